"""Repeated phrases and ranked search against brute force and SQL."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGE_TEXTS
from tests.llm.test_tables import as_counter, in_duckdb
from waymark.llm import lexical_search, phrase_automata
from waymark.llm.queries import QUERIES, SQL

# Repeated phrases.


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def phrases_by_force(rows, size=phrase_automata.LENGTH):
    split = [words_of(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = Counter()
    for (doc_id, _), w in zip(rows, split, strict=True):
        gone = {i + j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(size)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def phrase_rows(rng):
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "😀", "A", "a", "x#y"]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [draw(n) for n in (34, 35, 36, 40, 70, 120)]
    line, rows = draw(12), []
    for i in range(160):
        body = draw(rng.randrange(0, 90))
        for _ in range(rng.randrange(3)):
            passage = rng.choice(passages)
            low = rng.randrange(len(passage))
            at = rng.randrange(len(body) + 1)
            body[at:at] = rng.choice([passage, passage, passage[low:], passage[: low + 1]])
        if i % 2:
            at = rng.randrange(len(body) + 1)
            body[at:at] = line  # the windows around a line that is everywhere
        rows.append((i % 150, rng.choice([" ", "\t \n", "\x0b"]).join(body)))
    rows.append((900, " ".join(["same"] * 80)))
    rows.append((901, " ".join((["a", "b", "c"] * 40)[:100])))
    rows.append((902, "\xa0".join(draw(50)) + "\x1c " + " ".join(draw(50))))
    return rows + EDGE_TEXTS


def test_phrases_match_force_and_sql(spark):
    rows = phrase_rows(random.Random(12))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({"k1": F.lit("clash"), "ranges": F.lit(0)})
    found = phrase_automata.without_repeated_phrases(docs)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()) == phrases_by_force(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in found.collect())
    assert as_counter(found.drop("kept_text")) == in_duckdb(SQL["op12_phrases"], documents=docs.select("doc_id", "text"))


def test_frequent_grams_change_no_result(spark, monkeypatch):
    monkeypatch.setattr(phrase_automata, "COUNTERS", 400)
    rows = phrase_rows(random.Random(13))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len(phrase_automata.frequent_grams(docs)) >= 5
    found = phrase_automata.without_repeated_phrases(docs, keep_text=False).collect()
    assert Counter(tuple(r) for r in found) == phrases_by_force(rows)


def test_counters_keep_every_frequent_name():
    rng = np.random.default_rng(4)
    names, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    everything = Counter()
    for _ in range(30):
        batch = np.concatenate([rng.integers(0, 5000, 300), rng.integers(0, 5, 60)]).astype(np.uint64)
        everything.update(batch.tolist())
        total += len(batch)
        both, at = np.unique(np.concatenate([names, *[batch]]), return_inverse=True)
        sums = np.bincount(at, np.concatenate([counts, np.ones(len(batch))]), len(both)).astype(np.int64)
        names, counts = phrase_automata._fewest(both, sums, 50)
        assert len(names) <= 50
    held = dict(zip(names.tolist(), counts.tolist(), strict=True))
    assert all(everything[n] - total / 51 <= held.get(n, 0) <= everything[n] for n in everything)


def test_anchors_follow_the_words_of_a_window():
    rng = random.Random(5)
    passage = [f"v{i}" for i in range(35)]
    texts = [" ".join([f"w{rng.randrange(50)}" for _ in range(n)] + passage + ["end"] * n) for n in (0, 3, 60)]
    row, first, last, anchor = phrase_automata.runs_of(pa.array(texts), np.zeros(0, np.uint64))
    own = {}
    for r, a, b, name in zip(row, first, last, anchor, strict=True):
        for start in range(a, b + 1):
            assert (r, start) not in own
            own[r, start] = name
    assert len({own[i, n] for i, n in enumerate((0, 3, 60))}) == 1
    assert {k for k in own if k[0] == 0} == {(0, 0)}


def test_a_passage_is_cut_where_an_occurrence_ends():
    word = lambda a, b: b" ".join(b"t%d" % i for i in range(a, b))
    texts = pa.array([word(0, 50), word(0, 36) + b" x", b"y " + word(10, 50)], pa.large_binary())
    shard = phrase_automata.Shard(np.full(3, 9, np.uint64), texts, np.ones(3, np.int64))
    assert sorted(shard.passages()) == sorted([b" " + word(0, 36) + b" ", b" " + word(10, 50) + b" "])
    assert list(zip(*map(list, shard.located()), strict=True)) == [(0, 0, 50), (1, 0, 36), (2, 1, 41)]


def test_phrases_of_no_rows(spark):
    assert phrase_automata.without_repeated_phrases(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("name", ["op12_phrases", "op13_search"])
def test_queries_match_sql_on_the_small_tables(spark, name):
    folder = "/root/testdata/sf0.001"
    frames = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark")}
    assert as_counter(QUERIES[name](spark, folder)) == in_duckdb(SQL[name], **frames)


# Ranked search.

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def ranks_by_force(docs, items, top=lexical_search.TOP):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = Counter()
    for item, terms in asked.items():
        scored = []
        for i, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scored)[:top], 1):
            out[item, rank, i, -score] += 1
    return out


def search_rows(rng):
    vocabulary = [f"t{i}" for i in range(120)] + ["É", "é", "ÀB", "x_y", "a-b", "7", "😀"]
    text = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(rng.choice([None, *range(500)]), text(int(2 ** rng.uniform(0, 9)))) for _ in range(500)] + EDGE_TEXTS
    items = [(i, text(rng.randrange(1, 25))) for i in range(25)] + [(3, "T3 t90 again"), (None, "t1 t2"), (None, "t5"), (77, None), (78, ""), (79, "nowhere"), (80, "T0 " * 50)]
    return docs, items


@pytest.mark.parametrize("block_chars", [1 << 20, 300])
def test_search_matches_force_and_sql(spark, monkeypatch, block_chars):
    monkeypatch.setattr(lexical_search, "FIRST_BUCKET", 16)
    docs, items = search_rows(random.Random(13))
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({"n": F.lit("clash"), "terms": F.lit(1)})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    found = lexical_search.ranked(rows, asked, block_chars)
    assert Counter(tuple(r) for r in found.collect()) == ranks_by_force(docs, items)
    merged = spark.createDataFrame([(i, " ".join(t or "" for j, t in items if j == i)) for i in dict.fromkeys(i for i, _ in items)], "item_id long, text string")
    assert as_counter(found) == in_duckdb(SQL["op13_search"], documents=rows.select("doc_id", "text"), benchmark=merged)


def test_empty_search(spark):
    docs = spark.createDataFrame([(1, None), (2, "...")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.ranked(docs, items).collect() == []
    assert lexical_search.ranked(docs.limit(0), items).collect() == []
    assert lexical_search.ranked(spark.createDataFrame([(1, "a b")], docs.schema), items.limit(0)).collect() == []


def test_buckets_are_pruned_and_nothing_is_lost():
    rng = np.random.default_rng(8)
    n, terms = 6000, 60
    sizes = rng.integers(1, 12, n)
    names = np.concatenate([np.sort(rng.choice(terms, s, replace=False)) for s in sizes])
    times = rng.integers(1, 6, sizes.sum())
    m = rng.integers(50, 400, n)
    shard = lexical_search.Shard(np.arange(n), np.zeros(n, bool), m, np.concatenate([[0], np.cumsum(sizes)]), names, times)
    assert (np.diff(shard.norms) <= 0).all()
    dense = np.zeros((n, terms), np.int64)
    dense[np.repeat(np.arange(n), sizes), names] = (10**9 * times) // (1000 * times + 20 * np.repeat(m, sizes))
    scored = 0
    for _ in range(20):
        asked = np.sort(rng.choice(terms, 8, replace=False))
        query = np.zeros(terms, np.int64)
        query[asked] = rng.integers(1, 9000, 8)
        best = lexical_search.Best()
        scored += lexical_search.search(shard, asked, query[asked], query, best)
        scores = dense @ query
        order = np.lexsort((np.arange(n), -scores))[: lexical_search.TOP]
        assert best.ids.tolist() == order.tolist() and best.scores.tolist() == scores[order].tolist()
    assert scored < 20 * n / 2

"""Mixing, decontamination, search, URL filters, and the pipeline."""

import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import EDGE_TEXTS
from tests.llm.test_texts import base_by_force, components_by_force, near_copies, words
from waymark.llm import decontaminate, graph, maxscore, mixing, tables, urls
from waymark.llm.queries import QUERIES, SQL


def in_duckdb(sql, **frames):
    connection = duckdb.connect()
    for name, frame in frames.items():
        connection.register(name, frame.toArrow())
    result = connection.execute(sql)
    names = [c[0] for c in result.description]
    return Counter(tuple(sorted(zip(names, row))) for row in result.fetchall())


def as_counter(df):
    return Counter(tuple(sorted(r.asDict().items())) for r in df.collect())


# Connected components.


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 400)]
    star = [(1000, i) for i in range(1001, 1400)]
    wild = [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    edges = chain + star + wild + [(5, 5), (7, 6), (7, 6), (6, 7)]
    rng.shuffle(edges)
    found = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    neighbours = defaultdict(set)
    for a, b in edges:
        neighbours[a].add(b)
        neighbours[b].add(a)
    for start, component in found.items():
        seen, todo = {start}, [start]
        while todo:
            for x in neighbours[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert component == min(seen)
    assert set(found) == {x for e in edges for x in e if e[0] != e[1]}


def test_no_edges(spark):
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


# Mixing.


def mix_rows(documents):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 30)), "big" if i % 10 else f"small{i % 4}") for i in range(400)]
    docs = documents([(i, t) for i, t, _ in rows] + EDGE_TEXTS)
    source = F.when(F.col("doc_id").isNull(), None).when(F.col("doc_id") % 10 != 0, "big").otherwise(F.concat(F.lit("small"), F.col("doc_id") % 4))
    return docs.withColumn("source", source).withColumns({"epoch": F.lit("clash"), "mix_block": F.lit(1)})


def test_mix_matches_sql(documents):
    docs = mix_rows(documents)
    assert as_counter(mixing.mixed(docs, mixing.Target(max_repeats=mixing.MAX_REPEATS)).drop("text_hash")) == in_duckdb(mixing.SQL, documents=docs)


def test_repetition_limit_and_epochs(documents):
    docs = mix_rows(documents)
    mix = mixing.mixed(docs, mixing.Target(max_repeats=2.0)).collect()
    tokens = Counter()
    for r in docs.collect():
        tokens[r.source] += len(words(r.text))
    drawn = Counter()
    for r in mix:
        drawn[r.source] += r.n_tokens
        assert r.epoch <= 2
    assert drawn["small0"] > 1.3 * tokens["small0"]
    for source, n in drawn.items():
        longest = max(r.n_tokens for r in mix if r.source == source)
        assert n <= 2.0 * tokens[source] + longest
    whole = {r.doc_id for r in mix if r.source == "small0" and r.epoch == 0}
    assert whole == {r.doc_id for r in docs.collect() if r.source == "small0" and words(r.text)}


def test_entropy_target(documents):
    docs = mix_rows(documents)
    totals = docs.groupBy("source").agg(F.sum(mixing.token_count(F.col("text"))).alias("tokens")).where("tokens > 0")
    sizes = np.array([r.tokens for r in totals.collect()], float)

    def entropy(x):
        weights = (sizes / sizes.sum()) ** x
        weights = weights / weights.sum()
        return -sum(weights * np.log(weights))

    for share in (0.5, 0.9, 1.0):
        x = mixing.exponent(totals, int(sizes.sum()), len(sizes), int(sizes.sum()), mixing.Target(entropy_share=share))
        assert entropy(x) >= share * math.log(len(sizes)) - 1e-9
        assert x in (0.0, 1.0) or entropy(x + 1e-6) < share * math.log(len(sizes))


def test_blocks_hold_the_weights(documents):
    docs = mix_rows(documents)
    mix = mixing.mixed(docs, mixing.Target(max_repeats=2.0), block_tokens=6000).collect()
    blocks = 1 + max(r.block for r in mix)
    per = defaultdict(Counter)
    for r in mix:
        per[r.block][r.source] += r.n_tokens
    assert blocks > 2
    for source in ("big", "small0"):
        longest = max(r.n_tokens for r in mix if r.source == source)
        shares = [per[b][source] for b in range(blocks)]
        assert max(shares) - min(shares) <= 2 * longest + 1


@pytest.mark.parametrize("limit", [mixing.LOOKUP_BUCKETS, 0])
def test_mixed_documents_are_the_mix(documents, monkeypatch, limit):
    monkeypatch.setattr(mixing, "LOOKUP_BUCKETS", limit)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    docs = mix_rows(documents).withColumns({"row": F.lit("clash"), "key": F.lit(2), "hash": F.lit(3), "cuts": F.lit(4)})
    out = mixing.mixed_documents(docs, mixing.Target(max_repeats=2.0), block_tokens=600)
    assert out.columns == [*[c for c in docs.columns if c != "mix_block"], "mix_epoch", "mix_block", "mix_place"]
    expected = mixing.mixed(docs, mixing.Target(max_repeats=2.0), block_tokens=600).collect()
    assert Counter((r.doc_id, r.source, r.mix_epoch, r.mix_block, r.mix_place) for r in out.collect()) == Counter(
        (r.doc_id, r.source, r.epoch, r.block, r.place) for r in expected
    )
    assert max(r.block for r in expected) > 3
    assert mixing.mixed_documents(docs.limit(0)).collect() == []


def test_repeated_rows_and_rows_without_ids_obey_the_quota(spark):
    rows = [(7, "a b c", "x", i) for i in range(1000)] + [(None, f"w{i} w", "y", i) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(5)
    target = mixing.Target(max_repeats=2.0)
    mix = mixing.mixed(docs, target, budget=900).collect()
    tokens = Counter()
    for r in mix:
        tokens[r.source] += r.n_tokens
    assert 449 <= tokens["x"] < 460 and 449 <= tokens["y"] < 460
    out = mixing.mixed_documents(docs, target, budget=900).collect()
    assert Counter((r.source, r.mix_block, r.mix_place) for r in out) == Counter((r.source, r.block, r.place) for r in mix)
    assert len({r.n for r in out if r.source == "x"}) == sum(r.source == "x" for r in mix)  # each row once
    whole = mixing.mixed(docs, target, budget=9000).collect()
    assert len({r.place for r in whole if r.source == "y" and r.epoch == 0}) == sum(r.source == "y" and r.epoch == 0 for r in whole)


def test_offsets_in_two_levels(spark):
    rng = random.Random(2)
    rows = [("s", 0, f"{i:03x}", 3, rng.randrange(9)) for i in range(4096) if rng.random() < 0.3] + [("t", 1, f"{i:x}", 1, 5) for i in range(16)]
    copies = spark.createDataFrame(rows, "stream string, epoch long, bucket string, digits int, n_tokens long")
    found = {(r.stream, r.bucket): r.offset for r in mixing._offsets(copies, ["stream", "epoch"]).collect()}
    for stream in "st":
        total = 0
        for _, _, bucket, _, n in sorted(r for r in rows if r[0] == stream):
            assert found[stream, bucket] == total
            total += n


# Decontamination.


def leaky(spark, documents):
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 15, 30])))) for i in range(12)]
    items += [(50, None), (51, ""), (0, items[0][1]), (1, "another text of a repeated item id with enough words to be found again")]
    rows = []
    for i in range(80):
        text = [word() for _ in range(rng.randrange(60))]
        item = words(rng.choice(items[:12])[1])
        changed = [w if rng.random() > (i % 4) * 0.06 else "changed" for w in item]
        place = rng.randrange(len(text) + 1)
        rows.append((i, " ".join(text[:place] + (changed if i % 2 else []) + text[place:]).upper() + "!"))
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return documents([*rows, *EDGE_TEXTS]).withColumn("item_id", F.lit("clash")), benchmark, dict(items[:12])


def test_overlaps_match_sql(spark, documents):
    docs, benchmark, _ = leaky(spark, documents)
    benchmark = benchmark.where("item_id > 1").dropDuplicates(["item_id"])
    assert as_counter(decontaminate.overlaps(docs, benchmark).drop("text_hash")) == in_duckdb(decontaminate.SQL, documents=docs, benchmark=benchmark)


def test_whole_passages_are_found_and_clean_documents_stay(spark, documents):
    docs, benchmark, items = leaky(spark, documents)
    found = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, benchmark).collect()}
    texts = {r.doc_id: words(r.text.replace("!", "")) for r in docs.collect() if r.doc_id is not None and r.text}
    for doc_id, text in texts.items():
        for item_id, item in items.items():
            item = words(item)
            whole = any(text[k : k + len(item)] == item for k in range(len(text)))
            if whole and len(item) >= 15:
                assert (doc_id, item_id) in found
    assert all(doc_id is not None and doc_id % 2 for doc_id, _ in found)
    kept = decontaminate.without_overlaps(docs, benchmark)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - len({d for d, _ in found})


def test_nothing_to_search(spark, documents):
    docs, benchmark, _ = leaky(spark, documents)
    assert decontaminate.overlaps(docs.limit(0), benchmark).collect() == []
    assert decontaminate.without_overlaps(docs, benchmark.limit(0)).count() == docs.count()


def test_a_substitution_in_every_fifth_word_is_found(spark, documents):
    item = [f"i{k}" for k in range(30)]
    for first in range(5):
        text = " ".join("z" if k % 5 == first else w for k, w in enumerate(item))
        found = decontaminate.overlaps(documents([(1, text)]), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
        assert [(r.doc_id, r.item_id) for r in found] == [(1, 1)]


def overlaps_by_force(docs, items):
    """The pairs of which any stretch of any shift satisfies the declared rule; no seeds, no scores."""
    found = set()
    for doc_id, text in docs:
        for item_id, item in items:
            for shift in range(-len(item) + 1, len(text)):
                first, last = max(0, -shift), min(len(item), len(text) - shift)
                hits = [0]
                for k in range(first, last):
                    hits.append(hits[-1] + (item[k] == text[k + shift]))
                for i in range(len(hits)):
                    for j in range(i + 10, len(hits)):
                        if hits[j] - hits[i] >= 13 and 4 * (hits[j] - hits[i]) >= 3 * (j - i):
                            found.add((doc_id, item_id))
    return found


def checked_overlaps(spark, documents, docs, items):
    """The pairs found, after each row is held against the texts and the rule."""
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    rows = decontaminate.overlaps(documents([(i, " ".join(t)) for i, t in docs]), benchmark).collect()
    for r in rows:
        text, item = dict(docs)[r.doc_id][r.doc_start :][: r.length], dict(items)[r.item_id][r.item_start :][: r.length]
        assert len(text) == len(item) == r.length and sum(x == y for x, y in zip(text, item)) == r.matched
        assert r.matched >= 13 and r.matched * 4 >= r.length * 3
    return {(r.doc_id, r.item_id) for r in rows}


def replaced(item, places):
    return [f"z{k}" if k in places else w for k, w in enumerate(item)]


def test_any_stretch_by_the_rule_is_found(spark, documents):
    """Words replaced near an end (14 of 15 match), and stretches that the best score joins or trims."""
    item = [f"i{k}" for k in range(15)]
    long = [f"j{k}" for k in range(45)]
    docs = [(1, replaced(item, {2})), (2, replaced(item, {12})), (3, replaced(item, set(range(3, 8)))), (4, replaced(long, {*range(14, 20), *range(33, 45)}))]
    items = [(1, item), (2, long)]
    assert overlaps_by_force(docs, items) == {(1, 1), (2, 1), (4, 2)}
    assert checked_overlaps(spark, documents, docs, items) == {(1, 1), (2, 1), (4, 2)}


def unseeded(length):
    """The most matches that a stretch of this length can have without a seed."""
    span = max(map(len, decontaminate.MASKS))
    masks = [int(mask, 2) for mask in decontaminate.MASKS]
    most = {0: 0}  # by the last matches and mismatches, as bits
    for _ in range(length):
        longer = {}
        for last, matches in most.items():
            for bit in (0, 1):
                window = (last << 1 | bit) & (2**span - 1)
                if not any(window & mask == mask for mask in masks):
                    longer[window] = max(longer.get(window, 0), matches + bit)
        most = longer
    return max(most.values())


@pytest.mark.parametrize("length", range(13, 34))
def test_masks_are_lossless(length):
    assert unseeded(length) < max(13, math.ceil(length * 0.75))


def test_replacements_anywhere_are_found(spark, documents):
    rng = random.Random(5)
    items = [(i, [f"i{i}w{k}" for k in range(n)]) for i, n in enumerate([15, 17, 20, 24, 48])]
    docs = [(1, replaced(items[0][1], {6, 8})), (2, replaced(items[4][1], set(range(3, 48, 4))))]
    for i, item in items:
        for k in range(12):
            docs.append((100 * i + 10 + k, ["z"] * (k % 3) + replaced(item, set(rng.sample(range(len(item)), len(item) // 4 + k % 2)))))
    expected = overlaps_by_force(docs, items)
    assert {(1, 0), (2, 4)} <= expected
    assert len(expected) > 20 and checked_overlaps(spark, documents, docs, items) == expected


def test_short_items_are_found_whole(spark, documents):
    items = [(n, [f"i{n}w{k}" for k in range(n)]) for n in (9, 10, 11, 12, 13)]
    docs = [(n, ["a", *item, "b"]) for n, item in items] + [(100 + n, ["a", *replaced(item, {n - 1}), "b"]) for n, item in items]
    benchmark = spark.createDataFrame([(n, " ".join(item)) for n, item in items], "item_id long, text string")
    rows = decontaminate.overlaps(documents([(i, " ".join(t)) for i, t in docs]), benchmark).collect()
    found = sorted((r.doc_id, r.item_id, r.doc_start, r.item_start, r.length, r.matched) for r in rows)
    assert found == [(n, n, 1, 0, n, n) for n in (10, 11, 12, 13)]


# Search.


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def test_search_against_all_rows(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 24))
    rows = [(int(i), [float(x) for x in base[i]], "clash") for i in range(300)]
    rows += [(1000 + i, rows[3][1], "copy") for i in range(8)]
    rows += [(2000, None, ""), (2050, [None] * 24, ""), (2100, [float("nan")] * 24, ""), (2150, [float("inf")] * 24, ""), (None, rows[0][1], "")]
    df = vectors(spark, rows)
    whole = maxscore.integer_vectors(df)
    asked = whole.where(F.col("vec_id") % maxscore.EVERY == 0)
    assert as_counter(maxscore.top_products(whole, asked)) == in_duckdb(maxscore.SQL, embeddings=df)


def test_search_with_few_rows_and_other_lengths(spark):
    whole = maxscore.integer_vectors(vectors(spark, [(0, [1.0, 2.0], ""), (1, [0.5], ""), (2, [], ""), (2, [], "")]))
    found = maxscore.top_products(whole, whole.where("vec_id = 0")).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 1, 256 * 128), (2, 2, 0)]
    nothing = whole.limit(0)
    assert maxscore.top_products(nothing, nothing).collect() == []


def test_very_large_components(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(-(2**42), 2**42) / 256 for _ in range(6)], "") for i in range(60)]
    rows += [(100 + i, [float(rng.randrange(2**21)) for _ in range(6)], "") for i in range(40)]
    whole = maxscore.integer_vectors(vectors(spark, [(i, [x / 2**12 for x in v], s) for i, v, s in rows]))
    held = {r.vec_id: r.vector for r in whole.collect()}
    found = maxscore.top_products(whole, whole.where("vec_id = 50")).collect()
    scores = sorted((-sum(a * b for a, b in zip(held[50], v)), i) for i, v in held.items() if i != 50)
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(i, -s) for s, i in scores[:5]]
    huge = spark.createDataFrame([(0, [2**36, 2**36]), (1, [2**26, 1]), (2, [-(2**27), 3])], "vec_id long, vector array<long>")
    best = maxscore.top_products(huge, huge.where("vec_id = 1")).collect()
    assert [(r.vec_id, r.score) for r in best] == [(0, 2**62 + 2**36), (2, -(2**53) + 3)]
    for beyond in (spark.createDataFrame([(0, [2**40, 1]), (1, [2**40, 1])], "vec_id long, vector array<long>"), None):
        with pytest.raises(Exception, match="does not fit a long"):
            if beyond is None:
                maxscore.integer_vectors(vectors(spark, [(0, [1e300, 1.0], ""), (1, [1e18, 1.0], "")])).collect()
            else:
                maxscore.top_products(beyond, beyond.where("vec_id = 0")).collect()


def test_probing_stops_early_and_stays_exact():
    rng = np.random.default_rng(1)
    data = np.floor(rng.normal(size=(3000, 32)) * 40 * np.geomspace(1, 0.02, 32))
    shard = maxscore.Shard(np.arange(3000), data)
    for own in range(0, 3000, 500):
        ids, scores = shard.top(own, data[own], 5)
        exact = data @ data[own]
        exact[own] = -np.inf
        order = np.lexsort((np.arange(3000), -exact))[:5]
        assert ids.tolist() == order.tolist() and scores.tolist() == exact[order].tolist()


# URLs.

PAGES = [
    (1, "http://A.com/x?y", None),
    (2, "https://example.com/en/1", ""),
    (3, "https://www.example.com/en/1#t", "<a href='/en/'>"),
    (4, "https://example.com", ""),
    (5, "ftp://b.net/es/x", "<a href='http://c.org/'>"),
    (6, "https://b.net/fr/x", ""),
    (7, "https://b.net/en/x", ""),
    (8, "http://c.org/1", '<A HREF = "//b.net/es/1">x</a>'),
    (9, "no scheme", "<a href=http://b.net/>"),
    (10, None, None),
    (11, "http://d.org/x?u=http://a.com/", '<a href="https://b.net/"><a href="https://b.net/2">'),
    (11, "http://d.org/x?u=http://a.com/", '<a href="https://b.net/"><a href="https://b.net/2">'),
    (12, "://", ""),
    (13, "http://notcom/", ""),
    (14, "https://e.org/#x", '<a href="http://a.com/">'),
]


def pages(spark):
    return spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, host string")


def test_urls_match_sql(spark):
    assert as_counter(urls.judged(pages(spark))) == in_duckdb(urls.SQL, pages=pages(spark))


def test_rules_and_distrust(spark):
    found = {r.page_id: r for r in urls.judged(pages(spark)).collect()}
    assert (found[1].host, found[1].path, found[1].rule, found[1].verdict) == ("a.com", "/x", "com/", "allow")
    assert (found[2].rule, found[2].verdict) == ("example.com/en/", "block")
    assert (found[3].rule, found[3].verdict) == ("www.example.com/en/", "allow")
    assert (found[4].path, found[4].rule) == ("", None)
    assert (found[10].host, found[10].path, found[12].host) == ("", "", "")
    assert found[13].rule is None
    assert found[7].verdict == "block"  # two of three pages of the host are blocked
    assert urls.judged(pages(spark).limit(0)).collect() == []


def test_distrust_goes_against_links_and_trust_along(spark):
    rows = [(i, f"http://bad.net/es/{i}", "") for i in range(40)] + [(100, "http://friend.org/", "<a href='http://bad.net/'>" * 3)]
    rows += [(101, "http://linked.org/", ""), (102, "http://good.com/", "<a href='http://linked.org/'>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.verdict for r in urls.judged(df).collect()}
    assert found[100] == "block" and found[101] == "allow"


def test_distrust_reaches_hosts_many_links_away(spark):
    """At hop 16 a chain to 1000 blocked pages stands for at least 0.15 * 0.85^16 * 1000 = 11 of them."""
    rows = [(i, f"http://h0.net/es/{i}", "") for i in range(1000)]
    rows += [(1000 + k, f"http://h{k}.org/", f"<a href='http://h{k - 1}.{'org' if k > 1 else 'net'}/'>") for k in range(1, 17)]
    found = {r.page_id: r.verdict for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(found) == 1016 and set(found.values()) == {"block"}


# The pipeline and the registry.


def staged(spark, docs, name, folder):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, folder)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_every_stage_takes_edge_rows_and_nothing(spark, documents, folder, name):
    docs = documents(EDGE_TEXTS)
    out = staged(spark, docs, name, folder)
    assert out.columns[:5] == docs.columns and out.count() <= 12
    assert staged(spark, docs.limit(0), name, folder).collect() == []


def test_pipeline_runs_its_stages(spark, folder):
    docs = tables.table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, tables.stored(stage(spark, docs, folder), name)
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            kept = {i for i, _, c in components_by_force(rows) if i == c}
            assert {r.doc_id for r in docs.collect()} == kept
        if name == "decontamination":
            gone = {r.doc_id for r in decontaminate.overlaps(before, tables.table(spark, folder, "benchmark")).collect()}
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - gone
        if name == "personal_data":
            assert docs.count() == before.count()
            assert not any("email" in base_by_force(r.text) for r in docs.collect())
    assert as_counter(docs) == as_counter(corpus_pipeline.run(spark, folder))


def test_registry():
    assert list(QUERIES) == sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) and len(QUERIES) == 13
    assert set(SQL) <= set(QUERIES)
    assert near_copies(random.Random(1), 2)

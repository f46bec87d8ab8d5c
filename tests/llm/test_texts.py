"""Operators on whole texts against brute force."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm.conftest import EDGE_TEXTS
from waymark.llm import language_model, minhash, personal, suffix_dedup, text_arrays, token_counts, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOW))


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_word_hashes_agree_with_words():
    texts = [None, "", "One two  ONE", "a\tb\x0bc", "two", "é😀 é😀", " x "]
    hashes, offsets = text_arrays.word_hashes(pa.array(texts))
    names = {}
    for i, text in enumerate(texts):
        found = hashes[offsets[i] : offsets[i + 1]].tolist()
        assert len(found) == len(words(text))
        for word, value in zip(words(text), found):
            assert names.setdefault(word, value) == value
    assert len(set(names.values())) == len(names)


def test_pieces_hold_whole_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 50, "", "c" * 10]})
    parts = [p["text"].to_pylist() for p in text_arrays.pieces(batch, limit=20)]
    assert [t for p in parts for t in p] == batch["text"].to_pylist()
    assert ["b" * 50, ""] in parts or ["b" * 50] in parts


# Token counts.


def random_text(rng, size):
    return "".join(rng.choice("ab  \n\t'sreldvm1.,é😀 X") for _ in range(size))


def test_edits_keep_the_full_count():
    vocabulary = open(token_counts.VOCABULARY, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    full = tiktoken.Encoding("own", pat_str=token_counts.PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
    counter, rng = token_counts.Counter(vocabulary), random.Random(5)
    for _ in range(300):
        text = random_text(rng, rng.choice([0, 1, 20, 900]))
        columns = token_counts.Tree.columns(text, counter)
        tree = token_counts.Tree(*(c.tolist() for c in columns[:3]), *(c.copy() for c in columns[3:]))
        for _ in range(4):
            text, cut = tree.edit(text, rng.randrange(len(text) + 3), rng.choice([0, 1, 5, 2000]), random_text(rng, rng.choice([0, 1, 8, 100])), counter)
            assert tree.total == len(full.encode_ordinary(text))
            assert tree.chars[1] == len(text)


def test_a_small_edit_cuts_little_again():
    counter = token_counts.Counter(open(token_counts.VOCABULARY, "rb").read())
    text = "some plain words of a long text " * 5000
    columns = token_counts.Tree.columns(text, counter)
    tree = token_counts.Tree(*(c.tolist() for c in columns[:3]), *(c.copy() for c in columns[3:]))
    assert tree.edit(text, 80_000, 3, "new", counter)[1] < 50


def test_edited_table_on_edge_rows(spark, documents):
    docs = documents(EDGE_TEXTS).withColumn("tokens", F.lit("clash"))
    edits = spark.createDataFrame(
        [(2, 0, 0, 0, "new words"), (4, 1, 1, 99, None), (4, 0, 0, 0, "x "), (5, 0, 999, 1, "!"), (6, 0, None, None, "start ")],
        "doc_id long, seq int, start int, removed int, inserted string",
    )
    trees = token_counts.with_trees(docs.join(token_counts.gathered(edits), "doc_id", "left"))
    found = {r.doc_id: r for r in token_counts.edited(trees, keep_trees=True).collect()}
    assert len(trees.collect()) == len(EDGE_TEXTS)
    counter = token_counts.Counter(open(token_counts.VOCABULARY, "rb").read())
    expected = {2: "new words", 4: "x", 5: EDGE_TEXTS[4][1] + "!", 6: "start " + EDGE_TEXTS[5][1]}
    for doc_id, text in expected.items():
        assert found[doc_id].text == text
        assert found[doc_id].tokens_after == int(token_counts.Tree.columns(text, counter)[4][1])
    assert (found[1].tokens_before, found[1].tokens_after, found[1].n_edits) == (0, 0, 0)


def test_op1_counts_every_document(spark, folder, corpus):
    counter = token_counts.Counter(open(token_counts.VOCABULARY, "rb").read())
    found = {r.doc_id: r for r in token_counts.op1_token_counts(spark, folder).collect()}
    assert len(found) == corpus.count()
    for doc_id, text in rows_of(corpus):
        assert found[doc_id].tokens_before == int(token_counts.Tree.columns(text or "", counter)[4][1])


# Suffix dedup.


def removed_by_force(rows):
    first = {}
    for i, text in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: r[0]):
        data = (text or "").encode()
        for k in range(len(data) - 49):
            first.setdefault(data[k : k + 50], i)
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 49 if i is not None else 0):
            if first[data[k : k + 50]] < i:
                gone[k : k + 50] = True
        edges = np.flatnonzero(np.diff(gone.astype(int), prepend=0, append=0)).reshape(-1, 2).tolist()
        out.append((i, len(data), tuple(map(tuple, edges)), np.frombuffer(data, np.uint8)[~gone].tobytes()))
    return Counter(out)


def removed_by_operator(df, **options):
    found = suffix_dedup.repeated_spans(df, **options).collect()
    return Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in found)


@pytest.mark.parametrize("options", [{}, {"unit_bytes": 50_000}, {"unit_bytes": 100_000, "hot": 2}])
def test_repeated_strings_go(corpus, options):
    assert removed_by_operator(corpus, **options) == removed_by_force(rows_of(corpus))


@pytest.mark.parametrize("hot", [1, 10_000])
def test_repeated_strings_of_planted_passages(documents, hot):
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abcdefghij ü") for _ in range(n))
    passage, line = noise(120), "ab" * 40
    rows = [(i, noise(rng.randrange(80)) + rng.choice([passage, passage[:55], passage[30:], line, line + line, ""]) + noise(rng.randrange(80))) for i in range(60)]
    rows += [(3, passage), (70, passage + passage), (-5, line), *EDGE_TEXTS[:5], *EDGE_TEXTS[7:]]
    docs = documents(rows)
    assert removed_by_operator(docs, unit_bytes=2000, hot=hot) == removed_by_force(rows)


def test_repeated_strings_without_documents(documents, spark):
    assert suffix_dedup.repeated_spans(documents([(1, "x")]).limit(0)).collect() == []


def test_op2_digest(spark, folder, corpus):
    expected = {i: (n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for (i, n, spans, kept) in removed_by_force(rows_of(corpus))}
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op2_suffix_dedup(spark, folder).collect()}
    assert found == expected


# Personal data.

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    values = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def base_by_force(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in BASE for m in re.finditer(p, text or "") if passes(k, m.group()))


PERSONAL = [
    (21, "a@b.c_d@e.f x@y"),
    (22, "+1 (759) 555-2511, 1.2.3.4.5.6.7.8 256.1.1.1 00001.2.3.4"),
    (23, "é😀 4111 1111 1111 1111-4111-1111 3- 5 12 4111111111111111"),
    (24, "9" * 3000 + " " + "a" * 3000 + "@"),
    (25, "4111111111111111 " * 300),
    (26, "1-2-3 4 5-6-7 \n4111 1111 1111 1111 x@y.z..q@w.e-+1234567890"),
    (27, "a@" + ".b" * 5000),
]


def test_base_spans(documents):
    rows = [r for r in EDGE_TEXTS if r[0] != 8] + PERSONAL
    found = documents(rows).select("text", personal._written(personal.base_spans(F.coalesce("text", F.lit("")))).alias("spans")).collect()
    for r in found:
        assert r.spans == base_by_force(r.text)


def test_op5_base(spark, folder, corpus):
    texts = dict(rows_of(corpus))
    for r in personal.op5_personal(spark, folder).collect():
        base = base_by_force(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("id:")] == [s for s in base.split(",") if s]
        counts = Counter(s.split(":")[0] for s in r.spans.split(",") if s)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_id) == tuple(counts[k] for k in personal.KINDS)


def test_contexts_find_unseen_identifiers(documents):
    seeds = [(i, f"some words here contact ref: user{i}@mail.example.com and more") for i in range(8)]
    unseen = (100, "other words then contact ref: ab12-cd34x and the end")
    noise = [(200 + i, f"the count of items was 12345{i}6 in all of them") for i in range(8)]
    found = {r.doc_id: r.spans for r in personal.find_spans(documents([*seeds, unseen, *noise])).collect()}
    start = unseen[1].index("ab12")
    assert [(s.kind, s.start, s.end) for s in found[100]] == [(4, start, start + 10)]
    assert all(not found[200 + i] for i in range(8))


def test_redaction_keeps_rows_and_columns(documents):
    docs = documents([*EDGE_TEXTS, *PERSONAL]).withColumn("__x", F.lit(1))
    out = personal.redacted(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r for r in rows}
    assert texts[22].text == "[PHONE], [IP].[IP] 256.1.1.1 [IP]"
    assert texts[22].n_chars == len(texts[22].text)
    assert texts[5].text == EDGE_TEXTS[4][1] and texts[1].text is None


def test_redaction_of_nothing(documents):
    assert personal.redacted(documents([(1, "x")]).limit(0)).collect() == []


# Language model.


def test_scores_against_counts(documents):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary[: rng.choice([5, 60])]) for _ in range(rng.randrange(60)))) for i in range(120)] + EDGE_TEXTS
    docs = documents(rows)
    units = language_model.counted(docs, F.coalesce(F.col("doc_id") % 5 != 0, F.lit(True)), unit_bytes=40_000)
    model = language_model.fit_weights(units)
    found = defaultdict(list)
    for r in language_model.scored(units, model).collect():
        found[r.doc_id].append(r)
    words_, pairs = Counter(), Counter()
    for i, text in rows:
        if i is None or i % 5:
            tokens = [*words(text), None]
            words_.update(tokens)
            pairs.update(zip([None, *tokens], tokens))
    n, v = sum(words_.values()), len(words_)
    assert (model.tokens, model.words) == (n, v)
    assert np.allclose(model.by_bucket.sum(axis=1), 1)
    assert sum(map(len, found.values())) == len(rows)
    for i, text in rows:
        tokens = [*words(text), None]
        base = sum(math.log10((words_[t] + 1) / (n + v + 1)) for t in tokens)
        score = 0
        for before, t in zip([None, *tokens], tokens):
            c = words_[before]
            w = model.by_bucket[int(math.log2(c)) + 1 if c else 0]
            score += math.log10(w[0] * pairs[before, t] / max(c, 1) + w[1] * words_[t] / n + w[2] / (v + 1))
        assert any(
            math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9) and r.n_tokens == len(tokens) for r in found[i]
        )


def test_model_beats_base_on_held_out(spark, folder):
    rows = [r for r in language_model.op6_language_model(spark, folder).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)


def test_no_training_documents(documents):
    units = language_model.counted(documents(EDGE_TEXTS), F.lit(False))
    rows = language_model.scored(units, language_model.fit_weights(units)).collect()
    assert len(rows) == len(EDGE_TEXTS) and all(r.train_tokens == 0 and math.isfinite(r.score) for r in rows)


def trusted_by_force(mentions, rounds=personal.ROUNDS):
    edges = defaultdict(bool)
    for instance, known, patterns in mentions:
        for pattern in patterns:
            edges[pattern, instance] |= known
    seeds = {i: 1.0 for (_, i), known in edges.items() if known}
    scores = dict(seeds)
    for _ in range(rounds):
        held = defaultdict(list)
        for pattern, instance in edges:
            held[pattern].append(scores.get(instance, 0.0))
        confidence = {p: sum(x) / len(x) for p, x in held.items() if sum(v > 0 for v in x) >= personal.MIN_SUPPORT}
        confidence = {p: c for p, c in confidence.items() if c >= personal.MIN_CONFIDENCE}
        doubts = defaultdict(float)
        for pattern, instance in edges:
            if pattern in confidence:
                doubts[instance] += math.log(max(1 - confidence[pattern], 1e-9))
        scores = dict(seeds)
        for instance, doubt in doubts.items():
            scores[instance] = max(scores.get(instance, 0.0), 1 - math.exp(doubt))
    return confidence


def test_graph_rounds_match_plain_loops(spark):
    rng = random.Random(17)
    for share in (0.5, 0.8):
        mentions = []
        for _ in range(400):
            kind = rng.randrange(8)
            instance = f"i{kind if rng.random() < 0.8 else rng.randrange(8)}-{rng.randrange(12)}"
            known = instance[1] in "01" or (instance[1] == "2" and rng.random() < share)
            mentions.append((instance, known, [f"p{kind}", f"q{rng.randrange(3)} p{kind}"][: rng.randrange(1, 3)]))
        found = personal.trusted_patterns(spark.createDataFrame(mentions, "instance string, known boolean, patterns array<string>"))
        found = {r.pattern: r.confidence for r in found.collect()}
        expected = trusted_by_force(mentions)
        assert found.keys() == expected.keys() and len(found) > 2
        assert all(math.isclose(found[p], expected[p], rel_tol=1e-9) for p in found)


def test_identifiers_behind_learned_contexts_are_found(documents):
    """Behind a context three quarters of whose instances are addresses, all of 200 identifiers that
    no expression knows are found, and none of 200 codes behind other words."""
    rng = random.Random(18)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    code = lambda: f"{rng.choice('ABCDEF')}{rng.randrange(10**6, 10**7)}"
    rows, wanted = [], {}
    for i in range(1000):
        before, after = (" ".join(word() for _ in range(6)) for _ in range(2))
        if i % 5 < 3:
            middle = f"account holder: user{i}@host{i % 40}.example.org"
        elif i % 5 == 3:
            middle = f"account holder: {code()}"
        else:
            middle = f"{rng.choice(['version', 'chapter', 'part'])} {code()}"
        rows.append((i, f"{before} {middle} {after}"))
        wanted[i] = i % 5 == 3
    found = {r.doc_id: [s for s in r.spans if s["kind"] == personal.KINDS.index("id")] for r in personal.find_spans(documents(rows)).collect()}
    hits = sum(bool(found[i]) for i in wanted if wanted[i])
    false = sum(bool(found[i]) for i in wanted if not wanted[i])
    assert hits == 200 and false == 0
    for i, text in rows:
        if wanted[i]:
            assert [text[s["start"] : s["end"]] for s in found[i]] == [text.split("holder: ")[1].split(" ")[0]]
    texts = {r.doc_id: r.text for r in personal.redacted(documents(rows)).collect()}
    assert all(("holder: [ID] " in texts[i]) == wanted[i] for i in wanted)


def test_weights_match_plain_expectation_maximisation(documents):
    rng = random.Random(14)
    vocabulary = [f"w{i}" for i in range(60)]
    follow = {w: rng.choices(vocabulary, k=3) for w in vocabulary}
    rows = []
    for i in range(150):
        text = [rng.choice(vocabulary)]
        while len(text) < 40:
            text.append(rng.choice(follow[text[-1]]) if rng.random() < 0.7 else rng.choices(vocabulary, [1 / (k + 1) for k in range(60)])[0])
        rows.append((i, " ".join(text)))
    units = language_model.counted(documents(rows), F.lit(True), unit_bytes=8_000)
    model = language_model.fit_weights(units)
    docs = [[*words(t), None] for _, t in rows]  # None: the end token
    count, pairs = Counter(w for d in docs for w in d), Counter((d[k - 1], d[k]) for d in docs for k in range(len(d)))
    total, known = sum(count.values()), len(count)
    held = []
    for d in docs:  # each document is scored with its own counts deleted
        own, own_pairs = Counter(d), Counter((d[k - 1], d[k]) for k in range(len(d)))
        for k, w in enumerate(d):
            before = count[d[k - 1]] - own[d[k - 1]]
            share = (pairs[d[k - 1], w] - own_pairs[d[k - 1], w]) / before if before else 0.0
            bucket = min(before.bit_length(), language_model.BUCKETS - 1) if before else 0
            held.append((bucket, share, (count[w] - own[w]) / total, 1 / (known + 1)))
    for bucket in {b for b, *_ in held}:
        rows_of_bucket = np.array([e for b, *e in held if b == bucket])
        if bucket == 0 or len(rows_of_bucket) < 300:
            continue
        weights = np.full(3, 1 / 3)
        for _ in range(60):
            parts = weights * rows_of_bucket
            weights = (parts / parts.sum(axis=1, keepdims=True)).sum(axis=0) + 1
            weights = weights / weights.sum()
        assert np.abs(model.by_bucket[bucket] - weights).max() < 0.02


def test_no_documents_to_score(documents):
    units = language_model.counted(documents([(1, "x")]).limit(0), F.lit(True))
    assert language_model.scored(units, language_model.fit_weights(units)).collect() == []


# Near duplicates.


def components_by_force(rows):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return Counter((doc_id, len(sets[i]), least.get(root(i), doc_id)) for i, (doc_id, _) in enumerate(rows))


def near_copies(rng, count):
    out = []
    for base in range(6):
        text = [f"b{base}w{rng.randrange(500)}" for _ in range(80)]
        for i in range(count):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    return out


def test_components_against_all_pairs(documents):
    rng = random.Random(9)
    rows = list(enumerate(near_copies(rng, 25), start=1000)) + EDGE_TEXTS + [(10, "One"), (11, "a b c d"), (12, "a b c d"), (13, "a b c D e")]
    found = minhash.near_duplicates(documents(rows).withColumn("component_id", F.lit("clash"))).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == components_by_force(rows)


def test_op8_against_all_pairs(spark, folder, corpus):
    found = minhash.op8_minhash(spark, folder).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == components_by_force(rows_of(corpus))
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_an_id_with_several_texts(documents):
    rng = random.Random(4)
    a, b, c = (" ".join(f"{x}{rng.randrange(900)}" for _ in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (6, a + " z"), (7, b + " z"), (8, c), (5, c), (5, c), (None, a + " y"), (None, "alone without any id or any copy at all")]
    bridge = b.split()
    rows += [(20, " ".join(bridge[:50])), (None, " ".join(bridge[:40])), (21, " ".join(bridge[:33]))]  # linked by the row without an id
    docs = documents(rows)
    found = minhash.near_duplicates(docs).collect()
    expected = components_by_force(rows)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == Counter(
        {(i, n, None if i is None and c is None else c): k for (i, n, c), k in expected.items()}
    )
    kept = minhash.without_near_duplicates(docs).collect()
    texts = Counter(r.text for r in kept)
    assert texts[a] == texts[b] == texts[c] == texts["alone without any id or any copy at all"] == 1 and len(kept) == 4


def test_texts_just_below_are_not_paired(spark):
    """Forty texts with one template and similarity below 0.75, and ten copies of one of them."""
    rng = np.random.default_rng(5)
    template = np.arange(160)
    sets = [np.concatenate([template, rng.integers(10**6, 10**12, 31)]) for _ in range(40)]
    near = [np.append(sets[0][1:], 10**13 + i) for i in range(10)]
    rows = [(i, i, s.tolist()) for i, s in enumerate(sets)] + [(100 + i, 100, s.tolist()) for i, s in enumerate(near)]
    members = spark.createDataFrame(rows, "id long, component long, shingles array<long>")
    pairs = {(r.a, r.b) for r in minhash.rare_pairs(minhash.rare_first(members), members.select("id", "component")).collect()}
    similar = lambda x, y: 100 * len(set(x) & set(y)) >= 75 * len(set(x) | set(y))
    wanted = {(a, b) for a, i, x in rows for b, j, y in rows if a < b and i != j and similar(x, y)}
    assert wanted == {(0, 100 + i) for i in range(10)} and wanted <= pairs
    assert len(pairs) <= 20  # of 1180 pairs in different components


def test_rare_pairs_are_all_similar_pairs(spark):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        base = rng.randrange(5) * 1000
        rows.append((i, i // 2, sorted({base + rng.randrange(60) for _ in range(rng.randrange(20, 200))})))
    members = spark.createDataFrame(rows, "id long, component long, shingles array<long>")
    pairs = {(r.a, r.b) for r in minhash.rare_pairs(minhash.rare_first(members), members.select("id", "component")).collect()}
    for a, i, x in rows:
        for b, j, y in rows:
            if a < b and i != j and 100 * len(set(x) & set(y)) >= 75 * len(set(x) | set(y)):
                assert (a, b) in pairs
    assert all(rows[a][1] != rows[b][1] for a, b in pairs)


def test_one_document_of_a_group_stays(documents):
    docs = documents([*EDGE_TEXTS, (20, "the very same words"), (21, "the very same words")])
    kept = minhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 6, 8, None, None, 9, 20])
    assert minhash.without_near_duplicates(docs.limit(0)).collect() == []


# Toxicity.


def test_learned_words_decide(spark, documents):
    rng = random.Random(1)
    plain = lambda: " ".join(f"w{rng.randrange(40)}" for _ in range(30))
    rows = [(i, f"{plain()} {rng.choice(['vileness', 'nastiest'])} {plain()}" if i % 5 == 0 else plain()) for i in range(1500)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 1500, 2)], "doc_id long, toxic int")
    docs = documents([*rows, (None, "vileness"), (5000, None), (5001, "")]).withColumn("toxic", F.lit("clash"))
    model = toxicity.fit_toxicity(docs, labels)
    scores = toxicity.with_toxicity(docs, model).collect()
    assert len(scores) == len(rows) + 3
    for r in scores:
        assert 0 <= r.score <= 1
        if r.doc_id is not None and r.doc_id < 5000:
            assert (r.score >= 0.5) == (r.doc_id % 5 == 0)
        elif r.doc_id is not None:
            assert r.score < 0.5


def test_slope_of_the_risk_by_finite_differences():
    rng = np.random.default_rng(3)
    confirmed, drawn = (rng.random(40) < 0.4).astype(float), (rng.random(40) < 0.7).astype(float)
    confirmed, drawn = confirmed / confirmed.sum(), drawn / drawn.sum()
    seen = set()
    for prior, shift in ((0.1, 0.0), (0.3, -1.0), (0.6, 2.0), (0.9, 3.0), (0.95, -3.0)):
        z = rng.normal(size=40) + shift * np.sign(confirmed - drawn)
        clipped = toxicity.nnpu_risk(z, confirmed, drawn, prior)[1] < 0
        seen.add(clipped)
        found = toxicity.nnpu_slope(z, confirmed, drawn, prior)
        for i in range(40):
            ends = []
            for step in (1e-6, -1e-6):
                moved = z.copy()
                moved[i] += step
                missed, corrected = toxicity.nnpu_risk(moved, confirmed, drawn, prior)
                ends.append(-corrected if clipped else missed + corrected)
            assert math.isclose(found[i], (ends[0] - ends[1]) / 2e-6, abs_tol=1e-6)
    assert seen == {False, True}


def test_few_confirmed_texts_are_all_used(spark, documents):
    rng = random.Random(2)
    plain = lambda: " ".join(f"w{rng.randrange(40)}" for _ in range(30))
    docs = documents([(i, f"{plain()} vileness" if i % 10 == 0 else plain()) for i in range(600)])
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, max_unlabelled=200)
    held = [r for r in toxicity.with_toxicity(docs, model).collect() if r.doc_id is not None]
    assert all((r.score >= 0.5) == (r.doc_id % 10 == 0) for r in held)


def test_without_labels_nothing_is_toxic(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = documents(EDGE_TEXTS)
    assert {r.score for r in toxicity.with_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()} == {0.0}
    assert toxicity.with_toxicity(docs.limit(0), toxicity.fit_toxicity(docs.limit(0), labels)).collect() == []


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.op10_toxicity(spark, folder).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.95 * len(rows)

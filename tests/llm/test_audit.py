"""Filter interactions against brute force and SQL."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGE_TEXTS
from tests.llm.test_tables import as_counter, in_duckdb
from waymark.llm import filter_audit
from waymark.llm.queries import SQL


def audit_by_force(docs, labels):
    """``docs`` as (doc_id, text, source), ``labels`` as (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    smallest = {}
    for i, text, _ in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    found = []
    for i, text, source in docs:
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        fails = set()
        fails |= {"A"} if len(words) < 50 else set()
        fails |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else set()
        fails |= {"D"} if re.search("[#$%&*|]", text) else set()
        fails |= {"E"} if i is not None and smallest[text] < i else set()
        found.append((source or "", fails, i in good, i in toxic))
    rows = {}
    for part in {p for p, *_ in found}:
        total = Counter()
        for order in permutations("ABCDE"):
            alive = [x for x in found if x[0] == part]
            everyone = list(alive)
            for step, letter in enumerate(order, 1):
                gone = [x for x in alive if letter in x[1]]
                alive = [x for x in alive if letter not in x[1]]
                total[letter] += len(gone)
                failing = sum(letter in x[1] for x in everyone)
                rows[part, "".join(order), step] = [
                    letter, len(alive), len(gone), failing - len(gone), sum(x[1] == {letter} for x in everyone), sum(x[2] for x in gone), sum(x[3] for x in gone),
                ]
        for key, row in rows.items():
            if key[0] == part:
                row.append(total[row[0]])
    return {(*k, *v) for k, v in rows.items()}


def random_rows(rng, n):
    texts = [" ".join(rng.choice(["word", "Ab", "x#", "y", "ZZZ", "é", f"w{rng.randrange(200)}"]) for _ in range(rng.randrange(90))) for _ in range(n // 2)]
    return [(rng.choice([None, *range(n)]), rng.choice(texts), rng.choice(["a", "b", None, ""])) for _ in range(n)]


def test_audit_matches_force_and_sql(spark):
    rng = random.Random(11)
    rows = random_rows(rng, 150) + [(i, t, "edge" if i is None else "a") for i, t in EDGE_TEXTS]
    marks = [(rng.choice([None, *range(160)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).withColumns({"part": F.lit("clash"), "good": F.lit(7), "digest": F.lit(1)})
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("n", F.lit("clash"))
    found = filter_audit.interactions(filter_audit.cells(docs, labels))
    assert {tuple(r) for r in found.collect()} == audit_by_force(rows, marks)
    assert as_counter(found) == in_duckdb(SQL["op11_filter_audit"], documents=docs.select("doc_id", "text", "source"), labels=labels)


def test_empty_tables_and_labels(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.interactions(filter_audit.cells(docs, labels)).collect() == []
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    found = filter_audit.interactions(filter_audit.cells(one, labels)).collect()
    assert len(found) == 600 and {r.part for r in found} == {""} and all(r.removed == (r["filter"] == "A") for r in found)


def test_a_few_filters_of_ones_own(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 3, 0, 1), ("p", 3, 2, 2, 0)], "part string, mask int, n long, good long, toxic long")
    found = {(r.filter_order, r.step): r for r in filter_audit.interactions(cells, "XY").collect()}
    assert [found["XY", 2][c] for c in ("filter", "kept", "removed", "redundant", "shapley")] == ["Y", 5, 0, 2, 2]
    assert [found["YX", 1][c] for c in ("filter", "kept", "removed", "unique_fails", "good_lost", "shapley")] == ["Y", 8, 2, 0, 2, 2]
    assert found["XY", 1].unique_fails == 3 and found["YX", 2].toxic_lost == 1
    with pytest.raises(ValueError):
        filter_audit.interactions(cells, "ABCDEFG")


def test_digest_is_of_the_whole_text(spark):
    docs = spark.createDataFrame([(1, "é" * 3000, "s")], "doc_id long, text string, source string")
    assert bytes(filter_audit.document_masks(docs).first().digest) == hashlib.sha256(("é" * 3000).encode()).digest()

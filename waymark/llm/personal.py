"""Personal data by patterns and bootstrapped contexts.

The base finds e-mail addresses, IPv4 addresses, card and phone numbers by expression and
check. The method adds identifiers that no expression describes:

1. Candidates are runs of identifier characters with a digit or an at sign. Their left
   contexts (what is glued to them, and one or two words more) are lexical patterns.
2. Candidates that overlap a base span, or have the shape of a key or digest, are seeds.
3. On the graph of patterns and instances a pattern's confidence is the share of its instances
   that are known, weighted by their score; an instance's score is one minus the product of
   the doubts of its trusted patterns. Patterns with at least three known instances and
   enough confidence are trusted. Scores and confidences are computed in turn for some rounds.
4. What follows a trusted pattern and overlaps no base span is a span of the kind ``id``.

``redacted`` finds the spans a second time, against the trusted patterns, in the pass that
rewrites the texts, so no text moves. A pattern whose ending is trusted too adds nothing and is
left out; the others are part of the expression up to ``PATTERNS`` of them, beyond that the added
spans are joined to the texts.

Everything is DataFrame expressions. Candidates have ``MIN_LENGTH`` characters at least; shorter
runs of digits are not identifiers. Spans count code points, end exclusive. The patterns are
possessive where the plain ones are greedy, with the same matches, so long texts neither
backtrack nor overflow the stack.

A missing text is empty and has no spans. Missing ids are allowed; repeated rows are handled
each (equal instances count once in the graph). Only ``doc_id`` and ``text`` are read, all
other columns of ``redacted`` are kept, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.cluster import bounded_rows
from waymark.llm.tables import stored, table

KINDS = ("email", "ip", "card", "phone", "id")
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
# A whole chain of digits with single separators; only chains of 13 digits or more can pass.
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IDENTIFIER = r"(?<![A-Za-z0-9._%+@-])[A-Za-z._%+-]*+[0-9@][A-Za-z0-9._%+@-]*+"
_KEY_SHAPE = r"^(?:[0-9a-f]{32,}|[A-Z]{4}[A-Z0-9]{16})$"
CONTEXT_CHARS, MIN_LENGTH = 40, 6
MIN_SUPPORT, MIN_CONFIDENCE, ROUNDS = 3, 0.7, 3
PATTERNS = 20_000  # patterns that become part of an expression


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def _sums_before(lengths: Column) -> Column:
    """For each cell of an array, the sum of the cells before it, in steps of 64."""

    def add(cells: Column) -> Column:
        return F.aggregate(cells, F.lit(0).cast("long"), lambda s, x: s + x)

    def with_steps(cells: Column) -> Column:
        size = F.size(cells)
        steps = F.transform(F.sequence(F.lit(0), F.floor(size / 64).cast("int")), lambda i: add(F.slice(cells, i * 64 + 1, 64)))

        def from_steps(held: Column) -> Column:
            starts = F.transform(held, lambda _, i: add(F.slice(held, 1, i)))
            return _let(starts, lambda s: F.transform(cells, lambda _, i: s[F.floor(i / 64).cast("int")] + add(F.slice(cells, i - i % 64 + 1, i % 64))))

        return _let(steps, from_steps)

    return _let(lengths, with_steps)


def _matches(text: Column, pattern: str) -> Column:
    """All matches of an expression as ``start, end, found``."""
    length = lambda a: F.transform(a, lambda x: F.length(x).cast("long"))

    def placed(found: Column) -> Column:
        def between(gaps: Column) -> Column:
            widths = F.zip_with(F.slice(length(gaps), 1, F.size(found)), length(found), lambda g, w: g + w)
            starts = F.zip_with(_sums_before(widths), length(gaps), lambda before, g: before + g)
            return F.zip_with(
                F.slice(starts, 1, F.size(found)), found, lambda s, f: F.struct(s.alias("start"), (s + F.length(f)).alias("end"), f.alias("found"))
            )

        return _let(F.split(text, pattern, -1), between)

    all_found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return F.when(text.rlike(pattern), all_found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,found:string>>"))


def _passes_luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid_card(found: Column) -> Column:
    digits = F.translate(found, " -", "")
    return F.length(digits).between(13, 19) & _passes_luhn(digits)


def _valid_phone(found: Column) -> Column:
    return F.length(F.regexp_replace(found, "[^0-9]", "")).between(9, 15)


def base_spans(text: Column) -> Column:
    """Base spans as ``kind (index in KINDS), start, end``, by kind and start."""
    kinds = [
        (_EMAIL, None),
        (_IP, lambda x: x.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")),
        (_CARD, _valid_card),
        (_PHONE, _valid_phone),
    ]

    def spans_of(kind: int, pattern: str, valid: Callable[[Column], Column] | None) -> Column:
        found = _matches(text, pattern)
        found = F.filter(found, lambda m: valid(m["found"])) if valid else found
        return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    lists = [spans_of(kind, *rest) for kind, rest in enumerate(kinds)]
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    return F.when(text.rlike("[0-9@]"), F.concat(*lists)).otherwise(none)


def _patterns(text: Column, start: Column) -> Column:
    """Left contexts of a position, the shortest first."""
    size = F.least(start, F.lit(CONTEXT_CHARS)).cast("int")
    left = F.regexp_replace(F.lower(F.substring(text, (start - size + 1).cast("int"), size)), "[0-9]+", "0")

    def last(words: Column) -> Column:
        # The first of the words may be cut by the context's limit.
        whole = F.size(words) - F.when(start > CONTEXT_CHARS, 1).otherwise(0)
        tail = lambda n: F.when(whole >= n, F.array_join(F.slice(words, -n, n), " "))
        return F.filter(F.array(*[tail(n) for n in (1, 2, 3)]), lambda p: p.isNotNull() & (F.length(p) > 1))

    return _let(F.split(left, r"\s+", -1), last)


def _candidates(text: Column, spans: Column) -> Column:
    """Identifier-like runs with their contexts; ``known`` marks seeds, ``free`` those that
    overlap no base span."""
    runs = F.filter(_matches(text, _IDENTIFIER), lambda m: F.length(m["found"]) >= MIN_LENGTH)
    touched = lambda m: F.exists(spans, lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))
    return F.transform(
        runs,
        lambda m: F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            m["found"].alias("instance"),
            (touched(m) | m["found"].rlike(_KEY_SHAPE)).alias("known"),
            (~touched(m)).alias("free"),
            _patterns(text, m["start"]).alias("patterns"),
        ),
    )


def trusted_patterns(mentions: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Score the pattern-instance graph of ``mentions (instance, known, patterns)``.

    Returns ``(pattern, confidence)`` of the trusted patterns.
    """
    edges = mentions.select("instance", "known", F.explode("patterns").alias("pattern"))
    edges = stored(edges.groupBy("pattern", "instance").agg(F.max("known").alias("known")), "edges")
    seeds = stored(edges.where("known").select("instance", F.lit(1.0).alias("score")).distinct(), "scores")
    scores = seeds
    for round_ in range(rounds):
        scored = edges.join(scores, "instance", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        sums = scored.groupBy("pattern").agg(
            F.sum("score").alias("known"), F.count("*").alias("all"), F.sum((F.col("score") > 0).cast("int")).alias("support")
        )
        patterns = sums.where(F.col("support") >= MIN_SUPPORT).select("pattern", (F.col("known") / F.col("all")).alias("confidence"))
        patterns = stored(patterns.where(F.col("confidence") >= MIN_CONFIDENCE), "patterns")
        if round_ + 1 < rounds:
            doubt = F.ln(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))
            reached = edges.join(patterns, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(doubt))).alias("score"))
            scores = stored(reached.unionByName(seeds).groupBy("instance").agg(F.max("score").alias("score")), "scores")
    return patterns


def _mentioned(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, spans, candidates, row`` of every row, stored: base spans only."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text.alias("text"))
    rows = rows.withColumn("spans", base_spans(F.col("text")))
    seen = F.when(F.col("text").rlike("[0-9@]"), _candidates(F.col("text"), F.col("spans")))
    rows = rows.withColumn("candidates", seen).drop("text").withColumn("row", F.monotonically_increasing_id())
    return stored(rows, "spans")


def find_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, spans`` of every row: spans as ``kind, start, end`` by kind and start."""
    rows = _mentioned(docs)
    mentions = stored(rows.select("row", F.inline("candidates")), "mentions")
    return _with_added(rows, mentions, trusted_patterns(mentions))


def _with_added(rows: DataFrame, mentions: DataFrame, trusted: DataFrame) -> DataFrame:
    free = mentions.where("free").select("row", "start", "end", F.explode("patterns").alias("pattern"))
    added = free.join(trusted.select("pattern"), "pattern").select("row", "start", "end").distinct()
    added = added.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct(F.lit(KINDS.index("id")).alias("kind"), "start", "end"))).alias("added")
    )
    both = rows.join(added, "row", "left")
    spans = F.when(F.col("added").isNull(), F.col("spans")).otherwise(F.concat("spans", "added"))
    return both.select("doc_id", "text_hash", spans.alias("spans"))


def _least_patterns(trusted: DataFrame) -> DataFrame:
    """The trusted patterns none of whose endings (of one or two words) is trusted."""
    words = F.split("pattern", " ", -1)
    endings = F.array(*[F.when(F.size(words) > n, F.array_join(F.slice(words, -n, n), " ")) for n in (1, 2)])
    implied = trusted.select("pattern", F.explode(endings).alias("ending")).join(trusted.select(F.col("pattern").alias("ending")), "ending")
    return trusted.select("pattern").join(implied.select("pattern"), "pattern", "left_anti")


def all_spans(text: Column, patterns: list[str]) -> Column:
    """Base spans, and the free candidates behind one of the patterns, of a text."""

    def added(spans: Column) -> Column:
        behind = lambda c: c["free"] & F.exists(c["patterns"], lambda p: p.isin(patterns))
        kind = F.lit(KINDS.index("id")).alias("kind")
        return F.concat(spans, F.transform(F.filter(_candidates(text, spans), behind), lambda c: F.struct(kind, c["start"].alias("start"), c["end"].alias("end"))))

    return F.when(text.rlike("[0-9@]"), _let(base_spans(text), added)).otherwise(F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def _rebuilt(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def merge(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        overlaps = (F.size(kept) > 0) & (F.get(kept, F.size(kept) - 1)["end"] > s["start"])
        return F.when(overlaps, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(longer))).otherwise(F.concat(kept, F.array(s)))

    def written(kept: Column) -> Column:
        names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

        def piece(s: Column, i: Column) -> Column:
            begin = F.when(i == 0, F.lit(0)).otherwise(F.get(kept, i - 1)["end"]).cast("int")
            return F.concat(F.substring(text, begin + 1, s["start"].cast("int") - begin), names[s["kind"]])

        rest = F.expr("2147483647")
        end = F.element_at(kept, -1)["end"].cast("int")
        return F.concat(F.array_join(F.transform(kept, piece), ""), F.substring(text, end + 1, rest))

    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>")
    return _let(F.aggregate(order, empty, merge), written)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets, and ``n_chars``,
    if there is one, counted anew. Overlapping spans become one, named after the first."""
    rows = _mentioned(docs)
    mentions = stored(rows.select("row", F.inline("candidates")), "mentions")
    trusted = trusted_patterns(mentions)
    # Columns of the table stay inside a struct, apart from the names used here.
    whole = docs.select(F.struct("*").alias("row"))
    patterns = bounded_rows(_least_patterns(trusted), PATTERNS)
    if patterns is not None:
        found = whole.withColumn("spans", all_spans(F.coalesce("row.text", F.lit("")), sorted(r["pattern"] for r in patterns)))
    else:
        spans = _with_added(rows, mentions, trusted).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"])
        spans = stored(spans, "found")
        found = whole.join(spans, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("text_hash")), "left")
    hit = F.size(F.coalesce("spans", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"))) > 0
    found = found.select("row", F.when(hit, _rebuilt(F.col("row.text"), F.col("spans"))).alias("clean"))
    changed = {"text": F.coalesce("clean", "row.text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("clean").isNotNull(), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op5_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("id"))
    return found.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))

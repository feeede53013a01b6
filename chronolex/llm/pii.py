"""Personal data: fixed patterns, and identifiers found by bootstrapped contextual patterns.

Seed entities are the spans of the fixed patterns (e-mail, IP, card, phone), and secrets in known key formats.  Beside
them the bootstrap looks at candidates: identifier-like spans of at least MIN_TOKEN characters, which are tokens with a
digit or an @ and groups of digits with single spaces between them.  A span's lexical patterns are the word before it and
the word after it, each with the signs between, and with the span's shape (runs of digits, of letters and of both mixed,
and the length if there are no plain letters).

Patterns and instances form a graph, which is scored in passes.  An instance's score is 1 for a seed and 0 for what is
unknown, so unknown matches speak against a pattern and cannot lift it.  A pattern belongs to the kind for which the
scores of its distinct instances sum to most; that sum is its support, and its score is support / (instances + 1).
Patterns with a support of MIN_SUPPORT and a score of CONFIDENCE are kept, and their unknown instances become known with
the score 1 - product(1 - score of their kept patterns), which supports further patterns in the next pass, until a pass
keeps no pattern.  A candidate that a kept pattern matches is a new identifier, of the kind `<kind>_like`.

Edges are distinct (pattern, instance) pairs of hashes, counted in tasks before they are shuffled.  The kept patterns
that match anything but seeds are few; up to LITERAL_PATTERNS of them go into the expression that reads each text again,
so that no text is shuffled; more are joined with the candidates, and those with the texts.  Only column expressions are
used.

Positions count code points from 0, the end is exclusive.  Defined results: a null text is an empty one; repeated rows
give a row each and count as one instance; an empty table gives no rows; a null doc_id is kept; an overlap of kinds
keeps both spans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.llm.common import broadcast_checked, stored

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
SEED_KINDS = (*KINDS, SECRET)
# Each pattern finds what its plain form in PATTERNS_PLAIN finds, without scanning a run again from every place in it:
# a match can only begin where a run begins, or after an earlier match; possessive loops need no stack.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PATTERNS_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Public key formats, and hexadecimal strings as long as a digest that are assigned to something.
KEYS = r"""(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,72}|sk_live_[A-Za-z0-9]{24}|AIza[0-9A-Za-z_-]{35}|(?<=[=:] {0,2}["']?)(?=[0-9]{0,63}[a-f])(?=[a-f]{0,63}[0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}))(?![A-Za-z0-9_])"""
MAY_HOLD_KEYS = r"AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|AIza|[0-9a-f]{32}"
# A sentence's end is no part of a token or a group.
TOKEN = r"""(?<![^\s"'(<\[=:,;])[^\s"'()<>\[\]=:,;0-9@]*+[0-9@][^\s"'()<>\[\]=:,;]*(?<![.!?])"""
GROUPS = r"""(?<![^\s"'(<\[=:,;])\+?\(?[0-9](?:[0-9().-]*[0-9)])?(?: \(?[0-9](?:[0-9().-]*[0-9)])?)++"""
MIN_TOKEN, MIN_SUPPORT, CONFIDENCE = 6, 3.0, 0.5
#: Kept patterns, 8 bytes each, that are written into the expression over the texts.
LITERAL_PATTERNS = 10_000
#: Rows of pattern tables that are broadcast: three numbers each.
PATTERN_ROWS = 1_000_000
#: Matches whose places are summed in one go; more are summed by blocks, as an array that grows is copied each time.
SPAN_BLOCK = 256
SPAN = "array<struct<start:int,end:int,match:string>>"
FOUND = "array<struct<kind:string,start:int,end:int>>"


def spans(text: Column, regex: str) -> Column:
    """An array of (start, end, match) of the leftmost non-overlapping matches."""
    gaps = F.transform(F.split(text, regex, -1), F.length)
    both = F.arrays_zip(gaps.alias("g"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc, x):
        a = acc["at"] + x["g"]
        b = a + F.coalesce(F.length(x["m"]), F.lit(0))
        found = F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end"), x["m"].alias("match")))))
        return F.struct(b.alias("at"), found.alias("out"))

    def in_blocks(all_):
        numbers = F.sequence(F.lit(0), ((F.size(all_) - 1) / SPAN_BLOCK).cast("int"))
        blocks = F.transform(numbers, lambda i: F.aggregate(F.slice(all_, i * SPAN_BLOCK + 1, SPAN_BLOCK), start, step))
        first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        moved = lambda acc, b: F.transform(b["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["match"].alias("match")))
        return F.flatten(F.aggregate(blocks, first, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(moved(acc, b))).alias("out")), lambda acc: acc["out"]))

    # transform over an array of one names the zipped array, so that it is made once
    return F.get(F.transform(F.array(both), lambda z: F.when(F.size(z) <= SPAN_BLOCK, F.aggregate(z, start, step, lambda acc: acc["out"])).otherwise(in_blocks(z))), F.lit(0))


def _byte(part: Column) -> Column:
    return part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 0, F.substr(digits, i, F.lit(1)).cast("int")).otherwise(F.substr(digits, i, F.lit(1)).cast("int") * 2 - F.when(F.substr(digits, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)),
    )
    return total % 10 == 0


def with_base_spans(df: DataFrame) -> DataFrame:
    """row (all of df's columns), text and an array of spans for each of SEED_KINDS."""
    text = F.col("text")
    none = F.array().cast(SPAN)
    digits = lambda x: F.regexp_replace(x["match"], "[^0-9]", "")
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return df.select(
        "row",
        "text",
        F.when(F.contains(text, F.lit("@")), spans(text, EMAIL)).otherwise(none).alias("email"),
        F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(spans(text, IP), lambda x: F.forall(F.split(x["match"], r"\."), _byte))).otherwise(none).alias("ip"),
        F.when(text.rlike("[0-9][ -]?[0-9]"), F.filter(spans(text, CARD), lambda x: luhn(digits(x)))).otherwise(none).alias("card"),
        F.when(F.contains(text, F.lit("+")), F.filter(spans(text, PHONE), lambda x: F.length(digits(x)).between(9, 15))).otherwise(none).alias("phone"),
        F.when(text.rlike(MAY_HOLD_KEYS), spans(text, KEYS)).otherwise(none).alias(SECRET),
    )


def shape(span: Column) -> Column:
    """The span with 9 for each run of digits, a for each of letters and x for each of both mixed, and its length, up to
    24, unless it has plain letters."""
    runs = F.regexp_replace(span, r"(?<![0-9\p{L}])(?:(?:[0-9]++\p{L}++){2,}+[0-9]*+|(?:\p{L}++[0-9]++){2,}+\p{L}*+)", "\u0001")
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(runs, r"\p{L}+", "a"), "[0-9]+", "9"), "\u0001", "x")
    return F.concat_ws("/", runs, F.when(~F.contains(runs, F.lit("a")), F.least(F.length(span), F.lit(24)).cast("string")))


def candidates(found: DataFrame) -> DataFrame:
    """with_base_spans() and the column near: each seed and candidate with its kind (null: candidate) and its patterns.

    Texts without a digit or an @ have none.
    """
    text = F.col("text")
    marked = lambda c, kind: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"), kind.cast("string").alias("kind")))
    base = F.concat(*[marked(F.col(k), F.lit(k)) for k in SEED_KINDS])
    groups = F.when(text.rlike("[0-9] [(]?[0-9]"), spans(text, GROUPS)).otherwise(F.array().cast(SPAN))
    rows = found.withColumn("base", base).withColumn("more", F.when(text.rlike("[0-9@]"), F.array_distinct(F.concat(spans(text, TOKEN), groups))).otherwise(F.array().cast(SPAN)))
    free = lambda x: (F.length(x["match"]) >= MIN_TOKEN) & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    more = marked(F.filter("more", free), F.lit(None))
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", ""), "[0-9]+", "9")
    before = lambda x: plain(F.regexp_extract(F.substr(text, F.greatest(x["start"] - 39, F.lit(1)), F.least(x["start"], F.lit(40))), r"([\p{L}0-9_-]*[^\p{L}0-9]{0,4})$", 1))
    after = lambda x: plain(F.regexp_extract(F.substr(text, x["end"] + 1, F.lit(40)), r"^([^\p{L}0-9]{0,4}[\p{L}0-9_-]*)", 1))
    key = lambda side, word, x: F.xxhash64(F.lit(side), word, shape(x["match"]))
    near = F.transform(F.concat("base", more), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.xxhash64(x["match"]).alias("instance"), x["kind"].alias("kind"), F.array(key("before", before(x), x), key("after", after(x), x)).alias("patterns")))
    return rows.withColumn("near", near).drop("base", "more")


def edges_of(near: DataFrame) -> DataFrame:
    """(pattern, instance, kind): the distinct edges of candidates(), kind null if the instance is no seed there."""
    rows = near.select(F.explode("near").alias("s")).select(F.explode("s.patterns").alias("pattern"), "s.instance", "s.kind")
    return rows.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))


def score_patterns(edges: DataFrame, *, min_support: float = MIN_SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """The patterns kept: (pattern, kind, score), as scored when each was added. edges: (pattern, instance, kind), distinct."""
    edges = stored(edges.select("pattern", "instance", "kind"), "pii-edges")
    sizes = stored(edges.groupBy("pattern").agg(F.count("*").alias("n")), "pii-sizes")
    known = stored(edges.where("kind IS NOT NULL").groupBy("instance").agg(F.max("kind").alias("kind")).withColumn("score", F.lit(1.0)), "pii-known")
    kept = None
    while True:
        support = edges.select("pattern", "instance").join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("support")).where(F.col("support") >= min_support)
        best = support.groupBy("pattern").agg(F.max(F.struct("support", "kind")).alias("b")).select("pattern", "b.kind", "b.support")
        added = best.join(sizes, "pattern").select("pattern", "kind", (F.col("support") / (F.col("n") + 1)).alias("score")).where(F.col("score") >= confidence)
        added = stored(added if kept is None else added.join(kept.select("pattern"), "pattern", "left_anti"), "pii-added")
        if added.isEmpty():
            return added if kept is None else kept
        kept = added if kept is None else stored(kept.unionByName(added), "pii-kept")
        unknown = edges.select("pattern", "instance").join(broadcast_checked(added, PATTERN_ROWS), "pattern").join(known.select("instance"), "instance", "left_anti")
        # the sum of logarithms is that of 1 - score, and the kind is that of the best pattern
        found = unknown.groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("b"), (1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("score"))
        known = stored(known.unionByName(found.select("instance", "b.kind", "score")), "pii-known")


def matching(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """(pattern, kind): the kept patterns that match something else than seeds."""
    return edges.where("kind IS NULL").select("pattern").join(broadcast_checked(kept, PATTERN_ROWS), "pattern").select("pattern", "kind").distinct()


def with_all_spans(df: DataFrame, *, literal_patterns: int = LITERAL_PATTERNS, **options) -> DataFrame:
    """with_base_spans() and the column found, an array of (kind, start, end) in order."""
    near = candidates(with_base_spans(df))
    edges = stored(edges_of(near), "pii-edges")
    kept = stored(matching(edges, score_patterns(edges, **options)), "pii-patterns")
    rows = kept.limit(literal_patterns + 1).collect()
    like = lambda kind, x: F.struct(F.concat(kind, F.lit("_like")).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    if len(rows) <= literal_patterns:
        of: dict[str, list[int]] = {}
        for r in rows:
            of.setdefault(r["kind"], []).append(r["pattern"])
        none = F.lit(None).cast("string")
        kind = lambda x: reduce(lambda rest, k: F.when(F.exists(x["patterns"], lambda p: p.isin(of[k])), F.lit(k)).otherwise(rest), [k for k in reversed(SEED_KINDS) if k in of], none)
        named = F.transform(F.filter("near", lambda x: x["kind"].isNull()), lambda x: like(kind(x), x))
        found = F.filter(named, lambda x: x["kind"].isNotNull()) if rows else F.array().cast(FOUND)
        return near.withColumn("found", F.array_sort(found)).drop("near")
    rank = F.create_map(*[F.lit(v) for i, k in enumerate(SEED_KINDS) for v in (k, i)])
    keyed = near.withColumn("key", F.sha2("text", 256))
    each = keyed.select("key", F.explode(F.filter("near", lambda x: x["kind"].isNull())).alias("x")).select("key", "x", F.explode("x.patterns").alias("pattern"))
    each = each.join(kept, "pattern").groupBy("key", "x.start", "x.end").agg(F.min(F.struct(rank[F.col("kind")], "kind")).alias("k"))
    each = each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.concat(F.col("k.kind"), F.lit("_like")).alias("kind"), "start", "end"))).alias("found"))
    return keyed.join(each, "key", "left").withColumn("found", F.coalesce("found", F.array().cast(FOUND))).drop("near", "key")


def digests(df: DataFrame) -> DataFrame:
    """doc_id, the numbers of base spans, their digest, and all spans: base ones, secrets, and those found by patterns."""
    rows = with_all_spans(df.select("doc_id", "text"))
    named = lambda kind, c: F.transform(c, lambda x: F.concat_ws(":", kind if kind is not None else x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    base = F.concat(*[named(F.lit(k), F.col(k)) for k in KINDS])
    rows = rows.select(F.col("row.doc_id").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base"), F.concat(named(F.lit(SECRET), F.col(SECRET)), named(None, F.col("found"))).alias("more"))
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join(F.concat("base", "more"), ",").alias("spans"))


def redact(df: DataFrame, **options) -> DataFrame:
    """df with every span in text replaced by its kind in brackets; overlapping spans become one, named by the first."""
    rows = with_all_spans(df, **options)
    tagged = lambda c, kind: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.concat(F.lit("["), F.upper(kind(x)), F.lit("]")).alias("tag")))
    every = [tagged(F.col(k), lambda x, k=k: F.lit(k)) for k in SEED_KINDS] + [tagged(F.col("found"), lambda x: F.regexp_replace(x["kind"], "_like$", ""))]
    rows = rows.select("row", "text", F.array_sort(F.concat(*every)).alias("cuts"))
    text = F.col("text")

    def step(acc, x):
        gap = F.when(x["start"] >= acc["at"], F.concat(F.substr(text, acc["at"] + 1, x["start"] - acc["at"]), x["tag"])).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    cleaned = F.aggregate("cuts", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    rows = rows.select(F.col("row").withField("text", F.when(F.size("cuts") > 0, cleaned).otherwise(F.col("row.text"))).alias("row"))
    return rows.select("row.*")

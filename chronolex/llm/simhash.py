"""SimHash fingerprints of documents and a search of all fingerprints within a Hamming radius.

The terms of a text are its lower-case words, each as often as it stands there; a term's 64-bit hash votes for each bit
with the term's weight, its length up to 12, so that short function words count for little.  A bit is set if more than
half the weight votes for it.  The search keeps the bits in BLOCKS blocks: two fingerprints within a radius r differ in
at most r blocks, so they agree on some choice of BLOCKS - r blocks; there is a table for every choice, keyed by those
blocks, and a match is checked by its bit count and given once, by the first table that holds it.  Only distinct
fingerprints are searched, with the number of documents that have each.  RADIUS is chosen so that at least nine in ten
of the documents with a common set of five-word shingles of 0.8 and more are found.  Only column expressions are used.

The texts are shuffled once, by id: two joins read that exchange.  In the first each text is told how many characters
the document before it wants, and gives its beginning and no more; in the second it gets the beginning of the next one.
Votes are summed where the texts then are; two counters of 32 bits share a long.

Defined results: a null text is an empty one, whose fingerprint is all zeros, as is that of a text without words; equal
texts have equal fingerprints; repeated rows give a row each; rows with a null doc_id are one document that stands
before all others; of several texts with the next id, the one with the least hash is taken; an only document is its own
next; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.llm.common import stored

BLOCKS = 8
RADIUS = 5
MASK = 0x0000000100000001
#: Stands for a null id.
NO_ID = -(1 << 63)


def terms(text: Column, **constants: int) -> Column:
    """An array with a struct for each word: its hash h and weight w, whether it is the first, and the constants."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    fixed = [F.lit(v).alias(k) for k, v in constants.items()]
    return F.transform(words, lambda w, i: F.struct(*fixed, F.xxhash64(w).alias("h"), F.least(F.length(w), F.lit(12)).cast("long").alias("w"), (i == 0).alias("head")))


def vote(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and bits (long), from a column t with a struct of terms() or null; and n, the number of texts summed."""
    rows = rows.select(*keys, F.coalesce("t.h", F.lit(0).cast("long")).alias("h"), F.coalesce("t.w", F.lit(0).cast("long")).alias("w"), F.coalesce("t.head", F.lit(True)).cast("long").alias("head"))
    lanes = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(MASK)) * F.col("w")).alias(f"v{i}") for i in range(32)]
    votes = rows.groupBy(*keys).agg(*lanes, F.sum("w").alias("total"), F.sum("head").alias("n"))
    bits: Column = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"v{i}", 32)
        for bit, n in ((i, low), (i + 32, high)):
            bits = bits.bitwiseOR(F.when(2 * n > F.col("total"), F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")))
    return votes.select(*keys, bits.alias("bits"), "n")


def fingerprints(texts: DataFrame) -> DataFrame:
    """(key, text) -> (key, bits long): one row per key, which must name one text."""
    rows = texts.select("key", F.explode_outer(terms(F.coalesce("text", F.lit("")))).alias("t"))
    return vote(rows, "key").select("key", "bits")


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def next_ids(ids: DataFrame) -> DataFrame:
    """(id, next_id) for distinct ids: by ranges of ids, and from a range's last id to the next range's first.

    The table of ranges has a row per partition and so is broadcast.
    """
    ranged = stored(ids.distinct().repartitionByRange("id").withColumn("range", F.spark_partition_id()), "ranges")
    firsts = ranged.groupBy("range").agg(F.min("id").alias("first"))
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(Window.orderBy("range")), F.min("first").over(Window.partitionBy())).alias("beyond"))
    return ranged.join(F.broadcast(firsts), "range").select("id", F.coalesce(F.lead("id").over(Window.partitionBy("range").orderBy("id")), "beyond").alias("next_id"))


def with_edited(docs: DataFrame) -> DataFrame:
    """id, text, next_id, next_key and edited: the last quarter replaced by the beginning of the next document."""
    docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    take = F.floor(F.length("text") / 4).cast("int")
    asks = docs.groupBy("id").agg(F.max(take).alias("take"))
    asked = stored(next_ids(docs.select("id")).join(asks, "id").select(F.col("id").alias("of"), F.col("next_id").alias("id"), "take"), "asked")
    # both joins are merges by id, whatever the sizes, so that they share the exchange of the texts
    given = docs.join(asked.hint("merge"), "id").select("of", F.struct(F.xxhash64("text").alias("key"), F.substring(F.col("text"), F.lit(1), F.col("take")).alias("start"), F.col("id").alias("id")).alias("n"))
    nexts = given.groupBy("of").agg(F.min("n").alias("n")).select(F.col("of").alias("id"), "n")
    rows = docs.join(nexts.hint("merge"), "id")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - take), F.substring(F.col("n.start"), F.lit(1), take))
    return rows.select("id", "text", F.col("n.id").alias("next_id"), F.col("n.key").alias("next_key"), edited.alias("edited"))


def block_keys(bits: Column, blocks: int, radius: int) -> Column:
    """An array with a struct (table, value) for each choice of blocks - radius blocks."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(bits, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cut, cut[1:], strict=False)]
    made = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        value = F.lit(0).cast("long")
        for i in chosen:
            value = F.shiftleft(value, cut[i + 1] - cut[i]).bitwiseOR(part[i])
        made.append(F.struct(F.lit(t).alias("t"), value.alias("v")))
    return F.array(*made)


def within_radius(queries: DataFrame, all_bits: DataFrame, *, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, bits, n) for distinct queries and distinct bits, with n, that differ in at most radius bits: exact, each
    pair once. A block value that many fingerprints share is split by Spark's handling of skewed joins."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - (1 << a)) - (1 << 64 if b == 64 else 0) for a, b in zip(cut, cut[1:], strict=False)]
    a = queries.select(F.col("bits").alias("query"), F.explode(block_keys(F.col("bits"), blocks, radius)).alias("k")).select("query", "k.t", "k.v")
    b = all_bits.select("bits", "n", F.explode(block_keys(F.col("bits"), blocks, radius)).alias("k")).select("bits", "n", "k.t", "k.v")
    x = F.col("query").bitwiseXOR(F.col("bits"))
    close = a.hint("merge").join(b, ["t", "v"]).where(F.bit_count(x) <= radius)
    # tables are in the order of combinations(), so the first that holds a pair is that of its first agreeing blocks
    agree = F.array(*[x.bitwiseAND(F.lit(m)) == 0 for m in masks])
    first = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.get(agree, i))
    order = {c: t for t, c in enumerate(combinations(range(blocks), blocks - radius))}
    number = F.create_map(*[F.lit(v) for c, t in order.items() for v in (",".join(map(str, c)), t)])
    mine = F.try_element_at(number, F.array_join(F.slice(first, 1, blocks - radius), ",")) == F.col("t")
    return close.where(mine).select("query", "bits", "n")


def digests(docs: DataFrame) -> DataFrame:
    """Per document its and its edited text's fingerprints, their likeness, that to the next document, and n_near: for
    documents whose id is divisible by 20, the number of other documents within RADIUS bits; else null."""
    rows = with_edited(docs.select("doc_id", "text")).select("id", F.xxhash64("text").alias("key"), F.length("text").cast("long").alias("n_chars"), "next_id", "next_key", F.unhex(F.sha2("edited", 256)).alias("sha"), "text", "edited")
    keys = ("id", "key", "n_chars", "next_id", "next_key", "sha")
    both = F.concat(*[F.when(F.size(x) > 0, x).otherwise(F.array(F.struct(F.lit(k).alias("which"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("w"), F.lit(True).alias("head")))) for k, x in ((0, F.col("own")), (1, F.col("new")))])
    rows = rows.select(*keys, terms(F.col("text"), which=0).alias("own"), terms(F.col("edited"), which=1).alias("new"))
    votes = vote(rows.select(*keys, F.explode(both).alias("t")).select(*keys, F.col("t.which").alias("which"), "t"), *keys, "which")
    pick = lambda k, c: F.max(F.when(F.col("which") == k, F.col(c)))
    out = stored(votes.groupBy(*keys).agg(pick(0, "bits").alias("f"), pick(1, "bits").alias("e"), pick(0, "n").alias("copies")), "fingerprints")
    nexts = out.select(F.col("id").alias("next_id"), F.col("key").alias("next_key"), F.col("f").alias("x"))
    counted = out.groupBy(F.col("f").alias("bits")).agg(F.sum("copies").alias("n"))
    query = (F.col("id") % 20 == 0) & (F.col("id") != NO_ID)
    near = within_radius(out.where(query).select(F.col("f").alias("bits")).distinct(), counted).groupBy("query").agg(F.sum("n").alias("n_near"))
    out = out.join(nexts, ["next_id", "next_key"]).join(near, (F.col("f") == F.col("query")) & query, "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    shown = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return out.select(
        F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), shown("f").alias("fingerprint"), shown("e").alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("x")).alias("near_next"), (F.col("n_near") - 1).alias("n_near"),
    )

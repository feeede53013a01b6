"""Lines that many documents share: which to drop is told by a compressed keep bitmap for each document, not by new texts.

The keys of all lines are hashed to 128 bits and dealt to tasks by ranges of (hash, document), sorted there by document and
position, so that a line's occurrences stream by in order and the first of each document is seen without a buffer.  A line
that a third of all rows holds covers many ranges; what its tasks add up is one row each.

Null and empty texts are one empty line.  Rows that agree in doc_id and text are one document (also those without an id);
each gets the same bitmap.  Ties cannot be: a document has one line at a position.  Empty tables give empty tables, and other
columns of any name are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.llm.common import broadcast_checked, stored

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Repeated lines' hashes that are broadcast (16 bytes each); a line of more than this share of all lines is in it whatever their number.
FREQUENT_ROWS, HEAVY_SHARE = 1_000_000, 1e-4


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key_of(line: Column) -> Column:
    """line without blanks at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_hashes(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """doc_id, text_hash, at, h1, h2: the hash of each line's key of at least min_chars code points, and its place."""
    rows = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    keys = rows.select("doc_id", "text_hash", "at", key_of(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("doc_id", "text_hash", "at", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"))


def sorted_occurrences(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """line_hashes in ranges of (hash, document), sorted by position, with `first`: whether its document has the line for the first time."""
    document = ["h1", "h2", "doc_id", "text_hash"]
    ranges = line_hashes(docs, min_chars).repartitionByRange(*document).sortWithinPartitions(*document, "at")
    before = F.lag("at").over(Window.partitionBy(*document).orderBy("at"))
    # Rows of one doc_id and text stand side by side with equal places: those are one occurrence.
    return ranges.select(*document, "at", before.alias("before")).where("before IS NULL OR before < at").select(*document, "at", F.col("before").isNull().alias("first"))


def dropped_places(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """doc_id, text_hash, at: the lines to drop, which are those that at least min_docs documents hold; keep_first spares the
    one of the least (doc_id, text_hash, at).  With min_docs 1 and keep_first, every line stays once in the whole table."""
    seen = stored(sorted_occurrences(docs, min_chars), "lines")
    place = F.struct("doc_id", "text_hash", "at")
    firsts = [F.min(place).alias("one")] if keep_first else []
    counts = seen.groupBy("h1", "h2").agg(F.count_if("first").alias("n_docs"), F.count("*").alias("n_rows"), *firsts)
    frequent = stored(counts.where((F.col("n_docs") >= min_docs) & ((F.col("n_rows") > 1) | F.lit(not keep_first))), "frequent")
    heavy_rows = max(1.0, seen.count() * HEAVY_SHARE)
    heavy = F.broadcast(frequent.where(F.col("n_rows") > heavy_rows))  # at most 1 / HEAVY_SHARE rows
    light = broadcast_checked(frequent.where(F.col("n_rows") <= heavy_rows), FREQUENT_ROWS)
    hits = seen.join(heavy, ["h1", "h2"]).unionByName(seen.join(light, ["h1", "h2"]))
    if keep_first:
        hits = hits.where(~place.eqNullSafe(F.col("one")))
    return hits.select("doc_id", "text_hash", "at")


def _varint(n: Column) -> Column:
    """n < 2^31 as hex digits of base-128 bytes, the lowest first, all but the last with the high bit set."""
    byte = lambda k, more: F.lpad(F.hex(F.shiftright(n, 7 * k).bitwiseAND(127) + (128 if more else 0)), 2, "0")
    forms = [F.concat(*[byte(k, k < size - 1) for k in range(size)]) for size in range(1, 6)]
    out = F.when(n < 1 << 7, forms[0])
    for size in (2, 3, 4):
        out = out.when(n < 1 << 7 * size, forms[size - 1])
    return out.otherwise(forms[4])


def _bound(value: Column, f) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def pack(places: Column) -> Column:
    """Keep bitmap of a document from the sorted places of its dropped lines: lengths of the runs of kept and dropped lines in
    turn, the first kept (perhaps 0), each in base 128; the kept lines at the end are not written."""
    starts = lambda p: F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) < x - 1))
    ends = lambda p: F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) > x + 1))
    runs = lambda r: F.transform(r["s"], lambda s, i: F.concat(_varint(s - F.coalesce(F.get(r["e"], i - 1) + 1, F.lit(0))), _varint(F.get(r["e"], i) - s + 1)))
    return F.unhex(F.array_join(_bound(places, lambda p: _bound(F.struct(starts(p).alias("s"), ends(p).alias("e")), runs)), ""))


def unpack(bitmap: Column, n_lines: Column) -> Column:
    """The bitmap as an array of n_lines '1' (kept) and '0' (dropped); a null one keeps all."""
    runs = F.regexp_extract_all(F.hex(bitmap), F.lit("((?:[89A-F][0-9A-F])*[0-7][0-9A-F])"), F.lit(1))
    byte = lambda run, k: F.conv(F.substring(run, 2 * k + 1, 2), 16, 10).cast("int").bitwiseAND(127)
    value = lambda run: sum((F.shiftleft(F.coalesce(byte(run, k), F.lit(0)), 7 * k) for k in range(1, 5)), byte(run, 0))
    bits = F.array_join(F.transform(runs, lambda run, i: F.repeat(F.when(i % 2 == 0, "1").otherwise("0"), value(run))), "")
    return F.split(F.rpad(F.coalesce(bits, F.lit("")), n_lines, "1"), "")


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """doc_id, text_hash, n_dropped, keep: the bitmap of each document that loses lines; the others keep all."""
    places = dropped_places(docs, min_docs, min_chars, keep_first)
    lists = places.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("at")).alias("places"))
    return lists.select("doc_id", "text_hash", F.size("places").cast("long").alias("n_dropped"), pack(F.col("places")).alias("keep"))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, text, n_lines, n_dropped, keep: the documents with their bitmaps, null where all lines stay."""
    own = docs.select("doc_id", "text", text_hash(F.col("text")).alias("text_hash")).alias("d")
    b = bitmaps.alias("b")
    both = own.join(b, F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.text_hash") == F.col("b.text_hash")), "left")
    n_lines = F.size(lines_of(F.col("d.text"))).cast("long")
    return both.select("d.doc_id", "d.text", n_lines.alias("n_lines"), F.coalesce("b.n_dropped", F.lit(0)).alias("n_dropped"), "b.keep")


def kept_text(text: Column, n_lines: Column, keep: Column) -> Column:
    """The kept lines, joined by \\n; the text itself where nothing is dropped."""
    kept = _bound(unpack(keep, n_lines.cast("int")), lambda bits: F.filter(lines_of(text), lambda _, i: F.get(bits, i) == "1"))
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row of docs."""
    both = with_bitmaps(docs, keep_bitmaps(docs))
    text = kept_text(F.col("text"), F.col("n_lines"), F.col("keep"))
    return both.select("doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("kept_sha256"))

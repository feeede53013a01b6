"""Queries on alignments and audits of whole texts. Those without SQL are tested against plain Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.functions.storage import stored
from chronolex.operators import audits as au
from chronolex.operators import intervals as iv
from chronolex.plans.registry import query
from chronolex.plans.speaker_queries import _CLIPS40, _REGIONS, _clips40, _sparse
from chronolex.sources import tables as t

KEYS = ["conv_id", "turn"]


def _pairs(spark, sf):
    """Each turn's words (hyp) and those of the turn before (ref)."""
    c = t.table(spark, sf, "conversations").select(*KEYS, F.split("text", " ").alias("hyp"))
    return c.withColumn("ref", F.lag("hyp").over(Window.partitionBy("conv_id").orderBy("turn"))).where("ref IS NOT NULL")


def _path(spark, sf):
    return stored(au.paths(_pairs(spark, sf), KEYS, "ref", "hyp"))


def _of(pairs, side, place):
    return pairs.select(*KEYS, F.posexplode(side).alias(place, "word"))


@query()
def m3_align(spark: SparkSession, sf: str) -> DataFrame:
    """Word edits between each turn and the one before, of whole texts."""
    return au.counts(au.paths(_pairs(spark, sf), KEYS, "ref", "hyp"), KEYS)


@query()
def m3_align_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Word edits between each document and the one of the next id, of whole texts."""
    docs = t.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("ref"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("ref").alias("hyp"))
    return au.counts_of_texts(docs.join(after, "doc_id"), ["doc_id"], "ref", "hyp")


@query()
def m6_boundary_score(spark: SparkSession, sf: str) -> DataFrame:
    """Sentence ends of one turn found in the other, within two words."""
    pairs = _pairs(spark, sf)
    marks = lambda side, place: _of(pairs, side, place).where(F.col("word").rlike("[.!?]$")).select(*KEYS, place)
    return au.boundary_score(_path(spark, sf), KEYS, marks("ref", "i"), marks("hyp", "j"))


@query()
def m10_top_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The runs of words that are most often too many, and those most often missing: a report of 15 each."""
    pairs, path = _pairs(spark, sf), _path(spark, sf)
    runs = [au.top_runs(au.edit_runs(path, KEYS, _of(pairs, side, place), kind, place)).withColumn("kind", F.lit(kind)) for kind, side, place in (("ins", "hyp", "j"), ("del", "ref", "i"))]
    return runs[0].unionByName(runs[1])


@query()
def m18_word_error_rate(spark: SparkSession, sf: str) -> DataFrame:
    c = au.counts(au.paths(_pairs(spark, sf), KEYS, "ref", "hyp"), KEYS)
    edits, size = F.col("sub") + F.col("deleted") + F.col("inserted"), F.col("same") + F.col("sub") + F.col("deleted")
    return c.select(*KEYS, F.round(edits / F.greatest(size, F.lit(1)), 6).alias("wer"))


@query()
def m29_lost_cues(spark: SparkSession, sf: str) -> DataFrame:
    return au.lost(au.paths(_pairs(spark, sf), KEYS, "ref", "hyp"), KEYS)


@query()
def m30_extra_fillers(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _pairs(spark, sf)
    return au.spans_inside(au.paths(pairs, KEYS, "ref", "hyp"), KEYS, _of(pairs, "hyp", "j"), ["the", "and", "of", "a"])


@query(_REGIONS + _CLIPS40 + """, x AS (SELECT r.media_id, r.region, greatest(r.start, k.start) AS start, least(r."end", k."end") AS "end" FROM regions r JOIN k ON k.media_id = r.media_id AND k.start < r."end" AND r.start < k."end"),
    mm AS (SELECT *, max("end") OVER (PARTITION BY media_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
    c AS (SELECT media_id, sum(greatest(0, "end" - greatest(coalesce(reach, start), start))) AS covered FROM mm GROUP BY 1),
    v AS (SELECT media_id, sum("end" - start) AS voice FROM regions GROUP BY 1),
    i AS (SELECT k.media_id, count(*) AS cuts FROM k WHERE exists(SELECT 1 FROM regions r WHERE r.media_id = k.media_id AND k."end" > r.start + 8e-2 AND k."end" < r."end" - 8e-2) GROUP BY 1)
    SELECT media_id, round(100 * (1 - coalesce(covered, 0) / voice), 4) AS uncovered, coalesce(cuts, 0) AS cuts FROM v LEFT JOIN c USING (media_id) LEFT JOIN i USING (media_id)""")
def m20_live_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The share of speech that no segment covers, and segments that end inside an utterance."""
    regions, clips = iv.merge_regions(_sparse(spark, sf), ["media_id"]), _clips40(spark, sf)
    cut = iv.overlap_join(regions, clips).select("media_id", F.greatest("start", "b_start").alias("start"), F.least("end", "b_end").alias("end"))
    inner = regions.select("media_id", (F.col("start") + 0.08).alias("start"), (F.col("end") - 0.08).alias("end")).where("end > start")
    ends = clips.select("media_id", "piece_idx", F.col("end").alias("t"))
    cuts = iv.contains_join(inner, ends).where(F.col("t") > F.col("start")).select("media_id", "piece_idx").distinct().groupBy("media_id").agg(F.count("*").alias("cuts"))
    out = regions.groupBy("media_id").agg(F.sum(F.col("end") - F.col("start")).alias("voice")).join(iv.union_length(cut, ["media_id"]), "media_id", "left").join(cuts, "media_id", "left")
    return out.select("media_id", F.round(100 * (1 - F.coalesce("length", F.lit(0.0)) / F.col("voice")), 4).alias("uncovered"), F.coalesce("cuts", F.lit(0)).alias("cuts"))


@query("""WITH a AS (SELECT conv_id, turn, text FROM conversations), b AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, '.', '') ELSE text || ' ' END AS text FROM conversations WHERE turn <> 1)
    SELECT a.conv_id, count(*) FILTER (b.turn IS NULL) AS gone, count(*) FILTER (a.text <> b.text) AS changed, count(*) FILTER (regexp_replace(a.text, '\\s', '', 'g') = regexp_replace(b.text, '\\s', '', 'g')) AS same,
      coalesce(sum(greatest(length(regexp_replace(a.text, '[^.!?,;:…]', '', 'g')) - length(regexp_replace(b.text, '[^.!?,;:…]', '', 'g')), 0)), 0)::BIGINT AS signs_lost FROM a LEFT JOIN b USING (conv_id, turn) GROUP BY 1""")
def m22_before_after(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of a conversation: rows that are gone, changed, the same but for white space, and signs lost."""
    a = t.table(spark, sf, "conversations").select(*KEYS, "text")
    other = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.replace("text", F.lit("."), F.lit(""))).otherwise(F.concat("text", F.lit(" ")))
    b = a.where("turn <> 1").select(*KEYS, other.alias("after"))
    n = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0)))
    bare, signs = (lambda c: F.regexp_replace(c, r"\s", "")), (lambda c: F.length(F.regexp_replace(c, "[^.!?,;:…]", "")))
    rows = a.join(b, KEYS, "left").groupBy("conv_id")
    return rows.agg(n(F.col("after").isNull()).alias("gone"), n(F.col("text") != F.col("after")).alias("changed"), n(bare("text") == bare("after")).alias("same"), F.coalesce(F.sum(F.when(F.col("after").isNotNull(), F.greatest(signs("text") - signs("after"), F.lit(0)))), F.lit(0)).cast("long").alias("signs_lost"))


@query("SELECT conv_id, count(*) AS rows, count(*) FILTER (turn % 5 <> 4) AS other_rows, count(*) = count(*) FILTER (turn % 5 <> 4) AS aligned FROM conversations GROUP BY 1")
def m24_line_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Whether two columns of lines, of which one lacks every fifth, have as many."""
    c = t.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("rows"), F.sum((F.col("turn") % 5 != 4).cast("long")).alias("other_rows"))
    return c.withColumn("aligned", F.col("rows") == F.col("other_rows"))


@query(t.sql("pieces") + """, c AS (SELECT media_id, piece_idx AS idx, rtrim(text, '.') AS text, start, "end" + 8e-1 AS "end", CASE piece_idx % 3 WHEN 0 THEN 'これ' WHEN 1 THEN 'Hum, ' || text ELSE text END AS out FROM pieces),
    l AS (SELECT *, lead(start) OVER (PARTITION BY media_id ORDER BY start, idx) AS n FROM c)
    SELECT media_id, count(*) FILTER (regexp_matches(trim(text), '[^。？！、…,.?!;:」』)]$') AND n - "end" < 3e-1) AS broken, count(*) FILTER (out = 'これ') AS dense, count(*) FILTER (out LIKE 'Hum, %') AS hesitations FROM l GROUP BY 1""")
def m26_broken_drafts(spark: SparkSession, sf: str) -> DataFrame:
    idx = F.col("piece_idx")
    cues = t.pieces(spark, sf).select("media_id", idx.alias("idx"), F.rtrim("text", F.lit(".")).alias("text"), "start", (F.col("end") + 0.8).alias("end"), F.when(idx % 3 == 0, "これ").when(idx % 3 == 1, F.concat(F.lit("Hum, "), "text")).otherwise(F.col("text")).alias("o"))
    return au.broken_drafts(cues, F.col("o"))

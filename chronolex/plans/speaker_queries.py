"""Queries on speakers, voices and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.operators import intervals as iv
from chronolex.operators import speakers as sp
from chronolex.plans.registry import query
from chronolex.sources import tables as t

VOICE_THRESHOLD = 0.65

_ASSIGN = t.sql("clips") + """, s AS (
      SELECT c.media_id, c.piece_idx, t.speaker, round(sum(least(c."end", t."end") - greatest(c.start, t.start)), 9) AS total, max(t.turn_idx) AS last
      FROM clips c JOIN turns t ON c.media_id = t.media_id AND c.start < t."end" AND t.start < c."end" GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY media_id, piece_idx ORDER BY total DESC, last) AS r FROM s)"""


@query(_ASSIGN + "SELECT c.media_id, c.piece_idx, b.speaker FROM clips c LEFT JOIN best b ON b.media_id = c.media_id AND b.piece_idx = c.piece_idx AND r = 1")
def v1_assign_speakers(spark: SparkSession, sf: str) -> DataFrame:
    return sp.assign(t.clips(spark, sf), t.turns(spark, sf)).select("media_id", "piece_idx", "speaker")


@query(t.sql("turns") + """, f AS (SELECT media_id, speaker, min(turn_idx) AS first FROM turns GROUP BY ALL),
    n AS (SELECT media_id, speaker, 'Speaker ' || row_number() OVER (PARTITION BY media_id ORDER BY first, speaker) AS name FROM f)
    SELECT media_id, turn_idx AS piece_idx, name AS speaker FROM turns JOIN n USING (media_id, speaker)""")
def v2_renumber(spark: SparkSession, sf: str) -> DataFrame:
    return sp.renumber(t.turns(spark, sf).withColumnRenamed("turn_idx", "piece_idx")).select("media_id", "piece_idx", "speaker")


@query(t.sql("turns") + """, w AS (SELECT turn_idx // 2000 * 50 + turn_idx % 50 AS media_id, turn_idx, user_speaker AS speaker, start, "end" FROM (SELECT *, speaker || (turn_idx % 13) AS user_speaker FROM turns)),
    s AS (SELECT media_id, speaker, sum("end" - start) AS total FROM w GROUP BY ALL)
    SELECT w.media_id, w.turn_idx, w.speaker FROM w JOIN s USING (media_id, speaker)
    WHERE total >= 60 OR NOT exists(SELECT 1 FROM s x WHERE x.media_id = w.media_id AND x.total >= 60)""")
def v3_prune_tiny(spark: SparkSession, sf: str) -> DataFrame:
    turns = t.turns(spark, sf).select(t.submedia(50).alias("media_id"), "turn_idx", F.concat("speaker", (F.col("turn_idx") % 13).cast("string")).alias("speaker"), "start", "end")
    return sp.prune_tiny(turns, least=60.0).select("media_id", "turn_idx", "speaker")


@query(t.sql("turns") + """, r AS (SELECT *, lag(speaker) OVER w AS p, lead(speaker) OVER w AS n FROM turns WINDOW w AS (PARTITION BY media_id ORDER BY start, turn_idx))
    SELECT DISTINCT media_id, round(greatest(x - 5e-1, 0) + 1e-8, 6) AS t FROM (SELECT media_id, start AS x FROM r WHERE p <> speaker UNION ALL SELECT media_id, "end" FROM r WHERE n <> speaker)""")
def v4_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return sp.boundaries(t.turns(spark, sf)).select("media_id", F.round(F.col("t") + 1e-8, 6).alias("t")).distinct()


_PAIRS = t.sql("voices") + f""", p AS (
    SELECT a.label AS a, b.label AS b, 1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS distance
    FROM voices a JOIN voices b ON a.media_id = b.media_id AND a.label < b.label), near AS (SELECT * FROM p WHERE distance < {VOICE_THRESHOLD})"""


@query(_PAIRS + """, parent AS (SELECT label, coalesce((SELECT min(a) FROM near WHERE b = label), label) AS up FROM voices),
    walk AS (SELECT label, up FROM parent UNION SELECT w.label, p.up FROM walk w JOIN parent p ON p.label = w.up)
    SELECT label, min(up) AS group_label FROM walk GROUP BY label""")
def v5_group_voices(spark: SparkSession, sf: str) -> DataFrame:
    return sp.group_same_voice(t.voices(spark, sf), VOICE_THRESHOLD)


@query(_PAIRS + "SELECT a, b, round(distance, 5) AS distance FROM near")
def v6_cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return sp.similar_pairs(t.voices(spark, sf), VOICE_THRESHOLD).select("a", "b", F.round("distance", 5).alias("distance"))


_SPARSE = t.sql("turns") + """, u AS (SELECT turn_idx // 2000 * 40 + turn_idx % 40 AS media_id, turn_idx, speaker, start, start + ("end" - start) / 40 AS "end" FROM turns)"""


def _sparse(spark, sf):
    """Turns of more media and less length, so that there is silence between them."""
    return t.turns(spark, sf).select(t.submedia(40).alias("media_id"), "turn_idx", "speaker", "start", (F.col("start") + (F.col("end") - F.col("start")) / 40).alias("end"))


_REGIONS = _SPARSE + """, m AS (SELECT *, max("end") OVER (PARTITION BY media_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM u),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start - reach > 5e-1 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS region FROM m),
    regions AS (SELECT media_id, region, min(start) AS start, max("end") AS "end" FROM g GROUP BY ALL)"""


@query(_REGIONS + """SELECT media_id, round(start + 1e-8, 6) AS start, round("end" + 1e-8, 6) AS "end" FROM regions""")
def v9_merge_regions(spark: SparkSession, sf: str) -> DataFrame:
    return iv.merge_regions(_sparse(spark, sf), ["media_id"]).select("media_id", F.round(F.col("start") + 1e-8, 6).alias("start"), F.round(F.col("end") + 1e-8, 6).alias("end"))


_CLIPS40 = """, k AS (SELECT turn_idx // 2000 * 40 + turn_idx % 40 AS media_id, start + 2 AS start, start + 3 AS "end" FROM turns)"""


def _clips40(spark, sf):
    return t.turns(spark, sf).select(t.submedia(40).alias("media_id"), F.col("turn_idx").alias("piece_idx"), (F.col("start") + 2).alias("start"), (F.col("start") + 3).alias("end"))


@query(_REGIONS + _CLIPS40 + """SELECT media_id, count(*) AS regions, count(*) FILTER (exists(SELECT 1 FROM k WHERE k.media_id = r.media_id AND k.start < r."end" AND r.start < k."end")) AS reached FROM regions r GROUP BY media_id""")
def v10_reached(spark: SparkSession, sf: str) -> DataFrame:
    regions = iv.merge_regions(_sparse(spark, sf), ["media_id"])
    hit = iv.overlap_join(regions, _clips40(spark, sf), how="left_semi").groupBy("media_id").agg(F.count("*").alias("reached"))
    return regions.groupBy("media_id").agg(F.count("*").alias("regions")).join(hit, "media_id", "left").select("media_id", "regions", F.coalesce("reached", F.lit(0)).alias("reached"))


@query(_REGIONS + _CLIPS40 + """SELECT media_id, round(greatest(start - 25e-2 - greatest(0, 1 - ("end" - start + 5e-1)) / 2, 0) + 1e-8, 6) AS start, round(1e-8 + "end" + 25e-2 + greatest(0, 1 - ("end" - start + 5e-1)) / 2, 6) AS "end" FROM regions r
    WHERE NOT exists(SELECT 1 FROM k WHERE k.media_id = r.media_id AND k.start < r."end" AND r.start < k."end")""")
def m35_missed_regions(spark: SparkSession, sf: str) -> DataFrame:
    missed = iv.overlap_join(iv.merge_regions(_sparse(spark, sf), ["media_id"]), _clips40(spark, sf), how="left_anti")
    more = F.greatest(F.lit(0.0), 1 - (F.col("end") - F.col("start") + 0.5)) / 2
    return missed.select("media_id", F.round(F.greatest(F.col("start") - 0.25 - more, F.lit(0.0)) + 1e-8, 6).alias("start"), F.round(F.col("end") + 0.25 + more + 1e-8, 6).alias("end"))


@query(t.sql("turns") + """, m AS (SELECT *, max("end") OVER (PARTITION BY media_id, speaker ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM turns)
    SELECT media_id, speaker, round(sum(greatest(0, "end" - greatest(coalesce(reach, start), start))), 4) AS length FROM m GROUP BY ALL""")
def m1_union_length(spark: SparkSession, sf: str) -> DataFrame:
    return iv.union_length(t.turns(spark, sf), ["media_id", "speaker"]).withColumn("length", F.round("length", 4))


@query(t.sql("turns") + """, r AS (SELECT *, sum("end" - start) OVER (PARTITION BY media_id, speaker ORDER BY "end" - start DESC, turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM turns)
    SELECT media_id, speaker, turn_idx FROM r WHERE coalesce(before, 0) < 120""")
def v7_voice_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The longest turns of a speaker until they make up 120 seconds."""
    from pyspark.sql import Window

    length = F.col("end") - F.col("start")
    before = F.sum(length).over(Window.partitionBy("media_id", "speaker").orderBy(length.desc(), "turn_idx").rowsBetween(Window.unboundedPreceding, -1))
    return t.turns(spark, sf).withColumn("before", before).where(F.coalesce("before", F.lit(0.0)) < 120).select("media_id", "speaker", "turn_idx")


@query(t.sql("voices") + f""", tt AS (SELECT event_id AS turn_idx, (event_id // 2000) % (SELECT max(media_id) + 1 FROM voices) AS media_id, event_id % 200 AS k, (epoch_us(ts) - 1704067200000000) / 6e7 AS start, (epoch_us(ts) - 1704067200000000) / 6e7 + value AS "end" FROM events),
    x AS (SELECT turn_idx, media_id, media_id * 200 + k AS label, start, "end" FROM tt),
    r AS (SELECT *, sum("end" - start) OVER (PARTITION BY media_id, label ORDER BY "end" - start DESC, turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
    heard AS (SELECT media_id, label FROM r WHERE coalesce(before, 0) < 12 GROUP BY ALL HAVING sum("end" - start) >= 2),
    v AS (SELECT v.media_id, v.label, v.embedding, f.first FROM voices v JOIN heard USING (media_id, label) JOIN (SELECT media_id, label, min(start) AS first FROM x GROUP BY ALL) f USING (media_id, label)),
    p AS (SELECT a.label AS a, a.first AS fa, b.label AS b, 1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS distance FROM v a JOIN v b ON a.media_id = b.media_id AND (a.first, a.label) < (b.first, b.label)),
    parent AS (SELECT b AS label, arg_min(a, (fa, a)) AS up FROM p WHERE distance < {VOICE_THRESHOLD} GROUP BY b),
    walk AS (SELECT label, up, 1 AS n FROM parent UNION ALL SELECT w.label, q.up, n + 1 FROM walk w JOIN parent q ON q.label = w.up),
    root AS (SELECT label, arg_max(up, n) AS up FROM walk GROUP BY 1)
    SELECT turn_idx, coalesce(up, label) AS label FROM x LEFT JOIN root USING (label)""")
def v7_relabel(spark: SparkSession, sf: str) -> DataFrame:
    """Turns whose labels belong to one voice get the label of the one that was heard first."""
    voices = t.voices(spark, sf)
    media = voices.agg(F.max("media_id") + 1).first()[0]
    e = F.col("event_id")
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(6e7)
    rows = t.table(spark, sf, "events").select(e.alias("turn_idx"), (F.floor(e / 2000) % media).alias("media_id"), (e % 200).alias("k"), start.alias("start"), "value")
    turns = rows.select("turn_idx", "media_id", (F.col("media_id") * 200 + F.col("k")).alias("label"), "start", (F.col("start") + F.col("value")).alias("end"))
    return sp.merge_same_voice(turns, voices, VOICE_THRESHOLD).select("turn_idx", "label")

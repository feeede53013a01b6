"""Queries on signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.functions.storage import folder
from chronolex.operators import resample as rs
from chronolex.operators import signals as sg
from chronolex.plans.registry import query
from chronolex.sources import media_files
from chronolex.sources import tables as t

_FRAMES = t.sql("samples") + """, f AS (SELECT media_id, sample_idx // 16 AS frame_idx, sqrt(avg(v * v)) AS rms FROM samples GROUP BY ALL HAVING count(*) = 16),
    k AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY rms) AS r, count(*) OVER (PARTITION BY media_id) AS n FROM f),
    z AS (SELECT media_id, rms AS noise FROM k WHERE r = n // 5 + 1),
    voiced AS (SELECT f.*, rms > greatest(5e-3, 15e-1 * noise) AS voiced FROM f JOIN z USING (media_id))"""
_REGIONS = _FRAMES + """, s AS (SELECT *, frame_idx - lag(frame_idx) OVER w AS step FROM voiced WHERE voiced WINDOW w AS (PARTITION BY media_id ORDER BY frame_idx)),
    i AS (SELECT *, sum(CASE WHEN step > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY frame_idx) AS region FROM s),
    regions AS (SELECT media_id, region, min(frame_idx) * 3e-2 AS start, (max(frame_idx) + 1) * 3e-2 AS "end" FROM i GROUP BY ALL),
    gaps AS (SELECT * FROM (SELECT media_id, "end" AS start, lead(start) OVER (PARTITION BY media_id ORDER BY start) AS "end" FROM regions) WHERE "end" - start >= 2e-1)"""


def _voiced(spark, sf):
    return sg.voiced(sg.frames(t.samples(spark, sf), 16), multiplier=1.5)


def _regions(spark, sf):
    return sg.regions(_voiced(spark, sf), pause=0.12)


@query(_FRAMES + "SELECT media_id, frame_idx, round(rms, 6) AS rms, voiced FROM voiced")
def sg1_voiced(spark: SparkSession, sf: str) -> DataFrame:
    return _voiced(spark, sf).select("media_id", "frame_idx", F.round("rms", 6).alias("rms"), "voiced")


@query(_REGIONS + """SELECT media_id, round(start, 6) AS start, round("end", 6) AS "end" FROM regions""")
def sg2_regions(spark: SparkSession, sf: str) -> DataFrame:
    return _regions(spark, sf).select("media_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(_REGIONS + """SELECT media_id, round(start, 6) AS start, round("end", 6) AS "end" FROM gaps""")
def sg3_silences(spark: SparkSession, sf: str) -> DataFrame:
    return sg.silences(_regions(spark, sf), 0.2).select("media_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(_REGIONS + """SELECT media_id, round((start + "end") / 2, 6) AS t FROM gaps""")
def sg4_pauses(spark: SparkSession, sf: str) -> DataFrame:
    return sg.pause_boundaries(_regions(spark, sf), 0.2).select("media_id", F.round("t", 6).alias("t"))


@query(t.sql("samples") + """, q AS (SELECT media_id, v / 1e5 AS v FROM samples), a AS (SELECT media_id, sqrt(avg(v * v)) AS rms, max(abs(v)) AS peak FROM q GROUP BY 1)
    SELECT media_id, round(CASE WHEN rms > 1e-5 AND rms < 3e-3 AND least(20, 3e-2 / rms, 95e-2 / peak) > 1 THEN least(20, 3e-2 / rms, 95e-2 / peak) ELSE 1 END, 6) AS gain FROM a""")
def sg6_boost(spark: SparkSession, sf: str) -> DataFrame:
    return sg.boost(t.samples(spark, sf).withColumn("v", F.col("v") / 1e5)).select("media_id", F.round("gain", 6).alias("gain"))


@query(t.sql("samples") + """, x AS (SELECT media_id, sample_idx // 16 AS f, sample_idx // 400 AS w, v * v AS e FROM samples),
    s AS (SELECT media_id, w, f, sum(e) AS e, count(*) AS n FROM x GROUP BY ALL),
    k AS (SELECT media_id, sqrt(e / n) AS rms, row_number() OVER (PARTITION BY media_id ORDER BY sqrt(e / n)) AS r, count(*) OVER (PARTITION BY media_id) AS c FROM s),
    z AS (SELECT media_id, rms AS noise FROM k WHERE r = floor(c * 1e-1) + 1),
    win AS (SELECT media_id, w AS window_idx, sqrt(sum(e) / sum(n)) AS rms FROM s GROUP BY ALL),
    l AS (SELECT win.*, rms > greatest(5e-4, 11e-1 * noise) AS live FROM win JOIN z USING (media_id)),
    a AS (SELECT media_id, rms, row_number() OVER (PARTITION BY media_id ORDER BY rms) AS r, count(*) OVER (PARTITION BY media_id) AS c FROM l WHERE live),
    g AS (SELECT media_id, rms AS target FROM a WHERE r = floor(c * 75e-2) + 1 AND c > 3),
    h AS (SELECT l.*, CASE WHEN live AND target IS NOT NULL THEN least(20, greatest(1, target / rms)) ELSE 1 END AS gain FROM l LEFT JOIN g USING (media_id))
    SELECT media_id, window_idx, live, round(CASE WHEN max(gain) OVER (PARTITION BY media_id) > 105e-2 AND count(*) OVER (PARTITION BY media_id) > 4 THEN gain ELSE 1 END, 6) AS gain FROM h""")
def sg7_level(spark: SparkSession, sf: str) -> DataFrame:
    return sg.level(t.samples(spark, sf), window=400, frame=16, multiplier=1.1).select("media_id", "window_idx", "live", F.round("gain", 6).alias("gain"))


@query(t.sql("samples") + "SELECT media_id, bool_and(v = 0) AS silent FROM samples GROUP BY 1")
def sg9_silent(spark: SparkSession, sf: str) -> DataFrame:
    return sg.is_silent(t.samples(spark, sf))


def _resampled_sql(up: int, down: int) -> str:
    """Each output sample as a sum over the input samples around it, weighed by the formula of the filter."""
    cutoff = min(1.0, up / down) * rs.PASSED
    half = rs.CROSSINGS / cutoff
    reach = int(-(-half // 1))
    return t.sql("samples") + f""", k AS (SELECT p, j, j - p / {up}e0 AS x FROM range({up}) a(p), range({-reach}, {reach + 1}) b(j)),
    h AS (SELECT p, j, CASE WHEN abs(x) >= {half!r} THEN 0 ELSE (CASE WHEN x = 0 THEN 1 ELSE sin(pi() * {cutoff!r} * x) / (pi() * {cutoff!r} * x) END) * (42e-2 + 5e-1 * cos(pi() * x / {half!r}) + 8e-2 * cos(2 * pi() * x / {half!r})) END AS w FROM k),
    f AS (SELECT p, j, w / sum(w) OVER (PARTITION BY p) AS w FROM h),
    o AS (SELECT media_id, unnest(range((max(sample_idx) + 1) * {up} // {down} + CASE WHEN (max(sample_idx) + 1) * {up} % {down} > 0 THEN 1 ELSE 0 END)) AS n FROM samples GROUP BY 1)
    SELECT o.media_id, n AS sample_idx, round(coalesce(sum(s.v * w), 0), 6) AS v
    FROM o JOIN f ON f.p = n * {down} % {up} LEFT JOIN samples s ON s.media_id = o.media_id AND s.sample_idx = n * {down} // {up} + j GROUP BY ALL"""


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("media_id", "sample_idx", F.round("v", 6).alias("v"))


@query(_resampled_sql(1, 3))
def io18_resample(spark: SparkSession, sf: str) -> DataFrame:
    """The signals from 48 to 16 kHz, in chunks that end within a medium."""
    return _rounded(rs.resampled(t.samples(spark, sf), 48_000, 16_000, chunk=1000))


@query(_resampled_sql(160, 441))
def io18_resample_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """From 44.1 to 16 kHz: 160 phases."""
    return _rounded(rs.resampled(t.samples(spark, sf), 44_100, 16_000, chunk=1000))


@query(t.sql("samples") + "SELECT media_id, sample_idx, v FROM samples")
def io13_wav(spark: SparkSession, sf: str) -> DataFrame:
    """The signals as WAV files of doubles, read back."""
    media_files.register(spark)
    path = folder(spark)
    media_files.write_wav(t.samples(spark, sf), path, encoding="float64")
    return spark.read.format("wav").option("partitionSamples", "1000").load(path).select("media_id", "sample_idx", "v")


@query(t.sql("samples") + "SELECT media_id, sample_idx, round_even(least(1, greatest(-1, v / 100)) * 32767, 0)::BIGINT AS code FROM samples")
def io13_pcm(spark: SparkSession, sf: str) -> DataFrame:
    """The same in sixteen bits, as the recogniser takes them; values over 100 are cut."""
    media_files.register(spark)
    path = folder(spark)
    media_files.write_wav(t.samples(spark, sf).withColumn("v", F.col("v") / 100), path)
    return spark.read.format("wav").load(path).select("media_id", "sample_idx", F.rint(F.col("v") * 32767).cast("long").alias("code"))

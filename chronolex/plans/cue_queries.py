"""Queries on cues, SubRip and live history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.functions.storage import folder
from chronolex.functions.text import timecode
from chronolex.operators import cues as cu
from chronolex.plans.registry import query
from chronolex.sources import media_files, srt
from chronolex.sources import tables as t

_CUES = t.sql("pieces") + """, c AS (SELECT media_id, piece_idx AS idx, speaker, text, start, start + ("end" - start) / 6 AS "end" FROM pieces)"""


def _cues(spark, sf):
    """Pieces as cues, shortened so that there are gaps."""
    return t.pieces(spark, sf).select("media_id", F.col("piece_idx").alias("idx"), "speaker", "text", "start", (F.col("start") + (F.col("end") - F.col("start")) / 6).alias("end"))


_ROUND = """SELECT media_id, idx, round(start + 1e-8, 6) AS start, round("end" + 1e-8, 6) AS "end" FROM """


def _rounded(df):
    return df.select("media_id", "idx", F.round(F.col("start") + 1e-8, 6).alias("start"), F.round(F.col("end") + 1e-8, 6).alias("end"))


@query(_CUES + ", d AS (SELECT media_id, idx, start, least(\"end\", 60, start + 7) AS \"end\" FROM c WHERE start < 60 - 2e-1) " + _ROUND + """d WHERE "end" > start""")
def c2_clamp(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(cu.clamp(_cues(spark, sf), F.lit(60.0)))


@query(_CUES + """, l AS (SELECT *, start * 4e-1 AS s, start * 4e-1 + ("end" - start) AS e FROM c), n AS (SELECT *, lead(s) OVER (PARTITION BY media_id ORDER BY s, idx) AS f FROM l)
    SELECT media_id, idx, round(s + 1e-8, 6) AS start, round(1e-8 + CASE WHEN f - e > 8e-2 AND f - e < 1 THEN greatest(e, least(f - 8e-2, s + 7)) ELSE e END, 6) AS "end" FROM n""")
def c5_bridge_gaps(spark: SparkSession, sf: str) -> DataFrame:
    c = _cues(spark, sf).withColumn("end", F.col("start") * 0.4 + (F.col("end") - F.col("start"))).withColumn("start", F.col("start") * 0.4)
    return _rounded(cu.bridge_gaps(c))


@query(_CUES + """, e AS (SELECT media_id, idx, start, CASE WHEN idx % 4 = 3 THEN '' ELSE lower(text) END AS text FROM c),
    l AS (SELECT *, last_value(nullif(text, '') IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY start, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e)
    SELECT media_id, idx, CASE WHEN text <> '' AND (last IS NULL OR regexp_matches(last, '[.!?…"''）」]$')) THEN upper(left(text, 1)) || substr(text, 2) ELSE text END AS text FROM l""")
def c8_capitalize(spark: SparkSession, sf: str) -> DataFrame:
    c = _cues(spark, sf).withColumn("text", F.when(F.col("idx") % 4 == 3, "").otherwise(F.lower("text")))
    return cu.capitalize(c).select("media_id", "idx", "text")


@query(_CUES + """, e AS (SELECT media_id, idx, start, text, CASE WHEN idx % 3 = 2 THEN NULL ELSE speaker END AS speaker FROM c),
    l AS (SELECT *, last_value(speaker IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY start, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e)
    SELECT media_id, idx, CASE WHEN speaker IS NOT NULL AND last IS DISTINCT FROM speaker THEN '— ' || text ELSE text END AS text FROM l""")
def c12_speaker_mark(spark: SparkSession, sf: str) -> DataFrame:
    c = _cues(spark, sf).withColumn("speaker", F.when(F.col("idx") % 3 == 2, F.lit(None)).otherwise(F.col("speaker")))
    return cu.speaker_marks(c).select("media_id", "idx", "text")


@query("SELECT conv_id AS media_id, turn AS idx, coalesce(nullif(CASE WHEN turn % 2 = 0 THEN '' ELSE text END, ''), role) AS shown, CASE WHEN role IN ('ja', 'zh') THEN 20 ELSE 42 END AS width FROM conversations")
def c13_display_text(spark: SparkSession, sf: str) -> DataFrame:
    from chronolex.functions.text import line_width

    c = t.table(spark, sf, "conversations")
    shown = F.coalesce(F.nullif(F.when(F.col("turn") % 2 == 0, F.lit("")).otherwise(F.col("text")), F.lit("")), "role")
    return c.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("idx"), shown.alias("shown"), line_width(F.col("role")).alias("width"))


_TRACKS = t.sql("turns") + """, c AS (SELECT turn_idx // 2000 * 60 + turn_idx % 60 AS media_id, turn_idx AS idx, speaker AS text, start, start + ("end" - start) / 10 AS "end" FROM turns)"""


def _tracks(spark, sf):
    return t.turns(spark, sf).select(t.submedia(60).alias("media_id"), F.col("turn_idx").alias("idx"), F.col("speaker").alias("text"), "start", (F.col("start") + (F.col("end") - F.col("start")) / 10).alias("end"))


@query(_TRACKS + """, p AS (SELECT media_id, start AS p FROM c UNION SELECT media_id, "end" FROM c), e AS (SELECT media_id, p AS s, lead(p) OVER (PARTITION BY media_id ORDER BY p) AS e FROM p),
    x AS (SELECT e.media_id, e.s, e.e, string_agg(c.text, chr(10) ORDER BY c.start, c.idx) AS text FROM e JOIN c ON c.media_id = e.media_id AND c.start < e.e AND e.s < c."end" GROUP BY ALL),
    l AS (SELECT *, CASE WHEN lag(e) OVER w = s AND lag(text) OVER w = text THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY media_id ORDER BY s)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY media_id ORDER BY s) AS run FROM l)
    SELECT media_id, round(min(s) + 1e-8, 6) AS start, round(max(e) + 1e-8, 6) AS "end", text FROM r GROUP BY media_id, run, text""")
def c14_combine_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return cu.combine_tracks(_tracks(spark, sf)).select("media_id", F.round(F.col("start") + 1e-8, 6).alias("start"), F.round(F.col("end") + 1e-8, 6).alias("end"), "text")


_POINTS = """, q AS (SELECT turn_idx // 2000 * 60 + turn_idx % 60 AS media_id, turn_idx AS point_idx, start + 4e-1 AS t FROM turns)"""


def _points(spark, sf):
    return t.turns(spark, sf).select(t.submedia(60).alias("media_id"), F.col("turn_idx").alias("point_idx"), (F.col("start") + 0.4).alias("t"))


@query(_TRACKS + _POINTS + """SELECT q.media_id, q.point_idx, arg_min(c.idx, (c.start, c.idx)) AS idx FROM q LEFT JOIN c ON c.media_id = q.media_id AND c.start <= q.t AND q.t < c."end" GROUP BY ALL""")
def c15_cue_at(spark: SparkSession, sf: str) -> DataFrame:
    return cu.cue_at(_tracks(spark, sf), _points(spark, sf))


@query(_TRACKS + _POINTS + """, n AS (SELECT q.media_id, q.point_idx, arg_min(c.idx, (c.start, c.idx)) AS idx FROM q LEFT JOIN c ON c.media_id = q.media_id AND c.start > q.t + 5e-2 GROUP BY ALL),
    z AS (SELECT media_id, arg_max(idx, (start, idx)) AS last FROM c GROUP BY 1) SELECT n.media_id, point_idx, coalesce(idx, last) AS idx FROM n JOIN z USING (media_id)""")
def c16_next_cue(spark: SparkSession, sf: str) -> DataFrame:
    return cu.next_cue(_tracks(spark, sf), _points(spark, sf))


@query(_TRACKS + _POINTS + """, n AS (SELECT q.media_id, q.point_idx, any_value(q.t) AS t, arg_max(c.idx, (c.start, c.idx)) AS idx FROM q LEFT JOIN c ON c.media_id = q.media_id AND c.start < q.t - 5e-2 GROUP BY ALL),
    a AS (SELECT q.media_id, q.point_idx, arg_min(c.idx, (c.start, c.idx)) AS shown, min(c.start) AS start FROM q JOIN c ON c.media_id = q.media_id AND c.start <= q.t AND q.t < c."end" GROUP BY ALL),
    z AS (SELECT media_id, arg_min(idx, (start, idx)) AS first FROM c GROUP BY 1)
    SELECT n.media_id, n.point_idx, CASE WHEN n.t - a.start > 1 THEN shown ELSE coalesce(n.idx, first) END AS idx FROM n JOIN z USING (media_id) LEFT JOIN a ON a.media_id = n.media_id AND a.point_idx = n.point_idx""")
def c16_previous_cue(spark: SparkSession, sf: str) -> DataFrame:
    """The cue before a time, or the beginning of the one that is shown."""
    return cu.previous_cue(_tracks(spark, sf), _points(spark, sf))


@query(_CUES + """, l AS (SELECT *, lead(text) OVER w AS nt, lead(start) OVER w AS ns FROM (SELECT media_id, idx, start, "end", rtrim(text, '.') AS text FROM c) WINDOW w AS (PARTITION BY media_id ORDER BY start, idx))
    SELECT media_id, idx, CASE WHEN regexp_matches(rtrim(text), '[\\p{L}\\p{N}]$') AND regexp_matches(ltrim(nt), '^\\p{Lu}') AND ns - "end" >= 8e-1 THEN rtrim(text) || '.' ELSE text END AS text FROM l""")
def p6_close_at_pauses(spark: SparkSession, sf: str) -> DataFrame:
    c = _cues(spark, sf).withColumn("text", F.rtrim("text", F.lit(".")))
    return cu.close_at_pauses(c).select("media_id", "idx", "text")


@query(t.sql("pieces") + """, c AS (SELECT media_id, piece_idx AS idx, trim(text) AS text, start * 12e-1 AS s, start * 12e-1 + ("end" - start) AS e FROM pieces WHERE trim(text) <> ''),
    l AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY media_id ORDER BY s, idx) >= 10 THEN 1 ELSE 0 END AS new FROM c), p AS (SELECT *, sum(new) OVER (PARTITION BY media_id ORDER BY s, idx) AS para FROM l),
    g AS (SELECT media_id, para, string_agg(text, ' ' ORDER BY s, idx) AS text FROM p GROUP BY ALL) SELECT media_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY para)) AS text, count(*) AS paragraphs FROM g GROUP BY 1""")
def io6_prose(spark: SparkSession, sf: str) -> DataFrame:
    p = t.pieces(spark, sf).select("media_id", F.col("piece_idx").alias("idx"), "text", (F.col("start") * 1.2).alias("start"), (F.col("start") * 1.2 + (F.col("end") - F.col("start"))).alias("end"))
    out = cu.prose(p)
    return out.select("media_id", F.md5("text").alias("text"), F.size(F.split("text", "\n\n")).cast("long").alias("paragraphs"))


@query(t.sql("turns") + """, m AS (SELECT media_id, turn_idx, round(greatest(start, 0) * 1000)::BIGINT AS ms FROM turns)
    SELECT media_id, turn_idx, format('{:02d}:{:02d}:{:02d},{:03d}', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS code FROM m""")
def io5_timecode(spark: SparkSession, sf: str) -> DataFrame:
    return t.turns(spark, sf).select("media_id", "turn_idx", timecode(F.col("start")).alias("code"))


_SRT = t.sql("pieces") + """, c AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start, piece_idx) AS idx, regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g') AS text, round(start * 1000) / 1000 AS s, round("end" * 1000) / 1000 AS e FROM pieces WHERE regexp_matches(regexp_replace(text, '\\s+', ' ', 'g'), '[\\p{L}\\p{N}]'))
    SELECT media_id, idx, round(s, 3) AS start, round(CASE WHEN e <= s THEN s + 2e-1 ELSE e END, 3) AS "end", md5(trim(text)) AS text FROM c"""


@query(_SRT)
def io1_srt_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces rendered as SubRip and parsed back."""
    p = t.pieces(spark, sf).select("media_id", F.col("piece_idx").alias("idx"), F.regexp_replace("text", r"\s+", " ").alias("text"), "start", "end")
    return srt.parse(srt.render(p)).select("media_id", F.col("idx").cast("long").alias("idx"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.md5("text").alias("text"))


@query(_SRT)
def io1_srt_source(spark: SparkSession, sf: str) -> DataFrame:
    """The same as files of a data source."""
    media_files.register(spark)
    path = folder(spark)
    media_files.write_srt(t.pieces(spark, sf).select("media_id", F.col("piece_idx").alias("idx"), F.regexp_replace("text", r"\s+", " ").alias("text"), "start", "end"), path)
    rows = spark.read.format("srt").load(path)
    return rows.select(F.col("media_id").cast("long").alias("media_id"), F.col("idx").cast("long").alias("idx"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.md5("text").alias("text"))


@query("SELECT doc_id, CASE WHEN trim(text) = '' OR doc_id % 5 = 0 THEN '' ELSE reverse(text) END AS translated FROM documents")
def u6_skip_empty(spark: SparkSession, sf: str) -> DataFrame:
    """Only texts with content are translated; all keep their places."""
    docs = t.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text")).alias("text"))
    done = docs.where(F.trim("text") != "").select("doc_id", F.reverse("text").alias("made"))
    return docs.select("doc_id").join(done, "doc_id", "left").select("doc_id", F.coalesce("made", F.lit("")).alias("translated"))


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS batch, turn FROM conversations")
def u7_batches(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return t.table(spark, sf, "conversations").select("conv_id", F.floor(n / 2).alias("batch"), "turn")


@query(t.sql("pieces") + "SELECT media_id, piece_idx, lag(text) OVER (PARTITION BY media_id ORDER BY piece_idx) AS context FROM pieces")
def u10_context(spark: SparkSession, sf: str) -> DataFrame:
    return t.pieces(spark, sf).select("media_id", "piece_idx", F.lag("text").over(Window.partitionBy("media_id").orderBy("piece_idx")).alias("context"))


@query("""WITH a AS (SELECT user_id AS media_id, event_id AS attempt, round(value, 2) AS coverage FROM events), f AS (SELECT *, coalesce(max(coverage) OVER (PARTITION BY media_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS best, row_number() OVER (PARTITION BY media_id ORDER BY attempt) AS n FROM a)
    SELECT media_id, arg_min(attempt, (-coverage, attempt)) AS attempt FROM f WHERE n <= 3 AND best < 75 GROUP BY 1""")
def p9_best_attempt(spark: SparkSession, sf: str) -> DataFrame:
    """The best of up to three attempts; none is made after one that covers enough."""
    a = t.table(spark, sf, "events").select(F.col("user_id").alias("media_id"), F.col("event_id").alias("attempt"), F.round("value", 2).alias("coverage"))
    order = Window.partitionBy("media_id").orderBy("attempt")
    a = a.withColumn("best", F.coalesce(F.max("coverage").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("n", F.row_number().over(order))
    best = a.where("n <= 3 AND best < 75").groupBy("media_id").agg(F.min(F.struct((-F.col("coverage")).alias("c"), "attempt")).alias("b"))
    return best.select("media_id", F.col("b.attempt").alias("attempt"))

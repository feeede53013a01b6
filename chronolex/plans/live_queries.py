"""Queries on live machines, over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.functions import text as tx
from chronolex.operators import folds as fo
from chronolex.plans.registry import query
from chronolex.sources import tables as t
from chronolex.streaming import live


@query()
def s1_vad(spark: SparkSession, sf: str) -> DataFrame:
    """Voice activity over frames, 2000 a medium, that are loud for 200 and quiet for 200."""
    e = F.col("event_id")
    loud = F.floor(e / 200) % 2 == 0
    frames = t.table(spark, sf, "events").select(F.floor(e / 2000).alias("media_id"), e.alias("seq"), F.when(loud, F.col("value") / 100).otherwise(F.col("value") * 1e-6).alias("rms"))
    return live.over_table(frames, "segments", "rms")


# The words of a turn in hypotheses of five more each; in every odd one the last word is not yet right.
@query("""WITH w AS (SELECT conv_id * 10000 + turn AS media_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM conversations),
    k AS (SELECT media_id, w, len(w) AS n, unnest(range(1, greatest((len(w) + 4) // 5, 1) + 1)) AS k FROM w WHERE len(w) > 0),
    c AS (SELECT *, CASE WHEN k < 2 THEN 0 ELSE 5 * (k - 1) - (k - 1) % 2 END AS now, CASE WHEN k < 3 THEN 0 ELSE 5 * (k - 2) - (k - 2) % 2 END AS before, (n + 4) // 5 AS last FROM k),
    f AS (SELECT media_id, last AS seq, w[now + 1 : n - 1] || [w[n] || CASE WHEN last % 2 = 1 THEN 'x' ELSE '' END] AS words FROM c WHERE k = last)
    SELECT media_id, k AS seq, array_to_string(w[before + 1 : now], ' ') AS text FROM c WHERE now > before
    UNION ALL SELECT media_id, seq, array_to_string(words, ' ') FROM f""")
def s2_stable_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """What two hypotheses in a row agree on, and the rest at the end (S3)."""
    c = t.table(spark, sf, "conversations").select((F.col("conv_id") * 10000 + F.col("turn")).alias("media_id"), F.filter(F.split("text", " "), lambda x: x != "").alias("w")).where("size(w) > 0")
    rows = c.select("media_id", F.explode(F.sequence(F.lit(1), F.ceil(F.size("w") / 5).cast("int"))).alias("seq"), "w")
    text = F.concat(F.array_join(F.slice("w", F.lit(1), F.col("seq") * 5), " "), F.when(F.col("seq") % 2 == 1, "x").otherwise(""))
    return live.over_table(rows.select("media_id", F.col("seq").cast("long").alias("seq"), text.alias("text")), "stable_prefix", "text")


@query("""WITH RECURSIVE w AS (SELECT conv_id AS media_id, turn AS seq, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS word, generate_subscripts(list_filter(string_split(text, ' '), lambda x: x <> ''), 1) AS i FROM conversations),
    n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seq, i) AS n FROM w),
    h AS (SELECT media_id, n, seq, word AS held, regexp_matches(word, '[.!?…。！？]$') OR (regexp_matches(word, '[,;:—、，；：]$') AND length(word) >= 32) OR length(word) >= 75 AS done FROM n WHERE n = 1
      UNION ALL SELECT media_id, n, seq, held, regexp_matches(held, '[.!?…。！？]$') OR (regexp_matches(held, '[,;:—、，；：]$') AND length(held) >= 32) OR length(held) >= 75
      FROM (SELECT n.media_id, n.n, n.seq, CASE WHEN h.done THEN n.word ELSE h.held || ' ' || n.word END AS held FROM h JOIN n ON n.media_id = h.media_id AND n.n = h.n + 1)),
    z AS (SELECT media_id, max(n) AS n FROM h GROUP BY 1)
    SELECT media_id, seq, held AS text FROM h WHERE done UNION ALL SELECT h.media_id, seq, held FROM h JOIN z USING (media_id, n) WHERE NOT done""")
def s4_phrases(spark: SparkSession, sf: str) -> DataFrame:
    c = t.table(spark, sf, "conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("seq"), "text")
    return live.over_table(c, "phrases", "text")


def _latest(n):
    return f"""WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_id // 500, event_type ORDER BY event_id DESC) AS r, hash(event_type) AS h, event_id // 500 AS block FROM events)
    SELECT event_id, r > {n} AS dropped FROM r"""


def _kept(spark, sf, most):
    kinds = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    e = t.table(spark, sf, "events")
    rows = e.select((F.floor(F.col("event_id") / 500) * 10 + F.array_position(kinds, F.col("event_type"))).cast("long").alias("media_id"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("item"))
    return live.over_table(rows, "backlog", "item", most=most).select(F.col("item").cast("long").alias("event_id"), "dropped")


@query(_latest(12))
def s5_backlog(spark: SparkSession, sf: str) -> DataFrame:
    """A queue of 12 that drops its oldest item: what was dropped and what it holds at the end."""
    return _kept(spark, sf, 12)


@query(_latest(60))
def s6_history(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(spark, sf, 60)


@query(_latest(40))
def s7_raw_ring(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(spark, sf, 40)


@query()
def s8_commit(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases as they are committed: without what the one before said, cut into sentences, those with content kept."""
    p = t.pieces(spark, sf).withColumn("before", F.lag("text").over(Window.partitionBy("media_id").orderBy("piece_idx")))
    return live.committed(p.withColumnRenamed("piece_idx", "seq")).withColumnRenamed("seq", "piece_idx")


@query("""WITH c AS (SELECT user_id, event_id, event_type, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 END AS on_ FROM events),
    l AS (SELECT *, last_value(on_ IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last FROM c) SELECT event_id FROM l WHERE coalesce(last, 1) = 1""")
def s10_pause(spark: SparkSession, sf: str) -> DataFrame:
    """What comes between an error and the next purchase is discarded."""
    rows = t.table(spark, sf, "events").select(F.col("user_id").alias("media_id"), F.col("event_id").alias("seq"), "event_type")
    return live.while_running(rows, F.col("event_type") == "error", F.col("event_type") == "purchase").select(F.col("seq").alias("event_id"))


@query("SELECT event_id, max(event_id + value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS given_at FROM events")
def s11_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """When results that arrive out of order are given out."""
    rows = t.table(spark, sf, "events").select(F.col("user_id").alias("media_id"), F.col("event_id").alias("idx"), (F.col("event_id") + F.col("value")).alias("arrived"))
    return live.in_order(rows).select(F.col("idx").alias("event_id"), "given_at")


@query("""WITH RECURSIVE e AS (SELECT event_id // 500 AS media_id, event_id % 500 AS k, event_id, CASE WHEN event_id % 4 = 3 THEN -floor(value * 3)::BIGINT ELSE floor(value)::BIGINT END AS n FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY event_id) AS i FROM e),
    s AS (SELECT media_id, 0::BIGINT AS i, 0::BIGINT AS seq, 0::BIGINT AS written, 0::BIGINT AS read, 0::BIGINT AS place, 0::BIGINT AS count, 0::BIGINT AS lost, false AS asked FROM o GROUP BY 1
      UNION ALL SELECT media_id, i, seq, w, CASE WHEN asked THEN p + c ELSE r END, p, c, l, asked FROM (
        SELECT *, least(-n, w - p) AS c FROM (SELECT *, r + l AS p FROM (SELECT *, greatest(0, w - r - 300) AS l FROM (
          SELECT o.media_id, o.i, o.event_id AS seq, o.n, s.written + greatest(o.n, 0) AS w, s.read AS r, o.n < 0 AS asked FROM s JOIN o ON o.media_id = s.media_id AND o.i = s.i + 1)))))
    SELECT media_id, seq, place, count, lost FROM s WHERE asked""")
def io17_ring(spark: SparkSession, sf: str) -> DataFrame:
    """A ring buffer of 300 samples with a reader that falls behind."""
    e = F.col("event_id")
    rows = t.table(spark, sf, "events").select(F.floor(e / 500).alias("media_id"), e.alias("seq"), F.when(e % 4 == 3, -F.floor(F.col("value") * 3)).otherwise(F.floor("value")).cast("long").alias("n"))
    return live.over_table(rows, "ring", "n", capacity=300)

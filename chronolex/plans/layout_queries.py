"""Queries on pieces of speech, the layout of cues, files that are written, and text in pictures."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.functions.storage import folder
from chronolex.operators import boxes, layout, pieces
from chronolex.operators import cues as cu
from chronolex.operators import folds as fo
from chronolex.operators import signals as sg
from chronolex.operators import table_functions as tf
from chronolex.plans.cue_queries import _cues
from chronolex.plans.registry import query
from chronolex.sources import srt
from chronolex.sources import tables as t


def _words(spark, sf):
    """Words of conversations with times: each has its share of its piece, and there is a pause after every eleventh."""
    p = t.pieces(spark, sf).select("media_id", "piece_idx", "start", ((F.col("end") - F.col("start")) / F.size(F.split("text", " "))).alias("d"), F.posexplode(F.split("text", " ")).alias("k", "word"))
    first = F.col("start") + F.col("k") * F.col("d")
    return p.where("word <> ''").select("media_id", "piece_idx", "k", "word", first.alias("start"), (first + F.col("d") * F.when(F.col("k") % 11 == 10, 0.2).otherwise(1.0)).alias("end"))


_PIECE = "media_id long, idx int, text string, start double, end double"


def _folded(spark, sf, make):
    return fo.fold(_words(spark, sf), "media_id", ["piece_idx", "k"], _PIECE, lambda rows: ((i, *p) for i, p in enumerate(make([(r["word"], r["start"], r["end"]) for r in rows]))))


def _every(seconds, words):
    return [seconds * i for i in range(1, int(words[-1][2] // seconds) + 1)]


@query()
def p1_group_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Words as tokens that begin with a space; a special one stands before each."""
    return _folded(spark, sf, lambda words: pieces.group_tokens([x for w, a, b in words for x in (("<pad>", a, a), (f"▁{w}", a, b))]))


@query()
def p2_group_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Words as runs, the spaces between them without a time; a voice changes every 20 s."""
    return _folded(spark, sf, lambda words: pieces.group_runs([x for w, a, b in words for x in ((w, a, b), (" ", None, None))], _every(20.0, words)))


@query(t.sql("turns") + """, b AS (SELECT media_id, start AS t FROM turns WHERE speaker = 'click') SELECT t.media_id, t.turn_idx, count(b.t) AS side FROM turns t LEFT JOIN b ON b.media_id = t.media_id AND b.t <= t.start GROUP BY ALL""")
def p3_side(spark: SparkSession, sf: str) -> DataFrame:
    """How many boundaries are at or before each turn's start: a running count over both, equal times counted first."""
    from pyspark.sql import Window

    turns = t.turns(spark, sf)
    both = turns.select("media_id", "turn_idx", F.col("start").alias("at"), F.lit(0).alias("n")).unionByName(turns.where("speaker = 'click'").select("media_id", F.lit(None).cast("long").alias("turn_idx"), F.col("start").alias("at"), F.lit(1).alias("n")))
    counted = both.withColumn("side", F.sum("n").over(Window.partitionBy("media_id").orderBy("at")))
    return counted.where("turn_idx IS NOT NULL").select("media_id", "turn_idx", "side")


@query()
def p4_group_words(spark: SparkSession, sf: str) -> DataFrame:
    return _folded(spark, sf, lambda words: pieces.group_words(words, _every(20.0, words)))


@query()
def p5_punctuate(spark: SparkSession, sf: str) -> DataFrame:
    """Words without their signs, which come back from the full text."""
    bare = lambda w: "".join(x for x in w if x.isalnum())
    return _folded(spark, sf, lambda words: pieces.punctuate([(bare(w), a, b) for w, a, b in words], " ".join(w for w, _, _ in words)))


@query(t.sql("pieces") + """, b AS (SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY piece_idx) - 1) // 4 AS batch, piece_idx FROM pieces),
    n AS (SELECT media_id, batch, count(*) AS sent, count(*) FILTER (piece_idx % 9 <> 8) AS got FROM b GROUP BY ALL)
    SELECT b.media_id, b.piece_idx, sent = got AS translated, CASE WHEN sent = got THEN 0 ELSE 1 END AS failed FROM b JOIN n USING (media_id, batch)""")
def c7_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of four; one that gives back another number of texts than it was sent stays untranslated, and is counted."""
    from pyspark.sql import Window

    order, of_batch = Window.partitionBy("media_id").orderBy("piece_idx"), Window.partitionBy("media_id", "batch")
    rows = t.pieces(spark, sf).select("media_id", "piece_idx", F.floor((F.row_number().over(order) - 1) / 4).alias("batch"), (F.col("piece_idx") % 9 != 8).cast("long").alias("came"))
    ok = F.sum("came").over(of_batch) == F.count("*").over(of_batch)
    return rows.select("media_id", "piece_idx", ok.alias("translated"), F.when(ok, 0).otherwise(1).alias("failed"))


def _spoken(spark, sf):
    return _cues(spark, sf).withColumn("source", F.upper("text"))


@query()
def c9_enforce_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Cues of two lines at most; their parts come from c10 and c11."""
    return layout.enforce_lines(_spoken(spark, sf)).select("media_id", "idx", "start", "end", "text", "source", "speaker")


@query()
def c10_split_evenly(spark: SparkSession, sf: str) -> DataFrame:
    c = t.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    parts = F.pandas_udf(lambda texts: texts.map(lambda x: layout.split_evenly(x or "", 4)), "array<string>")(F.col("text"))
    return c.select("conv_id", "turn", F.posexplode(parts).alias("part", "text"))


@query("""WITH p AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS text, regexp_extract_all(trim(coalesce(text, '')), '^[ 、。，,;；:：!！?？]+[^ 、。，,;；:：!！?？]*[ 、。，,;；:：!！?？]*|[^ 、。，,;；:：!！?？]+[ 、。，,;；:：!！?？]*') AS p FROM conversations),
    s AS (SELECT conv_id, turn, text, len(p) AS n, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS i FROM p),
    g AS (SELECT conv_id, turn, least(i * 3 // n, 2) AS part, trim(string_agg(piece, '' ORDER BY i)) AS text FROM s WHERE n >= 3 GROUP BY ALL)
    SELECT conv_id, turn, part::INT AS part, text FROM g UNION ALL SELECT conv_id, turn, k, CASE WHEN k = 0 THEN text ELSE '' END FROM p, unnest([0, 1, 2]) u(k) WHERE len(p) < 3 AND (text <> '' OR k = 0)""")
def c11_split_source(spark: SparkSession, sf: str) -> DataFrame:
    """Turns in three parts cut after signs and spaces."""
    c = t.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    parts = F.pandas_udf(lambda texts: texts.map(lambda x: layout.split_source(x or "", 3)), "array<string>")(F.col("text"))
    return c.select("conv_id", "turn", F.posexplode(parts).alias("part", "text"))


@query()
def io4_render(spark: SparkSession, sf: str) -> DataFrame:
    """SubRip with dashes, wrapped lines, colours and sources."""
    cues = _spoken(spark, sf).withColumn("speaker", F.concat(F.lit("Speaker "), F.when(F.col("speaker") == "user", 1).otherwise(2).cast("string")))
    return layout.render(cues, colours=True, with_source=True)


@query(t.sql("pieces") + """, c AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start, piece_idx) AS idx, regexp_replace(text, '\\s+', ' ', 'g') AS text, round(start * 1000) / 1000 AS s, round("end" * 1000) / 1000 AS e FROM pieces WHERE regexp_matches(text, '[\\p{L}\\p{N}]'))
    SELECT media_id, idx, round(s, 3) AS start, round(CASE WHEN e <= s THEN s + 2e-1 ELSE e END, 3) AS "end", md5(trim(regexp_replace(text, '<[^>]*>', '', 'g'))) AS text FROM c""")
def io3_read_files(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces written as SubRip files, a file per medium, and read back."""
    path = folder(spark)
    rows = t.pieces(spark, sf).select("media_id", F.col("piece_idx").alias("idx"), F.regexp_replace("text", r"\s+", " ").alias("text"), "start", "end")
    srt.write(rows, path)
    back = srt.read(spark, path, glob="*.txt")
    media = F.regexp_extract("media_id", r"media_id=(-?\d+)", 1).cast("long")
    return back.select(media.alias("media_id"), F.col("idx").cast("long").alias("idx"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.md5("text").alias("text"))


@query("""WITH b AS (SELECT user_id AS media_id, ts AS t, event_id, event_type AS source, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN event_type ELSE 'x' || event_id END AS text FROM events),
    o AS (SELECT media_id, t, '[' || strftime(t, '%H:%M:%S') || ']' || chr(10) || source || CASE WHEN text <> '' AND text <> source THEN chr(10) || text ELSE '' END || chr(10) AS c FROM b)
    SELECT media_id, md5('Capture' || chr(10) || 'en → pt' || chr(10) || 'Started: ' || strftime(min(t), '%H:%M:%S') || chr(10) || chr(10) || string_agg(c, chr(10) ORDER BY t, c)) AS content FROM o GROUP BY 1""")
def io7_capture_text(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    text = F.when(e % 3 == 0, "").when(e % 3 == 1, F.col("event_type")).otherwise(F.concat(F.lit("x"), e.cast("string")))
    blocks = t.table(spark, sf, "events").select(F.col("user_id").alias("media_id"), F.col("ts").alias("at"), F.col("event_type").alias("source"), text.alias("text"))
    return layout.capture_text(blocks, F.lit("en"), F.lit("pt")).select("media_id", F.md5("content").alias("content"))


@query(t.sql("pieces") + """SELECT media_id, count(*) AS pieces, round(sum("end" - start), 4) AS seconds, md5(string_agg(text, '|' ORDER BY piece_idx)) AS digest FROM pieces GROUP BY 1""")
def io14_json_dump(spark: SparkSession, sf: str) -> DataFrame:
    """A generation per medium written as JSON lines, and read back."""
    rows = t.pieces(spark, sf).groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("piece_idx", "text", "start", "end"))).alias("pieces"), F.sum(F.col("end") - F.col("start")).alias("seconds"))
    path = folder(spark)
    rows.write.json(path)
    back = spark.read.schema(rows.schema).json(path)
    return back.select("media_id", F.size("pieces").cast("long").alias("pieces"), F.round("seconds", 4).alias("seconds"), F.md5(F.array_join(F.transform("pieces", lambda x: x["text"]), "|")).alias("digest"))


@query(t.sql("turns") + """SELECT turn_idx::INT AS n, round(round(start * 1000) / 1000, 3) AS start, round(round("end" * 1000) / 1000, 3) AS "end", CASE WHEN turn_idx % 2 = 0 THEN [speaker] ELSE [speaker, 'Rui'] END AS who FROM turns""")
def io15_marked_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of marked speakers, written and parsed."""
    from chronolex.functions.text import timecode

    who = F.concat(F.lit("["), "speaker", F.when(F.col("turn_idx") % 2 == 0, "").otherwise(" , Rui"), F.lit("]"))
    lines = t.turns(spark, sf).select(F.concat(F.col("turn_idx").cast("string"), F.lit(" "), timecode(F.col("start")), F.lit(" --> "), timecode(F.col("end")), F.lit(" "), who).alias("line"))
    return srt.parse_marks(lines).select("n", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "who")


def _boxes(spark, sf):
    """Six boxes a sample, in three heights, with Latin and Japanese texts."""
    e, v = F.col("event_id"), F.col("value") / 200
    text = F.when(e % 5 == 4, "これは").otherwise(F.col("event_type"))
    return t.table(spark, sf, "events").select(F.floor(e / 6).alias("sample"), "event_id", text.alias("text"), (0.35 + (e % 2) * 0.15 + v / 10).alias("x"), (0.6 + F.floor(e % 6 / 2) * 0.12 + v / 50).alias("y"), (F.lit(0.12) + v / 20).alias("w"), F.when(e % 6 < 4, 0.06).otherwise(0.025).alias("h"))


def _of_sample(rows):
    return [(r["text"], r["x"], r["y"], r["w"], r["h"]) for r in rows]


@query()
def b1_rows(spark: SparkSession, sf: str) -> DataFrame:
    step = lambda rows: ((i, " ".join(b[0] for b in r)) for i, r in enumerate(boxes.rows(_of_sample(rows))))
    return fo.fold(_boxes(spark, sf), "sample", ["event_id"], "sample long, row int, text string", step)


@query()
def b2_centred(spark: SparkSession, sf: str) -> DataFrame:
    step = lambda rows: ((i, " ".join(b[0] for b in boxes.centred(r))) for i, r in enumerate(boxes.rows(_of_sample(rows))))
    return fo.fold(_boxes(spark, sf), "sample", ["event_id"], "sample long, row int, text string", step)


@query()
def b3_filter(spark: SparkSession, sf: str) -> DataFrame:
    step = lambda rows: [boxes.kept(_of_sample(rows), "en")]
    return fo.fold(_boxes(spark, sf), "sample", ["event_id"], "sample long, text string, other boolean", step)


@query()
def sg5_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of half a second, one in each second of every signal, moved to where the signal is."""
    flags = sg.voiced(sg.frames(t.samples(spark, sf), 16), multiplier=1.5)
    media = flags.groupBy("media_id").agg(F.floor((F.max("frame_idx") + 1) * 0.03).cast("int").alias("seconds"))
    some = media.select("media_id", F.explode(F.sequence(F.lit(0), F.greatest(F.col("seconds") - 1, F.lit(0)))).alias("piece_idx")).select("media_id", F.col("piece_idx").cast("long").alias("piece_idx"), (F.col("piece_idx") + 0.2).alias("start"), (F.col("piece_idx") + 0.7).alias("end"))
    return sg.fit(some, flags).select("media_id", "piece_idx", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(t.sql("samples") + """, q AS (SELECT media_id, sample_idx, v / 1e5 AS v FROM samples), a AS (SELECT media_id, sqrt(avg(v * v)) AS rms, max(abs(v)) AS peak FROM q GROUP BY 1),
    b AS (SELECT media_id, CASE WHEN rms > 1e-5 AND rms < 3e-3 AND least(20, 3e-2 / rms, 95e-2 / peak) > 1 THEN least(20, 3e-2 / rms, 95e-2 / peak) ELSE 1 END AS g FROM a),
    y AS (SELECT media_id, sample_idx, v * g AS v FROM q JOIN b USING (media_id)),
    x AS (SELECT media_id, sample_idx // 16 AS f, sample_idx // 400 AS w, v * v AS e FROM y), s AS (SELECT media_id, w, f, sum(e) AS e, count(*) AS n FROM x GROUP BY ALL),
    k AS (SELECT media_id, sqrt(e / n) AS rms, row_number() OVER (PARTITION BY media_id ORDER BY sqrt(e / n)) AS r, count(*) OVER (PARTITION BY media_id) AS c FROM s),
    z AS (SELECT media_id, rms AS noise FROM k WHERE r = floor(c * 1e-1) + 1), win AS (SELECT media_id, w, sqrt(sum(e) / sum(n)) AS rms, sum(n) AS span FROM s GROUP BY ALL),
    l AS (SELECT win.*, rms > greatest(5e-4, 11e-1 * noise) AS live FROM win JOIN z USING (media_id)),
    t AS (SELECT media_id, rms, row_number() OVER (PARTITION BY media_id ORDER BY rms) AS r, count(*) OVER (PARTITION BY media_id) AS c FROM l WHERE live),
    g AS (SELECT media_id, rms AS target FROM t WHERE r = floor(c * 75e-2) + 1 AND c > 3),
    h AS (SELECT l.*, CASE WHEN live AND target IS NOT NULL THEN least(20, greatest(1, target / rms)) ELSE 1 END AS gain FROM l LEFT JOIN g USING (media_id)),
    i AS (SELECT *, max(gain) OVER (PARTITION BY media_id) > 105e-2 AND count(*) OVER (PARTITION BY media_id) > 4 AS raised, coalesce(lead(gain) OVER (PARTITION BY media_id ORDER BY w), gain) AS after FROM h)
    SELECT y.media_id, y.sample_idx, round(CASE WHEN raised THEN greatest(-99e-2, least(99e-2, v * (gain + (after - gain) * ((sample_idx - i.w * 400) / span)))) ELSE v END, 6) AS v FROM y JOIN i ON i.media_id = y.media_id AND i.w = y.sample_idx // 400""")
def sg8_prepared(spark: SparkSession, sf: str) -> DataFrame:
    """A quiet signal raised as a whole, then its quiet stretches, sample by sample."""
    quiet = t.samples(spark, sf).withColumn("v", F.col("v") / 1e5)
    return sg.prepare(quiet, window=400, frame=16, multiplier=1.1).select("media_id", "sample_idx", F.round("v", 6).alias("v"))


def _grouped_by_sql(spark, name, rows, more=""):
    tf.register(spark)
    view = f"{name}_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(view)
    return spark.sql(f"SELECT * FROM {name}(TABLE(SELECT * FROM {view}) PARTITION BY media_id ORDER BY (piece_idx, k, at){more})")


def _timed(spark, sf, *parts):
    """Words as rows (text, start, end) in the order piece_idx, k, at; parts: the rows that each word gives."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), *p) for i, p in enumerate(parts)])).alias("x")
    return _words(spark, sf).select("media_id", "piece_idx", "k", each).select("media_id", "piece_idx", "k", "x.*")


def _part(text, start, end):
    return text.alias("text"), start.cast("double").alias("start"), end.cast("double").alias("end")


@query()
def u11_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """p1 as a table function in SQL."""
    start, end = F.col("start"), F.col("end")
    return _grouped_by_sql(spark, "group_tokens", _timed(spark, sf, _part(F.lit("<pad>"), start, start), _part(F.concat(F.lit("▁"), "word"), start, end)))


@query()
def u11_runs(spark: SparkSession, sf: str) -> DataFrame:
    """p2 as a table function."""
    rows = _timed(spark, sf, _part(F.col("word"), F.col("start"), F.col("end")), _part(F.lit(" "), F.lit(None), F.lit(None)))
    return _grouped_by_sql(spark, "group_runs", rows, ", every => 20.0D")


@query()
def u11_words(spark: SparkSession, sf: str) -> DataFrame:
    """p4 as a table function."""
    return _grouped_by_sql(spark, "group_words", _timed(spark, sf, _part(F.col("word"), F.col("start"), F.col("end"))), ", every => 20.0D")


@query()
def u11_lines(spark: SparkSession, sf: str) -> DataFrame:
    """c9 as a table function; the cues' overlaps are fixed after it."""
    tf.register(spark)
    view = f"shown_{uuid.uuid4().hex}"
    layout.shown_cues(_spoken(spark, sf)).createOrReplaceTempView(view)
    parts = spark.sql(f"SELECT * FROM fit_lines(TABLE(SELECT * FROM {view}) PARTITION BY media_id ORDER BY idx)")
    return cu.fix_overlaps(parts.withColumn("idx", F.struct("idx", "part"))).select("media_id", "idx", "start", "end", "text", "source", "speaker")

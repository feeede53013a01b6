"""Queries on text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.functions import text as tx
from chronolex.plans.registry import query
from chronolex.sources import tables as t

_N = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g')".format


@query(f"SELECT doc_id, md5({_N('text')}) AS plain FROM documents")
def t6_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "documents").select("doc_id", F.md5(tx.normalize(F.col("text"))).alias("plain"))


@query("SELECT conv_id, turn, trim(regexp_replace(trim('... - ' || text || ' '), '^[^\\p{L}\\p{N}¿¡]+', '')) AS tidy FROM conversations")
def t8_tidy(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "conversations").select("conv_id", "turn", tx.tidy(F.concat(F.lit("... - "), "text", F.lit(" "))).alias("tidy"))


@query(f"""WITH p AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS b, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
    q AS (SELECT conv_id, turn, list_filter(string_split(coalesce(prev, ''), ' '), lambda x: x <> '') AS a, list_concat(list_filter(string_split(coalesce(prev, ''), ' '), lambda x: x <> '')[-3:], b) AS b FROM p),
    n AS (SELECT *, list_transform(a, lambda x: {_N('x')}) AS na, list_transform(b, lambda x: {_N('x')}) AS nb FROM q),
    h AS (SELECT *, coalesce(list_max(list_filter([1, 2, 3, 4, 5, 6, 7, 8], lambda k: len(na) >= k AND len(nb) >= k AND na[-k:] = nb[:k] AND NOT list_contains(nb[:k], ''))), 0) AS hit FROM n)
    SELECT conv_id, turn, hit, md5(array_to_string(b[hit + 1:], ' ')) AS rest FROM h""")
def t15_overlap_trim(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn, begun with the last three words of the one before, trimmed of what it repeats."""
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda x: x != "")
    p = t.table(spark, sf, "conversations").select("conv_id", "turn", "text", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("prev"))
    a, n = words(F.col("prev")), F.size(words(F.col("prev")))
    new = F.concat(F.slice(a, F.greatest(n - 2, F.lit(1)), 3), words(F.col("text")))
    p = p.select("conv_id", "turn", "prev", F.array_join(new, " ").alias("new"))
    rest = tx.overlap_trim(F.col("prev"), F.col("new"))
    return p.select("conv_id", "turn", (F.size(words(F.col("new"))) - F.size(words(rest))).cast("int").alias("hit"), F.md5(rest).alias("rest"))


_WITH_FILLERS = ["Thank you for watching!", "thanks for watching. Thanks for watching.", "Good morning", "...", "See you in the next video"]


@query("WITH r AS (SELECT event_id, [" + ", ".join(f"'{x}'" for x in _WITH_FILLERS) + "][(event_id % 5 + 1)::INT] AS text FROM events)"
       f""" SELECT event_id, regexp_matches({_N('text')}, '^(|({"|".join("(" + x + "){1,3}" for x in tx.FILLERS)}))$') AS filler FROM r""")
def t16_filler(spark: SparkSession, sf: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, _WITH_FILLERS)), (F.col("event_id") % 5 + 1).cast("int"))
    return t.table(spark, sf, "events").select("event_id", tx.is_filler(text).alias("filler"))


@query("SELECT event_id, event_id % 10 / 10e0 < 6e-1 AND -(event_id % 7) / 4e0 > -1 AND value / 20 < 24e-1 AS real FROM events")
def t23_real_speech(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return t.table(spark, sf, "events").select("event_id", tx.is_real_speech(e % 10 / 10.0, -(e % 7) / 4.0, F.col("value") / 20).alias("real"))


@query("""SELECT doc_id, 2 * length(regexp_replace(text, '[^A-Za-z\\x{C0}-\\x{24F}\\x{1E00}-\\x{1EFF}\\x{FF21}-\\x{FF3A}\\x{FF41}-\\x{FF5A}]|[×÷]', '', 'g')) > length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS written FROM documents""")
def t24_script(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "documents").select("doc_id", tx.is_written(F.col("text"), F.col("lang")).alias("written"))


@query("""WITH l AS (SELECT event_id // 10 AS batch, CASE WHEN event_id % 37 = 0 THEN '' ELSE (event_id % 10 + CASE WHEN event_id % 53 = 0 THEN 5 ELSE 1 END) || '::' || event_type END AS line FROM events),
    p AS (SELECT batch, try_cast(regexp_extract(line, '^\\s*([0-9]+)::', 1) AS INT) AS n, trim(regexp_extract(line, '^\\s*[0-9]+::(.*)$', 1)) AS text FROM l WHERE trim(line) <> ''),
    g AS (SELECT batch, n, count(DISTINCT text) AS texts, bool_or(text = '') AS empty FROM p WHERE n IS NOT NULL GROUP BY ALL)
    SELECT b.batch, coalesce(count(g.n) = 10 AND bool_and(texts = 1 AND NOT empty AND n BETWEEN 1 AND 10), false) AS accepted FROM (SELECT DISTINCT batch FROM l) b LEFT JOIN g USING (batch) GROUP BY 1""")
def t26_numbered_reply(spark: SparkSession, sf: str) -> DataFrame:
    """Replies of ten lines `N::text`: accepted only if every number is there once, with one text."""
    e = F.col("event_id")
    line = F.when(e % 37 == 0, "").otherwise(F.concat((e % 10 + F.when(e % 53 == 0, 5).otherwise(1)).cast("string"), F.lit("::"), "event_type"))
    rows = t.table(spark, sf, "events").select(F.floor(e / 10).alias("batch"), line.alias("line"))
    p = rows.where(F.trim("line") != "").select("batch", F.regexp_extract("line", r"^\s*([0-9]+)::", 1).try_cast("int").alias("n"), F.trim(F.regexp_extract("line", r"^\s*[0-9]+::(.*)$", 1)).alias("text"))
    g = p.where("n IS NOT NULL").groupBy("batch", "n").agg(F.countDistinct("text").alias("texts"), F.bool_or(F.col("text") == "").alias("empty"))
    ok = g.groupBy("batch").agg(((F.count("*") == 10) & F.bool_and((F.col("texts") == 1) & ~F.col("empty") & F.col("n").between(1, 10))).alias("accepted"))
    return rows.select("batch").distinct().join(ok, "batch", "left").select("batch", F.coalesce("accepted", F.lit(False)).alias("accepted"))


@query("""WITH p AS (SELECT conv_id, text AS src, CASE WHEN turn % 3 = 0 THEN text ELSE upper(text) END AS out FROM conversations), l AS (SELECT *, len(string_split(src, ' ')) AS words FROM p),
    g AS (SELECT conv_id, count(*) AS n, count(*) FILTER (words > 3) AS eligible, count(*) FILTER (words > 3 AND src = out) AS same, max(words) AS longest FROM l GROUP BY 1)
    SELECT conv_id, CASE WHEN n = 1 THEN same = 1 AND longest > 6 ELSE same >= 2 AND 3 * same >= eligible END AS echo FROM g""")
def t29_echo(spark: SparkSession, sf: str) -> DataFrame:
    """Batches whose translation is the source given back."""
    p = t.table(spark, sf, "conversations").select("conv_id", F.col("text").alias("src"), F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.upper("text")).alias("out"), F.size(F.split("text", " ")).alias("words"))
    n = lambda c: F.sum(c.cast("long"))
    g = p.groupBy("conv_id").agg(F.count("*").alias("n"), n(F.col("words") > 3).alias("eligible"), n((F.col("words") > 3) & (F.col("src") == F.col("out"))).alias("same"), F.max("words").alias("longest"))
    return g.select("conv_id", F.when(F.col("n") == 1, (F.col("same") == 1) & (F.col("longest") > 6)).otherwise((F.col("same") >= 2) & (3 * F.col("same") >= F.col("eligible"))).alias("echo"))


@query("SELECT event_id, (event_id % 4, event_id % 3, 0, 0, event_id % 2) > (event_id % 5, event_id % 2, event_id % 7, 0, event_id % 3) AS newer FROM events")
def t35_newer(spark: SparkSession, sf: str) -> DataFrame:
    e = lambda n: (F.col("event_id") % n).cast("string")
    remote = F.concat_ws(".", F.concat(F.lit("v"), e(4)), e(3), F.lit("0"), F.lit("0"), e(2))
    return t.table(spark, sf, "events").select("event_id", tx.is_newer(remote, F.concat_ws(".", e(5), e(2), e(7), F.lit("0"), e(3))).alias("newer"))


@query("""WITH s AS (SELECT event_id, floor(value * 100)::BIGINT AS s FROM events)
    SELECT event_id, CASE WHEN s >= 3600 THEN format('{:d}:{:02d}:{:02d}', s // 3600, s // 60 % 60, s % 60) ELSE format('{:d}:{:02d}', s // 60, s % 60) END AS clock FROM s""")
def t37_clock(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "events").select("event_id", tx.clock(F.col("value") * 100).alias("clock"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE greatest(user_id - 1, 0) % 4 END::INT AS colour FROM events")
def t39_palette(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("event_id") % 3 == 0, "Speaker").otherwise(F.concat(F.lit("Speaker "), F.col("user_id").cast("string")))
    return t.table(spark, sf, "events").select("event_id", tx.palette_index(label).alias("colour"))


# The other engine's edit distance counts bytes, so its accented letters become signs of one byte, one for each.
ONE_BYTE = "translate({}, 'àáâäçèéêëíîïñóôöùúûüßœ', '!#$%&()*+,-/:;<=>?@[]^_')".format


@query(f"""WITH p AS (SELECT conv_id, turn, {ONE_BYTE(_N('text'))} AS a, {ONE_BYTE(_N('lag(text) OVER (PARTITION BY conv_id ORDER BY turn)'))} AS b FROM conversations)
    SELECT conv_id, turn, CASE WHEN a = '' OR b = '' THEN a = b ELSE levenshtein(a, b) <= 75e-2 * greatest(length(a), length(b)) END AS same FROM p WHERE b IS NOT NULL""")
def b4_same_text(spark: SparkSession, sf: str) -> DataFrame:
    c = t.table(spark, sf, "conversations").select("conv_id", "turn", "text", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("b")).where("b IS NOT NULL")
    return c.select("conv_id", "turn", tx.same_text(F.col("text"), F.col("b"), 0.75).alias("same"))


@query("""WITH v AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL) SELECT user_id, arg_min(event_type, (-n, first)) AS text FROM v GROUP BY 1""")
def b6_vote(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent text; of equals, the earliest."""
    v = t.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return v.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "event_type")).alias("b")).select("user_id", F.col("b.event_type").alias("text"))

"""Queries on scalar rules of text, files and engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.functions import text as tx
from chronolex.operators import engines
from chronolex.plans.registry import query
from chronolex.sources import tables as t

_D = "\\x{3000}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{FF00}-\\x{FF9F}"
# Documents whose vowels are Japanese letters in every third one, so that rules of dense scripts apply.
_DENSE = "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN translate(text, 'aeiou', 'あえいおう') ELSE text END AS text FROM documents) "


def _dense(spark, sf):
    text = F.when(F.col("doc_id") % 3 == 0, F.translate("text", "aeiou", "あえいおう")).otherwise(F.col("text"))
    return t.table(spark, sf, "documents").select("doc_id", text.alias("text"))


@query(_DENSE + f"SELECT doc_id, regexp_matches(text, '^[{_D}]') AS dense FROM d")
def t1_is_dense(spark: SparkSession, sf: str) -> DataFrame:
    return _dense(spark, sf).select("doc_id", tx.is_dense(F.col("text")).alias("dense"))


_TOKENS = _DENSE + f""", k AS (SELECT doc_id, CASE WHEN regexp_matches(text, '[あえいおう]') THEN regexp_extract_all(text, '[{_D}]|[^\\s{_D}]+') ELSE list_filter(string_split(text, ' '), lambda x: x <> '') END AS tokens, text FROM d) """


@query(_TOKENS + "SELECT doc_id, len(tokens) AS tokens, md5(array_to_string(tokens, '|')) AS digest, regexp_matches(text, '[\\p{L}\\p{N}]') AS content FROM k")
def t2_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = _dense(spark, sf).withColumn("tokens", tx.split_tokens(F.col("text")))
    return rows.select("doc_id", F.size("tokens").cast("long").alias("tokens"), F.md5(F.array_join("tokens", "|")).alias("digest"), tx.has_content(F.col("text")).alias("content"))


@query(_TOKENS + f""", j AS (SELECT doc_id, array_to_string(tokens, ' ') AS s, regexp_matches(text, '[あえいおう]') AS dense FROM k)
    SELECT doc_id, md5(CASE WHEN dense THEN regexp_replace(regexp_replace(s, '([{_D}\\s]) ', '\\1', 'g'), ' ([{_D}\\s])', '\\1', 'g') ELSE s END) AS joined FROM j""")
def t3_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = _dense(spark, sf).select("doc_id", tx.split_tokens(F.col("text")).alias("tokens"))
    return rows.select("doc_id", F.md5(tx.join_tokens(F.col("tokens"))).alias("joined"))


@query(_DENSE + f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '([{_D}]) ([{_D}])', '\\1\\2', 'g'), '([{_D}]) ([{_D}])', '\\1\\2', 'g')) AS tight FROM d")
def t4_tighten(spark: SparkSession, sf: str) -> DataFrame:
    return _dense(spark, sf).select("doc_id", F.md5(tx.tighten_dense(F.col("text"))).alias("tight"))


_N = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g')".format
_LAGGED = "WITH p AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) "


def _lagged(spark, sf):
    order = Window.partitionBy("conv_id").orderBy("turn")
    return t.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", F.lag("text").over(order).alias("prev"), F.lead("text").over(order).alias("next"))


@query(_LAGGED + f"SELECT conv_id, turn, {_N('left(text, 12)')} <> '' AND contains({_N('text')} || {_N('next')}, {_N('left(text, 12)')}) AS confirmed FROM p WHERE next IS NOT NULL")
def t17_confirmed(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a turn's first words are in what it and the next turn say."""
    rows = _lagged(spark, sf).where("next IS NOT NULL")
    return rows.select("conv_id", "turn", tx.is_confirmed(F.substring("text", 1, 12), F.concat("text", "next")).alias("confirmed"))


_HEARD = """WITH h AS (SELECT event_id, event_id % 60 AS media_id, value AS start, value + (event_id % 7) - 1 AS "end", ['en', 'ja', 'pt', 'fr'][(event_id % 4 + 1)::INT] AS language,
    ['Thank you for watching!', 'Good morning', '...'][(event_id % 3 + 1)::INT] AS text, CASE event_id % 5 WHEN 0 THEN 'well, thank you for watching' WHEN 1 THEN NULL ELSE 'other words' END AS second FROM events) """


@query(_HEARD + f"""SELECT event_id FROM h WHERE NOT (text = '...' OR text LIKE 'Thank%') OR
    (language IN ('en', 'ja', 'pt') AND text <> '...' AND "end" > start AND start < 90 AND "end" > 0 AND contains({_N("coalesce(second, '')")}, {_N('text')}))""")
def t18_filter_fillers(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces that are not mere fillers, or that a second hearing of their stretch confirms; media are 90 s long."""
    e = F.col("event_id")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (e % n + 1).cast("int"))
    second = F.when(e % 5 == 0, "well, thank you for watching").when(e % 5 == 1, F.lit(None)).otherwise("other words")
    rows = t.table(spark, sf, "events").select("event_id", F.col("value").alias("start"), (F.col("value") + e % 7 - 1).alias("end"), pick(4, "en", "ja", "pt", "fr").alias("language"), pick(3, "Thank you for watching!", "Good morning", "...").alias("text"), second.alias("second"))
    heard = F.col("language").isin("en", "ja", "pt") & (F.col("end") > F.col("start")) & (F.col("start") < 90) & (F.col("end") > 0) & F.coalesce(tx.is_confirmed(F.col("text"), F.col("second")), F.lit(False))
    return rows.where(~tx.is_filler(F.col("text")) | heard).select("event_id")


@query()
def t21_strip_hesitations(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with hesitations put in, by language; rows without content go. Tested against the rules in plain Python."""
    c = t.table(spark, sf, "conversations")
    en, ja = F.concat(F.lit("Um, "), F.regexp_replace("text", " ", " uh, ")), F.concat(F.lit("えーと、"), F.translate("text", "aeiou ", "あえいおう、"))
    rows = c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, "en").otherwise("ja").alias("language"), F.when(F.col("turn") % 2 == 0, en).otherwise(ja).alias("text"))
    return rows.select("conv_id", "turn", tx.strip_hesitations(F.col("text"), F.col("language")).alias("text")).where("text IS NOT NULL")


@query("SELECT conv_id, turn, trim(regexp_replace('<|start|>' || replace(text, ' ', ' <|t|>') || ' <|end|> ', '<\\|[^|]*\\|>', '', 'g')) AS text FROM conversations")
def t22_strip_special(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.concat(F.lit("<|start|>"), F.replace("text", F.lit(" "), F.lit(" <|t|>")), F.lit(" <|end|> "))
    return t.table(spark, sf, "conversations").select("conv_id", "turn", tx.strip_special(marked).alias("text"))


@query("WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, text FROM conversations) SELECT conv_id, md5(string_agg(i || ') ' || text, chr(10) ORDER BY i)) AS prompt FROM n GROUP BY 1")
def t27_prompt(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return t.table(spark, sf, "conversations").groupBy("conv_id").agg(lines.alias("lines")).select("conv_id", F.md5(tx.prompt(F.col("lines"))).alias("prompt"))


@query("""SELECT conv_id, turn, replace(replace(replace(replace(replace(translate(text, 'aeiou', '“’–…„'), '“', '"'), '’', ''''), '–', '-'), '…', '...'), '„', '"') AS plain FROM conversations""")
def t28_typography(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "conversations").select("conv_id", "turn", tx.plain_typography(F.translate("text", "aeiou", "“’–…„")).alias("plain"))


@query("""WITH g AS (SELECT conv_id, string_agg(replace(text, chr(10), ' '), chr(10) ORDER BY turn) AS text, count(*) AS n FROM conversations GROUP BY 1)
    SELECT conv_id, CASE WHEN conv_id % 2 = 0 AND n > 1 THEN n ELSE 1 END AS parts FROM g""")
def t30_split_paragraph(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation in one paragraph; in odd ones the number of lines that is expected is wrong."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text")))), lambda x: x["text"])
    rows = t.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(lines, "\n").alias("text"), F.count("*").alias("n"))
    return rows.select("conv_id", F.size(tx.split_paragraph(F.array("text"), F.col("n") + F.col("conv_id") % 2)).cast("long").alias("parts"))


@query("SELECT event_id, event_id % 2 = 0 AND (event_id % 3 = 0 OR user_id % 4 = 0 OR event_type <> 'click') AS accepted FROM events")
def t31_acceptable(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    previous = F.when(F.col("user_id") % 4 == 0, F.lit(None)).otherwise(F.array(F.lit("click")))
    return t.table(spark, sf, "events").select("event_id", tx.acceptable(F.array("event_type"), e % 2 == 0, e % 3 == 0, previous).alias("accepted"))


def _written(column: str) -> str:
    for char, written in tx.SCRIPT_ESCAPES.items():
        column = f"replace({column}, chr({ord(char)}), '{written}')"
    return f"""'"' || {column} || '"'"""


#: The same as bytes of hex digits: those of ASCII letters and digits are taken back.
_ENCODED = """array_to_string(list_transform(range(1, octet_length(encode(s)) * 2, 2), lambda i: CASE WHEN regexp_matches(chr(('0x' || substr(hex(encode(s)), i, 2))::INT), '^[A-Za-z0-9]$') THEN chr(('0x' || substr(hex(encode(s)), i, 2))::INT) ELSE '%' || substr(hex(encode(s)), i, 2) END), '')"""


@query(f"""WITH t AS (SELECT conv_id, turn, text, text || chr(10) || role AS s FROM conversations)
    SELECT conv_id, turn, md5({_ENCODED.replace('(s)', "(coalesce(text, ''))")}) AS escaped, md5({_written('text')}) AS literal, md5('https://example.org/?bloco=' || turn || '#de/en-US/' || {_ENCODED}) AS address FROM t""")
def t32_escaped(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as parts of an address and as literals of a script."""
    c = t.table(spark, sf, "conversations")
    address = tx.request_address(F.array("text", "role"), F.lit("de"), F.lit("en-US"), F.col("turn"), "https://example.org/")
    return c.select("conv_id", "turn", F.md5(tx.percent_encoded(F.col("text"))).alias("escaped"), F.md5(tx.script_literal(F.col("text"))).alias("literal"), F.md5(address).alias("address"))


@query("WITH w AS (SELECT conv_id, turn, left(text, (turn % 6)::INT) AS s FROM conversations) SELECT conv_id, turn, length(s) < 4 AND NOT regexp_matches(s, '\\s') AS short FROM w")
def t33_too_short(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "conversations").select("conv_id", "turn", tx.too_short(F.substring(F.col("text"), F.lit(1), (F.col("turn") % 6).cast("int"))).alias("short"))


@query("""SELECT doc_id, lang, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' END AS name, lang AS deepl_source,
    CASE lang WHEN 'en' THEN 'en-US' WHEN 'pt' THEN 'pt-BR' ELSE lang END AS deepl_target, CASE lang WHEN 'zh' THEN 'zh-CN' ELSE lang END AS google, lang IN ('en', 'de', 'fr', 'es') AS parakeet FROM documents""")
def t34_language_codes(spark: SparkSession, sf: str) -> DataFrame:
    docs = t.table(spark, sf, "documents").select("doc_id", "lang")
    return docs.join(F.broadcast(engines.languages(spark)), F.col("lang") == F.col("code"), "left").drop("code")


_BUNDLES = "WITH b AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'com.' || event_type || '.app' WHEN 1 THEN 'com.' || event_type || '.Helper.renderer' WHEN 2 THEN '' ELSE 'helper.x' END AS bundle, CASE WHEN event_id % 3 = 0 THEN event_type END AS exe, value FROM events), k AS (SELECT *, CASE event_id % 4 WHEN 0 THEN bundle WHEN 1 THEN 'com.' || event_type2 WHEN 2 THEN coalesce('exec:' || exe, 'pid:' || event_id) ELSE bundle END AS grp FROM (SELECT *, split_part(bundle, '.', 2) AS event_type2 FROM b)) "


def _processes(spark, sf):
    e = F.col("event_id") % 4
    bundle = F.when(e == 0, F.concat(F.lit("com."), "event_type", F.lit(".app"))).when(e == 1, F.concat(F.lit("com."), "event_type", F.lit(".Helper.renderer"))).when(e == 2, "").otherwise("helper.x")
    rows = t.table(spark, sf, "events").select("event_id", bundle.alias("bundle"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("exe"), "value")
    return rows.withColumn("grp", tx.process_group(F.col("bundle"), F.col("exe"), F.col("event_id")))


@query(_BUNDLES + "SELECT event_id, grp FROM k")
def t36_process_group(spark: SparkSession, sf: str) -> DataFrame:
    return _processes(spark, sf).select("event_id", "grp")


@query(_BUNDLES + ", g AS (SELECT grp, min(bundle) FILTER (NOT contains(lower(bundle), 'helper')) AS main, min(bundle) AS any_name, bool_or(value > 90) AS playing, count(*) AS members FROM k GROUP BY 1) SELECT grp, coalesce(nullif(main, ''), nullif(any_name, ''), grp) AS name, playing, members, row_number() OVER (ORDER BY playing DESC, coalesce(nullif(main, ''), nullif(any_name, ''), grp), grp) AS place FROM g WHERE grp NOT LIKE 'pid:%'")
def v11_process_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Processes by group: the name of the main one, whether any plays, those that play first; nameless ones are hidden."""
    rows = _processes(spark, sf).where(~F.col("grp").startswith("pid:"))
    helper = F.contains(F.lower("bundle"), F.lit("helper"))
    g = rows.groupBy("grp").agg(F.min(F.when(~helper, F.col("bundle"))).alias("main"), F.min("bundle").alias("any_name"), F.bool_or(F.col("value") > 90).alias("playing"), F.count("*").alias("members"))
    g = g.select("grp", F.coalesce(F.nullif("main", F.lit("")), F.nullif("any_name", F.lit("")), "grp").alias("name"), "playing", "members")
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("playing"), "name", "grp")).cast("long"))  # a row per program


@query("WITH p AS (SELECT event_id, event_id % 40 / 10e0 AS p FROM events) SELECT event_id, (CASE WHEN p > 0 AND p = floor(p) THEN floor(p) ELSE floor(p) + 1 END)::INT AS number, round(CASE WHEN p > 0 AND p = floor(p) THEN 1 ELSE p - floor(p) END, 6) AS fraction FROM p")
def t38_progress_pass(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.table(spark, sf, "events").select("event_id", tx.progress_pass(F.col("event_id") % 40 / 10.0).alias("p"))
    return rows.select("event_id", "p.number", F.round("p.fraction", 6).alias("fraction"))


@query("""WITH c AS (SELECT event_id, value * 100 * [0.12e0, 0.18e0, 0.01e0, 0.08e0, 0.05e0, 0.1e0][(event_id % 6 + 1)::INT] AS s FROM events)
    SELECT event_id, '≈ ' || CASE WHEN s < 90 THEN round(s)::INT || ' s' ELSE round(s / 60)::INT || ' min' END AS shown FROM c WHERE s > 0""")
def t40_estimate(spark: SparkSession, sf: str) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, tx.COSTS)), (F.col("event_id") % 6 + 1).cast("int"))
    rows = t.table(spark, sf, "events").select("event_id", (F.col("value") * 100 * tx.cost(names)).alias("s")).where("s > 0")
    return rows.select("event_id", tx.estimate(F.col("s")).alias("shown"))


@query("SELECT conv_id, turn, md5(array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ')) AS words FROM conversations")
def t41_words(spark: SparkSession, sf: str) -> DataFrame:
    """The words that error rates compare: runs of letters and digits, in lower case."""
    return t.table(spark, sf, "conversations").select("conv_id", "turn", F.md5(F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")).alias("words"))


@query("SELECT event_id, 'capture-' || strftime(ts, '%Y-%m-%d-%H%M') || '.txt' AS capture, CASE WHEN event_id % 3 = 0 THEN 'subtitles' ELSE event_type || '.v' || event_id END || '.en.srt' AS srt FROM events")
def io8_names(spark: SparkSession, sf: str) -> DataFrame:
    path = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("/media/"), "event_type", F.lit(".v"), F.col("event_id").cast("string"), F.lit(".mp4")))
    return t.table(spark, sf, "events").select("event_id", tx.suggested_name(F.col("ts")).alias("capture"), tx.suggested_srt_name(path, F.lit("en")).alias("srt"))


_HEADS = {"MP4": "000000186674797069736F6D", "MOV": "00000014667479707174202000", "WAV": "52494646AAAAAAAA57415645", "AVI": "52494646AAAAAAAA41564920", "FLAC": "664C61430000002210001000", "MP3": "494433040000000000000000", "MKV": "1A45DFA30000000000000000", "Ogg": "4F6767530002000000000000"}


@query("WITH h AS (SELECT event_id, [" + ", ".join(f"'{k}'" for k in (*_HEADS, "")) + "][(event_id % 9 + 1)::INT] AS c FROM events) SELECT event_id, nullif(c, '') AS container, c IN ('MP4', 'M4V', 'M4A', 'MOV', 'MP3', 'WAV', 'AIFF', 'AAC', 'CAF', 'FLAC') AS supported FROM h")
def io11_container(spark: SparkSession, sf: str) -> DataFrame:
    """Files known by their first bytes (IO11), and whether they can be opened (IO12)."""
    head = F.unhex(F.element_at(F.array(*map(F.lit, (*_HEADS.values(), "00" * 12))), (F.col("event_id") % 9 + 1).cast("int")))
    rows = t.table(spark, sf, "events").select("event_id", tx.container(head).alias("container"))
    return rows.select("event_id", "container", tx.is_supported(F.col("container")).alias("supported"))


@query("""WITH s AS (SELECT event_id, ['extracting', 'loadingASR', 'diarizing', 'transcribing', 'loadingTranslator', 'translating', 'saving'][(event_id % 7 + 1)::INT] AS step, user_id, value / 100 AS w FROM events),
    o AS (SELECT *, CASE step WHEN 'extracting' THEN 0.04e0 * w WHEN 'loadingASR' THEN 0.04e0 + 0.08e0 * w WHEN 'diarizing' THEN 0.12e0 + 0.06e0 * w WHEN 'transcribing' THEN 0.18e0 + 0.3e0 * w WHEN 'loadingTranslator' THEN 0.48e0 + 0.04e0 * w WHEN 'translating' THEN 0.52e0 + 0.45e0 * w ELSE 0.97e0 + 0.03e0 * w END AS p FROM s)
    SELECT event_id, round(max(p) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS shown FROM o""")
def c18_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Progress over all steps, which is never shown to go back."""
    names = F.element_at(F.array(*[F.lit(x) for x in tx.STEP_SHARES if x != "readingImage"]), (F.col("event_id") % 7 + 1).cast("int"))
    rows = t.table(spark, sf, "events").select("event_id", "user_id", tx.overall_progress(names, F.col("value") / 100).alias("p"))
    return rows.select("event_id", F.round(F.max("p").over(Window.partitionBy("user_id").orderBy("event_id")), 6).alias("shown"))


@query("SELECT conv_id, turn, text AS translated, 'pt' AS target FROM conversations")
def u3_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Without translation the text stays and the target is the language spoken."""
    return engines.identity(t.table(spark, sf, "conversations").select("conv_id", "turn", "text"), F.lit("pt")).select("conv_id", "turn", "translated", "target")


@query("""WITH w AS (SELECT event_id, ['apple', 'qwen', 'qwenLarge', 'parakeet', 'whisper'][(event_id % 5 + 1)::INT] AS wanted, ['pt', 'en', 'ja', 'tr'][(event_id // 5 % 4 + 1)::INT] AS lang, value > 50 AS available FROM events)
    SELECT event_id, CASE WHEN wanted IN ('apple', 'qwen', 'qwenLarge') AND available THEN wanted WHEN wanted = 'parakeet' AND lang IN ('pt', 'en') THEN wanted ELSE 'whisper' END AS engine FROM w""")
def u9_engine(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    rows = t.table(spark, sf, "events").select("event_id", F.element_at(F.array(*map(F.lit, ("apple", "qwen", "qwenLarge", "parakeet", "whisper"))), (e % 5 + 1).cast("int")).alias("wanted"), F.element_at(F.array(*map(F.lit, ("pt", "en", "ja", "tr"))), (F.floor(e / 5) % 4 + 1).cast("int")).alias("code"), (F.col("value") > 50).alias("available"))
    return engines.choose(rows, engines.languages(spark)).select("event_id", "engine")


_CALLS = "WITH c AS (SELECT user_id, event_id, (epoch_us(ts) - 1704067200000000) / 1e6 AS t, value < 60 AS failed FROM events) "


@query(_CALLS + """, s AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM c), k AS (SELECT *, sum(failed::INT) OVER (PARTITION BY user_id, run ORDER BY t, event_id) AS streak FROM s),
    o AS (SELECT *, max(CASE WHEN failed AND streak >= 3 THEN t END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened FROM k)
    SELECT event_id, (CASE WHEN failed THEN streak ELSE 0 END)::BIGINT AS streak, coalesce(t - opened < 60000, false) AS refused FROM o""")
def u13_circuit_breaker(spark: SparkSession, sf: str) -> DataFrame:
    """A log of calls: failures in a row, and calls that come too soon after the third or a later one."""
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(1e6)
    calls = t.table(spark, sf, "events").select("user_id", "event_id", seconds.alias("t"), (F.col("value") < 60).alias("failed"))
    return engines.circuit(calls, "user_id", most=3, pause=60000.0).select("event_id", "streak", "refused")


@query(_LAGGED + "SELECT conv_id, turn, regexp_replace(text, '\\s', '', 'g') = regexp_replace(CASE WHEN turn % 2 = 0 THEN replace(text, ' ', '  ') ELSE coalesce(prev, '') END, '\\s', '', 'g') AS same FROM p")
def u14_same_lines(spark: SparkSession, sf: str) -> DataFrame:
    other = F.when(F.col("turn") % 2 == 0, F.replace("text", F.lit(" "), F.lit("  "))).otherwise(F.coalesce("prev", F.lit("")))
    return _lagged(spark, sf).select("conv_id", "turn", tx.same_lines(F.split("text", "\n"), F.split(other, "\n")).alias("same"))

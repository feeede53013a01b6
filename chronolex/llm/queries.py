"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.llm import bpe, chat, common, html_crf, jaccard, kneser_ney, licences, line_dedup, lsa, pii, simhash, spelling, warc, whitening


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    path = common.scratch(spark, "warc")
    warc.write_archive(pages, path, key="page_id", url="url", payload="payload")
    read = warc.payloads(warc.reassemble(warc.read_archive(spark, path))).drop("payload")
    found = warc.resolve(common.stored(read, "warc-records"))
    return found.select(F.col("key").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_key").alias("refers_to"))


def op2_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], "conv_id long, turn long, role string, text string")
    return chat.digests(common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(common.table(spark, sf_dir, "documents"))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(common.table(spark, sf_dir, "pages"))


def op5_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kneser_ney.judge(common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "n_symbols", "perplexity", "score", "threshold", "keep")


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(common.table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.token_digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(common.table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op9_lsa_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsa.contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(common.table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(common.table(spark, sf_dir, "documents"))


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.groups(common.table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(common.table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_warc_archive, op2_chat_examples, op3_simhash, op4_html_main_text, op5_quality_perplexity, op6_licence_scan, op7_byte_bpe, op8_jaccard_join, op9_lsa_decontamination, op10_pii, op11_line_dedup, op12_spelling_groups, op13_embedding_whitening)}

_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in licences.SENTENCES.items())


def _licence_sql() -> str:
    found = "s"
    for ids, licence in licences.RULES:
        found = f"replace({found}, '{',,'.join(ids).join((',', ','))}', ',={licence},')"
    return rf"""
        WITH known(plain, id) AS (VALUES {_VALUES}),
        cut AS (SELECT doc_id, row_number() OVER () AS r, string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\r\f]+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM documents),
        sentences AS (SELECT doc_id, r, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM cut),
        plain AS (SELECT doc_id, r, i, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS plain FROM sentences),
        ids AS (SELECT r, string_agg(coalesce(id, '-'), ',' ORDER BY i) AS s, count(id) AS n, string_agg(id, ',' ORDER BY i) AS k FROM plain LEFT JOIN known USING (plain) WHERE plain <> '' GROUP BY r),
        seq AS (SELECT doc_id, coalesce(n, 0) AS n_known, coalesce(k, '') AS sentence_ids,
                       replace(regexp_replace(',' || coalesce(s, '') || ',', '(,-)+,', ',-,', 'g'), ',', ',,') AS s FROM cut LEFT JOIN ids USING (r))
        SELECT doc_id, n_known, sentence_ids, array_to_string(regexp_extract_all({found}, '=([^,]+)', 1), ',') AS licences FROM seq
    """


def _spelling_sql() -> str:
    """Neighbours by shared patterns: words that agree with one letter masked, or with one letter left out."""
    upper, lower = spelling.UPPER, spelling.LOWER
    return rf"""
        WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
        runs AS (SELECT doc_id, run, count(*) AS m FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
        hashed AS (SELECT run, m, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * octet_length(encode(s)), 2), lambda p: ('0x' || substr(hex(encode(s)), p, 2))::BIGINT)),
                     lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)), 4294967295) AS h FROM (SELECT run, m, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM runs), crc),
        cut AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, m FROM hashed),
        v AS (SELECT word, sum(m)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(m) >= 3),
        cuts AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
        masked AS (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM cuts),
        shorter AS (SELECT DISTINCT word, n, a || b AS s FROM masked),
        pairs AS (
          SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM masked x JOIN masked y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
          UNION ALL SELECT x.word, x.n, v.word, v.n FROM shorter x JOIN v ON v.word = x.s
          UNION ALL SELECT v.word, v.n, x.word, x.n FROM shorter x JOIN v ON v.word = x.s),
        best AS (SELECT word, count(*) AS n_near, max(near_n) AS near_n FROM pairs GROUP BY word),
        tied AS (SELECT p.word, min(near COLLATE "C") AS near FROM pairs p JOIN best USING (word, near_n) GROUP BY p.word),
        f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word) LEFT JOIN tied USING (word)),
        walk AS (SELECT word, word AS place FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.place WHERE f.form IS NOT NULL),
        ends AS (SELECT walk.word, walk.place AS root FROM walk JOIN f ON f.word = walk.place WHERE f.form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
    """


ORACLES: dict[str, str] = {
    "op2_chat_examples": r"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
        ),
        f AS (SELECT *, length(role) + 1 + length(text) + len(regexp_extract_all(text, '[\[<]\\*/?(?:INST\]|s>)')) + CASE role WHEN 'assistant' THEN 7 ELSE 13 END AS chars FROM t),
        p AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars, coalesce(sum(before) FILTER (role = 'assistant'), 0)::BIGINT AS context_chars
        FROM p GROUP BY conv_id
    """,
    "op6_licence_scan": _licence_sql(),
    "op11_line_dedup": r"""
        WITH cut AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        lines AS (SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM cut),
        keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
        frequent AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.k IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN frequent f USING (k) GROUP BY r, doc_id
    """,
    "op12_spelling_groups": _spelling_sql(),
    "op1_warc_archive": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages),
             r AS (SELECT d, max(page_id) AS refers FROM p WHERE octet_length(b) >= 1000 GROUP BY d)
        SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, p.d AS payload_digest,
               CASE WHEN refers <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN refers <> page_id THEN refers END AS refers_to
        FROM p LEFT JOIN r ON r.d = p.d AND octet_length(b) >= 1000
    """,
}

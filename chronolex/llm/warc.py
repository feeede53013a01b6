"""WARC archives: writing, reading, segment reassembly and chunked-transfer decoding.

Writing is done with column expressions and Spark's text sink, whose line separator ends each record; a record that is
longer than a segment is written as its first segment and continuation records.  Reading parses whole archive files
(kept small by records_per_file) in Python.  Reassembly groups continuation records by the origin's identifier, orders
them by segment number, checks the total length that the last one states, and decodes the chunked framing.

Defined results: a null payload is an empty one; a null key is written without the key's field and read as null;
repeated rows give a record each; copies of a continuation record count once; an incomplete or over-long series gives
complete = false and a null payload, as does framing that cannot be decoded; an empty table gives an empty archive.
Other columns of the input are not written.  One reassembled payload must fit in a row, as it does in any table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
RECORDS = "record_id string, type string, key long, target_uri string, refers_to string, payload_digest string, segment int, origin_id string, total_length long, http int, block binary"


def _text(c: Column) -> Column:
    return F.regexp_replace(c, r"[\r\n]", " ")


def _binary(c: Column | str) -> Column:
    return (F.lit(c) if isinstance(c, str) else c).cast("binary")


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def chunked(payload: Column, chunk_bytes: int) -> Column:
    """The payload in chunked transfer framing: each chunk's length in hexadecimal, then the chunk, then an empty chunk."""
    n = F.ceil(F.octet_length(payload) / chunk_bytes).cast("int")
    chunk = lambda i: F.substring(payload, i * chunk_bytes + 1, F.lit(chunk_bytes))
    framed = F.transform(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(_binary(F.concat(F.lower(F.hex(F.octet_length(chunk(i)).cast("long"))), F.lit(CRLF))), chunk(i), _binary(CRLF)),
    )
    # the parts are bytes under the name of strings, which array_join leaves as they are
    return F.concat(_binary(F.array_join(F.transform(framed, lambda x: x.cast("string")), "")), _binary("0" + CRLF + CRLF))


def revisits(df: DataFrame, key: str, payload: str, min_bytes: int) -> DataFrame:
    """(key, digest, refers): for every payload of at least min_bytes, its rows but those with the largest key."""
    rows = df.select(F.col(key).alias("k"), F.sha1(F.col(payload)).alias("d"), F.octet_length(payload).alias("n")).where(F.col("n") >= min_bytes)
    first = rows.groupBy("d").agg(F.max("k").alias("refers"), F.count("*").alias("copies")).where("copies > 1 AND refers IS NOT NULL").drop("copies")
    return rows.join(first, "d").where(~F.col("k").eqNullSafe(F.col("refers"))).select("k", "d", "refers").distinct()


def write_archive(df: DataFrame, path: str, *, key: str, url: str, payload: str, date: str = "2024-01-01T00:00:00Z", revisit_min_bytes: int = 1000, chunk_bytes: int = 8192, segment_bytes: int = 32768, records_per_file: int = 2000, broadcast_rows: int = 500_000) -> None:
    """Write a record per row to gzip files under path. payload: a binary column.

    The rows that revisit another are broadcast to the join if they are counted to be at most broadcast_rows; else the
    join shuffles.
    """
    df = df.select(F.col(key).alias("k"), F.col(url).alias("u"), F.coalesce(F.col(payload), _binary("")).alias("p"))
    again = revisits(df, "k", "p", revisit_min_bytes)
    if again.limit(broadcast_rows + 1).count() <= broadcast_rows:
        again = F.broadcast(again)
    a = again.select(F.col("k").alias("ak"), F.col("d").alias("ad"), "refers")
    rows = df.withColumn("d", F.sha1("p")).join(a, F.col("k").eqNullSafe(F.col("ak")) & (F.col("d") == F.col("ad")), "left")
    ident = lambda k: F.concat(F.lit("<urn:x-page:"), F.coalesce(k.cast("string"), F.lit("")), F.lit(":"), F.col("d"), F.lit(">"))
    revisit = F.col("refers").isNotNull()
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = F.when(revisit, _binary(head)).otherwise(F.concat(_binary(head), chunked(F.col("p"), chunk_bytes)))
    rows = rows.select("k", "u", "d", "refers", block.alias("b")).withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("b") / segment_bytes).cast("int")))
    parts = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("s")).withColumn("part", F.expr(f"substring(b, (s - 1) * {segment_bytes} + 1, {segment_bytes})"))
    first, many = F.col("s") == 1, F.col("n") > 1
    lines = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", F.when(~first, F.lit("continuation")).when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", F.when(first, ident(F.col("k"))).otherwise(F.concat(F.lit("<urn:x-segment:"), F.coalesce(F.col("k").cast("string"), F.lit("")), F.lit(":"), F.col("d"), F.lit(":"), F.col("s").cast("string"), F.lit(">")))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _text(F.col("u"))),
        _line("WARC-Refers-To", F.when(first & revisit, ident(F.col("refers")))),
        _line("WARC-Profile", F.when(first & revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("d")))),
        _line("X-Row-Key", F.when(first, F.col("k"))),
        _line("WARC-Segment-Number", F.when(many, F.col("s"))),
        _line("WARC-Segment-Origin-ID", F.when(~first, ident(F.col("k")))),
        _line("WARC-Segment-Total-Length", F.when(many & (F.col("s") == F.col("n")), F.octet_length("b"))),
        _line("Content-Type", F.when(first, F.lit("application/http;msgtype=response"))),
        _line("Content-Length", F.octet_length("part")),
        F.lit(CRLF),
    )
    record = F.concat(_binary(lines), F.col("part")).cast("string")
    parts.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse(stream):
    """The records of an open archive: (header fields by lower-case name, block)."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields.get("content-length", 0)))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records under path as they stand, segments apart; gzip files, of one or more members, or plain ones."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    number = lambda x: int(x) if x and x.lstrip("-").isdigit() else None

    def run(frames):
        import gzip
        import io

        import pandas as pd

        for frame in frames:
            for content in frame["content"]:
                stream = io.BytesIO(content)
                if content[:2] == b"\x1f\x8b":
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=stream))
                rows, size = [], 0
                for f, block in parse(stream):
                    rows.append((f.get("warc-record-id"), f.get("warc-type"), number(f.get("x-row-key")), f.get("warc-target-uri"), f.get("warc-refers-to"), f.get("warc-payload-digest"), number(f.get("warc-segment-number")), f.get("warc-segment-origin-id"), number(f.get("warc-segment-total-length")), int(f.get("content-type", "").startswith("application/http")), block))
                    size += len(block)
                    if size > 8_000_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*[!_]*.*").load(path)
    return files.select("content").mapInPandas(run, RECORDS)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: first segments with their continuation records' blocks in order, and complete."""
    whole = records.where("origin_id IS NULL AND segment IS NULL").withColumn("complete", F.lit(True))
    tails = (
        records.where("origin_id IS NOT NULL")
        .groupBy("origin_id", "segment").agg(F.first("block").alias("block"), F.max("total_length").alias("total"))
        .groupBy("origin_id").agg(F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"))
        .withColumnRenamed("origin_id", "of")
    )
    heads = records.where("origin_id IS NULL AND segment IS NOT NULL").join(tails, F.col("record_id") == F.col("of"), "left")
    joined = F.concat(F.col("block"), _binary(F.array_join(F.transform("parts", lambda x: x["block"].cast("string")), "")))
    total = F.coalesce(F.col("total"), F.col("total_length"))
    ordered = F.coalesce(F.transform("parts", lambda x: x["segment"]) == F.sequence(F.lit(2), F.size("parts") + 1), F.lit(True))
    block = F.when(F.col("parts").isNull(), F.col("block")).otherwise(joined)
    heads = heads.withColumn("block", block).withColumn("complete", F.coalesce(ordered & (F.octet_length("block") == total), F.lit(False)))
    return whole.unionByName(heads.drop("of", "parts", "total"))


def dechunk(body: bytes) -> bytes | None:
    """The payload of a body in chunked framing; None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        digits = body[at:end].split(b";")[0].rstrip(b" \t") if end >= 0 else b""
        size = int(digits, 16) if 0 < len(digits) <= 16 and digits.isalnum() and not digits.strip(b"0123456789abcdefABCDEF") else -1
        if size < 0 or end + 2 + size > len(body):
            return None
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size
        if body[at : at + 2] != b"\r\n":
            return None
        at += 2


def payload_of(block: bytes, http: int) -> bytes | None:
    if not http:
        return block
    head, blank, body = block.partition(b"\r\n\r\n")
    if not blank:
        return None
    return dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def payloads(records: DataFrame) -> DataFrame:
    """Whole records with payload, payload_bytes and digest instead of the block; null where a record is incomplete."""
    kept = [f"{c} {t}" for c, t in records.dtypes if c != "block"]

    def run(frames):
        import hashlib

        for frame in frames:
            found = [payload_of(b, h) if c else None for b, h, c in zip(frame["block"], frame["http"], frame["complete"], strict=True)]
            frame = frame.drop(columns="block")
            frame["payload"] = found
            frame["payload_bytes"] = [len(x) if x is not None else None for x in found]
            frame["payload_bytes"] = frame["payload_bytes"].astype("Int64")
            frame["digest"] = [hashlib.sha1(x).hexdigest() if x is not None else None for x in found]
            yield frame

    return records.mapInPandas(run, ", ".join([*kept, "payload binary", "payload_bytes long", "digest string"]))


def resolve(records: DataFrame) -> DataFrame:
    """Records of payloads(); a revisit takes length and digest from the response it refers to, none if that is missing."""
    own = records.where("type <> 'revisit'").withColumn("refers_key", F.lit(None).cast("long"))
    there = own.select(F.col("record_id").alias("r"), F.col("key").alias("refers_key"), F.col("payload_bytes").alias("b"), F.col("digest").alias("dg")).dropDuplicates(["r"])
    again = records.where("type = 'revisit'").drop("payload_bytes", "digest").join(there, F.col("refers_to") == F.col("r"), "left")
    again = again.withColumn("payload_bytes", F.col("b")).withColumn("digest", F.when(F.concat(F.lit("sha1:"), F.col("dg")) == F.col("payload_digest"), F.col("dg"))).drop("r", "b", "dg")
    return own.unionByName(again)

"""SubRip files: parsing, rendering, reading and writing, and files of marked speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.functions.text import has_content, has_dense_letter, parse_timecode, timecode


def parse(files: DataFrame) -> DataFrame:
    """(media_id, content) -> media_id, idx (place in the file), start, end, text; blocks without text or times go."""
    text = F.regexp_replace("content", "\r\n?", "\n")
    blocks = F.split(F.regexp_replace(F.regexp_replace(text, r"^\x{FEFF}", ""), r"(?m)^[ \t]+$", ""), r"\n{2,}")
    rows = files.select("media_id", F.posexplode(blocks).alias("at", "block")).select("media_id", "at", F.split(F.regexp_replace("block", r"^\n+|\n+$", ""), "\n").alias("lines"))
    first = F.get("lines", F.lit(0)).contains("-->")
    times = F.when(first, F.get("lines", F.lit(0))).otherwise(F.get("lines", F.lit(1)))
    body = F.slice("lines", F.when(first, 2).otherwise(3), F.greatest(F.size("lines"), F.lit(1)))
    plain = F.transform(body, lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))
    plain = F.filter(plain, lambda x: x != "")
    joined = F.when(F.exists(plain, has_dense_letter), F.array_join(plain, "")).otherwise(F.array_join(plain, " "))
    ends = F.split(times, "-->")
    start, end = parse_timecode(F.get(ends, F.lit(0))), parse_timecode(F.regexp_extract(F.get(ends, F.lit(1)), r"^\s*(\S+)", 1))
    rows = rows.where(times.contains("-->")).select("media_id", "at", start.alias("start"), end.alias("end"), joined.alias("text")).where("start IS NOT NULL AND end IS NOT NULL AND text <> ''")
    idx = F.row_number().over(Window.partitionBy("media_id").orderBy("at"))
    return rows.select("media_id", idx.alias("idx"), "start", F.when(F.col("end") <= F.col("start"), F.col("start") + 0.2).otherwise(F.col("end")).alias("end"), "text")


def render(cues: DataFrame) -> DataFrame:
    """(media_id, start, end, text, idx) -> media_id, content: cues with a letter or digit, numbered by start."""
    kept = cues.where(has_content(F.col("text")))
    n = F.row_number().over(Window.partitionBy("media_id").orderBy("start", "idx"))
    one = F.concat(F.col("n").cast("string"), F.lit("\n"), timecode(F.col("start")), F.lit(" --> "), timecode(F.col("end")), F.lit("\n"), F.col("text"), F.lit("\n"))
    rows = kept.withColumn("n", n).select("media_id", "n", one.alias("c"))
    return rows.groupBy("media_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "c"))), lambda x: x["c"]), "\n").alias("content"))


def decode(content: Column) -> Column:
    """UTF-8, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def read(spark: SparkSession, path: str, glob: str = "*.srt") -> DataFrame:
    """path (as media_id), idx, start, end, text of the files under path that match glob."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return parse(files.select(F.col("path").alias("media_id"), decode(F.col("content")).alias("content")))


def write(cues: DataFrame, path: str) -> None:
    """A text file per medium, in a folder media_id=... under path."""
    render(cues).write.partitionBy("media_id").text(path)


def parse_marks(lines: DataFrame) -> DataFrame:
    """(line) -> n, start, end, who: lines such as `3 0:01:02,5 --> 0:01:04,0 [Ana, Rui]`."""
    pattern = r"^\s*(\d+)\s+([\d:,.]+)\s*-->\s*([\d:,.]+)\s*\[([^\]]*)\]"
    part = lambda i: F.regexp_extract("line", pattern, i)
    who = F.filter(F.transform(F.split(part(4), ","), lambda x: F.trim(x)), lambda x: x != "")
    return lines.where(F.col("line").rlike(pattern)).select(part(1).cast("int").alias("n"), parse_timecode(part(2)).alias("start"), parse_timecode(part(3)).alias("end"), who.alias("who"))

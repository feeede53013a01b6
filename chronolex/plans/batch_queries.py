"""Queries on batches with a contract of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.operators import batches as bt
from chronolex.plans.registry import query
from chronolex.sources import tables as t

#: Lines of a batch; letters of a batch from which a line is lost, and of a line that is refused.
LINES, LOST, REFUSED = 6, 900, 1500


def reversing(texts: list[str]) -> list[str]:
    """Texts reversed, by a function that loses a line of large batches, refuses long lines and cuts single ones in two."""
    if any(len(x) > REFUSED for x in texts):
        raise ValueError("too long")
    out = [x[::-1] for x in texts]
    if len(texts) == 1:
        return out[0].split(" ", 1)
    return out[:-1] if sum(map(len, texts)) > LOST else out


@query(f"""SELECT conv_id AS media_id, turn AS idx, CASE WHEN length(text) > {REFUSED} THEN NULL ELSE reverse(text) END AS translated, CASE WHEN length(text) > {REFUSED} THEN 'ValueError: too long' END AS error FROM conversations""")
def u12_halved(spark: SparkSession, sf: str) -> DataFrame:
    """Turns through a function that breaks its contract: every line comes back whole or with its error."""
    rows = t.pieces(spark, sf).select("media_id", F.col("piece_idx").alias("idx"), "text")
    return bt.translated(rows, reversing, size=LINES, retry=bt.Retry(1))

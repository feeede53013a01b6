"""Texts through a function of batches, as translators are: as many texts must come back as were sent.

A batch for which another number comes back, or that fails after its retries, is halved; the halves go to a table of what is
open, and round by round that table is worked off, in order, down to single lines.  A single line's parts are joined.  Every
line ends up with a text or an error, and a lost executor costs the batches of one round.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.functions.storage import stored

#: Lines that a batch holds if nothing else is asked for.
SIZE = 10

Call = Callable[[list[str]], list[str]]


@dataclass(frozen=True)
class Retry:
    """Up to `attempts` calls, with the seconds of `waits` between them (the last one again and again); errors of other kinds
    than `kinds` are not tried again."""

    attempts: int = 2
    waits: tuple[float, ...] = ()
    kinds: tuple[type[Exception], ...] = (Exception,)

    def run(self, call: Call, texts: list[str]) -> list[str]:
        for attempt in range(1, self.attempts + 1):
            try:
                return list(call(texts))
            except self.kinds:
                if attempt == self.attempts:
                    raise
                if self.waits:
                    time.sleep(self.waits[min(attempt, len(self.waits)) - 1])
        raise ValueError("a retry needs at least one attempt")


#: One more try with what failed; HTTP's busy answers, with two waits.
ONCE_MORE, BUSY = Retry(2), Retry(3, (2.0, 5.0), (OSError,))


def halves(texts: list[str], call: Call, retry: Retry) -> tuple[list[str] | None, str | None]:
    """(the results, None), (None, None) if the batch is to be halved, or (None, the error) of a single line."""
    error = None
    try:
        results = retry.run(call, texts)
        if len(results) == len(texts):
            return results, None
        if len(texts) == 1:
            return [" ".join(results).strip()], None
    except Exception as e:  # noqa: BLE001 - whatever the call raises is the line's error
        error = f"{type(e).__name__}: {e}"
    return None, error if len(texts) == 1 else None


def translated(rows: DataFrame, call: Call, *, size: int = SIZE, retry: Retry = ONCE_MORE) -> DataFrame:
    """rows (media_id, idx, text) with translated and error: one of the two is null. Blank and null texts are not sent and
    come back as ''. Batches are runs of `size` lines of a medium in the order of idx."""
    from pyspark.sql import Window

    sent = F.trim(F.coalesce("text", F.lit(""))) != ""
    place = F.row_number().over(Window.partitionBy("media_id").orderBy("idx")) - 1
    lines = rows.where(sent).select("media_id", "idx", "text", F.floor(place / size).alias("batch"))
    open_ = lines.groupBy("media_id", "batch").agg(F.sort_array(F.collect_list(F.struct("idx", "text"))).alias("lines")).select("media_id", "lines")
    schema = "media_id long, idx array<long>, results array<string>, error string, rest array<struct<idx: long, text: string>>"

    def work(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for media, some in zip(frame["media_id"], frame["lines"], strict=True):
                some = [(x["idx"], x["text"]) for x in some]
                results, error = halves([x for _, x in some], call, retry)
                if results is not None or error is not None:
                    out.append((media, [i for i, _ in some], results, error, None))
                else:
                    middle = len(some) // 2
                    out += [(media, None, None, None, [{"idx": i, "text": x} for i, x in part]) for part in (some[:middle], some[middle:])]
            yield pd.DataFrame(out, columns=["media_id", "idx", "results", "error", "rest"])

    done = None
    while True:
        round_ = stored(open_.mapInPandas(work, schema))
        ended = round_.where("rest IS NULL").select("media_id", "error", F.explode(F.arrays_zip("idx", F.coalesce("results", F.array_repeat(F.lit(None).cast("string"), F.size("idx"))).alias("results"))).alias("x"))
        ended = ended.select("media_id", F.col("x.idx").alias("idx"), F.col("x.results").alias("translated"), "error")
        done = ended if done is None else done.unionByName(ended)
        open_ = round_.where("rest IS NOT NULL").select("media_id", F.col("rest").alias("lines"))
        if open_.isEmpty():
            break
    blank = rows.where(~sent).select("media_id", "idx", F.lit("").alias("translated"), F.lit(None).cast("string").alias("error"))
    return done.unionByName(blank)

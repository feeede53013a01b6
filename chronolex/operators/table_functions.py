"""Table functions for SQL: pieces of tokens, runs and words, and the parts of cues that need too many lines.

    SELECT * FROM group_words(TABLE(SELECT media_id, k, word AS text, start, end FROM words) PARTITION BY media_id ORDER BY k)

A partition's rows go through one after the other and pieces come out as they are made, so a medium of any length needs the
memory of one piece.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from chronolex.operators import layout, pieces

TIMED = {"media_id": (LongType,), "text": (StringType,), "start": (DoubleType,), "end": (DoubleType,)}
CUES = {**TIMED, "idx": (LongType, IntegerType), "source": (StringType,), "speaker": (StringType,), "marked": (BooleanType,)}


def _checked(table: AnalyzeArgument, needed: dict, out: StructType) -> AnalyzeResult:
    """out as the result's schema, if the argument is a table that has the needed columns."""
    if not table.isTable:
        raise ValueError("the first argument must be a table: TABLE(...)")
    have = {f.name: f.dataType for f in table.dataType.fields}
    for name, kinds in needed.items():
        if not isinstance(have.get(name), kinds):
            raise ValueError(f"the table needs a column {name} of type {' or '.join(k.typeName() for k in kinds)}")
    return AnalyzeResult(schema=out)


PIECE = StructType().add("media_id", LongType()).add("idx", IntegerType()).add("text", StringType()).add("start", DoubleType()).add("end", DoubleType())
PART = StructType().add("media_id", LongType()).add("idx", LongType()).add("part", IntegerType()).add("start", DoubleType()).add("end", DoubleType()).add("text", StringType()).add("source", StringType()).add("speaker", StringType())


class _Pieces:
    """Base of the functions that group; `every` puts a boundary at each so many seconds."""

    kind: type = None

    def __init__(self):
        self.state, self.media, self.n = None, None, 0

    @staticmethod
    def analyze(table: AnalyzeArgument, every: AnalyzeArgument = None) -> AnalyzeResult:
        return _checked(table, TIMED, PIECE)

    def _out(self, made):
        for text, start, end in made:
            yield self.media, self.n, text, start, end
            self.n += 1

    def eval(self, row, every=None):
        if self.state is None:
            self.state, self.media = self.kind(**({} if every is None else {"every": float(every)})), row["media_id"]
        yield from self._out(self.state.feed(row["text"], row["start"], row["end"]))

    def terminate(self):
        if self.state is not None:
            yield from self._out(self.state.flush())


class GroupTokens(_Pieces):
    kind = pieces.TokenPieces


class GroupRuns(_Pieces):
    kind = pieces.RunPieces


class GroupWords(_Pieces):
    kind = pieces.WordPieces


class FitLines:
    """Parts of cues with at most LINES lines; overlaps are left to what comes after."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _checked(table, CUES, PART)

    def eval(self, row):
        for i, (start, end, text, source) in enumerate(layout.fit_passes(row["start"], row["end"], row["text"], row["source"], bool(row["marked"]))):
            yield row["media_id"], row["idx"], i, start, end, text, source, row["speaker"]


FUNCTIONS = {"group_tokens": GroupTokens, "group_runs": GroupRuns, "group_words": GroupWords, "fit_lines": FitLines}


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    from pyspark.sql.functions import udtf

    for name, handler in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler))

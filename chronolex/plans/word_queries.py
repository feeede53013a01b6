"""Queries on words of unspaced text. No table has a script without spaces, so texts with their spaces taken out stand for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.operators import folds as fo
from chronolex.operators import language as la
from chronolex.operators import layout
from chronolex.operators import segmentation as sg
from chronolex.plans.registry import query
from chronolex.sources import tables as t

#: Letters of a piece of a turn, as a recogniser cuts them, which splits words; width of lines.
PIECE, WIDTH = 24, 20


def _spread(df: DataFrame) -> DataFrame:
    """df, dealt anew where it has fewer partitions than there are cores: a letter takes some ten microseconds."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _documents(spark, sf):
    return _spread(t.table(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")))


def _turns(spark, sf):
    """The turns without spaces, and the lexicon of the conversations, in which language is not told."""
    turns = t.pieces(spark, sf).withColumn("text", F.coalesce("text", F.lit("")))
    lexicon = sg.trained(turns.select(F.lit("any").alias("lang"), "text"), rounds=0).get("any") or sg.Lexicon({})
    return _spread(turns.withColumn("text", sg.unspaced(F.col("text")))), spark.sparkContext.broadcast(lexicon)


def _answered(sent, each):
    """What rules of segmentation return, which all ask for the ends of phrases together."""
    return sg.answered(sg.gathered(each), lambda texts: sg.ends_of_phrases(sent.value, texts))


#: Rows whose media are folded side by side.
TOGETHER = 30_000


@query()
def t5_words(spark: SparkSession, sf: str) -> DataFrame:
    """Ends of words inside runs of letters: those of the spaced text, those found without spaces, and how many agree."""
    docs = _documents(spark, sf)
    sent = spark.sparkContext.broadcast(sg.trained(docs.select("lang", "text"), rounds=1))

    def run(frames):
        import pandas as pd

        for frame in frames:
            for lang, own in frame.groupby("lang"):
                texts, ids = own["text"].tolist(), own["doc_id"].tolist()
                for a, b in sg.slices(list(map(len, texts))):
                    true, found, right = sg.compared_many(sent.value.get(lang), texts[a:b])
                    yield pd.DataFrame({"doc_id": ids[a:b], "n_true": true, "n_found": found, "n_right": right})

    return docs.mapInPandas(run, "doc_id long, n_true long, n_found long, n_right long")


@query()
def t13_phrase_break(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of unspaced turns, cut at the ends of phrases."""
    turns, sent = _turns(spark, sf)

    def run(frames):
        import pandas as pd

        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in sg.slices(list(map(len, texts))):
                keys = zip(frame["media_id"].tolist()[a:b], frame["piece_idx"].tolist()[a:b], strict=True)
                lines = _answered(sent, [layout.wrapping(text, WIDTH, dense=True) for text in texts[a:b]])
                yield pd.DataFrame([(m, p, n, line) for (m, p), own in zip(keys, lines, strict=True) for n, line in enumerate(own)], columns=["media_id", "piece_idx", "n", "line"])

    return turns.select("media_id", "piece_idx", "text").mapInPandas(run, "media_id long, piece_idx long, n int, line string")


def _cut_turns(turns: DataFrame) -> DataFrame:
    """Pieces of PIECE letters of each turn, in even time."""
    n = F.length("text")
    starts = turns.where(n > 0).select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / PIECE) - 1, F.lit(0)).cast("int"))).alias("k"))
    pace = (F.col("end") - F.col("start")) / n
    start = F.col("start") + pace * F.col("k") * PIECE
    text = F.substring("text", F.col("k") * PIECE + 1, F.lit(PIECE))
    return starts.select("media_id", "piece_idx", "k", "speaker", text.alias("text"), start.alias("start"), (start + pace * F.length(text)).alias("end"))


@query()
def p7_mend(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of turns whose seams split words, and where the words went."""
    turns, sent = _turns(spark, sf)

    def steps(groups):
        for own in _answered(sent, [sg.mending(rows, joined=str.isalpha) for rows in groups]):
            yield [(i, c["speaker"], round(c["start"], 6), round(c["end"], 6), c["text"]) for i, c in enumerate(own)]

    return fo.fold_many(_cut_turns(turns), "media_id", ["piece_idx", "k"], "media_id long, idx int, speaker string, start double, end double, text string", steps, TOGETHER)


@query()
def m11_split_words(spark: SparkSession, sf: str) -> DataFrame:
    """Seams inside words between pieces and between their lines, before words are mended and after."""
    turns, sent = _turns(spark, sf)

    def wrapping(text):
        return layout.wrapping(text, WIDTH, dense=True)

    def both(rows):
        mended = yield from sg.mending(rows, joined=str.isalpha)
        before, after = yield from sg.gathered([sg.counting(x, wrapping, str.isalpha) for x in (rows, mended)])
        return [(*before, *after)]

    return fo.fold_many(_cut_turns(turns), "media_id", ["piece_idx", "k"], "media_id long, cues int, lines int, seams int, cues_mended int, lines_mended int, seams_mended int", lambda groups: _answered(sent, map(both, groups)), TOGETHER)


@query()
def t25_language(spark: SparkSession, sf: str) -> DataFrame:
    """The language of each document by a model of the half of the documents that it is not in, beside the given one."""
    docs = t.table(spark, sf, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    found = la.cross_detected(docs, F.pmod(F.xxhash64("text", F.lit(7)), F.lit(2)))
    return found.select("doc_id", "lang", "language", F.round("certainty", 6).alias("certainty"), F.size(sg.letter_runs(F.col("text"))).alias("n_words"))

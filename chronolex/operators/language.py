"""The language of a text, by the frequencies of its letters, pairs and triples of letters.

Words of labelled texts are counted by language first, then the n-grams of distinct words with those counts, so that what is
exploded grows with the vocabulary.  A text's score for a language is the sum of its n-grams' log probabilities.  N-grams of
one word depend on each other, so sums are too sure; they are divided by a temperature, the one at which labelled texts that
were not counted are least surprising, whole and word by word.  Below CERTAIN the answer is null, as for texts without letters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.functions.storage import stored
from chronolex.operators.segmentation import letter_runs

CERTAIN, LONGEST = 0.8, 3
#: N-grams in the model, the most frequent ones of all languages; it is sent to the tasks.
GRAMS = 50_000
#: Added to every count.
SMOOTHING = 0.5
#: Temperatures that are tried, and words of a text that are judged alone to find the best one.
TEMPERATURES = [1.0 * 1.25**k for k in range(20)]
#: One in so many labelled texts is kept for the temperature, by its hash.
HELD_OUT = 4


def grams(word: str, longest: int = LONGEST) -> list[str]:
    """The n-grams of a word with its ends marked, from single letters on."""
    w = f" {word} "
    return [w[i : i + n] for n in range(1, longest + 1) for i in range(len(w) - n + 1) if w[i : i + n] != " "]


def gram_counts(texts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, text) -> (lang, gram, n)."""
    words = texts.where("lang IS NOT NULL").select("lang", F.explode(letter_runs(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    w = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    cut = lambda size: F.transform(F.sequence(F.lit(1), F.length(w) - size + 1), lambda i: F.substring(w, i, F.lit(size)))
    all_ = words.select("lang", "n", F.explode(F.concat(*map(cut, range(1, longest + 1)))).alias("gram")).where("gram <> ' '")
    return all_.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Log probabilities of n-grams by language, and how many languages there are."""

    def __init__(self, counts: dict[str, dict[str, int]], temperature: float = 1.0):
        self.languages = sorted({lang for own in counts.values() for lang in own})
        totals = {x: sum(own.get(x, 0) for own in counts.values()) + SMOOTHING * (len(counts) + 1) for x in self.languages}
        self.known = {g: [math.log((own.get(x, 0) + SMOOTHING) / totals[x]) for x in self.languages] for g, own in counts.items()}
        self.unknown = [math.log(SMOOTHING / totals[x]) for x in self.languages]
        self.temperature = temperature
        self._words: dict[str, list[float]] = {}

    def word(self, word: str) -> list[float]:
        """The scores of one word; those of recent words are remembered."""
        if (found := self._words.get(word)) is None:
            rows = [self.known.get(g, self.unknown) for g in grams(word)]
            found = [math.fsum(x) for x in zip(*rows, strict=True)]
            if len(self._words) > 100_000:
                self._words.clear()
            self._words[word] = found
        return found

    def scores(self, words: list[str]) -> list[float]:
        rows = [self.word(w) for w in words]
        return [math.fsum(x) for x in zip(*rows, strict=True)] if rows else [0.0] * len(self.languages)

    def judge(self, words: list[str]) -> tuple[str | None, float | None]:
        """(language, certainty) of the most likely one, first in the alphabet of equals; None without words."""
        if not words or not self.languages:
            return None, None
        scores = self.scores(words)
        best = max(scores)
        return self.languages[scores.index(best)], 1.0 / math.fsum(math.exp((s - best) / self.temperature) for s in scores)


def trained(texts: DataFrame) -> Model:
    """The model of labelled texts (lang, text), with its temperature."""
    spark = texts.sparkSession
    held = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0
    counts = stored(gram_counts(texts.where(~held | F.col("text").isNull())))
    top = counts.groupBy("gram").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "gram").limit(GRAMS)
    table: dict[str, dict[str, int]] = {}
    for r in counts.join(top, "gram").select("gram", "lang", "n").toLocalIterator():
        table.setdefault(r["gram"], {})[r["lang"]] = r["n"]
    model = Model(table)
    if not model.languages:
        return model
    sent = spark.sparkContext.broadcast(model)
    steps = TEMPERATURES

    def surprise(frames):
        import pandas as pd

        total = [0.0] * len(steps)
        for frame in frames:
            for lang, words in zip(frame["lang"], frame["words"], strict=True):
                if lang not in sent.value.languages:
                    continue
                for some in [list(words), *([w] for w in words)]:
                    scores = sent.value.scores(some)
                    own = scores[sent.value.languages.index(lang)]
                    best = max(scores)
                    for k, t in enumerate(steps):
                        total[k] += (best - own) / t + math.log(math.fsum(math.exp((s - best) / t) for s in scores))
        yield pd.DataFrame({"k": range(len(steps)), "surprise": total})

    held_words = texts.where(held & F.col("lang").isNotNull()).select("lang", letter_runs(F.col("text")).alias("words"))
    sums = held_words.mapInPandas(surprise, "k int, surprise double").groupBy("k").agg(F.sum("surprise").alias("s")).collect()
    if sums and max(r["s"] for r in sums) > 0:
        model.temperature = steps[min(sums, key=lambda r: (r["s"], r["k"]))["k"]]
    return model


def detected(docs: DataFrame, model: Model, certain: float = CERTAIN) -> DataFrame:
    """docs with language (null below `certain`) and certainty (null without letters)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("language string, certainty double")
    def judged(words):
        import pandas as pd

        rows = [sent.value.judge(list(x) if x is not None else []) for x in words]
        return pd.DataFrame([(lang if p is not None and p >= certain else None, p) for lang, p in rows], columns=["language", "certainty"])

    columns = [c for c in docs.columns if c not in ("language", "certainty")]
    return docs.withColumn("__judged", judged(letter_runs(F.col("text")))).select(*columns, "__judged.language", "__judged.certainty")


def cross_detected(docs: DataFrame, part: Column, parts: int = 2) -> DataFrame:
    """docs (lang, text, ...) with language and certainty, each part (0, 1, ...) by a model that was trained on the others."""
    out = None
    for k in range(parts):
        found = detected(docs.where(part == k), trained(docs.where(part != k).select("lang", "text")))
        out = found if out is None else out.unionByName(found)
    return out

"""Quality by an interpolated modified Kneser-Ney model of character n-grams, per language.

Trusted text is what labels call good and not toxic.  Each task counts the n-grams of its trusted texts; the counts are
summed, and continuation counts, discounts, context totals and interpolated probabilities of every order come from
grouping and joining the count tables, sharded by n-gram.  A document's score is the perplexity per character of its
worst window: windows of two blocks of HALF_WINDOW symbols cover the whole text and overlap by a block, the last block
takes the rest, and a shorter text is one window, so a few bad words count the same in a short and in a long text.  It
is kept if its score is at most the language's threshold, the quantile UPPER of the trusted documents' scores.  One in
HELD_OUT of the trusted texts (by their hash, so copies stay together) is not trained on; thresholds come from those, as
a model flatters what it was trained on, or from all trusted texts of a language without any.

Scoring joins each text's n-grams with the model.  The model is a vocabulary of short character sequences, which
saturates; if it is counted to have at most MODEL_ROWS rows, it is sent to the tasks as sorted arrays and looked up
there; else the n-grams of the documents are shuffled to the shards of the model (score_joined).  Both read the same
single-precision numbers and add them in double precision.

Symbols: runs of white space are one space, digits are 0; each language has the SYMBOLS most frequent characters of its
trusted text as symbols of their own, and one for all others.  Defined results: a null or blank text has a null
perplexity and is not kept; a null language is `und`; a language without trusted text has no model, so its documents
have a null perplexity and threshold and are kept; repeated rows are scored each for itself; without any trusted text
every document is kept but the blank ones; an empty table gives no rows; a column of the input that has the name of one
that is added is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.llm.common import broadcast_checked, returning, semi_join_checked, stored

ORDER = 5
BITS = 12
START = 4095
#: Symbols from 1 on are a language's characters, 0 is any other.
SYMBOLS = 4094
#: Rows of the model that are sent to the tasks: 16 bytes each.
MODEL_ROWS = 8_000_000
#: Symbols of one language that are counted or scored together: n-grams that many texts share are looked up once.
RUN_SYMBOLS = 500_000
#: N-grams that a task holds while it counts.
TASK_GRAMS = 2_000_000
#: Labelled ids that are broadcast: 16 bytes each.
LABEL_ROWS = 2_000_000
#: The threshold is this quantile of the held-out trusted documents' scores.
UPPER = 0.95
HALF_WINDOW = 16
#: Discounts are no less, so that every context keeps some weight back for what was not seen after it.
LEAST_DISCOUNT = 0.05
#: Languages whose thresholds are broadcast; more are joined by shuffle.
LANGUAGES = 10_000
HELD_OUT = 4


def code_points(text: str):
    """The text's code points, with single spaces and 0 for digits."""
    import re

    text = re.sub("[0-9]", "0", " ".join(text.split()))
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def symbols(text: str, alphabet):
    """The text's symbols, as unsigned 64-bit integers; alphabet: sorted code points."""
    codes = code_points(text)
    at = np.minimum(np.searchsorted(alphabet, codes), len(alphabet) - 1)
    return np.where(alphabet[at] == codes, at + 1, 0).astype(np.uint64)


def alphabets(texts: DataFrame, *, size: int = SYMBOLS) -> dict:
    """{language: its `size` most frequent code points, sorted}, from (lang, text); 16 KB a language at most."""

    @returning
    def run(frames):
        counts: dict = {}
        for frame in frames:
            for lang, part in frame.groupby("lang"):
                mine = counts.setdefault(lang, {})
                for some in runs_of(part["text"]):
                    codes, n = np.unique(np.concatenate([code_points(x) for x in some]), return_counts=True)
                    for c, k in zip(codes.tolist(), n.tolist(), strict=True):
                        mine[c] = mine.get(c, 0) + k
        for lang, mine in counts.items():
            yield pd.DataFrame({"lang": lang, "code": list(mine), "n": list(mine.values())})

    counted = texts.mapInPandas(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= size)
    rows = ranked.groupBy("lang").agg(F.sort_array(F.collect_list("code")).alias("codes")).collect()
    return {r["lang"]: np.array(r["codes"], np.uint32) for r in rows}


def grams(syms, order: int = ORDER):
    """For each symbol the packed n-gram that ends with it; START stands before the text."""
    padded = np.concatenate([np.full(order - 1, START, np.uint64), syms])
    out = np.zeros(len(syms), np.uint64)
    for i in range(order):
        out = out << np.uint64(BITS) | padded[i : i + len(syms)]
    return out.astype(np.int64)


def blocks(n: int):
    """The block of each of n symbols: HALF_WINDOW symbols each, and the last one up to twice as many."""
    return np.minimum(np.arange(n) // HALF_WINDOW, max(n // HALF_WINDOW - 1, 0))


def worst_window(logp) -> float:
    """The perplexity of the worst window of a text, from the log probabilities of its symbols."""
    at = blocks(len(logp))
    sums, sizes = np.bincount(at, logp), np.bincount(at)
    if len(sums) > 1:
        sums, sizes = sums[1:] + sums[:-1], sizes[1:] + sizes[:-1]
    return float(np.exp(-np.min(sums / sizes)))


def language(c: str = "lang") -> Column:
    return F.coalesce(F.col(c), F.lit("und"))


def runs_of(texts) -> Iterator[list[str]]:
    """texts in runs of RUN_SYMBOLS characters; a longer text is a run of its own."""
    run, size = [], 0
    for x in texts:
        if run and size + len(x) > RUN_SYMBOLS:
            yield run
            run, size = [], 0
        run.append(x)
        size += len(x)
    if run:
        yield run


def summed(parts: list):
    """One (grams, counts) of several."""
    g, inverse = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    return g, np.bincount(inverse, np.concatenate([c for _, c in parts]), len(g)).astype(np.int64)


def count_grams(texts: DataFrame, known: dict) -> DataFrame:
    """(lang, text) -> (lang, gram, c), counted within tasks first. known: alphabets()."""

    @returning
    def run(frames):
        held: dict = {}  # lists of (grams, counts) by language, which are merged when they are long
        none = np.zeros(1, np.uint32)

        def table():
            for lang, parts in held.items():
                g, c = summed(parts)
                yield pd.DataFrame({"lang": lang, "gram": g, "c": c})
            held.clear()

        size = 0
        for frame in frames:
            for lang, part in frame.groupby("lang"):
                for some in runs_of(part["text"]):
                    g, c = np.unique(np.concatenate([grams(symbols(x, known.get(lang, none))) for x in some]), return_counts=True)
                    held.setdefault(lang, []).append((g, c))
                    size += len(g)
                    if size > TASK_GRAMS:
                        for key in held:
                            held[key] = [summed(held[key])]
                        if (size := sum(len(x[0][0]) for x in held.values())) > TASK_GRAMS // 2:
                            yield from table()
                            size = 0
        yield from table()

    counted = texts.mapInPandas(run, "lang string, gram long, c long")
    return counted.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _cut(c: Column | str, order: int) -> Column:
    """The last `order` symbols of a packed n-gram."""
    return F.col(c).bitwiseAND(F.lit((1 << (BITS * order)) - 1)) if isinstance(c, str) else c.bitwiseAND(F.lit((1 << (BITS * order)) - 1))


def train(texts: DataFrame, known: dict) -> DataFrame:
    """The model of (lang, text): lang, n (order), gram, logp, bow (log weight of the next order after it, or null), in
    single precision. known: alphabets()."""
    tables = {ORDER: stored(count_grams(texts, known), "grams")}
    for n in range(ORDER - 1, 0, -1):
        # how many different symbols stand before it; n-grams that begin with START have no such count beyond one
        tables[n] = stored(tables[n + 1].select("lang", _cut("gram", n).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("c")), "grams")
    below, model, bows = None, None, None
    for n in range(1, ORDER + 1):
        rows = tables[n]
        n1, n2, n3, n4 = (F.sum((F.col("c") == k).cast("double")) for k in range(1, 5))
        or_else = lambda c, d, most: F.coalesce(F.when(c.isNotNull(), F.greatest(F.lit(LEAST_DISCOUNT), F.least(c, F.lit(most)))), F.lit(d))
        zero = lambda c: F.when(c > 0, c)
        y = zero(n1) / zero(n1 + 2 * n2)
        discounts = rows.groupBy("lang").agg(
            or_else(1 - 2 * y * n2 / zero(n1), 0.5, 1.0).alias("d1"), or_else(2 - 3 * y * n3 / zero(n2), 1.0, 2.0).alias("d2"), or_else(3 - 4 * y * n4 / zero(n3), 1.5, 3.0).alias("d3"), F.count("*").alias("types")
        )
        rows = rows.join(discounts, "lang").withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        context = F.shiftrightunsigned("gram", BITS)
        totals = rows.groupBy("lang", context.alias("context")).agg(F.sum("c").alias("total"), F.sum(F.least(F.col("d"), F.col("c"))).alias("kept_back"))
        rows = rows.withColumn("context", context).join(totals, ["lang", "context"])
        if below is None:
            lower = 1.0 / (F.col("types") + 1)
        else:
            rows = rows.withColumn("suffix", _cut("gram", n - 1)).join(below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower")), ["lang", "suffix"])
            lower = F.col("lower")
        p = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("kept_back") / F.col("total") * lower
        below = stored(rows.select("lang", F.lit(n).alias("n"), "gram", p.alias("p")), "model")
        bow = stored(totals.select("lang", F.lit(n - 1).alias("n"), F.col("context").alias("gram"), F.log(F.col("kept_back") / F.col("total")).alias("bow")), "bows")
        bows = bow if bows is None else bows.unionByName(bow)
        model = below if model is None else model.unionByName(below)
    empty = bows.where("n = 0").select("lang", "n", "gram", F.lit(None).cast("double").alias("logp"), "bow")
    sizes = tables[1].groupBy("lang").agg(F.count("*").alias("types"))
    # order 0 is uniform over the symbols and one for all others
    empty = empty.join(sizes, "lang").select("lang", "n", "gram", (-F.log(F.col("types") + 1.0)).alias("logp"), "bow")
    rest = model.select("lang", "n", "gram", F.log("p").alias("logp")).join(bows.where("n > 0"), ["lang", "n", "gram"], "full").select("lang", "n", "gram", "logp", "bow")
    return stored(empty.unionByName(rest).select("lang", "n", "gram", F.col("logp").cast("float").alias("logp"), F.col("bow").cast("float").alias("bow")), "model")


def packed(model: DataFrame, *, shards: int = 16) -> dict:
    """The model as {lang: {order: [(grams, logp, bow) as bytes]}}: tasks pack it by hashed shards, of which the driver gets one after the other."""
    shard = F.when(F.col("n") >= 3, F.pmod(F.xxhash64("gram"), F.lit(shards))).otherwise(0).cast("int")

    def pack(frame):
        frame = frame.sort_values("gram")
        columns = (frame["gram"].to_numpy(np.int64), frame["logp"].to_numpy(np.float32), frame["bow"].fillna(0.0).to_numpy(np.float32))
        return pd.DataFrame([(frame["lang"].iloc[0], int(frame["n"].iloc[0]), *(x.tobytes() for x in columns))], columns=["lang", "n", "g", "p", "b"])

    rows = model.withColumn("shard", shard).groupBy("lang", "n", "shard").applyInPandas(pack, "lang string, n int, g binary, p binary, b binary")
    out: dict = {}
    for lang, n, *parts in stored(rows, "packed").toLocalIterator():
        out.setdefault(lang, {}).setdefault(n, []).append(tuple(map(bytes, parts)))
    return out


class Tables:
    """The model of one language as sorted arrays."""

    def __init__(self, orders: dict):
        self.orders = {}
        while orders:
            n, parts = orders.popitem()
            g, p, b = (np.concatenate([np.frombuffer(x[i], kind) for x in parts]) for i, kind in enumerate((np.int64, np.float32, np.float32)))
            at = np.argsort(g)
            self.orders[n] = (g[at], p[at], b[at])

    @classmethod
    def of(cls, sent: dict, lang: str) -> Tables | None:
        """The tables of a broadcast packed(), made once in each worker in place of what was sent, so that they go when Spark
        lets the broadcast go."""
        if isinstance(sent.get(lang), dict):
            sent[lang] = cls(sent[lang])
        return sent.get(lang)

    def _find(self, n: int, g):
        keys = self.orders[n][0] if n in self.orders else np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(keys, g), max(len(keys) - 1, 0))
        return at, (keys[at] == g if len(keys) else np.zeros(len(g), bool))

    def logp(self, g, n: int = ORDER):
        """Log probabilities of packed n-grams, best in ascending order."""
        g = g & ((1 << (BITS * n)) - 1)
        at, there = self._find(n, g)
        out = np.where(there, self.orders[n][1][at] if n in self.orders else 0.0, np.nan).astype(np.float64)
        rest = np.flatnonzero(np.isnan(out))
        if len(rest) and n:
            cat, cthere = self._find(n - 1, g[rest] >> BITS)
            out[rest] = self.logp(g[rest], n - 1) + np.where(cthere, self.orders[n - 1][2][cat], 0.0)
        return out


def sent_model(model: DataFrame, known: dict, model_rows: int = MODEL_ROWS):
    """The packed model and alphabets as a broadcast; None if the model is counted to have more than model_rows rows."""
    if model.limit(model_rows + 1).count() > model_rows:
        return None
    return model.sparkSession.sparkContext.broadcast((packed(model), known))


def score(docs: DataFrame, model: DataFrame, known: dict, *, model_rows: int = MODEL_ROWS, sent=None) -> DataFrame:
    """docs, which must have lang and text, with n_symbols, perplexity and worst, the worst window's perplexity.

    Only language and text go to Python and only numbers come back; the rows wait in Spark. sent: sent_model(), if there
    is one already.
    """
    docs = docs.drop("n_symbols", "perplexity", "worst")
    if sent is None and (sent := sent_model(model, known, model_rows)) is None:
        return score_joined(docs, model, known)

    def perplexities(tables, texts):
        """(whole text, worst window) of texts, which have symbols."""
        g, inverse = np.unique(np.concatenate([grams(x) for x in texts]), return_inverse=True)
        each = tables.logp(g)[inverse]
        parts = np.split(each, np.cumsum([len(x) for x in texts])[:-1])
        return [(np.exp(-x.mean()), worst_window(x)) for x in parts]

    @F.pandas_udf("n_symbols long, perplexity double, worst double")
    @returning
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        models, known = sent.value
        none = np.zeros(1, np.uint32)
        for langs, texts in batches:
            sizes, values = np.zeros(len(langs), np.int64), np.full((len(langs), 2), np.nan)
            waiting: dict = {}

            def flush(lang, values=values, waiting=waiting):
                places, some = zip(*waiting.pop(lang), strict=True)
                values[list(places)] = perplexities(Tables.of(models, lang), some)

            for i, (lang, text) in enumerate(zip(langs, texts, strict=True)):
                syms = symbols(text or "", known.get(lang, none))
                sizes[i] = len(syms)
                if len(syms) and lang in models:
                    waiting.setdefault(lang, []).append((i, syms))
                    if sum(len(x) for _, x in waiting[lang]) > RUN_SYMBOLS:
                        flush(lang)
            for lang in list(waiting):
                flush(lang)
            yield pd.DataFrame({"n_symbols": sizes, "perplexity": values[:, 0], "worst": values[:, 1]})

    rows = docs.withColumn("__scored", scored(language(), "text"))
    return rows.select(*docs.columns, "__scored.n_symbols", "__scored.perplexity", "__scored.worst")


def score_joined(docs: DataFrame, model: DataFrame, known: dict) -> DataFrame:
    """score() for a model of any size: the documents' n-grams, counted per block, are joined with its shards."""

    @returning
    def run(frames):
        none = np.zeros(1, np.uint32)
        for frame in frames:
            for row, lang, text in zip(frame["row"], frame["lang"], frame["text"], strict=True):
                g = grams(symbols(text or "", known.get(lang, none)))
                counted = pd.DataFrame({"block": blocks(len(g)), "gram": g}).groupby(["block", "gram"], as_index=False).size().rename(columns={"size": "c"})
                counted.insert(0, "row", row)
                counted.insert(1, "lang", lang)
                yield counted

    docs = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    own = language()
    rows = docs.select(F.col("__row").alias("row"), own.alias("lang"), "text").mapInPandas(run, "row long, lang string, block long, gram long, c long")
    value = None
    for n in range(ORDER + 1):
        part = model.where(F.col("n") == n)
        rows = rows.withColumn("k", _cut("gram", n)).join(part.select("lang", F.col("gram").alias("k"), F.col("logp").cast("double").alias(f"l{n}")), ["lang", "k"], "left")
        if n:
            context = model.where(F.col("n") == n - 1).select("lang", F.col("gram").alias("k"), F.col("bow").cast("double").alias(f"b{n}"))
            rows = rows.withColumn("k", F.shiftrightunsigned(_cut("gram", n), BITS)).join(context, ["lang", "k"], "left")
        value = F.col("l0") if value is None else F.coalesce(F.col(f"l{n}"), F.coalesce(F.col(f"b{n}"), F.lit(0.0)) + value)
    sums = stored(rows.groupBy("row", "block").agg(F.sum("c").alias("c"), F.sum(F.col("c") * value).alias("s")), "blocks")
    whole = sums.groupBy("row").agg(F.sum("c").alias("n_symbols"), F.exp(-F.sum("s") / F.sum("c")).alias("perplexity"), F.max("block").alias("last"))
    # window i is blocks i - 1 and i; those that only the first or the last block would fill are none
    windows = sums.withColumn("window", F.explode(F.array(F.col("block"), F.col("block") + 1))).groupBy("row", "window").agg((-F.sum("s") / F.sum("c")).alias("mean"))
    windows = windows.join(whole.select("row", "last"), "row").where((F.col("last") == 0) | F.col("window").between(F.lit(1), F.col("last")))
    sums = whole.drop("last").join(windows.groupBy("row").agg(F.exp(F.max("mean")).alias("worst")), "row")
    return docs.join(sums.withColumnRenamed("row", "__row"), "__row", "left").drop("__row").withColumn("n_symbols", F.coalesce("n_symbols", F.lit(0)))


def judge(docs: DataFrame, labels: DataFrame, *, upper: float = UPPER) -> DataFrame:
    """docs (doc_id, text, lang, ...) with n_symbols, perplexity, score, threshold and keep.

    The thresholds come first, from the held-out trusted texts alone, so the documents are read once more and judged
    where they are: no text is shuffled or stored.  There is one threshold per language; up to LANGUAGES of them are
    broadcast.
    """
    docs = docs.drop("n_symbols", "perplexity", "score", "threshold", "keep")
    good = labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    texts = docs.select("doc_id", language().alias("lang"), "text").where("text IS NOT NULL")
    trusted = semi_join_checked(texts, good, "doc_id", LABEL_ROWS).withColumn("held", F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0)
    own = trusted.where("NOT held").select("lang", "text")
    known = alphabets(own)
    model = train(own, known)
    sent = sent_model(model, known)
    quantile = lambda rows: score(rows, model, known, sent=sent).where("worst IS NOT NULL").groupBy("lang").agg(F.percentile_approx("worst", F.lit(upper), F.lit(10000)).alias("threshold"))
    limits = stored(quantile(trusted.where("held").select("lang", "text")), "limits")
    rest = own.join(broadcast_checked(limits.select("lang"), LANGUAGES), "lang", "left_anti")
    limits = stored(limits.unionByName(quantile(rest)), "limits") if not rest.isEmpty() else limits
    limits = broadcast_checked(limits.select(F.col("lang").alias("__limit_of"), "threshold"), LANGUAGES)
    out = score(docs, model, known, sent=sent).join(limits, language() == F.col("__limit_of"), "left").drop("__limit_of").withColumnRenamed("worst", "score")
    return out.withColumn("keep", F.when(F.col("n_symbols") == 0, F.lit(False)).otherwise(F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True))))

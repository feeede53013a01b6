"""Benchmark decontamination by latent semantic retrieval.

Words are lower-case runs of letters and digits, kept as 32-bit hashes, whose low bits are one of FEATURES features.  A
document is cut into words once, by sums over its letters; its hashes are stored, and all later passes read those.
Document frequencies of the features are counted over all documents.  The benchmark's passages are rows of a TF-IDF
matrix, of which a randomised SVD with power iterations gives the leading right singular vectors: each task multiplies
its rows, the partial products are summed by blocks of features in Spark, and the driver holds one matrix with a row per
feature that a passage has, FEATURES at most, and a column per singular vector, whatever the documents.  RANK of those
are taken, or one for every PER_VECTOR passages up to MOST_RANK if there are many.  Windows of WINDOW words from every
document, STEP words (half a window) apart, are folded into that space as the sums of their halves; those with a cosine
of at least COSINE to a passage are candidates.  A candidate is verified on the words around it: the longest common
subsequence with the passage must cover COPY of it (kind `copy`), or PARAPHRASE of it if the passage's answer is there as
well (kind `paraphrase`).  The answer is the item's column `answer` if there is one, else its last ANSWER_WORDS words.

Features in more than COMMON of the documents weigh nothing, unless a passage would keep fewer than MIN_TERMS terms.
The passages are the stated query set: they go to the tasks in blocks of ITEM_BLOCK, one pass over the documents each.

Defined results: null or empty texts and items without words match nothing; rows with a null doc_id are searched and
reported under null; repeated rows give one row; an empty table on either side gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.llm.common import ID_ROWS, returning, semi_join_checked, stored

FEATURES, RANK, MOST_RANK, PER_VECTOR, POWER = 1 << 16, 96, 256, 16, 2
WINDOW, STEP = 64, 32  # a window is two steps
COSINE, COPY, PARAPHRASE = 0.5, 0.8, 0.6
COMMON, MIN_TERMS, ANSWER_WORDS = 0.1, 5, 4
ITEM_BLOCK = 20_000
ROW_BLOCK = 1024
SEED = 5
#: letters that are hashed at a time, base of the words' polynomials; words and cosines that are folded at a time
SLICE, BASE = 1 << 14, 0x9E3779B97F4A7C15
GROUP_WORDS, GROUP_COSINES = 1 << 16, 1 << 22

_words = re.compile(r"[^\W_]+").findall


def words_of(text: str | None) -> list[str]:
    return _words(text.lower()) if text else []


def _mixed(x):
    """x, 64-bit numbers, with every bit of each depending on all of it; different numbers stay different."""
    import numpy as np

    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> np.uint64(33)) * np.uint64(by)
    return x ^ x >> np.uint64(33)


@functools.cache
def _letters():
    """For each code point a number, which is 0 if words do not have it."""
    import numpy as np

    n = sys.maxunicode + 1
    letter = np.fromiter(map(str.isalnum, map(chr, range(n))), bool, n)
    return np.where(letter, _mixed(np.arange(1, n + 1, dtype=np.uint64)), np.uint64(0))


@functools.lru_cache(maxsize=1)
def _powers(n: int):
    """The first n powers of BASE and of its inverse, modulo 2 ** 64."""
    import numpy as np

    out = np.full((2, n), [[BASE], [pow(BASE, -1, 1 << 64)]], np.uint64)
    out[:, :1] = 1
    return np.cumprod(out, axis=1, dtype=np.uint64)


def hashes(text: str | None):
    """The hashes of words_of(text), in their order: the polynomial of each word's letters, mixed. The words of a slice
    are taken from one running sum; one that goes on in the next slice is carried there."""
    import numpy as np

    text, out, so_far = (text or "").lower(), [np.zeros(0, np.uint64)], 0
    powers, inverse = _powers(SLICE)
    for at in range(0, len(text), SLICE):
        letters = _letters()[np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        n = len(letters)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = letters != 0
        ends = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = ends[::2], ends[1::2]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(letters * powers[:n], out=sums[1:])
        found = (sums[end] - sums[begin]) * inverse[begin]
        if so_far and inside[1]:
            out[-1][-1:] += found[:1] * np.uint64(pow(BASE, so_far, 1 << 64))
            found = found[1:]
        if len(found):
            out.append(found)
        last = int(end[-1] - begin[-1]) if inside[n] else 0
        so_far = so_far + n if last == n else last
    return _mixed(np.concatenate(out)).astype(np.uint32)


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, words): the hashes of each text's words, 4 bytes each. Rows without words are left out."""

    @returning
    def run(frames):
        import pandas as pd

        for frame in frames:
            out = [hashes(x).tobytes() for x in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "words": out})

    rows = docs.select("doc_id", "text").where("text IS NOT NULL").mapInPandas(run, "doc_id long, words binary")
    return stored(rows.where("octet_length(words) > 0"), "words")


def document_frequencies(docs: DataFrame):
    """(number of documents, documents per feature) over all of hashed(); each task sends one array of FEATURES counts."""
    import numpy as np

    @returning
    def run(frames):
        import pandas as pd

        counts, last, n = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64), 0
        for frame in frames:
            for words in frame["words"]:
                n += 1
                found = np.frombuffer(words, np.uint32) % FEATURES
                last[found] = at = np.arange(len(found))
                counts[found[last[found] == at]] += 1  # one place of each
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"feature": np.append(at, -1), "n": np.append(counts[at], n)})

    rows = docs.select("words").mapInPandas(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(FEATURES, np.int64)
    own = rows["feature"] >= 0
    out[rows["feature"][own]] = rows["n"][own]
    return int(rows["n"][~own].sum()), out


def passages(items: DataFrame) -> DataFrame:
    """(item_id, words, answer), as hashes, of passages: an item's words, cut into windows if there are more than WINDOW."""
    answer = F.col("answer").cast("string") if "answer" in items.columns else F.lit(None).cast("string")

    @returning
    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for item, text, answer in zip(frame["item_id"], frame["text"], frame["own"], strict=True):
                words = hashes(text)
                last = hashes(answer) if isinstance(answer, str) else words[-ANSWER_WORDS:]
                rows += [(item, words[i : i + WINDOW].tobytes(), last.tobytes()) for i in range(0, max(1, len(words) - STEP), STEP) if len(words)]
            yield pd.DataFrame(rows, columns=["item_id", "words", "answer"]).astype({"item_id": "Int64"})

    cut = items.select("item_id", "text", answer.alias("own")).where("text IS NOT NULL").mapInPandas(run, "item_id long, words binary, answer binary")
    return stored(cut.dropDuplicates(["item_id", "words"]), "passages")


def _tf_idf(words: bytes, weight):
    """(features, values) of a passage, of length 1."""
    import numpy as np

    at, tf = np.unique(np.frombuffer(words, np.uint32) % FEATURES, return_counts=True)
    value = tf * weight[at]
    at, value = at[value > 0], value[value > 0]
    return at, value / max(np.sqrt((value**2).sum()), 1e-12)


def weights(cut: DataFrame, n: int, df):
    """The weight of each feature; see the module."""
    import numpy as np

    idf = np.log((1 + n) / (1 + df)) + 1
    weight = np.where(df > COMMON * n, 0.0, idf)

    def needed(frames):
        import pandas as pd

        found: set[int] = set()
        for frame in frames:
            for words in frame["words"]:
                f = np.unique(np.frombuffer(words, np.uint32) % FEATURES)
                if (weight[f] > 0).sum() < MIN_TERMS:
                    found.update(f.tolist())
        yield pd.DataFrame({"feature": np.array(sorted(found), np.int64)})

    more = [r[0] for r in cut.select("words").mapInPandas(needed, "feature long").distinct().collect()]
    weight[more] = idf[more]
    return weight.astype(np.float32)


def used_features(cut: DataFrame, weight):
    """The features that passages have and that weigh something, in order; FEATURES at most."""
    import numpy as np

    @returning
    def run(frames):
        import pandas as pd

        found = np.zeros(FEATURES, bool)
        for frame in frames:
            for words in frame["words"]:
                found[np.frombuffer(words, np.uint32) % FEATURES] = True
        yield pd.DataFrame({"feature": np.flatnonzero(found & (weight > 0))})

    rows = cut.select("words").mapInPandas(run, "feature long").distinct().toPandas()
    return np.sort(rows["feature"].to_numpy(np.int64))


def _product(cut: DataFrame, weight, used, basis):
    """A' A basis, where A has the passages' rows and a column for each used feature: summed in tasks, then by blocks."""
    import numpy as np

    sent = cut.sparkSession.sparkContext.broadcast((weight, used, basis))
    size, rank = basis.shape

    @returning
    def run(frames):
        import pandas as pd

        weight, used, basis = sent.value
        out = np.zeros((-(-size // ROW_BLOCK) * ROW_BLOCK, rank), np.float32)
        for frame in frames:
            for words in frame["words"]:
                at, value = _tf_idf(words, weight)
                at = np.searchsorted(used, at)
                out[at] += np.outer(value, value @ basis[at])
        blocks = out.reshape(-1, ROW_BLOCK, rank)
        full = [i for i in range(len(blocks)) if blocks[i].any()]
        yield pd.DataFrame({"block": full, "part": [blocks[i].tobytes() for i in full]})

    def add(frame):
        import pandas as pd

        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in frame["part"])
        return pd.DataFrame({"block": frame["block"].iloc[:1], "part": [total.astype(np.float32).tobytes()]})

    summed = cut.select("words").mapInPandas(run, "block int, part binary").groupBy("block").applyInPandas(add, "block int, part binary")
    out = np.zeros((-(-size // ROW_BLOCK), ROW_BLOCK, rank), np.float32)
    for block, part in summed.toLocalIterator():
        out[block] = np.frombuffer(part, np.float32).reshape(ROW_BLOCK, rank)
    sent.destroy()
    return out.reshape(-1, rank)[:size]


def right_vectors(cut: DataFrame, weight, used, *, rank: int = RANK, power: int = POWER):
    """An orthonormal basis, a row per used feature, of the passages' leading right singular vectors."""
    import numpy as np

    basis = np.random.default_rng(SEED).standard_normal((len(used), min(rank, len(used))), np.float32)
    for _ in range(power + 1):
        basis = np.linalg.qr(_product(cut, weight, used, basis))[0].astype(np.float32)
    small = basis.T @ _product(cut, weight, used, basis)  # of the Gram matrix
    return (basis @ np.linalg.eigh((small + small.T) / 2)[1][:, ::-1]).astype(np.float32)


def common_subsequence(masks: dict[int, int], n: int, words: list[int]) -> int:
    """The length of the longest common subsequence; masks has the places of each word of a passage of n words."""
    v = full = (1 << n) - 1
    for w in words:
        if m := masks.get(w):
            u = v & m
            v = (v + u | v - u) & full
    return n - v.bit_count()


class Passage:
    def __init__(self, item, words: list[int], answer: list[int]):
        self.item, self.words, self.answer = item, words, answer
        self.masks: dict[int, int] = {}
        for i, w in enumerate(self.words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i
        self.distinct = frozenset(self.masks)
        #: so many of the distinct words are in any stretch that covers enough of the passage
        self.least = len(self.masks) - (1 - PARAPHRASE) * len(words)

    def verify(self, words: list[int]) -> tuple[float, str | None]:
        """(share of the passage in the best stretch of words, kind or None)."""
        n = len(self.words)
        share = common_subsequence(self.masks, n, words) / n
        if share < PARAPHRASE:
            return share, None
        span, best = n + n // 2 + 2, 0
        for i in range(0, max(1, len(words) - span + 1 + n // 4), max(1, n // 4)):
            best = max(best, common_subsequence(self.masks, n, words[i : i + span]))
        share = best / n
        k = len(self.answer)
        there = k and any(words[i : i + k] == self.answer for i in range(len(words) - k + 1))
        return share, "copy" if share >= COPY else "paraphrase" if share >= PARAPHRASE and there else None


def _groups(frame, size: int):
    """Lists of (doc_id, words, start), which stand for the windows that begin in the size words from start on; a list has
    about size words, whatever the documents' lengths."""
    import numpy as np

    group, n = [], 0
    for doc, raw in zip(frame["doc_id"], frame["words"], strict=True):
        words = np.frombuffer(raw, np.uint32)
        for start in range(0, max(1, len(words) - STEP), size):
            group.append((doc, words, start))
            n += min(size, len(words) - start)
            if n >= size:
                yield group
                group, n = [], 0
    if group:
        yield group


def _folded(group: list, size: int, place, scaled):
    """(windows' vectors, of length 1 or 0; part of the group and first word of each): a window is two steps of words."""
    import numpy as np

    parts = [words[start : start + size + STEP] for _, words, start in group]
    lengths = np.array([len(x) for x in parts])
    steps = np.maximum(2, -(-lengths // STEP))
    first, begin = np.cumsum(steps) - steps, np.cumsum(lengths) - lengths
    places = place[np.concatenate(parts) % FEATURES]
    at = np.flatnonzero(places >= 0)
    part = np.repeat(np.arange(len(parts)), lengths)[at]
    step = first[part] + (at - begin[part]) // STEP
    new = np.flatnonzero(np.diff(step, prepend=-1))
    sums = np.zeros((steps.sum(), scaled.shape[1]), np.float32)
    if len(new):
        sums[step[new]] = np.add.reduceat(scaled[places[at]], new, axis=0)
    window = np.delete(np.arange(len(sums)), first + steps - 1)
    folded = sums[window] + sums[window + 1]
    folded /= np.maximum(np.linalg.norm(folded, axis=1, keepdims=True), 1e-12)
    part = np.repeat(np.arange(len(parts)), steps - 1)
    return folded, part, np.array([start for _, _, start in group])[part] + (window - first[part]) * STEP


def _search(docs: DataFrame, block: list, weight, used, basis) -> DataFrame:
    """(doc_id, item_id, cosine, overlap, kind) for one block of passages."""
    import numpy as np

    sent = docs.sparkSession.sparkContext.broadcast(([(r["item_id"], bytes(r["words"]), bytes(r["answer"])) for r in block], weight, used, basis))

    @returning
    def run(frames):
        import pandas as pd

        rows, weight, used, basis = sent.value
        ints = lambda x: np.frombuffer(x, np.uint32).tolist()
        found = [Passage(item, ints(words), ints(answer)) for item, words, answer in rows]
        vectors = np.zeros((len(found), basis.shape[1]), np.float32)
        for i, (_, words, _) in enumerate(rows):
            at, value = _tf_idf(words, weight)
            vectors[i] = value @ basis[np.searchsorted(used, at)]
        vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)).T.copy()
        scaled = weight[used, None] * basis
        place = np.full(FEATURES, -1, np.int64)
        place[used] = np.where(np.abs(basis).sum(axis=1) > 1e-9, np.arange(len(used)), -1)
        size = min(GROUP_WORDS, max(1, GROUP_COSINES // max(1, len(found))) * STEP)
        for frame in frames:
            out = []
            for group in _groups(frame, size):
                folded, part, starts = _folded(group, size, place, scaled)
                cosines = folded @ vectors
                before = -1
                for i, j in zip(*(x.tolist() for x in np.nonzero(cosines >= COSINE)), strict=True):
                    p = found[j]
                    if i != before:
                        before, s, (doc, words, _) = i, int(starts[i]), group[part[i]]
                        near = frozenset(words[max(0, s - WINDOW) : s + 2 * WINDOW].tolist())
                    if len(p.distinct & near) < p.least:
                        continue
                    share, kind = p.verify(words[max(0, s - len(p.words)) : s + WINDOW + len(p.words)].tolist())
                    if kind:
                        out.append((doc, p.item, float(cosines[i, j]), share, kind))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "cosine", "overlap", "kind"]).astype({"doc_id": "Int64", "item_id": "Int64", "kind": "object"})

    return docs.mapInPandas(run, "doc_id long, item_id long, cosine double, overlap double, kind string")


def contaminated(docs: DataFrame, items: DataFrame, *, item_block: int = ITEM_BLOCK) -> DataFrame:
    """(doc_id, item_id, cosine, overlap, kind): every benchmark item that a document holds, with its best place."""
    cut = passages(items)
    cut = stored(cut.withColumn("nr", F.monotonically_increasing_id()), "passages")
    docs = hashed(docs)
    n, df = document_frequencies(docs)
    total = cut.count()
    weight = weights(cut, n, df)
    used = used_features(cut, weight)
    if not len(used):  # no item has a word
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, overlap double, kind string")
    basis = right_vectors(cut, weight, used, rank=min(max(RANK, total // PER_VECTOR), MOST_RANK))
    blocks = max(1, -(-total // item_block))
    found = None
    for k in range(blocks):
        # a block has about item_block rows, as many as its hash deals to it
        part = _search(docs, cut.where(F.pmod(F.xxhash64("nr"), F.lit(blocks)) == k).collect(), weight, used, basis)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("overlap").alias("overlap"), F.min("kind").alias("kind"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the contaminated ones, and without rows of a null doc_id if one of those is contaminated and has the
    same text. The ids to drop are broadcast if they are counted to be few enough, else joined by shuffle."""
    found = stored(contaminated(docs, items).select("doc_id").distinct(), "contaminated")
    kept = semi_join_checked(docs, found.where("doc_id IS NOT NULL"), "doc_id", ID_ROWS, "left_anti").select(docs.columns)
    if found.where("doc_id IS NULL").isEmpty():
        return kept
    # rows without an id are told apart by their texts
    nameless = docs.where("doc_id IS NULL")
    keyed = nameless.select(F.xxhash64("text").alias("doc_id"), "text").distinct()
    bad = contaminated(keyed, items).select(F.col("doc_id").alias("key")).distinct()
    same = F.xxhash64("text") == F.col("key")
    return kept.where("doc_id IS NOT NULL").unionByName(nameless.join(bad, same, "left_anti").select(docs.columns))

"""Words of text that is written without spaces.

A text is a lattice of the lexicon's words; each has a cost, the negative logarithm of its probability, and the cheapest way
through is the segmentation.  Probabilities come from counts of spaced text where there is some, or of all substrings where
there is none, and are re-estimated by expectation maximisation over unspaced text: each round, tasks add up how often every
word is expected over all ways through their lattices, and Spark sums that in a table of counts.  What no word covers is an
unknown word, spelled by the letters' frequencies.
"""

from __future__ import annotations

import itertools
import math
from array import array
from collections import Counter
from collections.abc import Callable, Generator, Iterable, Iterator
from functools import lru_cache
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.functions import tokens as tk
from chronolex.functions.storage import stored

#: Words of a language's lexicon, the most frequent ones: the model's size, whatever the corpus'.  It is sent to the tasks.
LEXICON_WORDS, LONGEST = 200_000, 24
#: Letters of runs that are one task's work in a round.
TASK_LETTERS = 100_000
#: Expected occurrences below which a word of several letters leaves the lexicon.
LEAST_EXPECTED = 0.5

# Japanese particles and auxiliaries that never open a phrase, and prefixes that go with the word after them.
ATTACHED_BACKWARD = frozenset([
    "は", "が", "を", "に", "で", "と", "も", "の", "へ", "や", "か", "ね", "よ", "な", "わ", "さ",
    "て", "た", "だ", "ば", "ん", "う", "い", "る", "ず",
    "から", "まで", "より", "けど", "けれど", "ので", "のに", "って", "だけ", "しか",
    "ほど", "など", "ながら", "たり", "だり", "ちゃ", "じゃ", "とか",
    "ない", "なかっ", "ます", "ませ", "まし", "です", "でし", "でしょ", "だろ", "だっ",
    "たい", "たく", "たかっ", "れる", "られる", "れ", "られ", "せる", "させる", "せ", "させ",
    "いる", "いう", "おり", "ござい",
    "やがる", "やがっ", "ちゃう", "ちゃっ", "じゃう", "じゃっ", "しまう", "しまっ", "しまい",
])
ATTACHED_FORWARD = frozenset(["お", "ご"])
KATAKANA, HIRAGANA = "[ァ-ヿｦ-ﾟ]", "[ぁ-ゟ]"


def unspaced(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")


def letter_runs(text: Column) -> Column:
    """Runs of letters, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, text) of spaced text -> (lang, word, n)."""
    words = texts.select("lang", F.explode(letter_runs(F.col("text"))).alias("word"))
    return words.where(F.length("word") <= LONGEST).groupBy("lang", "word").agg(F.count("*").cast("double").alias("n"))


def substring_counts(texts: DataFrame, longest: int = 6, least: int = 3) -> DataFrame:
    """(lang, text) of unspaced text -> (lang, word, n): every substring of up to `longest` letters that occurs `least` times,
    and all letters; a lexicon to begin with where nothing is known."""
    runs = texts.select("lang", F.explode(letter_runs(F.col("text"))).alias("run"))
    starts = runs.select("lang", "run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("i"))
    each = starts.select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - F.col("i") + 1)), lambda k: F.substring("run", F.col("i"), k))).alias("word"))
    return each.groupBy("lang", "word").agg(F.count("*").cast("double").alias("n")).where((F.col("n") >= least) | (F.length("word") == 1))


class Lexicon:
    """Costs of one language's words and of the letters of unknown ones."""

    def __init__(self, counts: dict[str, float]):
        total = sum(counts.values()) or 1.0
        rare = {w: n for w, n in counts.items() if n < 1.5} or counts
        self.unknown = min(0.5, max(1.0 / (total + 1), sum(rare.values()) / total)) if counts else 1.0
        self.cost = {w: -math.log(n / total * (1 - self.unknown)) for w, n in counts.items() if n > 0}
        letters, lengths = Counter(), Counter()
        for w in rare:
            letters.update(w)
            lengths[len(w)] += 1
        most = sum(letters.values()) + 1
        self.letters = {c: -math.log(n / most) for c, n in letters.items()}
        self.other = math.log(most)
        self.lengths = [0.0] + [-math.log((lengths[k] + 0.1) / (len(rare) + 0.1 * LONGEST)) - math.log(self.unknown) for k in range(1, LONGEST + 1)]
        self.beginnings = {w[:k] for w in self.cost for k in range(1, len(w))}

    def edges(self, text: str, i: int, spelled: array) -> Iterator[tuple[int, float]]:
        """(end, cost) of what can begin at i: known words, and one unknown word of each length that is none."""
        known, n = self.cost, len(text)
        open_ = True
        for k in range(1, min(LONGEST, n - i) + 1):
            word = text[i : i + k] if open_ else ""
            cost = known.get(word) if open_ else None
            if cost is None:
                cost = spelled[i + k] - spelled[i] + self.lengths[k]
            open_ = open_ and word in self.beginnings
            yield i + k, cost

    def spelling(self, text: str) -> array:
        """Cost of the letters up to each place."""
        out, total = array("d", [0.0]), 0.0
        for c in text:
            total += self.letters.get(c, self.other)
            out.append(total)
        return out

    def gain(self, word: str, n: float) -> float:
        """What a word that occurs n times saves, less what it takes to spell it once in the lexicon."""
        ends = self.cut(word, whole=False)
        parts = [word[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        spelled = self.spelling(word)[-1]
        apart = sum(self.cost.get(x, self.spelling(x)[-1] + self.lengths[len(x)]) for x in parts)
        return n * (apart - self.cost[word]) - spelled

    def cut(self, text: str, whole: bool = True) -> list[int]:
        """Ends of the words of the cheapest way through; of equal ones, that whose last word is longest.  Without whole, the
        text as one word is no way."""
        n = len(text)
        best, back, spelled = array("d", [math.inf]) * (n + 1), array("l", [0]) * (n + 1), self.spelling(text)
        best[0] = 0.0
        for i in range(n):
            for end, cost in self.edges(text, i, spelled):
                if best[i] + cost < best[end] and (whole or end - i < n):
                    best[end], back[end] = best[i] + cost, i
        ends = []
        while n:
            ends.append(n)
            n = back[n]
        return ends[::-1]

    def expected(self, text: str) -> dict[str, float]:
        """How often each word is expected over all ways through, unknown words too."""
        n, spelled = len(text), self.spelling(text)
        ways = [list(self.edges(text, i, spelled)) for i in range(n)]
        forward, backward = array("d", [-math.inf]) * (n + 1), array("d", [-math.inf]) * (n + 1)
        forward[0] = backward[n] = 0.0
        for i in range(n):
            for end, cost in ways[i]:
                forward[end] = _log_add(forward[end], forward[i] - cost)
        for i in range(n - 1, -1, -1):
            for end, cost in ways[i]:
                backward[i] = _log_add(backward[i], backward[end] - cost)
        out: dict[str, float] = {}
        for i in range(n):
            for end, cost in ways[i]:
                if (p := math.exp(forward[i] - cost + backward[end] - forward[n])) > 1e-6:
                    out[text[i:end]] = out.get(text[i:end], 0.0) + p
        return out

    def trie(self) -> Trie:
        if "_trie" not in self.__dict__:
            self._trie = Trie(self)
        return self._trie


def _log_add(a: float, b: float) -> float:
    a, b = (a, b) if a > b else (b, a)
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))

#: Letters of runs whose lattices are held together; longer runs go one by one.
LATTICE_LETTERS = 32_000


class Trie:
    """A lexicon's words as a table of steps from node to node, so that the lattices of many runs are filled at a time."""

    def __init__(self, lexicon: Lexicon):
        import numpy as np

        known = {w: c for w, c in lexicon.cost.items() if 0 < len(w) <= LONGEST}
        letters = sorted({*"".join(known), *(c for c in lexicon.letters if len(c) == 1)})
        self.codes = codes = np.array([ord(c) for c in letters], np.int64)
        self.of_code = np.zeros((codes[-1] if len(codes) else 0) + 2, np.int64)
        self.of_code[codes] = np.arange(1, len(codes) + 1)
        self.size = len(codes) + 1
        self.letter_cost = np.array([lexicon.other, *(lexicon.letters.get(c, lexicon.other) for c in letters)])
        self.lengths = lexicon.lengths
        lengths = np.fromiter(map(len, known), np.int64, len(known))
        ids, first = self.ids(_codes("".join(known))), np.cumsum(lengths) - lengths
        costs, at, keys, node_cost, nodes = np.fromiter(known.values(), float, len(known)), np.zeros(len(known), np.int64), [], [np.full(1, np.nan)], 1
        for k in range(int(lengths.max(initial=0))):
            own = np.flatnonzero(lengths > k)
            steps, child = np.unique(at[own] * self.size + ids[first[own] + k], return_inverse=True)
            keys.append(steps)
            cost = np.full(len(steps), np.nan)
            at[own] = nodes + child
            ends = own[lengths[own] == k + 1]
            cost[at[ends] - nodes] = costs[ends]
            node_cost.append(cost)
            nodes += len(steps)
        self.node_cost = np.concatenate(node_cost)
        self._fill(np.concatenate([*keys, np.empty(0, np.int64)]))

    def _fill(self, keys):
        """Open addressing: a key's slot or the next free one after it; node n has the key n - 1."""
        import numpy as np

        bits = max(4, (3 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.children = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        rest, slot = np.arange(len(keys)), self._slots(keys)
        while len(rest):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[rest[free]]
            mine = self.keys[slot] == keys[rest]
            self.children[slot[mine]] = rest[mine] + 1
            rest, slot = rest[~mine], (slot[~mine] + 1) & self.mask

    def _slots(self, keys):
        import numpy as np

        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ids(self, codes):
        import numpy as np

        return self.of_code[np.minimum(codes, len(self.of_code) - 1)]

    def step(self, nodes, letters):
        """The nodes after a letter; 0 where there is none."""
        import numpy as np

        keys = nodes * self.size + letters
        slot, out = self._slots(keys), np.zeros(len(keys), np.int64)
        found = self.keys[slot]
        hit = found == keys
        out[hit] = self.children[slot[hit]]
        rest = np.flatnonzero(~hit & (found != -1))
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & self.mask
            found = self.keys[slot]
            hit = found == keys[rest]
            out[rest[hit]] = self.children[slot[hit]]
            go = ~hit & (found != -1)
            rest, slot = rest[go], slot[go]
        return out

    def lattices(self, ids, first, lengths):
        """Groups of runs of about one length, of the letters ids[first : first + length] each: (their places, edges).
        edges[j, LONGEST - k, r] is the cost of the last k of the first j letters, as in Lexicon.edges()."""
        import numpy as np

        order = np.argsort(lengths, kind="stable")
        a = 0
        while a < len(order):
            b = a + max(1, int(np.searchsorted(lengths[order[a:]] * np.arange(1, len(order) - a + 1), LATTICE_LETTERS, "right")))
            runs, a = order[a:b], b
            n = lengths[runs]
            longest = int(n[-1])
            place = np.arange(longest)[:, None]
            inside = place < n
            x = np.where(inside, ids[np.minimum(first[runs] + place, len(ids) - 1)], 0)
            spelled = np.zeros((longest + 1, len(runs)))
            np.cumsum(self.letter_cost[x], axis=0, out=spelled[1:])
            edges = np.full((longest + 1, LONGEST, len(runs)), np.inf)
            for k in range(1, min(LONGEST, longest) + 1):
                edges[k:, LONGEST - k] = spelled[k:] - spelled[:-k] + self.lengths[k]
            at, row = np.nonzero(inside)
            node = np.zeros(len(row), np.int64)
            for k in range(1, min(LONGEST, longest) + 1):
                go = at + k <= n[row]
                row, at, node = row[go], at[go], node[go]
                node = self.step(node, x[at + k - 1, row])
                go = node > 0
                row, at, node = row[go], at[go], node[go]
                cost = self.node_cost[node]
                word = ~np.isnan(cost)
                edges[at[word] + k, LONGEST - k, row[word]] = cost[word]
                if not len(row):
                    break
            yield runs, edges

    def cut(self, ids, first, lengths):
        """Whether a word ends after each letter: Lexicon.cut() of many runs."""
        import numpy as np

        ends = np.zeros(len(ids), bool)
        for runs, edges in self.lattices(ids, first, lengths):
            size, count = edges.shape[0] - 1, len(runs)
            best, back, every = np.full((LONGEST + size + 1, count), np.inf), np.zeros((size + 1, count), np.int64), np.arange(count)
            best[LONGEST] = 0.0
            for j in range(1, size + 1):
                ways = best[j : j + LONGEST] + edges[j]
                least = ways.argmin(axis=0)  # the first of equal ones, whose last word is longest
                best[LONGEST + j], back[j] = ways[least, every], LONGEST - least
            at, start = lengths[runs].copy(), first[runs]
            while len(at):
                ends[start + at - 1] = True
                at = at - back[at, every]
                go = at > 0
                every, at, start = every[go], at[go], start[go]
        return ends

    def expected(self, ids, first, lengths):
        """(run, first letter, length, how often): Lexicon.expected() of many runs, a word of a run in several rows.  Ways up to
        a place give the chances of the last words there, and those, from the end on, how often each is taken."""
        import numpy as np

        for runs, edges in self.lattices(ids, first, lengths):
            size, count = edges.shape[0] - 1, len(runs)
            ways, taken = np.full((LONGEST + size + 1, count), -np.inf), np.zeros((LONGEST + size + 1, count))
            ways[LONGEST] = 0.0
            for j in range(1, size + 1):
                each = ways[j : j + LONGEST] - edges[j]
                most = each.max(axis=0)
                each -= most
                np.exp(each, out=edges[j])
                total = edges[j].sum(axis=0)
                ways[LONGEST + j] = most + np.log(total)
                edges[j] /= total
            edges[0] = 0.0
            taken[LONGEST + lengths[runs], np.arange(count)] = 1.0
            for j in range(size, 0, -1):
                edges[j] *= taken[LONGEST + j]
                taken[j : j + LONGEST] += edges[j]
            j, m, r = np.nonzero(edges > 1e-6)
            yield runs[r], first[runs[r]] + j - LONGEST + m, LONGEST - m, edges[j, m, r]


#: Letters of texts whose words are looked for together.
TEXT_LETTERS = 1_000_000


def slices(sizes: list[int], most: int = TEXT_LETTERS) -> Iterator[tuple[int, int]]:
    """Borders of slices of at most `most` letters together, or of one text."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def _codes(text: str):
    import numpy as np

    return np.frombuffer(_utf32(text), np.uint32).astype(np.int64)


def _utf32(text: str) -> bytes:
    return text.encode("utf-32-le", "surrogatepass")


@lru_cache(maxsize=1)
def _characters():
    """Of each code point: whether it is a letter, whether it is white space, and its lower case; -1 where that depends on the
    letters around it or takes several."""
    import numpy as np

    each = [chr(c) for c in range(0x110000)]
    low = np.array([ord(x) if len(x) == 1 else -1 for x in map(str.lower, each)], np.int64)
    low[0x3A3] = -1
    return np.fromiter(map(str.isalpha, each), bool, len(each)), np.fromiter(map(str.isspace, each), bool, len(each)), low


def word_ends(lexicon: Lexicon, codes, borders):
    """(ends, letters): whether a word ends inside a run of letters after each code point, and whether it is a letter; runs
    end at the borders too.  The same as Lexicon.cut() of each run in lower case."""
    import numpy as np

    alpha, _, lower = _characters()
    letter = alpha[codes]
    before = np.concatenate([[False], letter[:-1]])
    edge = np.zeros(len(codes) + 1, bool)
    edge[borders] = True
    begins = np.flatnonzero(letter & (~before | edge[:-1]))
    after = np.concatenate([letter[1:], [False]])
    stops = np.flatnonzero(letter & (~after | edge[1:])) + 1
    low = lower[codes]
    odd, ends = np.zeros(len(begins), bool), np.zeros(len(codes), bool)
    strange = np.flatnonzero((low < 0) & letter)
    odd[np.searchsorted(begins, strange, "right") - 1] = True
    odd |= stops - begins > LATTICE_LETTERS
    for i in np.flatnonzero(odd):
        run = codes[begins[i] : stops[i]].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        own = run.lower()
        for end in lexicon.cut(own if len(own) == len(run) else run):
            ends[begins[i] + end - 1] = True
    trie = lexicon.trie()
    if not odd.all():
        ends |= trie.cut(trie.ids(np.maximum(low, 0)), begins[~odd], (stops - begins)[~odd])
    ends[stops - 1] = False
    return ends, letter


def ends_of_phrases(lexicon: Lexicon, texts: list[str]) -> list[list[int]]:
    """phrase_ends() by phrases(words()) of many unspaced texts, with runs of Latin letters split."""
    import numpy as np

    if not any(texts):
        return [[] for _ in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    borders = np.concatenate([[0], np.cumsum(sizes)])
    codes = _codes("".join(texts))
    ends, letter = word_ends(lexicon, codes, borders)
    # What follows a run belongs to its last word: words end before letters only, and at the end of the text.
    after = np.concatenate([letter[1:], [False]])
    ends |= ~letter & after
    ends[borders[1:][sizes > 0] - 1] = True
    where = np.flatnonzero(ends) + 1
    share = np.searchsorted(where, borders, "right")
    out = []
    for i, text in enumerate(texts):
        own = (where[share[i] : share[i + 1]] - borders[i]).tolist()
        if not text.isascii():
            own = list(itertools.accumulate(map(len, phrases([text[a:b] for a, b in zip([0, *own], own, strict=False)], latin_runs=False))))
        out.append(own)
    return out


def compared_many(lexicon: Lexicon | None, texts: list[str]):
    """compared() of many texts, as an array of three rows."""
    import numpy as np

    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((3, len(texts)), np.int64)
    if not sizes.sum():
        return out
    alpha, space, _ = _characters()
    codes, text = _codes("".join(texts)), np.repeat(np.arange(len(texts)), sizes)
    kept = ~space[codes]
    place, codes, text = np.flatnonzero(kept), codes[kept], text[kept]
    if not len(codes):
        return out
    same = text[1:] == text[:-1]
    true = np.concatenate([same & (np.diff(place) > 1) & alpha[codes[1:]] & alpha[codes[:-1]], [False]])
    found, _ = word_ends(lexicon or Lexicon({}), codes, np.searchsorted(text, np.arange(len(texts) + 1)))
    for i, marks in enumerate((true, found, true & found)):
        out[i] = np.bincount(text[marks], minlength=len(texts))
    return out


class Expected:
    """How often each word of a language is expected in runs of letters; equal words are added up as they come, short ones as
    whole numbers that hold a letter in some bits each, others as bytes."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.tables, self.rows, self.trie = lexicon, {}, 0, lexicon.trie()
        self.bits = self.trie.size.bit_length()

    def add(self, runs: list[str], times) -> None:
        import numpy as np
        import pyarrow as pa

        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        for i in np.flatnonzero(sizes > LATTICE_LETTERS):
            own = self.lexicon.expected(runs[i])
            self._hold("bytes", pa.array([_utf32(w) for w in own], pa.large_binary()), pa.array([n * times[i] for n in own.values()], pa.float64()))
        some = np.flatnonzero((sizes > 0) & (sizes <= LATTICE_LETTERS))
        if not len(some):
            return
        codes, first = _codes("".join(runs)), (np.cumsum(sizes) - sizes)[some]
        letters, ids = codes.astype(np.uint32), self.trie.ids(codes)
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for run, start, length, n in self.trie.expected(ids, first, sizes[some]):
            n = n * times[some[run]]
            short = (length * self.bits < 64) & (unknown[start + length] == unknown[start])
            at, left, key = start[short], length[short], np.zeros(int(short.sum()), np.int64)
            for k in range(int(left.max(initial=0))):
                key |= np.where(k < left, ids[np.minimum(at + k, len(ids) - 1)] << (k * self.bits), 0)
            self._hold("numbers", pa.array(key), pa.array(n[short]))
            start, length = start[~short], length[~short]
            if len(start):
                ends = np.cumsum(length)
                place = np.repeat(start - ends + length, length) + np.arange(ends[-1])
                offsets = pa.py_buffer(np.concatenate([[0], ends * 4]).tobytes())
                words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, offsets, pa.py_buffer(letters[place].tobytes())])
                self._hold("bytes", words, pa.array(n[~short]))

    def _hold(self, kind, words, n) -> None:
        import pyarrow as pa

        self.tables.setdefault(kind, []).append(pa.table({"word": words, "n": n}))
        self.rows += len(n)
        if self.rows > 10 * LEXICON_WORDS:
            self.sum()

    def sum(self) -> int:
        """Equal words are added up; how many different ones there are."""
        import pyarrow as pa

        for kind, own in self.tables.items():
            self.tables[kind] = [pa.concat_tables(own).group_by("word").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})]
        self.rows = sum(x[0].num_rows for x in self.tables.values())
        return self.rows

    def given(self) -> tuple[list[str], list[float]]:
        """(words, n) so far, which are not held any more."""
        import numpy as np

        self.sum()
        words, n = [], []
        for kind, (own,) in self.tables.items():
            n += own["n"].to_pylist()
            if kind == "bytes":
                words += [w.decode("utf-32-le", "surrogatepass") for w in own["word"].to_pylist()]
                continue
            keys = own["word"].to_numpy()
            ids = (keys[:, None] >> (np.arange(63 // self.bits) * self.bits)) & ((1 << self.bits) - 1)
            ends = np.cumsum((ids > 0).sum(axis=1)).tolist()
            text = self.trie.codes[ids[ids > 0] - 1].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
            words += [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        self.tables, self.rows = {}, 0
        return words, n


def lexicons(counts: DataFrame, words: int = LEXICON_WORDS) -> dict[str, Lexicon]:
    """The lexicon of each language: its `words` most frequent words of (lang, word, n)."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    out: dict[str, dict[str, float]] = {}
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= words).select("lang", "word", "n").toLocalIterator():
        out.setdefault(r["lang"], {})[r["word"]] = r["n"]
    return {lang: Lexicon(own) for lang, own in out.items()}


def worthwhile(counts: DataFrame, words: int = LEXICON_WORDS) -> DataFrame:
    """Those words that save more than their spelling costs, and all letters."""
    sent = counts.sparkSession.sparkContext.broadcast(lexicons(counts, words))

    def keep(frames):
        for frame in frames:
            of = [sent.value[lang] for lang in frame["lang"]]
            yield frame[[len(w) == 1 or (w in x.cost and x.gain(w, n) > 0) for x, w, n in zip(of, frame["word"], frame["n"], strict=True)]]

    return stored(counts.mapInPandas(keep, "lang string, word string, n double"))


def reestimated(counts: DataFrame, texts: DataFrame, rounds: int = 2, words: int = LEXICON_WORDS, prune: bool = False) -> DataFrame:
    """counts (lang, word, n) after rounds of expectation maximisation over the unspaced texts (lang, text); equal runs of
    letters are weighed once with their number.  prune drops words that are not worthwhile after each round, which a lexicon
    of substrings needs: likelihood alone prefers long ones."""
    runs = stored(texts.select("lang", F.explode(letter_runs(F.col("text"))).alias("run")).groupBy("lang", "run").agg(F.count("*").alias("times")))
    letters = runs.agg(F.sum(F.length("run"))).first()[0] or 0
    runs = runs.repartition(letters // TASK_LETTERS + 1)
    for _ in range(rounds):
        sent = counts.sparkSession.sparkContext.broadcast(lexicons(counts, words))

        def add(frames, sent=sent):
            import pandas as pd

            def given(held):
                for lang, own in held.items():
                    words, n = own.given()
                    if words:
                        yield pd.DataFrame({"lang": lang, "word": words, "n": n})

            held: dict[str, Expected] = {}
            for frame in frames:
                for lang, own in frame.groupby("lang"):
                    if lang in sent.value:
                        held.setdefault(lang, Expected(sent.value[lang])).add(own["run"].tolist(), own["times"].to_numpy())
                if sum(x.sum() for x in held.values()) > 5 * LEXICON_WORDS:
                    yield from given(held)
            yield from given(held)

        summed = runs.mapInPandas(add, "lang string, word string, n double").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        counts = stored(summed.where((F.col("n") >= LEAST_EXPECTED) | (F.length("word") == 1)))
        sent.unpersist()
        counts = worthwhile(counts, words) if prune else counts
    return counts


def trained(texts: DataFrame, rounds: int = 2, words: int = LEXICON_WORDS) -> dict[str, Lexicon]:
    """Lexicons of the languages of spaced texts (lang, text): their words' counts, re-estimated on the texts without spaces."""
    counts = stored(word_counts(texts))
    if rounds:
        counts = reestimated(counts, texts.withColumn("text", unspaced(F.col("text"))), rounds, words)
    return lexicons(counts, words)


def words(lexicon: Lexicon, text: str) -> list[str]:
    """Words of an unspaced text, which make it up exactly: signs and spaces stay with the word before them."""
    out: list[str] = []
    i = 0
    while i < len(text):
        j = i
        while j < len(text) and text[j].isalpha():
            j += 1
        run, start = text[i:j], i
        low = run.lower()
        for end in lexicon.cut(low if len(low) == len(run) else run):
            out.append(text[start : i + end])
            start = i + end
        while j < len(text) and not text[j].isalpha():
            j += 1
        rest = text[start:j]
        if out:
            out[-1] += rest
        elif rest:
            out.append(rest)
        i = j
    return out


def phrases(parts: list[str], latin_runs: bool = True) -> list[str]:
    """Words joined to phrases that a line may end with: particles, auxiliaries and single hiragana go with the word before,
    prefixes with the one after, neighbouring katakana (and Latin letters, unless latin_runs is off) are one word."""
    import re

    one_script = re.compile(f"{KATAKANA}{{2}}|[A-Za-z]{{2}}" if latin_runs else f"{KATAKANA}{{2}}")
    out: list[str] = []
    prefix = ""
    for part in parts:
        bare = part.strip()
        if bare in ATTACHED_FORWARD:
            prefix += part
            continue
        before = out[-1].rstrip()[-1:] if out else ""
        attached = "".join(c for c in bare if c.isalpha()) in ATTACHED_BACKWARD or re.fullmatch(HIRAGANA, bare) or one_script.match(before + bare[:1])
        if not prefix and attached and before.isalpha():
            out[-1] += part
        else:
            out.append(prefix + part)
        prefix = ""
    return [*out, prefix] if prefix else out


Segmenter = Callable[[str], list[str]]
#: A rule that yields texts, gets the ends of their phrases, and so on, until it returns: so that many media ask together.
Steps = Generator[list[str], list[list[int]], Any]


def answered(steps: Steps, ends_of: Callable[[list[str]], list[list[int]]]):
    """What a rule returns, if ends_of() answers."""
    try:
        asked = next(steps)
        while True:
            asked = steps.send(ends_of(asked))
    except StopIteration as done:
        return done.value


def gathered(each: Iterable[Steps]) -> Steps:
    """Rules side by side, as one that returns what each returns."""
    out: dict[int, Any] = {}

    def move(i, steps, *answer):
        try:
            return [(i, steps, steps.send(*answer) if answer else next(steps))]
        except StopIteration as done:
            out[i] = done.value
            return []

    waiting = [x for i, steps in enumerate(each) for x in move(i, steps)]
    while waiting:
        answers = iter((yield [text for *_, asked in waiting for text in asked]))
        waiting = [x for i, steps, asked in waiting for x in move(i, steps, list(itertools.islice(answers, len(asked))))]
    return [out[i] for i in range(len(out))]


def one_by_one(split: Segmenter) -> Callable[[list[str]], list[list[int]]]:
    return lambda texts: [phrase_ends(split, text) for text in texts]


def phrase_ends(split: Segmenter, text: str) -> list[int]:
    ends, at = [], 0
    for part in split(text):
        at += len(part)
        ends.append(at)
    return ends


def breaking(rest: str, width: int, earliest: int) -> Steps:
    """The last phrase's end within width from earliest on, or else the last one within width.  A run of letters is split by
    itself, so what follows the one at the width is not looked at."""
    k = width
    while k < len(rest) and rest[k].isalpha():
        k += 1
    while k < len(rest) and not rest[k].isalpha():
        k += 1
    (ends,) = yield [rest[:k]]
    fits = [e for e in ends if e <= width and e < len(rest)]
    return max((e for e in fits if e >= earliest), default=fits[-1] if fits else None)


def phrase_break(split: Segmenter, rest: str, width: int, earliest: int) -> int | None:
    return answered(breaking(rest, width, earliest), one_by_one(split))


def _at_letters(left: str, right: str, joined: Callable[[str], bool]) -> bool:
    return bool(left and right and joined(left[-1]) and joined(right[0]))


def inside_word(split: Segmenter, left: str, right: str, joined: Callable[[str], bool] = tk.dense_char) -> bool:
    """Whether a seam between two texts of unspaced letters stands inside a phrase."""
    return _at_letters(left, right, joined) and len(left) not in phrase_ends(split, left + right)


def mend(split: Segmenter, pieces: list[dict], most: int = 4, joined: Callable[[str], bool] = tk.dense_char) -> list[dict]:
    return answered(mending(pieces, most, joined), one_by_one(split))


def mending(pieces: list[dict], most: int = 4, joined: Callable[[str], bool] = tk.dense_char) -> Steps:
    """Timed pieces in order; a word that a seam splits goes to the side that holds more of it, if at most `most` letters
    move. Time moves with the letters, at the pace of the piece that gives them; a piece that loses all goes."""
    out: list[dict] = []
    for b in pieces:
        a = out[-1] if out else None
        if not (a and _at_letters(a["text"], b["text"], joined)):
            out.append(b)
            continue
        both, seam = a["text"] + b["text"], len(a["text"])
        (found,) = yield [both]
        if seam in found:
            out.append(b)
            continue
        ends = [0, *found]
        back, forward = seam - max(e for e in ends if e < seam), min((e for e in ends if e > seam), default=len(both)) - seam
        move = forward if forward <= back else -back
        if abs(move) > most:
            out.append(b)
            continue
        if not 0 < seam + move < len(both):
            out[-1] = {**a, "text": both, "end": max(a["end"], b["end"]), "speaker": b["speaker"] if seam + move <= 0 else a["speaker"]}
            continue
        if move < 0:
            at = max(a["start"], a["end"] + (a["end"] - a["start"]) / len(a["text"]) * move)
        else:
            at = min(b["end"], b["start"] + (b["end"] - b["start"]) / len(b["text"]) * move)
        out[-1] = {**a, "text": both[: seam + move], "end": max(a["start"], at)}
        out.append({**b, "text": both[seam + move :], "start": min(at, b["end"])})
    return out


def split_words(split: Segmenter, cues: list[dict], wrap: Callable[[str], list[str]], joined: Callable[[str], bool] = tk.dense_char) -> tuple[int, int, int]:
    def wrapping(text):
        yield from ()
        return wrap(text)

    return answered(counting(cues, wrapping, joined), one_by_one(split))


def counting(cues: list[dict], wrapping: Callable[[str], Steps], joined: Callable[[str], bool] = tk.dense_char) -> Steps:
    """Seams inside a word: between cues under a second apart, and between a cue's lines; and how many seams of cues there are."""
    texts = [c["text"].replace("\n", "") for c in cues]
    near = [i for i in range(1, len(cues)) if cues[i]["start"] - cues[i - 1]["end"] < 1]
    lines = yield from gathered(map(wrapping, texts))
    out = []
    for seams in ([(texts[i - 1], texts[i]) for i in near], [pair for x in lines for pair in zip(x, x[1:], strict=False)]):
        seams = [(a, b) for a, b in seams if _at_letters(a, b, joined)]
        ends = yield [a + b for a, b in seams]
        out.append(sum(len(a) not in e for (a, _), e in zip(seams, ends, strict=True)))
    return out[0], out[1], len(near)


def compared(lexicon: Lexicon | None, text: str) -> tuple[int, int, int]:
    """Ends of words inside the runs of letters of a spaced text: true ones, those found without its spaces, and right ones."""
    true, letters, gap = set(), [], False
    for c in text:
        if not c.isspace():
            if gap and letters and letters[-1].isalpha() and c.isalpha():
                true.add(len(letters))
            letters.append(c)
        gap = c.isspace()
    plain = "".join(letters)
    found, at = set(), 0
    for part in words(lexicon or Lexicon({}), plain):
        at += len(part)
        if part[-1:].isalpha() and plain[at : at + 1].isalpha():
            found.add(at)
    return len(true), len(found), len(true & found)

"""Exact Jaccard similarity join of documents on word n-grams by partition of the universe.

A document is the set of its distinct n-grams; sets of equal content are one class.  A set's size gives its band, a
band's largest size the largest symmetric difference H that two linked sets can have.  The universe is hashed into
H + 1 + E segments, so two linked sets agree on at least E + 1 of them (pigeonhole), and a signature is the hash of a
segment's subset.  A set is also indexed in the next band if a partner can be there.

The allocation gives each segment of a set nothing, its subset, or its one-deletion neighbourhood, by what the lists of
the index cost.  A set may leave out the E longest of its lists, as the shortest list that it shares with a partner
cannot be among those, on either side: of E + 1 shared lists, E are longer.  The longest are those of empty subsets,
which are never written; then lists are counted, and the remaining budget goes to the longest counted ones.  So sets
that agree by chance, on a common line or passage, on no more segments than their budgets are no candidates.  A set with
more than E empty segments is indexed by the one-deletion neighbourhoods of the others as well.  (If two such sets agree
on e > E empty segments only, all others differ, and all but e - E - 1 of those by one element; so one is in the
other's one-deletion neighbourhood, unless empty segments are so many that all may be empty on one side; those sets
share a signature of their own.)  E is the sum of a share of H for skipping lists and of what empty segments take, of
least expected cost: a larger one means more segments, a smaller one more neighbourhoods.

The connected groups of candidates are verified on the n-grams themselves.  A group of up to BLOCK sets and BLOCK_BYTES
of text is one block.  In a larger one every set is first compared with the group's first set; those that link with it
are in one component already, so only the others go on: they are cut into blocks, which are compared with each other
and with the blocks of the former.  A group of near copies so costs about its size, whatever its pairs.  A task sends on
a spanning forest of the links it finds, never all pairs; the components of the forests are those of the links.

Words are runs of bytes other than U+0020 and U+0009 to U+000D, after A-Z are lower-cased.  Defined results: a text
with fewer words than n is one n-gram; a null, empty or blank text is an empty set, linked with nothing; repeated rows
are linked; rows without a doc_id take no part and have a null component; extra columns are dropped.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolex.llm.common import ID_ROWS, broadcast_checked, released, returning, stored
from chronolex.llm.components import components, compressed

BLOCK = 256
BLOCK_BYTES = 16_000_000
#: Signatures that a task holds at a time.
BATCH = 200_000
#: One in so many of the segments that can differ is added, for lists to leave out.
SKIP = 8
BAND = 1.5


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], n: int) -> list[tuple[bytes, ...]]:
    return list(zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else [tuple(words)] if words else []


def most_difference(size: int, percent: int) -> int:
    """The largest symmetric difference of two sets of at most `size` elements with 100 i >= percent u."""
    return 2 * size * (100 - percent) // (100 + percent)


@lru_cache(maxsize=4096)
def allocation(low: int, difference: int) -> int:
    """E: how many segments sets of `low` elements and more may leave out; the one of least expected signatures."""
    skip, best = 1 + difference // SKIP, (math.inf, 0)
    for z in (0, 1, 2, 3, 4, 5):
        extra = skip
        for _ in range(50):  # the segments depend on E, E on the segments
            m = difference + 1 + extra
            empty = m * (1 - 1 / m) ** low
            if (more := skip + math.ceil(empty + z * math.sqrt(empty))) <= extra:
                break
            extra = more
        if extra <= skip + 2 * (difference + 1):
            exceed = 0.5 * math.erfc((extra - empty) / math.sqrt(2 * empty + 1e-9))
            best = min(best, (m - empty + exceed * low, extra))
    return best[1] or skip


@lru_cache(maxsize=4096)
def schemes(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, segments, E) under which a set of n elements is indexed; none if it can only link with equal sets."""
    lows = [1]
    while most_difference(lows[-1], percent) == 0:
        lows[-1] += 1
    lows = [1, lows[-1]]
    while lows[-1] <= 100 * n // percent:
        lows.append(int(lows[-1] * BAND) + 1)
    band = max(k for k, low in enumerate(lows) if low <= n)
    bands = [band, band + 1] if band + 1 < len(lows) and lows[band + 1] <= 100 * n // percent else [band]
    found = [(k, most_difference(lows[k + 1] - 1, percent)) for k in bands if k > 0]
    return [(k, h + 1 + allocation(lows[k], h), allocation(lows[k], h)) for k, h in found]


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(hashes, percent: int):
    """(signatures, tags) of a set, given as sorted distinct 64-bit hashes. A tag is the band, and in its low 32 bits the
    number of lists that the set may leave out there."""
    import numpy as np

    out, tags = [], []
    for band, segments, spare in schemes(len(hashes), percent) if len(hashes) else ():
        seg = ((hashes >> np.uint64(17)) % np.uint64(segments)).astype(np.int64)
        element = _mix(hashes + np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(seg, kind="stable")
        seg, element = seg[order], element[order]
        first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        sums = np.add.reduceat(element, first)  # a subset's sum, so that an element is taken away by subtracting it
        mark = np.uint64(band) << np.uint64(40)
        here = [_mix(sums + _mix(seg[first].astype(np.uint64) + mark))]
        if (empty := segments - len(first)) > spare:
            counts = np.diff(np.append(first, len(seg)))
            several = np.repeat(counts > 1, counts)
            here.append(_mix((np.repeat(sums, counts) - element + _mix(seg.astype(np.uint64) + mark))[several]))
            if 2 * empty > segments + spare:
                here.append(_mix(np.array([mark + np.uint64(2**39)], np.uint64)))
        out.append(np.unique(np.concatenate(here)))
        tags.append(np.full(len(out[-1]), band << 32 | max(spare - empty, 0), np.int64))
    return (np.concatenate(out).view(np.int64), np.concatenate(tags)) if out else (np.empty(0, np.int64), np.empty(0, np.int64))


class Grams:
    """The n-grams of texts as sorted distinct 64-bit hashes; remembers the hashes of words."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def of(self, text: str):
        import numpy as np
        import xxhash

        words = words_of(text)
        if len(self.known) > 500_000:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        k = min(self.n, len(words))
        grams = np.zeros(max(len(words) - k + 1, 0) if k else 0, np.uint64)
        for i in range(k):
            grams = _mix(grams * np.uint64(0x100000001B3) + h[i : i + len(grams)] + np.uint64(k))
        return np.unique(grams)


def sets_of(df: DataFrame, *, n: int) -> DataFrame:
    """(doc_id, text_key, n_bytes, n_shingles, set_key, node) for each row; node is the first half of set_key."""
    names = ["doc_id", "text_key", "n_bytes", "n_shingles", "set_key", "node"]

    @returning
    def run(frames):
        import pandas as pd
        import xxhash

        grams = Grams(n)
        for frame in frames:
            rows = []
            for doc_id, key, text in zip(frame["doc_id"], frame["text_key"], frame["text"], strict=True):
                g = grams.of(text)
                digest = xxhash.xxh3_128_digest(g.tobytes())
                rows.append((doc_id, key, len(text), len(g), digest, int.from_bytes(digest[:8], "little", signed=True)))
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return df.mapInPandas(run, "doc_id long, text_key long, n_bytes long, n_shingles long, set_key binary, node long")


def index_of(df: DataFrame, *, n: int, percent: int) -> DataFrame:
    """(sig, node, tag): the signatures of each task's distinct sets; see signatures()."""

    @returning
    def run(frames):
        import numpy as np
        import pandas as pd
        import xxhash

        grams, seen, held = Grams(n), set(), []

        def table():
            sigs, tags, nodes = zip(*held, strict=True)
            held.clear()
            return pd.DataFrame({"sig": np.concatenate(sigs), "node": np.repeat(np.array(nodes, np.int64), [len(x) for x in sigs]), "tag": np.concatenate(tags)})

        size = 0
        for frame in frames:
            for text in frame["text"]:
                g = grams.of(text)
                node = int.from_bytes(xxhash.xxh3_128_digest(g.tobytes())[:8], "little", signed=True)
                if node in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(node)
                sig, tag = signatures(g, percent)
                held.append((sig, tag, node))
                size += len(sig)
                if size > BATCH:
                    yield table()
                    size = 0
        if held:
            yield table()

    return df.select("text").mapInPandas(run, "sig long, node long, tag long")


def candidates(index: DataFrame) -> DataFrame:
    """(a, b): edges that connect all nodes with a common signature that both keep.

    Lists of one node go at once, so that what is written is a small part of the index.
    """
    of_sig = Window.partitionBy("sig")
    new = (~F.col("node").eqNullSafe(F.lag("node").over(of_sig.orderBy("node")))).cast("int")
    lists = index.withColumn("new", new).withColumn("n", F.sum("new").over(of_sig)).where("n > 1 AND new = 1").select("sig", "node", "tag", "n")
    longest = Window.partitionBy("node", "tag").orderBy(F.desc("n"), "sig")
    kept = stored(lists, "lists").withColumn("nth", F.row_number().over(longest)).where(F.col("nth") > F.col("tag").bitwiseAND(F.lit(0xFFFFFFFF)))
    so_far = Window.partitionBy("sig").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    return kept.select(F.min("node").over(so_far).alias("a"), F.col("node").alias("b")).where("a <> b").distinct()


def linked(a: list, b: list | None, n: int, percent: int) -> list[tuple[int, int]]:
    """Positions of sets in a (or in a and b, numbered on from a) whose links make up a spanning forest of all links
    between a and b, or within a if there is no b."""
    import numpy as np

    sets = [set(shingles(words_of(x), n)) for x in (a if b is None else a + b)]
    seen: dict = {}
    for s in sets:
        for g in s:
            seen[g] = seen.get(g, 0) + 1
    ids = {g: i for i, g in enumerate(g for g, c in seen.items() if c > 1)}
    cols = [np.fromiter(sorted(ids[g] for g in s if g in ids), np.int64) for s in sets]
    size = np.array([len(s) for s in sets], np.float64)
    cut = len(sets) if b is None else len(a)
    rows, others = range(cut), range(0 if b is None else cut, len(sets))
    both = np.zeros((len(rows), len(others)))
    for at in range(0, len(ids), 4096):
        m = np.zeros((len(sets), min(4096, len(ids) - at)), np.float32)
        for i, c in enumerate(cols):
            lo, hi = np.searchsorted(c, (at, at + 4096))
            m[i, c[lo:hi] - at] = 1
        both += m[:cut] @ m[others.start :].T
    x, y = np.nonzero(100 * both >= percent * (size[:cut, None] + size[None, others.start :] - both))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []
    for i, j in zip(x.tolist(), (y + others.start).tolist(), strict=True):
        if (p := root(i)) != (q := root(j)):
            parent[p] = q
            out.append((i, j))
    return out


def verify(rows: DataFrame, *, n: int, percent: int) -> DataFrame:
    """(a, b): links within each job (cluster, i, j), between its sides if it has two. rows: cluster, i, j, side, cid, text."""

    @returning
    def run(frames):
        import itertools

        import pandas as pd

        rows = (r for f in frames for r in f.itertuples(index=False, name=None))
        out = []
        for _, job in itertools.groupby(rows, key=lambda r: r[:3]):
            sides: tuple[list, list] = [], []
            for _, _, _, side, cid, text in job:
                sides[side].append((cid, text))
            one, two = sides
            cids = [c for c, _ in one + two]
            out += [(cids[x], cids[y]) for x, y in linked([t for _, t in one], [t for _, t in two] or None, n, percent)]
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
                out = []
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    # the jobs of a large cluster go to different tasks
    dealt = rows.select("cluster", "i", "j", "side", "cid", "text").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side", "cid")
    return dealt.mapInPandas(run, "a long, b long")


def verified(members: DataFrame, texts: DataFrame, *, n: int, percent: int, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b) links of classes whose components are those of all links. members: cluster, cid, n_bytes; texts: cid, text."""
    many = lambda: F.ceil(F.greatest(F.count("*") / block, F.sum("n_bytes") / block_bytes)).cast("int")
    sizes = stored(members.groupBy("cluster").agg(many().alias("blocks"), F.min("cid").alias("pivot")), "clusters")
    large = broadcast_checked(sizes.where("blocks > 1"), ID_ROWS)
    within = lambda blocks: F.pmod(F.xxhash64("cid"), blocks).cast("int")
    nth = lambda x: F.lit(x).cast("int")
    small = members.join(broadcast_checked(sizes.where("blocks = 1"), ID_ROWS), "cluster", "left_semi").select("cluster", nth(0).alias("i"), nth(-1).alias("j"), nth(0).alias("side"), "cid")
    spread = members.join(large, "cluster")
    pivots = spread.where("cid = pivot").select("cluster", F.explode(F.sequence(nth(1), F.col("blocks"))).alias("i"), nth(-1).alias("j"), nth(0).alias("side"), "cid")
    others = spread.where("cid <> pivot").select("cluster", (within(F.col("blocks")) + 1).alias("i"), nth(-1).alias("j"), nth(1).alias("side"), "cid")
    with_text = lambda jobs: jobs.join(texts, "cid")
    first = stored(verify(with_text(small.unionByName(pivots).unionByName(others)), n=n, percent=percent), "links")
    if sizes.where("blocks > 1").isEmpty():
        return first
    # those that link with their pivot need not be compared with each other
    done = first.select(F.col("a").alias("pivot"), F.col("b").alias("cid"))
    state = spread.join(done.withColumn("linked", F.lit(True)), ["pivot", "cid"], "left").withColumn("linked", F.coalesce("linked", F.col("cid") == F.col("pivot")))
    state = stored(state.select("cluster", "cid", "n_bytes", "linked"), "states")
    parts = state.groupBy("cluster", "linked").agg(many().alias("blocks")).groupBy("cluster").pivot("linked", [False, True]).agg(F.first("blocks"))
    parts = stored(parts.where("`false` IS NOT NULL").select("cluster", F.col("false").alias("u"), F.coalesce("true", F.lit(0)).alias("r")), "clusters")
    if parts.isEmpty():
        return first
    state = state.join(broadcast_checked(parts, ID_ROWS), "cluster")
    left = state.where("NOT linked").withColumn("mine", within(F.col("u")))
    pairs = left.select("cluster", "cid", "mine", F.explode(F.sequence(nth(0), F.col("u") - 1)).alias("other"))
    pairs = pairs.select("cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"), "cid")
    known = state.where("linked").withColumn("mine", within(F.col("r")))
    against = left.where("r > 0").select("cluster", F.col("mine").alias("i"), F.explode(F.sequence(F.col("u"), F.col("u") + F.col("r") - 1)).alias("j"), nth(0).alias("side"), "cid")
    against = against.unionByName(known.select("cluster", F.explode(F.sequence(nth(0), F.col("u") - 1)).alias("i"), (F.col("u") + F.col("mine")).alias("j"), nth(1).alias("side"), "cid"))
    return first.unionByName(verify(with_text(pairs.unionByName(against)), n=n, percent=percent))


def join_components(df: DataFrame, *, n: int = 5, percent: int = 80, **blocks) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) per row; text_key is xxhash64 of the text (null: empty)."""
    docs = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    sets = stored(sets_of(docs, n=n), "sets")
    real = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = real.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key", "n_bytes")).alias("head"), F.first("node").alias("node"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    index = index_of(docs.where("doc_id IS NOT NULL AND text <> ''"), n=n, percent=percent)
    edges = stored(candidates(index), "edges")
    clusters = components(compressed(edges)).select("node", F.col("component").alias("cluster"))
    members = classes.join(clusters, "node").select("cluster", "cid", "head.doc_id", "head.text_key", "head.n_bytes")
    members = stored(members, "members")
    texts = docs.join(broadcast_checked(members.select("doc_id", "text_key", "cid"), ID_ROWS), ["doc_id", "text_key"]).groupBy("cid").agg(F.first("text").alias("text"))
    links = stored(verified(members, stored(texts, "texts"), n=n, percent=percent, **blocks), "links")
    merged = components(links)
    released(edges)
    of = classes.select("set_key", "cid", F.col("head.doc_id").alias("first")).join(merged, F.col("cid") == F.col("node"), "left")
    of = of.select("set_key", "first", F.coalesce("component", "cid").alias("c"))
    least = of.groupBy("c").agg(F.min("first").alias("component_id"))
    of = of.join(least, "c").select("set_key", "component_id")
    out = sets.select("doc_id", "text_key", "n_shingles", "set_key").join(of, "set_key", "left")
    lone = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", lone.alias("component_id"))

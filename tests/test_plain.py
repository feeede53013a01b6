"""Queries without SQL, from the tables to their rows, against plain loops over the same tables; the rules that the loops call
are tested on worked cases elsewhere."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from chronolex.operators import boxes, layout, pieces, ranks
from chronolex.operators import folds as fo
from chronolex.plans import registry
from chronolex.sources.tables import SQL
from chronolex.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in ("conversations", "documents", "events"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def near(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else [near(x) for x in v] if isinstance(v, (list, tuple)) else v


def same(spark, name, columns, want):
    got = sorted(str(near([r[c] for c in columns])) for r in registry.queries()[name](spark, SF).collect())
    assert got == sorted(str(near(list(x))) for x in want)
    assert got


def by_media(rows, key=0):
    return {k: list(g) for k, g in itertools.groupby(sorted(rows, key=lambda r: r[key]), key=lambda r: r[key])}


@pytest.fixture(scope="module")
def turns(db):
    """Per medium (idx, speaker, text, start, end) in order."""
    return {m: [r[1:] for r in rows] for m, rows in by_media(db.execute(f"SELECT * FROM ({SQL['pieces']}) ORDER BY media_id, piece_idx").fetchall()).items()}


@pytest.fixture(scope="module")
def words(turns):
    out = {}
    for m, rows in turns.items():
        out[m] = []
        for _, _, text, start, end in rows:
            parts = text.split(" ")
            d = (end - start) / len(parts)
            out[m] += [(w, start + k * d, start + k * d + d * (0.2 if k % 11 == 10 else 1.0)) for k, w in enumerate(parts) if w]
    return out


def every20(words):
    return [20.0 * i for i in range(1, int(words[-1][2] // 20) + 1)]


GROUPED = {
    "p1_group_tokens": lambda w: pieces.group_tokens([x for t, a, b in w for x in (("<pad>", a, a), ("▁" + t, a, b))]),
    "p2_group_runs": lambda w: pieces.group_runs([x for t, a, b in w for x in ((t, a, b), (" ", None, None))], every20(w)),
    "p4_group_words": lambda w: pieces.group_words(w, every20(w)),
    "p5_punctuate": lambda w: pieces.punctuate([("".join(c for c in t if c.isalnum()), a, b) for t, a, b in w], " ".join(t for t, _, _ in w)),
}


@pytest.mark.parametrize("name", sorted(GROUPED))
def test_pieces(spark, words, name):
    same(spark, name, ["media_id", "idx", "text", "start", "end"], [(m, i, *p) for m, own in words.items() if own for i, p in enumerate(GROUPED[name](own))])


def test_cues(spark, turns):
    tiny, units, made, even = [], [], [], []
    for m, rows in turns.items():
        short = [{"idx": i, "text": x, "speaker": "a", "start": i * 2.0, "end": i * 2.0 + (i % 3) * 0.5 + 0.2} for i, _, x, _, _ in rows]
        tiny += [(m, i + 1, c["start"], c["end"], c["text"], "a") for i, c in enumerate(fo.merge_tiny(short))]
        long = [{"idx": i, "text": x, "speaker": "a", "start": s, "end": s + 6} for i, _, x, s, _ in rows]
        units += [(m, u, c["idx"]) for u, unit in enumerate(fo.sentence_units(long, gap=20, chars=1500)) for c in unit]
        cut = []
        for i, who, x, s, e in rows:
            span = (e - s) / 12
            cut += [{"piece_idx": i, "k": k, "speaker": who, "text": part, "start": s + k * span, "end": s + (k + 1) * span} for k, part in enumerate(re.split("(?<=[.,]) ", x))]
        cut.sort(key=lambda r: (r["start"], r["piece_idx"], r["k"]))
        last = max(r["end"] for r in cut)
        silent = [(60.0 * i, 60.0 * i + 0.5) for i in range(1, int(last // 60) + 2)]
        made += [(m, i + 1, c["start"], c["end"], c["text"], c["speaker"]) for i, c in enumerate(fo.make_cues(cut, silent, last))]
        even += [(m, i, k, part) for i, _, x, _, _ in rows for k, part in enumerate(layout.split_evenly(x, 4))]
    columns = ["media_id", "idx", "start", "end", "text", "speaker"]
    same(spark, "c3_merge_tiny", columns, tiny)
    same(spark, "c6_units", ["media_id", "unit", "idx"], units)
    same(spark, "c1_make_cues", columns, made)
    same(spark, "c10_split_evenly", ["conv_id", "turn", "part", "text"], even)


def test_texts(spark, db):
    docs = db.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    same(spark, "t9_sentences", ["doc_id", "n", "text"], [(i, n, x) for i, text in docs for n, x in enumerate(fo.sentences(text))])
    same(spark, "t12_wrap", ["doc_id", "n", "text"], [(i, n, x) for i, text in docs for n, x in enumerate(layout.wrap(" ".join(text.split())))])


def test_boxes_and_samples(spark, db):
    events = db.execute("SELECT event_id, event_type, value FROM events ORDER BY event_id").fetchall()
    samples = collections.defaultdict(list)
    for e, kind, value in events:
        v = value / 200
        samples[e // 6].append(("これは" if e % 5 == 4 else kind, 0.35 + e % 2 * 0.15 + v / 10, 0.6 + e % 6 // 2 * 0.12 + v / 50, 0.12 + v / 20, 0.06 if e % 6 < 4 else 0.025))
    line = lambda row: " ".join(b[0] for b in row)
    same(spark, "b1_rows", ["sample", "row", "text"], [(s, i, line(r)) for s, own in samples.items() for i, r in enumerate(boxes.rows(own))])
    same(spark, "b2_centred", ["sample", "row", "text"], [(s, i, line(boxes.centred(r))) for s, own in samples.items() for i, r in enumerate(boxes.rows(own))])
    same(spark, "b3_filter", ["sample", "text", "other"], [(s, *boxes.kept(own, "en")) for s, own in samples.items()])
    media = by_media([(e // 500, e, kind, value) for e, kind, value in events])
    runs, cues = [], []
    for m, own in media.items():
        runs += [(m, i, run[0][0], run[-1][0], run[0][1]) for i, run in enumerate(fo.runs([(e, kind) for _, e, kind, _ in own], fo.near_text))]
        cues += [(m, i + 1, *c) for i, c in enumerate(fo.assemble([(e % 500 / 2.0, "" if value < 20 else kind) for _, e, kind, value in own], 250.0, fo.near_text))]
    same(spark, "b5_runs", ["media_id", "run", "first", "last", "text"], runs)
    same(spark, "b7_assemble", ["media_id", "idx", "start", "end", "text"], cues)
    segments = []
    for m, own in by_media([(e // 2000, e, value) for e, _, value in events]).items():
        state = live.Segmenter()
        for _, e, value in own:
            segments += [(m, e, *x) for x in state.feed(value / 100 if e // 200 % 2 == 0 else value * 1e-6)]
        segments += [(m, own[-1][1], *x) for x in state.flush()]
    same(spark, "s1_vad", ["media_id", "seq", "first", "last", "by_silence"], segments)


@pytest.fixture(scope="module")
def paths(turns):
    """(conv, turn, reference's words, hypothesis' words, path) of each turn and the one before."""
    out = []
    for m, rows in turns.items():
        for (_, _, a, _, _), (i, _, b, _, _) in itertools.pairwise(rows):
            out.append((m, i, a.split(" "), b.split(" "), fo.align(a.split(" "), b.split(" "))))
    return out


def test_edits(spark, paths):
    keys, counts, rates, lost = ["conv_id", "turn"], [], [], []
    fillers, extra = collections.Counter(), collections.Counter()
    runs = {"ins": collections.Counter(), "del": collections.Counter()}
    for m, i, ref, hyp, path in paths:
        n = collections.Counter(k for k, _, _ in path)
        counts.append((m, i, n["same"], n["sub"], n["del"], n["ins"]))
        rates.append((m, i, round((n["sub"] + n["del"] + n["ins"]) / max(len(ref), 1), 6)))
        if n["del"] / len(ref) > 0.5:
            lost.append((m, i))
        for w in ("the", "and", "of", "a"):
            fillers[w] += hyp.count(w)
            extra[w] += sum(k in ("ins", "sub") and hyp[j] == w for k, _, j in path)
        for kind, place, own in (("ins", 2, hyp), ("del", 1, ref)):
            at = [x[place] for x in path if x[0] == kind]
            for _, group in itertools.groupby(enumerate(at), key=lambda x: x[1] - x[0]):
                runs[kind][" ".join(own[x] for _, x in group)] += 1
    same(spark, "m3_align", [*keys, "same", "sub", "deleted", "inserted"], counts)
    same(spark, "m18_word_error_rate", [*keys, "wer"], rates)
    found = {(r["conv_id"], r["turn"]) for r in registry.queries()["m29_lost_cues"](spark, SF).collect()}
    assert found == set(lost)
    same(spark, "m30_extra_fillers", ["word", "total", "extra"], [(w, n, extra[w]) for w, n in fillers.items() if n])
    top = [(run, n, n * len(run), kind) for kind, own in runs.items() for run, n in sorted(own.items(), key=lambda x: (-x[1] * len(x[0]), x[0].encode()))[:15]]
    same(spark, "m10_top_runs", ["run", "n", "weight", "kind"], top)


def test_boundaries(spark, paths):
    want = []
    for m, i, ref, hyp, path in paths:
        last, mapped = None, []
        for _, a, b in path:
            last = b if a is not None and b is not None else last
            if a is not None and last is not None and re.search("[.!?]$", ref[a]):
                mapped.append(last)
        marks = [j for j, w in enumerate(hyp) if re.search("[.!?]$", w)]
        if mapped or marks:
            want.append((m, i, len(mapped), sum(any(abs(x - j) <= 2 for j in marks) for x in mapped), len(marks), sum(any(abs(x - j) <= 2 for x in mapped) for j in marks)))
    same(spark, "m6_boundary_score", ["conv_id", "turn", "mapped", "found", "marks", "right"], want)


def test_ranks_of_skewed_groups(spark):
    r = random.Random(8)
    rows = [(k, v) for k, n in (("a", 1), ("b", 700), ("c", 40)) for v in (r.choice([3.0, 3.0, 3.0, r.random() * 9, None]) for _ in range(n))] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    at = {"first": lambda n: F.lit(0), "middle": lambda n: F.floor(n / 2), "last": lambda n: n - 1, "beyond": lambda n: n}
    got = {(x["k"], x["name"]): x["value"] for x in ranks.at_ranks(df, "k", "v", at).collect()}
    want = {}
    for k in "abc":
        own = sorted(v for x, v in rows if x == k and v is not None)
        if own:
            want |= {(k, "first"): own[0], (k, "middle"): own[len(own) // 2], (k, "last"): own[-1]}
    assert got == want
    assert not math.isnan(got["b", "middle"])

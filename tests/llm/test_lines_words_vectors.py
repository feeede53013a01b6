"""Line dedup, spelling groups and whitening against plain versions, and their awkward rows; large pieces and odd pages."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time
import zlib
from decimal import Decimal
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("chronolex.llm.queries")
from chronolex.llm import bpe, common, html_crf, line_dedup, spelling, whitening  # noqa: E402
from test_handling import tables  # noqa: E402

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\f\r"
LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def key(line):
    return line.strip(BLANKS).translate(LOWER)


def plain_lines(docs, min_docs=10, min_chars=1, keep_first=False):
    """[(id, kept text, lines, dropped)] for rows (id, text): documents are distinct rows."""
    distinct = sorted({(i, t or "") for i, t in docs}, key=str)
    seen = collections.defaultdict(set)
    for d in distinct:
        for line in d[1].split("\n"):
            if len(key(line)) >= min_chars:
                seen[key(line)].add(d)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(seen[key(x)]) < min_docs]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


LINES = [
    (i, "\n".join(["Shared line", f"own {i}", "  SHARED Line \t", "", "É accent" if i % 2 else "é accent", *(["rare"] if i < 9 else ["common"]), " "])) for i in range(24)
] + [(None, "Shared line\nno id"), (None, "Shared line\nno id"), (100, ""), (101, None), (102, "\n\n"), (103, "common\r\ncommon"), (103, "common\r\ncommon"), (104, "shared line\n" * 3000 + "end")]


def test_lines_against_a_plain_version(spark):
    df = spark.createDataFrame(LINES, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.digests(df).collect())
    assert got == sorted((str(i), n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in plain_lines(LINES))
    assert line_dedup.digests(df.where("false")).count() == 0


@pytest.mark.parametrize("share", [1e-4, 0.2, 1.0])
def test_lines_frequent_and_heavy_alike(spark, monkeypatch, share):
    monkeypatch.setattr(line_dedup, "HEAVY_SHARE", share)
    monkeypatch.setattr(line_dedup, "FREQUENT_ROWS", 0)
    df = spark.createDataFrame(LINES, "doc_id long, text string")
    assert sorted(str(r["n_dropped"]) for r in line_dedup.digests(df).collect()) == sorted(str(x[3]) for x in plain_lines(LINES))


def test_lines_keep_the_first_of_the_table(spark):
    rows = [(2, "b\na\nb"), (1, "a\nx"), (3, "A \nz\nz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    both = line_dedup.with_bitmaps(df, line_dedup.keep_bitmaps(df, min_docs=1, keep_first=True))
    kept = {r["doc_id"]: r["t"] for r in both.select("doc_id", line_dedup.kept_text(F.col("text"), F.col("n_lines"), F.col("keep")).alias("t")).collect()}
    assert kept == {1: "a\nx", 2: "b", 3: "z"}


def test_bitmaps_round_trip(spark):
    n = 70_000
    cases = [[0], [n - 1], list(range(n)), list(range(0, n, 2)), [5, 6, 7, 200, 16_600], list(range(300, 17_000)), [1, n - 2], list(range(0, n, 129))]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, places array<int>")
    df = common.stored(df.withColumn("keep", line_dedup.pack(F.col("places"))), "t")
    began = time.time()
    for r in df.withColumn("bits", F.array_join(line_dedup.unpack(F.col("keep"), F.lit(n)), "")).collect():
        assert [i for i, c in enumerate(r["bits"]) if c == "0"] == cases[r["i"]]
        assert len(r["bits"]) == n
        assert len(r["keep"]) <= n + 4
    assert time.time() - began < 30


def plain_words(docs):
    """{word: (form, root, n, n_near, form_n)} by comparing neighbourhoods word by word."""
    counts = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        near = sorted((-m, v) for v, m in words.items() if abs(len(v) - len(w)) < 2 and one_edit(w, v))
        good = near and -near[0][0] >= 2 * n
        out[w] = (near[0][1] if good else None, n, len(near), -near[0][0] if good else None)
    root = lambda w: root(out[w][0]) if out[w][0] else w
    return {w: (f, root(w), n, k, fn) for w, (f, n, k, fn) in out.items()}


def test_words_against_a_plain_version(spark):
    texts = ["seaside " * 20 + "seasid " * 7 + "seazide " * 3 + "seasside " * 9 + "seassidé " * 4 + "seassida " * 4, "Colour colour COLOUR color color color colours colours colours " * 4, "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa aaaa aaaa aaaa aaaab aaaab aaaab", "ÉTOILE étoile étoile étoile ÉTOILE ÉTOILE ×××××÷ ×××××÷ ×××××÷ " * 3, None, "", "a^b$c ^^^^^ $$$$$ naïve's"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "seaside colour"), (0, texts[0]), (7, " ".join(f"word{chr(97 + i % 26)}{chr(97 + i % 7)}" for i in range(4000)))]
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain_words(docs)
    assert len(got) > 50


def test_words_of_the_table(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r["word"]: tuple(r)[1:] for r in spelling.groups(df).select("word", "form", "root", "n", "n_near", "form_n").collect()} == plain_words(docs)


def test_candidates_come_once(spark):
    words = spark.createDataFrame([("aabba", 3), ("aabbaa", 3), ("abcba", 4)], "word string, n long")
    some = spelling.neighbourhood(words, spelling.letters_between(words)).select("word", "candidate").collect()
    assert len(some) == len(set(some))
    letters = set("abc")
    for w in ("aabba", "abcba"):
        every = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in letters for k in (0, 1)} - {w}
        assert {r["candidate"] for r in some if r["word"] == w} <= every


def test_long_chains_of_forms(spark):
    names = ["x" * 5 + "y" * k for k in range(40)]
    rows = [(a, b) for a, b in zip(names, names[1:], strict=False)]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect()}
    assert got == {a: names[-1] for a in names[:-1]}


def plain_whitening(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [[math.floor(256 * c) for c in v] for _, v in kept]
    fit = np.array(sorted(set(map(tuple, xs))), dtype=object)
    n, total = len(fit), fit.sum(axis=0)
    z = np.array([[float(Decimal(int(n * a - s)) / n) for a, s in zip(x, total, strict=True)] for x in fit])
    values, axes = np.linalg.eigh(z.T @ z / n)
    values, axes = values[::-1], axes[:, ::-1]
    own = np.array([[float(Decimal(int(n * a - s)) / n) for a, s in zip(x, total, strict=True)] for x in xs])
    deviation = [sum(int(n * a - s) ** 2 for a, s in zip(x, total, strict=True)) for x in xs]
    return [i for i, _ in kept], n, deviation, values, own @ axes


@pytest.mark.parametrize("scale", [1.0, 1e-2, 1e3])
def test_whitening_against_a_library(spark, scale):
    r = np.random.default_rng(3)
    spread = np.array([8, 5, 3, 2, 1, 0.5, 0.2]) * scale
    rows = [(i, (r.normal(size=7) * spread).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i + 1000, v) for i, v in rows[:50]] + [(2000, None), (2001, [1.0] * 6 + [None]), (2002, [math.nan] * 7), (2003, [math.inf] + [0.0] * 6), (None, rows[0][1])]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    ids, n, deviation, values, own = plain_whitening(rows)
    assert len(out) == 4 * len(ids)
    at = {i: k for k, i in enumerate(ids)}
    signs = {}
    for x in out:
        k, c = at[x["vec_id"]], x["component"] - 1
        assert (x["n"], x["deviation"]) == (n, deviation[k])
        assert abs(x["explained"] / (values[c] / values.sum()) - 1) < 1e-9
        assert x["identity_error"] < 1e-9
        want = own[k, c] / math.sqrt(values[c])
        if abs(want) > 1e-3:
            assert signs.setdefault(c, np.sign(want) * np.sign(x["whitened"])) == np.sign(want) * np.sign(x["whitened"])
        assert abs(abs(x["whitened"]) - abs(want)) < 1e-7


def test_whitening_of_few_and_odd_vectors(spark):
    run = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert run([]) == []
    assert run([(1, None)]) == []
    one = run([(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert [(x["n"], x["deviation"], x["whitened"], x["explained"], x["identity_error"]) for x in one] == [(1, 0, None, None, None)] * 4
    two = run([(1, [1.0, 2.0, 5.0]), (2, [3.0, 2.0, 5.0])])
    assert [abs(x["whitened"]) if x["whitened"] is not None else None for x in two] == [1.0, None, None] * 2
    short = run([(1, [1.0]), (2, [0.0, 1.0]), (3, []), (4, [1.0, 0.0])])
    assert {x["vec_id"] for x in short} == {1, 2, 3, 4}
    assert {x["n"] for x in short} == {3}
    huge = run([(1, [1e300, 0.0]), (2, [-1e300, 3.0]), (3, [1.0, 1.0])])
    assert [x["deviation"] for x in sorted(huge, key=lambda x: x["vec_id"])] == [None] * 4 + [328705] * 2
    assert run([(5, [2.0, 1.0, 0.0, 7.0, 3.0]), (6, [0.0] * 5), (5, [2.0, 1.0, 0.0, 7.0, 3.0])])[0]["n"] == 2


def test_jacobi_keeps_small_eigenvalues():
    r = np.random.default_rng(5)
    for d in (1, 2, 3, 8, 33, 64):
        b = r.normal(size=(d, d))
        a = b @ b.T
        values, axes = whitening.jacobi(a)
        assert np.allclose(axes.T @ axes, np.eye(d), atol=1e-12)
        assert np.allclose(axes @ np.diag(values) @ axes.T, a, atol=1e-11 * np.abs(a).max())
        assert (np.diff(values) <= 0).all()
    scale = 10.0 ** -np.arange(0, 20, 2)  # graded matrix: the least eigenvalue is 1e-36 times the largest, and keeps its digits
    well = np.eye(10) + 0.1 * np.ones((10, 10))
    values, _ = whitening.jacobi(well * np.outer(scale, scale))
    from fractions import Fraction

    det = float(np.prod(scale.astype(float) ** 2) * np.linalg.det(well))
    assert abs(np.prod(values) / det - 1) < 1e-12
    assert Fraction(values[-1]) > 0
    for rank in (1, 3):
        b = r.normal(size=(40, rank))
        values, axes = whitening.jacobi(b @ b.T)
        assert np.abs(values[rank:]).max() < 1e-12 * values[0]


def test_whitening_of_the_table(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    out = whitening.whiten(spark.read.parquet(f"{SF}/embeddings.parquet")).collect()
    ids, n, deviation, values, own = plain_whitening(rows)
    at = {i: k for k, i in enumerate(ids)}
    assert len(out) == 4 * len(ids)
    for x in out:
        k, c = at[x["vec_id"]], x["component"] - 1
        assert (x["n"], x["deviation"]) == (n, deviation[k])
        assert abs(abs(x["whitened"]) - abs(own[k, c]) / math.sqrt(values[c])) < 1e-7


def test_awkward_tables(spark):
    for df in tables(spark).values():
        assert line_dedup.digests(df).count() == df.count()
        assert spelling.groups(df).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, x int, i int, n long")
    assert whitening.whiten(empty).count() == 0
    clash = spark.createDataFrame([(i, [float(i), float(i * i)], 1, 2, 3) for i in range(5)], "vec_id long, embedding array<float>, x int, i int, n long")
    assert whitening.whiten(clash).count() == 10


def test_bpe_places_of_a_piece_over_16_mebibytes():
    codec = bpe.Codec({bytes([b]): b for b in range(256)}, r"\S+")
    words = [b"a" * (2**24 + 1000), b"b" * 70]
    at, tok, _ = codec.rows_of(words)
    assert list(map(len, bpe.split_at(tok, at >> 40, 2))) == [4 * len(w) for w in words]


def test_bpe_query_of_short_words_keeps_one_step():
    """2000 words of 64 bytes, whose steps together have four million rows, within 60 MB and without disk."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    codec.db.execute("SET memory_limit = '60MB'")
    codec.db.execute("SET max_temp_directory_size = '0KB'")
    r = random.Random(4)
    words = ["".join(r.choices("etaoinsr", k=64)).encode() for _ in range(2000)]
    inverse = {v: k for k, v in ranks.items()}
    got = codec.contract(words)
    assert [b"".join(inverse[int.from_bytes(x[i : i + 4], "little")] for i in range(0, len(x), 4)) for x in got] == words


def test_bpe_words_of_every_slice_are_contracted_once(monkeypatch):
    """Words that come again before half as many others as the cache holds stay known, also when it is emptied meanwhile."""
    monkeypatch.setattr(bpe, "CACHE_PIECES", 200)
    codec = bpe.Codec({bytes([b]): b for b in range(256)} | {b"ab": 256}, r"\S+")
    done, contract = [], codec.contract
    monkeypatch.setattr(codec, "contract", lambda words: done.extend(words) or contract(words))
    for k in range(40):
        codec.encode([f"often{k % 2}", " ".join(f"once{k}x{i}" for i in range(30))])
    assert [done.count(x) for x in (b"often0", b"often1")] == [1, 1]


def test_workers_give_memory_back_when_a_task_ends():
    """What a task's batches took is no longer held by the process once its generator has ended."""
    import ctypes

    held = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1])
    libc = ctypes.CDLL(None)
    libc.malloc.restype, libc.malloc.argtypes, libc.free.argtypes, libc.memset.argtypes = ctypes.c_void_p, [ctypes.c_size_t], [ctypes.c_void_p], [ctypes.c_void_p, ctypes.c_int, ctypes.c_size_t]

    @common.returning
    def work(batches):
        for x in batches:
            at = [libc.malloc(100_000) for _ in range(1000)]
            for p in at:
                libc.memset(p, 1, 100_000)
            pin = libc.malloc(1000)  # above them, so that the heap can't shrink from its end
            for p in at:
                libc.free(p)
            pins.append(pin)
            yield x

    pins: list = []
    before = held()
    assert list(work(iter([1]))) == [1]
    assert held() - before < 50_000
    for p in pins:
        libc.free(p)


def test_pages_with_odd_markup():
    leaf = lambda page: [b[0] for b in html_crf.leaf_blocks(page)]
    assert leaf('<p>one</p><p title="foo>two</p>') == ["one"]
    assert leaf("<p>one<a href=foo\"bar>two</a> <b title='q>r'>three</b> <i a = \"x>y\">four</i>") == ["onetwo three four"]
    assert leaf("<article><p hidden>kept</p><noscript><p>also</p></noscript></article>") == ["kept", "also"]
    for page in ("<i>" * 20_000 + "</b>" * 20_000, "<b><div>" + "<i>" * 20_000 + "</b>" * 20_000, "<div>" * 8000, "<i>" * 20_000 + "<div>a</div>" * 20_000, '<p a="' * 20_000):
        began = time.time()
        html_crf.leaf_blocks(page + "x")
        assert time.time() - began < 5


def test_main_text_of_the_pages_against_a_plain_cut(spark):
    """The given pages have one <article> each, whose blocks a few patterns cut."""
    import html

    border = re.compile(r"</?(?:p|h[1-6]|li|ul|ol|div|table|tr|td|blockquote|pre|figure|figcaption|section|aside|nav|header|footer)\b[^>]*>")
    rest = re.compile(r"<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->|<(?!br)[^>]*>", re.S)
    sf = SF.replace("0.001", "0.01")
    want = {}
    for page_id, page in duckdb.sql(f"SELECT page_id, html FROM '{sf}/pages.parquet'").fetchall():
        inside = re.search(r"<article[^>]*>(.*?)</article>", page, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(rest.sub("", x).replace("<br>", " "))).strip() for x in border.split(inside)]
        want[page_id] = "\n".join(x for x in parts if x)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_crf.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}

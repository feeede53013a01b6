from __future__ import annotations

import random

import pytest

from chronolex.operators import folds as fo
from chronolex.sources import srt


def cue(start, end, text="some longer text", speaker=None):
    return {"start": start, "end": end, "text": text, "speaker": speaker}


def test_overlaps_leave_positive_durations():
    out = fo.fix_overlaps([cue(2, 3), cue(0, 5), cue(4, 4.5)])
    assert [(round(c["start"], 6), round(c["end"], 6)) for c in out] == [(0, 5), (5, 5.4), (5.4, 5.8)]


def test_tiny_cues_merge():
    out = fo.merge_tiny([cue(0, 2), cue(2.1, 2.4, "ok"), cue(9, 9.2, "far away text")])
    assert [c["text"] for c in out] == ["some longer text ok", "far away text"]


def test_draft_cuts_at_gap_speaker_and_sentence():
    out = fo.draft_cues([cue(0, 1, "One"), cue(1.1, 2, "two."), cue(2.1, 3, "Three"), cue(4, 5, "four"), cue(5.1, 6, "five", "b"), cue(6.1, 7, "...", "c")])
    assert [c["text"] for c in out] == ["One two.", "Three", "four", "five"]
    assert all(a["end"] <= b["start"] + 1.0 for a, b in zip(out, out[1:], strict=False))


def test_sentences_and_lines():
    assert fo.sentences("This is a sentence. No. Another one is here!") == ["This is a sentence.", "No. Another one is here!"]


def test_chunks_are_not_a_running_sum():
    assert fo.chunks([5, 5, 20, 5], 12) == [0, 0, 1, 2]


def test_runs_collapse_one_odd_sample():
    out = fo.runs([(0, "hello world"), (1, "xyz"), (2, "hello world"), (3, "")], fo.near_text)
    assert [len(r) for r in out] == [3, 1]


def test_align():
    assert [k for k, _, _ in fo.align(list("abcd"), list("axcde"))] == ["same", "sub", "same", "same", "ins"]


def test_srt_round_trip(spark):
    text = "1\r\n00:00:01,000 --> 00:00:02,500\r\n<i>Hi</i>\r\nthere\r\n\r\n00:00:05.0 --> 00:00:05.0\r\nnext\r\n   \r\nbad\r\nblock\r\n"
    out = srt.parse(spark.createDataFrame([(1, text)], "media_id long, content string")).orderBy("idx").collect()
    assert [(r["start"], r["end"], r["text"]) for r in out] == [(1.0, 2.5, "Hi there"), (5.0, 5.2, "next")]
    again = srt.parse(srt.render(spark.createDataFrame(out)))
    assert again.count() == 2


def test_marks(spark):
    rows = srt.parse_marks(spark.createDataFrame([("3 0:01:02,5 --> 0:01:04,0 [Ana, Rui]",), ("noise",)], "line string")).collect()
    assert [(r["n"], r["start"], r["who"]) for r in rows] == [(3, 62.5, ["Ana", "Rui"])]


def whole_table(ref, hyp):
    """The path from the whole table of costs, cell by cell."""
    d = [[i + j if not i or not j else 0 for j in range(len(hyp) + 1)] for i in range(len(ref) + 1)]
    for i, x in enumerate(ref, 1):
        for j, y in enumerate(hyp, 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x != y))
    out, i, j = [], len(ref), len(hyp)
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]):
            i, j = i - 1, j - 1
            out.append(("same" if ref[i] == hyp[j] else "sub", i, j))
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
            out.append(("del", i, None))
        else:
            j -= 1
            out.append(("ins", None, j))
    return out[::-1]


@pytest.mark.parametrize("cells", [1, 7, 40, 10**6])
def test_align_holds_few_cells_and_takes_the_same_path(cells):
    r = random.Random(cells)
    for _ in range(150):
        ref, hyp = (r.choices("abc", k=r.randint(0, 25)) for _ in range(2))
        assert fo.align(ref, hyp, cells=cells) == whole_table(ref, hyp)


def test_align_of_long_texts_in_little_memory():
    import tracemalloc

    r = random.Random(9)
    ref = [r.randrange(3000) for _ in range(6000)]
    hyp = [x for x in ref if r.random() > 0.1]
    hyp[2000:2000] = [-1] * 300
    fo.align(ref[:50], hyp[:50])
    tracemalloc.start()
    path = fo.align(ref, hyp, cells=100_000)
    assert tracemalloc.get_traced_memory()[1] < 12_000_000  # the whole table has 130 MB
    tracemalloc.stop()
    assert sum(k == "ins" for k, _, _ in path) >= 300
    assert [i for _, i, _ in path if i is not None] == list(range(len(ref)))
    assert [j for _, _, j in path if j is not None] == list(range(len(hyp)))


def test_documents_against_their_distance(spark):
    import duckdb

    from chronolex.plans import registry

    texts = dict(duckdb.sql("SELECT doc_id, coalesce(text, '') FROM '/root/testdata/sf0.001/documents.parquet'").fetchall())
    got = {r["doc_id"]: r for r in registry.queries()["m3_align_documents"](spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == {i for i in texts if i + 1 in texts}
    for i, r in got.items():
        a, b = texts[i].split(" "), texts[i + 1].split(" ")
        assert (r["same"] + r["sub"] + r["deleted"], r["same"] + r["sub"] + r["inserted"]) == (len(a), len(b))
        if len(a) * len(b) < 20_000:
            path = whole_table(a, b)
            assert r["same"] == sum(k == "same" for k, _, _ in path)

"""Layout of cues: lines, parts of texts that are too long, and the file that is written."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.functions import text as tx
from chronolex.functions import tokens as tk
from chronolex.operators import cues as cu
from chronolex.operators.segmentation import Steps, answered, breaking, one_by_one

WIDTH, LINES, LEAST_SECONDS = 42, 2, 1.0
# Signs after which a line is cut, words before which it is, signs that end a clause, borders of a source.
LINE_SIGNS = ",;:—、。，！？"
CONJUNCTIONS = (" e ", " ou ", " mas ", " que ", " porque ", " quando ", " and ", " or ", " but ", " that ", " because ", " when ")
CLAUSE_SIGNS = ",;:.!?—、。？！"
SOURCE_BORDERS = " 、。，,;；:：!！?？"


def wrap(text: str, width: int = WIDTH, *, split=None, dense: bool | None = None) -> list[str]:
    return answered(wrapping(text, width, by_phrases=split is not None, dense=dense), one_by_one(split))


def wrapping(text: str, width: int = WIDTH, *, by_phrases: bool = True, dense: bool | None = None) -> Steps:
    """Greedy lines of at most width characters: cut after the last sign, else before the last of the conjunctions, if the
    rest still fits in as few lines; else at the last space, but in dense scripts at the end of a phrase, if those are asked
    for; else at the width."""
    rest, lines, dense = text.strip(), [], tk.dense_letter(text) if dense is None else dense
    while len(rest) > width:
        window, earliest = rest[:width], len(rest) - width * (-(-len(rest) // width) - 1)
        after_sign = 1 + max(window.rfind(x) for x in LINE_SIGNS)
        before_word = max((i for w in CONJUNCTIONS if (i := window.rfind(w)) >= earliest), default=-1)
        cut = after_sign if after_sign >= max(earliest, 1) else before_word
        if cut < 0:
            space = ((yield from breaking(rest, width, earliest)) if by_phrases else None) or -1 if dense else window.rfind(" ")
            cut = space if space >= 0 else width
        if not (line := rest[:cut].strip()):
            break
        lines.append(line)
        rest = rest[cut:].lstrip(" ")
    return [x for x in (*lines, rest.strip()) if x]


def split_evenly(text: str, count: int, *, limit: int = WIDTH * LINES) -> list[str]:
    """text in up to count parts at spaces (at characters where a word is longer than a part): each part takes the units
    that leave it nearest to its share of the rest, a clause's end counting a third of the share nearer."""
    clean = text.strip()
    if count < 2 or len(clean) < 2 * count:
        return [clean]
    units, joiner = [x for x in clean.split(" ") if x], " "
    if not units or max(map(len, units)) > len(clean) // count or len(units) < count:
        units, joiner = list(clean), ""
    ends = [0]
    for u in units:  # length of the first k units, joined
        ends.append(ends[-1] + len(u) + (len(joiner) if len(ends) > 1 else 0))
    size = lambda a, b: ends[b] - ends[a] - (len(joiner) if a else 0)
    clause = [u.rstrip()[-1:] in CLAUSE_SIGNS and bool(u.strip()) for u in units]
    parts, first, n = [], 0, len(units)
    for left in range(count, 1, -1):
        aim = size(first, n) / left
        best, least = None, math.inf
        for last in range(first + 1, n - left + 2):
            chars = size(first, last)
            if chars > limit and best is not None:
                break
            score = abs(chars - aim) - (aim / 3 if clause[last - 1] else 0)
            if score < least:
                best, least = last, score
            if chars > 1.6 * aim:
                break
        if best is None:
            break
        parts.append(joiner.join(units[first:best]))
        first = best
    parts.append(joiner.join(units[first:]))
    return [x for x in (p.strip() for p in parts) if x]


def split_source(source: str, count: int) -> list[str]:
    """source in count parts, cut after spaces and signs only; all in the first part if there are too few places."""
    clean = source.strip()
    if count < 2 or not clean:
        return [clean]
    border = re.escape(SOURCE_BORDERS)
    pieces = re.findall(f"[{border}]*[^{border}]*[{border}]*", clean) if clean[0] in SOURCE_BORDERS else re.findall(f"[^{border}]+[{border}]*", clean)
    pieces = [p for p in pieces if p]
    if len(pieces) < count:
        return [clean] + [""] * (count - 1)
    out = [""] * count
    for i, p in enumerate(pieces):
        out[min(i * count // len(pieces), count - 1)] += p
    return [x.strip() for x in out]


def fit_cue(start: float, end: float, shown: str, marked: bool, source: str) -> list[tuple[float, float, str, str]]:
    """(start, end, text, source) of a cue's parts: as many as its lines need, with time by characters and no part under
    a share that the span allows. marked: whether a dash stands before the text."""
    lines = len(wrap(f"— {shown}" if marked else shown))
    parts = split_evenly(shown, max(2, -(-lines // LINES))) if lines > LINES else [shown]
    if len(parts) < 2:
        return [(start, end, shown, source)]
    span, chars = end - start, max(sum(map(len, parts)), 1)
    least = min(0.7 * LEAST_SECONDS, span / len(parts))
    sources, out, at = split_source(source, len(parts)), [], start
    for i, part in enumerate(parts):
        after = len(parts) - 1 - i
        to = min(at + max(span * len(part) / chars, least), end - after * least) if after else end
        out.append((at, to, part, sources[i] if i < len(sources) else ""))
        at = to
    return out


def fit_passes(start: float, end: float, text: str, source: str, marked: bool, passes: int = 3) -> list[tuple[float, float, str, str]]:
    """The parts of a cue, which are split again for up to `passes` times if they still need more lines."""
    rows = [(start, end, text, source)]
    for p in range(passes):
        rows = [x for i, r in enumerate(rows) for x in fit_cue(r[0], r[1], r[2], marked and i == 0, r[3])] if p == 0 or len(rows) > 1 else rows
    return rows


def shown_cues(cues: DataFrame) -> DataFrame:
    """media_id, idx, start, end, text, source, speaker, marked: what cues show, and whether a dash stands before it."""
    text = F.when(F.coalesce("text", F.lit("")) != "", F.col("text")).otherwise(F.coalesce("source", F.lit("")))
    shown = cues.select("media_id", F.col("idx").cast("long").alias("idx"), "start", "end", text.alias("text"), F.coalesce("source", F.lit("")).alias("source"), "speaker")
    return shown.withColumn("marked", cu.marked())


def enforce_lines(cues: DataFrame, *, passes: int = 3) -> DataFrame:
    """cues (media_id, idx, start, end, text, source, speaker) of at most LINES lines: split for up to `passes` times,
    renumbered, overlaps fixed. Whether a dash is shown depends on the speakers before, so it is found by a window."""
    def run(frames):
        import pandas as pd

        names = ["media_id", "idx", "part", "start", "end", "text", "source", "speaker"]
        for frame in frames:
            out = []
            for media, idx, start, end, text, source, speaker, mark in frame.itertuples(index=False, name=None):
                rows = fit_passes(start, end, text, source, bool(mark), passes)
                out += [(media, idx, i, *r, speaker) for i, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=names)

    schema = "media_id long, idx long, part int, start double, end double, text string, source string, speaker string"
    parts = shown_cues(cues).mapInPandas(run, schema)
    return cu.fix_overlaps(parts.withColumn("idx", F.struct("idx", "part")))


def render(cues: DataFrame, *, width: int = WIDTH, colours: bool = False, with_source: bool = False) -> DataFrame:
    """(media_id, idx, start, end, text, source, speaker) -> media_id, content: SubRip with a dash where the speaker
    changes, wrapped lines, and, if asked for, the speaker's colour and the source in italics."""
    rows = cues.withColumn("shown", F.when(F.coalesce("text", F.lit("")) != "", F.col("text")).otherwise(F.coalesce("source", F.lit("")))).where(tx.has_content(F.col("shown")))
    rows = rows.select("media_id", "idx", "start", "end", F.concat(F.when(cu.marked(), "— ").otherwise(""), "shown").alias("shown"), F.coalesce("source", F.lit("")).alias("source"), "speaker")

    def lines(texts):
        return texts.map(lambda x: "\n".join(wrap(x, width)))

    body = F.pandas_udf(lines, "string")(F.col("shown"))
    index = tx.palette_index(F.col("speaker"))
    hue = F.when(index.isNotNull(), F.get(F.array(*map(F.lit, tx.PALETTE)), index))
    body = F.when(hue.isNotNull(), F.concat(F.lit('<font color="'), hue, F.lit('">'), body, F.lit("</font>"))).otherwise(body) if colours else body
    tail = F.when(F.col("source") != "", F.concat(F.lit("\n<i>"), "source", F.lit("</i>"))).otherwise("") if with_source else F.lit("")
    rows = rows.select("media_id", "idx", "start", F.concat(tx.timecode(F.col("start")), F.lit(" --> "), tx.timecode(F.col("end")), F.lit("\n"), body, tail).alias("c"))
    each = F.array_sort(F.collect_list(F.struct("start", "idx", "c")))
    numbered = F.transform(each, lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x["c"], F.lit("\n\n")))
    return rows.groupBy("media_id").agg(F.array_join(numbered, "").alias("content"))


def capture_text(blocks: DataFrame, source: Column, target: Column) -> DataFrame:
    """(media_id, at, source, text) -> media_id, content: a header and each block's time, source and translation."""
    own = F.concat(F.lit("["), F.date_format("at", "HH:mm:ss"), F.lit("]\n"), "source", F.when((F.coalesce("text", F.lit("")) != "") & (F.col("text") != F.col("source")), F.concat(F.lit("\n"), "text")).otherwise(""), F.lit("\n"))
    rows = blocks.select("media_id", "at", own.alias("c"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda x: x["c"]), "\n")
    head = F.concat_ws("\n", F.lit("Capture"), F.concat(source, F.coalesce(F.concat(F.lit(" → "), target), F.lit(""))), F.concat(F.lit("Started: "), F.date_format(F.min("at"), "HH:mm:ss")), F.lit(""))
    return rows.groupBy("media_id").agg(F.concat(head, F.lit("\n"), body).alias("content"))

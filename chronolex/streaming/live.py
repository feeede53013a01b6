"""Live operators: the state machines, over tables by `fold()` and over streams by `transformWithStateInPandas`.

A stream has columns media_id, seq and one input column; rows of one media_id are taken in the order of seq within each
micro-batch, and batches in their order.  Arrival order is truth: there is no watermark.  A row whose input is null is a
pause: the machine gives out what it holds.  A table's medium ends with one.  A stream that is `ordered` has seq 0, 1, 2 and
so on in each medium, and rows that come before their turn wait in state until the gap is closed.  A stream with
`idle_seconds` gives out what a medium's machine holds when no row has come for so long.

A machine's state is kept as its named fields, so a class may gain fields between restarts.
"""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.functions import text as tx
from chronolex.functions import tokens as tk
from chronolex.functions.text import CLAUSE_ENDERS, SENTENCE_ENDERS
from chronolex.operators.folds import fold, sentences


def _shared(a: list[str], b: list[str]) -> int:
    """How many first words are the same, but for case and signs."""
    n = 0
    while n < min(len(a), len(b)) and tk.plain(a[n]) == tk.plain(b[n]):
        n += 1
    return n


@dataclass
class StablePrefix:
    """Confirms the prefix that two hypotheses in a row share; one that disagrees with confirmed words confirms nothing."""

    previous: list[str] = field(default_factory=list)
    confirmed: list[str] = field(default_factory=list)

    def _confirm(self, words: list[str]) -> list[tuple[str]]:
        self.confirmed += words
        return [(tk.join(words),)] if words else []

    def feed(self, text: str) -> list[tuple[str]]:
        words, before = tk.split(text), self.previous
        self.previous, done = words, len(self.confirmed)
        return self._confirm(words[done : _shared(before, words)]) if _shared(self.confirmed, words) == done else []

    def flush(self) -> list[tuple[str]]:
        """The last hypothesis beyond what is confirmed counts as confirmed."""
        return self._confirm(self.previous[len(self.confirmed) :])

    def reconcile(self, text: str) -> list[tuple[str]]:
        """A final hypothesis: all of it beyond the words that agree with the confirmed ones is confirmed."""
        words = tk.split(text)
        if not words:
            return self.flush()
        self.previous = words
        return self._confirm(words[_shared(self.confirmed, words) :])


@dataclass
class Phrases:
    """Closes a phrase at a sentence end, at a clause end from 32 characters on, or at 75 characters."""

    held: list[str] = field(default_factory=list)

    def flush(self) -> list[tuple[str]]:
        text = tk.join(self.held).strip()
        self.held = []
        return [(text,)] if text else []

    def feed(self, text: str) -> list[tuple[str]]:
        out = []
        for word in tk.split(text):
            self.held.append(word)
            size = len(tk.join(self.held).strip())
            if word[-1] in SENTENCE_ENDERS or (word[-1] in CLAUSE_ENDERS and size >= 32) or size >= 75:
                out += self.flush()
        return out


@dataclass
class Latest:
    """Keeps the last `most` items: gives out those that newer ones push out, and at a pause those that are left."""

    most: int = 12
    items: deque = field(default_factory=deque)

    def feed(self, item: str) -> list[tuple[str, bool]]:
        self.items.append(item)
        return [(self.items.popleft(), True)] if len(self.items) > self.most else []

    def flush(self) -> list[tuple[str, bool]]:
        out = [(x, False) for x in self.items]
        self.items.clear()
        return out


@dataclass
class Ring:
    """A buffer of `capacity` samples: a positive number writes so many, a negative one asks for so many. A reader that
    fell behind jumps to the oldest sample that is left. Gives out (place, samples read, samples lost) for each reading."""

    capacity: int = 480_000
    written: int = 0
    read: int = 0

    def feed(self, n: int) -> list[tuple[int, int, int]]:
        if n >= 0:
            self.written += n
            return []
        lost = max(0, self.written - self.read - self.capacity)
        at = self.read + lost
        count = min(-n, self.written - at)
        self.read = at + count
        return [(at, count, lost)]

    def flush(self) -> list:
        return []


@dataclass
class Segmenter:
    """Voice activity over frames' rms: opens after 3 loud frames, closes after 0.6 s of quiet, cuts at 12 s.

    The noise floor follows quiet frames, fast down and slowly up.  Gives (start frame, end frame, closed by silence).
    """

    frame_seconds: float = 0.02
    at: int = 0
    floor: float = 0.002
    loud: int = 0
    start: int | None = None
    quiet: int = 0
    recent: list[float] = field(default_factory=list)

    def feed(self, rms: float) -> list[tuple[int, int, bool]]:
        out: list[tuple[int, int, bool]] = []
        open_at, go_on = max(3.5 * self.floor, 0.0022), max(1.5 * self.floor, 0.00132)
        if rms <= open_at:
            self.floor = 0.9 * self.floor + 0.1 * rms if rms < self.floor else 0.995 * self.floor + 0.005 * rms
        if self.start is None:
            self.loud = self.loud + 1 if rms > open_at else 0
            if self.loud >= 3:
                self.start, self.quiet, self.recent = max(0, self.at - 2 - round(0.2 / self.frame_seconds)), 0, []
        else:
            self.quiet = 0 if rms > go_on else self.quiet + 1
            self.recent.append(rms)
            if self.quiet >= round(0.6 / self.frame_seconds):
                if (self.at + 1 - self.start) * self.frame_seconds >= 0.4:
                    out.append((self.start, self.at + 1, True))
                self.start, self.loud = None, 0
            elif (self.at + 1 - self.start) * self.frame_seconds >= 12:
                tail = self.recent[-min(30, len(self.recent) // 2) :]
                best = len(tail) - 1
                for i, x in enumerate(tail):
                    if x < tail[best]:
                        best = i
                cut = self.at + 1 - (len(tail) - 1 - best)
                out.append((self.start, cut, False))
                self.quiet = 0
                self.start, self.recent = cut, self.recent[len(self.recent) - (self.at + 1 - cut) :]
        self.at += 1
        return out

    def flush(self) -> list[tuple[int, int, bool]]:
        """The open segment, if it is long enough."""
        start, self.start, self.loud, self.quiet = self.start, None, 0, 0
        return [(start, self.at, False)] if start is not None and (self.at - start) * self.frame_seconds >= 0.4 else []


@dataclass
class Through:
    """Gives out what comes, which in an ordered stream is all that it takes to restore an order."""

    def feed(self, item) -> list[tuple]:
        return [(item,)]

    def flush(self) -> list:
        return []


@dataclass
class Reached:
    """When each result can be given out: at the latest arrival up to it."""

    at: float | None = None

    def feed(self, arrived: float) -> list[tuple[float]]:
        self.at = arrived if self.at is None else max(self.at, arrived)
        return [(self.at,)]

    def flush(self) -> list:
        return []


@dataclass
class Gate:
    """Gives out items while it is open: the item `pauses` closes it, `resumes` opens it, itself included."""

    pauses: str = "pause"
    resumes: str = "resume"
    open: bool = True

    def feed(self, item: str) -> list[tuple[str]]:
        self.open = item == self.resumes or (self.open and item != self.pauses)
        return [(item,)] if self.open else []

    def flush(self) -> list:
        return []


@dataclass
class Before:
    """Each text with the one before it."""

    before: str | None = None

    def feed(self, text: str) -> list[tuple[str, str | None]]:
        out, self.before = [(text, self.before)], text
        return out

    def flush(self) -> list:
        return []


MACHINES = {
    "stable_prefix": (StablePrefix, "text string"),
    "phrases": (Phrases, "text string"),
    "segments": (Segmenter, "first long, last long, by_silence boolean"),
    "backlog": (Latest, "item string, dropped boolean"),
    "ring": (Ring, "place long, count long, lost long"),
    "through": (Through, "item string"),
    "reached": (Reached, "given_at double"),
    "gate": (Gate, "item string"),
    "before": (Before, "text string, before string"),
}


def saved(state) -> str:
    """A machine's fields by name."""
    return json.dumps({f.name: list(x) if isinstance(x := getattr(state, f.name), deque) else x for f in fields(state)})


def restored(kind, options: dict, text: str):
    """The machine with what text has of its fields; others are as in a new one."""
    state, known = kind(**options), json.loads(text)
    for f in fields(state):
        if f.name in known:
            setattr(state, f.name, deque(known[f.name]) if isinstance(getattr(state, f.name), deque) else known[f.name])
    return state


def _given(state, value) -> list:
    return state.flush() if value is None or value != value else state.feed(value)


def over_table(df: DataFrame, machine: str, column: str, **options) -> DataFrame:
    """media_id, seq and what the machine gives out at that row; what it holds at the end comes with the last row's seq."""
    kind, made = MACHINES[machine]

    def step(rows):
        state = kind(**options)
        for r in rows:
            for x in _given(state, r[column]):
                yield (r["seq"], *x)
        for x in state.flush():
            yield (rows[-1]["seq"], *x)

    return fold(df.select("media_id", "seq", column), "media_id", ["seq"], f"media_id long, seq long, {made}", step)


def over_stream(df: DataFrame, machine: str, column: str, *, ordered: bool = False, idle_seconds: float | None = None, **options) -> DataFrame:
    """The same over a stream, with the machine's state kept per media_id between micro-batches."""
    from pyspark.sql.streaming import StatefulProcessor

    kind, made = MACHINES[machine]
    names = ["media_id", "seq", *(x.split()[0] for x in made.split(", "))]

    class Processor(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("machine", "fields string, seq long")
            self.waiting = handle.getMapState("waiting", "seq long", "value string") if ordered else None

        def _machine(self):
            text, seq = self.state.get() if self.state.exists() else (None, -1)
            return (restored(kind, options, text) if text else kind(**options)), seq

        def _in_turn(self, rows, last):
            """The rows whose turn it is after seq `last`; the others wait. One seq counts once."""
            for seq, value in rows:
                if seq > last and not self.waiting.containsKey((seq,)):
                    self.waiting.updateValue((seq,), (json.dumps(value),))
            while self.waiting.containsKey((last + 1,)):
                last += 1
                yield last, json.loads(self.waiting.getValue((last,))[0])
                self.waiting.removeKey((last,))

        def handleInputRows(self, key, rows, timers):  # noqa: N802
            import pandas as pd

            state, last = self._machine()
            frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
            given = [(int(q), None if x is None or x != x else x.item() if hasattr(x, "item") else x) for q, x in zip(frame["seq"], frame[column], strict=True)]
            out = []
            for last, value in self._in_turn(given, last) if ordered else given:
                out += [(key[0], last, *x) for x in _given(state, value)]
            self.state.update((saved(state), last))
            if idle_seconds is not None:
                for at in list(self.handle.listTimers()):
                    self.handle.deleteTimer(at)
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + int(idle_seconds * 1000))
            yield pd.DataFrame(out, columns=names)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            import pandas as pd

            state, last = self._machine()
            out = [(key[0], last, *x) for x in state.flush()]
            self.state.update((saved(state), last))
            yield pd.DataFrame(out, columns=names)

        def close(self):
            pass

    mode = "None" if idle_seconds is None else "ProcessingTime"
    return df.select("media_id", "seq", column).groupBy("media_id").transformWithStateInPandas(Processor(), f"media_id long, seq long, {made}", "Append", mode)


def rehearsals(df: DataFrame, every: float = 0.6, least: int = 8000) -> DataFrame:
    """media_id, seq, samples: when the samples in flight are to be recognised once more.

    df is a stream of media_id, seq and n, the samples that a block adds to what is in flight; a null n ends it.  A timer of
    processing time goes off `every` seconds after a block, also while the medium is silent; if more than `least` samples wait
    then, and some came since the last time, their number is given out.
    """
    from pyspark.sql.streaming import StatefulProcessor

    names = ["media_id", "seq", "samples"]

    class Processor(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("in_flight", "samples long, done long, seq long")

        def handleInputRows(self, key, rows, timers):  # noqa: N802
            import pandas as pd

            samples, done, last = self.state.get() if self.state.exists() else (0, 0, -1)
            frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
            for seq, n in zip(frame["seq"], frame["n"], strict=True):
                samples, done, last = (0, 0, int(seq)) if n is None or n != n else (samples + int(n), done, int(seq))
            self.state.update((samples, done, last))
            if samples and not list(self.handle.listTimers()):
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + int(every * 1000))
            yield pd.DataFrame([], columns=names)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            import pandas as pd

            samples, done, last = self.state.get()
            due = samples > least and samples != done
            if due:
                self.state.update((samples, samples, last))
            yield pd.DataFrame([(key[0], last, samples)] if due else [], columns=names)

        def close(self):
            pass

    return df.select("media_id", "seq", "n").groupBy("media_id").transformWithStateInPandas(Processor(), "media_id long, seq long, samples long", "Append", "ProcessingTime")


def committed(rows: DataFrame) -> DataFrame:
    """media_id, seq, n, source of rows (media_id, seq, text, before): phrases as they are committed, without what the one
    before said, cut into sentences, those with content kept; over a table or a stream."""
    trimmed = rows.select("media_id", "seq", tx.overlap_trim(F.col("before"), F.col("text")).alias("text"))
    cut = F.pandas_udf(lambda texts: texts.map(lambda x: sentences(x or "")), "array<string>")(F.col("text"))
    return trimmed.select("media_id", "seq", F.posexplode(cut).alias("n", "source")).where(tx.has_content(F.col("source")))


def while_running(rows: DataFrame, pauses: Column, resumes: Column) -> DataFrame:
    """rows (media_id, seq, ...) that come while the last control before them, or in them, is no pause."""
    control = F.when(pauses, False).when(resumes, True)
    last = F.last(control, ignorenulls=True).over(Window.partitionBy("media_id").orderBy("seq"))
    return rows.withColumn("on", F.coalesce(last, F.lit(True))).where("on").drop("on")


def in_order(results: DataFrame) -> DataFrame:
    """results (media_id, idx, arrived) with given_at: a result waits for all of smaller index."""
    return results.withColumn("given_at", F.max("arrived").over(Window.partitionBy("media_id").orderBy("idx")))

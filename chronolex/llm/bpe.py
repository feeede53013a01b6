"""Byte-level BPE: encoding and decoding as relational queries that DuckDB runs inside each Spark partition.

Encoding follows the rank files: a text is cut by a pattern into pieces; a piece that is itself in the vocabulary is
one token; every other piece starts as its bytes and the adjacent pair of least rank (the leftmost of equals) is
contracted until no pair is in the vocabulary.  In DuckDB that is a recursive query that joins the new pairs of each
step with the merge table.  Decoding joins the ids with the vocabulary and aggregates the bytes in the order of positions.

Words of up to SHORT_WORD bytes contract one pair a step (CONTRACT): a row is a word with its tokens and the ranks of its
pairs, of which a step changes two, and a word that has no pair left leaves the query.  Longer pieces are first cut
where no token of the vocabulary matches the bytes on both sides, which no contraction can cross.  A step of theirs (CONTRACT_LONG) contracts
all places of a word's least rank at once, from the left and without overlaps, up to the first place whose new
neighbours have a lower rank, as those would be next; so a long run of one letter takes as many steps as ranks.  Such a query
keeps the rows of each of its steps, so its steps are bounded by its rows (QUERY_ROWS), and the next query goes on.

Defined results: a null text counts as empty and gives no tokens; empty texts give an empty list; repeated rows are
encoded each for itself; other columns of the input are kept, and an output column replaces one of the same name; an
empty table gives no rows.  Long texts are processed whole: pieces are collected for SLICE_CHARS characters at a time,
so that memory follows the slice and the longest text, not the batch.
"""

from __future__ import annotations

import base64
import hashlib
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolex.llm.common import returning

#: Characters of text whose pieces and tokens are in memory at a time.
SLICE_CHARS = 500_000
#: Pieces whose tokens a worker remembers between batches.
CACHE_PIECES = 120_000

#: Words up to this are contracted pair by pair.
SHORT_WORD = 64
#: Rows of all steps that one run of CONTRACT_LONG keeps, 50 bytes each.
QUERY_ROWS = 600_000
#: Bytes of the short words of one query.
QUERY_BYTES = 200_000

# A row: a word, its tokens, and the rank that each of its pairs of neighbours would become (NONE: no token).
NONE = 2**31 - 1
CONTRACT = f"""
WITH RECURSIVE t AS (
  SELECT wid, toks, ranks FROM start
  UNION ALL
  SELECT q.wid, q.toks[:q.i - 1] || [q.m] || q.toks[q.i + 2:],
         q.ranks[:greatest(q.i - 2, 0)]
         || CASE WHEN q.i > 1 THEN [coalesce(a.merged, {NONE})::INTEGER] ELSE []::INTEGER[] END
         || CASE WHEN q.i < len(q.ranks) THEN [coalesce(b.merged, {NONE})::INTEGER] ELSE []::INTEGER[] END
         || q.ranks[q.i + 2:]
  FROM (SELECT *, list_position(ranks, m) AS i FROM (SELECT *, list_min(ranks) AS m FROM t) WHERE m < {NONE}) q
  LEFT JOIN merges a ON a.pair = CASE WHEN q.i > 1 THEN q.toks[q.i - 1]::BIGINT << 32 | q.m END
  LEFT JOIN merges b ON b.pair = q.m::BIGINT << 32 | q.toks[q.i + 2]
)
SELECT wid, toks FROM t WHERE coalesce(list_min(ranks), {NONE}) = {NONE}
"""
# A row: position p (piece << 40 | offset), and token. place: of a pair in its run of overlapping pairs; rows of a word in order.
CONTRACT_LONG = """
WITH RECURSIVE t AS (
  SELECT p, tok, 0 AS step FROM start
  UNION ALL
  SELECT p, CASE WHEN chosen THEN m ELSE tok END, step + 1
  FROM (
    SELECT *, coalesce(lag(chosen) OVER w, false) AS eaten
    FROM (
      SELECT *, c AND coalesce(bool_or(bad) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) = false AS chosen
      FROM (
        SELECT y.*, y.c AND (coalesce(a.merged, y.m) < y.m OR coalesce(b.merged, y.m) < y.m) AS bad
        FROM (
          SELECT *, CASE WHEN lag(c, 2) OVER w THEN m ELSE lag(tok) OVER w END AS before, lead(tok, 2) OVER w AS after
          FROM (
            SELECT *, hit AND (k - coalesce(max(CASE WHEN hit THEN NULL ELSE k END) OVER (w ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1 AS c
            FROM (
              SELECT *, coalesce(r = m, false) AS hit
              FROM (
                SELECT x.p, x.tok, x.step, x.k, g.merged AS r, min(g.merged) OVER (PARTITION BY x.p >> 40) AS m
                FROM (SELECT *, lead(tok) OVER w AS nxt, row_number() OVER w AS k FROM t WHERE step < {steps} WINDOW w AS (PARTITION BY p >> 40 ORDER BY p)) x
                LEFT JOIN merges g ON g.pair = (x.tok << 32 | x.nxt)
              ) WHERE m IS NOT NULL
            ) WINDOW w AS (PARTITION BY p >> 40 ORDER BY p)
          ) WINDOW w AS (PARTITION BY p >> 40 ORDER BY p)
        ) y
        LEFT JOIN merges a ON y.c AND a.pair = (y.before << 32 | y.m)
        LEFT JOIN merges b ON y.c AND b.pair = (y.m << 32 | y.after)
      ) WINDOW w AS (PARTITION BY p >> 40 ORDER BY p)
    ) WINDOW w AS (PARTITION BY p >> 40 ORDER BY p)
  ) WHERE NOT eaten
), last AS (SELECT p >> 40 AS wid, max(step) AS step FROM t GROUP BY 1)
SELECT t.p, t.tok, t.step FROM t JOIN last l ON l.wid = t.p >> 40 AND l.step = t.step ORDER BY t.p
"""
# chars has a character for each byte.
DECODE = """
SELECT i.p >> 32 AS doc, string_agg(v.chars, '' ORDER BY i.p) AS chars FROM ids i JOIN vocab v USING (tok) GROUP BY 1
"""


#: Texts without characters from here on are cut by the standard library's faster engine.
PLAIN_BELOW = 0x250


def pieces_finder(pattern: str):
    r"""A function from a text to its pieces.

    \s in the rank files' library is Unicode white space, which leaves out U+001C to U+001F.  For texts below
    PLAIN_BELOW the classes are spelled out from the Unicode categories, which `re` can use.
    """
    import re
    import unicodedata

    import regex

    full = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
    plain = [chr(c) for c in range(PLAIN_BELOW)]
    space = "".join(c for c in plain if regex.match(r"\p{White_Space}", c))
    classes = {r"\p{L}": [c for c in plain if unicodedata.category(c)[0] == "L"], r"\p{N}": [c for c in plain if unicodedata.category(c)[0] == "N"]}
    own = pattern.replace(r"[^\s", "[^" + space).replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")
    for name, chars in classes.items():
        text = "".join(chars)
        own = re.sub(rf"(?<!\[){re.escape(name)}(?![^\[]*\])", lambda _, text=text: f"[{text}]", own)
        own = own.replace(name, text)
    if regex.search(r"\\[a-zA-Z]", own):
        return full
    find, other = re.compile(own).findall, re.compile(f"[{chr(PLAIN_BELOW)}-\U0010ffff]").search
    return lambda text: full(text) if other(text) else find(text)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


FACTOR = 0x9E3779B97F4A7C15


def split_at(tokens, words, n: int) -> list[bytes]:
    """The tokens of each of n words, whose numbers are in order."""
    import numpy as np

    values = tokens.astype("<u4")
    ends = np.searchsorted(words, np.arange(n + 1)).tolist()
    return [values[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]


class Codec:
    """The merge table and vocabulary of one rank file in an in-memory DuckDB database of this Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import numpy as np
        import pyarrow as pa

        self.ranks = ranks
        self.find = pieces_finder(pattern)
        self.byte = [ranks[bytes([b])] for b in range(256)]
        pair, merged = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    pair.append(a << 32 | b), merged.append(rank)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "150MB", "temp_directory": tempfile.gettempdir(), "preserve_insertion_order": False})
        for name, data in (
            ("merges", {"pair": pair, "merged": merged}),
            ("vocab", {"tok": list(ranks.values()), "chars": [t.decode("latin-1") for t in ranks]}),
        ):
            rows = pa.table({k: pa.array(v, pa.string() if k == "chars" else pa.int64()) for k, v in data.items()})
            self.db.register("rows", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
            self.db.unregister("rows")
        self.pairs = np.full((256, 256), NONE, np.int32)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0], token[1]] = rank
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.beginnings: dict = {}

    @classmethod
    def of(cls, sent: dict) -> Codec:
        """The codec of a broadcast {"raw", "pattern"}, made once in each worker and kept in it, so that it goes when Spark lets
        the broadcast go."""
        if "codec" not in sent:
            sent["codec"] = cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in sent["raw"].splitlines() if x.strip())}, sent["pattern"])
        return sent["codec"]

    def rows_of(self, words: list[bytes]):
        """(p, tok) of the bytes of words, and where each word ends."""
        import numpy as np

        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        at = np.repeat(np.arange(len(words)) << 40, lengths) + np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
        return at, np.array(self.byte, np.int64)[np.frombuffer(b"".join(words), np.uint8)], ends

    def run(self, query: str, **columns):
        import pyarrow as pa

        self.db.register("start", pa.table(columns))
        got = self.db.sql(query).to_arrow_table()
        self.db.unregister("start")
        return got

    def contract(self, words: list[bytes]) -> list[bytes]:
        """The tokens of each short word, as little-endian unsigned 32-bit integers."""
        import numpy as np
        import pyarrow as pa

        starts = np.zeros(len(words) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, words), np.int32, len(words)), out=starts[1:])
        codes = np.frombuffer(b"".join(words), np.uint8)
        ranks = np.delete(self.pairs[codes, np.append(codes[1:], 0)], starts[1:] - 1)
        lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at), pa.array(values))
        got = self.run(CONTRACT, wid=np.arange(len(words)), toks=lists(starts, np.array(self.byte, np.int32)[codes]), ranks=lists(starts - np.arange(len(starts), dtype=np.int32), ranks))
        out = [b""] * len(words)
        for some in got.to_batches():
            toks = some["toks"]
            values, ends = toks.values.to_numpy().astype("<u4").tobytes(), (toks.offsets.to_numpy() * 4).tolist()
            for wid, a, b in zip(some["wid"].to_pylist(), ends, ends[1:], strict=False):
                out[wid] = values[a:b]
        return out

    def contract_long(self, words: list[bytes]) -> list[bytes]:
        """The same for words of any length, by as many queries as their steps need."""
        import numpy as np

        at, tok, _ = self.rows_of(words)
        done: list = []
        while len(at):
            steps = max(1, QUERY_ROWS // len(at))
            got = self.run(CONTRACT_LONG.format(steps=steps), p=at, tok=tok)
            at, tok, step = (got[c].to_numpy() for c in ("p", "tok", "step"))
            done.append((at[step < steps], tok[step < steps]))
            at, tok = at[step == steps], tok[step == steps]
        at, tok = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(at)
        return split_at(tok[order], at[order] >> 40, len(words))

    def cut(self, piece: bytes) -> list[bytes]:
        """piece in parts that no token reaches over: the tokens that match at each place are looked up by their hashes,
        length by length; a false match makes a part longer and changes nothing else."""
        import numpy as np

        if not self.beginnings:
            full: dict = {}
            first: dict = {}
            for token in self.ranks:
                h = token[0] + 1
                for n, c in enumerate(token[1:], 2):
                    h = (h * FACTOR + c + 1) & (2**64 - 1)
                    first.setdefault(n, set()).add(h)
                if len(token) > 1:
                    full.setdefault(len(token), set()).add(h)
            ordered = lambda x: np.array(sorted(x), np.uint64)
            self.beginnings = {n: (ordered(first[n]), ordered(full.get(n, ()))) for n in sorted(first)}
        known = lambda h, table: table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h if len(table) else np.zeros(len(h), bool)
        codes = np.frombuffer(piece, np.uint8).astype(np.uint64) + np.uint64(1)
        reach, at, h = np.arange(len(piece)), np.arange(len(piece)), codes
        for n, (first, full) in self.beginnings.items():
            inside = at + n <= len(piece)
            at, h = at[inside], h[inside]
            h = h * np.uint64(FACTOR) + codes[at + n - 1]
            there = known(h, first)
            at, h = at[there], h[there]
            if not len(at):
                break
            whole = at[known(h, full)]
            reach[whole] = whole + n - 1
        ends = np.flatnonzero(np.maximum.accumulate(reach) == np.arange(len(piece))) + 1
        return [piece[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def tokens_of(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each of the words, none of them a token, with its tokens."""
        short, long = [x for x in words if len(x) <= SHORT_WORD], [x for x in words if len(x) > SHORT_WORD]
        for some, work, most in ((short, self.contract, QUERY_BYTES), (long, self.contract_long, QUERY_ROWS // 8)):
            for run in slices(some, most):
                batch = [some[i] for i in run]
                yield from zip(batch, work(batch), strict=True)

    def learn(self, words: set[str]) -> None:
        """Tokens of the words into known. When known is full, words that were met since it was last emptied are still found in older."""
        if len(self.known) >= CACHE_PIECES // 2:
            self.known, self.older = {}, self.known
        known, older, ranks = self.known, self.older, self.ranks
        short, long = {}, {}
        for w in words:
            if w in known:
                continue
            if (ids := older.get(w)) is not None:
                known[w] = ids
                continue
            piece = w.encode()
            if (rank := ranks.get(piece)) is not None:
                known[w] = rank.to_bytes(4, "little")
            elif len(piece) <= SHORT_WORD:
                short[piece] = w
            else:
                long[w] = self.cut(piece)
        for piece, ids in self.tokens_of(list(short)):
            known[short[piece]] = ids
        parts = {x for some in long.values() for x in some}
        tokens = {x: ranks[x].to_bytes(4, "little") for x in parts if x in ranks}
        tokens.update(self.tokens_of([x for x in parts if x not in tokens]))
        for w, some in long.items():
            known[w] = b"".join(map(tokens.__getitem__, some))

    def encode(self, texts: list[str]) -> list[bytes]:
        found = [self.find(x) for x in texts]
        self.learn(set().union(*found) if found else set())
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in found]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        import numpy as np
        import pyarrow as pa

        lengths = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        tok = np.frombuffer(b"".join(ids), "<u4")
        starts = np.cumsum(lengths) - lengths
        self.db.register("ids", pa.table({"p": np.repeat(np.arange(len(ids)) << 32, lengths) + np.arange(len(tok)) - np.repeat(starts, lengths), "tok": tok.astype(np.int64)}))
        rows = self.db.sql(DECODE).fetchall()
        self.db.unregister("ids")
        out = [b""] * len(ids)
        for doc, chars in rows:
            out[doc] = chars.encode("latin-1")
        return out


def slices(texts: list[str] | list[bytes], most: int) -> Iterator[list[int]]:
    """Positions of texts in runs of at most so many characters; a longer text is a run of its own."""
    run, size = [], 0
    for i, x in enumerate(texts):
        if run and size + len(x) > most:
            yield run
            run, size = [], 0
        run.append(i)
        size += len(x)
    if run:
        yield run


def _mapped(df: DataFrame, made: dict[str, T.DataType], work, drop: str = "") -> DataFrame:
    """df with the columns `made`, which work(frame) computes for small pandas frames of it."""
    kept = [f for f in df.schema.fields if f.name not in made and f.name != drop]
    schema = T.StructType([*kept, *(T.StructField(k, v) for k, v in made.items())])

    @returning
    def run(frames):
        for frame in frames:
            yield from (x[[f.name for f in schema.fields]] for x in work(frame))

    return df.mapInPandas(run, schema)


def _coded(df: DataFrame, ranks_path: str, pattern: str, column: str, made: dict[str, T.DataType], work, drop: str = "") -> DataFrame:
    """df with the columns `made`, which work(codec, values) gives for some values of the column, null ones as empty.

    The rank file is read on the driver and sent with the task; its size is the vocabulary's, whatever the input's.
    """
    with open(ranks_path, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast({"raw": f.read(), "pattern": pattern})

    def run(frame):
        codec = Codec.of(sent.value)
        values = [x if isinstance(x, (str, bytes, bytearray)) else "" for x in frame[column]]
        for part in slices(values, SLICE_CHARS):
            yield frame.iloc[part].drop(columns=drop or []).assign(**work(codec, [values[i] for i in part]))

    return _mapped(df, made, run, drop=drop)


def encode(df: DataFrame, ranks_path: str, pattern: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with ids_col: the ids of the whole text as little-endian unsigned 32-bit integers (binary), without special tokens."""
    return _coded(df, ranks_path, pattern, text_col, {ids_col: T.BinaryType()}, lambda codec, texts: {ids_col: codec.encode(texts)})


def decode(df: DataFrame, ranks_path: str, pattern: str, *, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """df with bytes_col: the bytes that the ids stand for (binary). Null ids count as none."""
    return _coded(df, ranks_path, pattern, ids_col, {bytes_col: T.BinaryType()}, lambda codec, ids: {bytes_col: codec.decode([x or b"" for x in ids])})


def token_digests(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256, by encoding and decoding the whole text in one pass."""

    def work(codec, texts):
        ids = codec.encode(texts)
        return {"n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in codec.decode(ids)]}

    made = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    return _coded(df.select("doc_id", "text"), ranks_path, pattern, "text", made, work, drop="text")


def encode_checked(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """df without text, with n_tokens, ids (as encode()) and round_trip: whether the ids decode to the text's bytes."""

    def work(codec, texts):
        ids = codec.encode(texts)
        return {"n_tokens": [len(x) // 4 for x in ids], "ids": ids, "round_trip": [t.encode() == b for t, b in zip(texts, codec.decode(ids), strict=True)]}

    return _coded(df, ranks_path, pattern, "text", {"n_tokens": T.LongType(), "ids": T.BinaryType(), "round_trip": T.BooleanType()}, work, drop="text")

"""WAV and SubRip as data sources of Spark: `spark.dataSource.register`, then `format("wav")` and `format("srt")`.

Tasks write to names that nobody reads; when all are done the driver moves the files of those that count to their places, and
when one fails for good it deletes them all, so a reader sees the whole of a write or nothing.  Readers cut files into
partitions: long WAV files by ranges of samples, SubRip files by their number.  Paths are those of `pyarrow.fs`: local ones,
file:, hdfs:, s3:, gs:.

wav: columns file, media_id, sample_idx, v.  A medium's samples stand in one or more files `<media_id>-<first sample>.wav`, a
file for each run of samples that a task gets, so a long medium is written by many tasks.  Other WAV files are read from sample
0 with a null media_id; channels are averaged.  Options: encoding (pcm16, float32, float64; samples of pcm16 are cut to -1 to 1),
rate, partitionSamples.  Null samples are silence.

srt: columns media_id (text), idx, start, end, text.  A file `<media_id>.srt` for each medium, which one task must hold, so the
cues are to be dealt by media_id and sorted; `write_srt` does.  Option: partitionFiles.
"""

from __future__ import annotations

import re
import struct
import urllib.parse
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from chronolex.functions import tokens as tk

TEMPORARY = "_temporary-"
#: Encodings: the format's number in the header, bytes of a sample, its type in memory.
ENCODINGS = {"pcm16": (1, 2, "<i2"), "float32": (3, 4, "<f4"), "float64": (3, 8, "<f8")}
FULL = 32767.0
#: Bytes after which a task begins another file: what it holds at a time.
FILE_BYTES = 1 << 26
#: Samples and files that a partition reads, samples that are in memory at a time.
PARTITION_SAMPLES, PARTITION_FILES, BLOCK = 8_000_000, 200, 1 << 18


def _fs(path: str):
    from pyarrow import fs

    path = re.sub("^file:/+", "file:///", path)
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


def _files(path: str, ending: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files under path, or of path itself, without what is being written."""
    from pyarrow import fs

    system, base = _fs(path)
    info = system.get_file_info(base)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.endswith(ending) and TEMPORARY not in x.path)


@dataclass
class Written(WriterCommitMessage):
    """Names under the temporary folder, and what they become."""

    names: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    ending = ""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite
        self.path = options["path"].rstrip("/")
        self.temporary = f"{TEMPORARY}{uuid.uuid4().hex}"

    def create(self, name: str):
        """(temporary name, open file) for the file `name`."""
        system, base = _fs(self.path)
        system.create_dir(f"{base}/{self.temporary}", recursive=True)
        own = uuid.uuid4().hex
        return own, system.open_output_stream(f"{base}/{self.temporary}/{own}")

    def commit(self, messages) -> None:
        system, base = _fs(self.path)
        system.create_dir(base, recursive=True)
        if self.overwrite:
            for path, _ in _files(self.path, self.ending):
                system.delete_file(path)
        for message in messages:
            for own, name in message.names if message else ():
                system.move(f"{base}/{self.temporary}/{own}", f"{base}/{name}")
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, base = _fs(self.path)
        if system.get_file_info(f"{base}/{self.temporary}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.temporary}")


def wav_header(n: int, rate: int, encoding: str) -> bytes:
    number, size, _ = ENCODINGS[encoding]
    data = n * size
    return b"RIFF" + struct.pack("<I", min(36 + data, 0xFFFFFFFF)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, number, 1, rate, rate * size, size, 8 * size) + b"data" + struct.pack("<I", min(data, 0xFFFFFFFF))


def wav_layout(head: bytes, size: int) -> tuple[int, int, int, str]:
    """(place of the samples, frames, channels, encoding) from a file's beginning and its bytes."""
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(head):
        name, length = head[at : at + 4], struct.unpack("<I", head[at + 4 : at + 8])[0]
        if name == b"fmt ":
            number, channels = struct.unpack("<HH", head[at + 8 : at + 12])
            bits = struct.unpack("<H", head[at + 22 : at + 24])[0]
            number = struct.unpack("<H", head[at + 32 : at + 34])[0] if number == 0xFFFE else number  # the extensible form's own number
            form = next((k for k, (n, b, _) in ENCODINGS.items() if (n, 8 * b) == (number, bits)), None)
            if form is None:
                raise ValueError(f"WAV of format {number} with {bits} bits is not read")
        elif name == b"data":
            if form is None:
                raise ValueError("a WAV file's samples stand before their format")
            frame = ENCODINGS[form][1] * channels
            return at + 8, min(length, size - at - 8) // frame, channels, form
        at += 8 + length + length % 2
    raise ValueError("a WAV file without samples in its first bytes")


class WavWriter(_Writer):
    ending = ".wav"

    def write(self, iterator):
        import numpy as np

        encoding, rate = self.options.get("encoding", "pcm16"), int(self.options.get("rate", "16000"))
        kind = ENCODINGS[encoding][2]
        names, media, first, follow, out, held = [], None, 0, 0, None, []

        def ended():
            """The run that is open, as a file; its samples wait encoded, as the header tells their number."""
            if held:
                own, file = self.create("")
                with file:
                    file.write(wav_header(follow - first, rate, encoding))
                    for part in held:
                        file.write(part)
                names.append((own, f"{media}-{first:012d}.wav"))
                held.clear()

        for batch in iterator:
            ids, at = batch.column("media_id").to_numpy(zero_copy_only=False), batch.column("sample_idx").to_numpy(zero_copy_only=False)
            v = batch.column("v").fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64)
            raw = np.rint(np.clip(np.nan_to_num(v), -1, 1) * FULL).astype(kind) if encoding == "pcm16" else v.astype(kind)
            cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(at) != 1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                if a == b:
                    continue
                if not held or ids[a] != media or at[a] != follow or (follow - first) * raw.itemsize >= FILE_BYTES:
                    ended()
                    media, first = int(ids[a]), int(at[a])
                held.append(raw[a:b].tobytes())
                follow = int(at[b - 1]) + 1
        ended()
        return Written(names)


@dataclass
class Samples(InputPartition):
    path: str
    offset: int
    count: int
    first: int
    media: int | None
    channels: int
    encoding: str


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("partitionSamples", PARTITION_SAMPLES))

    def partitions(self):
        system, _ = _fs(self.path)
        out = []
        for path, size in _files(self.path, ".wav"):
            with system.open_input_file(path) as f:
                at, frames, channels, encoding = wav_layout(f.read(4096), size)
            own = re.fullmatch(r"(-?\d+)-(\d+)\.wav", path.rsplit("/", 1)[-1])
            media, first = (int(own[1]), int(own[2])) if own else (None, 0)
            frame = ENCODINGS[encoding][1] * channels
            out += [Samples(path, at + k * frame, min(self.size, frames - k), first + k, media, channels, encoding) for k in range(0, frames, self.size)]
        return out or [Samples("", 0, 0, 0, None, 1, "pcm16")]

    def read(self, part):
        import numpy as np
        import pyarrow as pa

        if not part.count:
            return
        kind = ENCODINGS[part.encoding][2]
        frame = ENCODINGS[part.encoding][1] * part.channels
        with _fs(self.path)[0].open_input_file(part.path) as f:
            f.seek(part.offset)
            for k in range(0, part.count, BLOCK):
                n = min(BLOCK, part.count - k)
                v = np.frombuffer(f.read(n * frame), kind).astype(np.float64).reshape(n, part.channels)
                v = (v[:, 0] if part.channels == 1 else v.mean(axis=1)) / (FULL if part.encoding == "pcm16" else 1.0)
                at = np.arange(part.first + k, part.first + k + n)
                media = pa.nulls(n, pa.int64()) if part.media is None else pa.array(np.full(n, part.media))
                yield pa.record_batch([pa.array([part.path] * n), media, pa.array(at), pa.array(v)], names=["file", "media_id", "sample_idx", "v"])


class Wav(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return "file string, media_id long, sample_idx long, v double"

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)

    def writer(self, schema, overwrite: bool) -> WavWriter:
        return WavWriter(self.options, overwrite)


def write_wav(samples: DataFrame, path: str, **options) -> None:
    """samples (media_id, sample_idx, v) under path; tasks get ranges, so that long media are spread."""
    rows = samples.select("media_id", "sample_idx", F.col("v").cast("double").alias("v")).repartitionByRange("media_id", "sample_idx").sortWithinPartitions("media_id", "sample_idx")
    rows.write.format("wav").options(**options).mode("append").save(path)


def seconds(text: str) -> float | None:
    """Of H:M:S with a comma or a point; None unless there are three parts in their ranges."""
    parts = text.strip().replace(",", ".").split(":")
    try:
        h, m, at = map(float, parts)
    except ValueError:
        return None
    return h * 3600 + m * 60 + at if 0 <= h < 1e6 and 0 <= m < 60 and 0 <= at < 60 else None


def parse_srt(text: str) -> list[tuple[float, float, str]]:
    """(start, end, text) of the blocks of a file that have times and text; markup goes."""
    text = re.sub("\r\n?", "\n", text).removeprefix("﻿")
    out = []
    for block in re.split(r"\n{2,}", re.sub(r"(?m)^[ \t]+$", "", text)):
        lines = block.strip("\n").split("\n")
        at = 0 if "-->" in lines[0] else 1
        if len(lines) <= at or "-->" not in lines[at]:
            continue
        start, _, end = lines[at].partition("-->")
        start, end = seconds(start), seconds((end.split() or [""])[0])
        plain = [y for x in lines[at + 1 :] if (y := re.sub("<[^>]*>", "", x).strip(" "))]
        if start is not None and end is not None and plain:
            out.append((start, start + 0.2 if end <= start else end, ("" if any(map(tk.dense_letter, plain)) else " ").join(plain)))
    return out


def stamp(at: float) -> str:
    ms = max(0, round(at * 1000))
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d},{ms % 1000:03d}"


class SrtWriter(_Writer):
    ending = ".srt"

    def write(self, iterator):
        names, media, n, file = [], None, 0, None
        for batch in iterator:
            for row in batch.to_pylist():
                if file is None or row["media_id"] != media:
                    if file is not None:
                        file.close()
                    media, n = row["media_id"], 0
                    own, file = self.create("")
                    names.append((own, f"{urllib.parse.quote(str(media), safe=' ')}.srt"))
                if tk.has_content(row["text"] or ""):
                    n += 1
                    file.write(f"{n}\n{stamp(row['start'])} --> {stamp(row['end'])}\n{row['text']}\n\n".encode())
        if file is not None:
            file.close()
        return Written(names)


@dataclass
class Files(InputPartition):
    paths: list[str]


class SrtReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("partitionFiles", PARTITION_FILES))

    def partitions(self):
        paths = [p for p, _ in _files(self.path, ".srt")]
        return [Files(paths[k : k + self.size]) for k in range(0, max(1, len(paths)), self.size)]

    def read(self, part):
        system, _ = _fs(self.path)
        for path in part.paths:
            with system.open_input_file(path) as f:
                raw = f.read()
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                text = raw.decode("latin-1")
            media = urllib.parse.unquote(path.rsplit("/", 1)[-1].removesuffix(".srt"))
            for i, (start, end, shown) in enumerate(parse_srt(text)):
                yield media, i + 1, start, end, shown


class Srt(DataSource):
    @classmethod
    def name(cls) -> str:
        return "srt"

    def schema(self) -> str:
        return "media_id string, idx int, start double, end double, text string"

    def reader(self, schema) -> SrtReader:
        return SrtReader(self.options)

    def writer(self, schema, overwrite: bool) -> SrtWriter:
        return SrtWriter(self.options, overwrite)


def write_srt(cues: DataFrame, path: str) -> None:
    """cues (media_id, idx, start, end, text) as a file for each medium under path."""
    rows = cues.select(F.col("media_id").cast("string").alias("media_id"), F.col("idx").cast("int").alias("idx"), "start", "end", "text")
    rows.repartition("media_id").sortWithinPartitions("media_id", "start", "idx").write.format("srt").mode("append").save(path)


def register(spark) -> None:
    spark.dataSource.register(Wav)
    spark.dataSource.register(Srt)

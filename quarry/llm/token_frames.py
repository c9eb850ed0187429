"""Token ids in files of independent zstandard frames that end in a seek table.

A file is::

    frame ...            little-endian unsigned 32-bit ids, no frame holds two documents
    skippable frame      zstandard: ids of the documents, which are null, and tokens of each
    skippable frame      seek table: per frame its compressed size, its size and its checksum

The seek table has the layout of the public zstandard seekable format (a skippable frame
that ends in the number of frames, a descriptor and a magic number), and its checksums are
the low 32 bits of XXH64 of a frame's content; so plain zstandard tools decompress a
file, and seekable readers can use it. A document's frames hold :data:`FRAME_IDS` ids
each but for the last, so a reader finds them from the token counts and decompresses
those alone.

Documents are ordered by ``doc_id`` (null first; equal ids by a hash of their text):
Spark range-partitions and sorts them, and each task tokenises and writes its part as
one or more files. Each attempt of a task writes files of new names. What counts is
the manifest, one row per file, that Spark commits once per task: files of lost or
repeated attempts are in no manifest and are never read.

Edge cases: a null or empty text is the end id alone; rows without an id come first, all
repeated rows are written; an empty table gives an empty manifest; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0  # appended to every document
FRAME_IDS = 1 << 20  # ids of a frame at most
FILE_IDS = 1 << 28  # a file ends with the document that reaches so many ids
FILE_FRAMES = 1 << 20  # or so many frames
TASK_BYTES = 256 << 20  # estimated bytes of input for one task
KNOWN_PIECES = 300_000  # pieces whose ids a worker keeps, twice
CHUNK_BYTES = 8 << 20  # of texts encoded together

# fixed values: magic numbers of the public format
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEK_TABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

MANIFEST = "part int, file string, seq int, n_docs long, n_tokens long, first_id long, last_id long, has_null boolean"


# kinds of bytes: ASCII letters and digits, printable signs, spaces, other ASCII; 0 from 128 on
_WORD, _SIGN, _SPACE, _OTHER = 1, 2, 4, 8
_KIND = np.zeros(256, np.uint8)
_KIND[:128] = _OTHER
_KIND[[b for b in range(33, 127)]] = _SIGN
_KIND[[b for b in range(128) if chr(b).isalnum()]] = _WORD
_KIND[list(b" \t\r\n")] = _SPACE
# first bytes of two that are letters but for two signs: U+00C0 to U+027F and Cyrillic
_LETTER_LEAD = np.zeros(256, bool)
_LETTER_LEAD[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = True


def piece_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places, 0 and the texts' ``begins`` among them, where UTF-8 bytes can be cut: after a letter or a digit that an
    ASCII sign or space follows, and before an ASCII space that follows no space.

    The vocabulary's own splitting pattern always ends a match there and never looks back,
    so the pieces' ids, one after the other, are the text's ids. Where a character's
    class could depend on the Unicode version there is no cut; that only makes pieces longer.
    """
    kind = _KIND[data]
    wordy = kind == _WORD
    solid = (kind & (_WORD | _SIGN)) > 0
    if (data >= 0x80).any():
        tail = (data & 0xC0) == 0x80  # the last byte of a character, where ASCII follows
        letter = tail[1:] & _LETTER_LEAD[data[:-1]]
        letter &= ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        wordy[1:] |= letter
        solid[1:] |= tail[1:] & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)  # no space has such a first byte
        solid[2:] |= tail[2:] & (data[:-2] >= 0xE4) & (data[:-2] < 0xF0)
        solid[3:] |= tail[3:] & (data[:-3] >= 0xF0)
    cut = np.ones(len(data), bool)
    cut[1:] = wordy[:-1] & (kind[1:] > _WORD) | solid[:-1] & (kind[1:] == _SPACE)
    cut[begins] = True
    return np.flatnonzero(cut)


class Encoder:
    """Whole texts to little-endian ids, with a tokenizer file of the tokenizers library.

    Arrow finds the distinct pieces of a chunk of texts, and only those are looked up and,
    where new, encoded. Remembered are the last :data:`KNOWN_PIECES` to :data:`KNOWN_PIECES`
    times two that were new or asked for again. Strings of special tokens in a text are
    ordinary text.
    """

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ids(self, texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, bytes]]:
        """``(place of the text, ids)`` in order: nothing for a null or empty text, several
        blocks for a long one. Chunks end between pieces, so what is held at once
        grows with the longest piece and not with the texts."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string()).fill_null("")
        buffers = texts.buffers()
        offsets = np.frombuffer(buffers[1], np.int64, len(texts) + 1, texts.offset * 8)
        at, size, step = int(offsets[0]), int(offsets[-1]), CHUNK_BYTES
        data = np.frombuffer(buffers[2], np.uint8) if size else np.zeros(0, np.uint8)
        while at < size:
            end = min(size, at + step)
            a, b = np.searchsorted(offsets, [at, end])
            starts = piece_starts(data[at:end], offsets[a:b] - at)
            if end < size:  # the last piece may go on
                if len(starts) == 1:
                    step *= 2
                    continue
                end, starts = at + int(starts[-1]), starts[:-1]
            step = CHUNK_BYTES
            ids, counts = self._encoded(data[at:end], np.append(starts, end - at))
            first = np.searchsorted(offsets, at, "right") - 1
            last = np.searchsorted(offsets, end, "left")
            ends = np.minimum(offsets[first + 1 : last + 1], end) - at
            cuts = counts[np.searchsorted(starts, ends)]
            lo = 0
            for i, hi in zip(range(int(first), int(last)), cuts.tolist()):
                if hi > lo:
                    yield i, ids[lo:hi].tobytes()
                lo = hi
            at = end

    def _encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces, and how many there are before each piece and in all."""
        pieces = pa.LargeStringArray.from_buffers(
            len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)
        ).dictionary_encode()
        distinct, places = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy()
        known, older = self.known, self.older
        missing = set(distinct).difference(known)
        new = missing.difference(older)
        known.update((p, older[p]) for p in missing - new)
        new = list(new)
        for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            known[p] = array("I", e.ids).tobytes()
        found = [known[p] for p in distinct]
        if len(known) > KNOWN_PIECES:
            self.known, self.older = {}, known
        table = np.frombuffer(b"".join(found), "<u4")
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        size, begin = n[places], (np.cumsum(n) - n)[places]
        before = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(begin - before[:-1], size)
        at += np.arange(len(at))
        return table[at], before


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder, which later tasks of the same worker use as well."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class _File:
    """One file while it is written: frames go out at once, tables are kept till the end."""

    def __init__(self, folder: str, part: int, seq: int, level: int):
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.part, self.seq = part, seq
        self.name = f"{part:06d}-{seq:04d}-{uuid.uuid4().hex}.zst"
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        self.out = system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.frames = array("I")  # compressed size, size, checksum of each
        self.ids, self.nulls, self.tokens, self.total = array("q"), bytearray(), array("q"), 0

    def frame(self, content: bytes) -> None:
        import xxhash

        packed = self.compress(content)
        self.out.write(packed)
        self.frames.extend((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def document(self, doc_id: int | None, blocks: Iterator[bytes]) -> None:
        size, held = 4 * FRAME_IDS, b""
        n = 0
        for block in blocks:
            held = held + block if held else block
            n += len(block) // 4
            if len(held) >= size:
                cut = len(held) - len(held) % size
                for at in range(0, cut, size):
                    self.frame(held[at : at + size])
                held = held[cut:]
        if held:
            self.frame(held)
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.tokens.append(n)
        self.total += n

    def full(self) -> bool:
        return self.total >= FILE_IDS or len(self.frames) >= 3 * FILE_FRAMES

    def close(self) -> dict:
        n = len(self.ids)
        content = np.array(self.ids, "<i8").tobytes() + bytes(self.nulls) + np.array(self.tokens, "<i8").tobytes()
        self.out.write(_skippable(SKIPPABLE_INDEX, struct.pack("<Q", n) + self.compress(content)))
        table = np.array(self.frames, "<u4").tobytes()
        footer = struct.pack("<IBI", len(self.frames) // 3, HAS_CHECKSUMS, SEEK_TABLE_MAGIC)
        self.out.write(_skippable(SKIPPABLE_SEEK_TABLE, table + footer))
        self.out.close()
        known = [i for i, null in zip(self.ids, self.nulls) if not null]
        return {
            "part": self.part, "file": self.name, "seq": self.seq, "n_docs": n, "n_tokens": self.total,
            "first_id": known[0] if known else None, "last_id": known[-1] if known else None,
            "has_null": len(known) < n,
        }


def _writer(folder: str, vocabulary: str, level: int):
    end = struct.pack("<I", END_ID)

    def write(batches):
        known, part, seq, file = encoder(vocabulary), TaskContext.get().partitionId(), 0, None
        schema = pa.schema([
            ("part", pa.int32()), ("file", pa.string()), ("seq", pa.int32()), ("n_docs", pa.int64()),
            ("n_tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("has_null", pa.bool_()),
        ])
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            found = groupby(known.ids(batch.column("text")), key=lambda x: x[0])
            i, blocks = next(found, (-1, ()))
            for place, doc_id in enumerate(ids):
                if file is None:
                    file, seq = _File(folder, part, seq, level), seq + 1
                mine = (b for _, b in blocks) if place == i else ()
                file.document(doc_id, chain(mine, [end]))
                if place == i:
                    i, blocks = next(found, (-1, ()))
                if file.full():
                    yield pa.RecordBatch.from_pylist([file.close()], schema)
                    file = None
        if file is not None:
            yield pa.RecordBatch.from_pylist([file.close()], schema)

    return write


def tasks(docs: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Partitions for ``docs``: the session's, or more where the optimizer's estimate of
    its size asks for them (it makes none of tables that do not come from files)."""
    estimate = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = -(-estimate // task_bytes) if estimate < 1 << 50 else 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted)


def write(docs: DataFrame, vocabulary: str, path: str | None = None, level: int = 3) -> str:
    """Encode the whole texts of ``docs(doc_id, text)`` into files under ``path`` (a new
    folder of the shared one if none is given), in ascending order of doc_id; returns
    the path. ``path`` is one that all executors reach through pyarrow's file systems.

    The row number is the last key of the order, so that even equal rows without an id are
    spread over tasks.
    """
    path = path or scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    placed = rows.repartitionByRange(tasks(rows), *order).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    )
    placed.mapInArrow(_writer(f"{path}/frames", vocabulary, level), MANIFEST).write.parquet(f"{path}/manifest")
    return path


class Reader:
    """One file. ``at(i)`` gives document ``i``'s ids, reading and checking its frames only."""

    def __init__(self, folder: str, name: str):
        import zstandard

        self.decompress = zstandard.ZstdDecompressor().decompress
        system, path = fs.FileSystem.from_uri(folder)
        self.name, self.file = name, system.open_input_file(f"{path}/{name}")
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_TABLE_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError(f"{name}: no seek table")
        at = size - 9 - 12 * n
        table = np.frombuffer(self._read(at, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.checksums = table[:, 0], table[:, 2]
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        index = int(self.offsets[-1])  # the document table follows the last frame
        content = self._read(index + 8, at - 8 - (index + 8))
        (docs,) = struct.unpack("<Q", content[:8])
        content = self.decompress(content[8:], max_output_size=17 * docs)
        self.ids = np.frombuffer(content, "<i8", docs)
        self.nulls = np.frombuffer(content, np.uint8, docs, 8 * docs).astype(bool)
        self.tokens = np.frombuffer(content, "<i8", docs, 9 * docs)
        self.first_frame = np.concatenate([[0], np.cumsum(-(-self.tokens // FRAME_IDS))])
        self.starts = np.concatenate([[0], np.cumsum(self.tokens)])

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frames(self, i: int) -> Iterator[bytes]:
        import xxhash

        for k in range(int(self.first_frame[i]), int(self.first_frame[i + 1])):
            content = self.decompress(self._read(int(self.offsets[k]), int(self.sizes[k])), max_output_size=4 * FRAME_IDS)
            if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.checksums[k]:
                raise ValueError(f"{self.name}: frame {k} does not match its checksum")
            yield content

    def wanted(self, doc_ids: np.ndarray | None) -> np.ndarray:
        if doc_ids is None:
            return np.arange(len(self.ids))
        return np.flatnonzero(np.isin(self.ids, doc_ids) & ~self.nulls)


def files(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with each file's place in the order and ``base``, the ids of all
    files before it. One row per file, gathered like any table's list of files."""
    rows = sorted(spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect(), key=lambda r: (r["part"], r["seq"]))
    out, base = [], 0
    for place, r in enumerate(rows):
        out.append((place, r["file"], base, r["n_docs"], r["n_tokens"], r["first_id"], r["last_id"]))
        base += r["n_tokens"]
    return spark.createDataFrame(
        out, "place int, file string, base long, n_docs long, n_tokens long, first_id long, last_id long"
    )


BATCH_BYTES = 32 << 20


def _scanner(folder: str, doc_ids: np.ndarray | None, with_ids: bool):
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.binary())] if with_ids else []))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def scan(batches):
        rows, held = [], 0
        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                reader = Reader(folder, name)
                for i in reader.wanted(doc_ids).tolist():
                    crc, parts = 0, []
                    for content in reader.frames(i):
                        crc = zlib.crc32(content, crc)
                        if with_ids:
                            parts.append(content)
                    doc_id = None if reader.nulls[i] else int(reader.ids[i])
                    row = (doc_id, base + int(reader.starts[i]), int(reader.tokens[i]), crc)
                    if with_ids:
                        row += (b"".join(parts),)
                        held += len(row[-1])
                    rows.append(row)
                    if len(rows) == 10_000 or held > BATCH_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    return scan


def read(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, unless ``with_ids`` is false, ``ids``
    (binary, little-endian) of the documents in the files of ``path``: of all, or of those
    in ``doc_ids``, a list of the caller's. Then only files that can hold one are opened
    and only their frames read. A frame that does not match its checksum is an error."""
    found = files(spark, path)
    asked = None
    if doc_ids is not None:
        asked = np.unique(np.asarray(doc_ids, np.int64))
        if not len(asked):
            found = found.limit(0)
        else:
            rows = [r for r in found.collect() if r["first_id"] is not None]
            ends = np.searchsorted(asked, [[r["first_id"], r["last_id"] + 1] for r in rows]).reshape(-1, 2)
            hit = [r["place"] for r, (a, b) in zip(rows, ends) if a < b]
            found = found.where(F.col("place").isin(hit)) if hit else found.limit(0)
    dealt = found.repartitionById(max(1, min(found.count(), 100_000)), F.col("place")).select("file", "base")
    columns = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return dealt.mapInArrow(_scanner(f"{path}/frames", asked, with_ids), columns)

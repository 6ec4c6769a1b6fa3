"""Token files: one zstandard frame per document, and a trailing seek table with a checksum per frame.

Layout of a file, all numbers little-endian:

* one independent zstandard frame per document, its content the ids as unsigned 32-bit numbers;
* a skippable frame (magic 0x184D2A5D) with the documents' ids: a signed 64-bit number each, then one byte each that is
  0 where the id is null;
* a skippable frame (magic 0x184D2A5E) with the seek table: per document the frame's size, its content's size and the
  low 32 bits of the content's xxh64; then the number of the two tables' entries, a descriptor byte of 128 (checksums
  are there) and the magic 0x8F92EAB1. This is zstandard's published seekable format with one table more, so any
  zstandard decoder also reads the file from end to end.

A reader takes the last bytes, then the tables, then only the frames it is asked for.

Files are in ascending order of document id (null first, ties by text) across and within files. A task writes under a
name of its own attempt, and the list of files names what the successful attempts wrote; files of lost attempts
are never read. Defined results: a null or empty text is the end id alone, repeated rows are documents of their
own, an empty table gives no files.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import partitions_for
from millrace.llm.tokens import encoder, wide
from millrace.session import new_path, stage

#: Ids in a file, about; a file ends after the document that reaches it.
FILE_IDS = 64_000_000
LEVEL = 3
END = 2
#: Fixed values of the format.
NAMES_MAGIC, TABLE_MAGIC, SEEK_MAGIC, CHECKED = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1, 128
_HEAD, _ENTRY, _FOOT = struct.Struct("<II"), struct.Struct("<III"), struct.Struct("<IBI")


def _open(path: str):
    store, inner = fs.FileSystem.from_uri(path)
    return store, inner


class Writer:
    """Writes documents to one file."""

    def __init__(self, path: str):
        store, inner = _open(path)
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(inner, compression=None)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.names, self.entries, self.total = [], [], 0

    def add(self, name: int | None, ids: bytes) -> None:
        frame = self.packer.compress(ids)
        self.out.write(frame)
        self.names.append(name)
        self.entries.append(_ENTRY.pack(len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.total += len(ids) // 4

    def close(self) -> None:
        names = b"".join(struct.pack("<q", x or 0) for x in self.names) + bytes(x is not None for x in self.names)
        table = b"".join(self.entries) + _FOOT.pack(len(self.entries), CHECKED, SEEK_MAGIC)
        self.out.write(_HEAD.pack(NAMES_MAGIC, len(names)) + names + _HEAD.pack(TABLE_MAGIC, len(table)) + table)
        self.out.close()


class Reader:
    """Opens a file by its tables; ``read(i)`` fetches and checks one document."""

    def __init__(self, path: str):
        store, inner = _open(path)
        self.file = store.open_input_file(inner)
        size = self.file.size()
        count, mode, magic = _FOOT.unpack(self._at(size - _FOOT.size, _FOOT.size))
        if magic != SEEK_MAGIC or mode != CHECKED:
            raise ValueError(f"{path} does not end in a seek table")
        table = count * _ENTRY.size
        names_at = size - _FOOT.size - table - _HEAD.size - 9 * count
        self.table = np.frombuffer(self._at(size - _FOOT.size - table, table), dtype="<u4").reshape(count, 3)
        raw = self._at(names_at, 9 * count)
        there = np.frombuffer(raw[8 * count :], dtype=np.uint8)
        self.names = [int(x) if ok else None for x, ok in zip(np.frombuffer(raw[: 8 * count], dtype="<i8"), there)]
        self.sizes = self.table[:, 1].astype(np.int64) // 4
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0].astype(np.int64))])
        self.unpacker = zstandard.ZstdDecompressor()

    def _at(self, offset: int, size: int) -> bytes:
        return self.file.read_at(size, offset)

    def read(self, i: int) -> bytes:
        ids = self.unpacker.decompress(self._at(int(self.starts[i]), int(self.table[i, 0])))
        if len(ids) != self.table[i, 1] or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self.table[i, 2]:
            raise ValueError(f"document {i} does not match its checksum")
        return ids

    def close(self) -> None:
        self.file.close()


def write_files(docs: DataFrame, path: str, folder: str | None = None, key: str = "doc_id", text: str = "text",
                end: int = END, file_ids: int = FILE_IDS) -> DataFrame:
    """Write ``docs`` in order of ``key``; returns ``(task, number, file)``, one row per file."""
    folder = folder or new_path(docs.sparkSession, "token-files")

    def write(batches):
        coder, task = encoder(path), TaskContext.get()
        made, writer = [], None
        for batch in batches:
            for name, text in zip(batch.column("id"), batch.column("text")):
                if writer is None:
                    file = f"{folder}/part-{task.partitionId():06d}-{len(made):04d}-{uuid.uuid4().hex}.tokens.zst"
                    writer = Writer(file)
                    made.append((task.partitionId(), len(made), file))
                writer.add(name.as_py(), wide(coder.ids(text.as_py(), end), coder.kind))
                if writer.total >= file_ids:
                    writer.close()
                    writer = None
        if writer is not None:
            writer.close()
        columns = list(zip(*made)) or [[], [], []]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.string()])],
                              names=["task", "number", "file"])

    given = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    order = ["id", F.xxhash64("text")]  # the hash parts rows of one id, which may be many
    sorted_ = given.repartitionByRange(partitions_for(docs), *order).sortWithinPartitions(*order, "text")
    return stage(sorted_.mapInArrow(write, "task long, number long, file string"), "token-file-list")


def _sizes(batches):
    for batch in batches:
        totals = []
        for file in batch.column("file"):
            reader = Reader(file.as_py())
            totals.append(int(reader.sizes.sum()))
            reader.close()
        yield pa.record_batch([*batch.columns, pa.array(totals, pa.int64())], names=[*batch.schema.names, "total"])


def read_files(files: DataFrame, wanted: set[int] | None = None, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` per document of the listed files, or of the wanted ids only.

    ``start`` counts the ids of all documents before; it comes from the seek tables alone.
    """
    tasks = partitions_for(files)
    totals = stage(files.repartition(tasks).mapInArrow(_sizes, "task long, number long, file string, total long"), "token-file-sizes")
    # One row per file meets here.
    before = Window.orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = stage(totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "token-file-starts")

    def read(batches):
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                reader = Reader(file)
                starts = base + np.concatenate([[0], np.cumsum(reader.sizes)])
                for first in range(0, len(reader.names), 1000):
                    chosen = [i for i in range(first, min(first + 1000, len(reader.names))) if wanted is None or reader.names[i] in wanted]
                    ids = [reader.read(i) for i in chosen]
                    columns = [
                        pa.array([reader.names[i] for i in chosen], pa.int64()), pa.array([int(starts[i]) for i in chosen], pa.int64()),
                        pa.array([int(reader.sizes[i]) for i in chosen], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array(ids, pa.binary()))
                        names.append("ids")
                    yield pa.record_batch(columns, names=names)
                reader.close()

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return placed.repartition(tasks).mapInArrow(read, schema + (", ids binary" if with_ids else ""))

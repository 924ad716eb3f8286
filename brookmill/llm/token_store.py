"""Token ids in seekable binary shards.

A shard is a run of independent zstandard frames followed by two skippable frames: an index of its documents and, last,
a seek table with the compressed size, content size and checksum of every frame, so a reader fetches the tail, then
only the frames that hold the documents it wants. Frames hold little-endian unsigned 32-bit ids, at most `frame_ids`
each; a document may begin and end anywhere in them.

    data frames | 0x184D2A50 size [zstd(index)] | 0x184D2A5E size [entries, frames u32, descriptor u8, 0x8F92EAB1]

Shards are range partitions in ascending order of doc_id (null ids first, repeated ids by text), written under a
temporary name and moved into place, so a repeated or lost task leaves only whole files of equal content.

Defined cases: a null text counts as empty and holds only its end id; rows that repeat an id are stored each for itself;
other columns are not stored; an empty table writes empty shards and reads back as no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.llm.tokens import encoder

#: Fixed values of the format.
INDEX_MAGIC, SEEK_MAGIC, FOOT_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
ENTRY, FOOT, HEAD = struct.Struct("<III"), struct.Struct("<IBI"), struct.Struct("<II")
CHECKSUMS = 0x80
FRAME_IDS = 1 << 16
#: Most shards of one store; their manifest is read by the driver, a few dozen bytes each.
MAX_SHARDS = 1_000_000

MANIFEST = "shard int, file string, documents long, ids long, bytes long"
ROWS = "doc_id long, shard int, position long, start long, n_tokens long, ids_crc32 long, ids binary"
_ROWS = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("position", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def checksum(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class ShardWriter:
    def __init__(self, sink, frame_ids: int = FRAME_IDS, level: int = 1):
        self.sink, self.most = sink, 4 * frame_ids
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.held, self.entries = bytearray(), []
        self.doc_ids, self.lengths, self.bytes = [], [], 0

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.bytes += len(data)

    def _frame(self, content: bytes) -> None:
        packed = self.zstd.compress(content)
        self._write(packed)
        self.entries.append((len(packed), len(content), checksum(content)))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.held += ids
        while len(self.held) >= self.most:
            self._frame(bytes(self.held[: self.most]))
            del self.held[: self.most]

    def close(self) -> None:
        if self.held:
            self._frame(bytes(self.held))
        ids = np.array([-1 if d is None else d for d in self.doc_ids], "<i8").tobytes()
        absent = np.array([d is None for d in self.doc_ids], "u1").tobytes()
        index = self.zstd.compress(struct.pack("<Q", len(self.doc_ids)) + ids + np.array(self.lengths, "<u8").tobytes() + absent)
        self._write(HEAD.pack(INDEX_MAGIC, len(index)) + index)
        table = b"".join(ENTRY.pack(*e) for e in self.entries) + FOOT.pack(len(self.entries), CHECKSUMS, FOOT_MAGIC)
        self._write(HEAD.pack(SEEK_MAGIC, len(table)) + table)


class ShardReader:
    """Random access to one shard. source: a seekable file."""

    def __init__(self, source):
        self.source, size = source, source.seek(0, 2) or source.tell()
        frames, descriptor, magic = FOOT.unpack(self._read(size - FOOT.size, FOOT.size))
        if magic != FOOT_MAGIC or descriptor != CHECKSUMS:
            raise ValueError("no seek table")
        table_at = size - FOOT.size - ENTRY.size * frames - HEAD.size
        table = self._read(table_at, HEAD.size + ENTRY.size * frames)
        if HEAD.unpack_from(table)[0] != SEEK_MAGIC:
            raise ValueError("damaged seek table")
        self.entries = np.frombuffer(table, "<u4", offset=HEAD.size).reshape(frames, 3).astype(np.int64)
        self.file_at = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        self.content_at = np.concatenate([[0], np.cumsum(self.entries[:, 1])])
        magic, length = HEAD.unpack(self._read(int(self.file_at[-1]), HEAD.size))
        if magic != INDEX_MAGIC:
            raise ValueError("damaged index")
        index = zstandard.ZstdDecompressor().decompress(self._read(int(self.file_at[-1]) + HEAD.size, length))
        n = struct.unpack_from("<Q", index)[0]
        self.doc_ids = np.frombuffer(index, "<i8", n, 8)
        self.lengths = np.frombuffer(index, "<u8", n, 8 + 8 * n).astype(np.int64)
        self.absent = np.frombuffer(index, "u1", n, 8 + 16 * n).astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self._last = (-1, b"")

    def _read(self, at: int, length: int) -> bytes:
        self.source.seek(at)
        return self.source.read(length)

    def _frame(self, k: int) -> bytes:
        if self._last[0] != k:
            content = zstandard.ZstdDecompressor().decompress(self._read(int(self.file_at[k]), int(self.entries[k, 0])))
            if len(content) != self.entries[k, 1] or checksum(content) != self.entries[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self._last = (k, content)
        return self._last[1]

    def ids(self, i: int) -> bytes:
        """Ids of the i-th document of the shard; only its frames are read."""
        a, b = 4 * int(self.starts[i]), 4 * int(self.starts[i + 1])
        out, k = [], int(np.searchsorted(self.content_at, a, "right")) - 1
        while a < b:
            low, high = int(self.content_at[k]), int(self.content_at[k + 1])
            out.append(self._frame(k)[a - low : min(b, high) - low])
            a, k = min(b, high), k + 1
        return b"".join(out)


@dataclass(frozen=True)
class Store:
    """A written store: its folder and one (shard, file, documents, ids, bytes) for each shard, in order."""

    root: str
    shards: list


def _open_root(root: str):
    if "://" not in root:
        root = "file://" + root.removeprefix("file:")
    return fs.FileSystem.from_uri(root)


def write(
    docs: DataFrame,
    root: str,
    vocabulary: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    leading_blank: bool = False,
    end_id: int = 2,
    frame_ids: int = FRAME_IDS,
    shards: int | None = None,
) -> Store:
    """Encodes every document and writes it in ascending order of id; returns the manifest."""
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        enc, end = encoder(vocabulary, leading_blank), np.array([end_id], "<u4").tobytes()
        shard = TaskContext.get().partitionId()
        files, folder = _open_root(root)
        name = f"shard-{shard:07d}.ids.zst"
        files.create_dir(folder, recursive=True)
        temporary = f"{folder}/.{name}.{uuid.uuid4().hex}"
        try:
            with files.open_output_stream(temporary) as sink:
                writer = ShardWriter(sink, frame_ids)
                for batch in batches:
                    for doc_id, text in zip(batch.column(0), batch.column(1)):
                        writer.add(doc_id.as_py(), enc.encode(text.as_py()) + end)
                writer.close()
            files.move(temporary, f"{folder}/{name}")
        except BaseException:
            if files.get_file_info(temporary).type != fs.FileType.NotFound:
                files.delete_file(temporary)
            raise
        row = [shard, name, len(writer.lengths), sum(writer.lengths), writer.bytes]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["shard", "file", "documents", "ids", "bytes"])

    if n > MAX_SHARDS:
        raise ValueError(f"more than {MAX_SHARDS} shards")
    manifest = ordered.mapInArrow(run, MANIFEST).collect()  # a row for each shard
    return Store(root, sorted(tuple(r) for r in manifest))


def read(spark: SparkSession, store: Store, *, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Documents of a store, from its files: doc_id, shard, position in it, start (ids of all documents before it in the store), n_tokens, ids_crc32, ids.

    doc_ids: only these, touching only their frames. with_ids=False leaves ids null, but still reads and checks them.
    """
    root, wanted = store.root, None if doc_ids is None else np.array(sorted(set(doc_ids)), np.int64)
    before, tasks = 0, []
    for shard, name, _, ids, _ in store.shards:
        tasks.append((shard, name, before))
        before += ids
    listed = spark.createDataFrame(tasks or [(0, "", 0)], "shard int, file string, before long").where("file != ''")
    listed = listed.repartitionByRange(max(1, len(tasks)), "shard")

    def run(batches):
        files, folder = _open_root(root)
        for batch in batches:
            for task in batch.to_pylist():
                with files.open_input_file(f"{folder}/{task['file']}") as source:
                    shard = ShardReader(source)
                    hits = np.arange(len(shard.doc_ids)) if wanted is None else np.flatnonzero(np.isin(shard.doc_ids, wanted) & ~shard.absent)
                    out = []
                    for i in hits.tolist():
                        ids = shard.ids(i)
                        doc_id = None if shard.absent[i] else int(shard.doc_ids[i])
                        out.append((doc_id, task["shard"], i, task["before"] + int(shard.starts[i]), len(ids) // 4, zlib.crc32(ids), ids if with_ids else None))
                        if len(out) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ROWS)], schema=_ROWS)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ROWS)], schema=_ROWS)

    return listed.mapInArrow(run, ROWS)

"""Packing into fixed-length sequences by vector bin packing.

Each example asks for three resources at once: tokens, one segment, and loss-bearing tokens. A sequence offers
`max_tokens`, `max_segments` and `max_loss` of them. The open sequence takes, from a pool of bounded size, the piece
that fits whole and has the largest dot product of its demand with what is left (both as shares of the limits). Where
no piece fits whole, the one with the largest product is cut to fill the sequence to its last token. Examples longer
than a sequence are first cut into full sequences. Each task packs its own input partition: no shuffle, no state beyond
the pool. Its last, unfinished sequence is closed as sequences whose lengths are powers of two and so need no padding.

Defined cases: a null text counts as empty; an empty text still has its end id and is packed; rows that repeat an id are
packed each for itself; other columns are not read; an empty table gives no pieces; texts of any length are cut, never
dropped. sequence_id is unique, not dense: the number of the task in its high bits.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmill.llm.tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids binary"
_ARROW = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in [c.split()[0] for c in SCHEMA.split(", ")]])
POOL = 384
#: Finished rows leave a task in batches of about so many bytes.
OUT_BYTES = 4 << 20


class Packer:
    """Streams pieces (doc_id, start, ids, doc_tokens, prompt) into sequences. `out` collects finished rows."""

    def __init__(self, base: int, max_tokens: int, max_segments: int, max_loss: int, with_ids: bool = True):
        self.limits, self.with_ids = (max_tokens, max_segments, max_loss), with_ids
        self.sequence, self.out, self.out_bytes = base, [], 0
        self.pool: list[tuple] = []
        self.need = np.zeros((0, 2))
        self.open: list[tuple] = []
        self.left = list(self.limits)

    @staticmethod
    def loss(start: int, length: int, prompt: int) -> int:
        return max(0, start + length - max(start, prompt))

    def _fitting(self, start: int, rest: int, prompt: int) -> int:
        """Tokens of a piece that fit into what is left."""
        free = max(0, min(rest, prompt - start))
        return min(rest, self.left[0], free + self.left[2])

    def _place(self, piece: tuple, length: int) -> tuple | None:
        """Puts the first `length` tokens into the open sequence; returns what remains of the piece."""
        doc_id, start, ids, total, prompt = piece
        self.open.append((doc_id, start, ids[: 4 * length], total, prompt))
        self.left[0] -= length
        self.left[1] -= 1
        self.left[2] -= self.loss(start, length, prompt)
        return (doc_id, start + length, ids[4 * length :], total, prompt) if 4 * length < len(ids) else None

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total, prompt in pieces:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, zlib.crc32(ids), total, self.sequence, offset, self.loss(start, n, prompt), bytes(ids) if self.with_ids else None))
            self.out_bytes += 100 + len(ids) * self.with_ids
            offset += n
        self.sequence += 1

    def _close(self) -> None:
        if self.open:
            self._emit(self.open)
        self.open, self.left = [], list(self.limits)

    def add(self, doc_id, ids: bytes, prompt: int = 0) -> None:
        total, start, ids = len(ids) // 4, 0, memoryview(ids)
        while total - start > self.limits[0] or self.loss(start, total - start, prompt) > self.limits[2]:
            free = max(0, min(total - start, prompt - start))
            length = min(self.limits[0], free + self.limits[2])
            self._emit([(doc_id, start, ids[4 * start : 4 * (start + length)], total, prompt)])
            start += length
        if start < total:
            self._pool((doc_id, start, ids[4 * start :], total, prompt))
        if len(self.pool) >= POOL:
            self._fill(POOL // 2)

    def _pool(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        if len(self.pool) >= len(self.need):
            self.need = np.vstack([self.need, np.zeros((POOL, 2))])
        self.need[len(self.pool)] = n, self.loss(piece[1], n, piece[4])
        self.pool.append(piece)

    def _take(self, i: int) -> tuple:
        piece, last = self.pool[i], self.pool.pop()
        if i < len(self.pool):
            self.pool[i] = last
            self.need[i] = self.need[len(self.pool)]
        return piece

    def _fill(self, down_to: int) -> None:
        """Fills sequences until the pool holds no more than `down_to` pieces."""
        whole, segments, loss = self.limits
        while len(self.pool) > down_to:
            if self.left[0] == 0 or self.left[1] == 0:
                self._close()
            need = self.need[: len(self.pool)]
            dot = need @ (self.left[0] / whole**2, self.left[2] / loss**2) + self.left[1] / segments**2
            fits = (need[:, 0] <= self.left[0]) & (need[:, 1] <= self.left[2])
            if fits.any():
                piece = self._take(int(np.argmax(np.where(fits, dot, -1.0))))
                self._place(piece, len(piece[2]) // 4)
                continue
            piece = self._take(int(np.argmax(dot)))
            length = self._fitting(piece[1], len(piece[2]) // 4, piece[4])
            rest = self._place(piece, length) if length else piece
            if rest is not None:
                self._pool(rest)
            if length == 0:
                self._close()

    def finish(self) -> None:
        self._fill(0)
        pieces, self.open = self.open, []
        used = sum(len(p[2]) // 4 for p in pieces)
        if used == self.limits[0]:
            self._emit(pieces)
            return
        for bit in range(used.bit_length() - 1, -1, -1):
            if not used >> bit & 1:
                continue
            room, part = 1 << bit, []
            while room:
                doc_id, start, ids, total, prompt = pieces.pop(0)
                n = min(room, len(ids) // 4)
                part.append((doc_id, start, ids[: 4 * n], total, prompt))
                if 4 * n < len(ids):
                    pieces.insert(0, (doc_id, start + n, ids[4 * n :], total, prompt))
                room -= n
            self._emit(part)


def pack(
    docs: DataFrame,
    vocabulary: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    leading_blank: bool = True,
    end_id: int = 1,
    max_tokens: int = 2048,
    max_segments: int = 256,
    max_loss: int | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens, ids.

    prompt_col: text before text_col that is packed but bears no loss, as in instruction data. end_id closes each
    document. with_ids=False leaves ids null for callers that need only the layout.
    """
    limit = max_loss or max_tokens
    prompt = F.lit(None) if prompt_col is None else F.col(prompt_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), prompt.cast("string").alias("prompt"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        enc, end = encoder(vocabulary, leading_blank), np.array([end_id], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << 40, max_tokens, max_segments, limit, with_ids)

        def ready():
            done, packer.out, packer.out_bytes = packer.out, [], 0
            columns = list(zip(*done)) or [()] * len(_ARROW)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

        for batch in batches:
            for doc_id, before, text in zip(*(batch.column(i) for i in range(3))):
                head = enc.encode(before.as_py() or "")
                packer.add(doc_id.as_py(), head + enc.encode(text.as_py() or "") + end, len(head) // 4)
                if packer.out_bytes >= OUT_BYTES:
                    yield ready()
        packer.finish()
        yield ready()

    return rows.mapInArrow(run, SCHEMA)

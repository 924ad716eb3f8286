import io
import zlib

import numpy as np
import pytest
from conftest import odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brookmill.llm import packing, token_store
from brookmill.llm.common import new_folder
from brookmill.llm.queries import vocabulary
from brookmill.llm.tokens import Encoder

WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
PLAIN = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def plain(path, text):
    return PLAIN[path].encode(text or "", add_special_tokens=False).ids


ENCODERS = {WORD: Encoder(WORD, False, most_bytes=12_000), BYTE: Encoder(BYTE, True, most_bytes=12_000)}


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("ab zÉß'.,\n\t%1é́日ſİ")) | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_pieces_give_the_ids_of_whole_texts(text):
    for path, enc in ENCODERS.items():
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == plain(path, text)


@pytest.mark.parametrize("text", ["don't we'll I've it's", "a<|endoftext|>b <|endoftext|>", "..., .,. a., b..", " lead", "trail ", "\n\nx\n", "µª × ÷ ǅ İ", "ﬁ ﬀ ｆ", "é ́"])
def test_special_cases(text):
    for path, enc in ENCODERS.items():
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == plain(path, text)


def test_store_round_trip_and_random_access(spark, odd, none):
    root = new_folder(spark, "tokens")
    store = token_store.write(odd, root, WORD, frame_ids=100, shards=3)
    rows = sorted(token_store.read(spark, store).collect(), key=lambda r: (r["shard"], r["position"]))
    want = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in rows] == [r[0] for r in want]
    at = 0
    for r, w in zip(rows, want):
        ids = np.array(plain(WORD, w[1]) + [2], "<u4").tobytes()
        assert bytes(r["ids"]) == ids and r["n_tokens"] == len(ids) // 4 and r["ids_crc32"] == zlib.crc32(ids) and r["start"] == at
        at += r["n_tokens"]
    few = token_store.read(spark, store, doc_ids=[7, 13, 999]).collect()
    assert sorted(r["doc_id"] for r in few) == [7, 13, 13, 13]
    assert {(r["doc_id"], r["start"]) for r in few} == {(r["doc_id"], r["start"]) for r in rows if r["doc_id"] in (7, 13)}
    empty = token_store.write(none, new_folder(spark, "tokens"), WORD)
    assert token_store.read(spark, empty).count() == 0


class _Counting(io.BytesIO):
    fetched = 0

    def read(self, n=-1):
        self.fetched += n
        return super().read(n)


def _shard(docs, frame_ids=64):
    sink = io.BytesIO()
    writer = token_store.ShardWriter(sink, frame_ids)
    for k, ids in docs:
        writer.add(k, np.array(ids, "<u4").tobytes())
    writer.close()
    return sink.getvalue()


def test_reader_fetches_only_the_frames_it_needs_and_sees_damage():
    import zstandard

    rng = np.random.default_rng(0)
    docs = [(k, rng.integers(0, 49_000, rng.integers(0, 300))) for k in range(200)]
    data = _shard(docs)
    source = _Counting(data)
    reader = token_store.ShardReader(source)
    before = source.fetched
    assert np.frombuffer(reader.ids(57), "<u4").tolist() == docs[57][1].tolist()
    assert source.fetched - before <= 300 * 4 + 3 * 64 * 4
    everything = b"".join(np.array(ids, "<u4").tobytes() for _, ids in docs)
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == everything
    broken = bytearray(data)
    broken[int(reader.file_at[5]) + int(reader.entries[5][0]) // 2] ^= 0xFF
    bad = token_store.ShardReader(io.BytesIO(bytes(broken)))
    hit = int(np.searchsorted(reader.starts, 5 * 64, "right")) - 1
    with pytest.raises(Exception):
        bad.ids(hit)
    with pytest.raises(ValueError):
        token_store.ShardReader(io.BytesIO(data[:-1] + b"\0"))
    assert token_store.ShardReader(io.BytesIO(_shard([]))).doc_ids.tolist() == []


def check_layout(rows, want, max_tokens=2048, max_segments=256, max_loss=None):
    """Every id in exactly one piece, sequences gapless and within all limits."""
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r["sequence_id"], []).append(r)
    for parts in pieces.values():
        parts.sort(key=lambda r: r["offset"])
        at = 0
        for r in parts:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= max_tokens and len(parts) <= max_segments and sum(r["loss_tokens"] for r in parts) <= (max_loss or max_tokens)
    got: dict = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for doc_id, ids in want:
        parts = got[doc_id]
        joined = b"".join(p for _, p in sorted(parts))
        copies = sum(w[0] == doc_id for w in want)
        assert len(joined) == copies * len(ids) * 4
        if copies == 1:
            assert joined == np.array(ids, "<u4").tobytes()
    return pieces


def test_packing_odd_rows(odd, none):
    rows = packing.pack(odd, BYTE).collect()
    pieces = check_layout(rows, [(r[0], plain(BYTE, r[1]) + [1]) for r in odd_rows()])
    total = [sum(r["length"] for r in p) for p in pieces.values()]
    assert all(n == 2048 or n & (n - 1) == 0 for n in total)
    assert packing.pack(none, BYTE).count() == 0


def test_packing_under_three_limits(spark):
    docs = [(k, "read this " * (k % 7), "and answer that " * (k % 30)) for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, prompt string, text string").coalesce(1)
    rows = packing.pack(df, BYTE, prompt_col="prompt", max_tokens=128, max_segments=6, max_loss=70).collect()
    pieces = check_layout(rows, [(k, plain(BYTE, p) + plain(BYTE, t) + [1]) for k, p, t in docs], 128, 6, 70)
    for k, p, t in docs:
        assert sum(r["loss_tokens"] for r in rows if r["doc_id"] == k) == len(plain(BYTE, t)) + 1
    used = sum(r["length"] for r in rows)
    assert used / (128 * len(pieces)) > 0.5


def test_little_padding():
    packer, r = packing.Packer(0, 2048, 256, 2048), np.random.default_rng(1)
    n = r.integers(1, 3000, 2000)
    for k, m in enumerate(n):
        packer.add(k, b"\0" * 4 * int(m))
    packer.finish()
    by: dict = {}
    for row in packer.out:
        by[row[5]] = by.get(row[5], 0) + row[2]
    assert sum(by.values()) == n.sum()
    assert sum(2048 - v for v in by.values() if v & (v - 1)) == 0

"""Toxic spans by a linear-chain conditional random field.

Labels are by document, so tokens are labelled first: in toxic documents of the sample, the words whose document counts
differ from those of clean ones beyond chance (log-likelihood ratio) are marked. A two-state chain is trained on these
lines by gradient ascent of the conditional likelihood, with forward-backward marginals; features are hashed words
and their beginnings, so nothing of a document but its text counts. Each line of a document is one sequence; marginals of all
lines of a block of documents are computed together, one position at a time. A document's score comes from its expected
number of toxic tokens and their largest marginal, calibrated on documents that the chain giving them was not trained on
(each half of the sample by a chain of the other half); offsets are those of tokens with a marginal of one half or more.

The fit takes at most `max_labelled` distinct labelled texts, in the order of a hash of their ids, and `max_lines` of their
lines, in the order of a hash; of a text over SAMPLE_CHARS it learns WINDOWS evenly spaced windows, SAMPLE_CHARS in all.
Every document is scored in full.

Defined cases: null or empty texts get the score of a text without toxic tokens; null labels are not used; without both
classes in the sample every score is the share of toxic rows (0 without any); rows that repeat an id are scored each
for itself; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmill.llm.common import logistic, sigmoid

DIM = 1 << 18
MAX_LABELLED, MAX_LINES = 4_000, 6_000
SAMPLE_CHARS, WINDOWS = 100_000, 10
#: Tokens whose marginals are computed together, and remembered words.
BLOCK, REMEMBERED = 800_000, 400_000
HELD_OUT = 2
_EDGE = re.compile(r"^\W+|\W+$")
_TOKEN = re.compile(r"\S+")


def features(token: str) -> tuple[int, ...]:
    """Hashed lower-cased word without the marks around it, and the hash of its first letters."""
    word = _EDGE.sub("", token).lower().encode("utf-8", "surrogatepass")
    return zlib.crc32(word) % DIM, zlib.crc32(word[:6], 1) % DIM


@dataclass
class Model:
    weights: np.ndarray | None = None  # by hashed feature: log-odds of the toxic state
    bias: float = 0.0
    chain: tuple = (1.0, 1.0, 1.0, 1.0)  # exp of the four transition weights: 00, 01, 10, 11
    scale: tuple = (0.0, 0.0, 0.0)  # of the document score: constant, expected toxic tokens, largest marginal
    base: float = 0.0


class _Emissions(dict):
    """exp of a token's emission, remembered."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.weights = model, memoryview(model.weights.astype(np.float64))

    def __missing__(self, token: str) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        self[token] = e = math.exp(min(30.0, max(-30.0, sum(self.weights[f] for f in features(token)) + self.model.bias)))
        return e


def marginals(e: np.ndarray, lengths: np.ndarray, chain: tuple, pairs: bool = False):
    """Probability of the toxic state at each position of sequences laid end to end (and the summed transition marginals).

    Forward and backward messages are kept as ratios of the toxic to the clean state; all sequences move together.
    """
    t00, t01, t10, t11 = chain
    lengths = np.asarray(lengths, np.int64)
    start = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    start, size = start[order], lengths[order]
    alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    forward, backward = np.empty(len(e)), np.ones(len(e))
    r = None
    for t, k in enumerate(alive):
        at = start[:k] + t
        r = e[at] if t == 0 else e[at] * (t01 + r[:k] * t11) / (t00 + r[:k] * t10)
        r = np.clip(r, 1e-30, 1e30)
        forward[at] = r
    for t in range(len(alive) - 2, -1, -1):
        k = alive[t + 1]
        at = start[:k] + t
        m = e[at + 1] * backward[at + 1]
        backward[at] = np.clip((t10 + t11 * m) / (t00 + t01 * m), 1e-30, 1e30)
    p = forward * backward
    p = p / (1.0 + p)
    if not pairs:
        return p
    inner = np.ones(len(e), bool)
    inner[start[size > 0] + size[size > 0] - 1] = False
    at = np.flatnonzero(inner)
    r, m = forward[at], e[at + 1] * backward[at + 1]
    joint = np.stack([np.full(len(at), t00), t01 * m, t10 * r, t11 * r * m])
    return p, (joint / joint.sum(axis=0)).sum(axis=1), at


def _marked_words(texts: list[str], toxic: np.ndarray, least: float = 20.0) -> set[str]:
    """Words that toxic documents have more often than chance, by log-likelihood ratio of document counts."""
    counts: dict[str, list] = {}
    for text, y in zip(texts, toxic):
        for word in {_EDGE.sub("", w).lower() for w in text.split()}:
            counts.setdefault(word, [0, 0])[int(y)] += 1
    n1, n0 = float(toxic.sum()), float((1 - toxic).sum())
    out = set()
    for word, (clean, bad) in counts.items():
        if not word or bad < 3 or bad / n1 <= 4 * (clean + 0.5) / n0:
            continue
        share = (bad + clean) / (n1 + n0)
        ratio = 2 * (bad * np.log(bad / (n1 * share)) + (clean * np.log(clean / (n0 * share)) if clean else 0.0))
        if ratio >= least:
            out.add(word)
    return out


def _spread(lines: list, most: int) -> list:
    """At most `most` lines, chosen by a hash of their words and place."""
    if len(lines) <= most:
        return lines
    order = sorted(range(len(lines)), key=lambda k: (zlib.crc32(f"{k} {' '.join(lines[k][0])}".encode("utf-8", "surrogatepass")), k))
    return [lines[k] for k in sorted(order[:most])]


def fit_chain(texts: list[str], y: np.ndarray, max_lines: int, rounds: int) -> Model:
    """Chain of labelled documents, without calibration."""
    marked = _marked_words(texts, y)
    with_mark, without = [], []
    for text, bad in zip(texts, y):
        for line in text.split("\n"):
            tokens = line.split()
            for k in range(0, len(tokens), 200):
                part = tokens[k : k + 200]
                tags = [bool(bad) and _EDGE.sub("", w).lower() in marked for w in part]
                (with_mark if any(tags) else without).append((part, tags))
    lines = _spread(with_mark, max_lines // 2)
    lines = lines + _spread(without, max_lines - len(lines))
    lengths = np.array([len(t) for t, _ in lines], np.int64)
    words: dict[str, int] = {}
    token = np.array([words.setdefault(w, len(words)) for t, _ in lines for w in t], np.int64)
    tag = np.array([v for _, tags in lines for v in tags], float)
    table = np.array([features(w) for w in words], np.int64).reshape(len(words), -1)
    w, b, theta = np.zeros(DIM), 0.0, np.zeros(4)
    gw, gb, gt = np.full(DIM, 1e-6), 1e-6, np.full(4, 1e-6)
    for k in range(rounds if len(words) else 0):
        score = w[table].sum(axis=1) + b
        e = np.exp(np.clip(score, -30, 30))[token]
        p, joint, at = marginals(e, lengths, tuple(np.exp(theta)), pairs=True)
        if k == 0:
            pairs = (2 * tag[at] + tag[at + 1]).astype(int)
            seen = np.bincount(pairs, minlength=4).astype(float)
        off = np.bincount(token, tag - p, len(words))
        up = np.bincount(table.ravel(), np.repeat(off, table.shape[1]), DIM) - 0.05 * w
        ub, ut = off.sum() - 0.05 * b, (seen - joint) - 0.05 * theta
        gw, gb, gt = gw + up**2, gb + ub**2, gt + ut**2
        w, b, theta = w + 0.5 * up / np.sqrt(gw), b + 0.5 * ub / np.sqrt(gb), theta + 0.3 * ut / np.sqrt(gt)
    return Model(w.astype(np.float32), float(b), tuple(np.exp(theta)))


def _points(texts: list[str], model: Model) -> np.ndarray:
    return np.array([[1.0, *evidence] for evidence, _ in _evidence(texts, model, _Emissions(model))]).reshape(-1, 3)


def train(texts: list[str], toxic: list[int], max_lines: int = MAX_LINES, rounds: int = 50) -> Model:
    """Chain and calibration from labelled documents, in the order given."""
    y = np.asarray(toxic, np.int64)
    if len(y) == 0 or y.min() == y.max():
        return Model(base=float(y.mean()) if len(y) else 0.0)
    model = fit_chain(texts, y, max_lines, rounds)
    half = np.zeros(len(y), np.int64)
    for label in (0, 1):  # both halves have as many of either label
        half[np.flatnonzero(y == label)[1::2]] = 1
    if min(y.sum(), len(y) - y.sum()) < 2:
        x = _points(texts, model)
    else:
        x = np.zeros((len(y), 3))
        for h in (0, 1):
            theirs, own = np.flatnonzero(half != h), np.flatnonzero(half == h)
            x[own] = _points([texts[k] for k in own], fit_chain([texts[k] for k in theirs], y[theirs], max_lines // 2, rounds))
    model.scale = tuple(logistic(x, y.astype(float)))
    return model


def _evidence(texts: list[str], model: Model, known: _Emissions):
    """For each text: (log of 1 + expected toxic tokens, largest marginal), and the offsets of toxic tokens."""
    at = 0
    while at < len(texts):
        tokens, lengths, lines_of = [], [], []
        while at < len(texts) and (len(tokens) < BLOCK or not lines_of):
            n = 0
            for line in texts[at].split("\n"):
                words = line.split()
                lengths.append(len(words))
                tokens += words
                n += 1
            lines_of.append(n)
            at += 1
        e = np.array([known[w] for w in tokens], np.float64)
        p = marginals(e, np.array(lengths), model.chain)
        ends = np.cumsum(lengths)
        line = position = 0
        for k, n in enumerate(lines_of):
            end = int(ends[line + n - 1])
            own = p[position:end]
            spans = []
            if len(own) and own.max() >= 0.5:
                spans = _offsets(texts[at - len(lines_of) + k], own)
            yield (float(np.log1p(own.sum())), float(own.max()) if len(own) else 0.0), spans
            line, position = line + n, end


def _offsets(text: str, p: np.ndarray) -> list[tuple[int, int]]:
    """Code points of tokens with a marginal of at least one half, without the marks around them."""
    out = []
    for m, q in zip(_TOKEN.finditer(text), p):
        if q >= 0.5:
            word = m[0]
            left = len(word) - len(re.sub(r"^\W+", "", word))
            right = len(re.sub(r"\W+$", "", word))
            out.append((m.start() + left, m.start() + right) if right > left else m.span())
    return out


def windows(text, chars: int = SAMPLE_CHARS, n: int = WINDOWS):
    """A text, or evenly spaced windows of one that is longer than `chars`."""
    size, length = chars // n, F.char_length(text)
    parts = [F.substring(text, (F.floor((length - size) * k / (n - 1)) + 1).cast("int"), F.lit(size)) for k in range(n)]
    return F.when(length <= chars, text).otherwise(F.concat_ws("\n", *parts))


def labelled_sample(docs: DataFrame, labels: DataFrame, *, label_col: str, id_col: str, text_col: str, max_labelled: int, usable=None) -> list:
    """At most max_labelled distinct labelled texts (_id, _label, _text), in the order of a hash of their ids; _text is cut to windows."""
    ids = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label")).where(F.col("_label").isNotNull() & F.col("_id").isNotNull())
    if usable is not None:
        ids = ids.where(usable(F.col("_id")))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_key"))
    first = rows.select("_id", "_key").join(ids, "_id").groupBy("_key").agg(F.min(F.struct(F.xxhash64("_id").alias("h"), "_id", "_label")).alias("s"))
    few = first.select("s.*", "_key").orderBy("h", "_id", "_label").limit(max_labelled)
    got = rows.join(F.broadcast(few), ["_id", "_key"]).select("_id", "_label", "_key", windows(F.col("_text")).alias("_text")).dropDuplicates(["_id", "_key"])
    return sorted(got.collect(), key=lambda r: (r["_id"], r["_text"]))


def is_held_out(doc_id):
    """The fold that labels are never learned from."""
    return F.crc32(doc_id.cast("string")) % 4 == HELD_OUT


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, max_lines: int = MAX_LINES) -> DataFrame:
    """One row for each document: doc_id, score, spans (array of start, end in code points)."""
    sample = labelled_sample(docs, labels, label_col=label_col, id_col=id_col, text_col=text_col, max_labelled=max_labelled, usable=lambda i: ~is_held_out(i))
    model = train([r["_text"] for r in sample], [r["_label"] for r in sample], max_lines)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches):
        known = None if model.weights is None else _Emissions(model)
        for batch in batches:
            ids, texts = batch.column(0), [t.as_py() or "" for t in batch.column(1)]
            if model.weights is None:
                yield pa.RecordBatch.from_arrays([ids, pa.array([model.base] * len(ids), pa.float64()), pa.array([[]] * len(ids), schema.field(2).type)], schema=schema)
                continue
            found = list(_evidence(texts, model, known))
            x = np.array([[1.0, *evidence] for evidence, _ in found]).reshape(-1, 3)
            spans = [[{"start": a, "end": b} for a, b in s] for _, s in found]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sigmoid(x @ np.array(model.scale))), pa.array(spans, schema.field(2).type)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, spans array<struct<start:long,end:long>>")

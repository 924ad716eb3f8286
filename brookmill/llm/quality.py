"""Quality classifier by co-training.

Two logistic regressions see a document from two sides: one its words (hashed words, word ends and word shapes, by
relative frequency), the other its page metadata (language, source, size, line layout, share of capitals, digits, marks
and repeated lines and words). Both start from labelled documents. In each round they score all unlabelled ones on the executors
(each distinct text once), and each hands the other those it is surest of, as many of either class as its share among the labels allows. After the last
round each view is calibrated on labelled documents that no round has trained on, and the calibrated log-odds are
added up, less those of the prior (the views count as independent given the class), to score every document in full.

Whole texts are read once: their features (hashed word frequencies as sparse rows, and metadata) are written to the shared
folder, and the rounds score those. The fit learns from at most `max_labelled` distinct labelled texts, in the order of a
hash of their ids, and a view hands over at most HANDED times `max_pool` distinct texts in a round; they are chosen from all
unlabelled rows, and whatever else is computed covers all rows. What the driver gathers is features, at most DIM entries of
6 bytes a text however long it is. Texts are told apart by a 64-bit hash; of rows with one text that of the smallest
language and source is scored.

Defined cases: a null text counts as empty; null languages and sources are values of their own; null labels are not
used; without both classes among the labels every document scores the share of good ones (1 without labels) and is
kept; rows that repeat an id are scored each for itself; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmill.llm.common import durable, logistic, new_folder, sigmoid

BITS = 14
DIM = 1 << BITS
MAX_LABELLED, MAX_POOL, ROUNDS = 2_000, 2_000, 3
#: Share of the unlabelled texts, or of max_pool if that is less, that a view hands over in one round.
HANDED = 0.1
#: Documents below this probability of being good are rejected.
THRESHOLD = 0.3
#: Raw score beyond which a view counts as sure.
SURE = 1.0
#: Number of words at which the word view counts half.
SHORT = 20
REMEMBERED = 200_000
_UPPER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _bucket(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % DIM


class _Classes(dict):
    """Class of a character by its code point, for str.translate."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return k


_classes, _REPEATS = _Classes(), re.compile(r"(.)\1+", re.DOTALL)


def word_features(word: str) -> tuple[int, int, int]:
    """Hashed word, its end, and its shape: classes of characters, repeats merged, with a coarse length."""
    shape = _REPEATS.sub(r"\1", word[:32].translate(_classes))
    return _bucket("w" + word.lower()), _bucket("e" + word[-3:]), _bucket(f"s{shape[:6]}/{min(4, len(word) // 4)}")


def _packed(word: str) -> int:
    a, b, c = word_features(word)
    return a | b << BITS | c << 2 * BITS


class _Remembered(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = v = self.make(word)
        return v


def meta_features(text: str, lang: str | None, source: str | None, words: list[str] | None = None) -> np.ndarray:
    """Dense page metadata; shares count less in short texts, which say little. The last 24 places are hashed language and source."""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split() if words is None else words
    n = len(raw)
    lines = text.split("\n")
    trust = 1 / (n + 120)
    share = lambda chars: (n - len(raw.translate(None, chars))) * trust
    some = len(words) + 20
    x = np.zeros(38)
    x[0] = 1.0
    x[1] = np.log1p(n) / 10
    x[2] = np.log1p(len(lines)) / 5
    x[3] = np.log1p(n / len(lines)) / 8
    x[4] = (len(lines) - len(set(lines))) / (len(lines) + 4)
    x[5] = min(1.0, 4 * share(_UPPER))
    x[6] = min(1.0, 10 * share(_DIGIT))
    x[7] = min(1.0, 5 * share(_MARKS))
    x[8] = min(1.0, 10 * share(b"!#$%&*|<>{}"))
    x[9] = min(1.0, max(0.0, n / (len(words) + 1) - 5) / 15) * n * trust
    x[10] = min(1.0, 50 * raw.count(b". ") * trust)
    x[11] = min(1.0, 3 * sum(map(operator.eq, words, words[1:])) / some)
    x[12] = (len(words) - len(set(words))) / some
    x[13] = float(not words)
    x[14 + zlib.crc32(repr(lang).encode("utf-8", "surrogatepass")) % 8] = 1.0
    x[22 + zlib.crc32(repr(source).encode("utf-8", "surrogatepass")) % 16] = 0.3
    return x


class Features(NamedTuple):
    """What both views see of a text: relative frequencies by hashed feature, number of words, metadata."""

    buckets: np.ndarray
    values: np.ndarray
    words: int
    meta: np.ndarray


def features(text: str | None, lang: str | None, source: str | None, known: dict) -> Features:
    words = (text or "").split()
    meta = meta_features(text or "", lang, source, words).astype(np.float32)
    if not words:
        return Features(np.zeros(0, np.uint16), np.zeros(0, np.float32), 0, meta)
    counts = Counter(words)
    packed = np.fromiter(map(known.__getitem__, counts), np.int64, len(counts))
    n = np.fromiter(counts.values(), np.float64, len(counts))
    total = np.bincount(np.concatenate([packed >> k * BITS & DIM - 1 for k in range(3)]), np.tile(n, 3))
    at = np.flatnonzero(total)
    return Features(at.astype(np.uint16), (total[at] / len(words)).astype(np.float32), len(words), meta)


class _Rows:
    """Sparse rows of relative word frequencies, and the metadata of the same texts."""

    def __init__(self, found: list[Features]):
        self.n = len(found)
        self.of = np.repeat(np.arange(self.n), [len(f.buckets) for f in found])
        self.at = np.concatenate([f.buckets for f in found]).astype(np.int64) if found else np.zeros(0, np.int64)
        self.value = np.concatenate([f.values for f in found]).astype(float) if found else np.zeros(0)
        self.words = np.array([f.words for f in found], float)
        self.meta = np.array([f.meta for f in found], float).reshape(self.n, -1)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, self.value * w[self.at], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.value * r[self.of], DIM)

    def views(self, model) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores by words and by metadata."""
        return self.dot(model.words) + model.bias, self.meta @ model.meta if self.n else np.zeros(0)


FEATURES = "row long, id long, key long, lang string, source string, words long, buckets binary, values binary, meta binary"


def featurised(rows: DataFrame) -> DataFrame:
    """Features of every row of a table with columns text, lang, source and, if there is one, id, as files in the shared folder."""
    names = [f.split()[0] for f in FEATURES.split(", ")]
    own = F.col("id").cast("long") if "id" in rows.columns else F.lit(None).cast("long")

    def run(batches):
        known = _Remembered(_packed)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                found = [features(*row, known) for row in zip(*(part.column(i).to_pylist() for i in (5, 3, 4)))]
                made = [pa.array([f.words for f in found], pa.int64()), *[pa.array([f[i].tobytes() for f in found], pa.binary()) for i in (0, 1, 3)]]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(5)] + made, names=names)

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), own.alias("id"), F.xxhash64("text").alias("key"), "lang", "source", "text")
    path = new_folder(rows.sparkSession, "quality-features")
    numbered.mapInArrow(run, FEATURES).write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.parquet(path)


def _read(words, buckets, values, meta) -> Features:
    return Features(np.frombuffer(buckets, np.uint16), np.frombuffer(values, np.float32), words, np.frombuffer(meta, np.float32))


def _stored(found: DataFrame, columns: list[str], schema: str, make) -> DataFrame:
    """Over stored features: the columns named, and arrays that `make` gives for a block of rows."""
    names = [f.split()[0] for f in schema.split(", ")]
    n = len(columns)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                rows = _Rows([_read(*f) for f in zip(*(part.column(n + i).to_pylist() for i in range(4)))])
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n)] + [pa.array(v, pa.float64()) for v in make(rows)], names=names)

    return found.select(*columns, "words", "buckets", "values", "meta").mapInArrow(run, schema)


def _fit_words(rows: _Rows, use: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression on word frequencies by adaptive gradient steps, classes weighted alike."""
    w, b, gw, gb = np.zeros(DIM), 0.0, np.full(DIM, 1e-8), 1e-8
    for _ in range(steps):
        r = np.where(use, weight * (y - sigmoid(rows.dot(w) + b)), 0.0)
        up, ub = rows.back(r) - 1e-4 * w, r.sum()
        gw, gb = gw + up**2, gb + ub**2
        w, b = w + 0.6 * up / np.sqrt(gw), b + 0.3 * ub / np.sqrt(gb)
    return w, b


@dataclass
class Model:
    words: np.ndarray | None = None
    bias: float = 0.0
    meta: np.ndarray | None = None
    calibration: tuple = ((0.0, 1.0), (0.0, 1.0))  # of the word and the metadata view
    prior: float = 0.0  # log-odds of good documents among the labels
    base: float = 1.0
    handed: list = field(default_factory=list)  # documents handed over in each round

    def combine(self, words: np.ndarray, meta: np.ndarray, trust: np.ndarray) -> tuple:
        """Probabilities by words, by metadata, and jointly. trust: weight of the word view against the prior."""
        by_words, by_meta = (np.clip(a + b * z, -12, 12) for (a, b), z in zip(self.calibration, (words, meta)))
        by_words = self.prior + trust * (by_words - self.prior)
        return sigmoid(by_words), sigmoid(by_meta), sigmoid(by_words + by_meta - self.prior)


class _Listed:
    """Features of unlabelled texts in memory."""

    def __init__(self, pool: list[Features]):
        self.pool, self.size = pool, len(pool)

    def surest(self, model: Model, low: int, high: int, known: list[set]) -> list[tuple]:
        """(giver, key, label, features): the documents each view is surest of, without those that the other one knows."""
        views, out = _Rows(self.pool).views(model), []
        for giver in (0, 1):
            z = views[giver]
            order = [int(k) for k in np.argsort(z, kind="stable") if int(k) not in known[1 - giver]]
            out += [(giver, k, 0.0, self.pool[k]) for k in order[:low] if z[k] < -SURE]
            out += [(giver, k, 1.0, self.pool[k]) for k in order[::-1][:high] if z[k] > SURE]
        return out


class _Stored:
    """All unlabelled rows of a table with columns text, lang, source (or of their features); scored on the executors, nothing but the surest reaches the driver.

    labelled: table of ids that are not to be chosen.
    """

    def __init__(self, rows: DataFrame, max_pool: int, labelled: DataFrame | None = None):
        self.found, self.labelled = rows if "buckets" in rows.columns else featurised(rows), labelled
        self.size = min(max_pool, self._free(self.found.select("id", "key")).select("key").distinct().count())

    def _free(self, rows: DataFrame) -> DataFrame:
        return rows if self.labelled is None else rows.join(self.labelled, "id", "left_anti")

    def surest(self, model: Model, low: int, high: int, known: list[set]) -> list[tuple]:
        scored = self._free(_stored(self.found, ["row", "id", "key", "lang", "source"], "row long, id long, key long, lang string, source string, z0 double, z1 double", lambda rows: rows.views(model)))
        distinct = durable(scored.groupBy("key").agg(F.min(F.struct("lang", "source", "row", "z0", "z1")).alias("s")).select("key", "s.*"))
        picked = []
        for giver in (0, 1):
            z, free = F.col(f"z{giver}"), distinct.where(~F.col("key").isin(list(known[1 - giver]))) if known[1 - giver] else distinct
            picked += [(giver, r["key"], 0.0, r["row"]) for r in free.where(z < -SURE).orderBy(z, "key").limit(low).collect()]
            picked += [(giver, r["key"], 1.0, r["row"]) for r in free.where(z > SURE).orderBy(z.desc(), "key").limit(high).collect()]
        found = _fetched(self.found, {row for _, _, _, row in picked})
        return [(giver, k, label, found[row]) for giver, k, label, row in picked]


def _fetched(found: DataFrame, rows: set[int]) -> dict[int, Features]:
    """Features of a few rows, by row number."""
    if not rows:
        return {}
    few = found.sparkSession.createDataFrame([(r,) for r in sorted(rows)], "row long")
    got = found.select("row", "words", "buckets", "values", "meta").join(F.broadcast(few), "row").collect()
    return {r["row"]: _read(r["words"], r["buckets"], r["values"], r["meta"]) for r in got}


def train(labelled: list[tuple], pool, rounds: int = ROUNDS) -> Model:
    """Model from texts in memory. labelled: (text, lang, source, label); pool: (text, lang, source)."""
    known = _Remembered(_packed)
    return co_train([(features(*row[:3], known), row[3]) for row in labelled], _Listed([features(*row, known) for row in pool]), rounds)


def co_train(labelled: list[tuple[Features, int]], pool, rounds: int = ROUNDS) -> Model:
    """labelled: features and label of each text; pool: _Listed or _Stored."""
    y = np.array([label for _, label in labelled], float)
    if not len(y) or y.min() == y.max():
        return Model(base=float(y.mean()) if len(y) else 1.0)
    n = len(labelled)
    held = np.arange(n) % 4 == 3  # for calibration
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    texts, position = [found for found, _ in labelled], {}
    labels = [list(np.where(held, -1.0, y)) for _ in range(2)]  # what each view trains on; -1: not known to it
    known: list[set] = [set(), set()]
    model = Model()
    share = y.mean()

    def balanced(t):
        good, bad = max(1, (t == 1).sum()), max(1, (t == 0).sum())
        return np.where(t == 1, 0.5 * (good + bad) / good, 0.5 * (good + bad) / bad) ** 0.5

    def fit():
        rows = _Rows(texts)
        of_words, of_meta = (np.array(v) for v in labels)
        model.words, model.bias = _fit_words(rows, of_words >= 0, np.clip(of_words, 0, 1), balanced(of_words))
        use = of_meta >= 0
        model.meta = _weighted(rows.meta[use], of_meta[use], balanced(of_meta)[use])
        return rows.views(model)

    scores = fit()
    quota = max(1, int(HANDED * pool.size))
    for _ in range(rounds if pool.size else 0):
        moved = pool.surest(model, max(1, int(quota * (1 - share))), max(1, int(quota * share)), known)
        for giver, key, label, row in moved:
            if key not in position:
                position[key] = len(texts)
                texts.append(row)
                for v in labels:
                    v.append(-1.0)
            labels[1 - giver][position[key]] = label
            known[1 - giver].add(key)
        model.handed.append(len(moved))
        if not moved:
            break
        scores = fit()
    of = held if held.any() else np.ones(n, bool)
    views = [s[:n][of] for s in scores]
    t = y[of]
    model.calibration = tuple(tuple(logistic(np.stack([np.ones(len(t)), v], axis=1), t)) for v in views)
    model.prior = float(np.log(share / (1 - share)))
    return model


def _weighted(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = sigmoid(x @ w)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-5:
            break
    return w


def _columns(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text(text_col), F.lit("")).alias("text"), text(lang_col).alias("lang"), text(source_col).alias("source"))


def fitted(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="quality", lang_col="lang", source_col="source", max_labelled=MAX_LABELLED, max_pool=MAX_POOL, rounds=ROUNDS) -> Model:
    """Co-trained model from the bounded sample of labelled documents and all unlabelled ones."""
    return _fitted(featurised(_columns(docs, id_col, text_col, lang_col, source_col)), labels, id_col, label_col, max_labelled, max_pool, rounds)


def _fitted(found: DataFrame, labels: DataFrame, id_col="doc_id", label_col="quality", max_labelled=MAX_LABELLED, max_pool=MAX_POOL, rounds=ROUNDS) -> Model:
    ids = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    given = found.select("row", "id", "key").join(ids.where("id is not null and label is not null"), "id")
    first = given.groupBy("key").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id", "label", "row")).alias("s")).select("s.*")
    few = sorted(tuple(r) for r in first.orderBy("h", "id", "label").limit(max_labelled).collect())
    if len({label for _, _, label, _ in few}) < 2:
        return co_train([(None, label) for _, _, label, _ in few], None)
    got = _fetched(found, {row for _, _, _, row in few})
    return co_train([(got[row], label) for _, _, label, row in few], _Stored(found, max_pool, ids.select("id").distinct()), rounds)


def _raw_views(model: Model):
    """Function from lists of texts, languages and sources to (word view, metadata view, numbers of words), not calibrated."""
    known = _Remembered(_packed)

    def run(texts, langs, sources):
        rows = _Rows([features(*row, known) for row in zip(texts, langs, sources)])
        return *rows.views(model), rows.words

    return run


def _joint(model: Model, words: np.ndarray, meta: np.ndarray, n: np.ndarray) -> tuple:
    return model.combine(words, meta, n / (n + SHORT))


def score(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, id_col="doc_id", text_col="text", lang_col="lang", source_col="source", **fit) -> DataFrame:
    """One row for each document: doc_id, word_score, meta_score, score (probability of being good), keep."""
    found = featurised(_columns(docs, id_col, text_col, lang_col, source_col))
    model = _fitted(found, labels, id_col, **fit)

    def make(rows):
        if model.words is None:
            return [np.full(rows.n, model.base)] * 3
        return _joint(model, *rows.views(model), rows.words)

    scored = _stored(found, ["id"], "doc_id long, word_score double, meta_score double, score double", make)
    return scored.withColumn("keep", F.lit(model.words is None) | (F.col("score") >= threshold))


def survivors(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, id_col="doc_id", text_col="text", lang_col="lang", source_col="source", **fit) -> DataFrame:
    """The rows of docs that the classifier keeps, with their columns; rows are judged where they are, none is shuffled."""
    model = fitted(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col, **fit)
    if model.words is None:
        return docs
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = [names.index(c) for c in (text_col, lang_col, source_col)]

    def run(batches):
        views = _raw_views(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                text, lang, source = (part.column(i).to_pylist() for i in at)
                raw = views([str(t) if t is not None else "" for t in text], [None if v is None else str(v) for v in lang], [None if v is None else str(v) for v in source])
                yield part.filter(pa.array(_joint(model, *raw)[2] >= threshold))

    return plain.mapInArrow(run, plain.schema).toDF(*names)

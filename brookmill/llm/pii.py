"""Personal data by weak supervision.

Candidates are what fixed patterns find (base spans, always kept) and looser ones: written-out addresses, phone numbers
without a country code, social security and bank account numbers, keys. Six labelers vote on each candidate for, against
or not at all: patterns that admit nothing else, a gazetteer (top-level domains, country codes, issuers), cue words before
it, check sums and number structure, its edges, and the place it stands in. Votes are counted by kind and pattern over the
whole corpus; expectation-maximisation on these counts estimates how reliable each labeler is where it votes (an
abstention counts as missing; no labeler is worse than chance, which keeps the two classes from swapping), how frequent
real ones are in each kind, and how likely each pattern is real. A logistic classifier on features of the span and of its
context (shape, validity, words before it, marks around it) is then trained on these likelihoods and decides which looser
candidates become spans. It learns from at most `max_train` looser candidates, in the order of a hash of their places, and
from each of them once more without its context, as likely as the labelers then find it: so that a bare key or number is
an example against. The corpus is read once; what is counted and decided works on the candidates it left.

Base patterns run from anchors ('@', '+', digits) and never rescan a run, so time is linear in the text.

Defined cases: a null text counts as empty; documents without candidates have empty strings; rows that repeat an id are
searched each for itself; other columns are not read; an empty table gives no rows. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmill.llm.common import bounded, durable, sigmoid

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")
BASE = 4
LABELERS = 6
CUE, PLACE = 2, 5
MAX_PATTERNS = len(KINDS) * 3**LABELERS * 2
#: Looser candidates that the classifier learns from at most, and its hashed features.
MAX_TRAIN, DIM = 20_000, 1 << 13

# Patterns of the base spans, and gazetteers.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPOKEN = re.compile(r"(?i)\b[a-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[a-z0-9-]{1,64} ?(?:\(dot\)|\[dot\]| dot ) ?[a-z]{2,12}\b")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
_SECRET = re.compile(r"\b(?:[0-9a-f]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})\b")
_OWN_FORM = re.compile(r"AKIA|gh[pousr]_|sk-")
_VALUE = re.compile(r"[=:]\s*[\"'(<\[]?$")
_WORD = re.compile(r"[^\W\d_]+|e-mail")
TOP_DOMAINS = frozenset("com org net edu gov io de fr es uk eu info biz us ca".split())
COUNTRY_CODES = ("1", "33", "34", "44", "49", "39", "31", "41", "43", "46", "61", "81", "86", "91")
CUES = {
    "email": ("mail", "contact", "write", "e-mail"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "mastercard", "credit", "carte", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "account", "konto", "compte"),
    "secret": ("key", "token", "secret", "password", "api"),
}
AGAINST = ("version", "isbn", "doi", "build", "commit", "sha", "md5", "license", "page")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if "." in text:
        out += [(1, *m.span()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def looser_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates beyond the fixed patterns that don't overlap any of their spans."""
    found = []
    low = text.lower()
    if ("at" in low and "dot" in low) and ("(at)" in low or "[at]" in low or " at " in low):
        found += [(0, *m.span()) for m in _SPOKEN.finditer(text)]
    if any(c in text for c in "0123456789"):
        found += [(3, *m.span()) for m in _LOCAL_PHONE.finditer(text)]
        found += [(4, *m.span()) for m in _SSN.finditer(text)]
        found += [(5, *m.span()) for m in _IBAN.finditer(text)]
        found += [(6, *m.span()) for m in _SECRET.finditer(text)]
    out, ends = [], sorted((a, b) for _, a, b in taken)
    for kind, a, b in sorted(found, key=lambda s: (s[1], s[0])):
        if all(b <= x or a >= y for x, y in ends):
            out.append((kind, a, b))
            ends.append((a, b))
    return out


def _iban(text: str) -> bool:
    s = text.replace(" ", "")
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def votes(text: str, kind: int, start: int, end: int, base: bool) -> list[int]:
    """Votes of the labelers: 1 for, -1 against, 0 none."""
    name, span = KINDS[kind], text[start:end]
    before = text[max(0, start - 40) : start]
    words = _WORD.findall(before.lower())
    digits = _digits(span)
    strict = 1 if base or name == "secret" and _OWN_FORM.match(span) else 0
    cued = not base  # a looser candidate without a cue word speaks against itself
    if name == "email":
        listed = 1 if re.split(r"[.\s)\]]+", span.rstrip("."))[-1].lower() in TOP_DOMAINS else -1
        structure, cued = 1 if base else 0, False
    elif name == "phone":
        listed = (1 if digits.startswith(COUNTRY_CODES) else -1) if base else 0
        structure = 1 if 10 <= len(digits) <= 12 else -1
    elif name == "ip":
        listed = -1 if span.split(".")[0] in ("0", "255", "127") else 1
        structure = 1 if all(p == "0" or p[0] != "0" for p in span.split(".")) else -1
    elif name == "card":
        listed = 1 if digits[0] in "3456" else -1
        structure = 1
    elif name == "iban":
        listed = 1 if span[:2] in ("DE", "FR", "ES", "GB", "IT", "NL", "AT", "BE", "CH") else -1
        structure, cued = 1 if _iban(span) else -1, False
    elif name == "ssn":
        listed = -1 if span[:3] in ("000", "666") or span[0] == "9" else 0
        structure = 1 if span[4:6] != "00" and span[7:] != "0000" else -1
    else:
        listed, cued = (0, True) if re.fullmatch("[0-9a-f]+", span) else (1, False)
        structure = 1 if len(set(span)) >= 8 else -1
    cue = 1 if any(w.startswith(CUES[name]) for w in words) else -1 if any(w in AGAINST for w in words[-4:]) or cued else 0
    edges = text[start - 1 : start] + text[end : end + 1]
    edge = 1 if not any(c.isalnum() for c in edges) else -1
    if name == "secret":
        place = 1 if _VALUE.search(before) else -1
    else:
        line = text[max(0, start - 80) : end + 80]
        letters = sum(c.isalpha() or c == " " for c in line)
        place = 1 if letters >= 0.7 * (len(line) - (end - start)) else -1
    return [strict, listed, cue, structure, edge, place]


def pattern_code(kind: int, ballot: list[int], base: bool) -> int:
    code = kind
    for v in ballot:
        code = code * 3 + v + 1
    return code * 2 + int(base)


def read_code(code: int) -> tuple[int, list[int], bool]:
    code, base = divmod(code, 2)
    ballot = []
    for _ in range(LABELERS):
        code, v = divmod(code, 3)
        ballot.insert(0, v - 1)
    return code, ballot, bool(base)


def without_context(ballot: list[int]) -> list[int]:
    """Votes on the same span where nothing before it speaks for it."""
    return [-1 if j in (CUE, PLACE) else v for j, v in enumerate(ballot)]


class Reliability:
    """Expectation-maximisation over vote patterns.

    right[t, j]: probability that labeler j, where it votes, votes for a real span (t = 1) or against another (t = 0);
    prior: share of real spans in each kind, kept within 0.05..0.75, as a pattern alone proves little.
    """

    def __init__(self, kinds: np.ndarray, ballots: np.ndarray, counts: np.ndarray, rounds: int = 40):
        self.right, self.prior = np.full((2, LABELERS), 0.7), np.full(len(KINDS), 0.5)
        for k in range(rounds):
            q = self.likely(kinds, ballots) if k else np.clip(0.5 + 0.15 * ballots.sum(axis=1), 0.05, 0.95)
            for t, share in ((1, q * counts), (0, (1 - q) * counts)):
                good, voted = share @ (ballots == (1 if t else -1)), share @ (ballots != 0)
                self.right[t] = np.clip((good + 4) / (voted + 6), 0.5, 0.99)
            real, every = (np.bincount(kinds, w, len(KINDS)) for w in (q * counts, counts))
            self.prior = np.clip((real + 2) / (every + 4), 0.05, 0.75)

    def likely(self, kinds: np.ndarray, ballots: np.ndarray) -> np.ndarray:
        """Probability that each pattern is real."""
        for_, against = np.log(self.right[1] / (1 - self.right[0])), np.log((1 - self.right[1]) / self.right[0])
        prior = self.prior[kinds]
        return sigmoid(np.log(prior / (1 - prior)) + (ballots == 1) @ for_ + (ballots == -1) @ against)


def features(text: str, kind: int, start: int, end: int, ballot: list[int]) -> tuple[list[int], list[int]]:
    """Hashed features of a span, and of its context."""
    span, name = text[start:end], KINDS[kind]
    shape = re.sub(r"(.)\1+", r"\1", "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in span[:24]))
    own = [f"{name}", f"{name} shape {shape[:8]}", f"{name} length {min(8, (end - start) // 8)}", f"{name} listed {ballot[1]}", f"{name} valid {ballot[3]}", f"{name} form {ballot[0]}"]
    before = text[max(0, start - 40) : start]
    around = [f"{name} near {w}" for w in _WORD.findall(before.lower())[-4:]]
    around += [f"{name} cue {v}" for v in CUES[name] if v in before.lower()]
    around += [f"{name} {side} {'a' if c.isalnum() else c}" for side, c in (("left", text[start - 1 : start]), ("right", text[end : end + 1]))]
    around += [f"{name} value"] * bool(_VALUE.search(before))
    return tuple([zlib.crc32(f.encode("utf-8", "surrogatepass")) % DIM for f in dict.fromkeys(fs)] for fs in (own, around))


def train(rows: list[tuple[list[int], float]], steps: int = 300) -> np.ndarray:
    """Weights by hashed feature of a logistic classifier, the constant last. rows: (features, likelihood)."""
    w, gain = np.zeros(DIM + 1), np.full(DIM + 1, 1e-6)
    if not rows:
        return w
    of = np.repeat(np.arange(len(rows)), [len(f) + 1 for f, _ in rows])
    at = np.array([i for f, _ in rows for i in (*f, DIM)])
    q = np.array([p for _, p in rows])
    for _ in range(steps):
        off = q - sigmoid(np.bincount(of, w[at], len(rows)))
        up = np.bincount(at, off[of], DIM + 1) - 0.02 * w
        gain += up**2
        w += 0.3 * up / np.sqrt(gain)
    return w


_ITEM = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("code", pa.int32()), ("own", pa.list_(pa.int32())), ("around", pa.list_(pa.int32()))])
_SPANS = "array<struct<kind:int,start:int,end:int,code:int,own:array<int>,around:array<int>>>"


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: array of (kind, start, end, code, own, around) of all candidates; the last bit of code marks base spans, which have no features."""

    def search(text: str) -> list[dict]:
        base = base_spans(text)
        out = []
        for spans, fixed in ((base, True), (looser_spans(text, base), False)):
            for kind, a, b in spans:
                ballot = votes(text, kind, a, b, fixed)
                own, around = ([], []) if fixed else features(text, kind, a, b, ballot)
                out.append({"kind": kind, "start": a, "end": b, "code": pattern_code(kind, ballot, fixed), "own": own, "around": around})
        return out

    def run(batches):
        for batch in batches:
            spans = [search(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_ITEM))], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, spans {_SPANS}")


def fitted(found: DataFrame, max_train: int = MAX_TRAIN) -> np.ndarray:
    """Classifier of looser candidates, from the labelers' votes on all candidates."""
    each = found.select("doc_id", F.explode("spans").alias("s"))
    tally = sorted(tuple(r) for r in bounded(each.groupBy("s.code").count(), MAX_PATTERNS, "vote patterns"))
    if not tally:
        return train([])
    read = [read_code(c) for c, _ in tally]
    model = Reliability(np.array([k for k, _, _ in read]), np.array([b for _, b, _ in read]), np.array([n for _, n in tally], float))
    place = F.xxhash64("doc_id", "s.start", "s.end")
    sample = each.where("s.code % 2 = 0").orderBy(place, "doc_id", "s.start", "s.end", "s.code").limit(max_train).select("s.code", "s.own", "s.around").collect()
    rows = []
    for code, own, around in sample:
        kind, ballot, _ = read_code(code)
        p = model.likely(np.array([kind, kind]), np.array([ballot, without_context(ballot)]))
        rows += [([*own, *around], float(p[0])), (own, float(p[1]))]
    return train(rows)


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id and spans: array of (kind, start, end, base), by kind and start: base spans and candidates of probability `least` or more."""
    found = durable(candidates(docs, id_col=id_col, text_col=text_col))
    weights = fitted(found, max_train)
    item = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def keep(s: dict) -> bool:
        return s["code"] % 2 == 1 or bool(sigmoid(weights[[*s["own"], *s["around"], DIM]].sum()) >= least)

    def run(batches):
        for batch in batches:
            spans = [[{"kind": s["kind"], "start": s["start"], "end": s["end"], "base": s["code"] % 2 == 1} for s in of if keep(s)] for of in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(item))], names=["doc_id", "spans"])

    kept = found.mapInArrow(run, "doc_id long, spans array<struct<kind:int,start:int,end:int,base:boolean>>")
    return kept.select("doc_id", F.array_sort("spans").alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

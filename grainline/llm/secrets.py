"""Secret scans (operator 6): fixed credential patterns, and formats learned by grammar inference.

From a bounded sample of labelled credentials (the values the fixed patterns find, by kind) a prefix tree is built and
its statistically compatible states are merged (Hoeffding bound on their symbol and ending frequencies), which gives one
probabilistic automaton per kind; a like automaton is inferred from ordinary tokens (words, numbers, addresses). Every token
over the alphabet of labelled credentials, of their least length or more and covered by no fixed pattern, is scored: the log
likelihood under its best credential automaton against the ordinary one. Above ``MIN_RATIO`` it is reported as kind ``format``.
Unlabelled credentials among the ordinary tokens would hide their own kind: those with a letter and a digit that are as likely
a symbol, under a credential automaton, as its own examples are, are not learnt from. Every one is scored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

# The patterns of the three base kinds and their least lengths (of group 2 for assign).
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "format")

MIN_CANDIDATE = min(LEAST.values())
MIN_RATIO = math.log(1e4)
MAX_EXAMPLES = 2_000  # per kind
MAX_LENGTH = 256  # symbols of an example that are learnt from; the end of a longer one is not counted
MAX_KNOWN = 200_000  # class strings whose ratio a task remembers
ALPHA = 0.05
TYPICAL = 0.05  # this share of a kind's examples may be less likely than what counts as typical of it
TOKEN = re.compile(rb"[A-Za-z0-9+/_.=-]{%d,}" % MIN_CANDIDATE)
_MIXED = re.compile(rb"(?=.*[0-9])(?=.*[A-Za-z])", re.DOTALL)
_HEX = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))

#: Symbol classes of the automata: digits, a-f, other lower case, upper case; any other character is its own class.
_CLASS = bytes(
    ord("d") if 48 <= i <= 57 else ord("h") if 97 <= i <= 102 else ord("l") if 97 <= i <= 122 else ord("u") if 65 <= i <= 90 else i for i in range(256)
)
_CLASS_SIZE = {ord("d"): 10, ord("h"): 6, ord("l"): 20, ord("u"): 26}
N_CLASSES = 12
END = -1


def base_spans(raw: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start, kind, end, value) in bytes: leftmost non-overlapping matches of each base kind that are long enough."""
    out = []
    if b"=" in raw or b":" in raw:
        low = raw.lower()
        if any(k in low for k in KEYWORDS):
            out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(raw) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(raw) if len(m[0]) >= LEAST["access"]]
    if b"x" * LEAST["hex"] in raw.translate(_HEX):
        out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(raw) if len(m[0]) >= LEAST["hex"]]
    return sorted(out)


def candidates(raw: bytes, spans: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int]]:
    """Start and end of the tokens that touch none of the sorted spans, in one pass over both."""
    at, far = 0, 0  # spans before ``at`` start before the token's end; ``far`` is the greatest end of those
    for m in TOKEN.finditer(raw):
        a, b = m.span()
        while at < len(spans) and spans[at][0] < b:
            far = max(far, spans[at][2])
            at += 1
        if far <= a:
            yield a, b


class Automaton:
    """A probabilistic automaton over symbol classes, by state merging."""

    def __init__(self, examples: list[bytes], alpha: float = ALPHA):
        self.next: list[dict[int, int]] = [{}]
        self.count: list[dict[int, int]] = [defaultdict(int)]
        for e in examples:
            s = 0
            for c in e[:MAX_LENGTH].translate(_CLASS):
                self.count[s][c] += 1
                if c not in self.next[s]:
                    self.next[s][c] = len(self.next)
                    self.next.append({})
                    self.count.append(defaultdict(int))
                s = self.next[s][c]
            if len(e) <= MAX_LENGTH:
                self.count[s][END] += 1
        self.alpha = alpha
        self._merge_states()
        self.total = [sum(c.values()) for c in self.count]
        self.count = [dict(c) for c in self.count]

    def _differ(self, a: int, b: int) -> bool:
        """Whether the Hoeffding bound tells the next-symbol frequencies of two states apart."""
        ca, cb = self.count[a], self.count[b]
        na, nb = sum(ca.values()), sum(cb.values())
        if not na or not nb:
            return False
        bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
        return any(abs(ca.get(x, 0) / na - cb.get(x, 0) / nb) > bound for x in ca.keys() | cb.keys())

    def _compatible(self, a: int, b: int) -> bool:
        """``b`` is the root of a tree: both and all their common successors must agree."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(a, b):
                return False
            todo += [(self.next[a][x], t) for x, t in self.next[b].items() if x in self.next[a]]
        return True

    def _fold(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            for x, n in self.count[b].items():
                self.count[a][x] += n
            for x, t in self.next[b].items():
                if x in self.next[a]:
                    todo.append((self.next[a][x], t))
                else:
                    self.next[a][x] = t

    def _merge_states(self) -> None:
        red = [0]
        while True:
            blue = [(s, x, t) for s in red for x, t in self.next[s].items() if t not in red]
            if not blue:
                return
            s, x, t = max(blue, key=lambda b: (sum(self.count[b[2]].values()), -b[2]))
            for r in red:
                if self._compatible(r, t):
                    self.next[s][x] = r
                    self._fold(r, t)
                    break
            else:
                red.append(t)

    def log_likelihood(self, token: bytes) -> float:
        """Log probability of a token's characters (a class's characters are equally likely) and of its end."""
        s: int | None = 0
        out = 0.0
        for c in [*token.translate(_CLASS), END]:
            n, k = (self.count[s].get(c, 0), self.total[s]) if s is not None else (0, 0)
            out += math.log((n + 0.5) / (k + 0.5 * (N_CLASSES + 1))) - math.log(_CLASS_SIZE.get(c, 1))
            s = self.next[s].get(c) if s is not None else None
        return out


class Formats:
    """The learned formats; without examples there are none and nothing is added."""

    def __init__(self, credentials: dict[str, list[bytes]], ordinary: list[bytes]):
        self.kinds = {k: Automaton(v) for k, v in sorted(credentials.items()) if v}
        floors = {k: self._floor(a, credentials[k]) for k, a in self.kinds.items()}
        typical = lambda t: any(self._per_symbol(a, t) >= floors[k] for k, a in self.kinds.items())
        self.ordinary = Automaton([t for t in ordinary if not (_MIXED.match(t) and typical(t))])
        self.known: dict[bytes, bool] = {}  # by class string, which decides the ratio

    @staticmethod
    def _per_symbol(a: Automaton, token: bytes) -> float:
        return a.log_likelihood(token[:MAX_LENGTH]) / (min(len(token), MAX_LENGTH) + 1)

    @classmethod
    def _floor(cls, a: Automaton, examples: list[bytes]) -> float:
        each = sorted(cls._per_symbol(a, e) for e in examples)
        return each[int(TYPICAL * len(each))]

    def ratio(self, token: bytes) -> float:
        """Log of how much likelier the token is as its best credential format than as an ordinary token."""
        if not self.kinds:
            return -math.inf
        return max(a.log_likelihood(token) for a in self.kinds.values()) - self.ordinary.log_likelihood(token)

    def spans(self, raw: bytes, base: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, int, bytes]]:
        if not self.kinds:
            return []
        out, known, classes = [], self.known, raw.translate(_CLASS)
        for a, b in candidates(raw, base):
            shape = classes[a:b]
            hit = known.get(shape)
            if hit is None:
                hit = self.ratio(raw[a:b]) >= MIN_RATIO
                if len(known) >= MAX_KNOWN:
                    known.clear()
                if len(shape) <= MAX_LENGTH:
                    known[shape] = hit
            if hit:
                out.append((a, 3, b, raw[a:b]))
        return out


def examples(documents: DataFrame, max_examples: int = MAX_EXAMPLES) -> tuple[dict[str, list[bytes]], list[bytes]]:
    """Distinct credentials by kind and ordinary tokens: of each the ``max_examples`` of lowest hash, from all documents in
    one scan. Each task sends no more than that, so the driver gets a bounded list. Longer examples than ``MAX_LENGTH`` keep
    one symbol more, which tells that their end is unknown."""
    cut = MAX_LENGTH + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[bytes, int]] = defaultdict(dict)
        highest: dict[str, int] = defaultdict(lambda: 1 << 32)  # no hash above it can be among the lowest

        def trim(most: int) -> None:
            for k, v in held.items():
                if len(v) > most:
                    held[k] = dict(sorted(v.items(), key=lambda x: (x[1], x[0]))[:max_examples])
                    highest[k] = max(held[k].values())

        for b in batches:
            for t in b.column("text").cast(pa.binary()):
                raw = t.as_py()
                if not raw:
                    continue
                spans = base_spans(raw)
                for _, k, _, v in spans:
                    v = v[:cut]
                    held[KINDS[k]][v] = zlib.crc32(v)
                ordinary = held["ordinary"]
                for start, end in candidates(raw, spans):
                    v = raw[start : min(end, start + cut)]
                    if v not in ordinary and (h := zlib.crc32(v)) <= highest["ordinary"]:
                        ordinary[v] = h
                trim(4 * max_examples)
        trim(max_examples)
        rows = [(k, v, h) for k, x in held.items() for v, h in x.items()]
        yield pa.RecordBatch.from_pydict({"kind": pa.array([r[0] for r in rows], pa.string()), "value": pa.array([r[1] for r in rows], pa.binary()), "h": pa.array([r[2] for r in rows], pa.int64())})

    found = documents.select("text").mapInArrow(run, "kind string, value binary, h long").distinct()
    found = Scratch(documents.sparkSession, "secrets").keep(found, "examples")
    out = {}
    for kind in ("assign", "access", "hex", "ordinary"):
        rows = found.where(F.col("kind") == kind).orderBy("h", "value").limit(max_examples)
        out[kind] = sorted(bytes(r["value"]) for r in rows.collect())
    return out, out.pop("ordinary")


def scan(documents: DataFrame, formats: Formats) -> DataFrame:
    """One row per document row: doc_id, n_assign, n_access, n_hex, n_format, base_sha256, spans.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind. A null or empty text has none (the
    digest is then that of the empty string). Repeated rows give the same result each; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = sha256(b"").hexdigest()
        for b in batches:
            n = [[0] * b.num_rows for _ in KINDS]
            digests, joined = [empty] * b.num_rows, [""] * b.num_rows
            for i, t in enumerate(b.column("text").cast(pa.binary())):
                raw = t.as_py() or b""
                base = base_spans(raw)
                spans = sorted(base + formats.spans(raw, base))
                if not spans:
                    continue
                at, chars, names = 0, 0, []
                place = {}
                for p in sorted({p for s in spans for p in (s[0], s[2])}):
                    chars += len(raw[at:p].decode("utf-8", "replace"))
                    place[p], at = chars, p
                for start, k, end, _ in spans:
                    n[k][i] += 1
                    names.append((k, f"{KINDS[k]}:{place[start]}:{place[end]}"))
                joined[i] = ",".join(x for _, x in names)
                digests[i] = sha256(",".join(x for k, x in names if k < 3).encode()).hexdigest()
            cols = [b.column("doc_id"), *[pa.array(x, pa.int64()) for x in n], pa.array(digests), pa.array(joined)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string"
    )


def find_secrets(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Learn the formats from the documents' own credentials and scan every document."""
    return scan(documents, Formats(*examples(documents)))

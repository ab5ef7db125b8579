"""Personal data found by a semi-Markov conditional random field over text segments.

Base spans.  Four patterns (email, ip, card, phone) with their checks give the spans that
are always reported; each kind takes leftmost non-overlapping matches and drops those that
fail its check.

Model.  A text is cut into tokens (runs of letters, runs of digits, single other
characters; white space is a token too).  Only tokens near a trigger - a digit or ``@`` -
can be part of an entity, so each maximal window of tokens around triggers is labelled on
its own.  A segmentation of a window consists of entity segments of up to ``MAX_TOKENS``
tokens and outside segments of one token.  Candidate segments are scored as wholes: kind,
number of digits, valid checksum, octets in range, separators, character classes beside the
segment, the words before it, all conjoined with the kind.  Dynamic programming over
segment ends sums (training) or maximises (decoding) over all segmentations, so boundaries
and types are chosen jointly; entities are bounded in tokens, and so is the work per token.

Training.  The base spans of a bounded sample of documents (``MAX_TRAIN``, least md5 of the
id) are the labels; log-likelihood is raised by stochastic gradient steps on the driver.
Decoding runs on every whole text in Spark tasks.

Results.  Base spans stay as they are; entities of the model that overlap no base span are
added.  Null and empty texts have no spans.  Repeated rows give equal rows; an empty table
gives no rows; a training sample without any window leaves the base spans alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import doc_text, hash_sample, map_arrow

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 24
MAX_TRAIN = 3000  # documents
MAX_WINDOWS = 4000  # and windows of theirs that the fit uses at most
EPOCHS, RATE = 6, 0.2
BITS = 14

# The contract's patterns, written so that no input makes them look back over long runs.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGIT_CHAIN = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def emails(text: str) -> Iterable[Span]:
    """Every match ends behind an @; its local part is the run of allowed characters before
    that @, as far as an earlier match leaves it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterable[Span]:
    """Chains of numbers joined by single dots, four by four."""
    for m in NUMBERS.finditer(text):
        at, parts = m.start(), m[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield "ip", at, end
            at = end + 1


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def cards(text: str) -> Iterable[Span]:
    for m in DIGIT_CHAIN.finditer(text):
        if 14 <= m.end() - m.start() <= 37:
            digits = only_digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()


def phones(text: str) -> Iterable[Span]:
    for m in PHONE.finditer(text):
        if 10 <= len(only_digits(m[0])) <= 15:
            yield "phone", m.start(), m.end()


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind in the order of ``KINDS``."""
    found = [*(emails(text) if "@" in text else ()), *ips(text), *cards(text), *(phones(text) if "+" in text else ())]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# ---- the model ------------------------------------------------------------------------

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|.", re.DOTALL)
TRIGGER = re.compile(r"[0-9@]")
NUMERIC_MARKS = frozenset("+(). -")


def windows(text: str) -> list[tuple[int, int]]:
    """(start, end) of the stretches around triggers: each trigger's own chunk of other than
    white space (up to 64 characters either way) and what one blank joins to it."""
    out: list[tuple[int, int]] = []
    at = 0
    while m := TRIGGER.search(text, at):
        low, floor = m.start(), max(at, m.start() - 64)
        while low > floor and not text[low - 1].isspace():
            low -= 1
        high, roof = m.end(), min(len(text), m.end() + 64)
        while high < roof and not text[high].isspace():
            high += 1
        # A blank followed by digits, brackets or a plus sign goes on: "+1 (555) 010-0000".
        if out and low - out[-1][1] <= 1:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
        at = high
    return out


def shape(s: str) -> str:
    """Character classes of a segment, runs shortened: 555-0101 is d-d."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "d", s)))[:24]


def segment_features(text: str, start: int, end: int, kind: str) -> list[int]:
    """Hashed features of the candidate text[start:end] as an entity of ``kind``."""
    s = text[start:end]
    digits = only_digits(s)
    checks = {"email": bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s)),
              "ip": s.count(".") == 3 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255
                                              for p in s.split(".")),
              "card": 14 <= len(digits) <= 19 and luhn(digits),
              "phone": s[:1] == "+" and 10 <= len(digits) <= 15}
    before, after = text[start - 1:start], text[end:end + 1]
    names = ["bias", f"check={checks[kind]}", f"shape={shape(s)}", f"digits={len(digits)}", f"length={min(len(s), 40) // 4}",
             f"before={shape(before) if before.strip() else 'blank'}", f"after={shape(after) if after.strip() else 'blank'}",
             f"check={checks[kind]},after={shape(after) if after.strip() else 'blank'}",
             f"word={text[max(0, start - 16):start].lower().split()[-1:]}"]
    return [_hash(f"{kind}|{n}") for n in names]


def _hash(name: str) -> int:
    return zlib.crc32(name.encode()) % (1 << BITS)


class Lattice:
    """The candidate segments of one window of a text."""

    def __init__(self, text: str, start: int, end: int):
        self.cuts = [start, *[m.end() for m in TOKEN.finditer(text, start, end)]]
        self.size = len(self.cuts) - 1
        # by_end[j]: (i, kind, features) of the candidates from token i to before token j.
        self.by_end: list[list[tuple[int, str, list[int]]]] = [[] for _ in range(self.size + 1)]
        tokens = [text[a:b] for a, b in zip(self.cuts, self.cuts[1:])]
        last_at = max((k for k, t in enumerate(tokens) if t == "@"), default=-1)
        for i, first in enumerate(tokens):
            numeric = first[0] in "+(0123456789"
            if not (numeric or first[0] in LOCAL_CHARS):
                continue
            digits = dots = ats = blanks = 0
            for j in range(i, min(self.size, i + MAX_TOKENS)):
                t = tokens[j]
                if "0" <= t[0] <= "9":
                    digits += len(t)
                elif t[0].isalpha() or t not in NUMERIC_MARKS:
                    numeric = False
                dots, ats, blanks = dots + (t == "."), ats + (t == "@"), blanks + t.isspace()
                if not numeric and (blanks or last_at < i):
                    break  # neither a number nor an address any more
                kinds = []
                if ats == 1 and not blanks and i < last_at < j and t.isalnum():
                    kinds.append("email")
                if numeric and "0" <= t[0] <= "9":
                    if dots == 3 and not blanks and digits <= 16:
                        kinds.append("ip")
                    if 12 <= digits <= 19 and first != "+":
                        kinds.append("card")
                    if 7 <= digits <= 15 and not (dots == 3 and digits <= 12):
                        kinds.append("phone")
                for kind in kinds:
                    a, b = self.cuts[i], self.cuts[j + 1]
                    self.by_end[j + 1].append((i, kind, segment_features(text, a, b, kind)))

    def best(self, w: np.ndarray) -> list[Span]:
        """The entities of the best segmentation; outside tokens score zero."""
        score, back = [0.0] * (self.size + 1), [None] * (self.size + 1)
        for j in range(1, self.size + 1):
            score[j] = score[j - 1]
            for i, kind, f in self.by_end[j]:
                x = score[i] + float(w[f].sum())
                if x > score[j]:
                    score[j], back[j] = x, (i, kind)
        out, j = [], self.size
        while j:
            i, kind = back[j] or (j - 1, None)
            if kind:
                out.append((kind, self.cuts[i], self.cuts[j]))
            j = i
        return out[::-1]

    def step(self, w: np.ndarray, gold: set[Span], rate: float) -> None:
        """One gradient step on the window's log-likelihood: expectations by forward and
        backward sums over all segmentations."""
        n = self.size
        weight = [[float(w[f].sum()) for _, _, f in row] for row in self.by_end]
        forward, backward = np.zeros(n + 1), np.full(n + 1, -np.inf)
        for j in range(1, n + 1):
            into = [forward[i] + x for (i, _, _), x in zip(self.by_end[j], weight[j])]
            forward[j] = np.logaddexp.reduce([forward[j - 1], *into])
        backward[n] = 0.0
        for j in range(n, 0, -1):
            backward[j - 1] = np.logaddexp(backward[j - 1], backward[j])
            for (i, _, _), x in zip(self.by_end[j], weight[j]):
                backward[i] = np.logaddexp(backward[i], x + backward[j])
        for j in range(1, n + 1):
            for (i, kind, f), x in zip(self.by_end[j], weight[j]):
                p = np.exp(min(0.0, forward[i] + x + backward[j] - forward[n]))
                np.add.at(w, f, rate * (((kind, self.cuts[i], self.cuts[j]) in gold) - p))


def fit(texts: list[str]) -> np.ndarray | None:
    """Weights from the base spans of a bounded list of texts; None without candidates."""
    examples: list[tuple[Lattice, set[Span]]] = []
    for text in texts:
        gold, end = set(), -1
        for span in base_spans(text):
            if span[1] >= end:  # overlapping spans cannot be in one segmentation
                gold.add(span)
                end = span[2]
        for a, b in windows(text):
            lattice = Lattice(text, a, b)
            if any(lattice.by_end):
                examples.append((lattice, gold))
        if len(examples) >= MAX_WINDOWS:
            break
    if not examples:
        return None
    w = np.zeros(1 << BITS)
    for epoch in range(EPOCHS):
        for lattice, gold in examples:
            lattice.step(w, gold, RATE / (1 + epoch))
    return w


def train(docs: DataFrame) -> np.ndarray | None:
    """The weights learned from a bounded sample of the documents that have a trigger."""
    found = doc_text(docs).filter(F.col("text").rlike("[0-9@]"))
    return fit([r["text"] for r in hash_sample(found, MAX_TRAIN).collect()])


def find(text: str, w: np.ndarray | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a whole text."""
    if not TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    added: list[Span] = []
    if w is not None:
        for a, b in windows(text):
            inside = [s for s in base if s[1] < b and s[2] > a]
            found = Lattice(text, a, b).best(w)
            added += [s for s in found if not any(s[1] < e and s[2] > st for _, st, e in inside)]
    return base, sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def find_spans(docs: DataFrame, w: np.ndarray | None) -> DataFrame:
    """(doc_id, spans): kind, start, end (code points, end exclusive) and whether it is a base
    span, by start and kind."""
    shared = docs.sparkSession.sparkContext.broadcast(w)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                               ("base", pa.bool_())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column("text").to_pylist():
            base, spans = find(text, shared.value)
            known = set(base)
            rows.append([{"kind": s[0], "start": s[1], "end": s[2], "base": s in known} for s in spans])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return map_arrow(doc_text(docs), run, f"doc_id long, spans {SPANS}")


def redact_text(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; spans that overlap
    an earlier one are part of its replacement."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, w: np.ndarray | None) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and, if it is there, ``n_chars``
    counted anew for texts that changed; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(w)
    names = docs.columns
    at = names.index("text")
    counted = names.index("n_chars") if "n_chars" in names else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        new = [t and redact_text(t, find(t, shared.value)[1]) for t in texts]
        arrays = list(batch.columns)
        arrays[at] = pa.array(new, batch.schema.field(at).type)
        if counted is not None:
            old = batch.column(counted).to_pylist()
            arrays[counted] = pa.array([c if a == b else len(b) for a, b, c in zip(texts, new, old)],
                                       batch.schema.field(counted).type)
        return pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return map_arrow(docs, run, docs.schema)


def query(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (all, joined)."""
    found = find_spans(docs, train(docs))
    base = F.filter("spans", lambda s: s["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(text(base), 256).alias("base_sha256"),
                        text(F.col("spans")).alias("spans"),
                        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))

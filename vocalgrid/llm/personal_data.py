"""Operator 13: personal data by boosted trees over candidate spans.

Method: generators of high recall propose spans of each kind (email, ip, card, phone), many of them overlapping: every run around an
@, quads and runs of colon-separated hexadecimal groups, and every row of neighbouring digit groups with a fitting number of digits.
Boosted trees (``boosted``) score each proposal by its format (groups, separators, check digit, parts) and its context (characters
and numbers beside it, cue words ahead of it). A score is calibrated to a probability, and a threshold for each kind, the lowest that reaches
``PRECISION`` on documents not fitted on, selects the spans to redact; of overlapping ones the likelier stays.

The base spans are fixed patterns with fixed checks, found by passes linear in the text. They are proposals that always stay;
proposals that overlap one of them are dropped.

Training: contexts are ``TRAIN_DOCS`` documents at most, each of at most ``TRAIN_CHARS`` characters, drawn by the hash of their text; made-up spans of known kind and
look-alikes (dates, versions, serial numbers, numbers that fail their check) are written into them, some next to each other. Proposals equal to a
planted span, or to a base span of the document itself, are positive; all others are negative. One task fits the model, so a lost executor repeats it alike.
No ids, labels, languages or sources are used. Without usable documents the spans stand in empty contexts.

Defined cases: null and empty texts have no spans; repeated rows give repeated results; ties in score go to the longer span, then to
the first; a span never overlaps another of the result, but for base spans of two kinds; null ids are carried; other columns are not
looked at, whatever their names; an empty table gives an empty result. Whole texts are read, whatever their length.
"""

from __future__ import annotations

import bisect
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalgrid.llm.boosted import BoostedTrees

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS = 400
TRAIN_CHARS = 20_000
PLANTED = 14
PRECISION = 0.98
SCORED = 20_000
SPAN = "struct<kind:string,start:int,end:int,score:double,base:boolean>"

# The base patterns. Each is written so that its pass is linear: an email is read from its @, a digit run only from its first digit.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Proposals. Wider than the base patterns.
_WIDE_LOCAL = re.compile(r"[\w.%+\-!#$&'*/=?^{|}~]")
_WIDE_DOMAIN = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*")
_SPELLED_AT = re.compile(r"\s?[\[({]\s?at\s?[\])}]\s?|\sat\s", re.I)
_SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s|\.)[A-Za-z0-9-]{1,63}){1,5}", re.I)
_WIDE_QUAD = re.compile(r"(?<![0-9])[0-9]{1,4}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,4}){3}(?![0-9])")
_COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
_COLON_REST = re.compile(r"(?:[0-9A-Fa-f]{0,4}:){1,8}[0-9A-Fa-f]{0,4}")
_REGION = re.compile(r"[0-9](?:[ ().\-/]{0,3}[0-9])++")
_GROUP = re.compile(r"[0-9]+")
_HEX = frozenset("0123456789abcdefABCDEF")

CUES = {
    "email": ("mail", "contact", "write", "reach", "@"), "ip": ("ip", "host", "server", "addr", "network", "from", "ping", "gateway"),
    "card": ("card", "visa", "credit", "debit", "pay", "amex", "master", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "fax", "mobil", "cell", "whatsapp", "sms", "dial", "contact"),
}
AGAINST = ("version", "ver.", "release", "section", "chapter", "isbn", "order", "invoice", "serial", "part no", "id", "no.", "token", "hash", "sha", "date", "page", "ratio", "build", "time", "iban", "ref", "#")


def luhn(digits: str) -> bool:
    doubled = (int(c) * 2 for c in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted: leftmost matches of each kind that do not overlap, without those that fail their check."""
    found = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, 0, end))
        at = text.find("@", at + 1)
    found += [(m.start(), 1, m.end()) for m in _QUAD.finditer(text) if all(map(_small, m[0].split(".")))]
    for kind, pattern, low, high in ((2, _CARD, 14, 19), (3, _PHONE, 10, 15)):
        for m in pattern.finditer(text):
            digits = "".join(_GROUP.findall(m[0]))
            if low <= len(digits) <= high and (kind == 3 or luhn(digits)):
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def proposals(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind number, end) of every candidate, each once; nothing but the text is held."""
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and _WIDE_LOCAL.match(text[start - 1]):
            start -= 1
        # Marks of the text around an address are no part of it.
        while start < at and not text[start].isalnum():
            start += 1
        domain = _WIDE_DOMAIN.match(text, at + 1)
        if start < at and domain:
            yield start, 0, domain.end()
        last = at + 1
        at = text.find("@", at + 1)
    for m in _SPELLED_AT.finditer(text):
        start = m.start()
        while start > 0 and m.start() - start < 64 and text[start - 1] in _LOCAL:
            start -= 1
        domain = _SPELLED_DOMAIN.match(text, m.end())
        if start < m.start() and domain:
            yield start, 0, domain.end()
    for m in _WIDE_QUAD.finditer(text):
        yield m.start(), 1, m.end()
    last = 0
    for m in _COLONS.finditer(text):
        start = m.start()
        while start > last and m.start() - start < 4 and text[start - 1] in _HEX:
            start -= 1
        if m.start() >= last:
            last = _COLON_REST.match(text, start).end()
            yield start, 1, last
    for region in _REGION.finditer(text):
        yield from _rows_of_groups(text, region)


def _rows_of_groups(text: str, region: re.Match) -> Iterator[tuple[int, int, int]]:
    """Neighbouring digit groups of a region that have as many digits as a card or a telephone number together."""
    if region.end() - region.start() < 7:
        return
    groups = [(m.start(), m.end()) for m in _GROUP.finditer(text, region.start(), region.end())]
    for k, (start, _) in enumerate(groups):
        digits = 0
        opened = start
        if opened and text[opened - 1] == "(":
            opened -= 1
        if opened and text[opened - 1] == "+":
            opened -= 1
        for begin, end in groups[k:]:
            digits += end - begin
            if digits > 19:
                break
            if digits >= 13:
                yield start, 2, end
            if 7 <= digits <= 15:
                yield opened, 3, end


def _side(text: str, at: int) -> int:
    """What stands at a place: 0 nothing or white space, 1 a letter, 2 a digit, 3 an end mark, 4 a bracket or quote, 5 any other."""
    if at < 0 or at >= len(text) or text[at].isspace():
        return 0
    c = text[at]
    return 1 if c.isalpha() else 2 if c.isdigit() else 3 if c in ".,;:!?" else 4 if c in "()[]{}<>\"'" else 5


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format and context of one proposal."""
    span = text[start:end]
    parts = _GROUP.findall(span)
    sizes = [len(p) for p in parts[:64]]
    digits = sum(map(len, parts))
    ahead, behind = text[max(start - 40, 0) : start].lower(), text[end : end + 24]
    local, _, domain = span.partition("@")
    labels = domain.split(".") if domain else []
    hexes = span.split(":") if kind == 1 and ":" in span else []
    before, after = text[max(start - 3, 0) : start].rstrip(" "), behind[:3].lstrip(" ")
    return [
        kind, len(span), digits, sum(map(str.isalpha, span)), len(parts),
        *[sizes[k] if k < len(sizes) else 0 for k in range(4)], sizes[-1] if sizes else 0, max(sizes, default=0), min(sizes, default=0),
        span.startswith("+"), span.startswith("00"), "(" in span, *[span.count(c) for c in ".- /:["],
        kind >= 2 and luhn("".join(parts)), len(parts) == 4 and all(map(_small, parts)), any(len(p) > 1 and p[0] == "0" for p in parts[:64]), int(span[0]) if span[0] in "0123456789" else -1,
        len(local) if domain else 0, len(labels), len(labels[-1]) if labels else 0, bool(labels) and labels[-1].isalpha(), "dot" in span.lower(),
        len(hexes), max(map(len, hexes), default=0), sum(not h for h in hexes), sum(map(len, hexes)),
        _side(text, start - 1), _side(text, end), _side(before, len(before) - 1), _side(after, 0), text[start - 1 : start] in ("#", "$", "€", "v", "V", "_", "/", "="),
        sum(c in ahead for c in CUES[KINDS[kind]]), sum(c in ahead for c in AGAINST), sum(map(str.isdigit, ahead[-16:])), sum(map(str.isdigit, behind[:16])),
    ]


def _matrix(rows: list[list[float]]) -> np.ndarray:
    return np.array(rows, dtype=np.float64).reshape(len(rows), -1)


class Detector:
    """Trees and the threshold of each kind; without trees only base spans are found."""

    def __init__(self, trees: BoostedTrees | None = None, thresholds: tuple[float, ...] = (2.0,) * len(KINDS)) -> None:
        self.trees, self.thresholds = trees, thresholds

    def state(self) -> tuple[dict, tuple[float, ...]]:
        """Plain values that ``of`` makes the same detector from."""
        return vars(self.trees), self.thresholds

    @classmethod
    def of(cls, trees: dict, thresholds: tuple[float, ...]) -> Detector:
        made = BoostedTrees()
        vars(made).update(trees)
        return cls(made, thresholds)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int, float, bool]]]:
        """(start, kind number, end, score, base) of every text, sorted. Proposals are scored ``SCORED`` at a time, whichever text they are of."""
        kept: list[list[tuple]] = [[] for _ in texts]
        likely: list[list[tuple]] = [[] for _ in texts]
        held: list[tuple[int, tuple[int, int, int], bool]] = []

        def score() -> None:
            if held:
                rows = _matrix([features(texts[i], *c) for i, c, _ in held]) if self.trees else None
                for (i, c, base), p in zip(held, (self.trees.score(rows) if self.trees else np.ones(len(held))).tolist()):
                    if base or p >= self.thresholds[c[1]]:
                        (kept if base else likely)[i].append((*c, p, base))
                held.clear()

        for i, text in enumerate(texts):
            base = base_spans(text)
            held += [(i, c, True) for c in base]
            for c in filter(_free_of(base), proposals(text) if self.trees else ()):
                held.append((i, c, False))
                if len(held) >= SCORED:
                    score()
        score()
        return [sorted(k + _apart(x)) for k, x in zip(kept, likely)]


def _free_of(base: list[tuple[int, int, int]]):
    """Whether a candidate overlaps no base span."""
    starts, reach = [b[0] for b in base], np.maximum.accumulate([b[2] for b in base]).tolist() if base else []

    def free(c: tuple[int, int, int]) -> bool:
        k = bisect.bisect_left(starts, c[2])
        return k == 0 or reach[k - 1] <= c[0]

    return free


def _apart(scored: list[tuple[int, int, int, float, bool]]) -> list[tuple[int, int, int, float, bool]]:
    """The likeliest ones of which none overlap."""
    starts: list[int] = []
    ends: list[int] = []
    out = []
    for x in sorted(scored, key=lambda x: (-x[3], x[0] - x[2], x)):
        k = bisect.bisect_right(starts, x[0])
        if (k == 0 or ends[k - 1] <= x[0]) and (k == len(starts) or x[2] <= starts[k]):
            starts.insert(k, x[0])
            ends.insert(k, x[2])
            out.append(x)
    return out


# --- training data ---


class _Maker:
    """Made-up spans with their kind, and look-alikes with none."""

    def __init__(self, seed: int) -> None:
        self.r = np.random.default_rng(seed)

    def one(self, choices):
        return choices[int(self.r.integers(len(choices)))]

    def digits(self, n: int, first: str = "0123456789") -> str:
        return self.one(first) + "".join(map(str, self.r.integers(0, 10, n - 1))) if n else ""

    def shaped(self, shape: str) -> str:
        """Every n becomes a digit, every N one that is not 0; the rest stays."""
        return "".join(str(self.r.integers(0, 10)) if c == "n" else str(self.r.integers(1, 10)) if c == "N" else c for c in shape)

    def word(self) -> str:
        return "".join(self.one("abcdefghijklmnopqrstuvwxyz") for _ in range(int(self.r.integers(3, 9))))

    def number(self, good: bool) -> str:
        """Digits of a card that pass the check, or fail it."""
        n = self.one((14, 15, 16, 16, 16, 16, 19))
        head = self.digits(n - 1, "3456" if good else "123456789")
        last = next(c for c in "0123456789" if luhn(head + c))
        return head + (last if good else str((int(last) + int(self.r.integers(1, 10))) % 10))

    def card(self, good: bool) -> str:
        d, mark = self.number(good), self.one(("", "", " ", "-", "."))
        cuts = (0, 4, 10, 15) if len(d) == 15 else (0, 4, 10, 14) if len(d) == 14 else (*range(0, len(d), 4), len(d))
        return mark.join(d[i:j] for i, j in zip(cuts, cuts[1:]))

    def email(self) -> str:
        local = self.one((self.word(), f"{self.word()}.{self.word()}", f"{self.word()}{self.digits(2)}", f"{self.word()}+{self.word()}", f"mü{self.word()}", f"{self.word()}é.{self.word()}"))
        domain = self.one((f"{self.word()}.com", f"{self.word()}.{self.word()}.org", f"{self.word()}-{self.word()}.co.uk", f"{self.word()}.de", f"ä{self.word()}.eu"))
        if self.r.random() < 0.25 and (local + domain).isascii():
            return f"{local}{self.one(('[at]', ' [at] ', '(at)', ' (at) '))}{domain.replace('.', self.one(('.', '[dot]', ' [dot] ', ' (dot) ')))}" if self.r.random() < 0.7 else f"{local} at {domain.replace('.', ' dot ')}"
        return f"{local}@{domain}"

    def ip(self) -> str:
        if self.r.random() < 0.3:
            groups = [f"{int(self.r.integers(1, 65536)):x}" for _ in range(8)]
            k = int(self.r.integers(1, 6))
            return ":".join(groups) if self.r.random() < 0.5 else f"{':'.join(groups[:k])}::{':'.join(groups[k + 1 : k + 1 + int(self.r.integers(1, 7 - k))])}"
        return self.one((".", ".", ".", "[.]", "(.)")).join(str(self.r.integers(0, 256)) for _ in range(4))

    def phone(self) -> str:
        return self.shaped(self.one((
            "+1 (nnn) nnn-nnnn", "+1 (nnn) nnn-nnnn", "+1-nnn-nnn-nnnn", "+1 nnn nnn nnnn", "+1.nnn.nnn.nnnn", "(Nnn) Nnn-nnnn", "Nnn-Nnn-nnnn", "Nnn.Nnn.nnnn", "+NN nnn nnnnnn", "+NN nn nnnn nnnn",
            "+NN N nn nn nn nn", "+NN Nnn nnn nnn", "+NN (0)nn nnnnnnn", "+NN/Nnn/nnnnnn", "00NN Nnn nnnnnnn", "00NN Nn nnn nnnn",
        )))

    def planted(self) -> tuple[str, str, int | None]:
        """(words ahead, span, kind or None for a look-alike)."""
        kind = int(self.r.integers(0, 9))
        if kind < 4:
            cue = self.one(CUES[KINDS[kind]][:4]) + self.one((": ", " ", ". ")) if self.r.random() < 0.3 else ""
            if kind == 3 and self.r.random() < 0.15:
                # A bare number is one only after its cue.
                return self.one(("tel ", "phone: ", "call ", "fax ")), self.shaped(self.one(("Nnnnnnnnnn", "0nnn nnnnnnn", "Nnn nnnn"))), 3
            return cue, (self.email(), self.ip(), self.card(True), self.phone())[kind], kind
        cue = self.one(AGAINST) + self.one((" ", ": ")) if self.r.random() < 0.4 else ""
        if kind == 4:
            return cue, self.card(False), None
        return cue, self.one((
            lambda: self.shaped(self.one(("20nn-0N-1n", "1n.0N.20nn", "20nn-0N-1n 1n:nn:nn", "19nn-20nn", "0N/1n/20nn", "nn:nn:nn", "1nnn-1nnn, 1nnn"))),
            lambda: self.shaped(self.one(("Nnn,nnn.nn", "N.nnnnnnnnn", "N nnn nnn nnn", "nnnnn-nnnn", "978-N-nn-nnnnnn-n", "N.nn.nnn", "nn - nn - nn", "N nn nnn nn", "NNNN NNN NN", "nn (nn) nn nn nn (nn)"))),
            lambda: self.digits(int(self.r.integers(7, 22))),
            lambda: self.one(("v", "#", "no", "$", "")) + self.digits(int(self.r.integers(7, 14))),
            lambda: f"{self.one('vV')}{self.shaped('N.n.nn.n')}", lambda: self.shaped("3nn.nnn.9nn.nn"), lambda: self.shaped("N.nnnn.n.nnn"),
            lambda: "".join(self.one("0123456789abcdef") for _ in range(40)), lambda: ":".join(f"{int(x):02x}" for x in self.r.integers(0, 256, 6)),
            lambda: f"@{self.word()}", lambda: f"{self.word()}@{self.word()}", lambda: f"{self.word()} @ {self.word()}.{self.word()}", lambda: f"{self.word()}@{self.shaped('n.n')}", lambda: f"{self.word()} at {self.word()}.{self.word()}",
            lambda: " ".join(self.digits(4) for _ in range(int(self.r.integers(5, 8)))), lambda: " ".join(self.digits(1) for _ in range(12)), lambda: "DE" + self.shaped("nn nnnn nnnn nnnn nnnn nn"),
        ))(), None


def training_rows(texts: list[str], seed: int = 13) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and document numbers of all proposals in the texts with spans written into them."""
    rows, labels, owner = [], [], []
    for i, text in enumerate(texts or [""] * 50):
        maker = _Maker(seed * 1_000_003 + i)
        places = sorted(int(x) for x in maker.r.integers(0, len(text) + 1, PLANTED))
        out, known, size, last = [], set(), 0, 0
        for k, place in enumerate(places):
            # Spans stand between words, now and then right behind one another.
            gap = text.find(" ", place)
            place = max(last, len(text) if gap < 0 else gap) if maker.r.random() > 0.2 else last
            cue, span, kind = maker.planted()
            ahead = f"{text[last:place]}{maker.one((' ', ' ', ' ', chr(10), ' (', ' **'))}{cue}"
            out += [ahead, span, maker.one((" ", " ", " ", ", ", ". ", "\n", ") ", "### ", "!! "))]
            if kind is not None:
                known.add((size + len(ahead), kind, size + len(ahead) + len(span)))
            size += sum(map(len, out[-3:]))
            last = place
        whole = "".join([*out, text[last:]])
        base = set(base_spans(whole))
        for c in sorted({*proposals(whole), *base}):
            rows.append(features(whole, *c))
            labels.append(c in known or c in base)
            owner.append(i)
    return _matrix(rows), np.array(labels, dtype=np.float64), np.array(owner)


def trained(texts: list[str]) -> Detector:
    """Trees fitted on three of four texts; calibration and thresholds from the fourth ones."""
    x, y, owner = training_rows(texts)
    aside = owner % 4 == 3
    trees = BoostedTrees()
    trees.fit(x[~aside], y[~aside])
    trees.calibrate(x[aside], y[aside])
    score = trees.score(x[aside])
    thresholds = []
    for kind in range(len(KINDS)):
        own, label = score[x[aside][:, 0] == kind], y[aside][x[aside][:, 0] == kind]
        # The lowest score from which on nearly all are right.
        reached = [s for s in np.unique(own) if s >= 0.5 and label[own >= s].mean() >= PRECISION]
        thresholds.append(float(min(reached, default=2.0)))
    return Detector(trees, tuple(thresholds))


def fitted(docs: DataFrame, n_docs: int = TRAIN_DOCS) -> Detector:
    """The detector trained on contexts of a bounded sample of ``docs``."""
    usable = docs.select(F.xxhash64("text").alias("draw"), "text").where(F.length("text").between(1, TRAIN_CHARS))
    # A share of the hashes that holds some times the sample, so that only few texts are shuffled however many there are.
    share = min(1.0, 8 * n_docs / max(docs.count(), 1))
    near = usable.where(F.pmod("draw", F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = near.groupBy("draw").agg(F.min("text").alias("text")).orderBy("draw").limit(n_docs)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((row["draw"], row["text"]) for batch in batches for row in batch.to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trained([t for _, t in rows]).state())], pa.binary())], names=["model"])

    made = sample.repartition(1).mapInArrow(train, "model binary").collect()
    return Detector.of(*pickle.loads(bytes(made[0]["model"]))) if made else trained([])


def _batches(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    texts, begin, held = [], 0, 0
    for k in range(len(batch)):
        texts.append(batch.column(1)[k].as_py() or "")
        held += len(texts[-1])
        if held >= limit or k + 1 == len(batch):
            yield begin, texts
            texts, begin, held = [], k + 1, 0


def personal_spans(docs: DataFrame, detector: Detector) -> DataFrame:
    """doc_id and the array ``spans`` (kind, start, end in code points, score, base), sorted by start, then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))
        for batch in batches:
            for begin, texts in _batches(batch):
                made = [[{"kind": KINDS[k], "start": s, "end": e, "score": p, "base": b} for s, k, e, p, b in spans] for spans in detector.spans(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), pa.array(made, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, spans array<{SPAN}>")


def redacted(docs: DataFrame, detector: Detector) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; all columns stay."""

    @F.pandas_udf("string")
    def run(texts):
        import pandas as pd

        filled = ["" if t is None else t for t in texts]
        return pd.Series([None if t is None else replaced(t, s) for t, s in zip(texts, detector.spans(filled))], dtype=object)

    return docs.withColumn("text", run("text"))


def replaced(text: str, spans: list[tuple[int, int, int, float, bool]]) -> str:
    """Spans that overlap are taken out together, under the first one's name."""
    out, last = [], 0
    for start, kind, end, *_ in spans:
        if start >= last:
            out += [text[last:start], f"[{KINDS[kind].upper()}]"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

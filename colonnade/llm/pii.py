"""Personal data: candidate spans from high-recall generators, judged by boosted trees.

Generators propose overlapping spans: the four base formats (email, ip, card, phone), which always stay once their own checks
hold, and wider ones: assigned secrets, telephone numbers without a country code, spelled-out addresses (name at host dot
com), account numbers (IBAN), social security numbers and hardware addresses. Every proposal is described by format and
context features (lengths, character classes, entropy, check digits, neighbours, cue words before it). Gradient-boosted trees
score it, and each kind has a threshold chosen on held-out labelled spans for a precision of ``PRECISION``. Of overlapping
proposals that pass, the base span wins, then the higher score, then the earlier and longer; only a secret stays beside base spans
that are smaller parts of it, for by chance a long one holds a card number. Neither a secret nor the name before it nor the parts of a
spelled-out address have a longest length; the other formats have the lengths that their standards give.

The trees are trained in the driver on labelled spans that ``labelled`` writes from a seed (``EXAMPLES`` of each kind, half of them
look-alikes: dates, versions, prices, order numbers, hashes of files); nothing is learned from the corpus, so results do not
depend on its size. The model (a few thousand numbers) travels with the tasks.

Scale: one pass over whole texts without a shuffle; a task holds one Arrow batch. Every pattern is anchored so that its work is
linear in the text, runs of 100,000 digits or pluses included; secrets are found from the = or : sign and spelled-out addresses from
their "at", the name backwards from it. Overlaps are found in marks over the text and by bisection, so many spans cost no more each.

Defined results: null and empty texts have no spans; repeated rows give repeated rows; an empty table an empty result; other
columns do not matter. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm import boosting
from colonnade.llm.batches import bounded_batches

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("secret", "national_phone", "spelled_email", "iban", "ssn", "mac")
KINDS = BASE_KINDS + MORE_KINDS
EXAMPLES = 600
PRECISION = 0.98
CONTEXT = 24

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGNED = re.compile(r"[=:][\x20]{0,2}[\"']?([A-Za-z0-9+/_-]{16,}+={0,2}+)(?![A-Za-z0-9+/_=-])")
NAME = LOCAL - frozenset("%+")
NAME_START = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z]")
#: " at host dot com" in words or brackets, as it follows a name.
SPELLED = re.compile(
    r"(?<=[A-Za-z0-9._-])(?:\x20?[\[({]\x20?|\x20)(?:at|AT)(?:\x20?[\])}]\x20?|\x20)[A-Za-z0-9-]++(?:\x20?[\[({]\x20?|\x20)(?:dot|DOT)(?:\x20?[\])}]\x20?|\x20)[A-Za-z]{2,12}(?![A-Za-z])"
)
MORE = {
    "national_phone": re.compile(r"(?<![0-9A-Za-z+.(-])\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{2,4}(?:[\x20./-][0-9]{2,5}){1,3}(?![0-9A-Za-z-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "mac": re.compile(r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])"),
}
#: What a text must hold for a generator to be tried at all.
HINTS = {
    "secret": re.compile(r"[=:]"), "national_phone": re.compile(r"[0-9]"), "spelled_email": re.compile(r"dot|DOT"), "iban": re.compile(r"[A-Z]{2}[0-9]{2}"),
    "ssn": re.compile(r"[0-9]-[0-9]"), "mac": re.compile(r"[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]"),
}
CUES = {
    "secret": re.compile(r"token|secret|passw|pwd|api[_-]?key|access|auth|credential|private", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|cell|fax|whatsapp|contact|dial", re.I),
    "mail": re.compile(r"mail|contact|write|reach", re.I),
    "account": re.compile(r"iban|account|bank|konto|transfer", re.I),
    "number": re.compile(r"ssn|social|security|tax", re.I),
    "device": re.compile(r"mac|device|hardware|ethernet|wifi", re.I),
    "plain": re.compile(r"order|version|date|invoice|isbn|page|sha|commit|hash|checksum|price|total|article|build|id\b", re.I),
}


QUOTES, SIGNS = frozenset("\"'"), frozenset("#$€v")  # one character each: the text's borders are none of them


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base formats, sorted by start, then by the order of BASE_KINDS."""
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end(), "email"))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], BASE_KINDS.index(s[2])))


def secrets(text: str) -> list[tuple[int, int, str]]:
    """Values of 16 characters or more that are assigned to a name of two or more."""
    found, last = [], 0
    m = ASSIGNED.search(text)
    while m:
        end = m.start()
        while end > max(last, m.start() - 2) and text[end - 1] == " ":
            end -= 1
        start = end
        while start > last and text[start - 1] in NAME:
            start -= 1
        if NAME_START.search(text, start, end - 1):
            found.append((*m.span(1), "secret"))
            last = m.end()
        m = ASSIGNED.search(text, max(last, m.start() + 1))
    return found


def spelled_emails(text: str) -> list[tuple[int, int, str]]:
    """Addresses whose signs are spelled out; a name starts where its run of letters, digits and ._- does."""
    found, last = [], 0
    for m in SPELLED.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in NAME:
            start -= 1
        if start < m.start():
            found.append((start, m.end(), "spelled_email"))
        last = m.end()
    return found


GENERATORS = {"secret": secrets, "spelled_email": spelled_emails}


def proposals(text: str) -> list[tuple[int, int, str]]:
    """Overlapping spans of the wider formats."""
    found = []
    for kind in MORE_KINDS:
        if HINTS[kind].search(text):
            found += GENERATORS[kind](text) if kind in GENERATORS else [(*m.span(), kind) for m in MORE[kind].finditer(text)]
    return found


def iban_remainder(span: str) -> int:
    s = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context of one proposal."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + 8]
    n = len(span)
    digits = [c for c in span if "0" <= c <= "9"]
    letters = sum(c.isalpha() for c in span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)] or [0]
    counts = Counter(span)
    entropy = -sum(v / n * math.log2(v / n) for v in counts.values())
    return [
        KINDS.index(kind), n, len(digits), letters, sum(c.isupper() for c in span), len(digits) / n, len(counts), entropy,
        sum(c in "0123456789abcdefABCDEF" for c in span) / n, span.count("-"), span.count("."), span.count(" "), span.count("/"), span.count(":"), float("(" in span), float("[" in span),
        len(groups), groups[0], groups[-1], max(groups), float(bool(digits) and luhn("".join(digits))), float(kind == "iban" and iban_remainder(span) == 1),
        float(kind == "ssn" and (span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000")),
        float(groups[0] in (19, 20) or (len(groups) > 1 and span[:2] in ("19", "20") and groups[0] == 4)), float(len(groups) > 2 and all(int("".join(g)) <= 31 for g in re.findall(r"[0-9]{1,2}", span)[:2])),
        float(before[-1:].isalnum()), float(before[-1:] in QUOTES), float(before[-1:] in SIGNS), float(after[:1] in QUOTES), float(after[:1].isalnum()),
        *[float(bool(c.search(before))) for c in CUES.values()],
    ]


def _word(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randrange(2, 9)))


def _text(rng: random.Random) -> str:
    return " ".join(_word(rng) for _ in range(rng.randrange(1, 6)))


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _iban(rng: random.Random) -> str:
    body = _digits(rng, rng.choice((14, 18, 20)))
    code = rng.choice(("DE", "FR", "ES", "GB", "NL"))
    for check in range(2, 99):
        s = f"{code}{check:02d}{body}"
        if iban_remainder(s) == 1:
            return s if rng.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))
    raise AssertionError


def _example(rng: random.Random, kind: str, real: bool) -> tuple[str, str, str]:
    """(text before, span, text after) of a labelled span."""
    cue = {"secret": "token secret api_key password auth_token access_key", "national_phone": "phone: |tel. |call me on |mobile |fax |", "spelled_email": "mail me: |contact |write to |", "iban": "IBAN |account |bank |", "ssn": "SSN |social security no. |", "mac": "MAC |device |"}[kind]
    plain = rng.choice(("order ", "version ", "date ", "invoice ", "page ", "total ", "", _word(rng) + " "))
    d = lambda n: _digits(rng, n)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    any64 = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-") for _ in range(n))
    if kind == "secret":
        if real:
            q = rng.choice(('"', "'", ""))
            lead = rng.choice(cue.split()) + rng.choice((" = ", "=", ": ", ":")) + q
            return (lead.upper() if rng.random() < 0.15 else lead), rng.choice((hexa, any64))(rng.randrange(20, 65)), q
        lead = rng.choice(("sha1", "checksum", "commit", "file", "ref", "see", "url", "name", _word(rng))) + rng.choice((" = ", ": ", "="))
        return lead, rng.choice((hexa(40), "-".join(_word(rng) for _ in range(5)) + "-abcdefgh", "_".join(_word(rng) for _ in range(4)) + "_abcdefgh", d(20), "a" * rng.randrange(16, 40))), ""
    if kind == "national_phone":
        if real:
            return rng.choice(cue.split("|")), rng.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)}/{d(3)}-{d(3)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}")), ""
        return plain, rng.choice((f"20{d(2)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", f"{rng.randrange(1, 29):02d}.{rng.randrange(1, 13):02d}.19{d(2)}", f"{rng.randrange(1, 29):02d}/{rng.randrange(1, 13):02d}/20{d(2)}", f"{d(2)}.{d(2)}.{d(2)}", f"{d(3)} {d(3)} {d(3)}", f"{d(2)} {d(2)} {d(3)}", f"{d(4)} {d(4)} {d(4)} {d(4)}")), ""
    if kind == "spelled_email":
        if real:
            a, dot = rng.choice(((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" AT ", " DOT "), ("[at]", "[dot]")))
            return rng.choice(cue.split("|")), f"{_word(rng)}.{_word(rng)}{a}{_word(rng)}{dot}{rng.choice(('com', 'org', 'net', 'de'))}", ""
        return _text(rng) + " ", f"{_word(rng)} at {rng.choice(('the', 'a', 'one', 'this'))} dot {rng.choice(('and', 'of', 'marks', 'on', 'where'))}", ""
    if kind == "iban":
        return rng.choice(cue.split("|") if real else [plain]), _iban(rng) if real else f"{rng.choice(('AB', 'ISO', 'XQ'))[:2]}{d(2)} {d(4)} {d(4)}{'' if rng.random() < 0.5 else ' ' + d(4)}", ""
    if kind == "ssn":
        if real:
            return rng.choice(cue.split("|")), f"{rng.randrange(100, 665)}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}", ""
        return rng.choice((plain, "part no. ")), rng.choice((f"000-{d(2)}-{d(4)}", f"9{d(2)}-{d(2)}-{d(4)}", f"{d(3)}-00-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}")), ""
    sep = rng.choice(":-")
    if real:
        return rng.choice(cue.split("|")), sep.join(hexa(2) for _ in range(6)), ""
    return plain, rng.choice(("00:00:00:00:00:00", sep.join(f"{rng.randrange(1, 13):02d}" for _ in range(6)))), ""


def labelled(seed: int = 11, examples: int = EXAMPLES) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Features, labels and kinds of synthetic spans."""
    rng, x, y, kinds = random.Random(seed), [], [], []
    for kind in MORE_KINDS:
        for i in range(examples):
            lead, span, tail = _example(rng, kind, real := i % 2 == 0)
            before = _text(rng) + " " + lead
            text = before + span + tail + rng.choice((" ", ". ", ", ")) + _text(rng)
            x.append(features(text, len(before), len(before) + len(span), kind))
            y.append(float(real))
            kinds.append(kind)
    return np.array(x), np.array(y), kinds


@dataclass
class Judge:
    trees: boosting.Trees
    thresholds: dict[str, float]

    def choose(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """The base spans, and all spans sorted by start and kind."""
        if not text:
            return [], []
        base = base_spans(text)
        wide = proposals(text)
        if not wide:
            return base, base
        scores = self.trees.scores(np.array([features(text, *s) for s in wide]))
        free = _Free(base, len(text))
        added = []
        for score, s in sorted(zip(scores.tolist(), wide, strict=True), key=lambda p: (-p[0], p[1][0], -p[1][1])):
            if score >= self.thresholds[s[2]] and free.takes(*s):
                added.append(s)
        return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


class _Free:
    """What of a text no chosen span covers. Base spans are known at first; added ones never overlap each other."""

    def __init__(self, base: list[tuple[int, int, str]], length: int):
        self.whole = {(a, b) for a, b, _ in base}
        self.starts = [a for a, _, _ in base]
        self.ends = np.maximum.accumulate([b for _, b, _ in base]).tolist() if base else []  # largest end up to each base span
        self.added = bytearray(length)

    def _end_before(self, at: int) -> int:
        """The largest end of the base spans that start before a position."""
        k = bisect_left(self.starts, at)
        return self.ends[k - 1] if k else 0

    def takes(self, start: int, end: int, kind: str) -> bool:
        """Whether the span may stay, which then is marked. Secrets may hold smaller base spans, others may touch none."""
        if self.added.find(1, start, end) >= 0:
            return False
        if kind == "secret":
            if self._end_before(start) > start or self._end_before(end) > end or (start, end) in self.whole:
                return False
        elif self._end_before(end) > start:
            return False
        self.added[start:end] = b"\1" * (end - start)
        return True


@lru_cache(maxsize=1)
def judge() -> Judge:
    """Trained once in the driver."""
    x, y, kinds = labelled(11)
    trees = boosting.fit(x, y)
    x2, y2, kinds2 = labelled(12)
    scores, kinds2 = trees.scores(x2), np.array(kinds2)
    return Judge(trees, {k: boosting.threshold_for(scores[kinds2 == k], y2[kinds2 == k], PRECISION) for k in MORE_KINDS})


def span_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


DETECTED = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def detect(docs: DataFrame) -> DataFrame:
    """One row per document (DETECTED): counts and digest of the base spans, and all spans."""
    bounded_batches(docs.sparkSession)
    j = judge()
    out = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in BASE_KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1):
                base, spans = j.choose(text.as_py() or "")
                n = Counter(k for _, _, k in base)
                rows.append((*[n[k] for k in BASE_KINDS], hashlib.sha256(span_text(base).encode()).hexdigest(), span_text(spans), len(spans) - len(base)))
            cols = [pa.array([r[i] for r in rows], out.field(i + 1).type) for i in range(7)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], schema=out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DETECTED)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by the name of its first kind."""
    out, last = [], 0
    for a, b, kind in spans:
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join(out) + text[last:]


def redact(docs: DataFrame) -> DataFrame:
    """The rows of docs with the text redacted (null stays null), and n_chars to match where there is such a column; columns and types stay."""
    bounded_batches(docs.sparkSession)
    j, names = judge(), docs.columns
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text in b.column(at):
                t = text.as_py()
                spans = j.choose(t)[1] if t else []
                texts.append(redacted(t, spans) if spans else t)
            cols = list(b.columns)
            cols[at] = pa.array(texts, b.schema.field(at).type)
            if chars is not None:
                lengths = [n if t is None else len(t) for t, n in zip(texts, cols[chars].to_pylist(), strict=True)]
                cols[chars] = pa.array(lengths, b.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)

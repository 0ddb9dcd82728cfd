"""Personal data: candidate spans, boosted trees, calibrated thresholds, redaction.

Base patterns (email, ip, card, phone) always count.  Beyond them, generous
generators propose overlapping spans; boosted trees score each by its format and
context.  Probabilities are calibrated, and a kind's threshold chosen, on examples of
other formats and wordings than those the trees were fitted on: the threshold is the
least that keeps a stated precision there.  Of overlapping candidates the likeliest
stays, and none may touch a base span.

The trees are fitted on examples made here from a fixed seed, since no table labels
personal data; their number is a parameter.  Offsets are code points.  Every pattern
is anchored or bounded, so that a long run of digits or letters is read once.

A null or empty text has no spans, ties between candidates go to the earlier, then
the longer, repeated rows give equal results, an empty table an empty one, and
other columns stay in ``redact``.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.llm import boosting
from augury.llm.common import map_column, map_rows

Span = tuple[str, int, int]
BASE_KINDS = ("email", "ip", "card", "phone")
#: All kinds in the order of listing; the base kinds first.
KINDS = (*BASE_KINDS, "id", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping matches: each @ is tried once, from the start of the run before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield "email", start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _ips(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping matches: of each run of numbers and single dots, four numbers at a time."""
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        at, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[k : k + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts[k : k + 4]):
                yield "ip", at, at + size
            at += size + 1


def base_spans(text: str | None) -> list[Span]:
    if not text:
        return []
    out = list(_emails(text))
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += _ips(text)
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start():
            d = _only_digits(m[0])
            if len(d) <= 19 and len(d) >= 16 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_only_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


#: Generators: generous patterns for what the base patterns miss.  Each begins with something rare or is bounded.
_AT = re.compile(r"(?:\(at\)|\[at\]|\bat\b)\s?[A-Za-z0-9-]{1,63}\s?(?:\(dot\)|\[dot\]|\bdot\b)\s?[A-Za-z]{2,6}\b", re.I)
_DOT = re.compile(r"dot", re.I)
_GENERATORS = (
    ("phone", re.compile(r"\(?\b[0-9]{2,4}\)?[ ./-][0-9]{2,4}(?:[ ./-][0-9]{2,5}){1,3}\b")),
    ("phone", re.compile(r"\b00[1-9][0-9]{1,2}[ -]?[0-9]{6,10}\b")),
    ("card", re.compile(r"\b[0-9]{4}(?:[ -]?[0-9]{4}){3}\b|\b[0-9]{13,19}\b")),
    ("id", re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b")),
    ("id", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_+/=.-])[A-Za-z0-9_+/=.-]{20,}(?![A-Za-z0-9_+/=.-])")),
)
#: What a word for a secret is followed by, with or without digits.
_HINTED = re.compile(r"\b(?:passwords?|passwd|passphrase|pwd|secret|token|credentials?|bearer|api[_ -]?key)\b[\"']?\s?(?:is|:=|=>|=|:)\s?[\"']?([^\s\"'<>,;]{6,})", re.I)
_HINT_PARTS = ("passw", "passp", "pwd", "secret", "token", "credential", "bearer", "api")
ADDED_KINDS = ("email", "card", "phone", "id", "secret")
_FOR = {
    "phone": ("call", "phone", "tel", "mobile", "fax", "whatsapp", "dial", "ring"),
    "email": ("mail", "contact", "write", "reach"),
    "card": ("card", "visa", "credit", "debit", "paid", "amex"),
    "id": ("ssn", "social", "iban", "account", "passport", "tax"),
    "secret": ("token", "secret", "key", "passw", "bearer", "auth", "credential", "pwd"),
}
_AGAINST = (
    "order", "version", "isbn", "invoice", "page", "item", "serial", "build", "ticket", "sum", "date", "release", "ref",
    "commit", "sha", "md5", "hash", "uuid", "http", "path", "file", "digest", "revision", "score",
)
_DATE = re.compile(r"^(?:(?:19|20)[0-9]{2}[ ./-][01]?[0-9][ ./-][0-3]?[0-9]|[0-3]?[0-9][ ./-][0-3]?[0-9][ ./-](?:19|20)[0-9]{2})$")


def candidates(text: str) -> list[Span]:
    """Overlapping spans that may be personal data."""
    out: list[Span] = []
    if _DOT.search(text):
        for m in _AT.finditer(text):
            end = m.start()
            end -= int(end > 0 and text[end - 1].isspace())
            start = end
            while start > 0 and end - start < 64 and text[start - 1] in _LOCAL:
                start -= 1
            if start < end:
                out.append(("email", start, m.end()))
    if _DIGIT.search(text):
        for kind, pattern in _GENERATORS:
            for m in pattern.finditer(text):
                # a secret has digits and letters
                if kind != "secret" or _DIGIT.search(m[0]) and any(map(str.isalpha, m[0])):
                    out.append((kind, *m.span()))
    low = text.lower()
    if any(h in low for h in _HINT_PARTS):
        for m in _HINTED.finditer(text):
            end = m.end(1) - (m[1][-1] in ".!?)")
            out.append(("secret", m.start(1), end))
    return list(dict.fromkeys(out))


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate, as numbers."""
    kind, a, b = span
    s = text[a:b]
    before, after = text[max(0, a - 40) : a].lower(), text[b : b + 20].lower()
    d = _only_digits(s)
    groups = re.findall(r"[0-9]+", s)
    pos = [before.rfind(w) for w in _FOR[kind]]
    neg = [before.rfind(w) for w in _AGAINST]
    tight = before.rstrip("\"'` ")[-1:]
    return [
        *[float(kind == k) for k in ADDED_KINDS],
        len(s), len(d), len(groups), max(map(len, groups), default=0), float(luhn(d)) if len(d) > 11 else -1.0,
        float(s[:1] == "("), float("-" in s), float("." in s), float(" " in s), float("/" in s), float(len(set(d))), float(bool(_DATE.match(s))),
        float(max(pos) >= 0), float(max(neg) >= 0), float(max(pos) > max(neg)), float(any(w in after for w in _FOR[kind])),
        float(before[-1:].isalnum() or before[-1:] in "._-#$"), float(after[:1].isalnum() or after[:1] in "._-"),
        float(bool(re.search(r"[(\[](?:at|dot)[)\]]", s, re.I))), float(s[:2].isalpha() and s[2:4].isdigit()),
        float(tight in ("=", ":")), len(set(s)) / len(s), float(s.lower() != s != s.upper()), float(not s.lower().strip("0123456789abcdef")),
    ]


def _examples(n: int, seed: int, part: int = 0) -> Iterator[tuple[str, Span, int]]:
    """Made-up sentences with one candidate each, and whether it is personal data.

    ``part`` 0 is for fitting, 1 for calibration: their formats and wordings differ.
    """
    r = random.Random(seed)
    num = lambda k: "".join(str(r.randint(0, 9)) for _ in range(k))
    from_ = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    word = lambda: from_("etaoinshrdlu" if part == 0 else "aeioubcdfgmnprst", r.randint(2, 9))
    hexa, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def card(good: bool, seps: str) -> str:
        while True:
            d = r.choice("3456") + num(15)
            if luhn(d) == good:
                sep = r.choice([*seps, ""])
                return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    date = lambda: (r.randint(1, 28), r.randint(1, 12), r.randint(1950, 2030))
    made = [
        {
            ("phone", 1): lambda: r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(2)} {num(3)} {num(4)}", f"00{r.randint(1, 9)}{num(1)} {num(8)}"]),
            ("phone", 0): lambda: r.choice(["{2}-{1:02d}-{0:02d}".format(*date()), f"{num(3)}/{num(3)}/{num(3)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(4)} {num(4)} {num(2)}", f"{num(3)}-{num(3)}-{num(4)}"]),
            ("email", 1): lambda: r.choice([f"{word()} (at) {word()} (dot) com", f"{word()}[at]{word()}[dot]org", f"{word()}.{word()} at {word()} dot com"]),
            ("email", 0): lambda: r.choice([f"{word()} at {word()} dot {word()[:5]}", f"{word()} at the dot and"]),
            ("card", 1): lambda: card(True, " "),
            ("card", 0): lambda: r.choice([card(False, " "), num(13), num(18), card(False, "")]),
            ("id", 1): lambda: r.choice([f"{num(3)}-{num(2)}-{num(4)}", f"DE{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(2)}"]),
            ("id", 0): lambda: r.choice([f"{num(3)}-{num(2)}-{num(4)}", f"AB{num(2)} {num(4)} {num(4)} {num(4)}"]),
            ("secret", 1): lambda: r.choice([from_(hexa, 32) + "0a", from_(mixed, r.randint(24, 40)) + "7q", "pk-" + from_(mixed, 32) + "x3", f"{word()}{word()}{word()}", from_(mixed[:52], r.randint(10, 30))]),
            ("secret", 0): lambda: r.choice([from_(hexa, 40) + "a1", f"{word()}-{word()}-{word()}-{word()}-{word()}-{num(4)}", f"/{word()}/{word()}/{word()}{num(1)}/{word()}.{word()}"]),
        },
        {
            ("phone", 1): lambda: r.choice([f"({num(2)}) {num(4)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(3)} {num(3)} {num(3)}", f"00{r.randint(1, 9)}{num(1)}{num(9)}"]),
            ("phone", 0): lambda: r.choice(["{0:02d}.{1:02d}.{2}".format(*date()), f"{num(4)}-{num(3)}-{num(3)}", f"{num(2)} {num(3)} {num(3)}", f"{num(3)}.{num(3)}.{num(3)}"]),
            ("email", 1): lambda: r.choice([f"{word()}{num(2)} [at] {word()} [dot] net", f"{word()}(at){word()}(dot)edu", f"{word()}_{word()} at {word()} dot org"]),
            ("email", 0): lambda: r.choice([f"{word()} at {word()}{word()} dot {word()[:4]}", f"{word()} at one dot of"]),
            ("card", 1): lambda: card(True, "-"),
            ("card", 0): lambda: r.choice([card(False, "-"), num(14), num(17), num(19)]),
            ("id", 1): lambda: r.choice([f"{num(3)}-{num(2)}-{num(4)}", f"GB{num(2)}ABCD{num(14)}", f"FR{num(2)}{num(4)}{num(4)}{num(4)}{num(4)}{num(4)}{num(3)}"]),
            ("id", 0): lambda: r.choice([f"{num(3)}-{num(2)}-{num(4)}", f"XK{num(2)} {num(4)} {num(4)} {num(4)}"]),
            ("secret", 1): lambda: r.choice([from_(hexa, 46) + "c4", from_(mixed + "+/", 38) + "9Z", "live_" + from_(mixed, 24) + "k8", f"{word()}{word()}{word()}{word()}", f"{word()}-{word()}_{word()}", from_(mixed[:52], r.randint(12, 40))]),
            ("secret", 0): lambda: r.choice([from_(hexa, 64), "-".join(from_(hexa, k) for k in (8, 4, 4, 4, 11)) + "7", f"{word()}_{word()}_{word()}_{word()}_{word()}_v{num(2)}", f"www.{word()}.{word()}/{word()}/{num(4)}"]),
        },
    ][part]
    hints = {k: w[part::2] for k, w in _FOR.items()}
    against = _AGAINST[part::2]
    keys = list(made)
    for _ in range(n):
        kind, y = r.choice(keys)
        s = made[kind, y]()
        plain = kind == "card" or kind == "phone" and s.startswith("(") or kind == "email" and s[-1] != "d"
        # without a hint most numbers are anything; with a true one and a right format they are not
        hint = r.choice(hints[kind]) if y and (not plain or r.random() < 0.7) else r.choice(against) if not y and r.random() < 0.7 else word()
        lead = " ".join(word() for _ in range(r.randint(1, 5)))
        link = r.choice([' = "', ": ", "=", ': "']) if kind == "secret" and y else r.choice([" ", ": ", " is "])
        text = f"{lead} {hint}{link}{s}{r.choice([' ', '. ', ', '])}{word()} {word()}"
        a = text.rindex(s)
        yield text, (kind, a, a + len(s)), y


@dataclass(frozen=True)
class Model:
    trees: boosting.Boosted
    thresholds: dict[str, float]
    #: Kinds for which calibration asked for less than one half, the floor.
    at_floor: tuple[str, ...] = ()


@functools.lru_cache(maxsize=4)
def train(examples: int = 4000, seed: int = 7, precision: float = 0.97) -> Model:
    """Fit and calibrate on made examples; a kind whose precision is never reached selects nothing."""
    rows, other = list(_examples(examples, seed, 0)), list(_examples(examples, seed + 1, 1))
    x, y = np.array([features(t, s) for t, s, _ in rows]), np.array([v for *_, v in rows])
    cx, cy = np.array([features(t, s) for t, s, _ in other]), np.array([v for *_, v in other])
    # one half of the other examples calibrates, the other chooses thresholds
    trees = boosting.fit(x, y, calibrate=(cx[::2], cy[::2]))
    p, ty = trees.probability(cx[1::2]), cy[1::2]
    kinds = np.array([s[0] for _, s, _ in other[1::2]])
    thresholds, at_floor = {}, []
    for kind in ADDED_KINDS:
        own, cut = kinds == kind, 2.0
        for level in sorted(set(p[own]), reverse=True):
            chosen = own & (p >= level)
            if ty[chosen].mean() < precision:
                break
            cut = float(level)
        thresholds[kind] = max(cut, 0.5)
        at_floor += [kind] * (cut < 0.5)
    return Model(trees, thresholds, tuple(at_floor))


class _Taken:
    """Places that are taken, as disjoint intervals in order."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        k = bisect.bisect_left(self.starts, b)
        return k == 0 or self.ends[k - 1] <= a

    def take(self, a: int, b: int) -> None:
        k = bisect.bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def _added(texts: list[str | None], bases: list[list[Span]], model: Model) -> Iterator[list[Span]]:
    """Selected candidates of each text, none overlapping another or a base span; those of all texts are scored together."""
    taken = [_Taken(b) for b in bases]
    found = [[s for s in candidates(t) if x.free(s[1], s[2])] if t else [] for t, x in zip(texts, taken, strict=True)]
    rows = [features(t, s) for t, f in zip(texts, found, strict=True) for s in f]
    p = iter(model.trees.probability(np.array(rows)).tolist() if rows else [])
    for own, x in zip(found, taken, strict=True):
        out = []
        for q, s in sorted(((next(p), s) for s in own), key=lambda v: (-v[0], v[1][1], -v[1][2], v[1][0])):
            if q >= model.thresholds[s[0]] and x.free(s[1], s[2]):
                out.append(s)
                x.take(s[1], s[2])
        yield out


def added_spans(text: str | None, base: list[Span], model: Model) -> list[Span]:
    return next(_added([text], [base], model))


def spans_of(texts: list[str | None], model: Model) -> Iterator[tuple[list[Span], list[Span]]]:
    """Base and added spans of each text."""
    bases = [base_spans(t) for t in texts]
    yield from zip(bases, _added(texts, bases, model), strict=True)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document: doc_id, base counts by kind, base_sha256, spans (all, as kind:start:end)."""
    sent = docs.sparkSession.sparkContext.broadcast(model or train())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        m = sent.value

        def run(c) -> Iterator[tuple]:
            for doc_id, (base, added) in zip(c[0], spans_of(c[1], m), strict=True):
                counts = [sum(k == s[0] for s in base) for k in BASE_KINDS]
                yield doc_id, *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + added)

        return run

    return map_rows(docs, ["doc_id", "text"], f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", make)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping base spans, the union goes."""
    if not spans:
        return text
    spans = sorted(spans, key=lambda s: (s[1], -s[2]))
    out, at = [], 0
    for kind, a, b in spans:
        if b <= at:
            continue
        out.append(text[at:a] if a >= at else "")
        if a >= at:
            out.append(f"[{kind.upper()}]")
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; n_chars, where there is one, follows the new text."""
    sent = docs.sparkSession.sparkContext.broadcast(model or train())

    def make():
        return lambda texts: [redacted(t, base + added) for t, (base, added) in zip(texts, spans_of(texts, sent.value), strict=True)]

    out = map_column(docs, "text", make)
    if "n_chars" in docs.columns:
        kept = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(F.coalesce("text", F.lit(""))).cast(kept)))
    return out

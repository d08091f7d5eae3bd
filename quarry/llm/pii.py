"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The patterns (email, ip, card, phone) give the base spans. The field then looks at the places of a text that could
hold an entity at all (digit groups, ``@``, written-out ``at``/``dot``): features of whole candidate spans score each
segment, and dynamic programming over segments of at most ``MOST_TOKENS`` tokens and ``MOST_CHARS`` characters chooses
boundaries and types together. All other tokens are outside by definition. Spans of the field that touch a base span are dropped; base spans stay.

The weights are trained on the driver by maximum likelihood on ``TRAIN_SENTENCES`` generated sentences and the
hand-labelled ones of ``LABELLED``, and depend on nothing in the data. A few hundred floats are shipped.

Each document is handled alone in Arrow batches: no shuffle, no state between documents. All scans are linear in the
text's length. Defined results: a null or empty text has no spans; positions are code points; repeated rows are
handled one by one; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import math
import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import as_text, carried, read_table, restored, trimmed

#: Fixed values of the query's contract: kinds, in their order, and patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches. From each ``@`` back to where its run of local characters begins: linear, while a plain
    search would try every start of every run."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def _octet(part: str) -> bool:
    p = part.lstrip("0")
    return len(p) <= 3 and int(p or 0) <= 255


def ips(text: str) -> list[Span]:
    out, done = [], 0
    for run in _DIGITS.finditer(text):
        if run.start() >= done and (m := _IP.match(text, run.start())):
            done = m.end()
            if all(map(_octet, m.group().split("."))):
                out.append(("ip", m.start(), m.end()))
    return out


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        d = "".join(_DIGITS.findall(m.group())) if m.end() - m.start() >= 13 else ""
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    return out


def phones(text: str) -> list[Span]:
    return [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    out = emails(text) if "@" in text else []
    if _DIGITS.search(text):
        out += ips(text) + cards(text) + (phones(text) if "+" in text else [])
    return out


# --- the semi-Markov field ---------------------------------------------------------------------

MOST_TOKENS = 7
TRAIN_SENTENCES = 400
#: How often a hand-labelled sentence counts beside a generated one.
LABELLED_TIMES = 3
#: Segments of more characters are no entities.
MOST_CHARS = 320
#: Where an entity can be: a digit group of six and more digits with the signs that join groups, an @ or its written
#: forms, a colon between hexadecimal digits. None of these looks further than its own match.
_PLACE = re.compile(
    r"(?i)[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){5,}|@|[\[(]at[\])]| at [\w-]+ (?:dot|[\[(]dot[\])]) |[0-9a-f]{1,4}(?::[0-9a-f]{0,4}){3,7}"
)
_TOKEN = re.compile(r"\S+")
_EDGE = "\"'<>,;:!?#$%&*|=“”«»"
#: Cue words before a span, per kind.
_CUES = {"email": ("mail", "email", "e-mail", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "account"), "phone": ("call", "phone", "tel", "tel.", "mobile", "fax")}
_OBF = re.compile(r"(?i)^[\w.+-]+(?: ?[\[(]at[\])] ?| at )[\w-]+(?:(?: ?[\[(]dot[\])] ?| dot |\.)[\w-]+)+$")
_MAIL = re.compile(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+\.?$")
_NANP = re.compile(r"^(?:\+?1[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}$")
_GROUPS4 = re.compile(r"^[0-9]{4}([ .-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$")
_V6 = re.compile(r"^(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$")


@functools.lru_cache(maxsize=1 << 12)
def span_features(span: str, n: int, before: str) -> tuple[str, ...]:
    """Features of a whole segment; the kind is added by the scorer."""
    digits = sum(map(str.isdigit, span))
    letters = sum(map(str.isalpha, span))
    out = ["bias", f"n{n}", f"d{min(digits, 20) // 2}"]
    shape = "mail" if _MAIL.match(span) else "obf" if _OBF.match(span) else "nanp" if _NANP.match(span) else "quad" if _IP.fullmatch(span) else "v6" if _V6.match(span) else "four" if _GROUPS4.match(span) and 13 <= digits <= 19 else "digits" if span.isdigit() else "word" if letters == len(span) else "mixed"
    out.append(shape)
    if shape == "quad" and all(map(_octet, span.split("."))):
        out.append("octets")
    if 13 <= digits <= 19 and not letters and luhn("".join(_DIGITS.findall(span))):
        out.append("luhn")
    if span.startswith("+") and 9 <= digits <= 15 and not letters:
        out.append("plus")
    out += [f"cue-{k}" for k, words in _CUES.items() if before in words]
    return tuple(out)


def _segments(tokens: list[tuple[int, int]], text: str, i: int) -> Iterator[tuple[int, str, str]]:
    before = text[max(tokens[i - 1][0], tokens[i - 1][1] - MOST_CHARS) : tokens[i - 1][1]].strip(_EDGE).lower().rstrip(":") if i else ""
    for n in range(1, min(MOST_TOKENS, len(tokens) - i) + 1):
        if tokens[i + n - 1][1] - tokens[i][0] > MOST_CHARS:
            break
        span = text[tokens[i][0] : tokens[i + n - 1][1]].strip(_EDGE).rstrip(".")
        if span:
            yield n, span, before


def _lattice(text: str, tokens: list[tuple[int, int]], w: dict[tuple[str, str], float]) -> list[list[tuple[int, str, float, tuple[str, ...]]]]:
    """For each token: segments that begin there, (tokens, kind, score, features). O segments have one token, score 0."""
    out = []
    for i in range(len(tokens)):
        here: list[tuple[int, str, float, tuple[str, ...]]] = [(1, "O", 0.0, ())]
        for n, span, before in _segments(tokens, text, i):
            f = span_features(span, n, before)
            here += [(n, k, sum(w.get((x, k), 0.0) for x in f), f) for k in KINDS]
        out.append(here)
    return out


def viterbi(text: str, tokens: list[tuple[int, int]], w: dict[tuple[str, str], float]) -> list[tuple[int, int, str]]:
    """(first token, tokens, kind) of the best segmentation's entities."""
    m, lattice = len(tokens), _lattice(text, tokens, w)
    best: list[tuple[float, tuple[int, str]]] = [(0.0, (0, ""))] * (m + 1)
    for i in range(m - 1, -1, -1):
        best[i] = max(((s + best[i + n][0], (n, k)) for n, k, s, _ in lattice[i]), key=lambda x: x[0])
    out, i = [], 0
    while i < m:
        n, k = best[i][1]
        if k != "O":
            out.append((i, n, k))
        i += n
    return out


def _logadd(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)


def gradient(text: str, tokens: list[tuple[int, int]], gold: set[tuple[int, int, str]], w: dict[tuple[str, str], float]) -> dict[tuple[str, str], float]:
    """Of the log likelihood: gold features less expected ones, by forward and backward sums over segments."""
    m, lattice = len(tokens), _lattice(text, tokens, w)
    back, fore = [-math.inf] * m + [0.0], [0.0] + [-math.inf] * m
    for i in range(m - 1, -1, -1):
        for n, _, s, _ in lattice[i]:
            back[i] = _logadd(back[i], s + back[i + n])
    for i in range(m):
        for n, _, s, _ in lattice[i]:
            fore[i + n] = _logadd(fore[i + n], fore[i] + s)
    out: dict[tuple[str, str], float] = {}
    for i in range(m):
        for n, k, s, f in lattice[i]:
            g = ((i, n, k) in gold) - math.exp(fore[i] + s + back[i + n] - back[0])
            if abs(g) > 1e-6:
                for x in f:
                    out[x, k] = out.get((x, k), 0.0) + g
    return out


def sentences(n: int = TRAIN_SENTENCES, seed: int = 7) -> Iterator[tuple[str, list[tuple[int, int]], set[tuple[int, int, str]]]]:
    """Generated sentences with their entities, and with numbers and words that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "er", "th", "on", "in", "es", "le", "ou", "ie", "ch", "at", "dot")) for _ in range(r.randint(1, 4)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = num(r.choice((15, 15, 12, 14)))
        return d + next(c for c in "0123456789" if luhn(d + c))

    def valid_card() -> str:
        d, sep = card(), r.choice(("", " ", "-", "."))
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4)) if len(d) == 16 else d

    makes = (
        ("email", lambda: f"{word()}.{num(2)}@{word()}{num(1)}.{word()}.com"), ("email", lambda: f"{word()} (at) {word()} (dot) com"), ("email", lambda: f"{word()} at {word()} dot org"), ("email", lambda: f"{word()}[at]{word()}[dot]net"),
        ("ip", lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))), ("ip", lambda: ":".join(f"{r.randint(0, 65535):x}" for _ in range(8))),
        ("card", valid_card), ("card", valid_card),
        ("phone", lambda: f"+{r.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}"), ("phone", lambda: f"({num(3)}) {num(3)}-{num(4)}"), ("phone", lambda: f"{num(3)}-{num(3)}-{num(4)}"), ("phone", lambda: f"+{num(2)} {num(3)} {num(3)} {num(3)}"),
        ("", lambda: num(r.randint(4, 8))), ("", lambda: f"{num(4)}-{num(2)}-{num(2)}"), ("", lambda: f"{num(3)}.{num(1)}"), ("", lambda: f"{r.randint(256, 999)}.{num(3)}.{num(3)}.{num(3)}"), ("", lambda: num(20) + num(r.randint(1, 9))), ("", lambda: num(16)[:-1] + "x"), ("", lambda: f"{word()} at {word()}"), ("", lambda: f"@{word()}"), ("", lambda: f"{num(2)}.{num(2)}.{num(4)}"), ("", lambda: f"{num(4)} {num(3)}"),
        ("", lambda: (lambda d: d if not luhn(d) else d[:-1] + str((int(d[-1]) + 1) % 10))(num(16))),
    )
    for _ in range(n):
        parts: list[str] = []
        gold: set[tuple[int, int, str]] = set()
        for _ in range(r.randint(1, 3)):
            parts += [word() for _ in range(r.randint(1, 3))]
            kind, make = r.choice(makes)
            if kind and r.random() < 0.3:
                parts.append(r.choice(_CUES[kind]))
            made = make().split()
            if kind:
                gold.add((len(parts), len(made), kind))
            parts += made
        parts += [word(), word()]
        text = " ".join(parts)
        yield text, [m.span() for m in _TOKEN.finditer(text)], gold


#: Sentences labelled by hand: an entity stands as {kind|text}.
LABELLED = (
    "Please send the form to {email|anna.keller(at)posthaus.de} before Friday.",
    "Write me at {email|tom at riverbank dot org} if the date suits you.",
    "contact: {email|office [at] lake-view [dot] co [dot] uk} for rooms",
    "We met at noon, and the dot on the map moved.",
    "She stayed at home dot and nothing else happened.",
    "My number is {phone|(212) 555-0147} and I am home after six.",
    "Tel. {phone|415-555-0132}, ask for Maria.",
    "Call {phone|+44 20 7946 0958} or {phone|+49 (30) 901820}.",
    "The order 2024-11-05 cost 120 000 and 45 cents.",
    "ISBN 978-3-16-148410-0 was out of print in 1998.",
    "Rooms 101 102 103 and 104 are free; 2015 2016 2017 2018 were not.",
    "Version 10.4.300.12 of the program came out in May.",
    "The server {ip|10.0.12.7} did not answer, nor did {ip|2001:db8:0:1:0:ff00:42:8329}.",
    "It began at 12:30:45 and ended at 13:05:10.",
    "Pay with {card|4111 1111 1111 1111} or {card|5500.0000.0000.0004}.",
    "Card {card|378282246310005} was declined.",
    "Tracking number 12345678901234567890 has left the port.",
    "Account 1234567890123456 does not exist.",
    "Follow @river on the network, or @lake@hill there.",
    "Between 1900 and 1950 about 3 500 000 people moved.",
    "GPS 52.520008 13.404954 marks the gate.",
    "Reach us: {phone|212.555.0188} (evenings), {email|desk(at)harbour(dot)net} (always).",
    "The sum of 555 123 and 877 is small.",
    "From 192.168.300.4 nothing can come.",
)
_MARK = re.compile(r"\{(email|ip|card|phone)\|([^}]*)\}")


def labelled(table: tuple[str, ...] = LABELLED) -> Iterator[tuple[str, list[tuple[int, int]], set[tuple[int, int, str]]]]:
    """The table's sentences as (text, tokens, gold segments), as ``sentences`` gives generated ones."""
    for row in table:
        text, spans, done = "", [], 0
        for m in _MARK.finditer(row):
            text += row[done : m.start()]
            spans.append((m[1], len(text), len(text) + len(m[2])))
            text, done = text + m[2], m.end()
        text += row[done:]
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        gold = set()
        for kind, a, b in spans:
            inside = [k for k, (x, y) in enumerate(tokens) if x < b and y > a]
            gold.add((inside[0], len(inside), kind))
        yield text, tokens, gold


@functools.lru_cache(maxsize=1)
def weights(epochs: int = 4, rate: float = 0.4) -> dict[tuple[str, str], float]:
    """Trained once per driver: stochastic gradient ascent in a fixed order, with a little decay."""
    w: dict[tuple[str, str], float] = {("bias", k): -2.0 for k in KINDS}
    data = [*sentences(), *(x for x in labelled() for _ in range(LABELLED_TIMES))]
    for e in range(epochs):
        for text, tokens, gold in data:
            for f, g in gradient(text, tokens, gold, w).items():
                w[f] = w.get(f, 0.0) * (1 - 1e-3) + rate / (1 + e) * g
    return w


def field_spans(text: str, w: dict[tuple[str, str], float], context: int = 4) -> list[Span]:
    """Entities that the field finds in the places of a text, windows of tokens that hold one."""
    places = [m.span() for m in _PLACE.finditer(text)]
    if not places:
        return []
    words = [m.span() for m in _TOKEN.finditer(text)]
    ends = [e for _, e in words]
    windows: list[list[int]] = []
    for lo, hi in places:
        # The words that the place touches, and some on either side.
        first = max(0, bisect.bisect_right(ends, lo) - context)
        last = min(len(words), bisect.bisect_left(ends, hi) + 1 + context)
        if windows and first <= windows[-1][1]:
            windows[-1][1] = max(last, windows[-1][1])
        else:
            windows.append([first, last])
    out, end = [], -1
    for first, last in windows:
        tokens = words[first:last]
        for i, n, kind in viterbi(text, tokens, w):
            a, b = tokens[i][0], tokens[i + n - 1][1]
            while a < b and text[a] in _EDGE:
                a += 1
            while b > a and (text[b - 1] in _EDGE or text[b - 1] == "."):
                b -= 1
            if b > a and a >= end:
                out.append((kind, a, b))
                end = b
    return out


def all_spans(text: str, base: list[Span], w: dict[tuple[str, str], float]) -> list[Span]:
    first = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in first], list(itertools.accumulate((b for _, b in first), max))
    # A span touches a base span if the furthest end of those that begin before its end lies after its start.
    touches = lambda a, b: (k := bisect.bisect_left(starts, b)) > 0 and reach[k - 1] > a
    more = [s for s in field_spans(text, w) if not touches(s[1], s[2])]
    return sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping ones the first, then the longest."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
            done = b
    return "".join([*out, text[done:]])


def _join(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans). The counts by kind are of base spans;
    n_spans counts all."""
    w = weights()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch["t"]:
                text = as_text(t)
                base = base_spans(text)
                spans = all_spans(text, base, w)
                rows.append([sum(s[0] == k for s in base) for k in KINDS] + [hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans), len(spans)])
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])
            out.insert(0, "i", batch["i"].to_numpy())
            yield out

    flat = docs.select(carried(docs, id_col), docs[text_col].alias("t"))
    return restored(flat.mapInPandas(run, "i string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"), docs, id_col)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data masked; nulls stay null. Other columns must be of simple types."""
    w, i = weights(), docs.columns.index(text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch.isetitem(0, [None if t is None else mask(t, all_spans(t, base_spans(t), w)) for t in batch.iloc[:, 0]])
            yield batch

    names = [f"c{k}" for k in range(len(docs.columns))]
    kinds = [f.dataType for f in docs.schema]
    flat = docs.toDF(*names).select(names[i], *(F.col(n).cast("string").alias(n) for k, n in enumerate(names) if k != i))
    return flat.mapInPandas(trimmed(run), flat.schema).select(*(F.col(n).cast(k).alias(n) for n, k in zip(names, kinds, strict=True))).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read_table(spark, sf_dir, "documents"))

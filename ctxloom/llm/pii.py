"""Personal data by candidates and gradient boosting.

Base spans (email, ip, card, phone) are rules and always stay.  High-recall
generators propose further, overlapping spans: long digit runs with any usual
separators, written-out addresses ("name (at) host dot tld") and long mixed
tokens.  Boosted trees over format and context features give each candidate a
probability, calibrated on candidates that the fit did not see; those at
``THRESHOLD`` or more are added, the best of overlapping ones only, and none
that overlaps a base span.

The trees learn from the corpus itself, each kind from candidates as its own
generator proposes them (``verdict``): numbers that a base rule accepts, or that
are grouped as a phone without its +; addresses that write out the at, the dot
or both; mixed tokens that a cue word assigns.  Candidates that these reject are
negatives, those that they cannot judge are left out, and the checks which decide
(Luhn, the number range) are no features.  A corpus may hold few of a kind, so
every sampled text also gets ``planted`` examples of all kinds and labels in its
own words.  The calibration is one for each kind.  The fit sees the candidates
of at most ``SAMPLE_DOCS`` documents (smallest hash of the key), at most
``SAMPLE_ROWS`` of them, of each kind and label as many while they last; all else
covers every whole text.

Offsets are code points, ends exclusive.  Null and empty texts have no spans.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.llm.textops import slices
from ctxloom.session import ship_package

BASE = ("email", "ip", "card", "phone")
ADDED = ("contact", "number", "secret")
KINDS = (*BASE, *ADDED)
SAMPLE_DOCS = 4_000
SAMPLE_ROWS = 20_000
THRESHOLD = 0.8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive repeats: the same matches, without trying each shorter run again
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|\(at\)|\[at\]| at ", re.I)
_AT = re.compile("at", re.I)
_NUMBER = re.compile(r"[0-9](?:[ ().:/-]{0,2}[0-9])++")
_CONTACT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]++)+", re.I)
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+")
#: A name and = in front of a token, which stand in the same run as it.
_KEYED = re.compile(r"[A-Za-z0-9_-]*[A-Za-z_-]=+(?=[^=]{16})")
_ASSIGNED = re.compile(r"(?:token|secret|password|passwd|pwd|credentials?|bearer|key)[\"'`]?\s{0,2}(?:=>|:=|[=:])\s{0,2}[\"'`]?$", re.I)
_GROUPED = re.compile(r"(?:[0-9]{1,3}[ .-]{1,2}\(?)?[0-9]{3}(?:\) ?|[ .-])[0-9]{3}[ .-][0-9]{4}")
_MARK = re.compile(r"\((?:at|dot)\)|\[(?:at|dot)\]| dot ", re.I)
_DIGITS = str.maketrans("", "", " ().-:/")
_WORD_BEFORE = re.compile(r"([^\W\d_]+)\W*$")

#: Words in front of a span that say what it is.
CUES = ("token", "key", "secret", "password", "passwd", "pwd", "credential", "credentials", "bearer", "tel", "phone", "fax", "call", "mail", "contact", "ip", "host", "address",
        "card", "account", "iban", "no", "version", "license", "isbn", "page", "year")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Runs of local characters in front of an @ that a dotted domain follows."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].translate(_DIGITS)
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(m[0].translate(_DIGITS)) - 1 <= 15:
                out.append(("phone", *m.span()))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposed spans of all generators, overlaps included."""
    out = [("number", *m.span()) for m in _NUMBER.finditer(text) if m.end() - m.start() >= 2]
    for m in _SECRET.finditer(text):
        keyed = _KEYED.match(text, *m.span())
        a = keyed.end() if keyed else m.start()
        if any(c.isdigit() for c in text[a:m.end()]):
            out.append(("secret", a, m.end()))
    if _AT.search(text):
        out += [("contact", *m.span()) for m in _CONTACT.finditer(text)]
    return out


FEATURES = 23


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context of a span; no rule's verdict."""
    span = text[a:b]
    digits = sum(c.isdigit() for c in span)
    alpha = sum(c.isalpha() for c in span)
    groups = [len(g) for g in re.split(r"[^0-9A-Za-z]+", span) if g]
    counts = Counter(span)
    n = len(span)
    before, after = text[max(0, a - 24):a], text[b:b + 1]
    cue = _WORD_BEFORE.search(before)
    word = cue[1].lower() if cue else ""
    left = before[-1:]
    return [ADDED.index(kind) if kind in ADDED else -1, len(span), digits, alpha, len(span) - digits - alpha,
            len(groups), max(groups, default=0), min(groups, default=0), groups[-1] if groups else 0, groups[0] if groups else 0,
            span.count("."), span.count("-"), span.count(" "), len(counts),
            -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0,
            float(left == "+") or 2 * float(left in "\"'") or 3 * float(left.isalpha()),
            float(after in "\"'" and after != "") or 2 * float(after == ".") or 3 * float(after.isalpha()),
            CUES.index(word) + 1 if word in CUES else 0, float("=" in before[-4:] or ":" in before[-4:]),
            sum(c in "0123456789abcdefABCDEF" for c in span) / len(span),
            len(_MARK.findall(span)), span.count(". "), sum(c in ".:/" for c in span) + 100 * float("(" in before[-1:])]


@dataclass
class Trees:
    """Boosted depth-3 trees over binned features, with a calibration."""
    edges: list = field(default_factory=list)    # bin edges of each feature
    trees: list = field(default_factory=list)    # (7 features, 7 bins, 8 leaf values)
    start: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    kinds: dict = field(default_factory=dict)    # (slope, shift) by the first feature's value

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, FEATURES), int)

    def raw(self, binned: np.ndarray) -> np.ndarray:
        z = np.full(len(binned), self.start)
        rows = np.arange(len(binned))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(binned), int)
            for _ in range(3):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            z += leaf[node - 7]
        return z

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.zeros(len(x))
        slope, shift = np.full(len(x), self.slope), np.full(len(x), self.shift)
        for kind, (a, b) in self.kinds.items():
            slope[x[:, 0] == kind], shift[x[:, 0] == kind] = a, b
        return 1 / (1 + np.exp(-np.clip(slope * self.raw(self.bins(x)) + shift, -500, 500)))


def _platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a calibration: Newton steps with a little ridge."""
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * raw + shift, -500, 500)))
        w = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - y) * raw).sum() + 0.1 * (slope - 1), (p - y).sum() + 0.1 * shift])
        hess = np.array([[(w * raw * raw).sum() + 0.1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 0.1]])
        slope, shift = np.array([slope, shift]) - np.linalg.solve(hess, grad)
    return float(slope), float(shift)


def boost(x: np.ndarray, y: np.ndarray, n_trees: int = 40, rate: float = 0.2, n_bins: int = 32, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss; a quarter of the rows calibrates."""
    out = Trees()
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        return out
    out.edges = [np.unique(np.quantile(x[~held, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = out.bins(x)
    xb, yt = binned[~held], y[~held]
    out.start = float(np.log(yt.mean() / (1 - yt.mean())))
    z = np.full(len(yt), out.start)
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        g, h = p - yt, np.maximum(p * (1 - p), 1e-6)
        feature, cut, node = np.zeros(7, int), np.full(7, n_bins), np.zeros(len(yt), int)
        for at in range(7):
            here = np.flatnonzero(node == at)
            best = 1e-9
            total_g, total_h = g[here].sum(), h[here].sum()
            for j in range(x.shape[1]):
                gs = np.cumsum(np.bincount(xb[here, j], g[here], n_bins))[:-1]
                hs = np.cumsum(np.bincount(xb[here, j], h[here], n_bins))[:-1]
                gain = gs**2 / (hs + ridge) + (total_g - gs)**2 / (total_h - hs + ridge) - total_g**2 / (total_h + ridge)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[at], cut[at] = gain[k], j, k
            node[here] = 2 * at + 1 + (xb[here, feature[at]] > cut[at])
        leaf = -rate * np.bincount(node - 7, g, 8) / (np.bincount(node - 7, h, 8) + ridge)
        z += leaf[node - 7]
        out.trees.append((feature, cut, leaf))
    raw, yh = out.raw(binned[held]), y[held]
    out.slope, out.shift = _platt(raw, yh)
    for kind in range(len(ADDED)):
        own = x[held, 0] == kind
        if len(set(yh[own])) == 2:
            out.kinds[kind] = _platt(raw[own], yh[own])
    return out


def verdict(text: str, kind: str, a: int, b: int) -> int | None:
    """Label of a candidate that overlaps no base span; None if nothing tells."""
    span = text[a:b]
    if kind == "secret":
        mixed = any(c.isalpha() for c in span) and any(c.isdigit() for c in span)
        return int(mixed and bool(_ASSIGNED.search(text[max(0, a - 24):a])))
    if kind == "contact":
        return 1 if _MARK.search(span) else 0 if ". " in span else None
    if _GROUPED.fullmatch(span):
        return 1
    return None if 9 <= len(span.translate(_DIGITS)) <= 15 and re.search("[ ()-]", span) else 0


def planted(text: str) -> Iterator[tuple[str, int, str, int, int]]:
    """(text around it, label, kind, start, end) of examples of every kind, set
    into ``text``; the same for the same text."""
    rng = random.Random(text)
    words = re.findall(r"[a-z]{2,12}", text[:4096].lower()) or ["a"]
    word = lambda: rng.choice(words)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    chars = rng.choice(("0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    token = rng.choice(("", "", "sk_", "AKIA")) + "a7" + "".join(rng.choices(chars, k=rng.choice((18, 22, 30, 38, 62))))
    cue = rng.choice(("token", "key", "secret", "password", "api_key", "access_token", "DB_PASSWORD", "client-secret", "pwd"))
    quote = rng.choice(('"', "'", ""))
    sign = rng.choice((" = ", "=", ": ", ":", " := ", '": '))
    plain = rng.choice(("commit ", "sha256: ", "id = ", "file ", word() + " ", word() + ": ", word() + " = "))
    slug = "-".join([word(), word(), word(), digits(4), word()])
    at, dot = rng.choice(((" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" (at) ", "."), (" at ", " dot "), ("(at)", " dot ")))
    name = rng.choice((word(), f"{word()}.{word()}", f"{word()}_{digits(2)}"))
    host = dot.join([word(), *([word()] if rng.random() < 0.3 else []), rng.choice(("com", "org", "net", "de", "io"))])
    mail = f"{name}{at}{host}"
    x = rng.choice((" ", ".", "-"))
    phone = f"{rng.choice(('', '', '1' + x, '49' + x))}{digits(3)}{rng.choice((x, x, ') '))}{digits(3)}{x}{digits(4)}"
    year, day = f"{rng.choice((19, 20))}{digits(2)}", f"{rng.randint(1, 12):02}{rng.choice('-./')}{rng.randint(1, 28):02}"
    number = rng.choice((f"{year}-{day}", f"{day}-{year}", f"{year}-{day} {digits(2)}:{digits(2)}:{digits(2)}", f"{year}-{int(year) + 4}", f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
                         digits(rng.randint(2, 12)), f"{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(3)}.{digits(2)}"))
    for label, kind, lead, span, tail in (
            (1, "secret", f"{cue}{sign}{quote}", token, quote), (0, "secret", f"{plain}{quote}", token, quote), (0, "secret", "", slug, ""),
            (1, "contact", rng.choice(("", "mail ", "contact: ", word() + " ")), mail, ""), (0, "contact", "", f"{word()} at {word()}. {word().capitalize()}", ""),
            (1, "number", rng.choice(("", "tel ", "call ", "phone: ", "fax ")) + "(" * (")" in phone and phone.index(")") == 3), phone, ""),
            (0, "number", rng.choice(("", "version ", "page ", "year ", "isbn ", "no ", word() + " ")), number, "")):
        where = text.find(" ", rng.randrange(len(text))) + 1
        before = text[max(0, where - 40):where]
        yield f"{before}{lead}{span}{tail} {text[where:where + 40]}", label, kind, len(before) + len(lead), len(before) + len(lead) + len(span)


def rewritten(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, str, int, int]]:
    """As ``planted``: the base phones without their +, the base emails written out."""
    for kind, a, b in base:
        before, after = text[max(0, a - 40):a], text[b:b + 40]
        if kind == "phone":
            yield before + text[a + 1:b] + after, 1, "number", len(before), len(before) + b - a - 1
        elif kind == "email" and b - a <= 320:
            at, dot = ((" (at) ", "."), ("[at]", "[dot]"), (" at ", " dot "))[(b - a) % 3]
            name, host = text[a:b].split("@")
            span = name + at + host.replace(".", dot)
            yield before + span + after, 1, "contact", len(before), len(before) + len(span)


def examples(text: str) -> Iterator[tuple[list[float], int]]:
    """Training rows of a text: its candidates as their generator proposes them,
    those of base spans positive, then the rewritten and the planted ones."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in taken], dict(taken)
    reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    for kind, a, b in candidates(text):
        i = bisect.bisect_left(starts, b) - 1
        if i < 0 or reach[i] <= a:
            y = verdict(text, kind, a, b)
        else:  # a phone's + is no part of a number
            y = 1 if kind == "number" and any(ends.get(s, b + 1) <= b for s in (a, a - 1)) else None
        if y is not None:
            yield features(text, kind, a, b), y
    for around, y, kind, a, b in (*rewritten(text, base), *planted(text)):
        for k, s, e in candidates(around):
            if k == kind and (s <= a and b <= e if y else s < b and a < e):
                yield features(around, k, s, e), y


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_rows: int = SAMPLE_ROWS) -> Trees:
    ship_package(docs.sparkSession)
    ids = docs.select(F.col(key).alias("_id")).where("_id IS NOT NULL").distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)
    ids = docs.sparkSession.createDataFrame(ids.collect(), ids.schema)  # sample_docs keys at most
    drawn = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(ids), "_id")
    drawn = drawn.groupBy("_id").agg(F.min("_text").alias("_text")).select("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            rows = [e for t in b.column(0).to_pylist() if t and _ANY.search(t) for e in examples(t)]
            packed = [(np.array(x, np.float64).tobytes(), y) for x, y in rows]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in packed], pa.binary()), pa.array([y for _, y in packed], pa.int32())], ["x", "y"])

    each = Window.partitionBy(F.substring("x", 1, 8), "y").orderBy(F.xxhash64("x"), "x")  # the first feature is the kind
    found = drawn.mapInArrow(run, "x binary, y int").withColumn("_n", F.row_number().over(each)).where(F.col("_n") <= sample_rows)
    got = found.orderBy("_n", F.xxhash64("x"), "x", "y").limit(sample_rows).collect()
    got.sort(key=lambda r: hashlib.md5(r["x"]).digest())  # so that what calibrates is no pattern of the ranks
    if not got:
        return Trees()
    return boost(np.array([np.frombuffer(r["x"]) for r in got]), np.array([float(r["y"]) for r in got]))


def added_spans(text: str, base: list[tuple[str, int, int]], trees: Trees, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """Candidates at the threshold that overlap no base span; of overlapping ones the likelier."""
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []

    def free(a: int, b: int) -> bool:
        i = int(np.searchsorted(starts, b, "left")) - 1
        return i < 0 or reach[i] <= a

    found = [c for c in candidates(text) if free(c[1], c[2])]
    if not found or not trees.trees:
        return []
    p = trees.probability(np.array([features(text, *c) for c in found]))
    best = sorted((-x, a, b, k) for x, (k, a, b) in zip(p.tolist(), found, strict=True) if x >= threshold)
    out: list[tuple[str, int, int]] = []
    chosen: list[tuple[int, int]] = []  # disjoint, ascending
    for _, a, b, k in best:
        i = bisect.bisect_left(chosen, (a, b))
        if (i == 0 or chosen[i - 1][1] <= a) and (i == len(chosen) or chosen[i][0] >= b):
            chosen.insert(i, (a, b))
            out.append((k, a, b))
    return out


def find(text: str | None, trees: Trees, threshold: float = THRESHOLD) -> tuple[list, list]:
    """(base spans, added spans) of a text, each by kind as listed, then start."""
    if not text or not _ANY.search(text):
        return [], []
    by = lambda s: (KINDS.index(s[0]), s[1], s[2])
    base = base_spans(text)
    return sorted(base, key=by), sorted(added_spans(text, base, trees, threshold), key=by)


def _join(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def spans(docs: DataFrame, trees: Trees, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, counts and digest of the base spans, and all spans, of every row."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    src = docs.select(F.col(key), F.col(text).alias("_text"))
    schema = src.select(key, *[F.lit(0).cast("long").alias(f"n_{k}") for k in BASE], F.lit("").alias("base_sha256"), F.lit("").alias("spans")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            rows = [find(t, sent.value, threshold) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in BASE]
            sha = pa.array([hashlib.sha256(_join(base).encode()).hexdigest() for base, _ in rows])
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, sha, pa.array([_join([*base, *more]) for base, more in rows])], schema.names)

    return src.mapInArrow(run, schema)


def redacted(text: str | None, trees: Trees, threshold: float = THRESHOLD) -> str | None:
    """The text with every span (overlapping ones as one) replaced by <KIND>."""
    base, more = find(text, trees, threshold)
    if not base and not more:
        return text
    merged: list[list] = []
    for k, a, b in sorted([*base, *more], key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    out, at = [], 0
    for k, a, b in merged:
        out += [text[at:a], f"<{k.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, trees: Trees, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns, the spans in ``text`` replaced."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            i = b.schema.get_field_index(text)
            has = pc.fill_null(pc.match_substring_regex(b.column(i), r"[0-9@]|\([aA][tT]\)|\[[aA][tT]\]| [aA][tT] "), False)
            if pc.any(has).as_py():
                col = pa.array([redacted(t, sent.value, threshold) if h else t for t, h in zip(b.column(i).to_pylist(), has.to_pylist(), strict=True)], b.schema.field(i).type)
                b = b.set_column(i, b.schema.field(i), col)
            yield b

    return docs.mapInArrow(run, docs.schema)

"""Language identification by hierarchical discrimination.

A text's family is predicted first (linear support vector machines, a family
against the others); within it one-versus-one machines vote for the language.
Features are character n-grams of ``ORDERS`` within words, a word's ends being
characters of their own, hashed into ``BLOCK`` weights an order; each order's
values are shares, so long and short texts compare.  Only letters and
combining marks count, folded to lower case one by one.

The machines learn from a bounded sample: the ``LANGUAGES`` most frequent
languages, at most ``SAMPLE`` distinct texts each (drawn by the text's hash, so
copies count once), at most ``SAMPLE`` texts of a family for its family machine.
Each machine is fitted in a task of its own.  Rows whose crc32 of the key as
text leaves ``HELD`` by ``FOLDS`` are never learned from (a null key reads as
the empty text: held out).  Texts are scored whole, long ones piece by piece.

``und`` with score 0 stands for null texts, texts without a letter, and any
text when nothing could be learned.  Equal texts get equal results; rows that
repeat a key count as they come; ties go to the language that sorts first.
The score is a confidence: the share of the calibrated family probabilities
that falls to the family, times the mean calibrated probability with which the
language wins its pairs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.llm.textops import slices
from ctxloom.session import ship_package

ORDERS = 4
BLOCK = 1 << 14
WEIGHTS = ORDERS * BLOCK
SCALE = 20.0
SAMPLE = 400
LANGUAGES = 64
FOLDS, HELD = 5, 0
PIECE = 1 << 20
#: Languages of each family by their codes.  A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fo lb fy yi",
    "romance": "fr es pt it ro ca gl oc la ast",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "indic": "hi mr ne bn as gu pa or sa ur si",
    "dravidian": "ta te kn ml",
    "iranian": "fa ps ku tg",
    "semitic": "ar he mt am",
    "malayic": "id ms jv su tl",
}


@dataclass
class Model:
    families: dict[str, list[str]] = field(default_factory=dict)
    #: machine name -> (weights with the intercept last, slope and shift of its calibration)
    machines: dict[str, tuple[np.ndarray, float, float]] = field(default_factory=dict)


def family_of(lang: str, families: dict[str, str] = FAMILIES) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in families.items() if code in codes.split()), lang)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(folded code point, 0 for what separates words; is a letter) of every code point."""
    fold, letter = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x40000):  # no letters are assigned beyond
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            fold[c], letter[c] = ord(low) if len(low) == 1 else c, True
        elif unicodedata.category(x)[0] == "M":
            fold[c] = c
    return fold, letter


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """(row numbers, texts) of about ``PIECE`` characters; longer texts are cut
    where words are separated, so no n-gram is lost."""
    fold = _tables()[0]
    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = at + PIECE
            while end < len(text):
                gap = np.flatnonzero(fold[_points(text[end:end + 4096])] == 0)
                if len(gap):
                    end += int(gap[0])
                    break
                end += 4096
            rows.append(i)
            parts.append(text[at:end])
            size += len(parts[-1])
            at = end
            if size >= PIECE:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def grams(parts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (weight number, part number) of every n-gram."""
    fold, _ = _tables()
    points = fold[_points("".join([f"\n{t}\n" for t in parts]))]
    starts = np.cumsum([0, *[len(t) + 2 for t in parts]])[:-1]
    apart = points == 0
    kept = ~apart
    kept[1:] |= ~apart[:-1]
    kept[starts] = True
    begins = np.zeros(len(points), bool)
    begins[starts] = True
    part = (np.cumsum(begins) - 1)[kept]
    c = points[kept].astype(np.uint64)
    gaps = np.concatenate(([0], np.cumsum(c == 0)))
    key = np.zeros(len(c), np.uint64)
    for n in range(1, ORDERS + 1):
        m = len(c) - n + 1
        key = key[:m] * np.uint64(0x100000001B3) + c[n - 1:] + np.uint64(1)
        if n == 1:
            own = c != 0
        else:  # within one part, word ends only at the ends
            own = (part[:m] == part[n - 1:]) & (gaps[n - 1:n - 1 + m] == gaps[1:1 + m])
        at = np.flatnonzero(own)
        h = key[at] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        yield (h >> np.uint64(50)).astype(np.int64) + (n - 1) * BLOCK, part[at]


def margins(texts: list[str], machines: list[np.ndarray]) -> np.ndarray:
    """Distance to each machine's border, a row a text."""
    total = np.zeros((ORDERS, len(machines), len(texts)))
    count = np.zeros((ORDERS, len(texts)))
    for rows, parts in _pieces(texts):
        rows = np.array(rows)
        for o, (number, part) in enumerate(grams(parts)):
            np.add.at(count[o], rows, np.bincount(part, minlength=len(parts)))
            for k, w in enumerate(machines):
                np.add.at(total[o, k], rows, np.bincount(part, w[number], minlength=len(parts)))
    z = SCALE * (total / np.maximum(count, 1)[:, None, :]).sum(0)
    return (z + np.array([w[-1] for w in machines])[:, None]).T


def has_letter(text: str | None) -> bool:
    letter = _tables()[1]
    return bool(text) and any(letter[_points(text[i:i + PIECE])].any() for i in range(0, len(text), PIECE))


def _pair(a: str, b: str) -> str:
    return f"pair\t{a}\t{b}"


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text."""
    out, score = ["und"] * len(texts), np.zeros(len(texts))
    todo = np.array([i for i, t in enumerate(texts) if has_letter(t)], np.int64)
    names = sorted(model.families)
    if not len(todo) or not names:
        return out, score

    def chances(machine_names, rows):
        found = [model.machines[n] for n in machine_names]
        z = margins([texts[i] for i in rows], [w for w, _, _ in found])
        return 1 / (1 + np.exp(-np.clip(z * [a for _, a, _ in found] + [b for _, _, b in found], -500, 500)))

    share = np.ones((len(todo), 1))
    if len(names) > 1:
        share = chances([f"family\t{n}" for n in names], todo) + 1e-12
        share /= share.sum(1, keepdims=True)
    family = share.argmax(1)
    for f, name in enumerate(names):
        rows, langs = todo[family == f], sorted(model.families[name])
        if not len(rows):
            continue
        score[rows] = share[family == f, f]
        won = np.ones((len(rows), len(langs)))
        pairs = list(combinations(range(len(langs)), 2))
        if pairs:
            p = chances([_pair(langs[a], langs[b]) for a, b in pairs], rows)
            won, votes = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
            for (a, b), q in zip(pairs, p.T, strict=True):
                won[:, a] += q / (len(langs) - 1)
                won[:, b] += (1 - q) / (len(langs) - 1)
                votes[:, a] += q >= 0.5
                votes[:, b] += q < 0.5
            best = (votes + 0.5 * won).argmax(1)  # most pairs won, then the surest wins
            score[rows] *= won[np.arange(len(rows)), best]
        else:
            best = np.zeros(len(rows), np.int64)
        for i, k in zip(rows.tolist(), best.tolist(), strict=True):
            out[i] = langs[k]
    return out, score


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_lang, _h, _slot, _text) to (_lang, _h, _slot, weight numbers, values) as packed arrays."""
    for b in slices(batches, "_text", 1 << 20):
        for i in range(b.num_rows):
            found = [np.zeros(BLOCK, np.int64) for _ in range(ORDERS)]
            for _, parts in _pieces([b.column(3)[i].as_py()]):
                for o, (number, _) in enumerate(grams(parts)):
                    found[o] += np.bincount(number - o * BLOCK, minlength=BLOCK)
            share = np.concatenate([SCALE * x / max(1, x.sum()) for x in found])
            at = np.flatnonzero(share).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.slice(i, 1).columns[:3], pa.array([at.tobytes()], pa.binary()),
                                              pa.array([share[at].astype(np.float32).tobytes()], pa.binary())],
                                             ["_lang", "_h", "_slot", "_num", "_val"])


def svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = 1.0, epochs: int = 30) -> np.ndarray:
    """Linear support vector machine (squared hinge, classes weighted alike) by
    dual coordinate descent; the last weight is the intercept."""
    w = np.zeros(WEIGHTS + 1)
    norm = np.array([float(v @ v) + 1 for _, v in rows])
    price = cost * len(y) / 2 / np.array([max(1, (y == s).sum()) for s in y])
    slack = 0.5 / price
    alpha = np.zeros(len(y))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            at, v = rows[i]
            gradient = y[i] * (v @ w[at] + w[-1]) - 1 + alpha[i] * slack[i]
            new = max(0.0, alpha[i] - gradient / (norm[i] + slack[i]))
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                w[-1] += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over margins (Newton steps, slightly penalised)."""
    x = np.stack([z, np.ones(len(z))], 1)
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    at = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + 1e-3 * np.eye(2)
        at = at - np.linalg.solve(h, x.T @ (p - target) + 1e-3 * (at - [1, 0]))
    return max(float(at[0]), 1e-3), float(at[1])


def _fit(table: pa.Table) -> pa.Table:
    """One machine: fitted on three quarters of its rows, calibrated on the rest."""
    table = table.sort_by([("_y", "ascending"), ("_h", "ascending"), ("_lang", "ascending")])  # shuffled rows come in any order
    y = np.array(table.column("_y").to_pylist(), float)
    rows = [(np.frombuffer(n, np.int32), np.frombuffer(v, np.float32).astype(float))
            for n, v in zip(table.column("_num").to_pylist(), table.column("_val").to_pylist(), strict=True)]
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.ones(len(y), bool)
    fit = ~held if not held.all() else held
    w = svm([r for r, f in zip(rows, fit, strict=True) if f], y[fit]).astype(np.float32)
    z = np.array([v @ w[n] + w[-1] for (n, v), h in zip(rows, held, strict=True) if h])
    slope, shift = _calibrate(z, y[held])
    return pa.table({"_machine": table.column("_machine").slice(0, 1), "weights": pa.array([w.tobytes()], pa.binary()), "slope": [slope], "shift": [shift]})


def _remainder(key):
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE,
          languages: int = LANGUAGES, families: dict[str, str] = FAMILIES) -> Model:
    """Fit a machine for each family and each pair of languages within one."""
    spark = docs.sparkSession
    ship_package(spark)
    learn = docs.select(F.col(key).cast("string").alias("_key"), F.col(lang).alias("_lang"), F.col(text).alias("_text")).where(
        F.col("_lang").isNotNull() & F.col("_text").isNotNull() & (_remainder(F.col("_key")) != HELD))
    common = [r["_lang"] for r in learn.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(languages).collect()]
    groups: dict[str, list[str]] = {}
    for name in sorted(common):
        groups.setdefault(family_of(name, families), []).append(name)
    if not common:
        return Model()
    machines = [(_pair(a, b), x, y) for g in groups.values() for a, b in combinations(g, 2) for x, y in ((a, 1), (b, -1))]
    # a family's machine takes its texts' first slots, so that no family has over `sample` texts
    if len(groups) > 1:
        machines += [(f"family\t{f}", x, 1 if x in g else -1) for f, g in groups.items() for x in common]
    if not machines:
        return Model(groups)
    uses = spark.createDataFrame([(m, x, y, sample if m.startswith("pair") else max(1, sample // len(groups[family_of(x, families)])))
                                  for m, x, y in machines], "_machine string, _lang string, _y int, _slots int")
    drawn = learn.where(F.col("_lang").isin(common)).withColumn("_h", F.xxhash64("_text"))
    # the least text hash of each slot: at most `sample` rows a language, copies once; no text is shuffled for it
    chosen = drawn.groupBy("_lang", F.pmod("_h", F.lit(sample)).cast("int").alias("_slot")).agg(F.min(F.struct("_h", "_key")).alias("_least"))
    chosen = chosen.select("_lang", F.row_number().over(Window.partitionBy("_lang").orderBy("_slot")).alias("_slot"),
                           F.col("_least._h").alias("_h"), F.col("_least._key").alias("_key"))
    one = (drawn.join(F.broadcast(chosen), ["_lang", "_h", "_key"]).select("_lang", "_h", "_slot", "_text")
           .mapInArrow(_features, "_lang string, _h long, _slot int, _num binary, _val binary").dropDuplicates(["_lang", "_h"]))
    rows = one.join(F.broadcast(uses), "_lang").where("_slot <= _slots").select("_machine", "_y", "_lang", "_h", "_num", "_val")
    fitted = rows.groupBy("_machine").applyInArrow(_fit, "_machine string, weights binary, slope double, shift double").collect()
    return Model(groups, {r["_machine"]: (np.frombuffer(r["weights"], np.float32), r["slope"], r["shift"]) for r in fitted})


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``held_out``, ``lang_pred`` and ``score`` of every row."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)
    src = docs.select(F.col(key).alias("_key"), (_remainder(F.col(key)) == HELD).alias("held_out"), F.col(text).alias("_text"))
    schema = src.select(F.col("_key").alias(key), "held_out", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text", 1 << 20):
            lang, score = predict(sent.value, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema.names)

    return src.mapInArrow(run, schema)

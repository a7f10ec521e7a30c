"""Toxicity by cumulative-link ordinal regression.

Severity grades 0 to K - 1 are predicted from sparse text features. One weight vector serves
all K - 1 ordered thresholds (proportional odds): P(grade > k) = sigmoid(w.x - t_k), and the
expected severity is the sum of these over k. Features are the counts of words and of
their first 4, 5 and 6 letters, A-Z and other cased letters lower-cased, chosen by a G-test
between toxic and clean texts of the training sample, so texts without such words score as
the bias alone, however long they are. Each is tested at every level up to LEVELS: as "occurs
that often at least". A stem that clean texts hold once, say, but toxic ones more often, counts
from its second occurrence on.

The model is fitted on the driver from at most `most_rows` labelled rows (those with the
smallest hash of their id), each reduced to its distinct words; everything else covers all
rows. The labels hold toxic 0 or 1 only; grades above 0 come from how many words of a toxic
text are marked, where a word is marked if the sample has it in toxic texts only, three
times at least (grade_rows). The model, at most MOST_FEATURES weights, travels with the task.

Nulls: a null text is an empty one and scores as the bias; labels that are null or without a
document are ignored; a null id gets a score like any other. Repeated rows get the same
score each. With no labels, or labels of one kind, every text gets severity 0. Empty tables
give no rows. Very long texts are read whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim

MOST_ROWS, MOST_FEATURES = 8_000, 20_000
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
#: Words whose features a task remembers.
CACHED = 100_000
#: Numbers of occurrences from which a feature may count.
LEVELS = 4


def word_counts(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def stem_counts(ws: dict[str, int]) -> Counter:
    """Occurrences of each feature, by those of the words."""
    on: Counter = Counter()
    for w, n in ws.items():
        for f in features_of(w):
            on[f] += n
    return on


def at_level(f: str, level: int) -> str:
    """Name of a feature that counts from its level-th occurrence on."""
    return f if level == 1 else f"{f}{level}"


@dataclass
class Model:
    """weights: by feature and level, for the binary logarithm of one more than its count from
    that level on; thresholds: ascending, one fewer than grades."""

    weights: dict[str, float]
    thresholds: list[float]

    def severity(self, text: str | None, known: dict[str, tuple]) -> tuple[float, float]:
        """Expected severity and P(grade > 0). known caches the features of words."""
        if not self.thresholds:
            return 0.0, 0.0
        on: Counter = Counter()
        for w in WORD.findall((text or "").lower()):
            got = known.get(w)
            if got is None:
                if len(known) > CACHED:
                    known.clear()
                got = known[w] = tuple(f for f in features_of(w) if any(at_level(f, k) in self.weights for k in range(1, LEVELS + 1)))
            if got:
                on.update(got)
        z = sum(self.weights.get(at_level(f, k), 0.0) * math.log2(2 + on[f] - k) for f in sorted(on) for k in range(1, min(LEVELS, on[f]) + 1))
        p = 1 / (1 + np.exp(-np.clip(z - np.array(self.thresholds), -40, 40)))
        return float(p.sum()), float(p[0])


def apart(rows: list[tuple[dict, int]]) -> list[tuple[dict, int]]:
    """rows without near copies of earlier ones (four triples of word MinHashes), which would
    make any rare word that they share look like evidence."""
    odd = np.random.default_rng(3).integers(1, 2**31, 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    seen, out = set(), []
    for ws, t in rows:
        if ws:
            h = np.array([zlib.crc32(w.encode()) for w in ws], np.uint64) + np.uint64(1)
            low = ((np.multiply.outer(odd, h) & np.uint64(0xFFFFFFFF)).min(axis=1)).reshape(4, 3).tolist()
            keys = {(k, *x) for k, x in enumerate(low)}
            if keys & seen:
                continue
            seen |= keys
        out.append((ws, t))
    return out


def grade_rows(rows: list[tuple[dict, int]], steps: tuple[int, ...] = (4, 8)) -> list[int]:
    """Grades of (word counts, toxic) rows: 0 if clean, else 1 and one more for each of steps that
    the count of marked words reaches."""
    toxic, clean = Counter(), Counter()
    for ws, t in rows:
        (toxic if t else clean).update(ws.keys())
    marked = {w for w, n in toxic.items() if n >= 3 and not clean[w]}
    return [0 if not t else 1 + sum(sum(n for w, n in ws.items() if w in marked) >= s for s in steps) for ws, t in rows]


def choose(rows: list[tuple[dict, int]], least: float = 20.0, share: float = 0.8) -> list[str]:
    """Features at levels where reaching the level and the label are dependent, by the G statistic,
    and where the given share of the texts that reach it is toxic; weaker ones mostly tell
    languages apart."""
    count, toxic = Counter(), Counter()
    for ws, g in rows:
        fs = [at_level(f, k) for f, n in stem_counts(ws).items() for k in range(1, min(LEVELS, n) + 1)]
        count.update(fs)
        if g:
            toxic.update(fs)
    n, p = len(rows), sum(g > 0 for _, g in rows)

    def g_test(f: str) -> float:
        cells = np.array([[toxic[f], count[f] - toxic[f]], [p - toxic[f], n - p - count[f] + toxic[f]]], float)
        want = cells.sum(1, keepdims=True) * cells.sum(0, keepdims=True) / n
        return 2 * float((cells * np.log(np.where(cells > 0, cells, 1) / np.maximum(want, 1e-12)))[cells > 0].sum())

    found = sorted(((-s, f) for f in count if count[f] >= 3 and toxic[f] >= share * count[f] and (s := g_test(f)) >= least))
    return [f for _, f in found[:MOST_FEATURES]]


def fit(rows: list[tuple[dict, int]], grades: list[int], steps: int = 500, rate: float = 0.1, ridge: float = 1e-6) -> Model:
    """Weights and thresholds by Adam on the mean log loss of the cumulative links. Classes
    count alike, so rare grades are not drowned."""
    k = max(grades, default=0)
    if not k or not min(grades) == 0:
        return Model({}, [])
    names = choose([(ws, g) for (ws, _), g in zip(rows, grades)])
    if not names:
        return Model({}, [])
    at = {f: i for i, f in enumerate(names)}
    cols = []
    for ws, _ in rows:
        cols.append(sorted((at[name], n + 1 - k) for f, n in stem_counts(ws).items() for k in range(1, min(LEVELS, n) + 1) if (name := at_level(f, k)) in at))
    row = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    col = np.array([c for cs in cols for c, _ in cs], np.int64)
    val = np.log2(1 + np.array([n for cs in cols for _, n in cs], float))
    above = (np.array(grades)[:, None] > np.arange(k)[None, :]).astype(float)
    weight = np.where(above[:, 0] > 0, 0.5 / max(1, above[:, 0].sum()), 0.5 / max(1, (1 - above[:, 0]).sum()))[:, None]
    x = np.concatenate([np.zeros(len(names)), [0.0], np.full(k - 1, 0.5)])  # weights, first threshold, gaps
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        w, gaps = x[: len(names)], np.logaddexp(0, x[len(names) + 1 :])
        th = x[len(names)] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(row, w[col] * val, len(cols))[:, None] - th[None, :]
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - above) * weight
        dth = -err.sum(0)
        tails = np.cumsum(dth[::-1])[::-1]
        g = np.concatenate([np.bincount(col, err.sum(1)[row] * val, len(names)) + ridge * w, [tails[0]], tails[1:] / (1 + np.exp(-x[len(names) + 1 :]))])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        np.maximum(x[: len(names)], 0, out=x[: len(names)])  # chosen features only ever raise severity
    gaps = np.logaddexp(0, x[len(names) + 1 :])
    return Model(dict(zip(names, x[: len(names)].tolist())), (x[len(names)] + np.concatenate([[0.0], np.cumsum(gaps)])).tolist())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = MOST_ROWS) -> Model:
    """A model from the most_rows labelled rows whose ids have the smallest hashes."""
    some = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("label"))
    some = some.orderBy(F.xxhash64(id_col), id_col).limit(most_rows)
    # the broadcast side has at most most_rows rows of two numbers
    own = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(some), id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([sorted(word_counts(t.as_py()).items()) for t in b.column(1)], pa.map_(pa.string(), pa.int32()))], names=["id", "label", "words"])

    got = own.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, label int, words map<string,int>").toArrow()
    rows = apart([(dict(ws), int(t)) for _, t, ws in sorted(zip(*(c.to_pylist() for c in got.columns)), key=lambda x: (x[0], x[1], x[2]))])
    return fit(rows, grade_rows(rows))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject: float = 0.5) -> DataFrame:
    """id_col, expected_severity (4 decimals), p_toxic, grade (the rounded expectation) and
    rejected (P(grade > 0) is reject or more) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for b in batches:
            got = [model.severity(t.as_py(), known) for t in b.column(1)]
            sev, p = [round(x, 4) for x, _ in got], [round(x, 4) for _, x in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sev, pa.float64()), pa.array(p, pa.float64()), pa.array([int(x + 0.5) for x in sev], pa.int32()), pa.array([x >= reject for x in p], pa.bool_())], names=[id_col, "expected_severity", "p_toxic", "grade", "rejected"])
        known.clear()
        trim()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, expected_severity double, p_toxic double, grade int, rejected boolean")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", reject: float = 0.5) -> DataFrame:
    """docs without the rows that score() rejects, all columns as they are."""

    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for b in batches:
            yield b.filter(pa.array([round(model.severity(t.as_py(), known)[1], 4) < reject for t in b.column(at)], pa.bool_()))
        known.clear()
        trim()

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names with dots aren't found by name
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)

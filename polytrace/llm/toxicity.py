"""Toxicity as ordered severity grades: cumulative-link regression on sparse text features.

Features are words and word beginnings (4 to 6 letters, for inflected languages) of a text, each with
log(1 + how many of 100 words it is): what counts is how dense a text is, not how long. The labelled rows say which matter: for every feature the toxic and clean documents that hold it are
counted; telling are those too frequent in toxic ones for chance (by a Chernoff bound with two or three false ones to be expected; copies count once), at most ``FEATURES``.

Labels are 0 or 1, so toxic rows get a grade from 1 to 3 by thirds of a density that the model does not see: the share of their words that tell toxic rows in the
other half of the labelled rows (halves by the text's hash, so copies stay together). Clean rows grade 0. The model
has one weight vector and ordered thresholds: P(grade >= j) = sigmoid(w x - t_j). The result is the expected severity,
the sum of these, and a verdict from P(grade >= 1), with a threshold set on labelled rows by models that were fitted on other ones (``FOLDS``).

Fitting takes at most ``MAX_LABELLED`` labelled rows, those whose ids hash smallest; all documents are scored.

Defined results: null or empty text has severity 0 and is never toxic; without labelled rows of
both classes nothing is toxic and severity is 0; a row labelled twice is toxic if either says so; rows with null labels or ids aren't used in fitting;
a probability equal to the threshold is toxic; of features equally telling the first in the alphabet is taken; very long texts are read whole;
repeated rows get equal results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_LABELLED, FEATURES, GRADES, FOLDS = 12_000, 4096, 3, 3
#: A feature is looked at if it stands in so many toxic documents.
SUPPORT = 3
PREFIXES = (4, 5, 6)
#: The verdict's threshold is the one of these with the most recall minus so many times the false alarms on labelled rows; else the middle.
THRESHOLDS, FALSE_ALARM = (0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6), 5.0

_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def words_in(text: str) -> Counter:
    """Lower-cased words with marks and digits at their ends removed, with counts."""
    out: Counter = Counter()
    for w, n in Counter(text.lower().split()).items():
        if not w.isalpha():
            w = _EDGES.sub("", w)
        if w:
            out[w] += n
    return out


def features_in(text: str) -> Counter:
    """Counts of all features of a text; a beginning ends in an asterisk."""
    words = words_in(text)
    out = Counter(words)
    for w, n in words.items():
        for k in PREFIXES:
            if len(w) > k:
                out[w[:k] + "*"] += n
    return out


def vector(text: str, index: dict[str, int]) -> list[tuple[int, int]]:
    """(feature, count) of a text for the features in ``index``."""
    out: Counter = Counter()
    get = index.get
    for w, n in words_in(text).items():
        if (k := get(w)) is not None:
            out[k] += n
        for size in PREFIXES:
            if len(w) > size and (k := get(w[:size] + "*")) is not None:
                out[k] += n
    return sorted(out.items())


def dense(counts: np.ndarray, words: np.ndarray | int) -> np.ndarray:
    """The value of a feature that is met so many times among so many words."""
    return np.log1p(100 * counts / np.maximum(words, 1))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class Ordinal:
    """P(grade >= j) = sigmoid(w x - t_j) with t_1 < t_2 < ...; gaps are kept positive as exponentials."""

    def __init__(self, n_features: int, grades: int):
        self.w, self.first, self.gaps = np.zeros(n_features), 2.0, np.zeros(grades - 1)

    @property
    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate([[0.0], np.cumsum(np.exp(self.gaps))])

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= j) for each row and j."""
        return sigmoid(z[:, None] - self.thresholds[None, :])

    def fit(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grade: np.ndarray, steps: int = 1200, rate: float = 0.05, decay: float = 2e-5) -> Ordinal:
        """Adam on the mean negative log-likelihood of sparse rows (coordinates ``rows``, ``cols``)."""
        n, j = len(grade), len(self.gaps) + 1
        p = np.concatenate([self.w, [self.first], self.gaps])
        m, v = np.zeros_like(p), np.zeros_like(p)
        for step in range(1, steps + 1):
            self.w, self.first, self.gaps = p[:-j], p[-j], p[len(p) - j + 1 :]
            z = np.bincount(rows, values * self.w[cols], minlength=n)
            c = np.concatenate([np.ones((n, 1)), self.above(z), np.zeros((n, 1))], axis=1)
            mass = np.maximum(np.take_along_axis(c, grade[:, None], 1) - np.take_along_axis(c, grade[:, None] + 1, 1), 1e-12)[:, 0]
            slope = c * (1 - c)
            low, high = np.take_along_axis(slope, grade[:, None], 1)[:, 0], np.take_along_axis(slope, grade[:, None] + 1, 1)[:, 0]
            dz = -(low - high) / mass / n
            g_w = np.bincount(cols, values * dz[rows], minlength=len(self.w)) + decay * self.w
            g_t = np.bincount(np.maximum(grade, 1) - 1, np.where(grade > 0, low / mass, 0), minlength=j)[:j] / n
            g_t -= np.bincount(np.minimum(grade, j - 1), np.where(grade < j, high / mass, 0), minlength=j)[:j] / n
            tail = np.cumsum(g_t[::-1])[::-1]
            g = np.concatenate([g_w, [tail[0]], tail[1:] * np.exp(self.gaps)])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.w, self.first, self.gaps = p[:-j], p[-j], p[len(p) - j + 1 :]
        return self


class Model:
    """The telling features and the fitted regression."""

    def __init__(self, index: dict[str, int], ordinal: Ordinal | None, threshold: float = 0.5):
        self.index, self.ordinal, self.threshold = index, ordinal, threshold

    def severity(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity and P(grade >= 1) of each text."""
        if self.ordinal is None:
            return np.zeros(len(texts)), np.zeros(len(texts))
        w = self.ordinal.w
        z, known = np.zeros(len(texts)), [vector(t, self.index) if t else [] for t in texts]
        for k, v in enumerate(known):
            if v:
                at, n = np.array(v).T
                z[k] = w[at] @ dense(n, len(texts[k].split()))
        p = np.where(np.array([bool(t) for t in texts])[:, None], self.ordinal.above(z), 0.0)
        return p.sum(axis=1), p[:, 0]


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    """The model from labelled documents; ``labels`` has ``id_col`` and toxic (0 or 1)."""
    known = labels.where("toxic is not null").select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null")
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = common.hash_sample(known, F.xxhash64("id"), max_labelled, known.count())
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    labelled = common.stored(docs.join(F.broadcast(known), "id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic"), "labelled")  # the side sent out has max_labelled rows at most
    totals = {r[0]: r[1] for r in labelled.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Model({}, None)

    labelled = labelled.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[int, bool], Counter] = {(h, y): Counter() for h in (0, 1) for y in (False, True)}
            for text, y, h in zip(common.texts(b, "text"), b.column("toxic").to_pylist(), b.column("half").to_pylist(), strict=True):
                seen[h, y > 0].update(features_in(text).keys())
            for h in (0, 1):
                names = list(seen[h, False].keys() | seen[h, True].keys())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([h] * len(names), pa.int32()), *(pa.array([seen[h, y][k] for k in names], pa.int64()) for y in (True, False))], names=["feature", "half", "toxic", "clean"])

    met = labelled.dropDuplicates(["text", "toxic"]).mapInArrow(counts, "feature string, half int, toxic long, clean long")
    by_half = [F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}") for h in (0, 1) for c in ("toxic", "clean")]
    each = common.stored(met.groupBy("feature").agg(*by_half).where(F.col("toxic0") + F.col("toxic1") >= SUPPORT), "features")

    def part(*halves: int) -> DataFrame:
        return each.select("feature", *[sum((F.col(f"{c}{h}") for h in halves), F.lit(0)).alias(c) for c in ("toxic", "clean")])

    def telling(held: DataFrame) -> list[str]:
        held = held.where(F.col("toxic") >= SUPPORT)
        tested = max(2, held.count())
        t, c, share = F.col("toxic").cast("double"), F.col("clean").cast("double"), toxic / (toxic + clean)
        surprise = t * F.log(t / ((t + c) * share)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - share)))).otherwise(0.0)
        told = held.withColumn("surprise", surprise).where((F.col("surprise") >= float(np.log(tested)) - 1) & (t > share * (t + c)))
        return [r[0] for r in told.orderBy(F.col("surprise").desc(), "feature").limit(FEATURES).select("feature").collect()]

    index = {f: k for k, f in enumerate(telling(part(0, 1)))}
    others = [frozenset(f for f in telling(part(1 - h)) if f[-1] != "*") for h in (0, 1)]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, half = common.texts(b, "text"), b.column("half").to_pylist()
            x, n = [vector(t, index) for t in own], [len(t.split()) for t in own]
            share = [sum(c for w, c in words_in(t).items() if w in others[h]) / max(1, m) for t, h, m in zip(own, half, n, strict=True)]
            columns = [b.column("toxic"), b.column("fold"), pa.array(n, pa.int64()), pa.array(share, pa.float64()), pa.array([[k for k, _ in v] for v in x], pa.list_(pa.int32())), pa.array([[c for _, c in v] for v in x], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["toxic", "fold", "words", "share", "cols", "counts"])

    folded = labelled.withColumn("fold", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(FOLDS)).cast("int"))
    rows = folded.mapInArrow(vectors, "toxic int, fold int, words long, share double, cols array<int>, counts array<int>").collect()  # MAX_LABELLED at most
    rows = sorted((r[0], r[1], r[2], r[3], tuple(r[4]), tuple(r[5])) for r in rows)
    y, fold, n, share = (np.array([r[k] for r in rows]) for k in range(4))
    y = y > 0
    at = np.repeat(np.arange(len(rows)), [len(r[4]) for r in rows])
    cols = np.array([k for r in rows for k in r[4]], np.int64)
    values = dense(np.array([c for r in rows for c in r[5]], np.float64), n[at])
    cuts = np.quantile(share[y], [1 / 3, 2 / 3])
    grade = np.where(y, 1 + (share[:, None] > cuts[None, :]).sum(axis=1), 0)

    def model(on: np.ndarray) -> Ordinal:
        place, inside = np.cumsum(on) - 1, on[at]
        return Ordinal(len(index), GRADES).fit(place[at[inside]], cols[inside], values[inside], grade[on])

    p = np.zeros(len(rows))
    for k in range(FOLDS):
        if (fold != k).any() and (fold == k).any():
            o = model(fold != k)
            p[fold == k] = o.above(np.bincount(at, values * o.w[cols], minlength=len(rows)))[fold == k, 0]
    gain = [(p[y] >= t).mean() - FALSE_ALARM * (p[~y] >= t).mean() for t in THRESHOLDS]
    return Model(index, model(np.ones(len(rows), bool)), THRESHOLDS[int(np.argmax(gain))])


def rate_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per row: ``id_col``, severity (0 to 3), p_toxic and toxic. With ``keep`` all rows of ``df`` that are not toxic, as they are."""
    model = df.sparkSession.sparkContext.broadcast(fit(df, labels, id_col, text_col, max_labelled))
    if keep:

        @F.pandas_udf("boolean")
        def fine(text):
            p = model.value.severity(["" if t is None else t for t in text])[1]
            return text.isna() | (p < model.value.threshold)

        return df.where(fine(F.col(text_col).cast("string")))
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches, 2000):
            s, p = model.value.severity(common.texts(b, "text"))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s), pa.array(p), pa.array(p >= model.value.threshold)], names=["id", "severity", "p_toxic", "toxic"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, severity double, p_toxic double, toxic boolean").withColumnRenamed("id", id_col)

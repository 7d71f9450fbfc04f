"""Document quality: rule statistics, and an isolation forest over them.

The statistics are counted over each whole text. The forest isolates documents by random
splits of the statistics: a document that few splits set apart is anomalous (score near
1). Each of ``TREES`` trees grows from ``SUBSAMPLE`` rows, which is the
method itself; the rows are those with the smallest hashes, so the forest depends only on the table.
All documents are scored.

Labels say twice what an anomaly means. The forest splits only on statistics by which some bad documents stand out: of at least ``TELLING`` of them they lie
outside the range that holds 99 % of the good ones (of ``MAX_LABELLED`` labelled rows at most, those whose hashes are smallest); else rare but
harmless things, such as a repeated line, hide them. And the threshold is the one with the most recall on all bad rows minus ``FALSE_ALARM`` times the
rejected share of all good ones, among those that pass the base rules.

Defined results: null or empty text has no words (and fails the base rules); a document
whose ``id_col`` has no label counts for the forest only; one that is labelled twice is bad if either says so; without bad labelled rows the forest takes
all statistics, and the threshold rejects ``FALSE_REJECTS`` of the good rows at most; without good labelled
rows only the base rules reject; a score equal to the threshold rejects; very long texts are counted whole; rows are independent, repeated rows get equal
results; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TREES, SUBSAMPLE = 100, 256
FALSE_REJECTS, FALSE_ALARM = 0.005, 5.0
MAX_LABELLED, TELLING = 12_000, 0.03
BINS = 10_000
WINDOW = 8
#: Texts above so many words find repeated windows by ranks, in arrays, instead of a dictionary.
RANKED_FROM = 50_000

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_echoes", "n_long_words"]
SYMBOLS, MARKS = b"#*$%&|<>", b"!?"
UPPER = bytes(range(65, 91))


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text, first ones included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    if len(words) < RANKED_FROM:
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        keys = [joined[a:b] for a, b in zip(starts[:n].tolist(), ends[window - 1 :].tolist(), strict=True)]
        seen = Counter(keys)
        if len(seen) == n:
            return 0
        again = np.fromiter((seen[k] > 1 for k in keys), bool, n)
    else:
        # ranks of single words, then of windows of 2, 4 and 8: equal ranks mean equal windows
        first: dict[bytes, int] = {}
        rank = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, len(words))
        at, span = rank, 1
        while span < window:
            pairs = at[: len(at) - span] * (int(at.max()) + 1) + at[span:]
            at, span = np.unique(pairs, return_inverse=True)[1].astype(np.int64), span * 2
        again = (np.bincount(at) > 1)[at]
    edge = np.zeros(len(words) + 1, np.int64)
    where = np.flatnonzero(again)
    np.add.at(edge, where, 1)
    np.add.at(edge, where + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: bytes) -> tuple[int, ...]:
    """The values of ``STATS`` for a UTF-8 text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(common.ASCII_SPACE)]
    strip = lambda drop: len(text) - len(text.translate(None, drop))
    code_points = len(text) if text.isascii() else len(text.decode())
    return (
        len(words),
        code_points - strip(common.ASCII_SPACE),
        strip(SYMBOLS),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        strip(UPPER),
        strip(MARKS),
        sum(map(bytes.__eq__, words, words[1:])),
        sum(map((30).__lt__, map(len, words))),
    )


def rule_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``id_col`` and the columns ``STATS``."""
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches, 2000):
            rows = np.array([statistics(t) for t in common.raw(b, "text")], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(rows[:, k]) for k in range(len(STATS)))], names=["id", *STATS])

    return source.mapInArrow(run, f"id {kind}, " + ", ".join(f"{s} long" for s in STATS)).withColumnRenamed("id", id_col)


def features(rows: np.ndarray) -> np.ndarray:
    """Rates from counts in the order of ``STATS``: length alone makes no document anomalous."""
    words, chars, symbols, dup, again, lines, upper, marks, echoes, long = rows.astype(np.float64).T
    per_char, per_word = np.maximum(chars, 1), np.maximum(words, 1)
    return np.stack([chars / per_word, symbols / per_char, dup / np.maximum(lines, 1), again / per_word, upper / per_char, marks / per_char, echoes / per_word, long / per_word], axis=1)


def harmonic_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, np.float64)
    big = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(big - 1) + 0.5772156649015329) - 2 * (big - 1) / big, np.where(n == 2, 1.0, 0.0))


def telling(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Which features tell bad rows: those that lay ``TELLING`` of them outside the middle 99 % of good rows; without such a one, all."""
    if not len(good) or not len(bad):
        return np.arange(good.shape[1])
    low, high = np.quantile(good, [0.005, 0.995], axis=0)
    out = ((bad < low) | (bad > high)).mean(axis=0)
    return np.flatnonzero(out >= TELLING) if (out >= TELLING).any() else np.arange(good.shape[1])


def best_threshold(bins: list[tuple[int, int, int]], false_rejects: float) -> float | None:
    """The score from which on documents are rejected, from (bin of scores, quality, count)."""
    good, bad = (sum(n for _, q, n in bins if q == k) for k in (1, 0))
    if not good:
        return None
    best, at, above = None, None, [0, 0]
    for k in sorted({k for k, _, _ in bins}, reverse=True):
        for kind in (0, 1):
            above[kind] += sum(n for i, q, n in bins if i == k and q == kind)
        if bad:
            gain = above[0] / bad - FALSE_ALARM * above[1] / good
        else:
            gain = above[1] if above[1] <= false_rejects * good else -1
        if gain > 0 and (best is None or gain > best):
            best, at = gain, k
    if at is None:
        at = max(k for k, _, _ in bins) + 1
    return at / BINS


class Forest:
    """Isolation trees in flat arrays: feature (-1: leaf), cut, left child (the right one follows), path length of leaves."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size = min(subsample, len(rows))
        depth = int(np.ceil(np.log2(max(self.size, 2))))
        self.feature, self.cut, self.left, self.path, self.roots = [], [], [], [], []
        for _ in range(trees if len(rows) else 0):
            self._grow(rows[rng.choice(len(rows), self.size, replace=False)], depth, rng)
        self.feature, self.left = np.array(self.feature, np.int32), np.array(self.left, np.int32)
        self.cut, self.path = np.array(self.cut), np.array(self.path)

    def _grow(self, rows: np.ndarray, depth: int, rng: np.random.Generator) -> None:
        def leaf(n: int, at: int) -> tuple:
            return -1, 0.0, 0, at + float(harmonic_path(n))

        def add(node: tuple) -> int:
            for to, v in zip((self.feature, self.cut, self.left, self.path), node, strict=True):
                to.append(v)
            return len(self.feature) - 1

        self.roots.append(add(leaf(len(rows), 0)))
        queue = [(self.roots[-1], rows, 0)]
        while queue:
            node, x, at = queue.pop()
            low, high = x.min(axis=0), x.max(axis=0)
            free = np.flatnonzero(high > low)
            if at >= depth or len(x) < 2 or not len(free):
                continue
            k = int(rng.choice(free))
            cut = float(rng.uniform(low[k], high[k]))
            side = x[:, k] < cut
            self.feature[node], self.cut[node] = k, cut
            self.left[node] = add(leaf(int(side.sum()), at + 1))
            add(leaf(int((~side).sum()), at + 1))
            queue += [(self.left[node], x[side], at + 1), (self.left[node] + 1, x[~side], at + 1)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row: 2 to the power of minus its mean path length over the expected one."""
        if not self.roots:
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for root in self.roots:
            node = np.full(len(x), root, np.int32)
            inner = np.flatnonzero(self.feature[node] >= 0)
            while len(inner):
                at = node[inner]
                node[inner] = self.left[at] + (x[inner, self.feature[at]] >= self.cut[at])
                inner = inner[self.feature[node[inner]] >= 0]
            total += self.path[node]
        return 2.0 ** (-total / len(self.roots) / max(float(harmonic_path(self.size)), 1e-9))


def assess(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, subsample: int = SUBSAMPLE, false_rejects: float = FALSE_REJECTS) -> DataFrame:
    """One row per row: ``id_col``, ``STATS``, base_failed, score (of anomaly), threshold and kept.

    ``labels`` has ``id_col`` and quality (1: good, 0: bad); null labels are not used.
    """
    spark = df.sparkSession
    stats = common.stored(rule_statistics(df, id_col, text_col), "statistics")
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    known = labels.where("quality in (0, 1)").groupBy(F.col(id_col).alias("labelled")).agg(F.min("quality").cast("int").alias("quality"))
    rated = stats.where(~base_failed).join(known, F.col(id_col) == F.col("labelled")).select(*STATS, "quality")
    rated = common.stored(rated, "rated")
    fit = common.hash_sample(rated, F.xxhash64(*STATS, "quality"), MAX_LABELLED, rated.count()).toPandas()
    seen, bad = features(fit[STATS].to_numpy(np.int64).reshape(-1, len(STATS))), fit["quality"].to_numpy() == 0
    use = telling(seen[~bad], seen[bad])
    picked = common.hash_sample(stats, F.xxhash64(F.col(id_col), *STATS), trees * subsample, stats.count()).select(*STATS).toPandas()
    forest = spark.sparkContext.broadcast(Forest(features(picked.to_numpy(np.int64).reshape(-1, len(STATS)))[:, use], trees, subsample))
    kind = stats.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.stack([b.column(1 + k).to_numpy() for k in range(len(STATS))], axis=1).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.value.score(features(rows)[:, use]))], names=[*b.schema.names, "score"])

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{s} long" for s in STATS) + ", score double"
    scored = common.stored(stats.mapInArrow(run, schema).withColumn("base_failed", base_failed), "scored")
    judged = scored.where(~F.col("base_failed")).join(known, F.col(id_col) == F.col("labelled"))
    bins = [tuple(r) for r in judged.groupBy(F.floor(F.col("score") * BINS).alias("bin"), "quality").count().collect()]
    threshold = best_threshold(bins, false_rejects)
    limit = F.lit(threshold).cast("double")
    kept = ~F.col("base_failed") & (F.lit(threshold is None) | F.coalesce(F.col("score") < limit, F.lit(True)))
    return scored.withColumn("threshold", limit).withColumn("kept", kept)

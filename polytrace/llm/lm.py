"""Language-model scores: add-one unigrams over all training words, and a gated recurrent network.

Tokens are the lower-cased words of a text and one end. Training documents are those for which crc32(id as text)
mod 7 is not 2; the rest are held out. Words of all training documents are counted on the cluster. The most frequent ``HEAD`` at
most go to every worker; the counts of the others are joined in, word by word, so
the vocabulary may grow without bound.

The network's symbols are the end, the most frequent words, and six groups for all other words (by final mark and by
whether they leave ASCII). P(word) of a grouped word is P(group) times its add-one share of the group,
with one place for words never seen, so that the probabilities of all words sum to at most 1. Output biases come from the
counts. The weights are warmed up on ``WARM_DOCS`` documents on the driver. Then all training documents are dealt to ``ROUNDS`` rounds by their texts' hashes: in each,
every task trains its own copy on all of its documents of that round (one in ``TRAIN_ONE_IN``, for trials), from the last round's weights and the sums of squared gradients
of the warm-up, and the copies are averaged by tokens. In training, documents longer than a piece are cut, so that all lanes are full. Documents are then scored whole,
in lanes that carry their state from window to window.

Defined results: null or empty text is the end alone; a null id counts as training; without training documents all counts are 0; words of equal counts are
numbered by the alphabet; very long texts are read whole;
repeated rows are scored alike (and count each); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, gru

HEAD, CLASSES, GROUPS = 65_536, 64, 6
WARM_DOCS, WARM_PASSES = 300, 2
ROUNDS, TRAIN_ONE_IN = 2, 1
#: Tokens that a task holds at once, and distinct words that it counts at once.
BLOCK_TOKENS, BLOCK_WORDS = 3_000_000, 400_000
CHUNKS = 128


def group_of(word: bytes) -> int:
    """Which of the ``GROUPS`` groups a word outside the network's symbols belongs to."""
    mark = 1 if word.endswith(b".") else 2 if word.endswith(b",") else 0
    return 2 * mark + (not word.isascii())


def group_column() -> F.Column:
    """The same as an expression over the column word."""
    word = F.col("word")
    return F.when(word.endswith("."), 2).when(word.endswith(","), 4).otherwise(0) + F.when(F.octet_length(word) != F.length(word), 1).otherwise(0)


def groups_of(words: pa.Array) -> np.ndarray:
    """The same of an array of words."""
    points, commas = (pc.ends_with(words, mark).to_numpy(zero_copy_only=False) for mark in (".", ","))
    return np.where(points, 2, np.where(commas, 4, 0)) + ~pc.string_is_ascii(words).to_numpy(zero_copy_only=False)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, one after another, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, number = parts.flatten(), np.diff(parts.offsets.to_numpy()).astype(np.int64)
    filled = pc.binary_length(words).to_numpy() > 0  # white space at a text's ends, and a text without words, give empty parts
    if not filled.all():
        number = np.bincount(np.repeat(np.arange(len(number)), number)[filled], minlength=len(number))
        words = words.filter(pa.array(filled))
    return words, number


def summed(values: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The sums of consecutive stretches of so many values each."""
    out, starts = np.zeros(len(number)), np.cumsum(number) - number
    some = number > 0
    if some.any():
        out[some] = np.add.reduceat(values, starts[some])
    return out


class Vocabulary:
    """What every worker needs of the counts: the head words with their symbols and logarithms."""

    def __init__(self, head: list[tuple[str, int]], ends: int, total: int, distinct: int, groups: dict[int, tuple[int, int]], classes: int = CLASSES):
        """head: (word, count); groups: (sum of counts, number of words) over all words of each group."""
        head = sorted(head, key=lambda x: (-x[1], x[0]))
        known = head[: classes * gru.CLASS - 1 - GROUPS]
        self.head = pa.array([w for w, _ in head], pa.string())
        count = np.array([n for _, n in head], np.int64)
        own = [group_of(w.encode()) for w, _ in head]
        mass, kinds = [groups.get(g, (0, 0))[0] for g in range(GROUPS)], [groups.get(g, (0, 0))[1] for g in range(GROUPS)]
        for (_, n), g in zip(known, own, strict=False):
            mass[g] -= n
            kinds[g] -= 1
        self.group_log = np.array([math.log10(m + k + 1) for m, k in zip(mass, kinds, strict=True)])
        # of the head words, and in the last place of words that are none
        self.symbol = np.array([*(1 + GROUPS + k if k < len(known) else 1 + own[k] for k in range(len(head))), 0], np.int32)
        self.log = np.append(np.log10(count + 1.0), 0.0)
        self.extra = np.array([*(0.0 if k < len(known) else self.log[k] - self.group_log[own[k]] for k in range(len(head))), 0.0])
        self.ends, self.end_log, self.end_known = ends, math.log10(ends + 1), int(ends > 0)
        self.total, self.base_log = total, math.log10(total + distinct + 1)
        self.frequency = np.zeros(classes * gru.CLASS)
        self.frequency[: 1 + GROUPS + len(known)] = [ends, *mass, *(n for _, n in known)]

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Of all texts together: the network's symbols, the head index of each word (-1: none), the words without one, and how many words each text has."""
        words, number = words_of(texts)
        found = pc.index_in(words, value_set=self.head.cast(words.type))
        at = found.fill_null(-1).to_numpy()
        tail = words.filter(found.is_null())
        symbols = self.symbol[at]
        symbols[at < 0] = 1 + groups_of(tail)
        return symbols, at, tail, number

    def symbols(self, texts: pa.Array) -> list[np.ndarray]:
        """The network's symbols of each text."""
        symbols, _, _, number = self.read(texts)
        return np.split(symbols, np.cumsum(number)[:-1])


def counted(rows: DataFrame) -> DataFrame:
    """(word, c) over the training rows; the empty word stands for ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, held = [], 0

        def merged() -> pa.Table:
            return pa.concat_tables(met).group_by("word", use_threads=False).aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])

        for b in common.sliced(batches, 500):
            words, _ = words_of(b.column("text"))
            each = words.value_counts()
            names, ends = each.field("values").cast(pa.string()), pa.array([""], pa.string())
            met.append(pa.table({"word": pa.chunked_array([names, ends]), "c": pa.chunked_array([each.field("counts"), pa.array([b.num_rows], pa.int64())])}))
            held += len(each)
            if held >= 2 * BLOCK_WORDS:
                met = [merged()]
                held = met[0].num_rows
                if held >= BLOCK_WORDS:
                    yield from met[0].combine_chunks().to_batches()
                    met, held = [], 0
        if met:
            yield from merged().combine_chunks().to_batches()

    # tasks hand over words already summed: they are dealt out before Spark sums them, not summed once more where they are
    return rows.where(~F.col("held_out")).select("text").mapInArrow(run, "word string, c long").repartition("word").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, head: int, classes: int) -> tuple[Vocabulary, int]:
    """The vocabulary and the least count of a head word."""
    words = counts.where("word != ''")
    # words by group and the eighth of a doubling their count lies in: a few hundred rows at any size, and one pass for all that follows from them
    met = counts.groupBy((F.col("word") == "").alias("end"), group_column().alias("g"), F.floor(F.log2("c") * 8).cast("int").alias("k")).agg(F.sum("c"), F.count("*")).collect()
    total, distinct, ends = sum(c for *_, c, _ in met), sum(n for *_, n in met), sum(c for end, _, _, c, _ in met if end)
    groups: dict[int, tuple[int, int]] = {}
    steps: dict[int, int] = {}
    for end, g, k, c, n in met:
        if not end:
            mass, kinds = groups.get(g, (0, 0))
            groups[g], steps[k] = (mass + c, kinds + n), steps.get(k, 0) + n
    least, held = 1 << 62, 0
    for k, n in sorted(steps.items(), reverse=True):
        held += n
        if held > head:
            break
        least = max(1, math.ceil(2 ** (k / 8) - 1e-9))
    rows = [(w, n) for w, n in words.where(F.floor(F.log2("c") * 8) >= F.floor(F.log2(F.lit(least)) * 8)).collect()] if steps and least < 1 << 62 else []
    return Vocabulary(rows, ends, total, distinct, groups, classes), min((n for _, n in rows), default=1 << 62)


def warmed(rows: DataFrame, vocab: Vocabulary, classes: int, hidden: int) -> tuple[gru.GRU, np.ndarray]:
    """The network after training on a bounded sample, the documents whose hashes are smallest; and its sums of squared gradients."""
    model = gru.GRU(classes, hidden)
    model.start_from(vocab.frequency)
    fit = rows.where(~F.col("held_out") & (F.length("text") > 0))
    texts = [r[0] for r in common.hash_sample(fit.select("text"), F.xxhash64("text"), WARM_DOCS, vocab.ends).collect()]
    docs = vocab.symbols(pa.array(texts, pa.string())) if texts else []
    memory = np.full_like(model.p, 0.1)
    for _ in range(WARM_PASSES):
        gru.train(model, docs, memory, lanes=32)
    return model, memory


def averaged(rows: DataFrame, vocab, model: gru.GRU, one_in: int, memory: np.ndarray | None = None) -> gru.GRU:
    """The mean, weighted by tokens, of the copies that all tasks have trained."""
    weights = rows.sparkSession.sparkContext.broadcast(model.p)
    met = rows.sparkSession.sparkContext.broadcast(np.full_like(model.p, 1.0) if memory is None else memory)
    classes, hidden = model.classes, model.hidden

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, docs, held, trained = gru.GRU(classes, hidden, flat=weights.value.copy()), [], 0, 0
        memory = met.value.copy()
        for b in common.sliced(batches, 500):
            texts = pc.fill_null(b.column("text"), "")
            taken = pc.binary_length(texts).to_numpy() > 0
            if one_in > 1:
                taken &= np.array([xxhash.xxh64_intdigest(text, 1) % one_in == 0 for text in common.raw(b, "text")])
            if taken.any():
                more = vocab.value.symbols(texts if taken.all() else texts.filter(pa.array(taken)))
                docs += more
                held += sum(map(len, more)) + len(more)
            if held >= BLOCK_TOKENS // 2:
                gru.train(own, docs, memory)
                docs, held, trained = [], 0, trained + held
        if docs:
            gru.train(own, docs, memory)
            trained += held
        if trained:
            parts = np.array_split(own.p, CHUNKS)
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([float(trained)] * CHUNKS, pa.float64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "tokens", "data"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for k, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                part = sums.setdefault(k, [0.0, 0.0])
                part[0] += n
                part[1] = part[1] + n * np.frombuffer(data, np.float32).astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.float64()), pa.array([p.tobytes() for _, p in sums.values()], pa.binary())], names=["chunk", "tokens", "data"])

    schema = "chunk int, tokens double, data binary"
    copies = rows.where(~F.col("held_out")).select("text").mapInArrow(run, schema)
    summed = sorted(copies.repartition("chunk").mapInArrow(total, schema).collect())  # the weights once, whatever the input
    if not summed:
        return model
    flat = np.concatenate([np.frombuffer(data, np.float64) / n for _, n, data in summed]).astype(np.float32)
    return gru.GRU(classes, hidden, flat=flat)


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, classes: int = CLASSES, hidden: int = gru.HIDDEN, train_one_in: int = TRAIN_ONE_IN) -> DataFrame:
    """One row per row: ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities)."""
    spark = df.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), held.alias("held_out"))
    counts = common.stored(counted(rows), "counts")
    words, least = vocabulary(counts, head, classes)
    vocab = spark.sparkContext.broadcast(words)
    model, memory = warmed(rows, words, classes, hidden)
    for k in range(ROUNDS):
        model = averaged(rows.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == k), vocab, model, train_one_in, memory)
    weights = spark.sparkContext.broadcast(model.p)
    tail_type = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, net = vocab.value, gru.GRU(classes, hidden, flat=weights.value)
        rid, held, docs, out, kept = TaskContext.get().partitionId() << 36, 0, [], [], []

        def tails(tail: pa.Array, number: np.ndarray) -> pa.Array:
            """Of each text, its words without a head index, and how often each occurs."""
            code = tail.dictionary_encode()
            kinds = max(1, len(code.dictionary))
            pairs, n = np.unique(np.repeat(np.arange(len(number)), number) * kinds + code.indices.to_numpy(), return_counts=True)
            bounds = np.searchsorted(pairs, np.arange(len(number) + 1) * kinds).astype(np.int32)
            words = code.dictionary.cast(pa.string()).take(pa.array(pairs % kinds))
            return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([words, pa.array(n, pa.int64())], fields=list(tail_type.value_type)))

        def block() -> pa.RecordBatch:
            nonlocal docs, out, kept, held
            lp = gru.score(net, docs) / math.log(10)
            first, n_tokens, known, head_log, extra, tail = zip(*out, strict=True)
            columns = [pa.array(np.concatenate(c)) for c in (first, n_tokens, known, head_log)]
            columns += [pa.array(lp + np.concatenate(extra)), pa.concat_arrays(tail)]
            whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            done = pa.RecordBatch.from_arrays([whole.column("id"), whole.column("held_out"), *columns], names=["id", "held_out", "rid", "n_tokens", "known", "head_log", "net_log", "tail"])
            docs, out, kept, held = [], [], [], 0
            return done

        for b in common.sliced(batches, 500):
            kept.append(b.select(["id", "held_out"]))
            symbols, at, tail, number = v.read(b.column("text"))
            ends, away = np.cumsum(number), at < 0
            docs += np.split(symbols, ends[:-1])
            extra = v.extra[at]
            extra[away] = -v.group_log[symbols[away] - 1]
            missing = np.diff(np.append(0, np.cumsum(away))[np.append(0, ends)])
            out.append((rid + np.arange(len(number)), number + 1, number - missing + v.end_known, summed(v.log[at], number) + v.end_log, summed(extra, number), tails(tail, missing)))
            rid += len(number)
            held += len(symbols) + len(number)
            if held >= BLOCK_TOKENS:
                yield block()
        if out:
            yield block()

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, rid long, n_tokens long, known long, head_log double, net_log double, tail array<struct<word:string,n:bigint>>"
    scored = common.stored(rows.mapInArrow(run, schema), "scored")
    tails = scored.select("rid", F.explode("tail").alias("t")).select("rid", "t.word", "t.n")
    met = tails.join(counts.where(F.col("c") < least), "word").select("rid", "n", "c")
    # dealt out by document before it is summed: the volume then follows the input, however many partitions there are
    sums = met.repartition("rid").groupBy("rid").agg(F.sum("n").alias("tail_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("tail_log"))
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    return scored.drop("tail").join(sums, "rid", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("head_log") + tail_log - F.col("n_tokens") * F.lit(words.base_log)).alias("base_score"),
        (F.col("net_log") + tail_log).alias("score"),
    )

"""The network learns from every training document."""

import time
import tracemalloc
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from polytrace.llm import gru, lm


def test_every_training_document_changes_the_weights(spark):
    texts = [f"some words {k} and others" for k in range(40)]
    texts = [t for t in texts if xxhash.xxh64_intdigest(t.encode(), 1) % 8][:12]
    vocab = lm.Vocabulary([(w, 5) for w in ("some", "words", "and", "others")], 12, 60, 16, {0: (40, 16)}, 1)
    model = gru.GRU(1)
    model.start_from(vocab.frequency)
    shared = spark.sparkContext.broadcast(vocab)
    for text in texts:
        rows = spark.createDataFrame([(text, False)], "text string, held_out boolean").where(F.lit(True))
        assert (lm.averaged(rows, shared, model, lm.TRAIN_ONE_IN).p != model.p).any()


def test_sparse_updates_equal_dense_ones():
    """One window on all weights, as Adagrad defines it, and as train() does it."""
    rng = np.random.default_rng(4)
    docs = [rng.integers(1, 100, 9).astype(np.int32) for _ in range(6)]
    model, plain = gru.GRU(2), gru.GRU(2)
    memory, sums = np.full_like(model.p, 1.0), np.full_like(model.p, 1.0)
    for _ in range(3):
        gru.train(model, docs, memory, lanes=6)
        line, flat = gru.Lanes(docs, 6), np.zeros_like(plain.p)
        of = gru.GRU(2, flat=flat)
        grads = {k: of[k] for k in plain.at}
        out, tape = plain.forward(line.x, np.zeros((6, plain.hidden), np.float32), line.keep, taped=True)
        on = line.y >= 0
        dout = np.zeros_like(out)
        dout[on] = plain.output(out[on], line.y[on], grads)[1]
        plain.backward(line.x, line.keep, tape, dout, grads)
        flat *= np.float32(1 / int(on.sum()) ** 0.5)
        sums += flat * flat
        plain.p -= np.float32(0.1) * flat / np.sqrt(sums)
        plain.tame()
    assert np.allclose(model.p, plain.p, atol=1e-6) and np.allclose(memory, sums, atol=1e-6)


def test_cut_documents_keep_every_token():
    """Pieces hold each symbol once as a target, after the symbol before it; the end follows the last piece alone."""
    rng = np.random.default_rng(5)
    docs = [rng.integers(1, 100, n).astype(np.int32) for n in (0, 1, 3, 4, 5, 8, 9, 40, 41)]
    line = gru.Lanes(docs, 3, 4)
    on = line.y >= 0
    assert sorted(line.y[on].tolist()) == sorted([s for d in docs for s in [*d.tolist(), 0]])
    pairs = sorted(zip(line.x[on].tolist(), line.y[on].tolist(), strict=True))
    assert pairs == sorted([p for d in docs for p in zip([0, *d.tolist()], [*d.tolist(), 0], strict=True)])
    assert line.lengths.max() - line.lengths.min() <= 5


def test_training_helps_on_held_out_text(spark):
    d = "/root/testdata/sf0.01"
    got = lm.score_documents(spark.read.parquet(f"{d}/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] / got[2] > got[1] / got[2] + 0.2 and got[0] / got[2] > -3.87


def test_gradients_equal_differences():
    """A window's gradients, of symbols met once and of those met often, against differences of its loss in double precision."""
    rng = np.random.default_rng(6)
    line = gru.Lanes([rng.choice([1, 1, 1, 2, 3, 70, 90, 127], rng.integers(1, 9)).astype(np.int32) for _ in range(90)], 30)
    model = gru.GRU(2, flat=rng.normal(0, 0.3, gru.GRU(2).p.shape))
    flat, on, start = np.zeros_like(model.p), line.y >= 0, np.zeros((line.x.shape[1], model.hidden))
    assert (np.bincount(line.x.ravel()) >= gru.OFTEN).any() and (np.bincount(line.x.ravel(), minlength=128)[[70, 90]] > 0).all()

    def loss() -> float:
        out, _ = model.forward(line.x, start, line.keep)
        return -model.output(out[on], line.y[on])[0].sum()

    of = gru.GRU(2, flat=flat)
    grads = {k: of[k] for k in model.at}
    out, tape = model.forward(line.x, start, line.keep, taped=True)
    dout = np.zeros_like(out)
    dout[on] = model.output(out[on], line.y[on], grads)[1]
    model.backward(line.x, line.keep, tape, dout, grads)
    for name, (a, b, _) in model.at.items():
        picked = a + np.argsort(-np.abs(flat[a:b]))[:4]
        for k in [*picked.tolist(), *rng.integers(a, b, 12).tolist()]:
            was = model.p[k]
            model.p[k] = was + 1e-5
            up = loss()
            model.p[k] = was - 1e-5
            down = loss()
            model.p[k] = was
            assert abs((up - down) / 2e-5 - flat[k]) < 1e-4 * max(1, abs(flat[k])), (name, k)


def vocabulary_of(texts: list[str], head: int) -> lm.Vocabulary:
    words = [w for t in texts for w in t.encode().lower().split()]
    kinds, counts = np.unique(np.array(words, object), return_counts=True)
    groups: dict[int, tuple[int, int]] = {}
    for w, n in zip(kinds, counts.tolist(), strict=True):
        mass, kind = groups.get(lm.group_of(w), (0, 0))
        groups[lm.group_of(w)] = mass + n, kind + 1
    ranked = sorted(((w.decode(), n) for w, n in zip(kinds, counts.tolist(), strict=True)), key=lambda x: (-x[1], x[0]))
    return lm.Vocabulary(ranked[:head], len(texts), len(words) + len(texts), len(kinds) + 1, groups)


def test_words_are_those_of_bytes():
    """Words, symbols, head indices and groups of a whole batch are those that bytes.lower().split() gives text by text."""
    texts = [f"{chr(c)}Ab{chr(c)}{chr(c)}\u00c9x,{chr(c)}" for c in [*range(300), 0x2003, 0x3000]] + ["", " \t\n", "one", None, "  Two  one. ", "\u0130 \u00df. K,"]
    want = [(t or "").encode().lower().split() for t in texts]
    vocab = vocabulary_of([t or "" for t in texts], 40)
    for k in (0, 3):  # slices too
        symbols, at, tail, number = vocab.read(pa.array(texts, pa.string()).slice(k))
        words = [w for x in want[k:] for w in x]
        index = {w.encode(): i for i, w in enumerate(vocab.head.to_pylist())}
        assert number.tolist() == [len(x) for x in want[k:]]
        assert at.tolist() == [index.get(w, -1) for w in words]
        assert [w.encode() for w in tail.to_pylist()] == [w for w in words if w not in index]
        assert symbols[at < 0].tolist() == [1 + lm.group_of(w) for w in words if w not in index]
        assert [len(x) for x in vocab.symbols(pa.array(texts, pa.string()).slice(k))] == number.tolist()


def test_reading_costs_less_than_a_lookup_for_each_word():
    """Counting, training and scoring each read all words: that takes well under the CPU time of a loop over words."""
    rng = np.random.default_rng(7)
    kinds = np.array([f"word{k}" for k in range(60_000)], object)
    texts = [" ".join(kinds[(rng.random(500) ** 4 * len(kinds)).astype(int)]) for _ in range(500)]
    vocab, column = vocabulary_of(texts, 20_000), pa.array(texts, pa.string())
    index = {w.encode(): i for i, w in enumerate(vocab.head.to_pylist())}

    def loop() -> None:
        for text in texts:
            words = text.encode().lower().split()
            at = np.fromiter(map(index.get, words, repeat(-1)), np.int32, len(words))
            tail = [words[k] for k in np.flatnonzero(at < 0).tolist()]
            vocab.symbol[at][at < 0] = [1 + lm.group_of(w) for w in tail]

    def seconds(f) -> float:
        start = time.process_time()
        f()
        return time.process_time() - start

    assert min(seconds(lambda: vocab.read(column)) for _ in range(5)) < 0.7 * min(seconds(loop) for _ in range(5))


def test_closed_gates_stay_finite():
    """Weights that drive the exponentials of gates and candidates to infinity give the states that the definition gives."""
    rng = np.random.default_rng(8)
    model = gru.GRU(2, hidden=8)
    model["e"][:] = rng.choice([-200, -3, 0, 3, 200], model["e"].shape)
    x, keep = rng.integers(0, 128, (6, 5)), np.ones((6, 5), np.float32)
    got, h = model.forward(x, np.zeros((5, 8), np.float32), keep)[0], np.zeros((5, 8))
    for t in range(6):
        g, r = model["e"][x[t]].astype(float), h @ model["u"].astype(float)
        z, reset = ((1 + np.tanh((g[:, a : a + 8] + r[:, a : a + 8]) / 2)) / 2 for a in (0, 8))
        n = np.tanh(g[:, 16:] + reset * r[:, 16:])
        h = n + z * (h - n)
        assert np.allclose(got[t], h, atol=1e-4)


def test_texts_without_rare_words(spark):
    """No word is outside the head; texts of no words count as their end."""
    rows = [(k, t) for k, t in enumerate(["a b a", None, " \n", "B", ""])]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(0, 4), (1, 1), (2, 1), (3, 2), (4, 1)] and all(np.isfinite(r.score) for r in got)


def test_products_are_small_and_memory_is_taken_again():
    """Blocks of logits stay in the range of the library's kernel for small products, and a second window's gradients take little fresh memory."""
    assert gru.BLOCK * gru.HIDDEN * gru.CLASS <= 1_000_000
    rng = np.random.default_rng(9)
    model = gru.GRU(4)
    line = gru.Lanes([rng.integers(1, 256, 31).astype(np.int32) for _ in range(256)], 256)
    flat = np.zeros_like(model.p)
    of = gru.GRU(4, flat=flat)
    grads = {k: of[k] for k in model.at}
    for _ in range(2):
        out, tape = model.forward(line.x, np.zeros((256, model.hidden), np.float32), line.keep, taped=True)
        dout = model.output(out.reshape(-1, model.hidden), line.y.ravel(), grads)[1].reshape(out.shape)
        tracemalloc.start()
        model.backward(line.x, line.keep, tape, dout, grads)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert most < 3 * dout.nbytes

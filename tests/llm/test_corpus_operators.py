"""Operators on whole tables: near-duplicates, passages, quality, toxicity, language model."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from polytrace.llm import gru, lm, quality, simhash, spans, toxicity

from .conftest import PASSAGE

# ------------------------------------------------------------------ SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius=2):
    label = list(range(len(fps)))
    while True:
        new = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= radius) for i in range(len(fps))]
        if new == label:
            break
        label = new
    least = {}
    for i, k in zip(ids, label, strict=True):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    return [least.get(k) for k in label]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=90), st.integers(0, 2**32))
def test_forest_connects_what_is_linked(groups, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fps, run = [], []
    for g in sorted(groups):
        x = int(base[g])
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            x ^= 1 << int(b)
        fps.append(x)
        run.append(g)
    pairs = sorted(set(zip(run, fps, strict=True)))
    run, x = np.array([r for r, _ in pairs]), np.array([f for _, f in pairs], np.uint64)
    a, b = simhash.forest_edges(run, x)
    root = list(range(len(x)))
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        assert run[i] == run[j]
        keep, gone = root[i], root[j]
        root = [keep if r == gone else r for r in root]
    want = list(range(len(x)))
    for i in range(len(x)):
        for j in range(i):
            if run[i] == run[j] and (int(x[i]) ^ int(x[j])).bit_count() <= 2:
                keep, gone = want[i], want[j]
                want = [keep if r == gone else r for r in want]
    assert len(set(zip(root, want, strict=True))) == len(set(root)) == len(set(want))


def test_large_groups_and_lags():
    rng = np.random.default_rng(5)
    x = np.unique(np.array([int(rng.integers(0, 2**20)) ^ (1 << int(rng.integers(0, 20))) for _ in range(3000)], np.uint64))
    near = simhash.within(lambda b, at: simhash.planes_of(x)[b][at] ^ (np.uint64(0xFFFFFFFFFFFFFFFF) if int(x[7]) >> b & 1 else np.uint64(0)), simhash.words_of(np.ones(len(x), bool)), 2, list(range(64)))
    assert simhash.lanes_of(near, len(x)).tolist() == [k for k in range(len(x)) if (int(x[k]) ^ int(x[7])).bit_count() <= 2]
    plane = simhash.words_of(rng.random(300) < 0.5)
    bits = np.unpackbits(plane.view(np.uint8), bitorder="little")
    for lag in (1, 63, 64, 65, 130):
        assert (np.unpackbits(simhash.shifted(plane, lag).view(np.uint8), bitorder="little")[: len(bits) - lag] == bits[lag:]).all()


def test_every_linked_pair_shares_a_key():
    rng = np.random.default_rng(2)
    m = simhash.masks(2, 8)
    assert len(m) == 28
    for _ in range(300):
        x = int(rng.integers(0, 2**63))
        y = x ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64)))
        assert any((x & k % (1 << 64)) == (y & k % (1 << 64)) for k in m)


def test_near_duplicates(docs, empty, rows):
    got = simhash.near_duplicates(docs).collect()
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    want = plain_components([i for i, _, _ in rows], fps)
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == Counter((i, f, c) for (i, _, _), f, c in zip(rows, fps, want, strict=True))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == sorted({c for c in want if c is not None})
    assert simhash.near_duplicates(empty).count() == 0 == simhash.keep_one(empty).count()


def test_long_chain_of_links(spark):
    """Components whose ends lie far apart need several rounds."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (1001, 1002)], "a long, b long")
    roots = defaultdict(set)
    for r in simhash.components(edges).collect():
        roots[r.root].add(r.node)
    assert sorted(map(len, roots.values())) == [3, 301]


def test_documents_of_the_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = d.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = plain_components([r.doc_id for r in rows], fps)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(d).collect()}
    assert got == {r.doc_id: (f, c) for r, f, c in zip(rows, fps, want, strict=True)}


# ------------------------------------------------------------------ passages


def test_sentences_cover_the_text(rows):
    for _, t, _ in rows:
        b = (t or "").encode()
        parts = spans.sentences(b)
        assert b"".join(b[x:y] for x, y, _ in parts) == b
        assert [w for p in parts for w in p[2]] == b.lower().split()


def brute_repeats(rows):
    """For each row its text without the sentences of runs that a smaller id, or the same text before, holds."""
    first = {}
    cut = [(i, (t or "").encode()) for i, t, _ in rows]
    for i, b in cut:
        for h, _ in spans.run_hashes(spans.sentences(b)):
            if i is not None:
                first[h] = min(first.get(h, i), i)
    out = []
    for (i, b), (_, t, _) in zip(cut, rows, strict=True):
        parts, seen = spans.sentences(b), set()
        drop = [False] * len(parts)
        for k, (h, end) in enumerate(spans.run_hashes(parts)):
            assert end - k >= spans.RUN and sum(len(p[2]) for p in parts[k:end]) >= spans.WORDS
            if h in seen or (i is not None and first[h] < i):
                drop[k:end] = [True] * (end - k)
            seen.add(h)
        text = b"".join(b[x:y] for (x, y, _), d in zip(parts, drop, strict=True) if not d)
        out.append((i, None if t is None else (text.rstrip(b" \t\n\x0b\x0c\r") if any(drop) else text).decode()))
    return out


def test_drop_repeats(docs, empty, rows):
    got = spans.drop_repeats(docs)
    assert got.columns[: len(docs.columns)] == docs.columns
    out = got.collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(brute_repeats(rows))
    ten = next(r for r in out if r.doc_id == 10)
    assert "quick brown fox" not in ten.text and ten.text.startswith("Some other opening") and ten.n_removed == 1 and ten.score == 0.5
    assert spans.drop_repeats(empty).count() == 0


def test_passages_in_documents_of_the_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, None) for r in d.collect()]
    assert Counter((r.doc_id, r.text) for r in spans.drop_repeats(d).collect()) == Counter(brute_repeats(rows))


def test_a_long_sentence_without_marks_is_found_anywhere(spark):
    words = " ".join(f"word{k * 7 % 101}x{k}" for k in range(70))
    d = spark.createDataFrame([(1, f"Intro one two three {words} closing part."), (2, f"Another start {words} different end entirely")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in spans.drop_repeats(d).collect()}
    assert out[1].count("word") == 70 and out[2].count("word") < 25


# ------------------------------------------------------------------ quality


def plain_statistics(text):
    b = text.encode()
    words = b.split()
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    n = Counter(windows)
    hit = {j for k, w in enumerate(windows) if n[w] > 1 for j in range(k, k + 8)}
    lines = [x for x in b.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), sum(lines[k] in lines[:k] for k in range(len(lines))), len(hit)


def test_statistics(spark, rows):
    texts = [t or "" for _, t, _ in rows if t is None or len(t) < 20_000] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150).collect()]
    for t in texts:
        assert quality.statistics(t.encode())[:5] == plain_statistics(t)


def test_ranked_windows_equal_counted_ones(monkeypatch):
    rng = np.random.default_rng(0)
    cases = [[b"%d" % k for k in rng.integers(0, m, n)] for n in (7, 8, 9, 40, 400) for m in (1, 2, 3, 50)]
    counted = [quality.repeat_words(c) for c in cases]
    monkeypatch.setattr(quality, "RANKED_FROM", 0)
    assert [quality.repeat_words(c) for c in cases] == counted


def test_assess(docs, empty, rows, labels):
    got = quality.assess(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        words = r.n_words
        assert r.base_failed == (words < 20 or 100 * r.n_repeat_words > 30 * words)
        assert not (r.kept and r.base_failed) and 0 <= r.score <= 1
    assert quality.assess(empty, labels).count() == 0
    assert quality.assess(docs, labels.limit(0)).where("not base_failed and not kept").count() == 0


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    x[:10] += 12
    s = quality.Forest(x).score(x)
    assert s[:10].min() > np.quantile(s[10:], 0.99)


def test_quality_verdicts_agree_with_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.assess(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").select("quality", "kept").collect()
    good = [r.kept for r in got if r.quality == 1]
    bad = [r.kept for r in got if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.1


def test_quality_verdicts_on_held_out_labels(spark):
    """Statistics and threshold chosen on two thirds of the labels, judged by the rest."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.assess(spark.read.parquet(f"{d}/documents.parquet"), labels.where("doc_id % 3 != 0")).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    passed = [r for r in got if not r.base_failed]
    bad, good = ([r.kept for r in passed if r.quality == k] for k in (0, 1))
    assert len(bad) > 50 and np.mean(bad) < 0.1 and np.mean(good) > 0.98
    assert np.mean([r.kept for r in got if r.quality == 0]) < 0.06


def test_best_threshold():
    bins = [(10, 1, 90), (20, 1, 9), (30, 0, 1), (40, 0, 9), (40, 1, 1)]
    assert quality.best_threshold(bins, 0.01) == 30 / quality.BINS  # all bad rows for 1 % of good ones
    assert quality.best_threshold([(10, 1, 98), (20, 1, 1), (30, 1, 1)], 0.011) == 30 / quality.BINS
    assert quality.best_threshold([(10, 1, 50), (10, 0, 50)], 0.01) == 11 / quality.BINS  # nothing to be told apart
    assert quality.best_threshold([(10, 0, 5)], 0.01) is None and quality.best_threshold([], 0.01) is None


def test_telling_statistics():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(size=(1000, 3)), rng.normal(size=(100, 3))
    bad[:20, 1] += 9
    assert quality.telling(good, bad).tolist() == [1]
    assert quality.telling(good, bad[:0]).tolist() == [0, 1, 2]


# ------------------------------------------------------------------ toxicity


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    got = toxicity.rate_toxicity(docs, labels.where("doc_id % 3 != 0")).join(labels.withColumnRenamed("toxic", "truth"), "doc_id").where("doc_id % 3 = 0").collect()
    truth, hit = np.array([r.truth for r in got]), np.array([r.toxic for r in got])
    assert hit[truth == 1].mean() > 0.9 and hit[truth == 0].mean() < 0.015


def test_severity_equals_a_plain_reading(spark):
    """Severities from the fitted weights by the definition, one document and one feature at a time."""
    d = "/root/testdata/sf0.01"
    labels, df = spark.read.parquet(f"{d}/labels.parquet"), spark.read.parquet(f"{d}/documents.parquet")
    m = toxicity.fit(df, labels)
    got = {r.doc_id: r for r in toxicity.rate_toxicity(df, labels).collect()}
    for r in df.collect():
        words = [toxicity._EDGES.sub("", w) for w in (r.text or "").lower().split()]
        z = 0.0
        for feature, k in m.index.items():
            stem = feature.rstrip("*")
            n = sum(w == feature if feature[-1] != "*" else w.startswith(stem) and len(w) > len(stem) for w in words if w[: len(stem)] == stem)
            z += m.ordinal.w[k] * np.log(1 + 100 * n / max(1, len(words)))
        p = [1 / (1 + np.exp(-(z - t))) if r.text else 0.0 for t in m.ordinal.thresholds]
        assert np.isclose(got[r.doc_id].severity, sum(p)) and np.isclose(got[r.doc_id].p_toxic, p[0])
        assert got[r.doc_id].toxic == (got[r.doc_id].p_toxic >= m.threshold)


def test_severity_is_no_length(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    texts = {r.doc_id: r.text for r in docs.collect()}
    m = toxicity.fit(spark.read.parquet(f"{d}/documents.parquet"), labels)
    severity = m.severity([*texts.values()])[0]
    rank = lambda v: np.argsort(np.argsort(v))
    length = np.array([len(t.split()) for t in texts.values()])
    told = np.array([sum(c for w, c in toxicity.words_in(t).items() if w in m.index) for t in texts.values()])
    on = told > 0
    assert np.corrcoef(rank(severity[on]), rank(length[on]))[0, 1] < 0.2
    assert np.corrcoef(rank(severity[on]), rank((told / length)[on]))[0, 1] > 0.6


def test_ordinal_gradients_and_order():
    rng = np.random.default_rng(1)
    x = rng.random(600) * 4
    grade = np.clip((x + rng.normal(0, 0.3, 600)).astype(int), 0, 3)
    o = toxicity.Ordinal(1, 3).fit(np.arange(600), np.zeros(600, int), x, grade, steps=800)
    p = o.above(x * o.w[0])
    assert (np.diff(o.thresholds) > 0).all() and np.corrcoef(p.sum(axis=1), grade)[0, 1] > 0.9


def test_toxicity_edge_cases(docs, empty, rows, labels):
    got = toxicity.rate_toxicity(docs, labels).collect()
    assert len(got) == len(rows) and not any(r.toxic for r in got if r.doc_id in (3, 4))
    assert toxicity.rate_toxicity(empty, labels).count() == 0
    none = toxicity.rate_toxicity(docs, labels.limit(0)).collect()
    assert not any(r.toxic for r in none) and all(r.severity == 0 for r in none)
    kept = toxicity.rate_toxicity(docs, labels.limit(0), keep=True)
    assert kept.columns == docs.columns and kept.count() == len(rows)


# ------------------------------------------------------------------ language model


def test_gradients():
    rng = np.random.default_rng(0)
    m = gru.GRU(2, hidden=4)
    m.p = m.p.astype(np.float64)
    line = gru.Lanes([rng.integers(0, 128, n) for n in (5, 3, 7)], 2)
    on = line.y >= 0
    start = np.zeros((2, 4))

    def loss():
        return -m.output(m.forward(line.x, start, line.keep)[0][on], line.y[on])[0].sum()

    g = gru.GRU(2, hidden=4, flat=np.zeros_like(m.p))
    grads = {k: g[k] for k in m.at}
    states, tape = m.forward(line.x, start, line.keep, taped=True)
    d = np.zeros_like(states)
    d[on] = m.output(states[on], line.y[on], grads)[1]
    m.backward(line.x, line.keep, tape, d, grads)
    for k in np.flatnonzero(np.abs(g.p) > 1e-6)[::37]:
        was = m.p[k]
        m.p[k] = was + 1e-4
        up = loss()
        m.p[k] = was - 1e-4
        down = loss()
        m.p[k] = was
        assert math.isclose((up - down) / 2e-4, g.p[k], rel_tol=1e-3, abs_tol=1e-5)


def test_probabilities_sum_to_one_and_state_is_carried():
    m = gru.GRU(2, hidden=8)
    h = np.random.default_rng(0).normal(size=(1, 8)).astype(np.float32)
    total = np.exp(m.output(np.repeat(h, 128, axis=0), np.arange(128))[0]).sum()
    assert math.isclose(total, 1, rel_tol=1e-4)
    docs = [np.random.default_rng(k).integers(0, 128, 70 + 9 * k).astype(np.int32) for k in range(7)]
    alone = [gru.score(m, [d], lanes=1, window=1000)[0] for d in docs]
    assert np.allclose(gru.score(m, docs, lanes=3, window=5), alone, rtol=1e-4)


def test_scores(docs, empty, rows):
    got = lm.score_documents(docs, head=8, classes=1).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter()
    for i, t, _ in rows:
        if not held(i):
            counts.update([*(t or "").encode().lower().split(), b""])
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for i, t, _ in rows:
        words = [*(t or "").encode().lower().split(), b""]
        want[i, held(i), len(words), sum(counts[w] > 0 for w in words), total, round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words), 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm.score_documents(empty).count() == 0


def test_network_beats_unigrams_on_held_out_documents(spark):
    got = lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").selectExpr("sum(score) / sum(n_tokens)", "sum(base_score) / sum(n_tokens)").first()
    assert got[0] > got[1] + 0.1


def test_groups_in_sql_and_python_agree(spark):
    words = ["a", "b.", "c,", "é", "é.", "ü,", "...", ",", "Σ.,"]
    got = spark.createDataFrame([(w,) for w in words], "word string").select("word", lm.group_column().alias("g")).collect()
    assert [r.g for r in got] == [lm.group_of(r.word.encode()) for r in got]


@pytest.mark.parametrize("text,want", [(PASSAGE, 4)])
def test_passage_has_sentences(text, want):
    assert len(spans.sentences(text.encode())) == want

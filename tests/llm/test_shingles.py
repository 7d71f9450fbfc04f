"""The pipeline's near-duplicate stage against brute-force Jaccard similarities."""

import random

import corpus_pipeline
import numpy as np
import pytest

from polytrace.llm import shingles, simhash


def brute(rows):
    """The ids that stay: of each component of pairs with a Jaccard similarity of 4/5 or more the smallest."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return {i for i, r in root.items() if i == r}


def made():
    """Texts with copies, with words replaced one by one, with a line common to all, and chains of near-copies."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(4000)}"
    line, rows = [word() for _ in range(30)], [(0, None), (1, ""), (2, "one two"), (3, "One  two")]
    for _ in range(25):
        text = [word() for _ in range(rng.randrange(20, 150))] + line * rng.randrange(2)
        for _ in range(rng.randrange(1, 8)):
            rows.append((len(rows), " ".join(text)))
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = word()
    return rows


def test_stage_equals_brute_force_jaccard(spark):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()]
    assert sorted(got) == sorted(brute(rows))


def test_stage_on_a_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == sorted(brute(rows))


def test_awkward_rows(docs, empty):
    got = shingles.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 1, 3, 6, 7, 8, 9, 10, 11, 12]
    assert shingles.keep_one(empty).count() == 0


def test_prefixes_and_fingerprints_drop_no_link():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 2500))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * rng.uniform(0.8, 1))], rng.integers(0, 1 << 63, int(n * rng.uniform(0, 0.2)), dtype=np.uint64)]))
        hot = np.sort(rng.choice(a, len(a) // 2, replace=False).view(np.int64))
        count = rng.integers(2, 9, len(hot))
        if shingles.linked(a, b):
            assert np.intersect1d(shingles.prefix(a, hot, count), shingles.prefix(b, hot, count)).size
            assert shingles.forest(prints_of([a, b])) == [(0, 1)]


def prints_of(sets):
    each = [shingles.prints_of(x) for x in sets]
    rows = [shingles.print_rows([p[k] for p in each], bits) for k, bits in enumerate((*shingles.PARITIES, shingles.BITS))]
    return shingles.Prints(np.array([len(x) for x in sets]), rows)


def test_bit_sliced_comparison_equals_a_plain_one():
    """A group of many sets, small and large ones, some near to others: the vertical comparison keeps what distances say."""
    rng = np.random.default_rng(5)
    draw = lambda n: np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    sets = []
    for n in (60, 300, 530, 630, 900, 1300, 1590, 3000):
        base = draw(n)
        sets += [np.unique(np.concatenate([base[: int(n * rng.uniform(0.7, 1))], draw(int(n * rng.uniform(0, 0.3)))])) for _ in range(20)] + [draw(n) for _ in range(10)]
    of, every = prints_of(sets), np.arange(len(sets))
    assert of.planes is not None
    for q in range(len(sets)):
        want = []
        for k, x in enumerate(sets):
            a, b = len(sets[q]), len(x)
            kind = int(max(a, b) > shingles.SMALL) + int(max(a, b) > shingles.MIDDLE)
            d = int(np.bitwise_count(of.rows[kind][q] ^ of.rows[kind][k]).sum())
            if 5 * b >= 4 * a and 4 * b <= 5 * a and (9 * d <= a + b if kind < 2 else d <= shingles.RADIUS):
                want.append(k)
        assert sorted(of.near(q, every).tolist()) == want
        assert {k for k, x in enumerate(sets) if shingles.linked(sets[q], x)} <= set(want)


def test_long_unrelated_texts_are_told_apart():
    rng = np.random.default_rng(6)
    shared = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 5000, dtype=np.uint64)])) for _ in range(40)]
    assert shingles.forest(prints_of(sets)) == []


def test_needed_filter(spark):
    keys = np.random.default_rng(7).integers(-(1 << 63), 1 << 63, 5000)
    bits = shingles.filter_of(spark.createDataFrame([(int(k),) for k in keys], "_key long"), len(keys))
    on = lambda k: bits[(at := shingles.positions(k, 8 * len(bits))) >> 3] >> (at & 7).astype(np.uint8) & 1
    assert on(keys).all() and on(keys + 12345).mean() < 0.1


def test_clashing_names(spark):
    rows = [(1, "a b c d e f g", 1, 2, "x", 3), (2, "a b c d e f g", 1, 2, "y", 3), (3, "h i j", 1, 2, "z", 3), (3, "h i j", 1, 2, "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_id int, _key int, key string, least int")
    got = shingles.keep_one(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]
    for part in (df, df.where("doc_id < 3")):
        assert sorted(r.doc_id for r in simhash.keep_one(part).collect()) == sorted({r.doc_id for r in part.collect()} - {2})


@pytest.mark.parametrize("ok", [True, False])
def test_groups_end_where_a_group_ends(ok):
    import pyarrow as pa

    h = [1, 1, 2, 2, 2, 3] if ok else [5] * 6
    batches = [pa.RecordBatch.from_arrays([pa.array(h[a : a + 2])], names=["h"]) for a in (0, 2, 4)]
    tables = [set(t.column("h").to_pylist()) for t in shingles.whole_groups(batches)]
    assert sum(map(len, tables)) == len(set(h))


def test_near_misses_are_not_written_out_in_pairs(spark, monkeypatch):
    """Texts of which any two nearly link, and some pairs that do: no table grows with the square of the group."""
    base, rows = [f"b{k}" for k in range(500)], []
    for i in range(120):
        text = list(base)
        for k in range(12):
            text[20 + 40 * k] = f"x{i}-{k}"
        rows.append((i, " ".join(text)))
        if i % 12 == 5:
            text[7] = "other"
            rows.append((1000 - i, " ".join(text)))
    sizes, stored = {}, shingles.common.stored

    def counting(df, name):
        out = stored(df, name)
        sizes[name] = max(out.count(), sizes.get(name, 0))
        return out

    monkeypatch.setattr(shingles.common, "stored", counting)
    monkeypatch.setattr(shingles, "SPREAD_SETS", 40, raising=False)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [r.doc_id for r in shingles.keep_one(df).collect()]
    assert sorted(got) == sorted(brute(rows)) == list(range(120))
    met = sizes.pop("met")  # dealt out by shingle: 101 times at most for each text
    assert met <= 101 * len(rows) and max(sizes.values()) <= 8 * len(rows), sizes


def test_tiles_find_every_link():
    """Counts of shared shingles against plain comparisons, over chunks of any cut."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 108, replace=False), rng.integers(0, 1 << 63, 4, dtype=np.uint64)])) for _ in range(60)]
    roots = rng.integers(0, 50, len(sets))
    for parts in (1, 3):
        label, chunk = roots.copy(), np.arange(len(sets)) % parts
        want = roots.copy()
        for i in range(parts):
            for j in range(i, parts):
                for a, b in shingles.joined(sets, roots, chunk == i, chunk == j):
                    assert shingles.linked(sets[a], sets[b]) and roots[a] != roots[b]
                    label[label == label[b]] = label[a]
        for a in range(len(sets)):
            for b in range(a):
                if shingles.linked(sets[a], sets[b]):
                    want[want == want[b]] = want[a]
        assert 1 < len(set(want.tolist())) < len(set(roots.tolist()))
        assert len(set(zip(label.tolist(), want.tolist(), strict=True))) == len(set(label.tolist())) == len(set(want.tolist()))


def test_long_texts_whose_simhashes_are_far_apart_still_link(spark):
    """Two texts of over 1,600 shingles, 4/5 of them shared, whose other words are chosen to push the bits of a SimHash apart."""
    rng = random.Random(9)
    stem = [f"s{rng.randrange(10**6)}" for _ in range(1680)]

    def bits(own):
        """+1 or -1 for each shingle and bit of the SimHash."""
        return np.array([np.unpackbits(np.frombuffer(shingles.majority(own[k : k + 1]), np.uint8)) for k in range(len(own))]).astype(int) * 2 - 1

    def hashes(words):
        return np.array([shingles.shingle_set(" ".join(words[k : k + 5]).encode())[0] for k in range(len(words) - 4)], np.uint64)

    total = bits(hashes(stem)).sum(axis=0)
    easy = np.argsort(np.abs(total))[:500]

    def tail(sign):
        words = stem[-4:]
        for _ in range(180):
            choice = [f"t{rng.randrange(10**6)}" for _ in range(60)]
            push = bits(np.array([shingles.shingle_set(" ".join([*words[-4:], w]).encode())[0] for w in choice], np.uint64))
            words.append(choice[int((sign * push[:, easy]).sum(axis=1).argmax())])
        return words[4:]

    texts = [" ".join(stem + tail(sign)) for sign in (1, -1)]
    a, b = (shingles.shingle_set(t.encode()) for t in texts)
    far = np.unpackbits(np.frombuffer(shingles.majority(a), np.uint8) ^ np.frombuffer(shingles.majority(b), np.uint8)).sum()
    assert shingles.linked(a, b) and far > shingles.RADIUS
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in shingles.keep_one(df).collect()] == [0]


def test_stage_on_long_texts(spark):
    """Texts of 1,000 to 13,000 shingles, near to others and around the sizes at which sets are cut, against brute force."""
    rng, rows = random.Random(10), []
    for n in (1270, 1290, 1590, 1610, 2600, 3190, 3210, 6390, 6410, 12900):
        text = [f"w{rng.randrange(10**5)}" for _ in range(n)]
        for part in (0, 0.05, 0.1, 0.19, 0.21, 0.3):
            rows.append((len(rows), " ".join(text[int(n * part) :])))  # 0.2 is where links end
        more = list(text)
        for k in range(0, n, 41):
            more[k] = f"x{k}"
        rows.append((len(rows), " ".join(more)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in shingles.keep_one(df).collect()) == sorted(brute(rows))


def test_a_piece_of_linked_sets_links():
    rng = np.random.default_rng(12)
    for n in (1281, 1600, 1601, 2560, 2561, 3200, 3201, 9000):
        for share in (0.79, 0.801, 0.9):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            for b in (a[rng.random(len(a)) < share], np.unique(np.concatenate([a[rng.random(len(a)) < (1 + share) / 2], rng.integers(0, 1 << 63, n // 12, dtype=np.uint64) * np.uint64(2)]))):
                one, two = dict(shingles.pieces(a)), dict(shingles.pieces(b))
                assert all(sum(map(len, (x for k, x in cut.items() if k.bit_length() == level))) == len(own) for cut, own in ((one, a), (two, b)) for level in {k.bit_length() for k in cut})
                if shingles.linked(a, b):
                    like = [(one[k], two[k]) for k in one.keys() & two.keys() if shingles.linked(one[k], two[k])]
                    each = [[shingles.parities_of(x) for x in pair] for pair in like]
                    assert any(shingles.forest(shingles.Prints(np.array([len(x) for x in pair]), [shingles.print_rows([p[k] for p in prints], bits) for k, bits in enumerate(shingles.PARITIES)])) for pair, prints in zip(like, each, strict=True))

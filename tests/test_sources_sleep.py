"""Sleep recorders' files, windows read from files, and files stored from tasks."""

import numpy as np
import pytest

from polytrace.plans.script import compile_script
from polytrace.sources import files, formats, formats_lab, formats_sleep


def plain_words(data, n):
    """The stream read byte by byte."""
    out, at, last = [], 0, [0] * n
    while at < len(data):
        point = []
        for c in range(n):
            if at >= len(data):
                return out
            b = data[at]
            if b & 0x80 or not out:
                if at + 1 >= len(data):
                    return out
                w = b << 8 | data[at + 1]
                v = w & 0x3FFF if not w & 0x4000 else (w | 0x8000) - 0x10000
                at += 2
            else:
                v = last[c] + (b - 0x80 if b & 0x40 else b)
                at += 1
            point.append(v)
        out.append(point)
        last = point
    return out


def test_words_and_differences():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        x = np.clip(np.cumsum(rng.integers(-90, 91, (300, n)), axis=0), -16384, 16383)
        data = formats_sleep.coded_bytes(x)
        assert (formats_sleep.coded_values(np.frombuffer(data, np.uint8), n) == x).all()
        assert plain_words(data, n) == x.tolist()
        for cut in range(1, 12):
            got = formats_sleep.coded_values(np.frombuffer(data[:-cut], np.uint8), n)
            assert got.tolist() == plain_words(data[:-cut], n)


def test_co_files():
    r = formats.Recording(100.0, ["Cz", "E O G"], np.array([np.sin(np.arange(500) / 9) * 80, np.arange(500) - 250.0]))
    parts = formats_sleep.encode_co(r)
    back = formats_sleep.decode_co(parts[".co"], parts[".coa"])
    assert back.channels == ["Cz", "E_O_G"] and back.sfreq == 100.0 and np.abs(back.values - r.values).max() <= 0.0501
    assert formats_sleep.decode_co(parts[".co"]).values.shape == (2, 500)
    with pytest.raises(ValueError):
        formats_sleep.encode_co(formats.Recording(100.0, ["a"], np.array([[1e6]])))


def test_difference_files():
    r = formats.Recording(128.0, ["C3", "C4"], np.array([np.round(np.sin(np.arange(600) / 20) * 40), np.round(np.cos(np.arange(600) / 30) * 25)]))
    parts = formats_sleep.encode_differences(r)
    back = formats_sleep.decode_differences(parts[".dsc"], parts[".eeg"])
    assert back.channels == ["C3", "C4"] and back.sfreq == 128.0 and np.abs(back.values - r.values)[:, 40:].max() <= 3
    steps = [b >> 2 if b & 3 == 3 else (b & ~3) << (2 * (b & 3)) for b in np.frombuffer(parts[".eeg"], np.int8).tolist()]
    assert (np.cumsum(np.array(steps).reshape(-1, 2), axis=0).T == back.values).all()


def test_field_files():
    r = formats.Recording(250.0, ["Fp1", "Fp2", "Resp"], np.round(np.random.default_rng(2).normal(size=(3, 90)) * 50, 2))
    back = formats_sleep.decode_fields(formats_sleep.encode_fields(r))
    assert back.channels == r.channels and back.sfreq == 250.0 and np.allclose(back.values, r.values, atol=1e-9)


def test_volt_files():
    r = formats.Recording(2000.0, ["M. tib.", "", "x"], np.random.default_rng(4).normal(size=(3, 70)))
    back = formats_lab.decode_volts(formats_lab.encode_volts(r))
    assert back.channels == ["M. tib.", "2", "x"] and back.sfreq == 2000.0 and np.allclose(back.values, r.values, rtol=1e-6)
    assert formats_lab.decode_volts(formats_lab.encode_volts(r)[:-5]).values.shape == (3, 69)


@pytest.mark.parametrize("seconds", [0, 1, 128, 129, 300])
def test_block_files(seconds):
    r = formats.Recording(5.0, ["1", "2"], np.arange(2 * 5 * seconds, dtype=float).reshape(2, -1))
    back = formats_lab.decode_blocks(formats_lab.encode_blocks(r))
    assert back.values.shape == (2 if seconds else 0, 5 * seconds) and back.values.tolist() == (r.values.tolist() if seconds else [])


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stored"))
    rows = [("a/b.x", 100.0, c, f"C{c}", p, float(p * (c + 1))) for c in range(2) for p in range(100)]
    df = spark.createDataFrame(rows, "recording string, sfreq double, channel_idx int, channel string, pos long, value double")
    marks = spark.createDataFrame([("a/b.x", 10, 1), ("a/b.x", 30, 2), ("a/b.x", 50, 1), ("a/b.x", 98, 1)], "recording string, position long, code int")
    assert files.write_recordings(df, folder, "brainvision", marks) == ["b.eeg", "b.vhdr", "b.vmrk"]
    assert files.write_recordings(df, folder, "brainvision", marks) == ["b.eeg", "b.vhdr", "b.vmrk"]  # again: the same files
    return folder


def test_windows_from_files(spark, stored):
    w = files.read_windows(spark, stored, "brainvision", "20ms", "50ms", codes=[1])
    got = {(r.epoch_id, r.channel, r.point): r.value for r in w.collect()}
    assert len(got) == 2 * 2 * 7 and got[0, "C0", 0] == 8 and got[1, "C1", 6] == 2 * 54  # the trigger at 98 has no room
    assert files.read_windows(spark, stored, "brainvision", 2, 5, codes=[1], first=2, most=1).select("epoch_id").distinct().collect()[0][0] == 0
    c = files.read_windows(spark, stored, "brainvision", 0, 30, continuous=True, first=2, most=1)
    assert sorted(r.value for r in c.where("channel = 'C0'").collect()) == list(range(30, 60))
    t = files.transferred(spark, stored, "brainvision", 5, 25, codes=[1])
    assert sorted((r.epoch_no, r.position, r.code) for r in t.collect()) == [(1, 5, 1), (1, 25, 2), (2, 5, 1)]


def test_trigger_file(spark, stored, tmp_path):
    (tmp_path / "x.trg").write_text("20 1\n400ms 3\n0 0\n")
    w = files.read_windows(spark, stored, "brainvision", 0, 10, trigger_file=str(tmp_path / "x.trg"))
    assert sorted({(r.epoch_id, r.condition) for r in w.collect()}) == [(0, 1), (1, 3)]


def test_scripts_name_readers(spark, stored):
    s = f"read_brainvision -t 1 {stored} 2 5\nset nrofaverages 3\nassert condition == 1\nset_channelposition =EEG\ntrim -a 0 3\nnull_sink"
    out = compile_script(s, {}, spark=spark).frame()
    assert out.count() == 2 * 2 and {r.nrofaverages for r in out.collect()} == {3} and {r.condition for r in out.collect()} == {1}
    two = compile_script(f"read_brainvision -t 1 {stored} 2 5\nread_brainvision -t 2 {stored} 2 5\nnull_sink", {}, spark=spark).frame()
    assert two.select("epoch_id").distinct().count() == 3
    for bad in (f"read_brainvision -q {stored} 2 5\nnull_sink", f"read_brainvision {stored}\nnull_sink", "read_nothing x 1 2\nnull_sink", f"average\nread_brainvision {stored} 2 5"):
        with pytest.raises(ValueError):
            compile_script(bad, {}, spark=spark)
    with pytest.raises(ValueError):
        compile_script(f"read_brainvision {stored} 2 5\nnull_sink", {})


def test_running_sums_do_not_depend_on_gaps(spark):
    from pyspark.sql import functions as F

    from polytrace.epochs import running

    ids = [*range(3000), 10**12, 10**12 + 7]
    df = spark.createDataFrame([(i, 1.0 + i % 3) for i in ids], "epoch_id long, v double").repartition(5)
    got = {r.epoch_id: r.s for r in running(df, "epoch_id", F.col("v"), "s").collect()}
    total = 0.0
    for i in ids:
        assert got[i] == total
        total += 1.0 + i % 3
    assert running(df.limit(0), "epoch_id", F.col("v"), "s").count() == 0


@pytest.mark.parametrize("size,step", [(1, 1), (3, 1), (4, 1), (5, 2), (7, 2.5), (1000, 1)])
def test_convolution_equals_plain_sums(size, step):
    from polytrace.operators.trace import convolved

    rng = np.random.default_rng(3)
    x, t = rng.normal(size=60), rng.normal(size=size)
    cut = t[: len(x)]
    right = (len(cut) - 1) // 2 + 1
    left = len(cut) - right
    got = convolved(x, t, step)
    assert len(got) == int(60 / step)
    for k, v in enumerate(got):
        m = int(np.float32(k) * np.float32(step))
        first, last = max(m - left, 0), min(m + right - 1, 59)
        want = sum(x[i] * cut[i - first] for i in range(first, last + 1) if i - first < len(cut)) / len(cut)
        assert np.isclose(v, want)


def test_overlaps_of_very_different_lengths(spark):
    import random

    from polytrace.operators import joins

    rng = random.Random(6)
    make = lambda n: [(rng.randrange(2), float(s := rng.uniform(-50, 500)), float(s + rng.choice((0.5, 3, 40, 900, 1e9)) * rng.random())) for _ in range(n)]
    a, b = make(60), make(80)
    frames = [spark.createDataFrame(x, "rec int, start double, end double") for x in (a, b)]
    got = sorted((r.rec, r.a_start, r.a_end, r.b_start, r.b_end) for r in joins.overlapping(*frames, "rec", 2.0).collect())
    assert got == sorted((x[0], x[1], x[2], y[1], y[2]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])

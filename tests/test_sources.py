"""File formats and generated sources."""

import math

import numpy as np
import pytest

from polytrace.sources import files, formats, simulate
from polytrace.streaming import run


def recording(n=3, points=700, triggers=()):
    t = np.arange(points) / 100
    return formats.Recording(100.0, [f"C{k}" for k in range(n)], np.array([np.sin(t * (k + 1)) * 50 * (k + 1) for k in range(n)]), list(triggers))


@pytest.mark.parametrize("kind", ["float32", "float64", "int16", "int32", "string"])
@pytest.mark.parametrize("points_fastest", [False, True])
def test_generic(kind, points_fastest):
    if kind == "string" and points_fastest:
        pytest.skip("text has one line per point")
    r = recording()
    options = {} if kind == "string" else {"points_fastest": points_fastest}
    back = formats.decode_generic(formats.encode_generic(r, kind, **options), kind, 3, 100.0, **options)
    assert np.allclose(back.values, r.values, atol=0.51 if "int" in kind else 1e-4)


def test_generic_drops_part_of_a_point():
    assert formats.decode_generic(b"\x01\x00\x02\x00\x03\x00", "int16", 2).values.shape == (2, 1)


def test_edf():
    r = recording(points=650)
    back = formats.decode_edf(formats.encode_edf(r))
    assert back.channels == r.channels and back.sfreq == 100.0 and back.values.shape == (3, 700)
    assert np.abs(back.values[:, :650] - r.values).max() < 0.01 and (back.values[:, 650:] - r.values[:, -1:]).max() < 0.01


def test_brainvision():
    r = recording(triggers=[(5, 3, None), (90, 12, None)])
    parts = formats.encode_brainvision(r, "x")
    back = formats.decode_brainvision(parts[".vhdr"], parts[".eeg"], parts[".vmrk"])
    assert np.allclose(back.values, r.values, atol=1e-4) and back.sfreq == 100.0 and [t[:2] for t in back.triggers] == [(5, 3), (90, 12)]


def test_simple_binary():
    r = recording(triggers=[(5, 3, None), (90, 12, None), (95, 3, None)])
    back = formats.decode_simple_binary(formats.encode_simple_binary(r))
    assert np.allclose(back.values, r.values, atol=1e-3) and [(p, d) for p, _, d in back.triggers] == [(5, "0003"), (90, "0012"), (95, "0003")]


@pytest.mark.parametrize("size", [1, 2, 4])
def test_wave(size):
    r = recording(2)
    r.values = r.values / 200
    back = formats.decode_wave(formats.encode_wave(r, size))
    assert back.sfreq == 100.0 and np.abs(back.values - r.values).max() < 2.0 ** (2 - 8 * size) + 1e-6


def test_cnt():
    r = recording(triggers=[(5, 3, None), (90, 12, None), (95, -2, None)])
    back = formats.decode_cnt(formats.encode_cnt(r))
    assert back.channels == r.channels and back.sfreq == 100.0 and np.abs(back.values - r.values).max() < 0.01
    assert [t[:2] for t in back.triggers] == [(5, 3), (90, 12), (95, -2)]


def test_parameter_pair(spark, tmp_path):
    r = recording(2, 40)
    for suffix, content in formats.encode_parameter_pair(r).items():
        (tmp_path / f"x{suffix}").write_bytes(content)
    got = files.read_parameter_pairs(spark, str(tmp_path)).where("channel = 'C1'").orderBy("pos").collect()
    assert np.allclose([g.value for g in got], r.values[1], atol=1e-4) and got[0].sfreq == 100.0


def test_text_epochs():
    rng = np.random.default_rng(0)
    make = lambda n, p, i: {"sfreq": 100.0, "comment": "test", "x_label": "Lat[ms]", "channels": [f"A{k}" for k in range(n)], "positions": rng.random((n, 3)).round(4), "x": np.arange(p) * 10.0, "values": rng.normal(size=(n, p, i))}
    epochs = [make(3, 4, 1), make(2, 5, 2)]
    back = formats.decode_text_epochs(formats.encode_text_epochs(epochs))
    assert len(back) == 2
    for a, b in zip(epochs, back, strict=True):
        assert a["channels"] == b["channels"] and np.allclose(a["values"], b["values"]) and np.allclose(a["positions"], b["positions"]) and b["sfreq"] == 100.0


@pytest.mark.parametrize("kind", ["f4", "f8"])
def test_binary_epochs(spark, tmp_path, kind):
    rng = np.random.default_rng(0)
    epochs = [{"sfreq": 250.0, "comment": "two words", "z_label": "Nr", "z_value": 4.5, "x_label": "Lat[ms]", "channels": [f"A{k}" for k in range(n)], "positions": rng.random((n, 3)), "x": np.arange(5) * 4.0, "values": rng.normal(size=(n, 5, 2))} for n in (3, 2)]
    data = formats.encode_binary_epochs(epochs, kind)
    back = formats.decode_epochs(data)
    for a, b in zip(epochs, back, strict=True):
        assert a["channels"] == b["channels"] and np.allclose(a["values"], b["values"], atol=1e-6) and (b["comment"], b["z_label"], b["z_value"]) == ("two words", "Nr", 4.5)
    (tmp_path / "x.asc").write_bytes(data)
    (tmp_path / "y.asc").write_bytes(formats.encode_text_epochs(epochs))
    assert files.read_epochs(spark, str(tmp_path)).groupBy("recording").count().collect()[0]["count"] == 50


def test_trigger_text():
    assert formats.decode_triggers("# head\n10 3 first one\n0.5s\n20ms 4\n99 0\n100 1", 100.0) == [(10, 3, "first one"), (50, 1, None), (2, 4, None)]
    with pytest.raises(ValueError):
        formats.decode_triggers("x 1", 100.0)


def test_files_as_tables(spark, tmp_path):
    r = recording(points=300)
    for name in ("a", "b"):
        (tmp_path / f"{name}.edf").write_bytes(formats.encode_edf(r))
        for suffix, content in formats.encode_brainvision(recording(points=50, triggers=[(1, 2, None)]), name).items():
            (tmp_path / f"{name}{suffix}").write_bytes(content)
    df = files.read_recordings(spark, str(tmp_path), "edf", channels=["C1"])
    assert df.count() == 600 and df.select("channel").distinct().collect()[0][0] == "C1"
    assert files.read_brainvision(spark, str(tmp_path)).groupBy("recording").count().collect()[0]["count"] == 150
    again = files.encoded(files.read_recordings(spark, str(tmp_path), "edf"), "wave").collect()
    assert len(again) == 2 and formats.decode_wave(bytes(again[0].content)).values.shape == (3, 300)
    files.write_table(df, str(tmp_path / "table"), partition_by=["channel"])
    assert spark.read.parquet(str(tmp_path / "table")).count() == 600


def test_generated_sources(spark):
    z = simulate.null_source(spark, 10.0, 3, 2, 4, 6, items=2)
    assert z.count() == 3 * 2 * 10 * 2 and z.agg({"value": "max"}).first()[0] == 0
    d = simulate.dip_simulate(spark, 100.0, 2, 10, 10)
    assert d.count() == 2 * 20 * 37 and math.isfinite(d.agg({"value": "sum"}).first()[0])


def test_stream_keeps_state_between_batches(spark, tmp_path):
    from polytrace.streaming import stateful

    for k in range(3):
        spark.createDataFrame([("A", 3 * k + i, float((3 * k + i) ** 2)) for i in range(3)], "channel string, pos long, value double").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    schema = "channel string, pos long, value double"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = {r.pos: r.value for r in run.finished(stateful.differentiate(stream())).collect()}
    assert got == {k: float(k * k - (k - 1) ** 2 if k else 0) for k in range(9)}
    total = {r.pos: r.value for r in run.finished(stateful.integrate(stream())).collect()}
    assert total[8] == sum(k * k for k in range(9))
    assert run.completed(stateful.running_average(stream(), ["channel"])).first().n == 9


def test_a_stream_s_rows_leave_in_parts():
    """A channel's rows of a batch come out in frames of bounded size, in order, with the state of the last."""
    import pandas as pd

    from polytrace.streaming import stateful

    class State:
        exists, get = False, None

        def update(self, now):
            self.get = now

    n, state = 3 * stateful.ROWS + 5, State()
    rows = pd.DataFrame({"channel": "A", "pos": np.arange(n)[::-1], "value": np.arange(n, dtype=float)[::-1] ** 2})
    step = lambda s, pos, value: ((float(value[-1]),), {"pos": pos, "value": np.diff(value, prepend=s[0])})
    got = list(stateful._walk(step, (0.0,))(("A",), iter([rows[: n // 2], rows[n // 2 :]]), state))
    assert max(map(len, got)) <= stateful.ROWS and state.get == (float((n - 1) ** 2),)
    every = pd.concat(got)
    assert (every["pos"].to_numpy() == np.arange(n)).all() and every["value"].iloc[-1] == 2 * n - 3

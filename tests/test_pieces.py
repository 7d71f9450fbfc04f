"""Files written and read in pieces hold what the encoders and decoders of whole files say."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from polytrace.sources import files, formats, formats_sleep, pieces

ENCODERS = files.ENCODERS | {k: lambda r, k=k: {"brainvision": lambda: formats.encode_brainvision(r, "nm"), "parameter_pair": lambda: formats.encode_parameter_pair(r), "words": lambda: formats_sleep.encode_co(r), "differences": lambda: formats_sleep.encode_differences(r)}[k]() for k in ("brainvision", "parameter_pair", "words", "differences")}


class Open(io.BytesIO):
    """As Arrow's open files are."""

    def read_at(self, n: int, at: int) -> bytes:
        return self.getvalue()[at : at + n]


def recording(points: int) -> formats.Recording:
    x = np.random.default_rng(points).normal(size=(3, points)) * 0.3
    return formats.Recording(128.0, ["A", "B", "C"], x, [(0, 1, None), (min(150, points - 1), 2, None), (points - 1, 1, None)])


@pytest.mark.parametrize("points", [1, 300, 17_000])
@pytest.mark.parametrize("kind", sorted(pieces.WRITERS))
def test_written_in_pieces(kind, points):
    r = recording(points)
    o = pieces.Outline(r.sfreq, r.channels, points, r.values.min(1).tolist(), r.values.max(1).tolist(), [1, 2], "nm")
    blocks = ((r.values[:, a : a + 700], [t for t in r.triggers if a <= t[0] < a + 700]) for a in range(0, points, 700))
    got: dict[str, bytes] = {}
    for suffix, content in pieces.written(kind, o, blocks):
        got[suffix] = got.get(suffix, b"") + content
    want = ENCODERS[kind](r)
    assert got == (want if isinstance(want, dict) else {files.WRITTEN[kind]: want})


@pytest.mark.parametrize("kind,options", [("generic", {"channels": 3}), *[(k, {}) for k in ("edf", "cnt", "wave", "fields", "volts", "simple_binary", "brainvision", "parameter_pair")]])
def test_ranges_decode_alone(kind, options):
    made = ENCODERS[kind](recording(1000))
    beside, data = (made[{"brainvision": ".vhdr", "parameter_pair": ".dpa"}[kind]], made[{"brainvision": ".eeg", "parameter_pair": ".cdt"}[kind]]) if isinstance(made, dict) else (b"", made)
    lay = pieces.layout(kind, data[: 1 << 15], len(data), beside, **options)
    parts = [lay.decode(data[lay.start + a * lay.unit : lay.start + min(a + 3, lay.units) * lay.unit]) for a in range(0, lay.units, 3)]
    want = files.DECODERS[kind](data, **options) if kind in files.DECODERS else files._pair(kind)[3]({files._pair(kind)[1]: beside, files._pair(kind)[2]: data})
    assert (np.concatenate([p.values for p in parts], axis=1) == want.values).all() and parts[0].channels == want.channels and lay.decode(b"").sfreq == want.sfreq
    if not beside:
        assert list(pieces.triggers(kind, Open(data), len(data), **options)) == want.triggers


@pytest.mark.parametrize("kind", ["words", "differences"])
def test_stretches_carry_on(monkeypatch, kind):
    monkeypatch.setattr(pieces, "STRETCH", 101)
    made = ENCODERS[kind](recording(1000))
    beside, data = (made[".coa"], made[".co"]) if kind == "words" else (made[".dsc"], made[".eeg"])
    want = formats_sleep.decode_co(data, beside) if kind == "words" else formats_sleep.decode_differences(beside, data)
    got = list(pieces.sequential(kind, Open(data), beside))
    assert len(got) > 5 and (np.concatenate([r.values for r in got], axis=1) == want.values).all() and got[0].channels == want.channels


def test_events_at_a_range_edge(monkeypatch):
    monkeypatch.setattr(pieces, "STRETCH", 160)
    x = formats.Recording(100.0, ["1"], np.zeros((1, 90)), [(k, 7, None) for k in (0, 19, 20, 21, 39, 40, 60, 80)])
    data = formats.encode_simple_binary(x)
    assert list(pieces.triggers("simple_binary", Open(data), len(data))) == formats.decode_simple_binary(data).triggers


@pytest.mark.parametrize("binary", [False, True])
def test_epochs_in_pieces(spark, tmp_path, binary):
    rows = [("r/one.x", e, c, f"C{c}", p, float(1000 * e + 10 * p + c)) for e in (3, 250, 255, 256, 300, 900) for c in range(2) for p in range(4)]
    df = spark.createDataFrame(rows, "recording string, epoch_id long, channel_idx int, channel string, point int, value double")
    assert files.write_epochs(df, str(tmp_path), 100.0, binary=binary) == ["one.asc"]
    data = (tmp_path / "one.asc").read_bytes()
    assert data == bytes(files.encoded_epochs(df, 100.0, binary=binary).first().content)
    got = {(r.epoch_no, r.channel, r.point): r.value for r in files.read_epochs(spark, str(tmp_path)).collect()}
    assert got == {((3, 250, 255, 256, 300, 900).index(e), n, p): v for _, e, _, n, p, v in rows}
    for one, whole in zip(formats.epochs_in(io.BytesIO(data)), formats.decode_epochs(data), strict=True):
        assert one["channels"] == whole["channels"] and (one["values"] == whole["values"]).all()


def test_recordings_of_many_blocks(spark, tmp_path):
    n = 2 * files._BLOCK + 77
    df = spark.range(2 * n).select(F.lit("x").alias("recording"), F.lit(100.0).alias("sfreq"), (F.col("id") % 2).cast("int").alias("channel_idx"), F.concat(F.lit("C"), (F.col("id") % 2).cast("string")).alias("channel"), F.floor(F.col("id") / 2).alias("pos"), F.sin("id").alias("value"))
    marks = spark.createDataFrame([("x", at, 1 + at % 2) for at in (0, files._BLOCK - 1, files._BLOCK, n - 1)] + [("none", 1, 1)], "recording string, position long, code int")
    for kind in ("edf", "cnt", "brainvision", "words", "simple_binary"):
        path = str(tmp_path / kind)
        files.write_recordings(df, path, kind, marks)
        for r in files.encoded(df, kind, marks.where("recording = 'x'")).collect():
            assert bytes(r.content) == (tmp_path / kind / ("x" + r.suffix)).read_bytes()
        got = files.samples_of(spark, path, kind)
        assert got.count() >= 2 * n and got.where("pos = 16384 and channel_idx = 1").count() == 1
        if kind in ("cnt", "brainvision"):
            assert sorted((t.position, t.code) for t in files.triggers_of(spark, path, kind).collect()) == [(0, 1), (files._BLOCK - 1, 2), (files._BLOCK, 1), (n - 1, 1 + (n - 1) % 2)]


def test_decoded_samples_are_not_broadcast(spark, tmp_path):
    """The list of files is small; what they hold is not."""
    (tmp_path / "a.edf").write_bytes(formats.encode_edf(recording(300)))
    got = files.samples_of(spark, str(tmp_path), "edf")
    other = spark.range(10**6).select(F.col("id").alias("pos"), F.lit(1).alias("one"))
    plan = other.join(got.select("pos", "value"), "pos")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan

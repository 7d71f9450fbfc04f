"""Operators on hand-made epochs: edge cases that the tables don't hold."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from polytrace.epochs import samples, traces
from polytrace.functions import channels, maths, units
from polytrace.operators import collect, elementwise, joins, paradigm, reject, shape, spectral, trace
from polytrace.plans.pipeline import Pipeline
from polytrace.plans.script import compile_script, split_scripts

NAN, INF = math.nan, math.inf


def frame(spark, epochs, names=None):
    """epochs: a list of {channel: values}."""
    rows = [(e, k, c, p, float(v)) for e, x in enumerate(epochs) for k, (c, vs) in enumerate(x.items()) for p, v in enumerate(vs)]
    return spark.createDataFrame(rows, "epoch_id long, channel_idx int, channel string, point int, value double")


def values(df, by=("epoch_id", "channel")):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (*[str(r[b]) for b in by], r.point)):
        out.setdefault(tuple(r[b] for b in by) if len(by) > 1 else r[by[0]], []).append(r.value)
    return out


def same(a, b):
    return np.allclose(a, b, equal_nan=True, rtol=1e-9, atol=1e-12)


# ------------------------------------------------------------------ functions

ODD = [NAN, INF, -INF, -0.0, 0.0, 1.0, -1.0, 2.5, 1e300]
WANT = {
    "log": [NAN, INF, NAN, -INF, -INF, 0.0, NAN, math.log(2.5), math.log(1e300)],
    "inv": [NAN, 0.0, 0.0, INF, INF, 1.0, -1.0, 0.4, 1e-300],
    "sqrt": [NAN, INF, NAN, 0.0, 0.0, 1.0, NAN, math.sqrt(2.5), 1e150],
    "abs": [NAN, INF, INF, 0.0, 0.0, 1.0, 1.0, 2.5, 1e300],
    "atanh": [NAN, NAN, NAN, 0.0, 0.0, INF, -INF, NAN, NAN],
}


@pytest.mark.parametrize("name", sorted(WANT))
def test_calc_on_odd_values(spark, name):
    got = values(elementwise.calc(frame(spark, [{"A": ODD}]), name))[0, "A"]
    assert same(got, WANT[name])


def test_rint_halves_to_even(spark):
    assert values(elementwise.calc(frame(spark, [{"A": [0.5, 1.5, 2.5, -0.5, -1.5]}]), "rint"))[0, "A"] == [0, 2, 2, 0, -2]


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
@pytest.mark.parametrize("n", range(1, 7))
def test_quantile(spark, n, q):
    s = [float(k * k) for k in range(n)]
    i1, i2 = math.floor((n - 1) * q), math.floor(n * q)
    want = (s[i1] + s[i1 if i2 >= n else i2]) / 2
    df = spark.createDataFrame([(s[::-1],)], "v array<double>").select(maths.quantile_of_sorted(F.array_sort("v"), q).alias("q"))
    assert df.first()[0] == want


def test_student():
    assert maths.student_two_sided(10, 2.228138852) == pytest.approx(0.05, abs=1e-8)
    assert maths.student_two_sided(1, 1.0) == pytest.approx(0.5)
    assert maths.student_two_sided(5, 0.0) == pytest.approx(1.0)
    assert maths.student_quantile(10, 0.05) == pytest.approx(2.228138852, abs=1e-6)
    assert math.isnan(maths.student_two_sided(0, 1.0))
    assert maths.incomplete_beta(2.0, 3.0, 0.4) == pytest.approx(0.5248, abs=1e-10)


@pytest.mark.parametrize("text,want", [("100ms", 10), ("1s", 100), ("25", 25), ("25ms", 2), ("0.5min", 3000), ("-1s", -100)])
def test_points(text, want):
    assert units.points(text, 100.0) == want


def test_units_refuse():
    assert units.fraction("10Hz", 100.0) == 0.2 and units.fraction("0.3", 100.0) == 0.3
    for bad in ("12q", "ms", "1 2"):
        with pytest.raises(ValueError):
            units.points(bad, 100.0)


def test_channel_lists():
    assert channels.names("A08-A11,EMG") == ["A08", "A09", "A10", "A11", "EMG"]
    have = ["A1", "A2", "B", "A1"]
    assert channels.select("B,A1", have) == [2, 0, 3]
    assert channels.select("!A1", have) == [1, 2] and channels.select("?X,B", have) == [2] and channels.select("ALL", have) == [0, 1, 2, 3]
    with pytest.raises(KeyError):
        channels.select("X", have)


def test_empty_selection_changes_nothing(spark):
    df = frame(spark, [{"A1": [1, 2], "A2": [3, 4]}])
    assert values(elementwise.scale_by(df, 0.0, channels="?ECG,EDA,other_unknown_channel")) == values(df)


# ------------------------------------------------------------------ traces and maps


def test_zero_divisors_count_as_one(spark):
    got = values(elementwise.scale_by(frame(spark, [{"A": [0, 0], "B": [0, 2]}]), "invmax"))
    assert got == {(0, "A"): [0, 0], (0, "B"): [0, 1]}


def test_recode_takes_the_first_interval(spark):
    got = values(elementwise.recode(frame(spark, [{"A": [NAN, 5, 0, 10, 11, INF]}]), [(NAN, NAN, -1, -1), (0, 10, 0, 1), (5, INF, 9, 9)]))[0, "A"]
    assert got == [-1, 0.5, 0, 1, 9, 9]


def test_baseline_needs_points(spark):
    with pytest.raises(ValueError):
        elementwise.baseline_subtract(frame(spark, [{"A": [1]}]), 0)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=2, max_size=9), st.integers(2, 6), st.sampled_from([1, 1.5, 2, 3.25]))
def test_sliding_average_equals_its_definition(spark, x, size, step):
    right = (size - 1) // 2 + 1
    left, n = size - right, len(x)
    want = [np.mean(x[max(0, int(k * step) - left) : int(k * step) + right]) for k in range(round(n / step))]
    got = values(trace.sliding_average(frame(spark, [{"A": x}]), size, step)).get((0, "A"), [])
    assert np.allclose(got, want, atol=1e-9)


def test_sliding_average_rejects_what_would_be_empty(spark):
    assert trace.sliding_average(frame(spark, [{"A": [1.0, 2.0]}]), 3, 10).count() == 0


def test_differences_and_sums_are_inverse(spark):
    df = frame(spark, [{"A": [1, 4, 9], "B": [2, 2, 5]}, {"A": [3, 1, 1], "B": [0, 0, 7]}])
    for epochwise in (True, False):
        assert values(trace.integrate(trace.differentiate(df, epochwise), epochwise)) == values(df)


def test_refractory_periods_are_kept_by_channel(spark):
    wave = [-1, 1, -1, 1, -1, 1, -1, 1]
    events = trace.refractory(trace.crossings(frame(spark, [{"A": wave, "B": [*wave[1:], 1]}]), 0.0), 3)
    assert sorted((r.channel, r.point) for r in events.collect()) == [("A", 1), ("A", 4), ("A", 7), ("B", 1), ("B", 4)]


def test_equal_neighbours_make_one_extremum(spark):
    got = trace.extrema(frame(spark, [{"A": [0, 2, 2, 0, -2, -2, 0]}]), 1.0).collect()
    assert [(r.point, r.code) for r in sorted(got, key=lambda r: r.point)] == [(1, 1), (4, -1)]


def test_threshold_itself_rejects(spark):
    df = frame(spark, [{"A": [0.0, 1.0]}, {"A": [0.0, 0.999]}, {"A": [NAN, 0.5]}])
    assert set(values(reject.reject_bandwidth(df, 1.0))) == {(1, "A"), (2, "A")}
    assert set(values(reject.reject_bandwidth(df, 1.0, invert=True))) == {(0, "A")}


def test_assert_aborts(spark):
    epochs = spark.createDataFrame([(0, 1.0), (1, NAN)], "epoch_id long, sfreq double")
    assert reject.assert_epochs(epochs, "sfreq", "==", NAN).count() == 1
    with pytest.raises(Exception, match="assertion failed"):
        reject.assert_epochs(epochs, "sfreq", "==", 1.0, abort=True).collect()


def test_channel_assertions(spark):
    epochs = spark.createDataFrame([(0, ["A", "B"]), (1, ["A", "AB"])], "epoch_id long, channels array<string>")
    ids = lambda op, v: [r.epoch_id for r in reject.assert_epochs(epochs, "channelname", op, v).collect()]
    assert ids("==", "B") == [0] and ids("!=", "B") == [1] and ids("=~", "A") == [1]


# ------------------------------------------------------------------ collection and shape


def test_average_by_name_divides_by_own_count(spark):
    got = {(r.channel, r.point): (r.value, r.n) for r in collect.average(frame(spark, [{"A": [1, 2], "B": [5, 5]}, {"A": [3, 4]}])).collect()}
    assert got == {("A", 0): (2, 2), ("A", 1): (3, 2), ("B", 0): (5, 1), ("B", 1): (5, 1)}


def test_summed_items_are_never_divided(spark):
    df = spark.createDataFrame([(e, "A", 0, i, float(v)) for e, x in enumerate([(1, 10), (3, 30)]) for i, v in enumerate(x)], "epoch_id long, channel string, point int, item int, value double")
    got = {r.item: r.value for r in collect.average(df, leaveright=1).collect()}
    assert got == {0: 2.0, 1: 40.0}


def test_weights_after_collapsing(spark):
    """Ten epochs of weight 1 and eight of weight 2 over 37 channels: the summed weights come to 962."""
    rows = [(e, f"A{c + 1}", 0, i, v) for e in range(18) for c in range(37) for i, v in enumerate((1.0, 1.0 if e < 10 else 2.0))]
    df = spark.createDataFrame(rows, "epoch_id long, channel string, point int, item int, value double")
    mean = collect.average(df, leaveright=1).select("channel", "point", "item", "value").withColumn("epoch_id", F.lit(0))
    got = {r.item: r.value for r in shape.collapse_channels(mean, leaveright=1).collect()}
    assert got == {0: 1.0, 1: 962.0}


def test_single_epoch_has_no_t(spark):
    r = collect.average(frame(spark, [{"A": [2.0]}]), t_test=True).first()
    assert r.value == 2.0 and math.isnan(r.t) and math.isnan(r.p)


def test_append_takes_epochs_of_any_length(spark):
    got = collect.append_points(frame(spark, [{"A": [1, 2]}, {"A": [3]}, {"A": [4, 5]}])).collect()
    assert [r.value for r in sorted(got, key=lambda r: r.point)] == [1, 2, 3, 4, 5]


def test_empty_bins(spark):
    got = collect.histogram(frame(spark, [{"A": [0.0, 0.1, 5.0, NAN]}]), 0.0, 1.0, 4, empty=True).collect()
    assert [(r.bin, r["count"]) for r in sorted(got, key=lambda r: r.bin)] == [(0, 2), (1, 0), (2, 0), (3, 0)]


def test_trim_pads_with_zeros(spark):
    df = frame(spark, [{"A": [1, 2, 3]}])
    assert values(shape.trim(df, [(-2, 4), (2, 3)]))[0, "A"] == [0, 0, 1, 2, 3, 0, 0]
    assert values(shape.trim(df, [(1, 0)]))[0, "A"] == [2, 3]
    assert values(shape.trim(df, [(-1, 3), (2, 5)], "mean"))[0, "A"] == [1.0, 3.0]
    assert shape.trim(df, []).count() == 0


def test_pop_keeps_one(spark):
    df = frame(spark, [{"A": [1]}]).withColumn("dataset_no", F.lit(1))
    assert shape.pop(shape.push(df)).count() == 1
    with pytest.raises(Exception, match="only data set"):
        shape.pop(df).collect()


def test_windows_at_the_edges(spark):
    rec = spark.createDataFrame([("r", "A", p, float(p)) for p in range(10)], "recording string, channel string, pos long, value double")
    trig = spark.createDataFrame([("r", 1, 1), ("r", 2, 1), ("r", 7, 2), ("r", 8, 1)], "recording string, position long, code int")
    got = joins.trigger_windows(rec, trig, 2, 3)
    assert sorted((r.epoch_no, r.condition, r.value) for r in got.where("point = 0").collect()) == [(1, 1, 0.0), (2, 2, 5.0)]
    got = joins.trigger_windows(rec, trig, 2, 3, codes=[1], offset=-1).where("point = 0").collect()
    assert [r.value for r in got] == [5.0]


def test_side_with_too_few_epochs(spark):
    df = frame(spark, [{"A": [1]}, {"A": [2]}])
    with pytest.raises(Exception, match="fewer epochs"):
        joins.subtract_epochwise(df, df.where("epoch_id = 0")).collect()


# ------------------------------------------------------------------ kernels


def test_filter_passes_and_stops(spark):
    t = np.arange(64)
    slow, fast = np.sin(2 * np.pi * 4 * t / 64), np.sin(2 * np.pi * 24 * t / 64)
    df = traces(frame(spark, [{"A": slow + fast}]))
    got = values(samples(spectral.fftfilter(df, [(0.5, 0.5, 1.0, 1.0, 0.0)])))[0, "A"]
    assert np.allclose(got, slow, atol=1e-9)


@pytest.mark.parametrize("n", [64, 100])
def test_fft_round_trip(spark, n):
    x = np.random.default_rng(0).normal(size=n)
    back = spectral.raw_ifft(spectral.raw_fft(traces(frame(spark, [{"A": x}])))).first()["values"]
    assert np.allclose(back[:n], x)


def test_power_finds_a_sine():
    freqs, over, window = spectral.spectrum_shape(96)
    assert freqs == 32 and window == 96
    p = spectral.power(np.sin(2 * np.pi * 8 * np.arange(96) / 64), freqs, over, window)
    assert p.argmax() == 8


def test_coherence_of_copies_is_one(spark):
    x = np.random.default_rng(1).normal(size=96)
    df = traces(frame(spark, [{"A": x, "B": 3 * x}]))
    r = spectral.cross_spectra(df, "A").where("channel = 'B'").first()
    assert np.allclose(r.re, 1) and np.allclose(r.im, 0, atol=1e-9)


def test_components_of_mixed_sources():
    t = np.arange(2000)
    sources = np.stack([np.sign(np.sin(t / 31)), np.random.default_rng(0).laplace(size=2000)])
    maps, act = spectral.infomax(np.array([[1.0, 0.5], [0.3, 1.0], [0.8, -0.4]]) @ sources, 2)
    c = np.abs(np.corrcoef(np.concatenate([act, sources]))[:2, 2:])
    assert (c.max(axis=0) > 0.95).all()


def test_dipole_is_found():
    from polytrace.sources.simulate import sensors

    at, moment = np.array([1.0, 2.0, 4.0]), np.array([0.5, 1.0, -0.5])
    place, found, rest = spectral.fit_dipole(sensors(37), spectral.lead_field(sensors(37), at) @ moment)
    assert rest < 1e-3 and np.allclose(place, at, atol=0.2)


def test_laplacian_of_a_plane_is_nothing():
    p = np.array([[x, y, 50.0] for x in range(5) for y in range(5)], float)
    m = spectral.laplacian_matrix(np.concatenate([p, [[2, 2, -50]]]))
    assert np.allclose((m[:25, :25] @ (2 * p[:, 0] + 3))[12], 0, atol=1e-6)


# ------------------------------------------------------------------ events


def test_ranges(spark):
    c = spark.createDataFrame([("r", float(a), s) for a, s in [(0, -1), (2, 1), (5, -1), (6, 1), (7, -1), (20, 1), (30, -1), (40, 1)]], "rec string, at double, code int")
    got = lambda **k: sorted((r.start, r.end) for r in paradigm.ranges_from_crossings(c, ["rec"], **k).collect())
    assert got() == [(2, 5), (6, 7), (20, 30)]
    assert got(debounce=1.0) == [(2, 7), (20, 30)] and got(min_length=2.0) == [(2, 5), (20, 30)]


def test_code_sequences(spark):
    e = spark.createDataFrame([("r", float(k), c, k) for k, c in enumerate("abcabxab")], "recording string, at double, code string, tie int")
    got = paradigm.code_sequences(e, {("a", "b", "c"): "X", ("a", "b"): "Y"}, 5.0).collect()
    assert [r.code for r in sorted(got, key=lambda r: r.at)] == ["X", "Y", "x", "Y"]


def test_artifacts(spark):
    rng = np.random.default_rng(3)
    x = {f"C{k}": rng.normal(size=600).cumsum() for k in range(4)}
    x["C1"][200:260] = x["C1"][200]
    x["C2"][400:] += 500
    jumps, still = paradigm.artifacts(frame(spark, [x]))
    assert [r.point for r in jumps.collect()] == [400]
    assert [(r.start, r.end) for r in still.collect()] == [(201, 260)]


# ------------------------------------------------------------------ pipelines


def test_scripts_are_checked(spark):
    df = frame(spark, [{"A": [1, 2]}])
    for bad, why in [("demean_maps\naverage", "source"), ("source d\ncalc abs", "collection"), ("source d\naverage\ncalc abs", "Post"), ("source d\nrun ls\naverage", "start programs"), ("source d\ncalc -z abs\naverage", "unknown option"), ("source d\ncalc\naverage", "arguments"), ("source d\nnothing\naverage", "unknown method")]:
        with pytest.raises(ValueError, match=why):
            compile_script(bad, {"d": df}, 100.0)


def test_script_variables_and_parts(spark):
    df = frame(spark, [{"A": [1, 2]}, {"A": [3, 4]}])
    parts = split_scripts("source d\nscale_by $1 # twice\naverage\n-\n# nothing\n-\nsource d\nminmax\n")
    assert len(parts) == 2
    got = compile_script(parts[0], {"d": df}, 100.0, variables=["2"]).frame().collect()
    assert sorted(r.value for r in got) == [4.0, 6.0]


def test_scripts_with_kernels_and_sides(spark):
    t = np.arange(64)
    df = frame(spark, [{"A": np.sin(2 * np.pi * 4 * t / 64) + np.sin(2 * np.pi * 24 * t / 64) + 1}])
    side = frame(spark, [{"A": np.ones(64)}]).drop("epoch_id")
    got = compile_script("source d\nsubtract side\nfftfilter 25Hz 25Hz 50Hz 50Hz\naverage", {"d": df, "side": side}, 100.0).frame().collect()
    assert np.allclose([r.value for r in sorted(got, key=lambda r: r.point)], np.sin(2 * np.pi * 4 * t / 64), atol=1e-9)


def test_pipeline_order(spark):
    with pytest.raises(ValueError):
        Pipeline().branch("calc", "abs")
    with pytest.raises(KeyError):
        Pipeline().source(frame(spark, [{"A": [1]}])).then("no_such_thing")


def test_artifact_peaks(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (2, 400))
    x[1, 150] += 40
    got = [r.point for r in paradigm.artifact_peaks(frame(spark, [{"A": x[0].tolist(), "B": x[1].tolist()}]), 100.0, threshold=8.0).collect()]
    assert got == [150]


def test_binomial_logarithms_stop(spark):
    df = spark.createDataFrame([([5000.0, 1.0],), ([1.0, 5000.0],), ([3.0, 3.0],)], "items array<double>")
    got = [r["items"][2:] for r in elementwise.binomial_items(df).collect()]
    assert np.isclose(got[0][1], 126 * np.log10(2)) and np.isclose(got[1][1], -126 * np.log10(2)) and got[2][:2] == [1.0, 0.0]


def test_largest_modulus_of_ties_is_the_first_channels(spark):
    rows = [(0, c, f"C{c}", 0, v) for c, v in enumerate(([0.0, 1.0], [3.0, 4.0], [5.0, 0.0]))]
    df = spark.createDataFrame(rows, "epoch_id long, channel_idx int, channel string, point int, items array<double>")
    got = {r.channel: r["items"] for r in elementwise.zero_phase(df, "MAXAMP").collect()}
    assert np.allclose(got["C1"], [5.0, 0.0]) and np.allclose(got["C2"], [3.0, -4.0])


def test_votes_equal_all_pairs(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 5, 30).astype(float)
    got = {r.point: r.value for r in collect.sign_votes(frame(spark, [{"A": x.tolist()}]), 8).collect()}
    for p in range(30):
        base = [x[k] for k in range(8) if k != p]
        assert np.isclose(got[p], np.mean([1 if x[p] > b else -1 for b in base]))


def test_components_do_not_depend_on_the_start():
    rng = np.random.default_rng(10)
    sources = np.array([rng.laplace(size=4000), rng.uniform(-1, 1, 4000)])
    mixed = np.array([[1.0, 0.5], [0.3, 1.0], [0.8, -0.4]]) @ sources
    plain = spectral.infomax(mixed, 2, steps=4000)[0]
    for seed in (1, 2):
        turned = spectral.infomax(mixed, 2, steps=4000, seed=seed)[0]
        assert np.allclose(np.abs(turned / np.linalg.norm(turned, axis=0)), np.abs(plain / np.linalg.norm(plain, axis=0)), atol=0.05)
    early = spectral.infomax(mixed, 2, steps=4000, least=0.5)[0]  # ends at the first step
    assert np.allclose(early, spectral.infomax(mixed, 2, steps=1)[0])


def test_vectors_are_sent_to_the_samples(spark):
    """A join by channel would put all samples into as many tasks as there are channels, and sums before the samples are dealt out hold what a file holds."""
    from pyspark.sql import functions as F

    from polytrace.operators import joins, spectral

    df = spark.range(4000).select(F.floor(F.col("id") / 8).alias("epoch_id"), F.concat(F.lit("A"), (F.col("id") % 4).cast("string")).alias("channel"), (F.floor(F.col("id") / 4) % 2).cast("int").alias("point"), F.sin("id").alias("value"))
    vectors = spark.createDataFrame([(0, f"A{c}", 0.5) for c in range(4)], "k int, channel string, weight double")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for got in (joins.subspace(df, vectors), joins.project(df, vectors), spectral.laplacian(df, np.full((4, 4), 1.0), ["A0", "A1", "A2", "A3"])):
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(channel" not in plan and "REPARTITION_BY_COL" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    back = {(r.epoch_id, r.channel, r.point): r.value for r in joins.subspace(df, vectors, remove=True).collect()}
    mean = np.sin(np.arange(8, 12)).mean()
    assert len(back) == 4000 and np.isclose(back[1, "A2", 0], np.sin(10) - mean)


def test_epochs_are_decomposed_together(spark, monkeypatch):
    """Epochs take their steps in common calls, and each gets what it gets by itself, whenever the others end and whatever their shapes."""
    from polytrace.operators import spectral

    rng = np.random.default_rng(11)
    xs = [rng.normal(size=(3, 4)) @ rng.laplace(size=(4, 40)) for _ in range(30)] + [np.zeros((3, 40))]
    alone, calls, tanh = [spectral.infomax(x, 2, steps=300) for x in xs], [], np.tanh
    monkeypatch.setattr(np, "tanh", lambda u: (calls.append(1), tanh(u))[1])
    met = spectral.infomax_of(xs, 2, steps=300)
    assert len(calls) <= 300
    assert all(np.allclose(a, b, atol=1e-9, equal_nan=True) for one, other in zip(alone, met, strict=True) for a, b in zip(one, other, strict=True))
    monkeypatch.undo()
    xs += [rng.normal(size=(c, 3)) @ rng.laplace(size=(3, 25)) for c in (2, 4, 4)]
    rows = [(e, c, f"A{c}", v.tolist()) for e, x in enumerate(xs) for c, v in enumerate(x)]
    got = spectral.icadecomp(spark.createDataFrame(rows, "epoch_id long, channel_idx int, channel string, values array<double>"), 2, steps=300)
    found = {(r.epoch_id, r.channel_idx): r["values"] for r in got.collect()}
    assert len(found) == 2 * len(xs)
    for e, x in enumerate(xs):
        for k, v in enumerate(spectral.infomax(x, 2, steps=300)[0].T):
            assert np.allclose(found[e, k], v, atol=1e-9, equal_nan=True)

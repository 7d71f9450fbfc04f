"""More registered queries: spectra, decompositions, corrections, generated sources, scripts and streams."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .epochs import pack_items, samples, traces, unpack_items
from .functions.maths import plain
from .operators import clean, elementwise, paradigm, spectral, trace
from .plans.pipeline import Pipeline
from .plans.script import compile_script
from .queries import BEFORE, EV, MD, S1, S4, epochs1, epochs4, metadata, out, recordings, register, sql4
from .sources import simulate
from .streaming import run, stateful

# ------------------------------------------------------------------ spectra


def _spectrum(spark: SparkSession, d: str) -> DataFrame:
    df = spectral.raw_fft(traces(epochs1(spark, d).drop("condition")))
    return df.select("epoch_id", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "z")).select("epoch_id", "bin", plain(F.col("z.re"), 5).alias("re"), plain(F.col("z.im"), 5).alias("im"))


register(
    "raw_fft",
    _spectrum,
    f"WITH {S1} SELECT epoch_id, CAST(k AS INTEGER) AS bin, round(sum(value * cos(2 * pi() * k * point / 64)) / 32, 5) + 0.0 AS re, round(-sum(value * sin(2 * pi() * k * point / 64)) / 32, 5) + 0.0 AS im FROM s, range(33) t(k) GROUP BY epoch_id, k",
)
register("raw_ifft", lambda spark, d: out(samples(spectral.raw_ifft(spectral.raw_fft(traces(epochs1(spark, d).drop("condition"))))), digits=5), sql4("value", base=S1, digits=5))
BLOCKS = [(0.0, 0.0, 0.05, 0.1, 0.0), (0.6, 0.7, 1.0, 1.0, 0.25)]
GAIN = "(CASE WHEN r > 0.1 THEN 1 WHEN r > 0.05 THEN (r - 0.05) / 0.05 ELSE 0 END) * (CASE WHEN r < 0.6 THEN 1 WHEN r < 0.7 THEN 1 - 0.75 * (r - 0.6) / 0.1 ELSE 0.25 END)"
register(
    "fftfilter",
    lambda spark, d: out(samples(spectral.fftfilter(traces(epochs1(spark, d).drop("condition")), BLOCKS)), digits=5),
    f"""WITH {S1}, z AS (SELECT epoch_id, k, sum(value * cos(2 * pi() * k * point / 64)) AS re, -sum(value * sin(2 * pi() * k * point / 64)) AS im FROM s, range(33) t(k) GROUP BY epoch_id, k),
 g AS (SELECT epoch_id, k, re, im, {GAIN} AS g FROM (SELECT *, k / 32.0 AS r FROM z))
 SELECT epoch_id, 'E' AS channel, CAST(n AS INTEGER) AS point, round(sum((CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) * g * (re * cos(2 * pi() * k * n / 64) - im * sin(2 * pi() * k * n / 64))) / 64, 5) + 0.0 AS value FROM g, range(64) t(n) GROUP BY epoch_id, n""",
)
register(
    "fftspect",
    lambda spark, d: out(samples(spectral.fftspect(traces(epochs1(spark, d).drop("condition")), 64)), digits=5),
    f"""WITH {S1}, p AS (SELECT epoch_id, seg, point - 16 * seg AS i, value AS v FROM s JOIN range(2) t(seg) ON point BETWEEN 16 * seg AND 16 * seg + 31),
 l AS (SELECT epoch_id, seg, regr_slope(v, i) AS a, regr_intercept(v, i) AS b FROM p GROUP BY 1, 2), w AS (SELECT p.epoch_id, p.seg, i, (v - b - a * i) * (1 - pow((i + 1 - 16.5) / 16.5, 2)) AS v FROM p JOIN l USING (epoch_id, seg)),
 x AS (SELECT epoch_id, seg, k, pow(sum(v * cos(2 * pi() * k * i / 32)), 2) + pow(sum(v * sin(2 * pi() * k * i / 32)), 2) AS pw FROM w, range(16) t(k) GROUP BY 1, 2, 3), d AS (SELECT sum(pow(1 - pow((i + 1 - 16.5) / 16.5, 2), 2)) AS d FROM range(32) t(i))
 SELECT epoch_id, 'E' AS channel, CAST(k AS INTEGER) AS point, round(sum(pw) * (CASE WHEN k = 0 THEN 1 ELSE 2 END) / (any_value(d) * 64), 5) + 0.0 AS value FROM x, d GROUP BY epoch_id, k""",
)
register(
    "spectrogram",
    lambda spark, d: samples(spectral.fftspect(traces(epochs1(spark, d).drop("condition")), 24, shifts=5)).select("epoch_id", "shift", "point", plain(F.col("value"), 5).alias("value")),
    f"""WITH {S1}, p AS (SELECT epoch_id, sh, seg, point - 10 * sh - 8 * seg AS i, value AS v FROM s, range(5) a(sh), range(2) t(seg) WHERE point BETWEEN 10 * sh + 8 * seg AND 10 * sh + 8 * seg + 15),
 l AS (SELECT epoch_id, sh, seg, regr_slope(v, i) AS a, regr_intercept(v, i) AS b FROM p GROUP BY ALL), w AS (SELECT epoch_id, sh, seg, i, (v - b - a * i) * (1 - pow((i + 1 - 8.5) / 8.5, 2)) AS v FROM p JOIN l USING (epoch_id, sh, seg)),
 x AS (SELECT epoch_id, sh, seg, k, pow(sum(v * cos(2 * pi() * k * i / 16)), 2) + pow(sum(v * sin(2 * pi() * k * i / 16)), 2) AS pw FROM w, range(8) t(k) GROUP BY ALL), d AS (SELECT sum(pow(1 - pow((i + 1 - 8.5) / 8.5, 2), 2)) AS d FROM range(16) t(i))
 SELECT epoch_id, CAST(sh AS INTEGER) AS shift, CAST(k AS INTEGER) AS point, round(sum(pw) * (CASE WHEN k = 0 THEN 1 ELSE 2 END) / (any_value(d) * 32), 5) + 0.0 AS value FROM x, d GROUP BY epoch_id, sh, k""",
)


def _cross(spark: SparkSession, d: str, mode: str) -> DataFrame:
    df = spectral.cross_spectra(traces(epochs4(spark, d).drop("condition")), "A1", mode)
    return df.select("epoch_id", "reference", "channel", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "z")).select("epoch_id", "reference", "channel", "bin", plain(F.col("z.re"), 5).alias("re"), plain(F.col("z.im"), 5).alias("im"))


#: Spectra of two half-overlapping segments of 8 points each, 5 bins; beside them those of the channel A1.
SEGMENTS = f"""WITH {S4}, p AS (SELECT epoch_id, channel, seg, point - 4 * seg AS i, value AS v FROM s, range(2) t(seg) WHERE point BETWEEN 4 * seg AND 4 * seg + 7),
 l AS (SELECT epoch_id, channel, seg, regr_slope(v, i) AS a, regr_intercept(v, i) AS b FROM p GROUP BY ALL), w AS (SELECT epoch_id, channel, seg, i, (v - b - a * i) * (1 - pow((i + 1 - 4.5) / 4.5, 2)) AS v FROM p JOIN l USING (epoch_id, channel, seg)),
 z AS (SELECT epoch_id, channel, seg, CAST(k AS INTEGER) AS k, sum(v * cos(2 * pi() * k * i / 8)) AS re, -sum(v * sin(2 * pi() * k * i / 8)) AS im FROM w, range(5) t(k) GROUP BY ALL),
 c AS (SELECT z.epoch_id, z.channel, z.k, z.re * r.re + z.im * r.im AS re, z.im * r.re - z.re * r.im AS im, sqrt(r.re * r.re + r.im * r.im) AS m, z.re * z.re + z.im * z.im AS px, r.re * r.re + r.im * r.im AS pr FROM z JOIN z r ON r.epoch_id = z.epoch_id AND r.seg = z.seg AND r.k = z.k AND r.channel = 'A1')
 SELECT epoch_id, 'A1' AS reference, channel, k AS bin, round({{re}}, 5) + 0.0 AS re, round({{im}}, 5) + 0.0 AS im FROM c GROUP BY epoch_id, channel, k"""
for _mode, _form in (("cross", "avg({})"), ("phase", "avg({} / m)"), ("coherence", "sum({}) / sqrt(sum(px) * sum(pr))")):
    register(f"spectra_{_mode}", lambda spark, d, m=_mode: _cross(spark, d, m), SEGMENTS.format(re=_form.format("re"), im=_form.format("im")))

# ------------------------------------------------------------------ decompositions


def _arrays(spark: SparkSession, d: str) -> DataFrame:
    return traces(epochs4(spark, d).drop("condition"))


def _svd_sum(spark: SparkSession, d: str) -> DataFrame:
    """All components of a decomposition add up to the epoch again."""
    parts = samples(spectral.svdecomp(_arrays(spark, d), 4)).withColumn("channel", F.split("channel", "/")[0])
    return out(parts.groupBy("epoch_id", "channel", "point").agg(F.sum("value").alias("value")), digits=5)


register("svdecomp", _svd_sum, sql4("value", digits=5))
register("svdecomp_maps", lambda spark, d: out(samples(spectral.svdecomp(_arrays(spark, d), 2, maps=True)), digits=5))
register("icadecomp", lambda spark, d: out(samples(spectral.icadecomp(_arrays(spark, d), 3)), digits=4))
register(
    "orthogonalize",
    lambda spark, d: out(samples(spectral.orthogonalize(_arrays(spark, d).where("channel_idx < 2"))), digits=5),
    sql4(
        "CASE WHEN channel_idx = 0 THEN value ELSE value - a * sum(value * a) OVER w / sum(a * a) OVER w END",
        rest="FROM (SELECT *, max(value) FILTER (channel_idx = 0) OVER (PARTITION BY epoch_id, point) AS a FROM s WHERE channel_idx < 2) WINDOW w AS (PARTITION BY epoch_id, channel)",
        digits=5,
    ),
)


def _inverse_product(spark: SparkSession, d: str) -> DataFrame:
    """The epoch times its pseudoinverse: the unit matrix, as 4 x 4 values."""
    inverse = samples(spectral.invert(_arrays(spark, d))).select("epoch_id", (F.col("channel_idx")).alias("point"), F.col("point").alias("column"), F.col("value").alias("w"))
    met = epochs4(spark, d).join(inverse, ["epoch_id", "point"])
    return met.groupBy("epoch_id", F.col("channel_idx").alias("line"), "column").agg(plain(F.sum(F.col("value") * F.col("w")), 5).alias("value"))


register("invert", _inverse_product, f"WITH {S4} SELECT DISTINCT epoch_id, channel_idx AS line, CAST(k AS INTEGER) AS \"column\", CASE WHEN channel_idx = k THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM s, range(4) t(k)")


def _laplacian(spark: SparkSession, d: str) -> DataFrame:
    """Four sensors, each the others' neighbour."""
    return out(spectral.laplacian(epochs4(spark, d), np.full((4, 4), 1.0) - 4 * np.eye(4), ["A1", "A2", "A3", "A4"]))


register("laplacian", _laplacian, sql4("sum(value) OVER (PARTITION BY epoch_id, point) - 4 * value"))


def _dipoles(spark: SparkSession, d: str) -> DataFrame:
    """One dipole for each of 8 simulated epochs."""
    at = {f"A{k + 1}": tuple(p) for k, p in enumerate(simulate.sensors(37).tolist())}
    return spectral.dip_fit(simulate.dip_simulate(spark, 100.0, 8, 10, 10), 10, at).select("epoch_id", *[plain(F.col(c), 2).alias(c) for c in ("x", "y", "z")])


register("dip_fit", _dipoles)



def _field_rows() -> str:
    """The sensors' responses to the simulated sources as SQL rows: the potential of a dipole at a sensor, by its definition."""
    rows = []
    for c, at in enumerate(simulate.sensors(37).tolist()):
        gains = []
        for place, moment, _, _ in simulate.SOURCES:
            away = [a - b for a, b in zip(at, place, strict=True)]
            gains.append(sum(a * m for a, m in zip(away, moment, strict=True)) / (4 * math.pi * sum(a * a for a in away) ** 1.5))
        rows.append(f"({c}, {', '.join(f'{g!r}::DOUBLE' for g in gains)})")
    return ", ".join(rows)


register(
    "dip_simulate",
    lambda spark, d: simulate.dip_simulate(spark, 100.0, 5, 100, 100, noise=False).select("epoch_id", "channel", "point", plain(F.col("value") * 1e3, 6).alias("value")),
    f"SELECT CAST(t // 200 AS BIGINT) AS epoch_id, 'A' || CAST(c + 1 AS VARCHAR) AS channel, CAST(t % 200 AS INTEGER) AS point, round(1000 * (g0 * cos(t * 0.5) + g1 * cos(3 + t * 0.2)), 6) + 0.0 AS value FROM range(1000) a(t), (VALUES {_field_rows()}) b(c, g0, g1, g2)",
)
register(
    "null_source",
    lambda spark, d: simulate.null_source(spark, 100.0, 4, 3, 5, 7).select("epoch_id", "channel", "point", plain(F.col("x"), 3).alias("x"), "value"),
    "SELECT CAST(e AS BIGINT) AS epoch_id, CAST(c + 1 AS VARCHAR) AS channel, CAST(p AS INTEGER) AS point, round((p - 5) * 10.0, 3)::DOUBLE AS x, 0.0::DOUBLE AS value FROM range(4) a(e), range(3) b(c), range(12) g(p)",
)

# ------------------------------------------------------------------ corrections

register(
    "regress_out",
    lambda spark, d: out(clean.regress_out(epochs4(spark, d), "A4")),
    f"WITH {S4}, m AS (SELECT a.epoch_id, a.channel, a.point, a.value, b.value AS r FROM s a JOIN s b USING (epoch_id, point) WHERE a.channel <> 'A4' AND b.channel = 'A4'), g AS (SELECT channel, regr_slope(value, r) AS g FROM m GROUP BY 1) SELECT epoch_id, channel, point, round(value - g * r, 6) + 0.0 AS value FROM m JOIN g USING (channel)",
)
register("template_subtract", lambda spark, d: out(clean.template_subtract(epochs4(spark, d), 4)), sql4("value - avg(value) OVER (PARTITION BY epoch_id, channel, point % 4)"))
register(
    "drift_correct",
    lambda spark, d: out(clean.drift_correct(epochs1(spark, d), 16)),
    f"""WITH {S1}, m AS (SELECT epoch_id, point // 16 AS c, avg(value) AS m FROM s GROUP BY 1, 2), l AS (SELECT *, lag(m) OVER w AS p, lead(m) OVER w AS n FROM m WINDOW w AS (PARTITION BY epoch_id ORDER BY c))
 SELECT s.epoch_id, s.channel, s.point, round(value - CASE WHEN point < 16 * c + 7.5 THEN coalesce(m + (point - 16 * c - 7.5) * (m - p) / 16, m) ELSE coalesce(m + (point - 16 * c - 7.5) * (n - m) / 16, m) END, 6) + 0.0 AS value FROM s JOIN l ON l.epoch_id = s.epoch_id AND c = point // 16""",
)
register(
    "heart_rate",
    lambda spark, d: clean.heart_rate(recordings(spark, d).where("code = 'view'").select("recording", "at"), ["recording"]).select("recording", plain(F.col("rate"), 6).alias("rate"), plain(F.col("sdnn"), 2).alias("sdnn"), plain(F.col("rmssd"), 2).alias("rmssd")),
    f"""WITH {EV}, a AS (SELECT recording, "at", "at" - lag("at") OVER (PARTITION BY recording ORDER BY "at") AS rr FROM e WHERE code = 'view'), b AS (SELECT *, rr - lag(rr) OVER (PARTITION BY recording ORDER BY "at") AS dd FROM a)
 SELECT recording, round(60 / avg(rr), 6) + 0.0 AS rate, round(stddev_samp(rr) * 1000, 2) + 0.0 AS sdnn, round(sqrt(avg(dd * dd)) * 1000, 2) + 0.0 AS rmssd FROM b GROUP BY 1""",
)
register("event_density", lambda spark, d: clean.event_density(recordings(spark, d).withColumn("at", F.col("pos")), ["recording"], 10.0).select("recording", F.col("at").cast("double").alias("start"), "n"), f"WITH {EV} SELECT recording, (pos // 10 * 10)::DOUBLE AS start, count(*) AS n FROM e GROUP BY 1, 2")
register("spindles", lambda spark, d: clean.spindles(traces(epochs1(spark, d).drop("condition")), 100.0, min_seconds=0.05))
register(
    "true_ranges",
    lambda spark, d: paradigm.true_ranges(epochs1(spark, d).withColumn("on", F.col("value") > 0), ["epoch_id"], 2, 1).select("epoch_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")),
    f"""WITH {S1}, i AS (SELECT epoch_id, point, point - row_number() OVER (PARTITION BY epoch_id ORDER BY point) AS g FROM s WHERE value > 0), r AS (SELECT epoch_id, min(point) AS a, max(point) + 1 AS b FROM i GROUP BY epoch_id, g),
 f AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY epoch_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 1 OR row_number() OVER (PARTITION BY epoch_id ORDER BY a) = 1 THEN 1 ELSE 0 END AS f FROM r), h AS (SELECT *, sum(f) OVER (PARTITION BY epoch_id ORDER BY a) AS h FROM f)
 SELECT epoch_id, min(a) AS start, CAST(max(b) AS INTEGER) AS "end" FROM h GROUP BY epoch_id, h HAVING max(b) - min(a) > 2""",
)


def _slow_waves(spark: SparkSession, d: str) -> DataFrame:
    df = epochs1(spark, d)
    found = trace.extrema(df, 0.05).join(df.select("epoch_id", "channel", "point", "value"), ["epoch_id", "channel", "point"])
    waves = paradigm.slow_waves(found.withColumn("at", F.col("point")), ["epoch_id"])
    return waves.select("epoch_id", "start", "end", "peak_at", plain(F.col("peak"), 6).alias("peak"), plain(F.col("trough"), 6).alias("trough"))


register(
    "slow_waves",
    _slow_waves,
    f"""WITH {S1}, l AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM s WINDOW w AS (PARTITION BY epoch_id ORDER BY point)), c AS (SELECT *, CASE WHEN value >= 0.05 AND a < value AND b <= value THEN 1 WHEN value <= -0.05 AND a > value AND b >= value THEN -1 END AS code FROM l),
 g AS (SELECT *, sum(CASE WHEN code < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY epoch_id ORDER BY point) AS g FROM c WHERE code IS NOT NULL), w AS (SELECT epoch_id, g, min(point) FILTER (code < 0) AS start, max(value) FILTER (code < 0) AS trough, max_by(point, value) FILTER (code > 0) AS peak_at, max(value) FILTER (code > 0) AS peak FROM g WHERE g > 0 GROUP BY 1, 2),
 e AS (SELECT *, lead(start) OVER (PARTITION BY epoch_id ORDER BY g) AS "end" FROM w) SELECT epoch_id, start, "end", peak_at, round(peak, 6) + 0.0 AS peak, round(trough, 6) + 0.0 AS trough FROM e WHERE "end" IS NOT NULL AND peak IS NOT NULL""",
)
register(
    "code_sequences",
    lambda spark, d: paradigm.code_sequences(recordings(spark, d).select("recording", "at", "code", "tie"), {("view", "click"): "view>click", ("view", "click", "purchase"): "funnel"}, 86400.0).groupBy("recording", "code").count().withColumnRenamed("count", "n"),
    f"""WITH RECURSIVE {EV}, l AS MATERIALIZED (SELECT recording, pos, code, lead(code) OVER w AS c1, lead(code, 2) OVER w AS c2, lead("at") OVER w - "at" AS a1, lead("at", 2) OVER w - "at" AS a2 FROM e WINDOW w AS (PARTITION BY recording ORDER BY pos)),
 m AS MATERIALIZED (SELECT *, CASE WHEN code = 'view' AND c1 = 'click' AND c2 = 'purchase' AND a2 <= 86400 THEN 3 WHEN code = 'view' AND c1 = 'click' AND a1 <= 86400 THEN 2 ELSE 1 END AS len FROM l),
 k(recording, pos) AS (SELECT DISTINCT recording, CAST(0 AS BIGINT) FROM m UNION ALL SELECT k.recording, k.pos + m.len FROM k JOIN m ON m.recording = k.recording AND m.pos = k.pos)
 SELECT recording, CASE len WHEN 3 THEN 'funnel' WHEN 2 THEN 'view>click' ELSE code END AS code, count(*) AS n FROM k JOIN m USING (recording, pos) GROUP BY 1, 2""",
)
register(
    "sleep_cycles",
    lambda spark, d: paradigm.sleep_cycles(recordings(spark, d).select("recording", F.col("pos").cast("double").alias("at"), F.pmod("tie", F.lit(6)).cast("int").alias("stage")), "recording", 5.0).groupBy("recording").agg(F.max("cycle").alias("cycles")),
    f"""WITH RECURSIVE {EV}, r AS MATERIALIZED (SELECT recording, CAST(pos AS BIGINT) AS pos, CAST(tie % 6 AS INTEGER) AS stage FROM e), w(recording, pos, cycle, onset, last) AS (SELECT DISTINCT recording, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), false, CAST(NULL AS BIGINT) FROM r
 UNION ALL SELECT r.recording, r.pos, cycle + CASE WHEN NOT onset AND stage >= 2 OR onset AND last IS NOT NULL AND stage <> 5 AND r.pos - last >= 5 THEN 1 ELSE 0 END, onset OR stage >= 2, CASE WHEN stage = 5 THEN r.pos WHEN onset AND last IS NOT NULL AND r.pos - last >= 5 THEN NULL ELSE last END
  FROM w JOIN r ON r.recording = w.recording AND r.pos = w.pos + 1)
 SELECT recording, max(CASE WHEN onset THEN cycle ELSE 0 END) AS cycles FROM w WHERE pos >= 0 GROUP BY 1""",
)
register(
    "binomial_items",
    lambda spark, d: elementwise.binomial_items(metadata(spark, d).select("epoch_id", F.array(F.lit(0.5), (F.col("condition") + 1).cast("double"), F.lit(4.0)).alias("items"))).select("epoch_id", F.size("items").alias("n"), plain(F.col("items")[5], 6).alias("difference")),
    f"WITH {MD} SELECT epoch_id, 6 AS n, round((condition + 1 - 4.0) / (condition + 1 + 4.0), 6) + 0.0 AS difference FROM m",
)


def _items_round_trip(spark: SparkSession, d: str) -> DataFrame:
    df = epochs4(spark, d).withColumn("item", F.col("channel_idx")).withColumn("channel", F.lit("Z")).drop("channel_idx", "condition")
    return out(unpack_items(pack_items(df)), "epoch_id", "channel", "point", "item")


register("items_round_trip", _items_round_trip, sql4("value", "epoch_id, 'Z' AS channel, point, channel_idx AS item"))

# ------------------------------------------------------------------ pipelines and scripts


def _pipeline(spark: SparkSession, d: str) -> DataFrame:
    df = epochs4(spark, d)
    p = Pipeline().source(df.where("condition < 5")).source(df.where("condition >= 5")).branch("scale_by", 2.0)
    return out(p.then("baseline_subtract", BEFORE).then("reject_bandwidth", 1.0).collect("average").then("calc", "abs").frame(), "channel", "point")


_TWO = ", b AS (SELECT *, value * CASE WHEN condition < 5 THEN 1 ELSE 2 END AS u FROM s), c AS (SELECT *, u - avg(u) FILTER (point < 4) OVER (PARTITION BY epoch_id, channel) AS v FROM b), k AS (SELECT epoch_id, channel, max(v) - min(v) AS span FROM c GROUP BY ALL)"
register("pipeline_branches", _pipeline, f"WITH {S4}{_TWO} SELECT channel, point, round(abs(avg(v)), 6) + 0.0 AS value FROM c WHERE epoch_id NOT IN (SELECT epoch_id FROM k WHERE span >= 1.0) GROUP BY channel, point")

SCRIPT = """
# two sources; the second one is doubled
source low
source high
> scale_by 2
baseline_subtract
reject_bandwidth 1.0
remove_channel -n A4
average -t -u
Post:
calc abs
"""


def _script(spark: SparkSession, d: str) -> DataFrame:
    df = epochs4(spark, d)
    p = compile_script(SCRIPT, {"low": df.where("condition < 5"), "high": df.where("condition >= 5")}, 100.0, BEFORE)
    return p.frame().select("channel", "point", plain(F.col("value"), 6).alias("value"), plain(F.col("sum"), 6).alias("sum"))


register("script", _script, f"WITH {S4}{_TWO} SELECT channel, point, round(abs(avg(v)), 6) + 0.0 AS value, round(sum(v), 6) + 0.0 AS sum FROM c WHERE channel <> 'A4' AND epoch_id NOT IN (SELECT epoch_id FROM k WHERE span >= 1.0) GROUP BY channel, point")

# ------------------------------------------------------------------ streams


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    return run.table_stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("channel"), F.col("event_id").alias("pos"), "value")


register(
    "stream_windows",
    lambda spark, d: run.completed(stateful.windowed(_event_stream(spark, d), "ts", "1 day", by=["channel"])).select(F.unix_seconds("start").alias("start"), "channel", "n", plain(F.col("sum"), 4).alias("sum"), plain(F.col("max"), 6).alias("max")),
    "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type AS channel, count(*) AS n, round(sum(value), 4) + 0.0 AS sum, round(max(value), 6) + 0.0 AS max FROM events GROUP BY ALL",
)
register("stream_average", lambda spark, d: run.completed(stateful.running_average(_event_stream(spark, d), ["channel"])).select("channel", "n", plain(F.col("value"), 6).alias("value")), "SELECT event_type AS channel, count(*) AS n, round(avg(value), 6) + 0.0 AS value FROM events GROUP BY 1")
register(
    "stream_hopping",
    lambda spark, d: run.completed(stateful.windowed(_event_stream(spark, d), "ts", "2 days", "1 day", by=["channel"])).select(F.unix_seconds("start").alias("start"), "channel", "n", plain(F.col("sum"), 4).alias("sum")),
    "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) - 86400 * k AS start, event_type AS channel, count(*) AS n, round(sum(value), 4) + 0.0 AS sum FROM events, range(2) t(k) GROUP BY ALL",
)
register(
    "stream_sessions",
    lambda spark, d: run.completed(stateful.sessions(_event_stream(spark, d), "ts", "1 hour", ["channel"])).select("channel", F.unix_micros("start").alias("start"), "n"),
    """WITH p AS (SELECT event_type AS channel, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS f FROM events), q AS (SELECT *, sum(f) OVER (PARTITION BY channel ORDER BY ts) AS g FROM p)
 SELECT channel, CAST(epoch_us(min(ts)) AS BIGINT) AS start, count(*) AS n FROM q GROUP BY channel, g""",
)
register(
    "stream_integrate",
    lambda spark, d: run.finished(stateful.integrate(_event_stream(spark, d).drop("ts"))).select("channel", "pos", plain(F.col("value"), 4).alias("value")),
    "SELECT event_type AS channel, event_id AS pos, round(sum(value) OVER (PARTITION BY event_type ORDER BY event_id), 4) + 0.0 AS value FROM events",
)
register(
    "stream_differentiate",
    lambda spark, d: run.finished(stateful.differentiate(_event_stream(spark, d).drop("ts"))).select("channel", "pos", plain(F.col("value"), 6).alias("value")),
    "SELECT event_type AS channel, event_id AS pos, round(value - coalesce(lag(value) OVER (PARTITION BY event_type ORDER BY event_id), 0), 6) + 0.0 AS value FROM events",
)
register(
    "stream_crossings",
    lambda spark, d: run.finished(stateful.crossings(_event_stream(spark, d).drop("ts"), 50.0)),
    "WITH c AS (SELECT event_type AS channel, event_id AS pos, CASE WHEN value >= 50 THEN 1 ELSE -1 END AS code FROM events), l AS (SELECT *, lag(code) OVER (PARTITION BY channel ORDER BY pos) AS p FROM c) SELECT channel, pos, code FROM l WHERE code <> p",
)

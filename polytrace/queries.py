"""Registered queries of the time-series operators, each with the SQL that says the same.

Bindings: ``embeddings`` are epochs of 64 values, read as 4 channels A1..A4 of 16 points (or one channel of 64);
``events`` are recordings (users) of timed codes; ``lineitem`` and ``orders`` serve where volume matters.
Results are rounded on both sides, and -0.0 becomes 0.0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .epochs import pack_items, traces, x_axis
from .functions.maths import plain
from .operators import collect, elementwise, joins, paradigm, reject, shape, trace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

CHANNELS, POINTS, BEFORE = 4, 16, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epochs4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of 4 channels x 16 points per vector."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("epoch_id"), F.col("label").alias("condition"), F.posexplode("embedding").alias("i", "v"))
    return e.select(
        "epoch_id",
        "condition",
        F.floor(F.col("i") / POINTS).cast("int").alias("channel_idx"),
        F.concat(F.lit("A"), (F.floor(F.col("i") / POINTS) + 1).cast("string")).alias("channel"),
        F.pmod("i", F.lit(POINTS)).cast("int").alias("point"),
        F.col("v").cast("double").alias("value"),
    )


def epochs1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of one channel x 64 points per vector."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("epoch_id"), F.col("label").alias("condition"), F.posexplode("embedding").alias("point", "v"))
    return e.select("epoch_id", "condition", F.lit("E").alias("channel"), "point", F.col("v").cast("double").alias("value"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user in order: (recording, pos, at in seconds, code, value, tie)."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(F.col("user_id").alias("recording"), (F.row_number().over(w) - 1).alias("pos"), at.alias("at"), F.col("event_type").alias("code"), "value", F.col("event_id").alias("tie"))


S4 = f"""s AS (SELECT vec_id AS epoch_id, label AS condition, CAST(i // {POINTS} AS INTEGER) AS channel_idx, 'A' || CAST(i // {POINTS} + 1 AS VARCHAR) AS channel,
 CAST(i % {POINTS} AS INTEGER) AS point, CAST(embedding[i + 1] AS DOUBLE) AS value FROM (SELECT vec_id, label, embedding, UNNEST(range(64)) AS i FROM embeddings))"""
S1 = "s AS (SELECT vec_id AS epoch_id, label AS condition, 'E' AS channel, CAST(i AS INTEGER) AS point, CAST(embedding[i + 1] AS DOUBLE) AS value FROM (SELECT vec_id, label, embedding, UNNEST(range(64)) AS i FROM embeddings))"
EV = 'e AS (SELECT user_id AS recording, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, epoch_us(ts) / 1e6 AS "at", event_type AS code, value, event_id AS tie FROM events)'


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def out(df: DataFrame, *keys: str, digits: int = 6, value: str = "value") -> DataFrame:
    return df.select(*(keys or ("epoch_id", "channel", "point")), plain(F.col(value), digits).alias(value))


def sql4(select: str, keys: str = "epoch_id, channel, point", rest: str = "FROM s", with_: str = "", base: str = S4, digits: int = 6) -> str:
    return f"WITH {base}{with_} SELECT {keys}, round({select}, {digits}) + 0.0 AS value {rest}"


# ------------------------------------------------------------------ elementwise

#: SQL of each function; inputs are spread so that every branch is met.
CALC = {
    "log": "CASE WHEN v > 0 THEN ln(v) WHEN v = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END",
    "log10": "CASE WHEN v > 0 THEN log10(v) WHEN v = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END",
    "logdB": "10 * CASE WHEN v > 0 THEN log10(v) WHEN v = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END",
    "expdB": "pow(10.0, v / 10)",
    "exp": "exp(v)",
    "exp10": "pow(10.0, v)",
    "atanh": "CASE WHEN abs(v) < 1 THEN 0.5 * ln((1 + v) / (1 - v)) WHEN abs(v) = 1 THEN sign(v) * 'inf'::DOUBLE ELSE 'nan'::DOUBLE END",
    "sqrt": "CASE WHEN v >= 0 THEN sqrt(v) ELSE 'nan'::DOUBLE END",
    "square": "v * v",
    "neg": "-v",
    "abs": "abs(v)",
    "inv": "CASE WHEN v = 0 THEN 'inf'::DOUBLE ELSE 1 / v END",
    "ceil": "ceil(v)",
    "floor": "floor(v)",
    "rint": "round_even(v, 0)",
}


def _calc(function: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = epochs4(spark, sf_dir)
        df = df.withColumn("value", F.when(F.col("point") == 0, F.lit(0.0)).otherwise(F.round(F.col("value") * 4, 3)))
        return out(elementwise.calc(df, function))

    return query


for _f, _sql in CALC.items():
    register(f"calc_{_f}", _calc(_f), sql4(f"({_sql})", rest=f"FROM (SELECT *, CASE WHEN point = 0 THEN 0.0 ELSE round(value * 4, 3) END AS v FROM s)"))


def complex_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels A1 and A2 as real and imaginary part."""
    df = epochs4(spark, sf_dir).where("channel_idx < 2").withColumn("item", F.col("channel_idx")).withColumn("channel", F.lit("Z")).drop("channel_idx", "condition")
    return pack_items(df)


C2 = ", z AS (SELECT epoch_id, 'Z' AS channel, point, max(value) FILTER (channel_idx = 0) AS re, max(value) FILTER (channel_idx = 1) AS im FROM s GROUP BY ALL HAVING count(*) FILTER (channel_idx < 2) > 0)"
C2 = C2.replace("FROM s GROUP BY ALL HAVING count(*) FILTER (channel_idx < 2) > 0", "FROM s GROUP BY epoch_id, point")
TUPLES = {
    "abs2": ("sqrt(re * re + im * im)", "0.0::DOUBLE"),
    "square2": ("re * re + im * im", "0.0::DOUBLE"),
    "norm2": ("re / sqrt(re * re + im * im)", "im / sqrt(re * re + im * im)"),
    "phase": ("atan2(im, re)", "0.0::DOUBLE"),
    "absandphase": ("sqrt(re * re + im * im)", "atan2(im, re)"),
    "coherence": ("sqrt(re * re + im * im)", "pow(1 - sqrt(re * re + im * im), 5)"),
}


def _tuple(function: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = elementwise.calc_items(complex_items(spark, sf_dir), function, 3.0)
        return df.select("epoch_id", "channel", "point", plain(F.col("items")[0], 6).alias("a"), plain(F.col("items")[1], 6).alias("b"))

    return query


for _f, (_a, _b) in TUPLES.items():
    register(f"calc_{_f}", _tuple(_f), f"WITH {S4}{C2} SELECT epoch_id, channel, point, round({_a}, 6) + 0.0 AS a, round({_b}, 6) + 0.0 AS b FROM z")


def _averaged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = collect.average(epochs4(spark, sf_dir), by=["condition"], leave_sums=True)
    return a.select("condition", "channel", "point", F.array("value", "sum", "sumsq", F.col("n").cast("double")).alias("items"))


register(
    "calc_stddev",
    lambda spark, d: elementwise.calc_items(_averaged_items(spark, d), "stddev").select("condition", "channel", "point", plain(F.col("items")[1], 6).alias("sigma"), plain(F.col("items")[2], 6).alias("error")),
    f"WITH {S4} SELECT condition, channel, point, round(stddev_pop(value), 6) + 0.0 AS sigma, round(stddev_pop(value) / sqrt(count(*) - 1), 6) + 0.0 AS error FROM s GROUP BY ALL",
)
register(
    "calc_ttest",
    lambda spark, d: elementwise.calc_items(_averaged_items(spark, d), "ttest").select("condition", "channel", "point", plain(F.col("items")[1], 4).alias("t")),
    f"WITH {S4} SELECT condition, channel, point, round(avg(value) / (stddev_samp(value) / sqrt(count(*))), 4) + 0.0 AS t FROM s GROUP BY ALL",
)

SQL_Q = "(list_sort(list(value))[CAST(floor((count(*) - 1) * {q}) AS INTEGER) + 1] + list_sort(list(value))[CASE WHEN floor(count(*) * {q}) >= count(*) THEN CAST(floor((count(*) - 1) * {q}) AS INTEGER) ELSE CAST(floor(count(*) * {q}) AS INTEGER) END + 1]) / 2"
MAP, TRACE = "epoch_id, point", "epoch_id, channel"
for _name, _agg, _over in (
    ("negmean", "avg(value)", MAP),
    ("negmin", "min(value)", MAP),
    ("negmax", "max(value)", MAP),
    ("negpointmean", "avg(value)", TRACE),
    ("negpointmin", "min(value)", TRACE),
    ("negpointmax", "max(value)", TRACE),
):
    register(f"add_{_name}", lambda spark, d, n=_name: out(elementwise.add(epochs4(spark, d), n)), sql4(f"value - {_agg} OVER (PARTITION BY {_over})"))
for _name, _over in (("negquantile", MAP), ("negpointquantile", TRACE)):
    register(
        f"add_{_name}",
        lambda spark, d, n=_name: out(elementwise.add(epochs4(spark, d), n, q=0.4)),
        sql4("s.value - q.q", "s.epoch_id, s.channel, s.point", f"FROM s JOIN q USING ({_over})", f", q AS (SELECT {_over}, {SQL_Q.format(q=0.4)} AS q FROM s GROUP BY {_over})"),
    )
register("add_constant", lambda spark, d: out(elementwise.add(epochs4(spark, d), 0.25, channels="A2-A3")), sql4("CASE WHEN channel IN ('A2', 'A3') THEN value + 0.25 ELSE value END"))


def _add_triggers(spark: SparkSession, d: str) -> DataFrame:
    df = epochs4(spark, d)
    marks = df.select("epoch_id").distinct().select("epoch_id", F.pmod("epoch_id", F.lit(POINTS)).alias("position"), (F.pmod("epoch_id", F.lit(5)) + 1).alias("code"))
    return out(elementwise.add(df, "triggers", triggers=marks))


register("add_triggers", _add_triggers, sql4("value + CASE WHEN point = epoch_id % 16 THEN epoch_id % 5 + 1 ELSE 0 END"))
register("add_noise", lambda spark, d: elementwise.add(epochs4(spark, d), "gaussnoise", amount=0.1, seed=1).select("epoch_id", "channel", "point", "value"))
for _name, _agg in (("norm", "sqrt(sum(value * value) {o})"), ("squarenorm", "sum(value * value) {o}"), ("sum", "sum(value) {o}"), ("max", "max(value) {o}"), ("maxabs", "max(abs(value)) {o}")):
    for _point, _over in (("", MAP), ("point", TRACE)):
        _factor = _agg.format(o=f"OVER (PARTITION BY {_over})")
        register(f"scale_by_inv{_point}{_name}", lambda spark, d, n=f"inv{_point}{_name}": out(elementwise.scale_by(epochs4(spark, d), n), digits=4), sql4(f"value / CASE WHEN {_factor} = 0 THEN 1 ELSE {_factor} END", digits=4))
for _point, _over in (("", MAP), ("point", TRACE)):
    register(
        f"scale_by_inv{_point}quantile",
        lambda spark, d, n=f"inv{_point}quantile": out(elementwise.scale_by(epochs4(spark, d), n, q=0.9), digits=4),
        sql4("s.value / CASE WHEN q.q = 0 THEN 1 ELSE q.q END", "s.epoch_id, s.channel, s.point", f"FROM s JOIN q USING ({_over})", f", q AS (SELECT {_over}, {SQL_Q.format(q=0.9)} AS q FROM s GROUP BY {_over})", digits=4),
    )
for _name, _factor in (("xdata", "((point - 4) * 10.0)"), ("pi", "pi()"), ("sfreq", "100.0"), ("nr_of_points", "16.0"), ("nr_of_channels", "4.0"), ("nrofaverages", "5.0"), ("sqrtnrofaverages", "sqrt(5.0)")):
    _scaled = lambda spark, d, n: out(elementwise.scale_by(x_axis(epochs4(spark, d), 100.0, BEFORE), n, sfreq=100.0, averages=5.0))
    register(f"scale_by_{_name}", lambda spark, d, n=_name, f=_scaled: f(spark, d, n), sql4(f"value * {_factor}"))
    register(f"scale_by_inv{_name}", lambda spark, d, n=f"inv{_name}", f=_scaled: f(spark, d, n), sql4(f"value / CASE WHEN {_factor} = 0 THEN 1 ELSE {_factor} END"))
register(
    "recode",
    lambda spark, d: out(elementwise.recode(epochs4(spark, d), [(-0.1, 0.1, 0.0, 0.0), (0.1, 1.0, 1.0, 2.0), (float("-inf"), -0.1, -1.0, -1.0)])),
    sql4("CASE WHEN value BETWEEN -0.1 AND 0.1 THEN 0 WHEN value BETWEEN 0.1 AND 1.0 THEN 1 + (value - 0.1) * (1.0 / 0.9) WHEN value <= -0.1 THEN -1 ELSE value END"),
)
register("baseline_subtract", lambda spark, d: out(elementwise.baseline_subtract(epochs4(spark, d), BEFORE)), sql4("value - avg(value) FILTER (point < 4) OVER (PARTITION BY epoch_id, channel)"))
register("baseline_divide", lambda spark, d: out(elementwise.baseline_divide(epochs4(spark, d), BEFORE), digits=3), sql4("value / avg(value) FILTER (point < 4) OVER (PARTITION BY epoch_id, channel)", digits=3))
register("demean_maps", lambda spark, d: out(elementwise.demean_maps(epochs4(spark, d))), sql4("value - avg(value) OVER (PARTITION BY epoch_id, point)"))
register("rereference", lambda spark, d: out(elementwise.rereference(epochs4(spark, d), "A1,A3", exclude="A4")), sql4("CASE WHEN channel = 'A4' THEN value ELSE value - avg(value) FILTER (channel IN ('A1', 'A3')) OVER (PARTITION BY epoch_id, point) END"))


def complex_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two complex channels: (A1, A2) and (A3, A4)."""
    df = epochs4(spark, sf_dir).withColumn("item", F.pmod("channel_idx", F.lit(2))).withColumn("channel", F.concat(F.lit("Z"), (F.floor(F.col("channel_idx") / 2) + 1).cast("string"))).drop("channel_idx", "condition")
    return pack_items(df)


register(
    "zero_phase",
    lambda spark, d: elementwise.zero_phase(complex_channels(spark, d), "Z1").select("epoch_id", "channel", "point", plain(F.col("items")[0], 6).alias("a"), plain(F.col("items")[1], 6).alias("b")),
    f"""WITH {S4}, z AS (SELECT epoch_id, 'Z' || CAST(channel_idx // 2 + 1 AS VARCHAR) AS channel, point, max(value) FILTER (channel_idx % 2 = 0) AS re, max(value) FILTER (channel_idx % 2 = 1) AS im FROM s GROUP BY ALL),
 r AS (SELECT epoch_id, point, atan2(im, re) AS a FROM z WHERE channel = 'Z1')
 SELECT epoch_id, channel, point, round(re * cos(a) + im * sin(a), 6) + 0.0 AS a, round(im * cos(a) - re * sin(a), 6) + 0.0 AS b FROM z JOIN r USING (epoch_id, point)""",
)

# ------------------------------------------------------------------ traces

register("differentiate", lambda spark, d: out(trace.differentiate(epochs4(spark, d))), sql4("value - coalesce(lag(value) OVER (PARTITION BY epoch_id, channel ORDER BY point), 0)"))
register("differentiate_across", lambda spark, d: out(trace.differentiate(epochs4(spark, d), epochwise=False)), sql4("value - coalesce(lag(value) OVER (PARTITION BY channel ORDER BY epoch_id, point), 0)"))
register("integrate", lambda spark, d: out(trace.integrate(epochs4(spark, d))), sql4("sum(value) OVER (PARTITION BY epoch_id, channel ORDER BY point)"))
register("integrate_across", lambda spark, d: out(trace.integrate(epochs4(spark, d), epochwise=False)), sql4("sum(value) OVER (PARTITION BY channel ORDER BY epoch_id, point)"))
register("sliding_average", lambda spark, d: out(trace.sliding_average(epochs4(spark, d), 5, 1)), sql4("avg(value) OVER (PARTITION BY epoch_id, channel ORDER BY point ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"))
_K = ", k AS (SELECT CAST(range AS INTEGER) AS k, CAST(floor(range * {step}) AS INTEGER) AS m FROM range({n}))"
register(
    "sliding_average_step",
    lambda spark, d: out(trace.sliding_average(epochs4(spark, d), 4, 2.5)),
    sql4("avg(value)", "epoch_id, channel, k AS point", "FROM s JOIN k ON s.point BETWEEN m - 2 AND m + 1 GROUP BY epoch_id, channel, k", _K.format(step=2.5, n=6)),
)
register(
    "sliding_median",
    lambda spark, d: out(trace.sliding_average(epochs4(spark, d), 4, 2, q=0.5)),
    sql4(SQL_Q.format(q=0.5), "epoch_id, channel, k AS point", "FROM s JOIN k ON s.point BETWEEN m - 2 AND m + 1 GROUP BY epoch_id, channel, k", _K.format(step=2, n=8)),
)
register(
    "sliding_interpolation",
    lambda spark, d: out(trace.sliding_average(epochs4(spark, d), 1, 2.5)),
    sql4("sum(value * CASE WHEN point = m THEN 1 - (k * 2.5 - m) ELSE k * 2.5 - m END)", "epoch_id, channel, k AS point", "FROM s JOIN k ON s.point IN (m, m + 1) GROUP BY epoch_id, channel, k", _K.format(step=2.5, n=6)),
)
register(
    "convolve",
    lambda spark, d: out(trace.convolve(epochs4(spark, d), [0.25, 0.5, 0.25], 1)),
    sql4(
        "sum(value * CASE point - greatest(m - 1, 0) WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 ELSE 0.25 END) / 3",
        "epoch_id, channel, k AS point",
        "FROM s JOIN k ON s.point BETWEEN greatest(m - 1, 0) AND m + 1 GROUP BY epoch_id, channel, k",
        _K.format(step=1, n=16),
    ),
)
register("detrend", lambda spark, d: out(trace.detrend(epochs4(spark, d))), sql4("value - regr_intercept(value, point) OVER w - regr_slope(value, point) OVER w * point", rest="FROM s WINDOW w AS (PARTITION BY epoch_id, channel)"))
register(
    "detrend_omit",
    lambda spark, d: out(trace.detrend(epochs4(spark, d), omit=[(5, 9)])),
    sql4("s.value - l.b - l.a * s.point", "s.epoch_id, s.channel, s.point", "FROM s JOIN l USING (epoch_id, channel)", ", l AS (SELECT epoch_id, channel, regr_slope(value, point) AS a, regr_intercept(value, point) AS b FROM s WHERE point NOT BETWEEN 5 AND 9 GROUP BY ALL)"),
)
register("detrend_mean", lambda spark, d: out(trace.detrend(epochs4(spark, d), "mean")), sql4("value - avg(value) OVER (PARTITION BY epoch_id, channel)"))
register(
    "detrend_ends",
    lambda spark, d: out(trace.detrend(epochs4(spark, d), "ends")),
    sql4("value - max(value) FILTER (point = 0) OVER w - point * (max(value) FILTER (point = 15) OVER w - max(value) FILTER (point = 0) OVER w) / 15", rest="FROM s WINDOW w AS (PARTITION BY epoch_id, channel)"),
)
register("detrend_at", lambda spark, d: out(trace.detrend(epochs4(spark, d), "at", at=BEFORE)), sql4("value - max(value) FILTER (point = 4) OVER (PARTITION BY epoch_id, channel)"))
for _name, _ew, _part, _order in (("crossings", True, "epoch_id, channel", "point"), ("crossings_across", False, "channel", "epoch_id, point")):
    register(
        _name,
        lambda spark, d, e=_ew: trace.crossings(epochs4(spark, d), 0.05, epochwise=e).select("epoch_id", "channel", "point", "code"),
        f"WITH {S4}, c AS (SELECT *, CASE WHEN value >= 0.05 THEN 1 ELSE -1 END AS code FROM s), l AS (SELECT *, lag(code) OVER (PARTITION BY {_part} ORDER BY {_order}) AS p FROM c) SELECT epoch_id, channel, point, code FROM l WHERE code <> p",
    )
register(
    "extrema",
    lambda spark, d: trace.extrema(epochs4(spark, d), 0.1).select("epoch_id", "channel", "point", "code"),
    f"""WITH {S4}, l AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM s WINDOW w AS (PARTITION BY epoch_id, channel ORDER BY point)),
 c AS (SELECT *, CASE WHEN value >= 0.1 AND a < value AND b <= value THEN 1 WHEN value <= -0.1 AND a > value AND b >= value THEN -1 END AS code FROM l) SELECT epoch_id, channel, point, code FROM c WHERE code IS NOT NULL""",
)
register(
    "crossings_refractory",
    lambda spark, d: trace.refractory(trace.crossings(epochs1(spark, d), 0.0), 6).select("epoch_id", "channel", "point", "code"),
    f"""WITH RECURSIVE {S1}, l AS (SELECT *, lag(value) OVER (PARTITION BY epoch_id ORDER BY point) AS a FROM s), c AS MATERIALIZED (SELECT epoch_id, channel, point, CASE WHEN value >= 0 THEN 1 ELSE -1 END AS code FROM l WHERE a IS NOT NULL AND (value >= 0) <> (a >= 0)),
 k(epoch_id, point) AS (SELECT epoch_id, min(point) FROM c GROUP BY 1 UNION ALL SELECT k.epoch_id, (SELECT min(c.point) FROM c WHERE c.epoch_id = k.epoch_id AND c.point >= k.point + 6) FROM k WHERE k.point IS NOT NULL)
 SELECT c.epoch_id, c.channel, c.point, c.code FROM c JOIN k USING (epoch_id, point)""",
)

# ------------------------------------------------------------------ rejection

SPAN = ", b AS (SELECT epoch_id, channel, max(value) - min(value) AS span FROM s GROUP BY ALL)"
register("reject_bandwidth", lambda spark, d: out(reject.reject_bandwidth(epochs4(spark, d), 0.55)), sql4("value", rest="FROM s WHERE epoch_id NOT IN (SELECT epoch_id FROM b WHERE span >= 0.55)", with_=SPAN))
register("reject_bandwidth_channels", lambda spark, d: out(reject.reject_bandwidth(epochs4(spark, d), 0.45, channels_only=True)), sql4("value", "s.epoch_id, s.channel, s.point", "FROM s JOIN b USING (epoch_id, channel) WHERE span < 0.45", SPAN))


def _thresholds(spark: SparkSession, d: str) -> DataFrame:
    limits = spark.createDataFrame([("A1", 0.4), ("A3", 0.6)], "channel string, threshold double")
    return out(reject.reject_bandwidth(epochs4(spark, d), 0.55, thresholds=limits))


register("reject_bandwidth_thresholds", _thresholds, sql4("value", rest="FROM s WHERE epoch_id NOT IN (SELECT epoch_id FROM b WHERE span >= CASE channel WHEN 'A1' THEN 0.4 WHEN 'A3' THEN 0.6 ELSE 0.55 END)", with_=SPAN))
register("reject_overflow", lambda spark, d: out(reject.reject_overflow(epochs4(spark, d), 0.4)), sql4("value", rest="FROM s WHERE epoch_id NOT IN (SELECT epoch_id FROM s WHERE abs(value) > 0.4)"))


def metadata(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("epoch_id"), F.col("label").alias("condition"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("comment"), F.lit(POINTS).alias("n_points"), F.lit(BEFORE).alias("beforetrig"), F.lit(100.0).alias("sfreq"), F.lit(1).cast("long").alias("nrofaverages"))


MD = "m AS (SELECT vec_id AS epoch_id, label AS condition, 'label ' || CAST(label AS VARCHAR) AS comment FROM embeddings)"
for _name, _args, _where in (
    ("assert_equal", ("condition", "==", 3), "condition = 3"),
    ("assert_less", ("condition", "<", 4), "condition < 4"),
    ("assert_substring", ("comment", "=~", "l 7"), "contains(comment, 'l 7')"),
    ("assert_not_substring", ("comment", "!~", "7"), "NOT contains(comment, '7')"),
):
    register(_name, lambda spark, d, a=_args: reject.assert_epochs(metadata(spark, d), *a).select("epoch_id", "condition", "comment"), f"WITH {MD} SELECT epoch_id, condition, comment FROM m WHERE {_where}")
register("assert_stop", lambda spark, d: reject.assert_epochs(metadata(spark, d), "condition", "!=", 9, stop=True).select("epoch_id", "condition"), f"WITH {MD} SELECT epoch_id, condition FROM m WHERE epoch_id < coalesce((SELECT min(epoch_id) FROM m WHERE condition = 9), 1000000000)")
register(
    "counters",
    lambda spark, d: reject.counters(metadata(spark, d), F.col("condition") < 7).select("epoch_id", "accepted_epochs", "rejected_epochs"),
    f"WITH {MD} SELECT epoch_id, CAST(coalesce(sum(CASE WHEN condition < 7 THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS accepted_epochs, CAST(coalesce(sum(CASE WHEN condition < 7 THEN 0 ELSE 1 END) OVER w, 0) AS BIGINT) AS rejected_epochs FROM m WINDOW w AS (ORDER BY epoch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
)

# ------------------------------------------------------------------ shape

register("remove_channels", lambda spark, d: out(shape.remove_channels(epochs4(spark, d), "A2,A3")), sql4("value", rest="FROM s WHERE channel NOT IN ('A2', 'A3')"))
register("keep_channels", lambda spark, d: out(shape.keep_channels(epochs4(spark, d), "A3,A1"), "epoch_id", "channel", "channel_idx", "point"), sql4("value", "epoch_id, channel, CASE channel WHEN 'A3' THEN 0 ELSE 1 END AS channel_idx, point", "FROM s WHERE channel IN ('A3', 'A1')"))
register("remove_channel_ranges", lambda spark, d: out(shape.remove_channel_ranges(epochs4(spark, d), [(2, 3)])), sql4("value", rest="FROM s WHERE NOT channel_idx + 1 BETWEEN 2 AND 3"))
register(
    "extract_items",
    lambda spark, d: shape.extract_items(complex_items(spark, d), [1, 0, 1]).select("epoch_id", "channel", "point", *[plain(F.col("items")[k], 6).alias(f"i{k}") for k in range(3)]),
    f"WITH {S4}{C2} SELECT epoch_id, channel, point, round(im, 6) + 0.0 AS i0, round(re, 6) + 0.0 AS i1, round(im, 6) + 0.0 AS i2 FROM z",
)
for _how, _agg in (("mean", "avg"), ("sum", "sum"), ("max", "max"), ("min", "min")):
    register(
        f"collapse_channels_{_how}",
        lambda spark, d, h=_how: out(shape.collapse_channels(epochs4(spark, d), {"left": "A1-A2", "mid": "A2,A3", "all": "ALL"}, h)),
        sql4(f"{_agg}(value)", "epoch_id, g AS channel, point", "FROM s JOIN (VALUES ('left', 'A1'), ('left', 'A2'), ('mid', 'A2'), ('mid', 'A3'), ('all', 'A1'), ('all', 'A2'), ('all', 'A3'), ('all', 'A4')) t(g, c) ON channel = c GROUP BY epoch_id, g, point"),
    )
register(
    "trim",
    lambda spark, d: out(shape.trim(epochs4(spark, d), [(-2, 5), (10, 8)])),
    sql4("coalesce(s.value, 0)", "n.epoch_id, n.channel, n.point", "FROM n LEFT JOIN s ON s.epoch_id = n.epoch_id AND s.channel = n.channel AND s.point = n.f", ", n AS (SELECT DISTINCT epoch_id, channel, k.point, k.f FROM s, (SELECT CAST(range AS INTEGER) AS point, CASE WHEN range < 5 THEN range - 2 ELSE range + 5 END AS f FROM range(13)) k)"),
)
for _how, _agg in (("mean", "sum(value) / max(d)"), ("sum", "sum(value)"), ("max", "max(value)"), ("min", "min(value)")):
    register(
        f"trim_collapse_{_how}",
        lambda spark, d, h=_how: out(shape.trim(epochs4(spark, d), [(-2, 5), (10, 8)], h)),
        sql4(_agg, "epoch_id, channel, r AS point", "FROM s JOIN (VALUES (0, 0, 2, 5), (1, 10, 17, 6)) t(r, a, b, d) ON point BETWEEN a AND b GROUP BY epoch_id, channel, r"),
    )
register(
    "trim_runs",
    lambda spark, d: shape.runs_where(epochs4(spark, d), "A1", 0.0, 1.0).select("epoch_id", "offset", "length"),
    f"WITH {S4}, i AS (SELECT epoch_id, point, point - row_number() OVER (PARTITION BY epoch_id ORDER BY point) AS g FROM s WHERE channel = 'A1' AND value BETWEEN 0 AND 1) SELECT epoch_id, min(point) AS offset, CAST(count(*) AS INTEGER) AS length FROM i GROUP BY epoch_id, g",
)
register("swap_fc", lambda spark, d: out(shape.swap_fc(epochs1(spark, d), 100.0, 0.5)), sql4("value", "epoch_id, printf('%.2fHz', point * 0.5) AS channel, 0 AS point", base=S1))
register("swap_ic", lambda spark, d: out(shape.swap_ic(epochs4(spark, d).withColumn("item", F.lit(0))), "epoch_id", "channel", "point", "item"), sql4("value", "epoch_id, '1' AS channel, point, channel_idx AS item"))
register("swap_ix", lambda spark, d: out(shape.swap_ix(epochs4(spark, d).withColumn("item", F.lit(0))), "epoch_id", "channel", "point", "item"), sql4("value", "epoch_id, channel, 0 AS point, point AS item"))
register("change_axes", lambda spark, d: out(shape.change_axes(x_axis(epochs4(spark, d), 100.0, BEFORE), 5.0, 0.5), "epoch_id", "channel", "point", value="x"), f"WITH {S4} SELECT epoch_id, channel, point, round(((point - 4) * 10.0::DOUBLE + 5) * 0.5, 6) + 0.0 AS x FROM s")
register("add_zero_channel", lambda spark, d: out(shape.add_zero_channel(epochs4(spark, d), "Z")), sql4("value", rest="FROM s UNION ALL SELECT DISTINCT epoch_id, 'Z', point, 0.0 FROM s"))
register("set_comment", lambda spark, d: shape.set_comment(metadata(spark, d), "; seen", "append").select("epoch_id", "comment"), f"WITH {MD} SELECT epoch_id, comment || '; seen' AS comment FROM m")
register("set_values", lambda spark, d: shape.set_values(metadata(spark, d), sfreq=250.0, leaveright=1).select("epoch_id", "sfreq", "leaveright"), f"WITH {MD} SELECT epoch_id, 250.0::DOUBLE AS sfreq, 1 AS leaveright FROM m")
register("query_metadata", lambda spark, d: shape.query(metadata(spark, d), "sfreq", "aftertrig", "condition"), f"WITH {MD} SELECT epoch_id, 100.0::DOUBLE AS sfreq, 12 AS aftertrig, condition FROM m")


def _set_trigger(spark: SparkSession, d: str) -> DataFrame:
    none = spark.createDataFrame([], "epoch_id long, position long, code int, description string")
    return shape.add_trigger(none, metadata(spark, d), 40, 7).select("epoch_id", "position", "code")


register("set_trigger", _set_trigger, f"WITH {MD} SELECT epoch_id, CAST(15 AS BIGINT) AS position, 7 AS code FROM m")


def _import_point(spark: SparkSession, d: str) -> DataFrame:
    values = spark.createDataFrame([("A1", 1.5), ("A4", -1.0)], "channel string, value double")
    return out(shape.import_point(epochs4(spark, d), 3, values))


register("import_point", _import_point, sql4("CASE WHEN point = 3 AND channel = 'A1' THEN 1.5 WHEN point = 3 AND channel = 'A4' THEN -1.0 ELSE value END"))
register("export_point", lambda spark, d: out(shape.export_point(epochs4(spark, d), 5), "epoch_id", "channel"), sql4("value", "epoch_id, channel", "FROM s WHERE point = 5"))
register("link_order", lambda spark, d: out(shape.link_order(epochs4(spark, d).withColumn("dataset_no", F.col("condition") + 1), [3, 1]), "dataset_no", "epoch_id", "channel", "point"), sql4("value", "CASE condition WHEN 2 THEN 1 ELSE 2 END AS dataset_no, epoch_id, channel, point", "FROM s WHERE condition IN (2, 0)"))
register("push", lambda spark, d: out(shape.push(epochs4(spark, d).withColumn("dataset_no", F.col("condition") + 1)), "dataset_no", "epoch_id", "channel", "point"), sql4("value", "condition + 1 AS dataset_no, epoch_id, channel, point", "FROM (SELECT * FROM s UNION ALL SELECT epoch_id, condition + 1, channel_idx, channel, point, value FROM s WHERE condition = (SELECT max(condition) FROM s))"))
register("pop", lambda spark, d: out(shape.pop(epochs4(spark, d).withColumn("dataset_no", F.col("condition") + 1)), "dataset_no", "epoch_id", "channel", "point"), sql4("value", "condition + 1 AS dataset_no, epoch_id, channel, point", "FROM s WHERE condition < (SELECT max(condition) FROM s)"))

# ------------------------------------------------------------------ collection

register("average", lambda spark, d: out(collect.average(epochs4(spark, d), by=["condition"]), "condition", "channel", "point"), sql4("avg(value)", "condition, channel, point", "FROM s GROUP BY condition, channel, point"))
register(
    "average_weighted",
    lambda spark, d: out(collect.average(epochs4(spark, d).withColumn("w", F.col("condition") + 1), weight="w"), "channel", "point"),
    sql4("sum(value * (condition + 1)) / sum(condition + 1)", "channel, point", "FROM s GROUP BY channel, point"),
)
register(
    "average_by_name",
    lambda spark, d: collect.average(epochs4(spark, d).where("condition < 5 or channel != 'A4'")).select("channel", "point", plain(F.col("value"), 6).alias("value"), "n"),
    f"WITH {S4} SELECT channel, point, round(avg(value), 6) + 0.0 AS value, count(*) AS n FROM s WHERE condition < 5 OR channel <> 'A4' GROUP BY channel, point",
)
register(
    "average_sums",
    lambda spark, d: collect.average(epochs4(spark, d), by=["condition"], leave_sums=True).select("condition", "channel", "point", plain(F.col("sum"), 6).alias("sum"), plain(F.col("sumsq"), 6).alias("sumsq"), "n"),
    f"WITH {S4} SELECT condition, channel, point, round(sum(value), 6) + 0.0 AS sum, round(sum(value * value), 6) + 0.0 AS sumsq, count(*) AS n FROM s GROUP BY condition, channel, point",
)
register(
    "average_t",
    lambda spark, d: collect.average(epochs4(spark, d), by=["condition"], t_test=True).select("condition", "channel", "point", plain(F.col("value"), 6).alias("value"), plain(F.col("t"), 4).alias("t"), "n"),
    f"WITH {S4} SELECT condition, channel, point, round(avg(value), 6) + 0.0 AS value, round(avg(value) / (stddev_samp(value) / sqrt(count(*))), 4) + 0.0 AS t, count(*) AS n FROM s GROUP BY condition, channel, point",
)
register("average_t_p", lambda spark, d: collect.average(epochs4(spark, d), by=["condition"], t_test=True).select("condition", "channel", "point", plain(F.col("p"), 5).alias("p")))
register(
    "average_sign",
    lambda spark, d: collect.average(epochs4(spark, d), by=["condition"], sign_test=True, beforetrig=BEFORE).select("condition", "channel", "point", "n_above", "n_below"),
    f"WITH {S4}, b AS (SELECT *, avg(value) FILTER (point < 4) OVER (PARTITION BY epoch_id, channel) AS base FROM s) SELECT condition, channel, point, sum(CASE WHEN value > base THEN 1.0::DOUBLE ELSE 0 END) AS n_above, sum(CASE WHEN value > base THEN 0 ELSE 1.0::DOUBLE END) AS n_below FROM b GROUP BY condition, channel, point",
)
register(
    "average_votes",
    lambda spark, d: out(collect.sign_votes(epochs4(spark, d).drop("condition"), BEFORE), "channel", "point"),
    sql4("avg(v)", "channel, point", "FROM v GROUP BY channel, point", ", v AS (SELECT a.epoch_id, a.channel, a.point, avg(CASE WHEN a.value > b.value THEN 1.0 ELSE -1.0 END) AS v FROM s a JOIN s b ON a.epoch_id = b.epoch_id AND a.channel = b.channel AND b.point < 4 AND a.point <> b.point GROUP BY ALL)"),
)
register("append_points", lambda spark, d: out(collect.append_points(epochs4(spark, d)), "channel", "point"), sql4("value", "channel, CAST(point + 16 * (dense_rank() OVER (ORDER BY epoch_id) - 1) AS BIGINT) AS point"))
register("append_channels", lambda spark, d: out(collect.append_channels(epochs4(spark, d)), "channel", "point"), sql4("value", "channel || '@' || CAST(epoch_id AS VARCHAR) AS channel, point"))
register("append_items", lambda spark, d: out(collect.append_items(epochs4(spark, d)), "channel", "point", "item"), sql4("value", "channel, point, CAST(dense_rank() OVER (ORDER BY epoch_id) - 1 AS INTEGER) AS item"))
register("append_datasets", lambda spark, d: out(collect.append_datasets(epochs4(spark, d)), "dataset_no", "channel", "point"), sql4("value", "CAST(dense_rank() OVER (ORDER BY epoch_id) AS INTEGER) AS dataset_no, channel, point"))
for _name, _kw, _keys, _bin, _where in (
    ("histogram", {}, "channel", "CAST(round_even((value + 0.3) / 0.06, 0) AS INTEGER)", "WHERE bin BETWEEN 0 AND 9"),
    ("histogram_outliers", {"keep_outliers": True}, "channel", "greatest(0, least(9, CAST(round_even((value + 0.3) / 0.06, 0) AS INTEGER)))", ""),
    ("histogram_points", {"by_channel": False, "by_point": True}, "point", "CAST(round_even((value + 0.3) / 0.06, 0) AS INTEGER)", "WHERE bin BETWEEN 0 AND 9"),
):
    register(
        _name,
        lambda spark, d, k=_kw, g=_keys: collect.histogram(epochs4(spark, d), -0.3, 0.3, 10, **k).select(g, "bin", F.col("count").alias("n")),
        f"WITH {S4}, b AS (SELECT *, {_bin} AS bin FROM s) SELECT {_keys}, bin, count(*) AS n FROM b {_where} GROUP BY {_keys}, bin",
    )
register(
    "histogram_lineitem",
    lambda spark, d: collect.histogram(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("channel"), F.col("l_extendedprice").alias("value")), 0.0, 100000.0, 50).select("channel", "bin", F.col("count").alias("n")),
    "SELECT channel, bin, count(*) AS n FROM (SELECT l_returnflag AS channel, CAST(round_even(l_extendedprice / 2000.0, 0) AS INTEGER) AS bin FROM lineitem) WHERE bin BETWEEN 0 AND 49 GROUP BY ALL",
)
for _name, _kw, _keys in (("minmax", {}, ["channel", "point"]), ("minmax_points", {"by_channel": False}, ["point"]), ("minmax_channels", {"by_point": False}, ["channel"]), ("minmax_all", {"by_channel": False, "by_point": False}, [])):
    register(
        _name,
        lambda spark, d, k=_kw, g=_keys: collect.minmax(epochs4(spark, d), **k).select(*g, plain(F.col("min"), 6).alias("low"), plain(F.col("max"), 6).alias("high")),
        f"WITH {S4} SELECT {''.join(k + ', ' for k in _keys)}round(min(value), 6) + 0.0 AS low, round(max(value), 6) + 0.0 AS high FROM s {'GROUP BY ' + ', '.join(_keys) if _keys else ''}",
    )

# ------------------------------------------------------------------ joins


def _side(spark: SparkSession, d: str, points: int = POINTS, channels: int = CHANNELS) -> DataFrame:
    """The mean of all epochs, or its first channels and points."""
    return collect.average(epochs4(spark, d).drop("condition")).where((F.col("point") < points) & (F.col("channel_idx") < channels)).select("channel_idx", "channel", "point", "value")


A4 = ", a AS (SELECT channel_idx, point, avg(value) AS v FROM s GROUP BY ALL)"
for _how, _expr in (("subtract", "s.value - a.v"), ("add", "s.value + a.v"), ("mean", "(s.value + a.v) / 2"), ("wmean", "(s.value * 1 + a.v * 3) / 4"), ("multiply", "s.value * a.v"), ("divide", "s.value / a.v")):
    _digits = 2 if _how == "divide" else 6
    register(f"side_{_how}", lambda spark, d, h=_how, n=_digits: out(joins.subtract(epochs4(spark, d), _side(spark, d), h, weights=(1.0, 3.0)), digits=n), sql4(_expr, "s.epoch_id, s.channel, s.point", "FROM s JOIN a USING (channel_idx, point)", A4, digits=_digits))
register(
    "side_recycled",
    lambda spark, d: out(joins.subtract(epochs4(spark, d), _side(spark, d, 5, 2), recycle_channels=True, recycle_points=True)),
    sql4("s.value - a.v", "s.epoch_id, s.channel, s.point", "FROM s JOIN a ON a.channel_idx = s.channel_idx % 2 AND a.point = s.point % 5", A4),
)
register("side_truncated", lambda spark, d: out(joins.subtract(epochs4(spark, d), _side(spark, d, 5, 2))), sql4("CASE WHEN s.point < 5 AND s.channel_idx < 2 THEN s.value - a.v ELSE s.value END", "s.epoch_id, s.channel, s.point", "FROM s JOIN a USING (channel_idx, point)", A4))
register(
    "side_epochwise",
    lambda spark, d: out(joins.subtract_epochwise(epochs4(spark, d), epochs4(spark, d).withColumn("value", F.col("value") * 0.5))),
    sql4("value - 0.5 * value"),
)


def _complex_side(spark: SparkSession, d: str, how: str) -> DataFrame:
    df = complex_channels(spark, d).withColumn("channel_idx", F.substring("channel", 2, 1).cast("int") - 1)
    side = df.where("epoch_id = 0").select("channel_idx", "point", "items")
    return joins.complex_subtract(df, side, how).select("epoch_id", "channel", "point", plain(F.col("items")[0], 4).alias("a"), plain(F.col("items")[1], 4).alias("b"))


CZ = f"""WITH {S4}, z AS (SELECT epoch_id, 'Z' || CAST(channel_idx // 2 + 1 AS VARCHAR) AS channel, point, max(value) FILTER (channel_idx % 2 = 0) AS re, max(value) FILTER (channel_idx % 2 = 1) AS im FROM s GROUP BY ALL),
 y AS (SELECT channel, point, re AS c, im AS d FROM z WHERE epoch_id = 0)"""
register("side_complex_multiply", lambda spark, d: _complex_side(spark, d, "multiply"), CZ + " SELECT epoch_id, channel, point, round(re * c + im * d, 4) + 0.0 AS a, round(im * c - re * d, 4) + 0.0 AS b FROM z JOIN y USING (channel, point)")
register("side_complex_divide", lambda spark, d: _complex_side(spark, d, "divide"), CZ + " SELECT epoch_id, channel, point, round((re * c - im * d) / (c * c + d * d), 4) + 0.0 AS a, round((im * c + re * d) / (c * c + d * d), 4) + 0.0 AS b FROM z JOIN y USING (channel, point)")


def _two_sample(spark: SparkSession, d: str) -> DataFrame:
    one = lambda k: collect.average(epochs4(spark, d).where(F.col("condition") == k).drop("condition"), leave_sums=True)
    return joins.two_sample_t(one(0), one(1)).select("channel", "point", plain(F.col("value"), 6).alias("value"), plain(F.col("t"), 4).alias("t"))


register(
    "two_sample_t",
    _two_sample,
    f"""WITH {S4}, g AS (SELECT condition, channel, point, avg(value) AS m, var_pop(value) * count(*) AS ss, count(*) AS n FROM s WHERE condition < 2 GROUP BY ALL)
 SELECT a.channel, a.point, round(a.m - b.m, 6) + 0.0 AS value, round((a.m - b.m) / sqrt((a.ss + b.ss) / (a.n + b.n - 2)) * sqrt(a.n * b.n / (a.n + b.n)::DOUBLE), 4) + 0.0 AS t FROM g a JOIN g b ON a.channel = b.channel AND a.point = b.point WHERE a.condition = 0 AND b.condition = 1""",
)


def _add_channels(spark: SparkSession, d: str, along: str) -> DataFrame:
    df = epochs4(spark, d).select("epoch_id", "channel", "point", "value")
    side = df.where("epoch_id = 0 and channel = 'A1'")
    return out(joins.add_channels(df, side.withColumn("channel", F.lit("S")) if along == "channel" else df.where("epoch_id = 0"), along))


register("add_channels", lambda spark, d: _add_channels(spark, d, "channel"), sql4("value", rest="FROM s UNION ALL SELECT e.epoch_id, 'S', o.point, round(o.value, 6) + 0.0 FROM (SELECT DISTINCT epoch_id FROM s) e, (SELECT * FROM s WHERE epoch_id = 0 AND channel = 'A1') o"))
register("add_points", lambda spark, d: _add_channels(spark, d, "point"), sql4("value", rest="FROM s UNION ALL SELECT e.epoch_id, o.channel, CAST(o.point + 16 AS INTEGER), round(o.value, 6) + 0.0 FROM (SELECT DISTINCT epoch_id FROM s) e, (SELECT * FROM s WHERE epoch_id = 0) o"))


def _vectors(spark: SparkSession) -> DataFrame:
    rows = [(k, f"A{c + 1}", float((k + 1) * (c + 1) % 5 - 2)) for k in range(2) for c in range(CHANNELS)]
    return spark.createDataFrame(rows, "k int, channel string, weight double")


VEC = ", v AS (SELECT * FROM (VALUES (0, 'A1', -1.0), (0, 'A2', 0.0), (0, 'A3', 1.0), (0, 'A4', 2.0), (1, 'A1', 0.0), (1, 'A2', 2.0), (1, 'A3', -1.0), (1, 'A4', 1.0)) t(k, channel, w)), u AS (SELECT k, channel, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM v)"
register("project", lambda spark, d: out(joins.project(epochs4(spark, d), _vectors(spark)), "epoch_id", "point", "k"), sql4("sum(value * w)", "epoch_id, point, k", "FROM s JOIN u USING (channel) GROUP BY epoch_id, point, k", VEC))


def _templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, p, float((p * (k + 1)) % 7 - 3)) for k in range(2) for p in range(POINTS)], "k int, point int, weight double")


TMP = ", v AS (SELECT CAST(k AS INTEGER) AS k, CAST(p AS INTEGER) AS point, CAST((p * (k + 1)) % 7 - 3 AS DOUBLE) AS w FROM range(2) a(k), range(16) b(p)), u AS (SELECT k, point, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM v)"
register("correlate", lambda spark, d: out(joins.correlate(epochs4(spark, d).drop("condition"), _templates(spark)), "epoch_id", "channel", "k"), sql4("sum(value * w)", "epoch_id, channel, k", "FROM s JOIN u USING (point) GROUP BY epoch_id, channel, k", TMP))


def _one_vector(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, f"A{c + 1}", 0.5) for c in range(CHANNELS)], "k int, channel string, weight double")


register("project_subspace", lambda spark, d: out(joins.subspace(epochs4(spark, d), _one_vector(spark))), sql4("avg(value) OVER (PARTITION BY epoch_id, point)"))
register("project_removed", lambda spark, d: out(joins.subspace(epochs4(spark, d), _one_vector(spark), remove=True)), sql4("value - avg(value) OVER (PARTITION BY epoch_id, point)"))

# ------------------------------------------------------------------ windows of recordings


def _signal(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = recordings(spark, d)
    marks = r.where("code = 'purchase' or code = 'click'").select("recording", F.col("pos").alias("position"), F.col("code"))
    return r.select("recording", F.lit("V").alias("channel"), "pos", "value"), marks


register(
    "trigger_windows",
    lambda spark, d: joins.trigger_windows(*_signal(spark, d), 2, 3, codes=["purchase"]).select("recording", F.col("epoch_no").cast("long").alias("epoch_no"), "point", plain(F.col("value"), 6).alias("value")),
    f"""WITH {EV}, n AS (SELECT recording, max(pos) + 1 AS n FROM e GROUP BY 1), t AS (SELECT recording, pos - 2 AS a, row_number() OVER (PARTITION BY recording ORDER BY pos) AS epoch_no FROM e JOIN n USING (recording) WHERE code = 'purchase' AND pos - 2 >= 0 AND pos + 3 <= n)
 SELECT recording, epoch_no, CAST(e.pos - a AS INTEGER) AS point, round(value, 6) + 0.0 AS value FROM t JOIN e USING (recording) WHERE e.pos BETWEEN a AND a + 4""",
)
register(
    "trigger_windows_limited",
    lambda spark, d: joins.trigger_windows(*_signal(spark, d), 1, 2, codes=["purchase"], offset=1, first=2, most=3).select("recording", F.col("epoch_no").cast("long").alias("epoch_no"), "point", plain(F.col("value"), 6).alias("value")),
    f"""WITH {EV}, n AS (SELECT recording, max(pos) + 1 AS n FROM e GROUP BY 1), t AS (SELECT recording, pos AS a, row_number() OVER (PARTITION BY recording ORDER BY pos) AS epoch_no FROM e JOIN n USING (recording) WHERE code = 'purchase' AND pos + 3 <= n)
 SELECT recording, epoch_no, CAST(e.pos - a AS INTEGER) AS point, round(value, 6) + 0.0 AS value FROM t JOIN e USING (recording) WHERE epoch_no BETWEEN 2 AND 4 AND e.pos BETWEEN a AND a + 2""",
)
register(
    "continuous_windows",
    lambda spark, d: joins.continuous_windows(_signal(spark, d)[0], 8).select("recording", "epoch_no", "point", plain(F.col("value"), 6).alias("value")),
    f"WITH {EV}, n AS (SELECT recording, max(pos) + 1 AS n FROM e GROUP BY 1) SELECT recording, CAST(pos // 8 + 1 AS INTEGER) AS epoch_no, CAST(pos % 8 AS INTEGER) AS point, round(value, 6) + 0.0 AS value FROM e JOIN n USING (recording) WHERE (pos // 8 + 1) * 8 <= n",
)
register(
    "transferred_triggers",
    lambda spark, d: joins.transferred_triggers(recordings(spark, d).where("pos % 8 = 0").select("recording", (F.floor(F.col("pos") / 8) + 1).alias("epoch_no"), F.col("pos").alias("start")), _signal(spark, d)[1], 8),
    f"WITH {EV} SELECT recording, CAST(pos // 8 + 1 AS BIGINT) AS epoch_no, CAST(pos % 8 AS BIGINT) AS position, code FROM e WHERE code IN ('purchase', 'click')",
)

# ------------------------------------------------------------------ events

register(
    "trials",
    lambda spark, d: paradigm.trials(recordings(spark, d), ["view"], ["click", "purchase"], 0.0, 36000.0).select("recording", plain(F.col("at"), 3).alias("at"), "answered", "response", plain(F.col("rt"), 3).alias("rt")),
    f"""WITH {EV}, k AS (SELECT *, lead(code) OVER w AS nc, lead("at") OVER w AS na FROM e WHERE code IN ('view', 'click', 'purchase') WINDOW w AS (PARTITION BY recording ORDER BY "at", tie)), a AS (SELECT *, coalesce(nc IN ('click', 'purchase') AND na - "at" BETWEEN 0 AND 36000, false) AS answered FROM k WHERE code = 'view')
 SELECT recording, round("at", 3) + 0.0 AS "at", answered, CASE WHEN answered THEN nc END AS response, CASE WHEN answered THEN round(na - "at", 3) + 0.0 END AS rt FROM a""",
)
TQ = "CASE WHEN len(l) = 0 THEN NULL WHEN ceil(len(l) * {q}) >= len(l) THEN l[len(l)] ELSE l[CAST(ceil(len(l) * {q}) AS INTEGER)] * least(len(l) % {m}, 1.0) + l[CAST(ceil(len(l) * {q}) AS INTEGER) + 1] * (1 - least(len(l) % {m}, 1.0)) END"
register(
    "trigger_stats",
    lambda spark, d: paradigm.trigger_stats(recordings(spark, d), ["recording", "code"]).select("recording", "code", "n", *[plain(F.col(c), 3).alias(c) for c in ("mean", "min", "q25", "q50", "q75", "max")]),
    f"""WITH {EV}, d AS (SELECT *, "at" - lag("at") OVER (PARTITION BY recording, code ORDER BY "at", tie) AS d FROM e), g AS (SELECT recording, code, count(*) AS n, avg(d) AS mean, min(d) AS min, max(d) AS max, list_sort(list(d) FILTER (d IS NOT NULL)) AS l FROM d GROUP BY 1, 2)
 SELECT recording, code, n, round(mean, 3) + 0.0 AS mean, round(min, 3) + 0.0 AS min, round({TQ.format(q=0.25, m=4.0)}, 3) + 0.0 AS q25, round({TQ.format(q=0.5, m=2.0)}, 3) + 0.0 AS q50, round({TQ.format(q=0.75, m=1 / 0.75)}, 3) + 0.0 AS q75, round(max, 3) + 0.0 AS max FROM g""",
)


def _ranges(spark: SparkSession, d: str, min_length: float, debounce: float) -> DataFrame:
    c = trace.crossings(epochs1(spark, d), 0.0).select("epoch_id", F.col("point").alias("at"), "code")
    return paradigm.ranges_from_crossings(c, ["epoch_id"], 1, min_length, debounce)


register(
    "ranges",
    lambda spark, d: _ranges(spark, d, 2, 1),
    f"""WITH {S1}, c AS (SELECT *, CASE WHEN value >= 0 THEN 1 ELSE -1 END AS code FROM s), l AS (SELECT *, lag(code) OVER (PARTITION BY epoch_id ORDER BY point) AS p FROM c), x AS (SELECT epoch_id, point AS "at", code, lead(point) OVER (PARTITION BY epoch_id ORDER BY point) AS e FROM l WHERE code <> p),
 r AS (SELECT epoch_id, "at" AS a, e AS b FROM x WHERE code = 1 AND e - "at" >= 2), i AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY epoch_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 1 OR row_number() OVER (PARTITION BY epoch_id ORDER BY a) = 1 THEN 1 ELSE 0 END AS f FROM r),
 g AS (SELECT *, sum(f) OVER (PARTITION BY epoch_id ORDER BY a) AS g FROM i) SELECT epoch_id, min(a) AS start, max(b) AS "end" FROM g GROUP BY epoch_id, g""",
)
register(
    "clear_sections",
    lambda spark, d: paradigm.clear_sections(
        recordings(spark, d).where("code = 'purchase'").select("recording", F.col("pos").cast("double").alias("at")), recordings(spark, d).groupBy("recording").agg(F.lit(0.0).alias("start"), F.max("pos").cast("double").alias("end")), "recording", 1.5
    ).select("recording", "start", "end"),
    f"""WITH {EV}, n AS (SELECT recording, max(pos)::DOUBLE AS n FROM e GROUP BY 1), b AS (SELECT recording, pos - 1.5 AS f, pos + 1.5 AS t FROM e WHERE code = 'purchase' UNION ALL SELECT recording, 0.0, 0.0 FROM n UNION ALL SELECT recording, n, n FROM n),
 g AS (SELECT recording, max(t) OVER (PARTITION BY recording ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, f AS z FROM b), c AS (SELECT recording, greatest(a, 0.0)::DOUBLE AS start, least(z, n)::DOUBLE AS "end" FROM g JOIN n USING (recording) WHERE a IS NOT NULL) SELECT * FROM c WHERE "end" > start""",
)
register(
    "section_windows",
    lambda spark, d: paradigm.windows_in_sections(recordings(spark, d).groupBy("recording").agg(F.lit(0.0).alias("start"), F.max("pos").cast("double").alias("end")), 10.0, 7.5).select("recording", "at"),
    f"WITH {EV}, n AS (SELECT recording, max(pos)::DOUBLE AS n FROM e GROUP BY 1) SELECT recording, (k * 7.5)::DOUBLE AS at FROM n, range(10000) t(k) WHERE k * 7.5 + 10 <= n",
)
register(
    "measure",
    lambda spark, d: paradigm.measure(x_axis(epochs4(spark, d), 100.0, BEFORE), [("early", -20.0, 30.0), ("late", 40.0, 100.0)]).select("epoch_id", "channel", "range", plain(F.col("amplitude"), 6).alias("amplitude"), plain(F.col("latency"), 4).alias("latency")),
    f"""WITH {S4}, r AS (SELECT epoch_id, channel, g AS range, (point - 4) * 10.0 AS x, value, value - min(value) OVER (PARTITION BY epoch_id, channel, g) AS w FROM s JOIN (VALUES ('early', -20, 30), ('late', 40, 100)) t(g, a, b) ON (point - 4) * 10 BETWEEN a AND b)
 SELECT epoch_id, channel, range, round(avg(value), 6) + 0.0 AS amplitude, round(sum(w * x) / sum(w), 4) + 0.0 AS latency FROM r GROUP BY ALL""",
)
JUMP = f"""WITH {S4}, d AS (SELECT epoch_id, channel, point, abs(value - lag(value) OVER (PARTITION BY epoch_id, channel ORDER BY point)) AS value FROM s), k AS (SELECT * FROM d WHERE value IS NOT NULL),
 m AS (SELECT epoch_id, channel, {SQL_Q.format(q=0.5)} AS m FROM k GROUP BY 1, 2), h AS (SELECT epoch_id, point, max(value / m) AS highest, min(value / m) AS lowest FROM k JOIN m USING (epoch_id, channel) GROUP BY 1, 2)"""
register("jump_scores", lambda spark, d: paradigm.jump_scores(epochs4(spark, d)).select("epoch_id", "point", plain(F.col("highest"), 4).alias("highest"), plain(F.col("lowest"), 4).alias("lowest")), JUMP + " SELECT epoch_id, point, round(highest, 4) + 0.0 AS highest, round(lowest, 4) + 0.0 AS lowest FROM h")
register("artifact_jumps", lambda spark, d: paradigm.artifacts(epochs4(spark, d), 3.0)[0], JUMP + " SELECT epoch_id, point FROM h WHERE highest >= 3")
register(
    "artifact_jump_peaks",
    lambda spark, d: paradigm.jump_peaks(epochs4(spark, d), 3.0),
    JUMP + ", n AS (SELECT *, lag(highest) OVER (PARTITION BY epoch_id ORDER BY point) AS before, lead(highest) OVER (PARTITION BY epoch_id ORDER BY point) AS after FROM h) SELECT epoch_id, point FROM n WHERE highest >= 3 AND before < highest AND after <= highest",
)
register(
    "sessions",
    lambda spark, d: recordings(spark, d).withColumn("_p", F.lag("at").over(Window.partitionBy("recording").orderBy("at", "tie"))).withColumn("_n", F.coalesce((F.col("at") - F.col("_p") > 43200).cast("int"), F.lit(1))).withColumn("session", F.sum("_n").over(Window.partitionBy("recording").orderBy("at", "tie"))).groupBy("recording", "session").agg(F.count("*").alias("n"), plain(F.sum("value"), 4).alias("value")),
    f"""WITH {EV}, p AS (SELECT *, CASE WHEN "at" - lag("at") OVER w > 43200 OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS f FROM e WINDOW w AS (PARTITION BY recording ORDER BY "at", tie)), q AS (SELECT *, CAST(sum(f) OVER (PARTITION BY recording ORDER BY "at", tie) AS BIGINT) AS session FROM p) SELECT recording, session, count(*) AS n, round(sum(value), 4) + 0.0 AS value FROM q GROUP BY 1, 2""",
)
register(
    "not_near",
    lambda spark, d: joins.not_near(recordings(spark, d).where("code = 'view'").select("recording", "at", "tie"), recordings(spark, d).where("code = 'purchase'").select("recording", "at"), "recording", 3600.0).select("recording", "tie"),
    f"""WITH {EV} SELECT recording, tie FROM e v WHERE code = 'view' AND NOT EXISTS (SELECT 1 FROM e p WHERE p.recording = v.recording AND p.code = 'purchase' AND abs(p."at" - v."at") < 3600)""",
)
register(
    "overlapping",
    lambda spark, d: joins.overlapping(
        recordings(spark, d).where("code = 'view'").select("recording", F.col("at").alias("start"), (F.col("at") + 5000).alias("end")), recordings(spark, d).where("code = 'click'").select("recording", F.col("at").alias("start"), (F.col("at") + 3000).alias("end")), "recording", 5000.0
    ).select("recording", *[plain(F.col(c), 3).alias(c) for c in ("a_start", "b_start")]),
    f"""WITH {EV} SELECT a.recording, round(a."at", 3) + 0.0 AS a_start, round(b."at", 3) + 0.0 AS b_start FROM e a JOIN e b USING (recording) WHERE a.code = 'view' AND b.code = 'click' AND a."at" < b."at" + 3000 AND b."at" < a."at" + 5000""",
)
register(
    "conversation_turns",
    lambda spark, d: paradigm.trials(table(spark, d, "conversations").select(F.col("conv_id").alias("recording"), F.col("turn").cast("double").alias("at"), F.col("role").alias("code"), F.col("turn").alias("tie")), ["user"], ["assistant"], 0.0, 1.0).groupBy("answered").agg(F.count("*").alias("n")),
    "WITH k AS (SELECT *, lead(role) OVER w AS nr, lead(turn) OVER w AS nt FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT coalesce(nr = 'assistant' AND nt - turn BETWEEN 0 AND 1, false) AS answered, count(*) AS n FROM k WHERE role = 'user' GROUP BY 1",
)


# ------------------------------------------------------------------ the flagship


def evoked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as epochs of one channel: baseline off, wide ones rejected, averaged by label with t, and the mean's size in dB."""
    df = reject.reject_bandwidth(elementwise.baseline_subtract(epochs1(spark, sf_dir), 16), 0.6)
    a = collect.average(df, by=["condition"], t_test=True)
    return a.select("condition", "channel", "point", plain(F.col("value"), 6).alias("value"), plain(F.col("t"), 4).alias("t"), "n")


register(
    "evoked",
    evoked,
    f"""WITH {S1}, b AS (SELECT *, value - avg(value) FILTER (point < 16) OVER (PARTITION BY epoch_id) AS v FROM s), k AS (SELECT epoch_id FROM b GROUP BY 1 HAVING max(v) - min(v) < 0.6)
 SELECT condition, channel, point, round(avg(v), 6) + 0.0 AS value, round(avg(v) / (stddev_samp(v) / sqrt(count(*))), 4) + 0.0 AS t, count(*) AS n FROM b JOIN k USING (epoch_id) GROUP BY 1, 2, 3""",
)


def trace_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(epochs1(spark, sf_dir))

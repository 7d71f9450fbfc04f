"""Registered queries that go through files: tables are written as recordings of a format, read again, and held against the table;
and the scripts that exercise simulated recordings.

Recordings are the vectors of one label, one after another by id, as 4 channels of 16 points each. Their files go to the folder all executors share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.maths import plain
from .operators import collect, elementwise, joins, paradigm, shape
from .plans.script import compile_script
from .queries import POINTS, S4, epochs4, metadata, out, register
from .sources import files, simulate
from .streaming.run import shared_folder

# ------------------------------------------------------------------ tables through files


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def label_recordings(spark: SparkSession, d: str) -> DataFrame:
    """(recording, sfreq, channel_idx, channel, pos, value)."""
    df = epochs4(spark, d)
    order = df.select("epoch_id", "condition").distinct().withColumn("_no", F.row_number().over(Window.partitionBy("condition").orderBy("epoch_id")) - 1)
    at = (F.col("_no") * POINTS + F.col("point")).cast("long")
    return df.join(order.drop("condition"), "epoch_id").select(F.concat(F.lit("label"), F.col("condition").cast("string")).alias("recording"), F.lit(100.0).alias("sfreq"), "channel_idx", "channel", at.alias("pos"), "value")


LR = f"{S4}, o AS (SELECT *, dense_rank() OVER (PARTITION BY condition ORDER BY epoch_id) - 1 AS no FROM s), r AS (SELECT 'label' || CAST(condition AS VARCHAR) AS recording, channel_idx, channel, no * {POINTS} + point AS pos, no, point, value FROM o)"
#: Kinds whose values come back exactly, and how they are written and read.
EXACT = {"brainvision": ({}, {}), "generic": ({"kind": "float64"}, {"kind": "float64", "channels": 4}), "simple_binary": ({}, {}), "parameter_pair": ({}, {})}


def _name(column: str = "recording") -> F.Column:
    return F.regexp_extract(column, r"(label[0-9]+)[^/]*$", 1)


def _stored(kind: str):
    """All samples written as files of one kind and read again; unnamed channels are named by number."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        path, (writing, reading) = folder(spark), EXACT[kind]
        files.write_recordings(label_recordings(spark, d), path, kind, encoding=writing)
        got = files.samples_of(spark, path, kind, **reading)
        return got.select(_name().alias("recording"), "channel_idx", F.col("pos").cast("long").alias("pos"), plain(F.col("value"), 6).alias("value"))

    return query


for _kind in EXACT:
    register(f"files_{_kind}", _stored(_kind), f"WITH {LR} SELECT recording, channel_idx, CAST(pos AS BIGINT) AS pos, round(value, 6) + 0.0 AS value FROM r")


def _quantised(kind: str, step: float):
    """Formats of 16 bits: values come back within a step of what was written."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        path, df = folder(spark), label_recordings(spark, d)
        files.write_recordings(df, path, kind)
        got = files.samples_of(spark, path, kind).select(_name().alias("recording"), "channel_idx", "pos", F.col("value").alias("_v"))
        near = F.abs(F.col("value") - F.col("_v")) <= step
        return df.join(got, ["recording", "channel_idx", "pos"]).groupBy("recording", "channel_idx").agg(F.count("*").alias("n"), F.sum(near.cast("long")).alias("near"))

    return query


for _kind, _step in (("edf", 1e-3), ("wave", 1e-3), ("cnt", 0.01), ("words", 0.06), ("fields", 0.006), ("volts", 1e-6)):
    register(f"files_{_kind}", _quantised(_kind, _step), f"WITH {LR} SELECT recording, channel_idx, count(*) AS n, count(*) AS near FROM r GROUP BY ALL")


def _epoch_files(binary: bool):
    def query(spark: SparkSession, d: str) -> DataFrame:
        path = folder(spark)
        files.write_epochs(epochs4(spark, d).withColumn("recording", F.concat(F.lit("label"), F.col("condition").cast("string"))), path, 100.0, binary=binary)
        got = files.read_epochs(spark, path)
        return got.select(_name().alias("recording"), F.col("epoch_no").cast("long").alias("no"), "channel", "point", plain(F.col("value"), 6).alias("value"))

    return query


for _name_, _binary in (("text", False), ("binary", True)):
    register(f"files_epochs_{_name_}", _epoch_files(_binary), f"WITH {LR} SELECT recording, CAST(no AS BIGINT) AS no, channel, point, round(value, 6) + 0.0 AS value FROM r")


def _read_script(spark: SparkSession, d: str) -> DataFrame:
    """A script that reads files in epochs of 16 points from the second on, takes the maps' means out, and averages."""
    path = folder(spark)
    files.write_recordings(label_recordings(spark, d), path, "brainvision")
    return out(compile_script(f"read_brainvision -c -f 2 {path} 0 {POINTS}\ndemean_maps\naverage", {}, spark=spark).frame(), "channel", "point")


register("script_reader", _read_script, f"WITH {LR} SELECT channel, point, round(avg(value - m), 6) + 0.0 AS value FROM (SELECT *, avg(value) OVER (PARTITION BY recording, no, point) AS m FROM r) WHERE no > 0 GROUP BY channel, point")


def _marked(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """The recordings as files with a trigger at point 4 of each vector, whose code is 1 + number mod 3."""
    path, df = folder(spark), label_recordings(spark, d)
    marks = df.where(F.col("channel_idx") == 0).where(F.col("pos") % POINTS == 4).select("recording", F.col("pos").alias("position"), (F.floor(F.col("pos") / POINTS) % 3 + 1).cast("int").alias("code"))
    files.write_recordings(df, path, "brainvision", marks)
    return path, marks


def _trigger_script(spark: SparkSession, d: str) -> DataFrame:
    path, _ = _marked(spark, d)
    return out(compile_script(f"read_brainvision -t 1,3 {path} 20ms 80ms\naverage", {}, spark=spark).frame(), "channel", "point")


register("script_triggers", _trigger_script, f"WITH {LR} SELECT channel, CAST(point - 2 AS INTEGER) AS point, round(avg(value), 6) + 0.0 AS value FROM r WHERE point BETWEEN 2 AND 11 AND no % 3 IN (0, 2) GROUP BY channel, point")


def _transferred(spark: SparkSession, d: str) -> DataFrame:
    path, _ = _marked(spark, d)
    got = files.transferred(spark, path, "brainvision", 4, 20)
    return got.select(_name().alias("recording"), "epoch_no", "position", "code")


register(
    "files_transferred",
    _transferred,
    f"""WITH {LR}, t AS (SELECT DISTINCT recording, no * {POINTS} + 4 AS position, CAST(no % 3 + 1 AS INTEGER) AS code FROM r), e AS (SELECT recording, max(pos) + 1 AS e FROM r GROUP BY 1),
 w AS (SELECT recording, position - 4 AS start, CAST(row_number() OVER (PARTITION BY recording ORDER BY position) AS INTEGER) AS epoch_no FROM t JOIN e USING (recording) WHERE position - 4 + 24 <= e)
 SELECT w.recording, w.epoch_no, CAST(t.position - w.start AS BIGINT) AS position, t.code FROM w JOIN t ON t.recording = w.recording AND t.position >= w.start AND t.position < w.start + 24""",
)

# ------------------------------------------------------------------ simulated recordings


def simulated(spark: SparkSession) -> tuple[str, DataFrame]:
    """A simulated recording of 5 stretches of 200 points at 100 Hz with code 5 at point 50 and code 1 at point 150 of each, as a file; and its triggers."""
    df = simulate.dip_simulate(spark, 100.0, 5, 100, 100)
    rec = df.select(F.lit("o").alias("recording"), F.lit(100.0).alias("sfreq"), "channel_idx", "channel", (F.col("epoch_id") * 200 + F.col("point")).alias("pos"), "value")
    marks = F.explode(F.array(*[F.struct((F.col("id") * 200 + at).alias("position"), F.lit(code).alias("code")) for at, code in ((50, 5), (150, 1))])).alias("t")
    triggers = spark.range(5).select(F.lit("o").alias("recording"), marks).select("recording", "t.*")
    path = folder(spark)
    files.write_recordings(rec, path, "cnt", triggers)
    return path, triggers


register(
    "simulated_triggers",
    lambda spark, d: files.triggers_of(spark, simulated(spark)[0], "cnt").select("position", "code"),
    "SELECT CAST(e * 200 + 50 + 100 * k AS BIGINT) AS position, CAST(CASE k WHEN 0 THEN 5 ELSE 1 END AS INTEGER) AS code FROM range(5) a(e), range(2) b(k)",
)
register(
    "simulated_windows",
    lambda spark, d: files.read_windows(spark, simulated(spark)[0], "cnt", "100ms", "400ms", codes=[1, 3, 7, 9, 5]).groupBy("epoch_id", "condition").agg(F.count("*").alias("n"), F.max("point").alias("last")),
    "SELECT CAST(e AS BIGINT) AS epoch_id, CAST(CASE e % 2 WHEN 0 THEN 5 ELSE 1 END AS INTEGER) AS condition, CAST(37 * 50 AS BIGINT) AS n, 49 AS last FROM range(10) t(e)",
)
register(
    "simulated_accepted",
    lambda spark, d: compile_script(f"read_synamps {simulated(spark)[0]} 100ms 400ms\nquery -N accepted_epochs\nnull_sink", {}, spark=spark).frame(),
    "SELECT CAST(e AS BIGINT) AS epoch_id, CAST(e AS BIGINT) AS accepted_epochs FROM range(10) t(e)",
)


def _weighted_spectra(spark: SparkSession, d: str) -> DataFrame:
    """Two branches of the same file, the second from epoch 3 on and of double weight: the weights of all channels add up to 37 * (10 + 2 * 8)."""
    path = simulated(spark)[0]
    script = f"read_synamps {path} 100ms 400ms\n>fftspect 0 1 1\nread_synamps -f 3 {path} 100ms 400ms\n>set nrofaverages 2\n>fftspect 0 1 1\naverage -M -W"
    return compile_script(script, {}, spark=spark).frame().groupBy("point").agg(F.count("*").alias("channels"), F.sum("weight").alias("weights"), F.min((F.col("value") > 0).cast("int")).alias("positive"))


register("simulated_spectra", _weighted_spectra, "SELECT CAST(k AS INTEGER) AS point, CAST(37 AS BIGINT) AS channels, 962.0::DOUBLE AS weights, 1 AS positive FROM range(16) t(k)")


def _groups(spark: SparkSession, d: str) -> DataFrame:
    """The averaged groups at one point against the plain means of their channels: the largest difference."""
    path = simulated(spark)[0]
    got = compile_script(f"read_synamps {path} 100ms 400ms\ncollapse_channels A1-A15:low A16-A37:high\naverage\nPost:\ntrim 10 1", {}, spark=spark).frame()
    df = files.read_windows(spark, path, "cnt", "100ms", "400ms").where("point = 10")
    want = df.groupBy(F.when(F.col("channel_idx") < 15, "low").otherwise("high").alias("channel")).agg(F.avg("value").alias("_v"))
    return got.join(want, "channel").select("channel", "point", plain(F.abs(F.col("value") - F.col("_v")), 6).alias("difference"))


register("simulated_groups", _groups, "SELECT channel, 0 AS point, 0.0::DOUBLE AS difference FROM (VALUES ('low'), ('high')) t(channel)")
register(
    "simulated_unmatched",
    lambda spark, d: compile_script("dip_simulate 100 2 200ms 300ms eg_source\nscale_by -n ?ECG,EDA,other_unknown_channel 0\nnull_sink", {}, spark=spark).frame().groupBy("epoch_id").agg(F.count("*").alias("n"), F.sum((F.col("value") == 0).cast("long")).alias("zeros")),
    "SELECT CAST(e AS BIGINT) AS epoch_id, CAST(37 * 50 AS BIGINT) AS n, CAST(0 AS BIGINT) AS zeros FROM range(2) t(e)",
)
register(
    "simulated_resampled",
    lambda spark, d: compile_script("dip_simulate 500 1 1s 15s eg_source\nsliding_average 1 62.5\nnull_sink", {}, spark=spark).frame().groupBy("epoch_id", "channel").agg(F.count("*").alias("n")),
    "SELECT CAST(0 AS BIGINT) AS epoch_id, 'A' || CAST(c + 1 AS VARCHAR) AS channel, CAST(128 AS BIGINT) AS n FROM range(37) t(c)",
)

# ------------------------------------------------------------------ shapes and projections

RANGES = [(-2, 5), (6, 4), (14, 0)]
register(
    "trim_x",
    lambda spark, d: shape.trim_x(epochs4(spark, d).withColumn("x", (F.col("point") - 4) * 10.0), [(-31.0, -8.0), (42.0, 61.0)]).select("epoch_id", "channel", "point", plain(F.col("x"), 3).alias("x"), plain(F.col("value"), 6).alias("value")),
    f"WITH {S4} SELECT epoch_id, channel, CAST(CASE WHEN point < 4 THEN point - 1 ELSE point - 8 + 3 END AS INTEGER) AS point, round((point - 4) * 10.0, 3)::DOUBLE AS x, round(value, 6) + 0.0 AS value FROM s WHERE point BETWEEN 1 AND 3 OR point BETWEEN 8 AND 10",
)


def _trimmed_triggers(spark: SparkSession, d: str) -> DataFrame:
    df = epochs4(spark, d).where("channel_idx = 0").drop("channel_idx", "channel", "condition")
    marks = df.where("value > 0.1").select("epoch_id", F.col("point").cast("long").alias("position"), F.lit(7).alias("code"))
    return shape.trim_triggers(df, marks, RANGES)


register(
    "trim_triggers",
    _trimmed_triggers,
    f"WITH {S4} SELECT epoch_id, CAST(CASE WHEN point < 3 THEN point + 2 WHEN point < 10 THEN point - 6 + 5 ELSE point - 14 + 9 END AS BIGINT) AS position, 7 AS code FROM s WHERE channel_idx = 0 AND value > 0.1 AND (point < 3 OR point BETWEEN 6 AND 9 OR point >= 14)",
)
register(
    "trim_epochs",
    lambda spark, d: shape.trim_epochs(metadata(spark, d).select("epoch_id", F.lit(16).alias("n_points"), F.lit(4).alias("beforetrig")), RANGES).select("epoch_id", "n_points", "beforetrig"),
    "SELECT vec_id AS epoch_id, 11 AS n_points, 6 AS beforetrig FROM embeddings",
)
register(
    "swap_fc_back",
    lambda spark, d: shape.swap_fc_back(epochs4(spark, d).where("point = 3").withColumn("channel", F.concat((F.col("channel_idx") * 2.5).cast("string"), F.lit("Hz"))), 100.0).select("epoch_id", "point", plain(F.col("x"), 3).alias("x"), plain(F.col("z"), 6).alias("z"), plain(F.col("value"), 6).alias("value")),
    f"WITH {S4} SELECT epoch_id, channel_idx AS point, round(channel_idx * 2.5, 3)::DOUBLE AS x, round(epoch_id / 100.0, 6)::DOUBLE AS z, round(value, 6) + 0.0 AS value FROM s WHERE point = 3",
)


def _placed(layout: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        names = ["fp1", "Cz", "A1", "T8", "strange", "EEG O2", "oddity"]
        rows = metadata(spark, d).select("epoch_id", F.posexplode(F.array(*map(F.lit, names))).alias("channel_idx", "channel"))
        return shape.set_layout(rows, layout).select("epoch_id", "channel", "px", "py", "pz")

    return query


for _layout, _rows in (
    ("PSG", "('fp1', -1.0, 4.0), ('Cz', 0.0, 2.0), ('A1', -3.0, 2.0), ('T8', 2.0, 2.0), ('strange', 0.0, -3.0), ('EEG O2', 1.0, 0.0), ('oddity', 0.5, -3.0)"),
    ("EEG", "('fp1', -0.628435, 1.93413), ('Cz', 0.0, 0.0), ('A1', -2.5, 0.0), ('T8', 2.03366, 0.0), ('strange', 0.0, -3.0), ('EEG O2', 0.5, -3.0), ('oddity', 1.0, -3.0)"),
):
    register(f"channelposition_{_layout}", _placed(_layout), f"SELECT vec_id AS epoch_id, channel, px::DOUBLE AS px, py::DOUBLE AS py, 0.0::DOUBLE AS pz FROM embeddings, (VALUES {_rows}) t(channel, px, py)")


def _templates(spark: SparkSession, d: str, axis: str) -> DataFrame:
    """Two vectors: the means of even and of odd vectors of the table."""
    df = epochs4(spark, d).withColumn("k", F.col("epoch_id") % 2)
    return df.groupBy("k", axis).agg(F.avg("value").alias("weight"))


MEANS = ", t AS (SELECT epoch_id % 2 AS k, {axis}, avg(value) AS w FROM s GROUP BY 1, 2), c AS (SELECT k, {axis}, w - avg(w) OVER (PARTITION BY k) AS w FROM t), u AS (SELECT k, {axis}, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM c)"
register(
    "project_centred",
    lambda spark, d: joins.project(epochs4(spark, d), _templates(spark, d, "channel"), centred=True, into="channel").select("epoch_id", "channel", "point", plain(F.col("value"), 5).alias("value")),
    f"WITH {S4}{MEANS.format(axis='channel')} SELECT epoch_id, 'projected' || CAST(k + 1 AS VARCHAR) AS channel, point, round(sum(value * w), 5) + 0.0 AS value FROM s JOIN u USING (channel) GROUP BY epoch_id, k, point",
)
register(
    "correlate_centred",
    lambda spark, d: joins.correlate(epochs4(spark, d).drop("condition"), _templates(spark, d, "point"), centred=True).select("epoch_id", "channel", F.col("k").cast("long").alias("k"), plain(F.col("value"), 5).alias("value")),
    f"WITH {S4}{MEANS.format(axis='point')} SELECT epoch_id, channel, k, round(sum(value * w), 5) + 0.0 AS value FROM s JOIN u USING (point) GROUP BY epoch_id, channel, k",
)
register(
    "project_orthogonal",
    lambda spark, d: joins.project(epochs4(spark, d), _templates(spark, d, "channel"), unit=False, orthogonal=True).select("epoch_id", "point", F.col("k").cast("long").alias("k"), plain(F.col("value"), 5).alias("value")),
    f"""WITH {S4}, t AS (SELECT epoch_id % 2 AS k, channel, avg(value) AS w FROM s GROUP BY 1, 2), a AS (SELECT channel, w AS w FROM t WHERE k = 0), b AS (SELECT channel, w AS w FROM t WHERE k = 1), g AS (SELECT sum(a.w * b.w) / sum(a.w * a.w) AS g FROM a JOIN b USING (channel)),
 o AS (SELECT CAST(0 AS BIGINT) AS k, channel, w FROM a UNION ALL SELECT 1, b.channel, b.w - g * a.w FROM a JOIN b USING (channel), g) SELECT epoch_id, point, k, round(sum(value * w), 5) + 0.0 AS value FROM s JOIN o USING (channel) GROUP BY epoch_id, point, k""",
)


def _multiplied(spark: SparkSession, d: str) -> DataFrame:
    weights = epochs4(spark, d).where("channel_idx < 2").drop("condition")
    return out(joins.multiplied(weights, _templates(spark, d, "channel"), unit=False))


register(
    "project_multiplied",
    _multiplied,
    f"WITH {S4}, t AS (SELECT epoch_id % 2 AS k, channel, avg(value) AS w FROM s GROUP BY 1, 2) SELECT epoch_id, t.channel, point, round(sum(value * w), 6) + 0.0 AS value FROM s JOIN t ON k = channel_idx WHERE channel_idx < 2 GROUP BY epoch_id, t.channel, point",
)


def _binomial(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the label and 9 minus it: p and its signed logarithm from sums of binomial coefficients."""
    counts = metadata(spark, d).select("epoch_id", F.array(F.lit(0.5), F.col("condition").cast("double"), (9 - F.col("condition")).cast("double")).alias("items"))
    made = elementwise.binomial_items(counts)
    return made.select("epoch_id", *[plain(F.col("items")[3 + k], 8 - 2 * (k > 0)).alias(n) for k, n in enumerate(("p", "log", "difference"))])


register(
    "binomial_values",
    _binomial,
    """WITH c AS (SELECT CAST(k AS BIGINT) AS k, factorial(9) / (factorial(CAST(k AS INTEGER)) * factorial(CAST(9 - k AS INTEGER))) AS n FROM range(10) t(k)), p AS (SELECT a.k, 2 * sum(c.n) / 512.0 AS p FROM range(10) a(k), c WHERE c.k >= greatest(a.k, 9 - a.k) GROUP BY a.k)
 SELECT vec_id AS epoch_id, round(p::DOUBLE, 8) + 0.0 AS p, round(CASE WHEN label > 4 THEN -log10(p) ELSE log10(p) END, 6) + 0.0 AS log, round((2 * label - 9) / 9.0, 6)::DOUBLE + 0.0 AS difference FROM embeddings JOIN p ON p.k = label""",
)

# ------------------------------------------------------------------ composites


def _shifted(spark: SparkSession, d: str) -> DataFrame:
    """Trials of two events each, one a vector: the second follows 1 to 5 points after the first."""
    df = epochs4(spark, d)
    order = df.select("epoch_id", "condition").distinct().withColumn("_no", F.row_number().over(Window.partitionBy("condition").orderBy("epoch_id")) - 1)
    at = (F.col("_no") * POINTS + 4).cast("long")
    trials = order.select(F.concat(F.lit("label"), F.col("condition").cast("string")).alias("recording"), "epoch_id", "condition", at.alias("at"), (at + 1 + F.col("_no") % 5).alias("second"))
    made = paradigm.shifted_epochs(label_recordings(spark, d), trials, 3, 8)
    return made.select("epoch_id", "channel", "point", "shift", plain(F.col("value"), 6).alias("value"))


register(
    "shifted_epochs",
    _shifted,
    f"""WITH {LR}, t AS (SELECT DISTINCT 'label' || CAST(condition AS VARCHAR) AS recording, epoch_id, condition, no * {POINTS} + 4 AS "at", 1 + no % 5 AS d FROM o), h AS (SELECT condition, CAST(round_even(exp(avg(ln(d))), 0) AS INTEGER) AS shift FROM t GROUP BY 1),
 w AS (SELECT recording, epoch_id, shift, "at", CAST(k AS INTEGER) AS point, d - shift + k AS i FROM t JOIN h USING (condition), range(11) u(k) WHERE d - shift + 11 > 0), b AS (SELECT t.epoch_id, r.channel, avg(r.value) AS base FROM t JOIN r ON r.recording = t.recording AND r.pos BETWEEN t."at" - 3 AND t."at" - 1 GROUP BY 1, 2)
 SELECT w.epoch_id, b.channel, w.point, w.shift, round(CASE WHEN i < 0 THEN 0 ELSE coalesce(r.value - b.base, 0) END, 6) + 0.0 AS value FROM w JOIN b USING (epoch_id) LEFT JOIN r ON r.recording = w.recording AND r.channel = b.channel AND r.pos = w."at" - 3 + i""",
)


def _z_crossings(spark: SparkSession, d: str) -> DataFrame:
    means = collect.average(epochs4(spark, d), by=["condition"], t_test=True).withColumn("epoch_id", F.col("condition")).withColumn("x", (F.col("point") - 4) * 10.0)
    return paradigm.z_crossings(means, 0.1, None).select("epoch_id", "channel", "x", "code")


register(
    "z_crossings",
    _z_crossings,
    f"""WITH {S4}, m AS (SELECT condition, channel, point, avg(value) / sqrt((sum(value * value) - sum(value) * sum(value) / count(*)) / (count(*) * (count(*) - 1))) / sqrt(count(*)) AS z FROM s WHERE point >= 4 GROUP BY 1, 2, 3 HAVING count(*) > 1),
 l AS (SELECT *, z >= 0.1 AS above, lag(z >= 0.1) OVER (PARTITION BY condition, channel ORDER BY point) AS before FROM m) SELECT condition AS epoch_id, channel, ((point - 4) * 10.0)::DOUBLE AS x, CASE WHEN above THEN 1 ELSE -1 END AS code FROM l WHERE above <> before""",
)


def _components(spark: SparkSession, d: str) -> DataFrame:
    mean = epochs4(spark, d).groupBy("channel", "point").agg(F.avg("value").alias("value"))
    return paradigm.artifact_components(mean, _templates(spark, d, "channel"), 0.0).select("k", plain(F.col("importance"), 5).alias("importance"))


WEIGHTS = ", t AS (SELECT epoch_id % 2 AS k, channel, avg(value) AS w FROM s GROUP BY 1, 2)"
register(
    "artifact_components",
    _components,
    f"WITH {S4}{WEIGHTS}, a AS (SELECT channel, point, avg(value) AS v FROM s GROUP BY 1, 2), c AS (SELECT point, k, sum(v * w) AS c FROM a JOIN t USING (channel) GROUP BY 1, 2), m AS (SELECT k, avg(abs(c)) AS m FROM c GROUP BY 1) SELECT k, round(m / max(m) OVER (), 5) + 0.0 AS importance FROM m",
)


def _without(spark: SparkSession, d: str) -> DataFrame:
    weights = _templates(spark, d, "channel")
    return out(paradigm.without_components(epochs4(spark, d), weights, weights, weights.where("k = 1").select("k").distinct()), digits=5)


register(
    "without_components",
    _without,
    f"WITH {S4}{WEIGHTS}, c AS (SELECT epoch_id, point, sum(value * w) AS c FROM s JOIN t USING (channel) WHERE k = 1 GROUP BY 1, 2) SELECT epoch_id, s.channel, point, round(value - c * w, 5) + 0.0 AS value FROM s JOIN c USING (epoch_id, point) JOIN t ON t.channel = s.channel AND t.k = 1",
)

"""Queries over row series: segments, frames, spectra, interpolation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spectra as S
from ..functions.columns import decibel, no_nan, rounded
from ..operators import align, clean, profile, sequence, signal
from ..session import scratch_path
from ..sources import readers
from .registry import query

USER, ORDER, SIZE = ["user_id"], ["ts", "event_id"], 32

# Positions of the events of each user, and 32-row segments, in SQL.
SQL_POS = """ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos
  FROM events)"""
SQL_SEG = SQL_POS + """,
seg AS (SELECT *, pos // 32 AS seg, pos % 32 AS t FROM ev)"""
# Fourier sums of every segment of (keys, n, t, v) rows.
SQL_DFT = """dft AS (SELECT user_id, seg, n, k,
    sum(value * cos(2 * pi() * k * t / n)) AS re, -sum(value * sin(2 * pi() * k * t / n)) AS im
  FROM (SELECT user_id, seg, t, value, count(*) OVER (PARTITION BY user_id, seg) AS n FROM seg) s,
    LATERAL (SELECT unnest(range(0, n // 2 + 1)) AS k) r
  GROUP BY user_id, seg, n, k)"""


def segments(t):
    return sequence.segment_rows(t.events.select("event_id", "ts", "user_id", "event_type", "value"),
                                 USER, ORDER, SIZE)


@query("w1_segments", f"""WITH {SQL_SEG}
SELECT s.user_id, s.seg, count(*) AS n, min(f.event_type) AS label,
  sum(s.event_id) :: BIGINT AS ids, round(sum(s.value) + 1e-9, 4) + 0.0 AS total
FROM seg s JOIN seg f ON f.user_id = s.user_id AND f.seg = s.seg AND f.t = 0 GROUP BY s.user_id, s.seg""")
def w1_segments(spark, t):
    s = segments(t)
    return s.groupBy("user_id", "seg").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("event_type", "t").alias("label"),
        F.sum("event_id").alias("ids"), rounded(F.sum("value"), 4).alias("total"))


@query("w2_running_segment_ids", f"""WITH {SQL_SEG},
k AS (SELECT user_id, (count(*) + 31) // 32 AS k FROM events GROUP BY 1),
o AS (SELECT user_id, (sum(k) OVER (ORDER BY user_id) - k) :: BIGINT AS first FROM k)
SELECT event_id, first + seg AS segment_id FROM seg JOIN o USING (user_id)""")
def w2_running_ids(spark, t):
    return sequence.running_segment_ids(segments(t), "user_id", SIZE).select("event_id", "segment_id")


@query("w5_sliding_windows", f"""WITH {SQL_POS},
n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1),
f AS (SELECT user_id, unnest(range(0, n - 16)) AS frame FROM n)
SELECT f.user_id, f.frame, count(*) AS n, round(sum(value) + 1e-9, 4) + 0.0 AS total,
  round(min_by(value, pos), 4) AS first_value, round(max_by(value, pos), 4) AS last_value
FROM f JOIN ev ON ev.user_id = f.user_id AND pos BETWEEN frame AND frame + 15 GROUP BY ALL""")
def w5_sliding(spark, t):
    w = sequence.sliding_windows(segments(t), USER, "pos", "value", 16)
    total = F.aggregate("window", F.lit(0.0), lambda s, v: s + v)
    return w.select("user_id", "frame", F.size("window").cast("long").alias("n"),
                    rounded(total, 4).alias("total"),
                    F.round(F.get("window", F.lit(0)), 4).alias("first_value"),
                    F.round(F.element_at("window", -1), 4).alias("last_value"))


def sql_frames(hop: int) -> str:
    """Complete 16-row frames in SQL."""
    return f"""{SQL_POS},
n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1),
f AS (SELECT user_id, unnest(range(0, (n - 16) // {hop} + 1)) AS frame FROM n WHERE n >= 16),
fr AS (SELECT f.user_id, frame, pos - frame * {hop} AS o, value,
    value - avg(value) OVER (PARTITION BY f.user_id, frame) AS centred
  FROM f JOIN ev ON ev.user_id = f.user_id AND pos BETWEEN frame * {hop} AND frame * {hop} + 15)"""


@query("w6_overlapping_frames", f"""WITH {sql_frames(8)}
SELECT user_id, frame, count(*) AS n, round(sum(value) + 1e-9, 4) + 0.0 AS total,
  round(min_by(value, o), 4) AS first_value FROM fr GROUP BY ALL""")
def w6_frames(spark, t):
    f = sequence.overlapping_frames(segments(t), USER, "pos", "value", 16, 8)
    total = F.aggregate("window", F.lit(0.0), lambda s, v: s + v)
    return f.select("user_id", "frame", F.size("window").cast("long").alias("n"),
                    rounded(total, 4).alias("total"), F.round(F.get("window", F.lit(0)), 4).alias("first_value"))


SQL_FEATURES = f"""WITH {SQL_SEG}, {SQL_DFT},
f AS (SELECT user_id, seg, avg(sqrt(re * re + im * im)) AS m, stddev_pop(sqrt(re * re + im * im)) AS s,
    var_pop(sqrt(re * re + im * im)) AS v FROM dft WHERE k >= 5 AND k < n // 2 GROUP BY 1, 2),
b AS (SELECT user_id, seg, min_by(event_type, t) AS label, avg(value) AS m, stddev_samp(value) AS s,
    var_samp(value) AS v FROM seg GROUP BY 1, 2)
SELECT b.user_id, b.seg, b.label, round(b.m + 1e-9, 4) + 0.0 AS value_mean, round(b.s + 1e-9, 4) + 0.0 AS value_std,
  round(b.v + 1e-9, 4) + 0.0 AS value_var, round(f.m + 1e-9, 4) + 0.0 AS value_fourier_mean,
  round(f.s + 1e-9, 4) + 0.0 AS value_fourier_std, round(f.v + 1e-9, 4) + 0.0 AS value_fourier_var
FROM b LEFT JOIN f USING (user_id, seg)"""


def features(t):
    f = signal.segment_features(segments(t), ["user_id", "seg"], "t", ["value"], "event_type")
    return f.select("user_id", "seg", "label", *[
        rounded(F.col(c), 4).alias(c) for c in f.columns if c.startswith("value_")])


@query("g1_segment_features", SQL_FEATURES)
def g1_features(spark, t):
    return features(t)


@query("g2_feature_tables", f"""WITH g AS ({SQL_FEATURES})
SELECT 'train' AS part, (row_number() OVER (ORDER BY user_id, seg) - 1) :: VARCHAR AS id, label,
  value_mean, value_fourier_mean FROM g WHERE user_id % 5 <> 0
UNION ALL
SELECT 'test', user_id || '-' || seg, NULL, value_mean, value_fourier_mean FROM g WHERE user_id % 5 = 0""")
def g2_feature_tables(spark, t):
    """Train rows are numbered in (file, segment) order; test rows keep their file name as id."""
    f = features(t)
    held_out = F.col("user_id") % 5 == 0
    train = sequence.renumber(f.filter(~held_out), ["user_id", "seg"], "_id")
    train = train.select(F.lit("train").alias("part"), F.col("_id").cast("string").alias("id"), "label",
                         "value_mean", "value_fourier_mean")
    test = f.filter(held_out).select(
        F.lit("test").alias("part"), F.concat_ws("-", "user_id", "seg").alias("id"),
        F.lit(None).cast("string").alias("label"), "value_mean", "value_fourier_mean")
    return train.unionByName(test)


@query("chain_sensor_files", f"""WITH g AS ({SQL_FEATURES}),
c(label, code) AS (VALUES ('click', 0), ('error', 1), ('purchase', 2), ('signup', 3), ('view', 4))
SELECT user_id || '-' || seg AS id, code :: VARCHAR AS class, value_mean, value_fourier_mean FROM g JOIN c USING (label)
UNION ALL SELECT 'none-0', '', NULL, NULL""")
def chain_sensor_files(spark, t):
    """Sensor files -> segments -> features -> class table -> answers in the rows of a template."""
    path = scratch_path(spark, "sensor")
    (t.events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "user_id", "event_type", "value")
     .repartition(4, "user_id").write.option("header", True).csv(path))
    rows = readers.read_csv_files(spark, path, "event_id long, ts long, user_id long, event_type string, value double")
    segs = sequence.segment_rows(rows, USER, ORDER, SIZE)
    f = signal.segment_features(segs, ["user_id", "seg"], "t", ["value"], "event_type")
    codes = readers.table_of(spark, list(zip(("click", "error", "purchase", "signup", "view"), range(5))), "label string, code int")
    named = align.lookup_strict(f.withColumn("code", F.col("label")), codes.withColumnRenamed("code", "class").withColumnRenamed("label", "code"), "code", "class")
    answers = named.select(F.concat_ws("-", "user_id", "seg").alias("id"), F.col("class").cast("string").alias("class"),
                           rounded(F.col("value_mean"), 4).alias("value_mean"), rounded(F.col("value_fourier_mean"), 4).alias("value_fourier_mean"))
    template = align.union_rows(answers.select("id"), readers.table_of(spark, [("none-0",)], "id string"))
    return align.fill_template(template, answers, "id")


@query("g3_spectrum", f"""WITH {SQL_SEG}, {SQL_DFT}
SELECT user_id, seg, k :: INTEGER AS k, round(k * 64.0 / n, 4) AS freq,
  round(sqrt(re * re + im * im) + 1e-9, 4) + 0.0 AS mag, round(abs(re) + 1e-9, 4) + 0.0 AS abs_real,
  round(20 * log10(greatest(sqrt(re * re + im * im), 1e-4)) + 1e-9, 3) + 0.0 AS mag_db
FROM dft WHERE k > 0 AND 2 * k < n""")
def g3_spectrum(spark, t):
    packed = sequence.pack(segments(t), ["user_id", "seg"], "t", "value")
    s = signal.spectrum(packed, ["user_id", "seg"], "series", 64.0)
    # Bins that cancel to rounding noise have no stable decibel value: both sides stop at a floor.
    floor = F.when(F.col("mag") < 1e-4, F.lit(-80.0)).otherwise(F.col("mag_db"))
    return s.select("user_id", "seg", "k", F.round("freq", 4).alias("freq"),
                    rounded(F.col("mag"), 4).alias("mag"), rounded(F.col("abs_real"), 4).alias("abs_real"),
                    rounded(floor, 3).alias("mag_db"))


def sql_density(window: str, fs: float) -> str:
    """One-sided power density per frame in SQL."""
    return f"""w AS (SELECT user_id, frame, o, centred * {window} AS x, {window} AS w FROM fr),
d AS (SELECT user_id, frame, k, (power(sum(x * cos(2 * pi() * k * o / 16)), 2)
    + power(sum(x * sin(2 * pi() * k * o / 16)), 2)) / ({fs} * sum(w * w))
    * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END AS psd
  FROM w, (SELECT unnest(range(0, 9)) AS k) r GROUP BY user_id, frame, k)"""


SQL_HANN = "(0.5 - 0.5 * cos(2 * pi() * o / 16))"
SQL_TUKEY = """(CASE WHEN least(o, 16 - o) < 2 THEN 0.5 - 0.5 * cos(pi() * least(o, 16 - o) / 2) ELSE 1 END)"""


@query("g4_power_spectral_density", f"""WITH {sql_frames(8)}, {sql_density(SQL_HANN, 250.0)}
SELECT user_id, k :: INTEGER AS k, k * 250.0 / 16 AS freq, round(avg(psd) + 1e-9, 5) + 0.0 AS psd
FROM d GROUP BY user_id, k""")
def g4_psd(spark, t):
    p = signal.power_spectral_density(segments(t), USER, "pos", "value", 250.0, 16)
    return p.withColumn("psd", rounded(F.col("psd"), 5))


@query("g5_stft_magnitude", f"""WITH {SQL_POS},
n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1),
f AS (SELECT user_id, unnest(range(0, (n - 1) // 8 + 2)) AS frame FROM n),
x AS (SELECT f.user_id, frame, pos + 8 - frame * 8 AS o, value FROM f JOIN ev ON ev.user_id = f.user_id
  AND pos + 8 BETWEEN frame * 8 AND frame * 8 + 15),
m AS (SELECT user_id, frame, k, sqrt(power(sum(value * {SQL_HANN} * cos(2 * pi() * k * o / 16)), 2)
    + power(sum(value * {SQL_HANN} * sin(2 * pi() * k * o / 16)), 2)) / 8 AS mag
  FROM x, (SELECT unnest(range(0, 9)) AS k) r GROUP BY user_id, frame, k)
SELECT user_id, frame, k :: INTEGER AS k, round(mag + 1e-9, 4) + 0.0 AS mag FROM m""")
def g5_stft(spark, t):
    return signal.stft_magnitude(segments(t), USER, "pos", "value", 16).withColumn(
        "mag", rounded(F.col("mag"), 4))


@query("g6_spectrogram", f"""WITH {sql_frames(14)}, {sql_density(SQL_TUKEY, 250.0)}
SELECT user_id, frame, k :: INTEGER AS k, round(psd + 1e-9, 5) + 0.0 AS psd FROM d""")
def g6_spectrogram(spark, t):
    return signal.spectrogram(segments(t), USER, "pos", "value", 250.0, 16).withColumn(
        "psd", rounded(F.col("psd"), 5))


def sql_any_frames(size: int, part: int) -> str:
    """Complete frames of ``size`` rows, or of a whole shorter series, that overlap by size // part."""
    return f"""{SQL_POS},
n AS (SELECT user_id, count(*) AS n, least({size}, count(*)) AS s FROM ev GROUP BY 1),
f AS (SELECT user_id, s, s - s // {part} AS hop, unnest(range(0, (n - s) // (s - s // {part}) + 1)) AS frame FROM n),
fr AS (SELECT f.user_id, frame, s, pos - frame * hop AS o, value - avg(value) OVER (PARTITION BY f.user_id, frame) AS centred
  FROM f JOIN ev ON ev.user_id = f.user_id AND pos BETWEEN frame * hop AND frame * hop + s - 1)"""


def sql_any_density(window: str) -> str:
    return f"""w AS (SELECT user_id, frame, s, o, centred * {window} AS x, {window} AS w FROM fr),
d AS (SELECT user_id, frame, s, k, (power(sum(x * cos(2 * pi() * k * o / s)), 2)
    + power(sum(x * sin(2 * pi() * k * o / s)), 2)) / (250.0 * sum(w * w))
    * CASE WHEN k = 0 OR 2 * k = s THEN 1 ELSE 2 END AS psd
  FROM w, LATERAL (SELECT unnest(range(0, s // 2 + 1)) AS k) r GROUP BY user_id, frame, s, k)"""


SQL_ANY_HANN = "(0.5 - 0.5 * cos(2 * pi() * o / s))"
SQL_ANY_TUKEY = """(CASE WHEN least(o, s - o) < s / 8.0 THEN 0.5 - 0.5 * cos(pi() * least(o, s - o) / (s / 8.0)) ELSE 1 END)"""


def _density_query(size: int) -> None:
    @query(f"g4_power_spectral_density_{size}", f"""WITH {sql_any_frames(size, 2)}, {sql_any_density(SQL_ANY_HANN)}
SELECT user_id, k :: INTEGER AS k, round(k * 250.0 / s, 6) AS freq, round(avg(psd) + 1e-9, 5) + 0.0 AS psd FROM d GROUP BY user_id, k, s""")
    def density(spark, t):
        p = signal.power_spectral_density(segments(t), USER, "pos", "value", 250.0, size)
        return p.withColumns({"psd": rounded(F.col("psd"), 5), "freq": F.round("freq", 6)})

    @query(f"g6_spectrogram_{size}", f"""WITH {sql_any_frames(size, 8)}, {sql_any_density(SQL_ANY_TUKEY)}
SELECT user_id, frame, k :: INTEGER AS k, round(psd + 1e-9, 5) + 0.0 AS psd FROM d""")
    def gram(spark, t):
        return signal.spectrogram(segments(t), USER, "pos", "value", 250.0, size).withColumn("psd", rounded(F.col("psd"), 5))


for _size in (9, 256):
    _density_query(_size)


@query("g5_stft_magnitude_9", f"""WITH {SQL_POS},
n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1),
f AS (SELECT user_id, unnest(range(0, (n + 3) // 5 + 1)) AS frame FROM n),
x AS (SELECT f.user_id, frame, pos + 4 - frame * 5 AS o, value FROM f JOIN ev ON ev.user_id = f.user_id
  AND pos + 4 BETWEEN frame * 5 AND frame * 5 + 8),
m AS (SELECT user_id, frame, k, sqrt(power(sum(value * (0.5 - 0.5 * cos(2 * pi() * o / 9)) * cos(2 * pi() * k * o / 9)), 2)
    + power(sum(value * (0.5 - 0.5 * cos(2 * pi() * o / 9)) * sin(2 * pi() * k * o / 9)), 2)) / 4.5 AS mag
  FROM x, (SELECT unnest(range(0, 5)) AS k) r GROUP BY user_id, frame, k)
SELECT user_id, frame, k :: INTEGER AS k, round(mag + 1e-9, 4) + 0.0 AS mag FROM m""")
def g5_stft_odd(spark, t):
    return signal.stft_magnitude(segments(t), USER, "pos", "value", 9).withColumn("mag", rounded(F.col("mag"), 4))


# Errors hide the value of their event: NULL for even ids, NaN for odd ones.
SQL_GAPS = """gev AS (SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"""


def with_gaps(t):
    hidden = F.when(F.col("event_type") != "error", F.col("value")).when(F.col("event_id") % 2 == 1, F.lit(float("nan")))
    return t.events.select("event_id", "ts", "user_id", "event_type", hidden.alias("v"))


@query("w5_sliding_windows_gaps", f"""WITH {SQL_GAPS},
n AS (SELECT user_id, count(*) AS n FROM gev GROUP BY 1),
f AS (SELECT user_id, unnest(range(0, n - 4)) AS frame FROM n)
SELECT f.user_id, f.frame, list(round(v, 4) ORDER BY pos) AS w
FROM f JOIN gev ON gev.user_id = f.user_id AND pos BETWEEN frame AND frame + 3 GROUP BY ALL""")
def w5_sliding_gaps(spark, t):
    placed = sequence.segment_rows(with_gaps(t), USER, ORDER, SIZE).withColumn("v", no_nan(F.col("v")))
    w = sequence.sliding_windows(placed, USER, "pos", "v", 4)
    return w.select("user_id", "frame", F.transform("window", lambda x: F.round(x, 4)).alias("w"))


@query("w6_overlapping_frames_gaps", f"""WITH {SQL_GAPS},
n AS (SELECT user_id, count(*) AS n FROM gev GROUP BY 1),
f AS (SELECT user_id, n, unnest(range(0, (n + 1) // 2 + 1)) AS frame FROM n),
o AS (SELECT *, unnest(range(0, 4)) AS o FROM f WHERE frame <= (n + 1) // 2)
SELECT o.user_id, o.frame, list(CASE WHEN gev.user_id IS NULL THEN 0.0 ELSE round(v, 4) END ORDER BY o) AS w
FROM o LEFT JOIN gev ON gev.user_id = o.user_id AND gev.pos = o.frame * 2 + o.o - 2 GROUP BY ALL""")
def w6_frames_gaps(spark, t):
    placed = sequence.segment_rows(with_gaps(t), USER, ORDER, SIZE).withColumn("v", no_nan(F.col("v")))
    w = sequence.overlapping_frames(placed, USER, "pos", "v", 4, 2, zero_edges=True)
    return w.select("user_id", "frame", F.transform("window", lambda x: F.round(x, 4)).alias("w"))


@query("n5_z_scores_gaps", f"""WITH {SQL_GAPS},
g AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type END AS kind, v FROM gev),
s AS (SELECT kind, avg(v) AS m, stddev_pop(v) AS s FROM g GROUP BY 1)
SELECT event_id, CASE WHEN v IS NOT NULL THEN round(CASE WHEN s > 0 THEN (v - m) / s ELSE 0 END + 1e-9, 6) + 0.0 END AS z
FROM g JOIN s ON g.kind IS NOT DISTINCT FROM s.kind""")
def n5_z_gaps(spark, t):
    rows = with_gaps(t).withColumn("kind", F.when(F.col("event_type") != "view", F.col("event_type")))
    return sequence.z_scores(rows, ["kind"], "v").select("event_id", rounded(F.col("z")).alias("z"))


@query("w2_running_segment_ids_gaps", """WITH e AS (SELECT event_id, ts, nullif(user_id % 7, 3) AS file FROM events),
p AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ts, event_id) - 1 AS pos FROM e),
k AS (SELECT file, (count(*) + 31) // 32 AS k FROM p GROUP BY 1),
o AS (SELECT file, (sum(k) OVER (ORDER BY file NULLS FIRST) - k) :: BIGINT AS first FROM k)
SELECT event_id, first + pos // 32 AS segment_id FROM p JOIN o ON p.file IS NOT DISTINCT FROM o.file""")
def w2_running_gaps(spark, t):
    rows = t.events.select("event_id", "ts", F.nullif(F.col("user_id") % 7, F.lit(3)).alias("file"))
    segs = sequence.segment_rows(rows, ["file"], ORDER, SIZE)
    return sequence.running_segment_ids(segs, "file", SIZE).select("event_id", "segment_id")


@query("c1_interpolate_gaps", f"""WITH {SQL_GAPS},
b AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS p0,
    last_value(v IGNORE NULLS) OVER w AS v0,
    first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER x AS p1, first_value(v IGNORE NULLS) OVER x AS v1
  FROM gev WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    x AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NOT NULL AND v1 IS NOT NULL
  THEN v0 + (v1 - v0) * (pos - p0) / (p1 - p0) ELSE v0 END + 1e-9, 6) + 0.0 AS v FROM b""")
def c1_interpolate_gaps(spark, t):
    return clean.interpolate(with_gaps(t), USER, ORDER, "v").select("event_id", rounded(F.col("v")).alias("v"))


@query("a_profiles_gaps", f"""WITH {SQL_GAPS},
m AS (SELECT count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS lo, max(v) AS hi,
  quantile_cont(v, [0.25, 0.5, 0.75]) AS q, count(DISTINCT v) + max((v IS NULL)::INT) AS n_distinct FROM gev)
SELECT 'count' AS what, n :: DOUBLE AS x FROM m UNION ALL SELECT 'mean', round(mean + 1e-9, 6) FROM m
UNION ALL SELECT 'std', round(std + 1e-9, 6) FROM m UNION ALL SELECT 'min', round(lo + 1e-9, 6) FROM m
UNION ALL SELECT 'max', round(hi + 1e-9, 6) FROM m UNION ALL SELECT 'q25', round(q[1] + 1e-9, 6) FROM m
UNION ALL SELECT 'q50', round(q[2] + 1e-9, 6) FROM m UNION ALL SELECT 'q75', round(q[3] + 1e-9, 6) FROM m
UNION ALL SELECT 'distinct', n_distinct FROM m
UNION ALL SELECT 'values', (SELECT count(*) FROM (SELECT v FROM gev WHERE v IS NOT NULL GROUP BY v))
UNION ALL SELECT 'filled', round((SELECT sum(coalesce(v, (SELECT mean FROM m))) FROM gev) + 1e-9, 3)""")
def a_profiles_gaps(spark, t):
    df = with_gaps(t).select("v")
    d = profile.describe(df, ["v"])
    parts = [d.select(F.lit(c).alias("what"), rounded(F.col(c).cast("double")).alias("x"))
             for c in ("count", "mean", "std", "min", "max", "q25", "q50", "q75")]
    parts += [profile.distinct_counts(df, ["v"]).select(F.lit("distinct").alias("what"), F.col("n_distinct").cast("double").alias("x")),
              profile.value_counts(df, ["v"]).agg(F.count(F.lit(1)).cast("double").alias("x")).select(F.lit("values").alias("what"), "x"),
              clean.fill_means(df, ["v"]).agg(rounded(F.sum("v"), 3).alias("x")).select(F.lit("filled").alias("what"), "x")]
    return align.union_rows(*parts)


SQL_ARRAYS = """x AS (SELECT vec_id, unnest(range(0, 64)) AS t, unnest(embedding) :: DOUBLE AS v FROM embeddings)"""
SQL_ARRAY_DFT = f"""{SQL_ARRAYS},
z AS (SELECT vec_id, k, sum(v * cos(2 * pi() * k * t / 64)) AS re, -sum(v * sin(2 * pi() * k * t / 64)) AS im
  FROM x, (SELECT unnest(range(0, 33)) AS k) r GROUP BY vec_id, k)"""


def elements(df, keys, array, name):
    return df.select(*keys, F.posexplode(array).alias("t", name)).withColumn(
        name, rounded(F.col(name), 5))


@query("g7_autocorrelation", f"""WITH {SQL_ARRAYS}
SELECT a.vec_id, lag :: INTEGER AS t, round(sum(a.v * b.v) + 1e-9, 5) + 0.0 AS corr
FROM x a, (SELECT unnest(range(0, 64)) AS lag) l, x b
WHERE b.vec_id = a.vec_id AND b.t = (a.t + lag) % 64 GROUP BY a.vec_id, lag""")
def g7_autocorrelation(spark, t):
    e = t.embeddings.select("vec_id", S.autocorrelation(F.col("embedding").cast(S.DOUBLES)).alias("c"))
    return elements(e, ["vec_id"], "c", "corr")


SQL_GAIN = """1 / (1 + power((power(tan(pi() * k / 64), 2) - tan(pi() * 13 / 125) * tan(pi() * 32 / 125))
  / ((tan(pi() * 32 / 125) - tan(pi() * 13 / 125)) * tan(pi() * k / 64)), 10))"""


@query("g8_band_pass", f"""WITH {SQL_ARRAY_DFT},
g AS (SELECT vec_id, k, re * {SQL_GAIN} AS re, im * {SQL_GAIN} AS im FROM z WHERE k BETWEEN 1 AND 31)
SELECT vec_id, t :: INTEGER AS t, round(sum(re * cos(2 * pi() * k * t / 64)
  - im * sin(2 * pi() * k * t / 64)) / 32 + 1e-9, 5) + 0.0 AS filtered
FROM g, (SELECT unnest(range(0, 64)) AS t) r GROUP BY vec_id, t""")
def g8_band_pass(spark, t):
    band = S.band_pass(F.col("embedding").cast(S.DOUBLES), 13, 32, 125.0, 5)
    return elements(t.embeddings.select("vec_id", band.alias("b")), ["vec_id"], "b", "filtered")


def sql_sections(sections, edge: int, n: int) -> str:
    """The filter as a recursion over time, all sections in one step, forward and then backward."""
    k = len(sections)

    def start(x: str) -> str:
        b0, b1, b2, _, _ = (float(v) for v in sections[0])
        zero = ", ".join(f"0.0 :: DOUBLE AS p{i}, 0.0 :: DOUBLE AS q{i}" for i in range(1, k))
        return f"({b1!r} + {b2!r}) * {x} AS p0, {b2!r} * {x} AS q0" + (f", {zero}" if zero else "")

    def step(x: str) -> str:
        parts, last = [], x
        for i, row in enumerate(sections):
            b0, b1, b2, a1, a2 = (f"({float(v)!r})" for v in row)
            parts.append(f"{b0} * {last} + p{i} AS y{i}, {b1} * {last} - {a1} * y{i} + q{i} AS np{i}, {b2} * {last} - {a2} * y{i} AS nq{i}")
            last = f"y{i}"
        return ", ".join(parts)

    state = ", ".join(f"p{i}, q{i}" for i in range(k))
    new = ", ".join(f"np{i}, nq{i}" for i in range(k))

    def walk(name: str, source: str) -> str:
        return f"""{name} AS (SELECT vec_id, x, 0 AS t, 0.0 :: DOUBLE AS y, {start("x[1]")} FROM {source}
  UNION ALL SELECT vec_id, x, t + 1, y{k - 1}, {new} FROM (SELECT *, {step("x[t + 1]")} FROM {name} WHERE t < len(x)))"""

    return f"""WITH RECURSIVE e AS (SELECT vec_id, embedding :: DOUBLE[] AS v FROM embeddings),
x0 AS (SELECT vec_id, list_concat(list_transform(range({edge}, 0, -1), lambda i: 2 * v[1] - v[i + 1]), v,
  list_transform(range(1, {edge + 1}), lambda i: 2 * v[{n}] - v[{n} - i])) AS x FROM e),
{walk("f", "x0")},
x1 AS (SELECT vec_id, list(y ORDER BY t DESC) AS x FROM f WHERE t > 0 GROUP BY vec_id),
{walk("b", "x1")}
SELECT vec_id, ({n + 2 * edge} - t - {edge}) :: INTEGER AS t, round(y + 1e-9, 5) + 0.0 AS filtered FROM b WHERE t BETWEEN {edge + 1} AND {n + edge}"""


@query("g8_recursive_band_pass", sql_sections(S.band_pass_sections(13, 32, 125.0, 5), 33, 64))
def g8_recursive(spark, t):
    """Forward and backward by recursion, edges included."""
    band = S.recursive_band_pass(F.col("embedding").cast(S.DOUBLES), 13, 32, 125.0, 5)
    return elements(t.embeddings.select("vec_id", band.alias("b")), ["vec_id"], "b", "filtered")


@query("g8_band_energy", f"""WITH {SQL_ARRAY_DFT}
SELECT vec_id, round(sum(re * re + im * im) + 1e-9, 5) + 0.0 AS energy FROM z
WHERE k * 125.0 / 64 BETWEEN 13 AND 32 AND k BETWEEN 1 AND 31 GROUP BY vec_id""")
def g8_band_energy(spark, t):
    return signal.band_energy(t.embeddings.select("vec_id", F.col("embedding").cast(S.DOUBLES).alias("e")),
                              ["vec_id"], "e", 13, 32, 125.0).withColumn("energy", rounded(F.col("energy"), 5))


@query("g9_resample_half", f"""WITH {SQL_ARRAY_DFT}
SELECT vec_id, t :: INTEGER AS t, round(sum(CASE WHEN k = 0 THEN re WHEN k = 16 THEN 2 * re * cos(pi() * t)
  ELSE 2 * (re * cos(2 * pi() * k * t / 32) - im * sin(2 * pi() * k * t / 32)) END) / 64 + 1e-9, 5) + 0.0 AS half
FROM z, (SELECT unnest(range(0, 32)) AS t) r WHERE k <= 16 GROUP BY vec_id, t""")
def g9_resample(spark, t):
    e = t.embeddings.select("vec_id", S.resample_half(F.col("embedding").cast(S.DOUBLES)).alias("h"))
    return elements(e, ["vec_id"], "h", "half")


@query("g9_pair_means", f"""WITH {SQL_ARRAYS}
SELECT vec_id, (t // 2) :: INTEGER AS t, round(avg(v) + 1e-9, 5) + 0.0 AS half FROM x GROUP BY vec_id, t // 2""")
def g9_pair_means(spark, t):
    e = t.embeddings.select("vec_id", S.pair_means(F.col("embedding").cast(S.DOUBLES)).alias("h"))
    return elements(e, ["vec_id"], "h", "half")


@query("g11_sliding_spectrum", f"""WITH {SQL_POS},
n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1),
f AS (SELECT user_id, unnest(range(0, n - 16)) AS frame FROM n),
x AS (SELECT f.user_id, frame, pos - frame AS o, abs(value) AS v FROM f JOIN ev ON ev.user_id = f.user_id
  AND pos BETWEEN frame AND frame + 15),
m AS (SELECT user_id, frame, k, sqrt(power(sum(v * cos(2 * pi() * k * o / 16)), 2)
  + power(sum(v * sin(2 * pi() * k * o / 16)), 2)) AS mag
  FROM x, (SELECT unnest(range(0, 16)) AS k) r GROUP BY user_id, frame, k)
SELECT user_id, frame, k :: INTEGER AS k, frame * 16 + k AS row, round(10 * log10(greatest(mag, 1e-4)) + 1e-9, 3) + 0.0 AS db
FROM m""")
def g11_sliding_spectrum(spark, t):
    s = segments(t).withColumn("value", F.abs("value"))
    out = signal.sliding_spectrum(s, USER, "pos", "value", 16)
    # Bins that cancel to rounding noise have no stable decibel value: both sides stop at a floor.
    return out.withColumn("db", rounded(F.greatest(F.col("db"), F.lit(-40.0)), 3))


@query("g11_long_windows_gaps", f"""WITH {SQL_GAPS},
e AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos FROM gev),
n AS (SELECT event_type, count(*) AS n FROM e GROUP BY 1),
f AS (SELECT event_type, unnest(range(0, n - 125)) AS frame FROM n),
x AS (SELECT f.event_type, frame, pos - frame AS o, v, count(v) OVER (PARTITION BY f.event_type, frame) AS known
  FROM f JOIN e ON e.event_type = f.event_type AND pos BETWEEN frame AND frame + 124)
SELECT event_type, frame, k :: INTEGER AS k, CASE WHEN any_value(known) = 125 THEN round(10 * log10(greatest(sqrt(power(sum(v * cos(2 * pi() * k * o / 125)), 2)
  + power(sum(v * sin(2 * pi() * k * o / 125)), 2)), 1e-4)) + 1e-9, 3) + 0.0 END AS db
FROM x, (SELECT unnest([0, 5, 62]) AS k) r GROUP BY event_type, frame, k""")
def g11_long(spark, t):
    """Windows of 125 rows over series with gaps; three of the bins."""
    placed = sequence.segment_rows(with_gaps(t), ["event_type"], ORDER, SIZE).withColumn("v", no_nan(F.col("v")))
    out = signal.sliding_spectrum(placed, ["event_type"], "pos", "v", 125).filter(F.col("k").isin(0, 5, 62))
    return out.select("event_type", "frame", "k", rounded(F.col("db"), 3).alias("db"))


@query("g12_chunk_preprocessing", f"""WITH c AS (SELECT vec_id, list_slice(embedding, 8, 57) AS e FROM embeddings),
x AS (SELECT vec_id, unnest(range(0, 50)) AS t, unnest(e) :: DOUBLE AS v FROM c),
z AS (SELECT vec_id, k, sum(v * cos(2 * pi() * k * t / 50)) AS re, -sum(v * sin(2 * pi() * k * t / 50)) AS im
  FROM x, (SELECT unnest(range(1, 25)) AS k) r GROUP BY vec_id, k),
g AS (SELECT vec_id, k, re * {SQL_GAIN.replace('/ 64', '/ 50')} AS re, im * {SQL_GAIN.replace('/ 64', '/ 50')} AS im
  FROM z WHERE k <= 12)
SELECT vec_id, t :: INTEGER AS t, round(sum(2 * (re * cos(2 * pi() * k * t / 25)
  - im * sin(2 * pi() * k * t / 25))) / 50 + 1e-9, 5) + 0.0 AS value
FROM g, (SELECT unnest(range(0, 25)) AS t) r GROUP BY vec_id, t""")
def g12_preprocess(spark, t):
    done = signal.preprocess_chunks(t.embeddings.select("vec_id", "embedding"), "embedding", 50, 13, 32, 125.0)
    return elements(done, ["vec_id"], "embedding", "value")


@query("c1_interpolate", """WITH e AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS v,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
w AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER b AS p0,
    last_value(v IGNORE NULLS) OVER b AS v0,
    first_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER a AS p1,
    first_value(v IGNORE NULLS) OVER a AS v1 FROM e
  WINDOW b AS (PARTITION BY user_id ORDER BY p ROWS UNBOUNDED PRECEDING),
    a AS (PARTITION BY user_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN p0 IS NULL THEN NULL WHEN p1 IS NULL THEN v0
  ELSE v0 + (v1 - v0) * (p - p0) / (p1 - p0) END + 1e-9, 5) + 0.0 AS value FROM w""")
def c1_interpolate(spark, t):
    e = t.events.select("event_id", "ts", "user_id", F.when(
        F.col("event_type") != "error", F.col("value")).alias("value"))
    done = clean.interpolate(e, USER, ORDER, "value")
    return done.select("event_id", rounded(F.col("value"), 5).alias("value"))


@query("n5_z_scores", f"""WITH {SQL_SEG}
SELECT event_id, round(CASE WHEN stddev_pop(value) OVER w > 0
  THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0 END + 1e-9, 5) + 0.0 AS z
FROM seg WINDOW w AS (PARTITION BY user_id, seg)""")
def n5_z_scores(spark, t):
    z = sequence.z_scores(segments(t), ["user_id", "seg"], "value")
    return z.select("event_id", rounded(F.col("z"), 5).alias("z"))


@query("n4_decibel", """SELECT event_id, round(10 * log10(abs(value) + 1e-10) + 1e-9, 5) + 0.0 AS db FROM events""")
def n4_decibel(spark, t):
    return t.events.select("event_id", rounded(decibel(F.col("value")), 5).alias("db"))


@query("e6_running_mean", """SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS UNBOUNDED PRECEDING) + 1e-9, 4) + 0.0 AS running_mean FROM events""")
def e6_running_mean(spark, t):
    m = profile.running_mean(t.events.select("event_id", "ts", "user_id", "value"), USER, ORDER, "value")
    return m.select("event_id", rounded(F.col("running_mean"), 4).alias("running_mean"))


@query("w11_clip", """SELECT vec_id, i :: INTEGER AS pos, round(list_extract(list_slice(embedding, 8, 57),
  i + 1) :: DOUBLE + 1e-9, 6) + 0.0 AS value FROM embeddings, (SELECT unnest(range(0, 50)) AS i) r""")
def w11_clip(spark, t):
    c = t.embeddings.select("vec_id", sequence.clip(F.col("embedding"), 50).alias("c"))
    return c.select("vec_id", F.posexplode("c").alias("pos", "value")).withColumn(
        "value", rounded(F.col("value").cast("double")))


@query("n7_transpose", """WITH x AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) :: DOUBLE AS v
  FROM embeddings)
SELECT vec_id, (i % 8) :: INTEGER AS channel, (i // 8) :: INTEGER AS t, round(v + 1e-9, 6) + 0.0 AS value FROM x""")
def n7_transpose(spark, t):
    """64 values as 8 time steps of 8 channels, turned into 8 channels."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    c = t.embeddings.select("vec_id", F.posexplode(sequence.transpose(steps)).alias("channel", "c"))
    return c.select("vec_id", "channel", F.posexplode("c").alias("t", "value")).withColumn(
        "value", rounded(F.col("value").cast("double")))


@query("g12_chunk_channels", """WITH x AS (SELECT vec_id, i // 4 AS t, i % 4 AS channel, v FROM
    (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) :: DOUBLE AS v FROM embeddings) WHERE i < 56)
SELECT a.vec_id, lag :: INTEGER AS t, a.channel :: INTEGER AS channel, round(sum(a.v * b.v) + 1e-9, 5) + 0.0 AS corr
FROM x a, (SELECT unnest(range(0, 14)) AS lag) l, x b
WHERE b.vec_id = a.vec_id AND b.channel = a.channel AND b.t = (a.t + lag) % 14 GROUP BY a.vec_id, lag, a.channel""")
def g12_channels(spark, t):
    """Chunks of (time, channel): 14 rows of four channels, autocorrelated channel by channel."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: F.slice("embedding", i * 4 + 1, 4))
    done = signal.preprocess_chunks(t.embeddings.select("vec_id", rows.alias("m")), "m", 14, 13, 32, 125.0, steps=("clip", "autocorrelate"))
    out = done.select("vec_id", F.posexplode("m").alias("t", "row"))
    return out.select("vec_id", "t", F.posexplode("row").alias("channel", "corr")).withColumn("corr", rounded(F.col("corr"), 5))


@query("g12_chunk_frames", f"""WITH {SQL_ARRAYS}, f AS (SELECT unnest(range(0, 9)) AS frame),
y AS (SELECT vec_id, frame, t + 8 - frame * 8 AS o, v FROM x, f WHERE t + 8 BETWEEN frame * 8 AND frame * 8 + 15)
SELECT vec_id, frame :: INTEGER AS frame, k :: INTEGER AS k, round(sqrt(power(sum(v * {SQL_HANN} * cos(2 * pi() * k * o / 16)), 2)
    + power(sum(v * {SQL_HANN} * sin(2 * pi() * k * o / 16)), 2)) / 8 + 1e-9, 5) + 0.0 AS mag
  FROM y, (SELECT unnest(range(0, 9)) AS k) r GROUP BY vec_id, frame, k""")
def g12_frames(spark, t):
    done = signal.preprocess_chunks(t.embeddings.select("vec_id", "embedding"), "embedding", 64, 13, 32, 125.0, steps=("clip", "stft"), frame=16)
    out = done.select("vec_id", F.posexplode("embedding").alias("frame", "bins"))
    return out.select("vec_id", "frame", F.posexplode("bins").alias("k", "mag")).withColumn("mag", rounded(F.col("mag"), 5))

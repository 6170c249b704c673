"""The registered queries over sensing records and their SQL oracles.

Values are rounded to six places (+ 0.0 turns -0.0 into 0.0); infinities and NaN become sentinels."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.functions import design
from lumenspan.model import Record
from lumenspan.operators import aggregates, concat, correct, export, filters, plotdata, space, spectral, timeaxis
from lumenspan.plans.records import embeddings, events, lineitem

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
INF = 1e300


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def long(record: Record) -> DataFrame:
    return record.samples().select("channel", "sample_idx", r6("value").alias("value"))


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


# Oracle fragments: each names the relation x(ch, i, x) of a record.
E = "x AS (SELECT vec_id::BIGINT AS ch, (i - 1)::BIGINT AS i, embedding[i]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"
V = """k AS (SELECT event_type, (row_number() OVER (ORDER BY event_type) - 1)::BIGINT AS ch FROM (SELECT DISTINCT event_type FROM events)),
s AS (SELECT ch, floor(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 3600000000.0)::BIGINT AS i, sum(value) AS v FROM events JOIN k USING (event_type) GROUP BY ALL),
x AS (SELECT ch, g.i, coalesce(v, 0.0)::DOUBLE AS x FROM (SELECT ch, unnest(range(720))::BIGINT AS i FROM k) g LEFT JOIN s USING (ch, i))"""
L = """b AS (SELECT min(l_shipdate::DATE) AS d0, date_diff('day', min(l_shipdate::DATE), max(l_shipdate::DATE)) + 1 AS n FROM lineitem),
s AS (SELECT (l_linenumber - 1)::BIGINT AS ch, date_diff('day', d0, l_shipdate::DATE)::BIGINT AS i, sum(l_extendedprice) AS v FROM lineitem, b GROUP BY ALL),
x AS (SELECT ch, g.i, coalesce(v, 0.0)::DOUBLE AS x FROM (SELECT ch, unnest(range(n))::BIGINT AS i FROM (SELECT DISTINCT ch FROM s), b) g LEFT JOIN s USING (ch, i))"""
OUT = "SELECT ch::DOUBLE AS channel, i::BIGINT AS sample_idx, round({v}, 6) + 0.0 AS value FROM {t}"


def out(v: str = "x", t: str = "x") -> str:
    return OUT.format(v=v, t=t)


def tukey_sql(i: str, m: int | str, alpha: float) -> str:
    return f"""(CASE WHEN {i} <= floor({alpha}::DOUBLE * ({m} - 1) / 2) THEN 0.5::DOUBLE * (1 + cos(pi() * (2 * {i} / ({alpha}::DOUBLE * ({m} - 1)) - 1)))
 WHEN {i} >= {m} - floor({alpha}::DOUBLE * ({m} - 1) / 2) - 1 THEN 0.5::DOUBLE * (1 + cos(pi() * (2 * {i} / ({alpha}::DOUBLE * ({m} - 1)) - 2 / {alpha}::DOUBLE + 1))) ELSE 1::DOUBLE END)"""


def detrend_sql(name: str, source: str, value: str = "x") -> str:
    return f"""{name} AS (SELECT ch, i, {value} - (regr_intercept({value}, i) OVER (PARTITION BY ch) + regr_slope({value}, i) OVER (PARTITION BY ch) * i) AS x FROM {source})"""


def demean_sql(name: str, source: str) -> str:
    return f"{name} AS (SELECT ch, i, x - avg(x) OVER (PARTITION BY ch) AS x FROM {source})"


def taper_sql(name: str, source: str, m: int | str, frac: float) -> str:
    return f"{name} AS (SELECT ch, i, x * {tukey_sql('i', m, 2 * frac)} AS x FROM {source})"


PRE = ", ".join([E, detrend_sql("p1", "x"), demean_sql("p2", "p1"), taper_sql("p3", "p2", 64, 0.05)])


def bucket_sql(n: int, parts: int) -> str:
    b, r = divmod(n, parts)
    return f"(CASE WHEN i < {r * (b + 1)} THEN i // {b + 1} ELSE {r} + (i - {r * (b + 1)}) // {b} END)"


FLAGSHIP = f"""WITH {E}, e AS (SELECT * FROM x WHERE ch BETWEEN 0 AND 49), {demean_sql('a', 'e')}, {detrend_sql('d', 'a')}, {taper_sql('w', 'd', 64, 0.05)}
SELECT ch::DOUBLE AS channel, {bucket_sql(64, 4)}::BIGINT AS segment, round(sqrt(avg(x * x)), 6) + 0.0 AS rms FROM w GROUP BY ALL"""


@query("das_flagship", FLAGSHIP)
def das_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = space.restrict_channels(embeddings(spark, sf_dir), (0, 49))
    tapered = timeaxis.taper(timeaxis.detrend(timeaxis.demean(part)))
    return aggregates.rmsa(tapered, window=0.25).select("channel", "segment", r6("rms").alias("rms"))


# --- slicing ---------------------------------------------------------------------------------------------------
@query("das_trim", f"WITH {V} " + "SELECT ch::DOUBLE AS channel, (i - 100)::BIGINT AS sample_idx, round(x, 6) + 0.0 AS value FROM x WHERE i >= 100 AND i < 299")
def das_trim(spark, sf_dir):
    record = events(spark, sf_dir)
    return long(timeaxis.trim(record, "2024-01-01T00:01:40.500000", datetime(2024, 1, 1, 0, 4, 59)))


@query("das_trim_full", f"WITH {E} " + out() + " WHERE i < 63")
def das_trim_full(spark, sf_dir):
    return long(timeaxis.trim(embeddings(spark, sf_dir)))


@query("das_restrict_channels", f"WITH {E} " + out() + " WHERE ch BETWEEN 50 AND 100")
def das_restrict_channels(spark, sf_dir):
    return long(space.restrict_channels(embeddings(spark, sf_dir), (50, 100)))


@query("das_get_channel", f"WITH {E} " + out() + " WHERE ch = 42")
def das_get_channel(spark, sf_dir):
    record = embeddings(spark, sf_dir)
    return long(Record(space.get_data(record, 42), record.meta))


def times_sql(time: str) -> str:
    return f"WITH {E} SELECT ch::DOUBLE AS channel, i AS sample_idx, round(x, 6) + 0.0 AS value, {time} AS time FROM x"


def timed(record: Record, time_type: str) -> DataFrame:
    return record.timed_samples(time_type).select("channel", "sample_idx", r6("value").alias("value"), "time")


@query("das_times_utc", times_sql("TIMESTAMP '2024-01-01' + to_microseconds(i * 15625)"))
def das_times_utc(spark, sf_dir):
    return timed(embeddings(spark, sf_dir), "UTC")


@query("das_times_isoformat", times_sql("strftime(TIMESTAMP '2024-01-01' + to_microseconds(i * 15625), '%Y-%m-%dT%H:%M:%S.%fZ')"))
def das_times_isoformat(spark, sf_dir):
    return timed(embeddings(spark, sf_dir), "isoformat")


@query("das_times_matplotlib", times_sql("round((epoch_us(TIMESTAMP '2024-01-01') + i * 15625) / 86400000000.0, 9)::DOUBLE"))
def das_times_matplotlib(spark, sf_dir):
    return timed(embeddings(spark, sf_dir), "matplotlib").withColumn("time", F.round("time", 9))


@query("das_downsample", f"WITH {E} " + out() + " WHERE ch % 2 = 0")
def das_downsample(spark, sf_dir):
    return long(space.resample(embeddings(spark, sf_dir), "downsampling"))


@query("das_upsample", f"WITH {E}, m AS (SELECT ch::DOUBLE AS ch, i, x FROM x UNION ALL SELECT * FROM (SELECT ch + 0.5, i, (x + lead(x) OVER (PARTITION BY i ORDER BY ch)) / 2 AS x FROM x) WHERE x IS NOT NULL) " + out(t="m"))
def das_upsample(spark, sf_dir):
    return long(space.resample(embeddings(spark, sf_dir), "upsampling"))


@query("das_integer_decimation", f"WITH {E} SELECT ch::DOUBLE AS channel, (i // 3)::BIGINT AS sample_idx, round(x, 6) + 0.0 AS value FROM x WHERE i % 3 = 0")
def das_integer_decimation(spark, sf_dir):
    return long(timeaxis.integer_decimation(embeddings(spark, sf_dir), 3))


@query("das_record_section", f"WITH {E}, e AS (SELECT * FROM x WHERE ch BETWEEN 10 AND 19), m AS (SELECT max(abs(x)) AS m FROM e) SELECT ch::DOUBLE AS channel, i AS sample_idx, round(x * (1.5 / m) + (ch - 10), 6) + 0.0 AS offset_value FROM e, m")
def das_record_section(spark, sf_dir):
    rows = plotdata.record_section(embeddings(spark, sf_dir), (10, 19))
    return rows.select("channel", "sample_idx", r6("offset_value").alias("offset_value"))


# --- corrections -----------------------------------------------------------------------------------------------
@query("das_instr_silixa", f"WITH {E} " + out("x * (116e-9::DOUBLE * 64 / 10 / 8192) * 1e12::DOUBLE"))
def das_instr_silixa(spark, sf_dir):
    record = embeddings(spark, sf_dir, company="silixa", units="counts", gauge_length=10.0)
    return long(timeaxis.scale(correct.instr_correct(record), 1e12))


@query("das_instr_quantx", f"WITH {E} " + out("x * (116e-9::DOUBLE * 64 / 10 / 65536) * 1e12::DOUBLE"))
def das_instr_quantx(spark, sf_dir):
    record = embeddings(spark, sf_dir, company="quantx", units="rad * 2PI / 2^16", gauge_length=10.0)
    return long(timeaxis.scale(correct.instr_correct(record), 1e12))


@query("das_instr_asn", f"WITH {E} " + out("x / 9.2::DOUBLE"))
def das_instr_asn(spark, sf_dir):
    record = embeddings(spark, sf_dir, company="asn", units="rad/(strain*m)", conv_factor=9.2)
    return long(correct.instr_correct(record))


@query("das_instr_bam", f"WITH {E} " + out("x * (1e-6::DOUBLE / 18.4::DOUBLE) * 1e6::DOUBLE"))
def das_instr_bam(spark, sf_dir):
    record = embeddings(spark, sf_dir, company="bam", format="npz", units="counts")
    return long(timeaxis.scale(correct.instr_correct(record, "strain"), 1e6))


@query("das_instr_terra15", f"WITH {E}, d AS (SELECT ch + 2 AS ch, i, (lead(x, 5) OVER (PARTITION BY i ORDER BY ch) - x) / 5 AS x FROM x) " + out(t="d") + " WHERE x IS NOT NULL")
def das_instr_terra15(spark, sf_dir):
    return long(correct.instr_correct(embeddings(spark, sf_dir, company="terra15", units="m/s", gauge_length=5.0)))


# --- per-trace mathematics ---------------------------------------------------------------------------------------
@query("das_demean", f"WITH {E}, {demean_sql('y', 'x')} " + out(t="y"))
def das_demean(spark, sf_dir):
    return long(timeaxis.demean(embeddings(spark, sf_dir)))


@query("das_demean_channels", f"WITH {E} " + out("x - avg(x) OVER (PARTITION BY i)"))
def das_demean_channels(spark, sf_dir):
    return long(space.demean_channels(embeddings(spark, sf_dir)))


@query("das_detrend", f"WITH {V}, {detrend_sql('y', 'x')} " + out(t="y"))
def das_detrend(spark, sf_dir):
    return long(timeaxis.detrend(events(spark, sf_dir)))


QUADRATIC = f"""WITH {V}, u AS (SELECT ch, i, x, (i - 359.5) / 359.5 AS t FROM x),
m AS (SELECT ch, avg(x) AS a, sum(x * t) / sum(t * t) AS b, avg(t * t) AS t2, sum(x * (t * t - q.t2)) / sum((t * t - q.t2) * (t * t - q.t2)) AS c FROM u, (SELECT avg(t * t) AS t2 FROM u WHERE ch = 0) q GROUP BY ch)
SELECT ch::DOUBLE AS channel, i AS sample_idx, round(x - a - b * t - c * (t * t - t2), 6) + 0.0 AS value FROM u JOIN m USING (ch)"""


@query("das_detrend_quadratic", QUADRATIC)
def das_detrend_quadratic(spark, sf_dir):
    return long(timeaxis.detrend(events(spark, sf_dir), 2))


@query("das_detrend_channels", f"WITH {E} " + out("x - (regr_intercept(x, ch) OVER (PARTITION BY i) + regr_slope(x, ch) OVER (PARTITION BY i) * ch)"))
def das_detrend_channels(spark, sf_dir):
    return long(space.detrend_channels(embeddings(spark, sf_dir)))


@query("das_taper", f"WITH {E}, {taper_sql('y', 'x', 64, 0.05)} " + out(t="y"))
def das_taper(spark, sf_dir):
    return long(timeaxis.taper(embeddings(spark, sf_dir)))


#: The number of channels of E, as SQL.
WIDTH = "(SELECT count(*) FROM embeddings)"


@query("das_taper_channels", f"WITH {E} " + out(f"x * {tukey_sql('ch', WIDTH, 0.1)}"))
def das_taper_channels(spark, sf_dir):
    record = embeddings(spark, sf_dir)
    return long(space.taper_channels(record, record.traces.count()))


DETAPER = f"CASE WHEN {tukey_sql('i', 64, 0.1)} = 0 THEN CASE WHEN x > 0 THEN 1e300 WHEN x < 0 THEN -1e300 ELSE 0 END ELSE round(x / {tukey_sql('i', 64, 0.1)}, 6) + 0.0 END"


@query("das_detaper", f"WITH {E} SELECT ch::DOUBLE AS channel, i AS sample_idx, ({DETAPER})::DOUBLE AS value FROM x")
def das_detaper(spark, sf_dir):
    rows = timeaxis.detaper(embeddings(spark, sf_dir)).samples()
    plain = F.when(F.col("value") == float("inf"), INF).when(F.col("value") == float("-inf"), -INF).when(F.isnan("value"), 0.0)
    return rows.select("channel", "sample_idx", plain.otherwise(r6("value")).alias("value"))


def integral_sql(source: str, name: str, m: int | str, dt: str) -> str:
    return f"""{taper_sql(name + '1', source, m, 0.05)}, {name}2 AS (SELECT ch, i, coalesce((x + lag(x) OVER (PARTITION BY ch ORDER BY i)) * {dt} / 2, 0) AS x FROM {name}1),
{name}3 AS (SELECT ch, i, sum(x) OVER (PARTITION BY ch ORDER BY i ROWS UNBOUNDED PRECEDING) AS x FROM {name}2), {detrend_sql(name, name + '3')}"""


INTEGRAL = f"WITH {V}, {integral_sql('x', 'y', 720, '1.0::DOUBLE')} " + "SELECT ch::DOUBLE AS channel, i AS sample_idx, round(x, 4) + 0.0 AS value FROM y"


@query("das_integrate", INTEGRAL)
def das_integrate(spark, sf_dir):
    return timeaxis.integrate(events(spark, sf_dir)).samples().select("channel", "sample_idx", (F.round("value", 4) + 0.0).alias("value"))


@query("das_differentiate", f"WITH {E} " + out("""CASE WHEN i = 0 THEN (lead(x) OVER w - x) * 64 WHEN i = 63 THEN (x - lag(x) OVER w) * 64 ELSE (lead(x) OVER w - lag(x) OVER w) * 32 END""") + " WINDOW w AS (PARTITION BY ch ORDER BY i)")
def das_differentiate(spark, sf_dir):
    return long(timeaxis.differentiate(embeddings(spark, sf_dir)))


@query("das_differentiate_channels", f"WITH {E} " + out("(coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x)) / (CASE WHEN lead(x) OVER w IS NULL OR lag(x) OVER w IS NULL THEN 1 ELSE 2 END)") + " WINDOW w AS (PARTITION BY i ORDER BY ch)")
def das_differentiate_channels(spark, sf_dir):
    return long(space.differentiate_channels(embeddings(spark, sf_dir)))


INTEGRAL_CHANNELS = f"""WITH {E}, e AS (SELECT i AS ch, ch AS i, x FROM x), {integral_sql('e', 'y', WIDTH, '1.0::DOUBLE')}
SELECT i::DOUBLE AS channel, ch AS sample_idx, round(x, 6) + 0.0 AS value FROM y"""


@query("das_integrate_channels", INTEGRAL_CHANNELS)
def das_integrate_channels(spark, sf_dir):
    record = embeddings(spark, sf_dir)
    return long(space.integrate_channels(record, record.traces.count()))


@query("das_preprocess", f"WITH {PRE} " + out(t="p3"))
def das_preprocess(spark, sf_dir):
    return long(timeaxis.preprocess(embeddings(spark, sf_dir)))


# --- aggregates --------------------------------------------------------------------------------------------------
@query("das_std", f"WITH {E} SELECT ch::DOUBLE AS channel, round(stddev_pop(x), 6) + 0.0 AS std FROM x GROUP BY ch")
def das_std(spark, sf_dir):
    return aggregates.std(embeddings(spark, sf_dir)).select("channel", r6("std").alias("std"))


RMSA = f"WITH {V}, q AS (SELECT ch, {bucket_sql(720, 7)}::BIGINT AS segment, i, x FROM x) SELECT ch::DOUBLE AS channel, segment, (min(i) + count(*) // 2)::BIGINT AS time_idx, round(sqrt(avg(x * x)), 6) + 0.0 AS rms FROM q GROUP BY ch, segment"


@query("das_rmsa", RMSA)
def das_rmsa(spark, sf_dir):
    return aggregates.rmsa(events(spark, sf_dir), 100.0).select("channel", "segment", "time_idx", r6("rms").alias("rms"))


PP = f"""WITH {E}, g AS (SELECT ch, max(x) - min(x) AS pp, abs(arg_max(i, (x, -i)) - arg_min(i, (x, i))) AS apart FROM x GROUP BY ch),
w AS (SELECT ch, max(pp) AS pp FROM (SELECT ch, i // 16 AS k, max(x) - min(x) AS pp FROM x WHERE i // 16 < 63 // 16 GROUP BY ALL) GROUP BY ch)
SELECT ch::DOUBLE AS channel, round(CASE WHEN apart > 32 THEN w.pp ELSE g.pp END, 6) + 0.0 AS pp FROM g JOIN w USING (ch)"""


@query("das_peak_to_peak", PP)
def das_peak_to_peak(spark, sf_dir):
    return aggregates.peak_to_peak(embeddings(spark, sf_dir)).select("channel", r6("pp").alias("pp"))


@query("das_colour_limit", f"WITH {E} SELECT round(max(abs(x)), 6) AS \"limit\" FROM x")
def das_colour_limit(spark, sf_dir):
    return aggregates.colour_limit(embeddings(spark, sf_dir)).select(F.round("limit", 6).alias("limit"))


# --- filters -----------------------------------------------------------------------------------------------------
def sos_sql(sos: np.ndarray, source: str, name: str, reverse: bool = False) -> str:
    """Recursive CTEs, one a section, over relation source(ch, i, x) of 64 samples."""
    parts, last = [], source
    if reverse:
        parts.append(f"{name}r AS (SELECT ch, 63 - i AS i, x FROM {source})")
        last = f"{name}r"
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        b0, b1, b2, a1, a2 = (f"({v!r}::DOUBLE)" for v in map(float, (b0, b1, b2, a1, a2)))
        y = f"{b0} * n.x + p.z1"
        parts.append(f"""{name}{k} AS (SELECT ch, 0::BIGINT AS i, {b0} * x AS x, {b1} * x - {a1} * {b0} * x AS z1, {b2} * x - {a2} * {b0} * x AS z2 FROM {last} WHERE i = 0
 UNION ALL SELECT p.ch, n.i, {y}, {b1} * n.x - {a1} * ({y}) + p.z2, {b2} * n.x - {a2} * ({y}) FROM {name}{k} p JOIN {last} n ON n.ch = p.ch AND n.i = p.i + 1)""")
        last = f"{name}{k}"
    parts.append(f"{name} AS (SELECT ch, {'63 - i' if reverse else 'i'} AS i, x FROM {last})")
    return ", ".join(parts)


def band_oracle(f_type, freq, zerophase=False, pre=False, sos=None) -> str:
    sos = filters.design_band(f_type, freq, 64.0) if sos is None else sos
    source = "p3" if pre else "x"
    steps = sos_sql(sos, source, "f")
    if zerophase:
        steps += ", " + sos_sql(sos, "f", "g", True)
    return f"WITH RECURSIVE {PRE if pre else E}, {steps} " + out(t="g" if zerophase else "f")


for _name, _type, _freq, _zero in (
    ("das_lowpass", "lowpass", 10.0, False), ("das_highpass", "highpass", 10.0, False), ("das_bandpass", "bandpass", (5.0, 15.0), False),
    ("das_bandstop", "bandstop", (5.0, 15.0), False), ("das_lowpass_zerophase", "lowpass", 10.0, True), ("das_bandpass_zerophase", "bandpass", (5.0, 15.0), True),
):
    query(_name, band_oracle(_type, _freq, _zero))(lambda spark, sf_dir, t=_type, f=_freq, z=_zero: long(filters.band_filter(embeddings(spark, sf_dir), t, f, zerophase=z)))


@query("das_filter_preprocessed", band_oracle("bandpass", (5.0, 15.0), pre=True))
def das_filter_preprocessed(spark, sf_dir):
    return long(filters.filter(embeddings(spark, sf_dir), "bandpass", (5.0, 15.0)))


@query("das_lowpass_cheby2", band_oracle(None, None, sos=filters.cheby_2_sections(16.0, 64.0)[0]))
def das_lowpass_cheby2(spark, sf_dir):
    return long(filters.lowpass_cheby_2(embeddings(spark, sf_dir), 16.0))


def taps_sql(taps: np.ndarray) -> str:
    return "t AS (SELECT * FROM (VALUES " + ", ".join(f"({j}, {float(b)!r}::DOUBLE)" for j, b in enumerate(taps)) + ") v(j, b))"


def convolution_sql(base: str, taps: np.ndarray, at: str, index: str, places: int = 6) -> str:
    """sum_j b_j x[o - j] for the outputs o that `at` generates."""
    return f"""WITH {base}, {taps_sql(taps)}, o AS (SELECT ch, unnest({at})::BIGINT AS o FROM (SELECT ch, max(i) + 1 AS n FROM x GROUP BY ch))
SELECT o.ch::DOUBLE AS channel, ({index})::BIGINT AS sample_idx, round(sum(b * x), {places}) + 0.0 AS value FROM o, t, x WHERE x.ch = o.ch AND x.i = o.o - t.j GROUP BY o.ch, o.o"""


FIR_DECIMATE = convolution_sql(L, design.decimation_taps(4), "range(90, n, 4)", "(o.o - 90) // 4", 2)


@query("das_fir_decimate", FIR_DECIMATE)
def das_fir_decimate(spark, sf_dir):
    rows = filters.decimate(lineitem(spark, sf_dir), 0.25).samples()
    return rows.select("channel", "sample_idx", (F.round("value", 2) + 0.0).alias("value"))


@query("das_remez_bandpass", convolution_sql(E, filters.remez_bandpass_taps(8.0, 16.0, 64.0), "range(0, n + 49)", "o.o"))
def das_remez_bandpass(spark, sf_dir):
    return long(filters.remez_fir(embeddings(spark, sf_dir), 8.0, 16.0))


@query("das_lowpass_fir", convolution_sql(E, filters.sinc_taps(10.0, 64.0, 64), "range(32, n + 31)", "o.o - 32"))
def das_lowpass_fir(spark, sf_dir):
    return long(filters.lowpass_fir(embeddings(spark, sf_dir), 10.0, 64))


def padded_pass_sql(sos: np.ndarray, source: str, name: str, last: int, reverse: bool = False) -> str:
    """Recursive CTEs, one a section, over source(ch, i, x) of last + 1 samples, each from the steady state of its first."""
    parts = [f"{name}s AS MATERIALIZED (SELECT ch, {f'{last} - i' if reverse else 'i'} AS i, x FROM {source})"]
    before, scale = f"{name}s", f"(SELECT x FROM {name}s s WHERE s.ch = n.ch AND s.i = 0)"
    for k, row in enumerate(sos):
        b0, b1, b2, _, a1, a2 = map(float, row)
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        z2 = b2 - a2 * gain
        z1 = b1 - a1 * gain + z2
        c = lambda v: f"({v!r}::DOUBLE)"
        y0 = f"({c(b0)} * n.x + {c(z1)} * {scale})"
        y = f"({c(b0)} * n.x + p.z1)"
        parts.append(f"""{name}{k} AS MATERIALIZED (SELECT n.ch, 0::BIGINT AS i, {y0} AS x, {c(b1)} * n.x - {c(a1)} * {y0} + {c(z2)} * {scale} AS z1, {c(b2)} * n.x - {c(a2)} * {y0} AS z2 FROM {before} n WHERE n.i = 0
 UNION ALL SELECT p.ch, n.i, {y}, {c(b1)} * n.x - {c(a1)} * {y} + p.z2, {c(b2)} * n.x - {c(a2)} * {y} FROM {name}{k} p JOIN {before} n ON n.ch = p.ch AND n.i = p.i + 1)""")
        before, scale = f"{name}{k}", f"({c(gain)} * {scale})"
    parts.append(f"{name} AS MATERIALIZED (SELECT ch, {f'{last} - i' if reverse else 'i'} AS i, x FROM {before})")
    return ", ".join(parts)


_CHEBY1 = design.iir_sos("cheby1", 8, 0.8 / 4, "lowpass", 0.05)
#: V with an odd extension of 27 samples at both ends, forward, backward, every fourth sample.
CHEBY1 = f"""WITH RECURSIVE {V}, e AS MATERIALIZED (SELECT ch, i + 27 AS i, x FROM x
 UNION ALL SELECT x.ch, 27 - x.i, 2 * f.x - x.x FROM x JOIN x f ON f.ch = x.ch AND f.i = 0 WHERE x.i BETWEEN 1 AND 27
 UNION ALL SELECT x.ch, 27 + 719 + (719 - x.i), 2 * f.x - x.x FROM x JOIN x f ON f.ch = x.ch AND f.i = 719 WHERE x.i BETWEEN 692 AND 718),
{padded_pass_sql(_CHEBY1, 'e', 'f', 773)}, {padded_pass_sql(_CHEBY1, 'f', 'g', 773, True)}
SELECT ch::DOUBLE AS channel, ((i - 27) // 4)::BIGINT AS sample_idx, round(x, 4) + 0.0 AS value FROM g WHERE i BETWEEN 27 AND 746 AND (i - 27) % 4 = 0"""


@query("das_decimate_cheby1", CHEBY1)
def das_decimate_cheby1(spark, sf_dir):
    rows = filters.decimate(events(spark, sf_dir), 0.25, None).samples()
    return rows.select("channel", "sample_idx", (F.round("value", 4) + 0.0).alias("value"))


# --- concatenation -----------------------------------------------------------------------------------------------
def halves(spark, sf_dir, shift: int) -> tuple[Record, Record]:
    """The first 300 hours of V and the rest, the second part starting `shift` samples late."""
    whole = events(spark, sf_dir)
    first = Record(whole.traces.withColumn("samples", F.slice("samples", 1, 300)), replace(whole.meta, n=300))
    rest = Record(whole.traces.withColumn("samples", F.slice("samples", 301, 420)), replace(whole.meta, n=420, start_time=whole.meta.time_of(300 + shift)))
    return first, rest


def concat_sql(gap: str) -> str:
    return f"WITH {V}, c AS (SELECT ch, i, x FROM x WHERE i < 300 UNION ALL SELECT ch, i + 5, x FROM x WHERE i >= 300 UNION ALL SELECT ch, unnest(range(300, 305)), {gap} FROM k) " + out(t="c")


@query("das_concat_gap", concat_sql("-1.5"))
def das_concat_gap(spark, sf_dir):
    first, second = halves(spark, sf_dir, 5)
    return long(concat.concatenate(second, first, -1.5))


@query("das_concat_nan", concat_sql("1e300"))
def das_concat_nan(spark, sf_dir):
    rows = concat.concatenate(*halves(spark, sf_dir, 5), None).samples()
    return rows.select("channel", "sample_idx", F.when(F.isnan("value"), INF).otherwise(r6("value")).alias("value"))


@query("das_concat_overlap", f"WITH {V}, c AS (SELECT ch, i, x FROM x WHERE i < 300 UNION ALL SELECT ch, i - 7, x FROM x WHERE i >= 307) " + out(t="c"))
def das_concat_overlap(spark, sf_dir):
    return long(concat.concatenate(*halves(spark, sf_dir, -7)))


# --- spectra -----------------------------------------------------------------------------------------------------
def dft_sql(source: str, n: int, bins: int, length: int = 0) -> str:
    """relation dft(ch, k, re, im): bins k of a transform of length n over source(ch, i, x)."""
    angle = f"2 * pi() * ((k * i) % {n}) / {n}"
    return f"dft AS (SELECT ch, k, sum(x * cos({angle})) AS re, -sum(x * sin({angle})) AS im FROM {source}, (SELECT unnest(range({bins}))::BIGINT AS k) GROUP BY ch, k)"


def spectrum_sql(base: str, source: str, n: int, fs: float, where: str = "") -> str:
    return f"WITH {base}, {dft_sql(source, n, n // 2)} SELECT ch::DOUBLE AS channel, k AS freq_idx, k * ({fs / n!r}::DOUBLE) AS freq, round(2.0 / {n} * sqrt(re * re + im * im), 6) + 0.0 AS amplitude FROM dft {where}"


def amplitude(rows: DataFrame, name: str = "amplitude") -> DataFrame:
    return rows.select("channel", "freq_idx", "freq", r6(name).alias(name))


@query("das_spectrum", spectrum_sql(PRE, "p3", 64, 64.0))
def das_spectrum(spark, sf_dir):
    return amplitude(spectral.spectrum(embeddings(spark, sf_dir)))


@query("das_spectrum_raw_channels", spectrum_sql(E, "x", 128, 64.0, "WHERE ch IN (3, 7)"))
def das_spectrum_raw_channels(spark, sf_dir):
    return amplitude(spectral.spectrum(embeddings(spark, sf_dir), [3, 7], pre=False, nfft=2))


SPECTRUM_NORM = f"WITH {PRE}, {dft_sql('p3', 64, 32)}, a AS (SELECT ch, k, sqrt(re * re + im * im) AS a FROM dft) SELECT ch::DOUBLE AS channel, k AS freq_idx, k * 1.0::DOUBLE AS freq, round(a / max(a) OVER (PARTITION BY ch), 6) + 0.0 AS amplitude FROM a"


@query("das_spectrum_norm", SPECTRUM_NORM)
def das_spectrum_norm(spark, sf_dir):
    return amplitude(spectral.spectrum(embeddings(spark, sf_dir), norm=True))


def spectrogram_sql() -> str:
    return f"WITH {PRE}, q AS (SELECT ch, i + 15 AS i, x FROM p3), {dft_sql('q', 95, 47)} SELECT ch::DOUBLE AS channel, k AS freq_idx, k * ({64 / 95!r}::DOUBLE) AS freq, round(2.0 / 95 * sqrt(re * re + im * im), 6) + 0.0 AS amplitude FROM dft"


@query("das_spectrogram", spectrogram_sql())
def das_spectrogram(spark, sf_dir):
    return amplitude(spectral.spectrogram(embeddings(spark, sf_dir)))


WELCH = f"""WITH {V}, f AS (SELECT ch, f, i - 120 * f AS i, x FROM x, (SELECT unnest(range(5))::BIGINT AS f) WHERE i >= 120 * f AND i < 120 * f + 240),
d AS (SELECT ch * 10 + f AS ch, i, (x - avg(x) OVER (PARTITION BY ch, f)) * (0.5 - 0.5 * cos(2 * pi() * i / 240)) AS x FROM f), {dft_sql('d', 240, 121)},
w AS (SELECT sum((0.5 - 0.5 * cos(2 * pi() * i / 240)) ** 2) AS w FROM (SELECT unnest(range(240)) AS i))
SELECT (ch // 10)::DOUBLE AS channel, k AS freq_idx, k * ({1 / 240!r}::DOUBLE) AS freq, round(avg((re * re + im * im) / w * CASE WHEN k IN (0, 120) THEN 1 ELSE 2 END), 4) + 0.0 AS power FROM dft, w GROUP BY ch // 10, k"""


@query("das_psd_welch", WELCH)
def das_psd_welch(spark, sf_dir):
    rows = spectral.psd(events(spark, sf_dir), pre=False, n=240)
    return rows.select("channel", "freq_idx", "freq", (F.round("power", 4) + 0.0).alias("power"))


def stft_sql() -> str:
    """Frames of 12 of E's 64 samples, hop 6, 64 bins of 1 Hz, channel 5."""
    w = f"{tukey_sql('i', 13, 0.25)}"
    return f"""WITH {E}, f AS (SELECT f AS ch, i - 6 * f AS i, x FROM x, (SELECT unnest(range(9))::BIGINT AS f) WHERE ch = 5 AND i >= 6 * f AND i < 6 * f + 12),
d AS (SELECT ch, i, (x - avg(x) OVER (PARTITION BY ch)) * {w} AS x FROM f), {dft_sql('d', 64, 33)}, w AS (SELECT sum({w} ** 2) AS w FROM (SELECT unnest(range(12)) AS i))
SELECT 5::DOUBLE AS channel, ch AS frame, (ch * 6 + 6.0) / 64::DOUBLE AS time_s, k AS freq_idx, k::DOUBLE AS freq, round((re * re + im * im) / (64 * w) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END, 6) + 0.0 AS power FROM dft, w"""


@query("das_channel_spectrogram", stft_sql())
def das_channel_spectrogram(spark, sf_dir):
    return spectral.channel_spectrogram(embeddings(spark, sf_dir), 5).drop("record_id").withColumn("power", r6("power"))


def hilbert_sql(base: str, n: int) -> str:
    """Relation y(ch, i, x, h) of an even number of samples: h the Hilbert transform."""
    half, turn = n // 2, f"2 * pi() * ((k * i) % {n}) / {n}"
    return f"""{base}, {dft_sql('x', n, half + 1)}, h AS (SELECT dft.ch, i, sum(CASE WHEN k IN (0, {half}) THEN 0 ELSE 2 END * (re * sin({turn}) + im * cos({turn}))) / {n} AS h FROM dft, (SELECT unnest(range({n}))::BIGINT AS i) GROUP BY dft.ch, i),
y AS (SELECT x.ch, x.i, x, h FROM x JOIN h USING (ch, i))"""


HILBERT = hilbert_sql(E, 64)


@query("das_hilbert", f"WITH {HILBERT} SELECT ch::DOUBLE AS channel, i AS sample_idx, round(x, 6) + 0.0 AS re, round(h, 6) + 0.0 AS im FROM y")
def das_hilbert(spark, sf_dir):
    rows = spectral.hilbert(embeddings(spark, sf_dir)).select("channel", F.posexplode("analytic").alias("sample_idx", "z"))
    return rows.select("channel", F.col("sample_idx").cast("long").alias("sample_idx"), r6("z.re").alias("re"), r6("z.im").alias("im"))


@query("das_envelope", f"WITH {HILBERT} " + out("sqrt(x * x + h * h)", "y"))
def das_envelope(spark, sf_dir):
    return long(spectral.envelope(embeddings(spark, sf_dir)))


@query("das_envelope_ref", f"WITH {HILBERT} " + out("sqrt(2 * x * x + h * h)", "y"))
def das_envelope_ref(spark, sf_dir):
    return long(spectral.envelope_ref(embeddings(spark, sf_dir)))


FK = f"""WITH {E}, c AS (SELECT count(*)::BIGINT AS n FROM embeddings), e AS (SELECT (ch + (n + 1) // 2) % n AS ch, (i + 32) % 64 AS i, x FROM x, c), {dft_sql('e', 64, 64)},
a AS (SELECT d, cos(2 * pi() * d / n) AS c, sin(2 * pi() * d / n) AS s FROM (SELECT n, unnest(range(n))::BIGINT AS d FROM c)),
z AS (SELECT k AS f, m AS k, sum(re * c + im * s) AS re, sum(im * c - re * s) AS im FROM dft, (SELECT n, unnest(range(n))::BIGINT AS m FROM c) JOIN a ON d = (m * ch) % n GROUP BY ALL)
SELECT (k + n // 2) % n AS k_idx, (f + 32) % 64 AS freq_idx, ((k + n // 2) % n - n // 2) / n::DOUBLE AS k, ((f + 32) % 64 - 32)::DOUBLE AS freq, round(sqrt(re * re + im * im), 4) + 0.0 AS magnitude FROM z, c"""


@query("das_fk_spectrum", FK)
def das_fk_spectrum(spark, sf_dir):
    record = embeddings(spark, sf_dir)
    rows = spectral.fk_spectrum(record, record.traces.count()).drop("record_id")
    return rows.withColumn("magnitude", F.round("magnitude", 4) + 0.0)


def kept_sql(name: str, n: str, low: float, high: float, fs: float) -> str:
    """Relation (d, w): the real kernel of a transform of length n that keeps |frequency| from low to high."""
    return f"""{name} AS (SELECT d, sum(cos(2 * pi() * ((k * d) % n) / n)) / any_value(n) AS w FROM (SELECT n, d, unnest(range(n))::BIGINT AS k FROM (SELECT n, unnest(range(n))::BIGINT AS d FROM (SELECT {n}::BIGINT AS n)))
 WHERE least(k, n - k) * {fs}::DOUBLE / n BETWEEN {low} AND {high} GROUP BY d)"""


FK_FILTER = f"""WITH {E}, c AS (SELECT count(*)::BIGINT AS n FROM embeddings), {kept_sql('ft', '64', 5.0, 20.0, 64.0)}, {kept_sql('fk', WIDTH, 0.0, 0.25, 1.0)},
y AS (SELECT ch, o AS i, sum(w * x) AS x FROM x, (SELECT unnest(range(64))::BIGINT AS o) JOIN ft ON d = (o - i + 64) % 64 GROUP BY ch, o),
z AS (SELECT o AS ch, i, sum(w * x) AS x FROM y, (SELECT n, unnest(range(n))::BIGINT AS o FROM c) JOIN fk ON d = (o - ch + n) % n GROUP BY o, i) """


@query("das_fk_filter", FK_FILTER + out(t="z"))
def das_fk_filter(spark, sf_dir):
    record = embeddings(spark, sf_dir)
    return long(spectral.fk_filter(record, record.traces.count(), (5.0, 20.0), (0.0, 0.25)))


# --- plots and export --------------------------------------------------------------------------------------------
@query("das_waterfall", f"WITH {E} SELECT ch::DOUBLE AS channel, i AS sample_idx, round(x, 6) + 0.0 AS value, round((SELECT max(abs(x)) FROM x), 6) AS \"limit\" FROM x")
def das_waterfall(spark, sf_dir):
    return plotdata.waterfall(embeddings(spark, sf_dir)).select("channel", "sample_idx", r6("value").alias("value"), r6("limit").alias("limit"))


@query("das_channel_plot", f"WITH {E} SELECT i AS sample_idx, TIMESTAMP '2024-01-01' + to_microseconds(i * 15625) AS time, round(x, 6) + 0.0 AS value, round(1.2::DOUBLE * max(abs(x)) OVER (), 6) AS y_limit FROM x WHERE ch = 9")
def das_channel_plot(spark, sf_dir):
    rows = plotdata.channel_plot(embeddings(spark, sf_dir), 9)
    return rows.select("sample_idx", "time", r6("value").alias("value"), r6("y_limit").alias("y_limit"))


@query("das_export", "SELECT 'standard' AS network, lpad(vec_id::VARCHAR, 5, '0') AS station, TIMESTAMP '2024-01-01' AS starttime, 0.015625::DOUBLE AS delta, len(embedding)::BIGINT AS npts, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total FROM embeddings")
def das_export(spark, sf_dir):
    rows = export.as_traces(embeddings(spark, sf_dir))
    return rows.select("network", "station", "starttime", "delta", "npts", r6(timeaxis.total(F.col("samples"))).alias("total"))

"""Queries over the same recordings in chunks of time: none of their operators holds a whole channel in a row or a task.

Where an operator exists for whole traces, its SQL is the same."""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta

from pyspark.sql import functions as F

from lumenspan.operators import chunkmath, chunks, filters, longfft, pyramid, sweep, windows
from lumenspan.plans import catalogue as c
from lumenspan.plans.catalogue import amplitude, out, query, r6
from lumenspan.plans.records import embeddings, events, lineitem

#: Samples of a chunk, and numbers that meet in a task.
V_CHUNK, E_CHUNK, L_CHUNK, CELLS = 100, 10, 300, 1 << 12


def long_chunks(record: chunks.Chunked, places: int = 6):
    """channel, sample_idx, value, rounded once."""
    rows = record.chunks.select("channel", "start", F.posexplode("samples").alias("i", "value"))
    return rows.select("channel", (F.col("start") + F.col("i")).cast("long").alias("sample_idx"), (F.round("value", places) + 0.0).alias("value"))


def e(spark, sf_dir):
    return chunks.chunked(embeddings(spark, sf_dir), E_CHUNK)


def v(spark, sf_dir):
    return chunks.chunked(events(spark, sf_dir), V_CHUNK)


def channels_of(spark, sf_dir) -> int:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()


# --- transforms --------------------------------------------------------------------------------------------------
PRE_V = ", ".join([c.V, c.detrend_sql("p1", "x"), c.demean_sql("p2", "p1"), c.taper_sql("p3", "p2", 720, 0.05)])


@query("das_long_spectrum", c.spectrum_sql(PRE_V, "p3", 720, 1.0))
def das_long_spectrum(spark, sf_dir):
    return amplitude(longfft.spectrum(v(spark, sf_dir), cells=CELLS))


#: 719 samples, a prime, of which no row fits in a task of 512 numbers: by chirps.
PRIME = f"{c.V}, q AS (SELECT * FROM x WHERE i < 719)"


@query("das_long_spectrum_prime", c.spectrum_sql(PRIME, "q", 719, 1.0))
def das_long_spectrum_prime(spark, sf_dir):
    return amplitude(longfft.spectrum(chunks.trim(v(spark, sf_dir)), pre=False, cells=512))


@query("das_long_spectrum_norm", c.SPECTRUM_NORM)
def das_long_spectrum_norm(spark, sf_dir):
    return amplitude(longfft.spectrum(e(spark, sf_dir), norm=True, cells=CELLS))


@query("das_long_spectrogram", c.spectrogram_sql())
def das_long_spectrogram(spark, sf_dir):
    return amplitude(longfft.spectrogram(e(spark, sf_dir), cells=CELLS))


HILBERT_V = c.hilbert_sql(c.V, 720)


@query("das_long_hilbert", f"WITH {HILBERT_V} SELECT ch::DOUBLE AS channel, i AS sample_idx, round(x, 5) + 0.0 AS re, round(h, 5) + 0.0 AS im FROM y")
def das_long_hilbert(spark, sf_dir):
    rows = longfft.hilbert(v(spark, sf_dir), V_CHUNK, CELLS).select("channel", "start", F.posexplode(F.arrays_zip("re", "im")).alias("i", "z"))
    value = lambda name: (F.round(F.col("z")[name], 5) + 0.0).alias(name)
    return rows.select("channel", (F.col("start") + F.col("i")).alias("sample_idx"), value("re"), value("im"))


@query("das_long_envelope", f"WITH {c.HILBERT} " + out("sqrt(x * x + h * h)", "y"))
def das_long_envelope(spark, sf_dir):
    return long_chunks(longfft.envelope(e(spark, sf_dir), E_CHUNK, CELLS))


@query("das_long_envelope_ref", f"WITH {c.HILBERT} " + out("sqrt(2 * x * x + h * h)", "y"))
def das_long_envelope_ref(spark, sf_dir):
    return long_chunks(longfft.envelope_ref(e(spark, sf_dir), E_CHUNK, CELLS))


@query("das_long_fk_spectrum", c.FK)
def das_long_fk_spectrum(spark, sf_dir):
    record = e(spark, sf_dir)
    rows = longfft.fk_spectrum(record, channels_of(spark, sf_dir)).drop("record_id")
    return rows.withColumn("magnitude", F.round("magnitude", 4) + 0.0)


@query("das_long_fk_filter", c.FK_FILTER + out(t="z"))
def das_long_fk_filter(spark, sf_dir):
    return long_chunks(longfft.fk_filter(e(spark, sf_dir), channels_of(spark, sf_dir), (5.0, 20.0), (0.0, 0.25)))


# --- moments, sums, extremes --------------------------------------------------------------------------------------
@query("das_long_detrend", f"WITH {c.V}, {c.detrend_sql('y', 'x')} " + out(t="y"))
def das_long_detrend(spark, sf_dir):
    return long_chunks(chunkmath.detrend(v(spark, sf_dir)))


@query("das_long_detrend_quadratic", c.QUADRATIC)
def das_long_detrend_quadratic(spark, sf_dir):
    return long_chunks(chunkmath.detrend(v(spark, sf_dir), 2))


@query("das_long_preprocess", f"WITH {c.PRE} " + out(t="p3"))
def das_long_preprocess(spark, sf_dir):
    return long_chunks(chunkmath.preprocess(e(spark, sf_dir)))


@query("das_long_integrate", c.INTEGRAL)
def das_long_integrate(spark, sf_dir):
    return long_chunks(chunkmath.integrate(v(spark, sf_dir)), 4)


@query("das_long_rmsa", c.RMSA)
def das_long_rmsa(spark, sf_dir):
    return chunkmath.rmsa(v(spark, sf_dir), 100.0).select("channel", "segment", "time_idx", r6("rms").alias("rms"))


@query("das_long_peak_to_peak", c.PP)
def das_long_peak_to_peak(spark, sf_dir):
    return chunkmath.peak_to_peak(e(spark, sf_dir)).select("channel", r6("pp").alias("pp"))


# --- windows ------------------------------------------------------------------------------------------------------
@query("das_long_psd_welch", c.WELCH)
def das_long_psd_welch(spark, sf_dir):
    rows = windows.psd(v(spark, sf_dir), 240, cells=CELLS)
    return rows.select("channel", "freq_idx", "freq", (F.round("power", 4) + 0.0).alias("power"))


@query("das_long_channel_spectrogram", c.stft_sql())
def das_long_channel_spectrogram(spark, sf_dir):
    return windows.channel_spectrogram(e(spark, sf_dir), 5, cells=CELLS).drop("record_id").withColumn("power", r6("power"))


@query("das_long_remez_bandpass", c.convolution_sql(c.E, filters.remez_bandpass_taps(8.0, 16.0, 64.0), "range(0, n + 49)", "o.o"))
def das_long_remez_bandpass(spark, sf_dir):
    return long_chunks(windows.remez_fir(e(spark, sf_dir), 8.0, 16.0, E_CHUNK))


@query("das_long_lowpass_fir", c.convolution_sql(c.E, filters.sinc_taps(10.0, 64.0, 64), "range(32, n + 31)", "o.o - 32"))
def das_long_lowpass_fir(spark, sf_dir):
    return long_chunks(windows.lowpass_fir(e(spark, sf_dir), 10.0, 64, E_CHUNK))


@query("das_long_fir_decimate", c.FIR_DECIMATE)
def das_long_fir_decimate(spark, sf_dir):
    return long_chunks(windows.fir_decimate(chunks.chunked(lineitem(spark, sf_dir), L_CHUNK), 4, size=L_CHUNK), 2)


# --- recursive filters ----------------------------------------------------------------------------------------------
@query("das_long_bandpass_zerophase", c.band_oracle("bandpass", (5.0, 15.0), True))
def das_long_bandpass_zerophase(spark, sf_dir):
    return long_chunks(chunks.band_filter(e(spark, sf_dir), "bandpass", (5.0, 15.0), zerophase=True))


@query("das_long_decimate_cheby1", c.CHEBY1)
def das_long_decimate_cheby1(spark, sf_dir):
    return long_chunks(chunkmath.decimate_cheby(v(spark, sf_dir), 4), 4)


# --- many recordings --------------------------------------------------------------------------------------------------
#: Fifty recordings of V: number, first hour, length; they overlap in every way, and leave gaps.
PARTS = [(r, 14 * r + (r * 37) % 23, 4 + (r * 11) % 29) for r in range(50)]
MANY = f"""WITH {c.V}, r(r, a, n) AS (VALUES {', '.join(map(str, PARTS))}), p AS (SELECT r, a, least(n, 720 - a) AS n FROM r WHERE a < 720),
spoken AS (SELECT ch, i, arg_min(x + 1000 * r, (a, r)) AS x FROM x JOIN p ON i >= a AND i < a + n GROUP BY ch, i),
g AS (SELECT ch, unnest(range((SELECT max(a + n) FROM p)))::BIGINT AS i FROM (SELECT DISTINCT ch FROM x))
SELECT ch::DOUBLE AS channel, g.i - (SELECT min(a) FROM p) AS sample_idx, round(coalesce(x, -1.5), 6) + 0.0 AS value FROM g LEFT JOIN spoken USING (ch, i) WHERE g.i >= (SELECT min(a) FROM p)"""


@query("das_concat_many", MANY)
def das_concat_many(spark, sf_dir):
    whole = v(spark, sf_dir)
    start = whole.meta.start_time
    parts = [(f"r{r:02d}", r, a, min(n, 720 - a), start + timedelta(seconds=a), 1.0) for r, a, n in PARTS if a < 720]
    table = spark.createDataFrame(parts, "record_id string, r int, a long, n long, start_time timestamp_ntz, fs double")
    reach = (F.col("start") < F.col("a") + F.col("n")) & (F.col("start") + F.size("samples") > F.col("a"))
    met = whole.chunks.drop("record_id").join(F.broadcast(table), reach)
    lo = F.greatest(F.col("a") - F.col("start"), F.lit(0))
    hi = F.least(F.col("a") + F.col("n") - F.col("start"), F.size("samples").cast("long"))
    own = F.transform(F.slice("samples", (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int")), lambda x: x + F.col("r") * 1000)
    rows = met.select("record_id", "channel_pos", "channel", (F.col("start") + lo - F.col("a")).alias("start"), own.alias("samples"))
    return long_chunks(sweep.concatenate_all(rows, table, replace(whole.meta), -1.5, gap_row=8))


# --- plots --------------------------------------------------------------------------------------------------------------
PYRAMID = f"""WITH {c.E}, l AS (SELECT *, (4 ** level)::BIGINT AS f FROM (SELECT unnest(range(3)) AS level))
SELECT level::INT AS level, ch // f AS channel_block, i // (4 * f) AS time_block, round(min(x), 6) + 0.0 AS low, round(max(x), 6) + 0.0 AS high FROM x, l GROUP BY ALL"""


@query("das_plot_pyramid", PYRAMID)
def das_plot_pyramid(spark, sf_dir):
    rows = pyramid.pyramid(e(spark, sf_dir), 3, 4)
    return rows.select("level", "channel_block", "time_block", r6("low").alias("low"), r6("high").alias("high"))


"""Wave spectra."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinelake.functions import arrays as A
from brinelake.operators import filters, joins, scans


def expand(df: DataFrame, values: str, out: str, labels: tuple[str, ...] = (),
           limit: int | None = None, ts: str = "received_at") -> DataFrame:
    """One row per value with its frequency; newest first when limited."""
    keep = [c for c in ("record_id", ts, *labels, "measurement_date", "measurement_time")
            if c in df.columns]
    rows = df.select(*keep, "start_frequency", "step_frequency", F.posexplode(values).alias("_i", out))
    rows = rows.select(*keep, out, (
        F.col("start_frequency").cast("double")
        + F.col("_i") * F.col("step_frequency").cast("double")).alias("frequency"))
    if limit is None:
        return rows
    return rows.orderBy(F.col(ts).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in labels],
                        F.col("frequency").asc_nulls_last(), F.col("record_id").asc_nulls_last()
                        ).limit(limit)


def energy_long(energy: DataFrame, limit: int | None = None) -> DataFrame:
    return expand(energy, "energy_densities", "energy", (), limit)


def coefficients_long(coefficients: DataFrame, limit: int | None = None) -> DataFrame:
    return expand(coefficients, "coefficients", "coefficient_value", ("coefficient_flag",), limit)


def directions_long(directions: DataFrame, limit: int | None = None) -> DataFrame:
    return expand(directions, "values", "direction_value", ("direction_type",), limit)


def coefficient_spectra(
    coefficients: DataFrame, flag: str = "A1", time_range: str | None = None,
    as_of: datetime | None = None, burst_labels: list[str] | None = None, limit: int | None = None,
    shown: int | None = None,
) -> DataFrame:
    """Spectra of one coefficient, newest first, cut to their bin count, with a frequency axis.

    ``burst_labels`` ("date time") picks bursts among all rows; without it ``shown`` keeps the
    newest few, as the layered display does.
    """
    rows = coefficients.where(F.col("coefficient_flag") == flag)
    if time_range:
        rows = filters.look_back(rows, time_range, as_of)
    if burst_labels is not None:
        rows = rows.where(F.concat_ws(" ", "measurement_date", "measurement_time").isin(burst_labels))
        shown = None
    few = [n for n in (limit, shown) if n is not None]
    rows = filters.first_rows(rows, "received_at", "record_id", min(few) if few else None)
    n = F.least(F.size("coefficients"), F.col("num_frequencies").cast("int"))
    s, d = F.col("start_frequency").cast("double"), F.col("step_frequency").cast("double")
    cut = F.slice("coefficients", F.lit(1), F.greatest(n, F.lit(0)))
    return rows.where(F.size("coefficients") > 0).select(
        "record_id", "received_at", "measurement_date", "measurement_time", "coefficient_flag",
        F.transform(cut, lambda _x, i: s + i * d).alias("frequencies"), cut.alias("coefficients"))


def energy_rows(energy: DataFrame, time_range: str | None = None, as_of: datetime | None = None,
                limit: int | None = None) -> DataFrame:
    """The newest spectra with a value at all."""
    rows = filters.look_back(energy, time_range, as_of) if time_range else energy
    rows = filters.first_rows(rows, "received_at", "record_id", limit)
    return rows.where(F.size("energy_densities") > 0)


def energy_heatmap(energy: DataFrame, time_range: str | None = None,
                   as_of: datetime | None = None, limit: int | None = None) -> DataFrame:
    """Rows padded with 0 to the longest; the newest ``limit`` rows, all where it is None."""
    rows = energy_rows(energy, time_range, as_of, limit)
    longest = rows.agg(F.max(F.size("energy_densities")).alias("n")).scalar()
    return rows.select("record_id", "received_at",
                       A.pad("energy_densities", longest).alias("energies"))


def heatmap_axis(energy: DataFrame, time_range: str | None = None, as_of: datetime | None = None,
                 limit: int | None = None) -> DataFrame:
    """Every frequency of the heatmap rows, once, upwards."""
    rows = energy_rows(energy, time_range, as_of, limit)
    return energy_long(rows).select("frequency").distinct().orderBy("frequency")


def _burst(df: DataFrame) -> list[str]:
    """What names a burst in a frame: its stream, where that is known, and its date and time."""
    return [c for c in ("stream_id",) if c in df.columns] + list(joins.BURST)


def directional_spectra(energy: DataFrame, directions: DataFrame, complete: bool = False) -> DataFrame:
    """Energy, mean direction, spread and axis of every burst.

    Missing direction arrays count as zeros; ``complete`` keeps only bursts that have both.
    Of repeated rows of a burst the one with the lowest id counts.
    """
    key = joins.burst_key(energy, directions)
    e = energy.groupBy(*key).agg(F.min_by(F.struct(
        "received_at", "start_frequency", "step_frequency", "num_frequencies",
        F.col("energy_densities").alias("energy"),
        *[c for c in joins.BURST if c not in key]), "record_id").alias("_e"))
    e = e.select(*key, "_e.*")
    d = joins.one_per_burst(directions, key, "direction_type", "values", ("MD", "DS"))
    out = e.join(d, key, "inner" if complete else "left")
    if complete:
        out = out.where(F.col("MD").isNotNull() & F.col("DS").isNotNull())
    n = F.col("num_frequencies")
    return out.select(
        F.col("received_at").alias("timestamp"), *_burst(out),
        A.frequency_axis("start_frequency", "step_frequency", n).alias("frequencies"), "energy",
        F.coalesce("MD", A.zeros(n)).alias("directions"),
        F.coalesce("DS", A.zeros(n)).alias("spreads"))


def directional_spectrum(energy: DataFrame, directions: DataFrame,
                         timestamp: datetime | None = None) -> DataFrame:
    """One burst, the latest complete one or that of a given time.

    A time is first compared with the time of receipt, then with date and time of the
    measurement.
    """
    if timestamp is None:
        spectra = directional_spectra(energy, directions, complete=True)
        newest = F.max_by(F.struct("*"), F.struct("timestamp", *reversed(_burst(spectra))))
        return spectra.agg(newest.alias("r")).select("r.*").where("timestamp IS NOT NULL")
    exact = F.col("received_at") == F.lit(timestamp.isoformat(sep=" ")).cast("timestamp_ntz")
    by_text = ((F.col("measurement_date") == timestamp.strftime("%m%d%y"))
               & (F.col("measurement_time") == timestamp.strftime("%H%M%S")))
    burst = _burst(energy)
    best = energy.where(exact | by_text).agg(F.min_by(
        F.struct(*burst), F.struct((~exact).cast("int"), F.col("record_id"))).alias("b"))
    chosen = energy.join(best.where("b IS NOT NULL").select("b.*"), burst, "left_semi")
    return directional_spectra(chosen, directions)


def peaks(spectra: DataFrame) -> DataFrame:
    """Frequency, energy and direction at the largest energy of each burst."""
    i = A.peak_position("energy")
    return spectra.select(
        "timestamp", *_burst(spectra),
        F.get("frequencies", i).alias("peak_frequency"),
        F.get(A.no_nulls("energy"), i).alias("peak_energy"),
        F.get("directions", i).alias("peak_direction"))


def bins(spectra: DataFrame) -> DataFrame:
    """Directional spectra as one row per burst and frequency."""
    rows = spectra.select("timestamp", *_burst(spectra), F.posexplode(F.arrays_zip(
        F.col("frequencies").alias("f"), F.col("energy").alias("e"),
        F.col("directions").alias("d"), F.col("spreads").alias("s"))).alias("bin", "_b"))
    return rows.select("timestamp", *_burst(spectra), "bin", F.col("_b.f").alias("frequency"),
                       F.col("_b.e").alias("energy"), F.col("_b.d").alias("direction"),
                       F.col("_b.s").alias("spread"))


def spreading_grid(spectra: DataFrame) -> DataFrame:
    """Energy over 72 directions for every burst and frequency.

    The weights of one frequency depend on that row only, so their sum is an array fold and
    not a shuffle.  The result has 72 rows per bin: filter or aggregate bursts first.
    """
    rows = bins(spectra).where("frequency IS NOT NULL").select(
        "timestamp", *_burst(spectra), "bin", "frequency",
        F.coalesce("energy", F.lit(0.0)).alias("_e"), F.coalesce("direction", F.lit(0.0)).alias("_m"),
        F.greatest(F.coalesce("spread", F.lit(A.DEFAULT_SPREAD)), F.lit(A.LEAST_SPREAD)).alias("_s"))
    thetas = F.sequence(F.lit(0), F.lit(360 - A.DIRECTION_STEP), F.lit(A.DIRECTION_STEP))
    weights = F.transform(thetas, lambda t: A.spread_weight(
        t.cast("double"), F.col("_m"), F.col("_s")))
    rows = rows.select("*", F.inline(F.array(F.struct(weights.alias("_w")))))
    total = F.aggregate("_w", F.lit(0.0), lambda acc, x: acc + x)
    rows = rows.select("*", F.inline(F.array(F.struct(total.alias("_sum")))))
    rows = rows.select("timestamp", *_burst(spectra), "bin", "frequency", "_e", "_sum",
                       F.posexplode("_w").alias("_i", "_x"))
    scaled = F.when(F.col("_sum") > 0,
                    F.col("_x") / F.col("_sum") * (F.col("_e") / float(A.DIRECTION_STEP)))
    return rows.select("timestamp", *_burst(spectra), "bin", "frequency",
                       (F.col("_i") * A.DIRECTION_STEP).alias("theta"),
                       F.coalesce(scaled, F.col("_x")).alias("intensity"))


def bubbles(spectra: DataFrame) -> DataFrame:
    """Polar bubbles, one per frequency."""
    return bins(spectra).withColumn("size", A.bubble_size("energy"))


def mean_steps(spectra: DataFrame) -> DataFrame:
    """Mean frequency step of each burst."""
    return spectra.select("timestamp", *_burst(spectra), A.mean_step("frequencies").alias("mean_step"))


def layered(coefficients: DataFrame, n: int = 5) -> DataFrame:
    """The newest n spectra of every coefficient."""
    return scans.first_per_group(coefficients, ["coefficient_flag"], n)


def json_column(name: str) -> Column:
    """Array column of an old table, where arrays are JSON text."""
    return A.decode_array(name).alias(name)

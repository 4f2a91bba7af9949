"""Spectra (D1-D3, D7-D12, D14)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from brinelake.functions import arrays as A
from brinelake.operators import spectra as D
from driver_queries.registry import query, rounded


@query("d01_energy_long", "energy", """SELECT record_id, received_at, round(unnest(energy_densities), 6) AS energy,
 round(start_frequency + (generate_subscripts(energy_densities, 1) - 1) * step_frequency, 6) AS frequency FROM energy""")
def _(f):
    return rounded(D.energy_long(f.energy).select("record_id", "received_at", "energy", "frequency"))


@query("d01_energy_newest", "energy", """SELECT * FROM (SELECT record_id, received_at, round(unnest(energy_densities), 6) AS energy,
 round(start_frequency + (generate_subscripts(energy_densities, 1) - 1) * step_frequency, 6) AS frequency FROM energy)
 ORDER BY received_at DESC, frequency LIMIT 100""")
def _(f):
    return rounded(D.energy_long(f.energy, 100).select("record_id", "received_at", "energy", "frequency"))


@query("d02_coefficients_long", "coefs", """SELECT record_id, coefficient_flag, round(unnest(coefficients), 6) AS coefficient_value,
 round(start_frequency + (generate_subscripts(coefficients, 1) - 1) * step_frequency, 6) AS frequency FROM coefs""")
def _(f):
    return rounded(D.coefficients_long(f.coefs).select(
        "record_id", "coefficient_flag", "coefficient_value", "frequency"))


@query("d03_directions_long", "dirs", """SELECT record_id, direction_type, round(unnest("values"), 6) AS direction_value,
 round(start_frequency + (generate_subscripts("values", 1) - 1) * step_frequency, 6) AS frequency FROM dirs""")
def _(f):
    return rounded(D.directions_long(f.dirs).select(
        "record_id", "direction_type", "direction_value", "frequency"))


@query("d07_coefficient_spectra", "coefs", """SELECT record_id, len(coefficients) AS n, round(list_sum(coefficients), 6) AS total,
 round(start_frequency + 63 * step_frequency, 6) AS last_frequency FROM coefs WHERE coefficient_flag = 'B2'""")
def _(f):
    out = D.coefficient_spectra(f.coefs, "B2")
    return rounded(out.select(
        "record_id", F.size("coefficients").cast("bigint").alias("n"),
        F.aggregate("coefficients", F.lit(0.0), lambda a, x: a + x).alias("total"),
        F.get("frequencies", F.lit(63)).alias("last_frequency")))


@query("d08_energy_heatmap", "energy", """SELECT record_id, received_at, len(energy_densities) AS n,
 round(list_sum(energy_densities), 6) AS total FROM energy""")
def _(f):
    out = D.energy_heatmap(f.energy)
    return rounded(out.select("record_id", "received_at", F.size("energies").cast("bigint").alias("n"),
                              F.aggregate("energies", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query("d08_heatmap_axis", "energy", """SELECT DISTINCT round(start_frequency
 + (generate_subscripts(energy_densities, 1) - 1) * step_frequency, 6) AS frequency FROM energy""")
def _(f):
    return rounded(D.heatmap_axis(f.energy)).distinct()


_SPECTRA = """spectra_d AS (SELECT e.received_at AS ts, e.measurement_date, e.measurement_time, e.start_frequency AS f0,
 e.step_frequency AS df, e.num_frequencies AS n, e.energy_densities AS energy,
 coalesce(md."values", list_transform(range(e.num_frequencies), lambda x: 0.0e0)) AS directions,
 coalesce(ds."values", list_transform(range(e.num_frequencies), lambda x: 0.0e0)) AS spreads
 FROM energy e LEFT JOIN dirs md ON md.received_at = e.received_at AND md.direction_type = 'MD'
 LEFT JOIN dirs ds ON ds.received_at = e.received_at AND ds.direction_type = 'DS')"""
_BINS = """bins AS (SELECT ts, i - 1 AS bin, round(f0 + (i - 1) * df, 4) AS frequency, energy[i] AS e, directions[i] AS d,
 spreads[i] AS s FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM spectra_d))"""


def _directional(name: str, sql: str, ctes: str = _SPECTRA):
    """Query whose SQL continues the frames with the directional tables."""
    def add(fn):
        from driver_queries.frames import duck
        from driver_queries.registry import ORACLES

        query(name)(fn)
        ORACLES[name] = duck("energy dirs", "@@" + sql).replace("\n@@", ", " + ctes + "\n")
        return fn
    return add


@_directional("d09_directional", """SELECT ts AS "timestamp", measurement_date, measurement_time, len(energy) AS n,
 round(list_sum(energy), 6) AS e_sum, round(list_sum(directions), 6) AS d_sum, round(list_sum(spreads), 6) AS s_sum,
 round(f0 + (n - 1) * df, 4) AS last_frequency FROM spectra_d""")
def _(f):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    out = D.directional_spectra(f.energy, f.dirs)
    return rounded(out.select(
        "timestamp", "measurement_date", "measurement_time", F.size("energy").cast("bigint").alias("n"),
        total("energy").alias("e_sum"), total("directions").alias("d_sum"), total("spreads").alias("s_sum"),
        F.get("frequencies", F.size("frequencies") - 1).alias("last_frequency")))


@_directional("d09_latest", """SELECT ts AS "timestamp", round(list_sum(energy), 6) AS e_sum FROM spectra_d
 WHERE ts IN (SELECT received_at FROM dirs WHERE direction_type = 'MD')
 AND ts IN (SELECT received_at FROM dirs WHERE direction_type = 'DS') ORDER BY ts DESC LIMIT 1""")
def _(f):
    out = D.directional_spectrum(f.energy, f.dirs)
    return rounded(out.select("timestamp", F.aggregate("energy", F.lit(0.0), lambda a, x: a + x).alias("e_sum")))


@_directional("d09_at_time", """SELECT ts AS "timestamp", round(list_sum(directions), 6) AS d_sum FROM spectra_d
 WHERE ts = TIMESTAMP '2026-01-16 02:20:00'""")
def _(f):
    out = D.directional_spectrum(f.energy, f.dirs, datetime(2026, 1, 16, 2, 20))
    return rounded(out.select("timestamp", F.aggregate("directions", F.lit(0.0), lambda a, x: a + x).alias("d_sum")))


@_directional("d10_peaks", """SELECT ts AS "timestamp", round(max(e), 6) AS peak_energy, arg_max(frequency, struct_pack(e, b := -bin)) AS peak_frequency,
 round(arg_max(d, struct_pack(e, b := -bin)), 6) AS peak_direction FROM bins GROUP BY 1""", f"{_SPECTRA}, {_BINS}")
def _(f):
    return rounded(D.peaks(D.directional_spectra(f.energy, f.dirs)).select(
        "timestamp", "peak_energy", "peak_frequency", "peak_direction"))


@_directional("d11_spreading", """SELECT ts AS "timestamp", bin, frequency, theta,
 round(w / sum(w) OVER (PARTITION BY ts, bin) * (e / 5.0), 6) AS intensity FROM (
 SELECT *, exp(-0.5 * pow(((((theta - d + 180) % 360) + 360) % 360 - 180) / greatest(s, 1.0), 2)) AS w
 FROM (SELECT *, CAST(unnest(range(0, 360, 5)) AS INT) AS theta FROM bins))""", f"{_SPECTRA}, {_BINS}")
def _(f):
    out = D.spreading_grid(D.directional_spectra(f.energy, f.dirs))
    return rounded(out.select("timestamp", F.col("bin").cast("bigint").alias("bin"), "frequency", "theta",
                              "intensity"))


@_directional("d12_bubbles", """SELECT ts AS "timestamp", bin, frequency, round(d, 6) AS direction,
 round(greatest(5.0, sqrt(e) * 40), 6) AS size FROM bins""", f"{_SPECTRA}, {_BINS}")
def _(f):
    out = D.bubbles(D.directional_spectra(f.energy, f.dirs))
    return rounded(out.select("timestamp", F.col("bin").cast("bigint").alias("bin"), "frequency", "direction", "size"))


@_directional("d14_mean_step", """SELECT ts AS "timestamp", round((max(frequency) - min(frequency)) / (count(*) - 1), 6) AS mean_step
 FROM bins GROUP BY 1""", f"{_SPECTRA}, {_BINS}")
def _(f):
    return rounded(D.mean_steps(D.directional_spectra(f.energy, f.dirs)).select("timestamp", "mean_step"))


@query("x09_unnest", "energy", """SELECT record_id, generate_subscripts(energy_densities, 1) - 1 AS pos,
 round(unnest(energy_densities), 6) AS value FROM energy""")
def _(f):
    return rounded(f.energy.select("record_id", F.posexplode("energy_densities").alias("pos", "value")).select(
        "record_id", F.col("pos").cast("bigint").alias("pos"), "value"))


@query("x11_padded_axis", "energy", """SELECT record_id, 80 AS n, round(list_sum(energy_densities), 6) AS total FROM energy""")
def _(f):
    padded = A.pad("energy_densities", F.lit(80))
    return rounded(f.energy.select("record_id", F.size(padded).alias("n"), F.aggregate(
        padded, F.lit(0.0), lambda a, x: a + x).alias("total")))

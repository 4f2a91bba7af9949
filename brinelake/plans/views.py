"""The joined views over the lake, each only where its inputs exist."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from brinelake.operators import joins

# view name -> input types, and the join
_VIEWS: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {
    "wave_measurement": (("PNORW", "PNORE"), joins.wave_measurement),
    "wave_measurement_full": (("PNORW", "PNORE", "PNORB", "PNORF", "PNORWD"),
                              joins.wave_measurement_full),
    "current_profile_df100": (("PNORS", "PNORC"), joins.current_profile_df100),
    "current_profile_12": (("PNORS12", "PNORC12"), joins.current_profile_12),
    "current_profile_34": (("PNORH", "PNORS34", "PNORC34"), joins.current_profile_34),
}


def lake_views(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Joined frames of the lake types at hand; they carry every left column."""
    out = {}
    for name, (inputs, join) in _VIEWS.items():
        if all(t in frames for t in inputs):
            sides = [frames[t] for t in inputs]
            out[name] = join(*sides) if name == "current_profile_34" else join(
                *sides, all_columns=True)
    return out


def register_views(frames: dict[str, DataFrame]) -> list[str]:
    """The joined frames as temporary views."""
    views = lake_views(frames)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return sorted(views)

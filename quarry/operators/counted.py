"""Counters of a run, taken in the pass that writes: nothing is read twice to be counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Counters:
    """Metrics watched at several places of one plan; read after it has been written."""

    def __init__(self) -> None:
        self._watched: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, place: str, **metrics: Column) -> DataFrame:
        """``df``, with its rows (as ``place``) and ``metrics`` (as place.name) counted as they pass."""
        o = Observation()
        self._watched.append((place, o))
        return df.observe(o, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in metrics.items()))

    def values(self) -> dict[str, object]:
        """The counters; waits for the action that passes the rows."""
        out = {}
        for place, o in self._watched:
            out |= {place if k == "rows" else f"{place}.{k}": v for k, v in o.get.items()}
        return out

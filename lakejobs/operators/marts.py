"""Gold marts and metric queries."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejobs.functions import casts


def yearly_damage(silver: DataFrame, yearmonth: str = "begin_yearmonth", state: str = "state", damage: str = "damage_property") -> DataFrame:
    """(event_year, state, total_property_damage)."""
    rows = silver.select(F.substring(F.col(yearmonth).cast("string"), 1, 4).alias("event_year"), F.col(state).alias("state"), casts.damage_amount(F.col(damage)).alias("amount"))
    return rows.groupBy("event_year", "state").agg(F.sum("amount").alias("total_property_damage"))


_OPERATORS = {
    "equals": lambda c, v: c.isin(v), "notEquals": lambda c, v: ~c.isin(v), "gt": lambda c, v: c > v[0], "gte": lambda c, v: c >= v[0],
    "lt": lambda c, v: c < v[0], "lte": lambda c, v: c <= v[0], "set": lambda c, v: c.isNotNull(), "notSet": lambda c, v: c.isNull(),
}


@dataclass(frozen=True)
class MetricCube:
    """Dimensions, and measures as name -> (column, "sum" or "avg"), over one mart."""

    dimensions: tuple[str, ...]
    measures: dict[str, tuple[str, str]]

    def query(self, mart: DataFrame, measures: list[str], dimensions: list[str] = (), filters: list[dict[str, Any]] = (), limit: int | None = 5) -> DataFrame:
        """Measures grouped by dimensions, in the dimensions' order; the limit (1 to 50, None for all) is the report's."""
        if not measures:
            raise ValueError("a query needs measures")
        if unknown := [x for x in measures if x not in self.measures] + [x for x in dimensions if x not in self.dimensions]:
            raise ValueError(f"unknown names: {unknown}")
        for f in filters:
            if f["member"] not in self.dimensions or f["operator"] not in _OPERATORS:
                raise ValueError(f"unknown filter {f}")
            mart = mart.where(_OPERATORS[f["operator"]](F.col(f["member"]), f.get("values") or []))
        kinds = {"sum": F.sum, "avg": F.avg}
        out = mart.groupBy(*dimensions).agg(*[kinds[self.measures[m][1]](self.measures[m][0]).alias(m) for m in measures])
        return out if limit is None else out.orderBy(*dimensions).limit(max(1, min(50, limit)))


RUN_DAILY = MetricCube(("attempt_date", "pipeline", "command"), {"attempts": ("attempts", "sum"), "ok": ("ok", "sum"), "error": ("error", "sum"), "rows": ("rows", "sum"), "p50_ms": ("p50_ms", "avg"), "p95_ms": ("p95_ms", "avg")})
YEARLY_DAMAGE = MetricCube(("event_year", "state"), {"total_property_damage": ("total_property_damage", "sum")})

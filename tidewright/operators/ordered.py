"""Running values and places in a whole order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.sources.shared import written

FUNCTIONS = {"sum": F.sum, "max": F.max, "min": F.min}


def running(rows: DataFrame, order: list[Column | str], values: dict[str, tuple[str, Column]], keys: list[str] = ()) -> DataFrame:
    """Adds, for each (name: (function, column)) of ``values``, the sum, max or min over the rows before (null where there are none).

    Rows are dealt by ranges of ``keys`` and ``order`` and written once; each range runs by itself from what the ranges before
    add up to, which is one row a key and range. ``order`` is total inside the keys: rows equal in it would share a range and stand
    in any order there. Rows of one value should be aggregated before.
    """
    ends = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    held = rows.withColumns({f"__running_v_{name}": column for name, (_, column) in values.items()})
    dealt = written(held.repartitionByRange(*ends).withColumn("__running_cell", F.spark_partition_id()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    cells = dealt.groupBy(*keys, "__running_cell").agg(*[FUNCTIONS[f](f"__running_v_{name}").alias(f"__running_t_{name}") for name, (f, _) in values.items()])
    over = before(Window.partitionBy(*keys).orderBy("__running_cell"))
    cells = cells.select(*[F.col(k).alias(f"__running_k_{k}") for k in keys], F.col("__running_cell").alias("__running_at"), *[FUNCTIONS[f](f"__running_t_{name}").over(over).alias(f"__running_b_{name}") for name, (f, _) in values.items()])
    inside = before(Window.partitionBy(*keys, "__running_cell").orderBy(*order))
    dealt = dealt.withColumns({f"__running_i_{name}": FUNCTIONS[f](f"__running_v_{name}").over(inside) for name, (f, _) in values.items()})
    met = F.col("__running_cell") == F.col("__running_at")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"__running_k_{k}"))

    def both(name: str, function: str) -> Column:
        a, b = F.col(f"__running_b_{name}"), F.col(f"__running_i_{name}")
        return {"sum": F.coalesce(a + b, a, b), "max": F.greatest(a, b), "min": F.least(a, b)}[function].alias(name)

    return dealt.join(cells, met, "left").select(*[F.col(c) for c in rows.columns], *[both(name, f) for name, (f, _) in values.items()])


def places(rows: DataFrame, order: list[Column | str], keys: list[str] = (), name: str = "place") -> DataFrame:
    """Adds the place, from 0, of each row of each key in a total order."""
    out = running(rows, order, {name: ("sum", F.lit(1).cast("long"))}, keys)
    return out.withColumn(name, F.coalesce(name, F.lit(0).cast("long")))

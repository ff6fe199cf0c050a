"""Ordered computations (ranks, running values) that split a hot group over many tasks.

Rows of a group are cut into order buckets at approximate quantiles of the ordering column. Each
bucket is summarised by a map-side aggregate, the summaries are scanned in order (a few rows per
group), and every row combines its bucket's prefix with a window inside the bucket. The widest window
partition is one bucket of one group, never a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emulake.operators.rank import rank_in_cells
from emulake.session import bounded

BUCKETS = 64
CELL_ROWS = 500_000  # rows one window partition should hold
MAX_PARTS = 16_384
SPLITTERS = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}


def _tree(c: Column, bounds: list, leaves: list[Column], lo: int, hi: int) -> Column:
    """Balanced comparisons choosing leaf k, where k bounds lie below the value."""
    if lo == hi:
        return leaves[lo]
    mid = (lo + hi) // 2
    return F.when(c <= F.lit(bounds[mid]), _tree(c, bounds, leaves, lo, mid)).otherwise(_tree(c, bounds, leaves, mid + 1, hi))


def _cells(c: Column, bounds: list, low, high, parts: int) -> Column:
    """Quantile bucket, each cut into ``parts`` equal-width cells; never decreases with the value."""
    edges = [low, *bounds, high]
    leaves = []
    for k in range(len(bounds) + 1):
        cell = F.lit(k * parts).cast("bigint")
        if parts > 1 and edges[k + 1] > edges[k]:
            at = F.floor((c - F.lit(edges[k])) * F.lit(parts / (edges[k + 1] - edges[k])))
            cell = cell + F.greatest(F.least(at, F.lit(parts - 1)), F.lit(0))
        leaves.append(cell)
    return _tree(c, bounds, leaves, 0, len(bounds))


def order_bucket(df: DataFrame, order: Column, ties: Column | None = None, buckets: int = BUCKETS, cell_rows: int = CELL_ROWS) -> Column:
    """An expression numbering rows by consecutive cells of ``order`` (a number).

    Cells are quantile buckets, cut finer by width as the table grows so that one holds about ``cell_rows``
    rows. A value so frequent that it fills whole buckets is split at quantiles of ``ties`` (a number too).
    """
    probs = [i / buckets for i in range(1, buckets)]
    got = df.agg(F.percentile_approx(order, probs, 1000).alias("q"), F.min(order).alias("lo"), F.max(order).alias("hi"), F.count(order).alias("n")).first()
    quantiles = got.q or []
    bounds = sorted(set(quantiles))
    parts = max(1, min(MAX_PARTS, got.n // (buckets * cell_rows)))
    coarse = _cells(order, bounds, got.lo, got.hi, parts)
    heavy = [v for v in bounds if quantiles.count(v) > 1]
    if not heavy or ties is None:
        return coarse
    asked = df.agg(*[F.struct(F.percentile_approx(F.when(order == F.lit(v), ties), probs, 1000).alias("q"), F.min(F.when(order == F.lit(v), ties)).alias("lo"),
                                F.max(F.when(order == F.lit(v), ties)).alias("hi")).alias(f"t{i}") for i, v in enumerate(heavy)]).first()
    finer = F.lit(0).cast("bigint")
    for i, v in enumerate(heavy):
        t = asked[f"t{i}"]
        inner = sorted(set(t.q or []))
        finer = F.when(order == F.lit(v), _cells(ties, inner, t.lo, t.hi, parts) + 1).otherwise(finer)
    return coarse * (buckets * parts + 2) + finer


def ordered_rank(
    df: DataFrame, order: str, group: Sequence[str] = (), ties: Sequence[str] = (), rank: str = "rank",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Exact 1-based position by ``order`` (numeric, not NULL) then ``ties``, per group."""
    numeric = bool(ties) and isinstance(df.schema[ties[0]].dataType, T.NumericType)
    first_tie = F.col(ties[0]) if numeric else None  # only a leading numeric tie can split a frequent value
    cell = order_bucket(df, F.col(order), first_tie, buckets)
    return rank_in_cells(df, cell, group, [order, *ties], rank)


def running(
    df: DataFrame, order: str, group: Sequence[str], values: dict[str, tuple[str, str, bool]], ties: Sequence[str] = (),
    buckets: int = BUCKETS, cell: Column | None = None,
) -> DataFrame:
    """Add running aggregates: ``name -> (how, column, include_current_row)``, how in max/min/sum/count.

    Callers that chain several passes compute ``cell`` (see ``order_bucket``) once on the source table.
    """
    group = list(group)
    if cell is None:
        cell = order_bucket(df, F.col(order), buckets=buckets)
    tagged = df.withColumn("__g", F.struct(*group, cell.alias("__cell")))
    sums = [SPLITTERS[how](c).alias(f"__s_{name}") for name, (how, c, _) in values.items()]
    cells = tagged.groupBy("__g").agg(*sums)
    fields = [F.col("__g")[c] for c in group]
    before = Window.partitionBy(*fields).orderBy(F.col("__g")["__cell"]).rowsBetween(Window.unboundedPreceding, -1)
    prefix = cells.select(
        "__g",
        *[(F.sum if how == "count" else SPLITTERS[how])(f"__s_{name}").over(before).alias(f"__p_{name}")
          for name, (how, _, _) in values.items()],
    )
    placed = tagged.join(bounded(prefix), "__g")
    inside = Window.partitionBy("__g").orderBy(order, *ties)
    out = placed
    for name, (how, c, inclusive) in values.items():
        frame = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        here, earlier = SPLITTERS[how](c).over(frame), F.col(f"__p_{name}")
        if how == "max":
            total = F.greatest(here, earlier)
        elif how == "min":
            total = F.least(here, earlier)
        elif how == "count":
            total = F.coalesce(here, F.lit(0)) + F.coalesce(earlier, F.lit(0))
        else:
            total = F.coalesce(here + earlier, here, earlier)
        out = out.withColumn(name, total)
    return out.drop("__g", *[f"__p_{name}" for name in values])

"""Ordered scans that survive a hot key.

A window partitioned by job puts every event of one job into one task. These helpers
cut each key into chunks of its order column instead: chunks are scanned in parallel,
chunk totals (one row per chunk) carry the state from one chunk into the next. The
chunk of a row is a function of the row alone, so a re-run task gives the same answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Large enough that ordinary keys fit one chunk, small enough for one window task.
CHUNK_ROWS = 1 << 20
CHUNK = "__chunk"
HEAD = "__head"


def chunk_of(order: Column, size: int = CHUNK_ROWS) -> Column:
    """First order value of the chunk an integer order value falls into."""
    return order - F.pmod(order, F.lit(size))


def _with_heads(rows: DataFrame, heads: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` and, in front of each chunk, a head row with what the chunks before left.

    Heads take part in the same window as the rows, so keys and order values may be null:
    nothing is joined, and a window keeps null keys together.
    """
    kinds = {f.name: f.dataType for f in heads.schema.fields}
    filled = [
        F.col(f.name) if f.name in kinds else F.lit(None).cast(f.dataType).alias(f.name)
        for f in rows.schema.fields
    ]
    lead = heads.select(*filled, F.lit(0).alias(HEAD))
    own = rows.select(
        *[F.col(f.name).cast(kinds[f.name]).alias(f.name) if f.name in names else F.col(f.name) for f in rows.schema.fields],
        F.lit(1).alias(HEAD),
    )
    return own.unionByName(lead)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    scans: dict[str, tuple[str, Column, bool]],
    chunk: Column | None = None,
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """Add running aggregates per key; no row is lost, null keys form a key of their own.

    ``scans`` maps a new column to (sum|max|min|count, expression, include current row).
    ``order`` must be a total order within a key; ``chunk`` must not decrease along it
    and defaults to ranges of ``size`` values of the first order column. Null order values
    come first, as in a window.
    """
    chunk = chunk if chunk is not None else chunk_of(F.col(order[0]), size)
    inputs = {name: f"__in_{i}" for i, name in enumerate(scans)}
    rows = df.select(
        "*", chunk.alias(CHUNK),
        *[(F.when(expr.isNotNull(), F.lit(1)).cast("bigint") if kind == "count" else expr).alias(inputs[n])
          for n, (kind, expr, _) in scans.items()],
    )
    merge = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    totals = rows.groupBy(*keys, CHUNK).agg(
        *[merge[kind](inputs[n]).alias(f"__total_{i}") for i, (n, (kind, _, _)) in enumerate(scans.items())]
    )
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select(
        *keys, CHUNK,
        *[merge[kind](f"__total_{i}").over(earlier).alias(inputs[n])
          for i, (n, (kind, _, _)) in enumerate(scans.items())],
    )
    both = _with_heads(rows, heads, list(inputs.values()))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(HEAD, *order)
    result = []
    for name, (kind, _, inclusive) in scans.items():
        frame = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        value = merge[kind](inputs[name]).over(frame)
        result.append((F.coalesce(value, F.lit(0)) if kind == "count" else value).alias(name))
    return both.select(*df.columns, HEAD, *result).where(F.col(HEAD) == 1).drop(HEAD)


def previous(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: dict[str, str],
    chunk: Column | None = None,
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """Add the preceding row's value of each column (new name -> column); see ``running``."""
    chunk = chunk if chunk is not None else chunk_of(F.col(order[0]), size)
    sources = list(dict.fromkeys(columns.values()))
    inputs = {source: f"__in_{i}" for i, source in enumerate(sources)}
    rows = df.select("*", chunk.alias(CHUNK), *[F.col(s).alias(i) for s, i in inputs.items()])
    last = rows.groupBy(*keys, CHUNK).agg(
        F.max_by(F.struct(*inputs.values()), F.struct(*order)).alias("__last")
    )
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    heads = last.select(*keys, CHUNK, F.lag("__last").over(across).alias("__before")).select(
        *keys, CHUNK, *[F.col("__before").getField(i).alias(i) for i in inputs.values()]
    )
    both = _with_heads(rows, heads, list(inputs.values()))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(HEAD, *order)
    return both.select(
        *df.columns, HEAD, *[F.lag(inputs[source]).over(inside).alias(name) for name, source in columns.items()]
    ).where(F.col(HEAD) == 1).drop(HEAD)


def numbered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    name: str = "row_number",
    chunk: Column | None = None,
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """Row number per key as a chunked running count."""
    return running(df, keys, order, {name: ("count", F.lit(1), True)}, chunk, size)

"""Ordered scans over a document that may hold a large share of all rows.

A plain window partitioned by document puts the whole document in one task.
Here the rows of a document are cut into chunks by an order-preserving bucket;
each chunk is scanned on its own, one summary row per chunk is scanned for the
document, and the two are joined. The last scan sees rows / chunk-size rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def read_once(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` partitioned by ``keys``, for a plan that reads it more than once: what lies below runs once.

    Readers share an exchange only if they ask it for the same columns. A filter that always holds, but needs every column
    and is not deterministic, keeps the optimiser from pruning columns for one reader and not for the other.
    """
    parts = df.repartition(*keys)
    # a hash lies between -2 ** 31 and 2 ** 31
    return parts.where(F.rand(0) > F.hash(*parts.columns) / 2**31 - 2)


def chunked_scan(
    df: DataFrame,
    group: list[str],
    order: list[str],
    chunk: Column,
    carried: Mapping[str, str] | None = None,
    totals: Mapping[str, str] | None = None,
    position: str | None = None,
) -> DataFrame:
    """``df`` with values of its whole group on each row, from one exchange of the rows.

    ``carried``: new column -> column whose last non-null value strictly before the row it holds. ``totals``: new column ->
    column whose maximum over the group it holds. ``position``: the row's number in its group, from 0. ``chunk`` must grow
    with ``order``.

    The replay within chunks and the summary row of each chunk read the same exchange, by group and chunk; only the
    summaries are shuffled by group.
    """
    carried, totals = carried or {}, totals or {}
    keys = [*group, "_chunk"]
    parts = read_once(df.withColumn("_chunk", chunk), *keys)
    inside = Window.partitionBy(*keys).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    local, ends, sums, out = {}, [F.count("*").alias("_n")], {}, {}
    for i, (name, value) in enumerate(carried.items()):
        local[f"_l{i}"] = F.last(value, True).over(before)
        ends.append(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order))).alias(f"_e{i}"))
        sums[f"_c{i}"] = F.last(f"_e{i}", True).over(earlier)
        out[name] = F.coalesce(f"_l{i}", f"_c{i}")
    for i, (name, value) in enumerate(totals.items()):
        ends.append(F.max(value).alias(f"_m{i}"))
        sums[f"_t{i}"] = F.max(f"_m{i}").over(whole)
        out[name] = F.col(f"_t{i}")
    if position:
        local["_row"] = F.row_number().over(inside)
        sums["_before"] = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
        out[position] = (F.col("_before") + F.col("_row") - 1).cast("int")
    summaries = parts.groupBy(*keys).agg(*ends).withColumns(sums).select(*keys, *sums)
    kept = [c for c in df.columns if c not in out]
    joined = parts.withColumns(local).join(summaries, keys)
    return joined.select(*kept, *[value.alias(name) for name, value in out.items()])


def carry_last(
    df: DataFrame, group: list[str], order: list[str], chunk: Column, value: str, out: str
) -> DataFrame:
    """Last non-null ``value`` strictly before each row of its group, as ``out``."""
    return chunked_scan(df, group, order, chunk, carried={out: value})


def dense_position(
    df: DataFrame, group: list[str], order: list[str], chunk: Column, out: str
) -> DataFrame:
    """0-based position of each row in its group."""
    return chunked_scan(df, group, order, chunk, position=out)


def salted_join(
    rows: DataFrame, extra: DataFrame, keys: list[str], salt: Column, salts: int = 16, how: str = "inner"
) -> DataFrame:
    """Equi-join whose left side may hold very many rows of one key.

    The rows of a key are spread over ``salts`` tasks by ``salt``; the other
    side, a few rows per key, is repeated once per salt.
    """
    left = rows.withColumn("_salt", F.pmod(F.hash(salt), F.lit(salts)))
    right = extra.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def explode_span(df: DataFrame, first: Column, last: Column, out: str, step: int = 1024) -> DataFrame:
    """One row per integer in ``[first, last]``, without an array as long as the span."""
    blocks = df.withColumn("_first", first.cast("bigint")).withColumn("_last", last.cast("bigint"))
    blocks = blocks.where("_first <= _last").withColumn(
        "_from", F.explode(F.sequence("_first", "_last", F.lit(step).cast("bigint")))
    )
    upper = F.least(F.col("_from") + step - 1, F.col("_last"))
    spans = blocks.withColumn(out, F.explode(F.sequence(F.col("_from"), upper)))
    return spans.withColumn(out, F.col(out).cast("int")).drop("_first", "_last", "_from")

"""Running functions over keys of any size.

A window partitioned by a key puts the key's rows into one task.  Here the rows
are range-partitioned by (key, order), which splits large keys; windows run
within the parts of a key, and what came before a part is added from the parts'
totals, of which there are as many as partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.session import settle


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, seq: str | None = None) -> DataFrame:
    """df with running sums and maxima in order within keys, each row's own value included, and its place from 1.

    Null values add nothing; null keys are a key of their own."""
    sums, maxima = dict(sums or {}), dict(maxima or {})
    columns = df.columns
    place = "_place" if seq is None else seq
    values = {f"_v_{n}": c for n, c in (sums | maxima).items()}
    parts = settle(df.withColumns(values).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())) if values or seq else df
    w = Window.partitionBy(*keys, "_part").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    inner = {n: F.coalesce(F.sum(f"_v_{n}").over(upto), F.lit(0)) for n in sums} | {n: F.max(f"_v_{n}").over(upto) for n in maxima} | {place: F.row_number().over(w)}
    totals = parts.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_t_rows"), *(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums), *(F.max(f"_v_{n}").alias(f"_t_{n}") for n in maxima)
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p"), F.coalesce(F.sum("_t_rows").over(before), F.lit(0)).alias("_o_rows"),
        *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums), *(F.max(f"_t_{n}").over(before).alias(f"_o_{n}") for n in maxima),
    )
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = parts.withColumns(inner).join(offsets, same)
    return out.select(
        *columns,
        *((F.col(n) + F.col(f"_o_{n}")).alias(n) for n in sums),
        *(F.greatest(n, f"_o_{n}").alias(n) for n in maxima),
        *([(F.col(seq) + F.col("_o_rows")).alias(seq)] if seq else []),
    )


def moving_mean(df: DataFrame, keys: list[str], order: list[Column], value: str, window: int, name: str) -> DataFrame:
    """df with the mean of the last ``window`` values within keys, this row's included, from differences of running sums.

    Null values don't count; a window without values has null."""
    rows = settle(running(df, keys, order, {"_s": F.col(value).cast("double"), "_n": F.col(value).isNotNull().cast("long")}, seq="_i"))
    old = rows.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), (F.col("_i") + window).alias("_j"), F.col("_s").alias("_s0"), F.col("_n").alias("_n0"))
    same = F.col("_i") == F.col("_j")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = rows.join(old, same, "left")
    n = F.col("_n") - F.coalesce("_n0", F.lit(0))
    mean = F.when(n > 0, (F.col("_s") - F.coalesce("_s0", F.lit(0.0))) / n)
    return out.select(*df.columns, mean.alias(name), F.col("_i"))

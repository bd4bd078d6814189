"""Exact order statistics that survive a hot group.

Spark's ``percentile`` holds every distinct value of a group in one buffer. That
is right for a series, which its calendar bounds, and wrong for raw rows, where
one group may hold a third of the table. Here a mergeable sketch first brackets
the wanted ranks, rows are counted below the bracket by ordinary partial
aggregation, and only the few rows inside the bracket are sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
#: Groups up to this size are sorted whole; the sketch need not be trusted.
WHOLE = 5_000


def _bracketed(
    frame: DataFrame,
    keys: Sequence[str],
    value: str,
    share: float,
    ranks: Callable[[Column], Sequence[Column]],
    accuracy: int,
    whole: int,
) -> DataFrame:
    """Values of the wanted 1-based ranks: columns keys, n, r0.., v0.. ."""
    margin = 4.0 / accuracy
    low, high = max(0.0, share - margin), min(1.0, share + margin)
    keys = list(keys)
    known = frame.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())

    # Equal values travel once, and a hot group spreads over its values.
    counted = known.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    sketch = known.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.percentile_approx("_v", [low, high], accuracy).alias("_b"),
    )
    sketch = sketch.select(
        *[F.col(key).alias(f"_k_{key}") for key in keys],
        "_n",
        F.when(F.col("_n") > whole, F.col("_b")[0]).alias("_low"),
        F.when(F.col("_n") > whole, F.col("_b")[1]).alias("_high"),
    )
    if keys:
        matched = None
        for key in keys:
            same = F.col(key).eqNullSafe(F.col(f"_k_{key}"))
            matched = same if matched is None else matched & same
        joined = counted.join(sketch, matched, "inner").drop(*[f"_k_{key}" for key in keys])
    else:
        bounds = sketch.select(F.struct("_n", "_low", "_high").alias("_s")).scalar()
        joined = counted.withColumn("_s", bounds).select("*", "_s.*").drop("_s")

    below = F.coalesce(F.col("_v") < F.col("_low"), F.lit(False))
    above = F.coalesce(F.col("_v") > F.col("_high"), F.lit(False))
    # Rows outside the bracket collapse to one counted row per group, map side.
    squeezed = (
        joined.withColumn("_slot", F.when(below, 0).when(above, 2).otherwise(1))
        .filter(F.col("_slot") < 2)
        .withColumn("_v", F.when(F.col("_slot") == 1, F.col("_v")))
        .groupBy(*keys, "_slot", "_v")
        .agg(F.sum("_c").alias("_c"), F.first("_n").alias("_n"))
    )
    order = Window.partitionBy(*keys).orderBy("_slot", "_v")
    upto = squeezed.withColumn(
        "_upto", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    wanted = ranks(F.col("_n"))
    # A rank outside its bracket would be a wrong answer, never a missing one.
    missed = F.raise_error(F.lit("A wanted rank lies outside its bracket; raise the accuracy."))
    picks = [
        F.coalesce(F.min(F.when((F.col("_slot") == 1) & (F.col("_upto") >= rank), F.col("_v"))), missed.cast(known.schema["_v"].dataType)).alias(f"v{i}")
        for i, rank in enumerate(wanted)
    ]
    return upto.groupBy(*keys).agg(F.first("_n").alias("n"), *picks)


def exact_quantile(
    frame: DataFrame,
    keys: Sequence[str],
    value: str,
    share: float,
    *,
    name: str = "quantile",
    accuracy: int = ACCURACY,
    whole: int = WHOLE,
) -> DataFrame:
    """Linearly interpolated quantile of a column per key."""

    def position(n: Column) -> Column:
        return F.lit(share) * (n - 1)

    picked = _bracketed(
        frame,
        keys,
        value,
        share,
        lambda n: [F.floor(position(n)) + 1, F.ceil(position(n)) + 1],
        accuracy,
        whole,
    )
    part = position(F.col("n")) - F.floor(position(F.col("n")))
    return picked.select(*keys, "n", (F.col("v0") + (F.col("v1") - F.col("v0")) * part).alias(name))


def value_at_rank(
    frame: DataFrame,
    keys: Sequence[str],
    value: str,
    share: float,
    rank: Callable[[Column], Column],
    *,
    name: str = "value",
    accuracy: int = ACCURACY,
    whole: int = WHOLE,
) -> DataFrame:
    """The value at a 1-based rank computed from the group size.

    ``share`` says roughly where in the order that rank lies.
    """
    picked = _bracketed(frame, keys, value, share, lambda n: [rank(n)], accuracy, whole)
    return picked.select(*keys, "n", F.col("v0").alias(name))


def nearest_rank(frame: DataFrame, keys: Sequence[str], value: str, share: float, **options) -> DataFrame:
    """The value at rank ceil(share * n)."""
    return value_at_rank(
        frame, keys, value, share, lambda n: F.greatest(F.ceil(n * share), F.lit(1)), **options
    )

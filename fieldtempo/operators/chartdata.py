"""The tables behind the charts. Inputs have one row per key and day."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtempo.operators.pace import CAMPAIGN, CAMPAIGN_DATASET

# Bins of a campaign's own histogram, of the shared one, and points of a curve.
CAMPAIGN_BINS = 15
SHARED_BINS = 20
CURVE_POINTS = 512

# Stretches that a curve is cut into, tasks that all stretches of all curves are dealt to at least, and
# kernels (a day at a point) that a task sums, about a second's work.
CURVE_SLICES = 8
CURVE_TASKS = 32
TASK_KERNELS = 20_000_000
# Days of a key that a curve can be made of: a calendar of two centuries.
MOST_DAYS = 73_200

# A value this fraction of a bin above an edge is on the edge: it absorbs rounding in the division.
EDGE_TOLERANCE = 1e-8


def _ordered(table: DataFrame, *columns: str) -> DataFrame:
    return table.orderBy(*[F.asc_nulls_last(column) for column in columns])


def _axis(
    daily: DataFrame, value: str, keys: Sequence[str], shared_range: bool
) -> tuple[Column, Column]:
    """Ends of the axis: of the key, or of the whole table if shared.

    The shared ends are one row of two numbers. A scalar subquery finds them from the same shuffles
    as the table itself, so there is no window without a key.
    """
    ends = [F.min(value), F.max(value)]
    if shared_range:
        low, high = [daily.select(end).scalar() for end in ends]
    else:
        low, high = [end.over(Window.partitionBy(*keys)) for end in ends]
    return low, high


def timeseries(trimmed: DataFrame, keys: Sequence[str] = CAMPAIGN_DATASET) -> DataFrame:
    """Pace day by day."""
    return _ordered(trimmed.select(*keys, "date", "daily_avg"), *keys, "date")


def histogram(
    trimmed: DataFrame,
    value: str = "daily_avg",
    keys: Sequence[str] = CAMPAIGN_DATASET,
    bins: int = CAMPAIGN_BINS,
    shared_range: bool = False,
) -> DataFrame:
    """Count and density per bin, empty bins included.

    The outer bins are centred on the ends of the axis and bins are closed on the right. Where all
    values on the axis are equal there is one bin, and no density.
    """
    low, high = _axis(trimmed, value, keys, shared_range)
    placed = (
        trimmed.select(*keys, value, low.alias("low"), high.alias("high"))
        .withColumn("width", F.nullif((F.col("high") - F.col("low")) / (bins - 1), F.lit(0.0)))
        .withColumn("position", (F.col(value) - F.col("low")) / F.col("width") + 0.5)
        .withColumn("bin", F.ceil(F.col("position") - EDGE_TOLERANCE) - 1)
        .withColumn("bin", F.least(F.greatest("bin", F.lit(0)), F.lit(bins - 1)))
        .withColumn("bin", F.when(F.col("width").isNull(), 0).otherwise(F.col("bin")))
    )
    counted = placed.groupBy(*keys, "low", "width").agg(
        F.count(value).alias("n"),
        F.array(*[F.count_if(F.col("bin") == number) for number in range(bins)]).alias("counts"),
    )
    left = F.col("low") + (F.col("bin") - 0.5) * F.coalesce("width", F.lit(0.0))
    return (
        counted.select(*keys, "low", "width", "n", F.posexplode("counts").alias("bin", "count"))
        .where(F.col("width").isNotNull() | (F.col("bin") == 0))
        .select(
            *keys,
            "bin",
            left.alias("bin_start"),
            (left + F.coalesce("width", F.lit(0.0))).alias("bin_end"),
            "count",
            (F.col("count") / (F.col("n") * F.col("width"))).alias("density"),
        )
    )


def curve_tasks(days: int, points: int = CURVE_POINTS) -> int:
    """Tasks for the curves of so many days in all: the work is a kernel for each day and point."""
    return max(CURVE_TASKS, -(-days * points // TASK_KERNELS))


def density(
    trimmed: DataFrame,
    value: str = "daily_avg",
    keys: Sequence[str] = CAMPAIGN_DATASET,
    points: int = CURVE_POINTS,
    shared_range: bool = False,
    order: str = "date",
    tasks: int | None = None,
) -> DataFrame:
    """Gaussian kernel density on a regular grid over the axis; keys of one day have no curve.

    The bandwidth is ``0.9 * min(sd, IQR / 1.34) * n^-0.2``; if that minimum is 0, the deviation,
    then the size of the earliest value, then 1 takes its place. The values of a key travel as one
    array, so no pair of grid point and day becomes a row; ``daily`` must have one row per key and
    day, and a key with more rows than days fails. The kernel sums are the work: each curve is cut
    into slices, and these are dealt to ``tasks``, whose number does not follow the few bytes they
    hold: that of ``curve_tasks``, or if it is left out as many as the cluster runs at a time.
    """
    low, high = _axis(trimmed, value, keys, shared_range)
    if tasks is None:
        tasks = max(CURVE_TASKS, trimmed.sparkSession.sparkContext.defaultParallelism)
    size = F.col("n").cast("double")
    spread = F.least("sd", (F.col("quartiles")[1] - F.col("quartiles")[0]) / 1.34)

    def unless_zero(column: Column) -> Column:
        return F.nullif(column, F.lit(0.0))

    scale = F.coalesce(
        unless_zero(spread),
        unless_zero(F.col("sd")),
        unless_zero(F.abs(F.col("earliest"))),
        F.lit(1.0),
    )
    few_enough = F.assert_true(
        F.col("n") <= MOST_DAYS, "a curve needs one row per key and day"
    ).isNull()
    shaped = (
        trimmed.select(*keys, value, order, low.alias("low"), high.alias("high"))
        .groupBy(*keys, "low", "high")
        .agg(
            F.count(value).alias("n"),
            F.stddev_samp(value).alias("sd"),
            F.percentile(value, [0.25, 0.75]).alias("quartiles"),
            F.min_by(value, order).alias("earliest"),
            F.collect_list(value).alias("days"),
        )
        .where((F.col("n") >= 2) & few_enough)
        .withColumn("bw", 0.9 * scale * F.pow(size, F.lit(-0.2)))
        .withColumn("exponent", -0.5 / (F.col("bw") * F.col("bw")))
        .withColumn("step", (F.col("high") - F.col("low")) / (points - 1))
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(CURVE_SLICES - 1))))
        .repartition(tasks, *keys, "slice")
    )
    stretch = -(-points // CURVE_SLICES)
    first = F.col("slice") * stretch
    last = F.least(first + stretch, F.lit(points)) - 1
    numbers = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    def grid_point(number: Column) -> Column:
        x = F.col("low") + number * F.col("step")

        def add_kernel(total: Column, day: Column) -> Column:
            return total + F.exp((x - day) * (x - day) * F.col("exponent"))

        height = F.aggregate("days", F.lit(0.0), add_kernel)
        return F.struct(
            number.alias("point"),
            x.alias("x"),
            (height / (size * F.col("bw") * math.sqrt(2 * math.pi))).alias("density"),
        )

    return shaped.select(*keys, "bw", F.inline(F.transform(numbers, grid_point)))


def dow_tod_bars(profile: DataFrame, keys: Sequence[str] = CAMPAIGN) -> DataFrame:
    """A weekday and shift profile as grouped bars, one panel per campaign."""
    return _ordered(profile, *keys, "dow_order", "tod")


def trend_by_tod(profile: DataFrame, keys: Sequence[str] = CAMPAIGN) -> DataFrame:
    """A weekday and shift profile as one line per campaign and shift, Sunday to Saturday."""
    return _ordered(profile, *keys, "tod", "dow_order")

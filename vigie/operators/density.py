"""Density hot spots: a Gaussian kernel over distinct places, on a grid.

For m places the density at a grid point g is

    sum_i exp(-((gx - x_i) / hx)^2 / 2 - ((gy - y_i) / hy)^2 / 2) / (2 pi m hx hy)
    h = 1.06 * min(sd, IQR / 1.34) * m^(-1/5)      along each axis

The kernel is a product of one factor per axis. A task therefore turns its places into
two thin matrices, one factor per place and grid line, and their product is the task's
whole grid: neither place-cell pairs nor a cross join are needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vigie import rules

Extent = tuple[tuple[float, float], tuple[float, float]]
MAP_EXTENT: Extent = (rules.LONGITUDE_EXTENT, rules.LATITUDE_EXTENT)


# Around a quartile, values of ranks within this share of all are sorted; below so many rows, all.
NEAR = 0.002
FEW = 2_000
ACCURACY = 10_000


def _quartile(h: Column, below: str, above: str) -> Column:
    """Linear interpolation between two neighbouring order statistics."""
    return F.col(below) + (h - F.floor(h)) * (F.col(above) - F.col(below))


def axis_quartiles(values: DataFrame) -> DataFrame:
    """Count, deviation and exact quartiles of ``value`` per ``axis`` (a few axes). Nothing runs here.

    Equal values are counted first, so no value is hot. Approximate quantiles, whose error is bounded,
    then fence in each quartile; values below the fence are only counted and those inside, a small
    share of all, are sorted.
    """
    near = (0.25 - NEAR, 0.25 + NEAR, 0.75 - NEAR, 0.75 + NEAR)
    fences = F.percentile_approx("value", list(near), ACCURACY)
    m = F.count("value")
    stats = F.broadcast(values.groupBy("axis").agg(  # one row per axis
        m.alias("m"),
        F.stddev_samp("value").alias("sd"),
        F.when(m < FEW, F.array(F.min("value"), F.max("value"), F.min("value"), F.max("value")))
        .otherwise(fences).alias("fences"),
    ))
    h = {"q25": (F.col("m") - 1) * 0.25, "q75": (F.col("m") - 1) * 0.75}
    counted = values.groupBy("axis", "value").agg(F.count(F.lit(1)).alias("n")).join(stats, "axis")
    sides = F.array(*[
        F.struct(
            F.lit(name).alias("quartile"), F.floor(rank).alias("rank"),
            F.get("fences", F.lit(2 * i)).alias("low"), F.get("fences", F.lit(2 * i + 1)).alias("high"),
        )
        for i, (name, rank) in enumerate(h.items())
    ])
    fenced = counted.select("axis", "value", "n", "m", F.inline(sides)).filter(F.col("value") <= F.col("high"))
    below = F.broadcast(fenced.groupBy("axis", "quartile").agg(
        F.sum(F.when(F.col("value") < F.col("low"), F.col("n")).otherwise(0)).alias("below")))
    upto = W.partitionBy("axis", "quartile").orderBy("value").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    ranked = (
        fenced.filter(F.col("value") >= F.col("low"))
        .withColumn("inside", F.sum("n").over(upto))
        .join(below, ["axis", "quartile"])
        .withColumn("upto", F.col("below") + F.col("inside"))
    )

    def at(rank: Column, quartile: str) -> Column:
        holds = (rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n"))
        return F.max(F.when(holds & (F.col("quartile") == quartile), F.col("value")))

    following = F.least(F.col("rank") + 1, F.col("m") - 1)
    found = [
        column
        for name in h
        for column in (at(F.col("rank"), name).alias(f"{name}_low"), at(following, name).alias(f"{name}_high"))
    ]
    return (
        ranked.groupBy("axis")
        .agg(*found)
        .join(stats.select("axis", "m", "sd"), "axis")
        .select("axis", "m", "sd", *[_quartile(h[name], f"{name}_low", f"{name}_high").alias(name) for name in h])
    )


def _width(m: Column, sd: Column, q25: Column, q75: Column) -> Column:
    return F.least(sd, (q75 - q25) / 1.34) * 1.06 * m.cast("double") ** F.lit(-0.2)


def bandwidths(places: DataFrame) -> DataFrame:
    """One row: number of places ``m`` and the kernel widths ``hx`` and ``hy``."""
    m = F.col("m")
    values = F.array(
        F.struct(F.lit("x").alias("axis"), F.col("longitude").alias("value")),
        F.struct(F.lit("y").alias("axis"), F.col("latitude").alias("value")),
    )
    width = _width(m, F.col("sd"), F.col("q25"), F.col("q75"))
    return (
        axis_quartiles(places.select(F.inline(values)))
        .agg(
            F.max("m").alias("m"),
            F.max(F.when(F.col("axis") == "x", width)).alias("hx"),
            F.max(F.when(F.col("axis") == "y", width)).alias("hy"),
        )
    )


def hotspot_density(
    places: DataFrame, grid: int = 100, extent: Extent = MAP_EXTENT
) -> DataFrame:
    """Density on a ``grid`` x ``grid`` raster; each place row counts once.

    Fewer than two places, or places without spread along an axis, give no rows. Nothing runs
    here: the one row of widths joins the kernel's input as a scalar. The places are read several
    times; Spark reuses the shuffle they come from.
    """
    if grid < 2:
        raise ValueError("grid needs at least 2 points per axis")
    located = places.filter(F.col("longitude").isNotNull() & F.col("latitude").isNotNull()).select(
        F.col("longitude").cast("double").alias("longitude"), F.col("latitude").cast("double").alias("latitude")
    )
    widths = bandwidths(located).select(F.struct("m", "hx", "hy")).scalar()
    (x_low, x_high), (y_low, y_high) = extent
    x_step, y_step = (x_high - x_low) / (grid - 1), (y_high - y_low) / (grid - 1)

    def task_grid(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        steps = np.arange(grid)
        x_lines, y_lines = x_low + steps * x_step, y_low + steps * y_step
        total, seen = np.zeros((grid, grid)), False
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (column.to_numpy(zero_copy_only=False) for column in batch.columns[:2])
            m, hx, hy = (column[0].as_py() for column in batch.columns[2:])
            along_x = np.exp(-(((x_lines - x[:, None]) / hx) ** 2) / 2)
            along_y = np.exp(-(((y_lines - y[:, None]) / hy) ** 2) / 2)
            total += along_x.T @ along_y / (2 * pi * m * hx * hy)
            seen = True
        if seen:
            cell_x, cell_y = np.divmod(np.arange(grid * grid, dtype="int32"), grid)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cell_x, pa.int32()),
                    pa.array(cell_y, pa.int32()),
                    pa.array(total.ravel()),
                ],
                names=["cell_x", "cell_y", "part"],
            )

    return (
        located.select("longitude", "latitude", widths.alias("widths"))
        .filter("widths.hx > 0 AND widths.hy > 0")
        .select("longitude", "latitude", "widths.*")
        .mapInArrow(task_grid, "cell_x INT, cell_y INT, part DOUBLE")
        .groupBy("cell_x", "cell_y")
        .agg(F.sum("part").alias("density"))
        .select(
            "cell_x",
            "cell_y",
            (F.lit(x_low) + F.col("cell_x") * F.lit(x_step)).alias("longitude"),
            (F.lit(y_low) + F.col("cell_y") * F.lit(y_step)).alias("latitude"),
            "density",
        )
    )

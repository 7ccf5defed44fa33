"""Storage and work of a block in four formats, by formula."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("CSR", "CSC", "CDS", "Dense")


def _long(formats: list[tuple[str, Column, Column, Column]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(name).alias("format"), s.cast("bigint").alias("storage"), m.cast("bigint").alias("mults"), a.cast("bigint").alias("memory")) for name, s, m, a in formats]))


def _sums(cells: DataFrame, key: list[str], rows: Column, cols: Column) -> DataFrame:
    """Entries z, diagonals and their lengths (spread) within each block that has entries; cells don't repeat. rows and cols follow from the key."""
    along = cells.groupBy(*key, (F.col("j") - F.col("i")).alias("d")).agg(F.count("*").alias("z"))
    d = F.col("d")
    length = F.when(d < 0, F.least(rows + d, cols)).otherwise(F.least(rows, cols - d))
    return along.groupBy(*key).agg(F.sum("z").alias("z"), F.count("*").alias("diagonals"), F.sum(length.cast("bigint")).alias("spread"))


def _costs(sums: DataFrame, key: list[str], count: Column, rows: Column, cols: Column) -> DataFrame:
    """Of `count` blocks of equal size together: costs are linear in their sums, so that empty blocks need no rows of their own."""
    z, n, spread = (F.coalesce(F.col(c), F.lit(0)) for c in ("z", "diagonals", "spread"))
    return sums.select(*key, _long([
        ("CSR", count * (rows + 1) + 2 * z, z, 4 * z),
        ("CSC", count * (cols + 1) + 2 * z, z, 4 * z),
        ("CDS", n + spread, spread, 3 * n + 3 * spread),
        ("Dense", count * rows * cols, count * rows * cols, 3 * count * rows * cols),
    ]).alias("c")).select(*key, "c.*")


def format_cost(cells: DataFrame, n: int, b: int) -> DataFrame:
    """(block, format, storage, mults, memory) of all b * b blocks of the floor_last convention."""
    size = n // b
    r, c = F.least(F.floor(F.col("i") / size), F.lit(b - 1)), F.least(F.floor(F.col("j") / size), F.lit(b - 1))
    last = n - size * (b - 1)
    width = lambda k: F.when(k == b - 1, last).otherwise(size).cast("bigint")
    rows, cols = width(F.floor(F.col("block") / b)), width(F.col("block") % b)
    keyed = cells.where("v <> 0").select("i", "j").distinct().select((r * b + c).alias("block"), (F.col("i") - r * size).alias("i"), (F.col("j") - c * size).alias("j"))
    every = cells.sparkSession.range(b * b).select(F.col("id").alias("block"))
    return _costs(every.join(_sums(keyed, ["block"], rows, cols), "block", "left"), ["block"], F.lit(1), rows, cols)


def format_cost_sweep(cells: DataFrame, n: int, most: int | None = None) -> DataFrame:
    """(b, format, storage, mults, memory), summed over the b * b blocks, for each b up to `most` that divides n. All in one pass over the cells."""
    counts = [b for b in range(1, (most or n) + 1) if n % b == 0]
    each = F.explode(F.array(*[F.lit(b).cast("bigint") for b in counts])).alias("b")
    b = F.col("b")
    size = (F.lit(n) / b).cast("bigint")
    r, c = F.floor(F.col("i") / size), F.floor(F.col("j") / size)
    keyed = cells.where("v <> 0").select("i", "j").distinct().select("i", "j", each)
    keyed = keyed.select("b", (r * b + c).alias("block"), (F.col("i") - r * size).alias("i"), (F.col("j") - c * size).alias("j"))
    sums = _sums(keyed, ["b", "block"], size, size).groupBy("b").agg(*[F.sum(k).alias(k) for k in ("z", "diagonals", "spread")])
    every = cells.sparkSession.range(1).select(each)
    return _costs(every.join(sums, "b", "left"), ["b"], b * b, size, size)


def cheapest(costs: DataFrame, by: str = "memory") -> DataFrame:
    """Of each block the format of least cost, the first of equals."""
    order = F.array_position(F.array(*map(F.lit, FORMATS)), F.col("format"))
    return costs.groupBy("block").agg(F.min_by("format", F.struct(F.col(by), order)).alias("format"), F.min(by).alias(by))

"""Split-risk kernels as columns, in doubles: good to nine places for expectations and bounds (functions.exact has the rest)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Factors that a product may have; beyond that its logarithm is summed in closed form.
FACTORS = 4_096


def all_drawn(population: Column, drawn: Column, size: Column) -> Column:
    """The chance that all ``size`` files of a group are among ``drawn`` of ``population``.

    A product of (drawn - i) / (population - i) over the group's files, or, which is the same, of (population - size - i) /
    (population - i) over the files that aren't drawn, whichever are fewer. Of more than FACTORS the logarithm is summed by Euler and
    Maclaurin's formula, so that a group of any size takes a bounded row.
    """
    few = size <= population - drawn
    n = F.when(few, size).otherwise(population - drawn).cast("long")
    top = F.when(few, drawn).otherwise(population - size)
    product = F.aggregate(F.sequence(F.lit(1).cast("long"), F.when(n <= FACTORS, n).otherwise(1)), F.lit(1.0), lambda a, i: a * F.greatest(top - i + 1, F.lit(0)) / (population - i + 1))
    ends = lambda f: f(n) - f(F.lit(0))
    whole = n * F.log(top / population) - (top - n) * F.log1p(-n / top) + (population - n) * F.log1p(-n / population)
    step = ends(lambda i: F.log(top - i) - F.log(population - i)) / 2
    slope = ends(lambda i: -1.0 / (top - i) + 1.0 / (population - i)) / 12
    # with fewer than 64 to spare the chance is below what a double holds
    summed = F.when(top - n < 64, 0.0).otherwise(F.exp(whole - step + slope))
    return F.when(n <= 0, 1.0).when(n <= FACTORS, product).otherwise(summed)


def crossing(population: Column, test: Column, size: Column) -> Column:
    """The chance that a group has files on both sides."""
    return 1 - all_drawn(population, test, size) - all_drawn(population, population - test, size)


def exposed(population: Column, test: Column, size: Column) -> Column:
    """U4: the expected number of a group's test files with a twin in train."""
    return size * test / population - size * all_drawn(population, test, size)


def allocations(groups: Column, files: Column, cap: Column | None = None) -> dict[str, Column]:
    """The even and the uneven allocation as arrays of (size, n), three rows at most; null where no allocation is possible."""
    room = files - 2 * groups if cap is None else F.coalesce(cap - 2, files - 2 * groups)
    feasible = (groups >= 1) & (files >= 2 * groups) & ((F.lit(True) if cap is None else cap.isNull()) | (files <= groups * (room + 2)))
    spare = files - 2 * groups
    full = F.when(room > 0, F.floor(spare / room)).otherwise(0).cast("long")
    part = (spare - full * room).cast("long")
    some = F.when(part > 0, 1).otherwise(0)
    even, over = F.floor(files / groups).cast("long"), files % groups

    def rows(*pairs: tuple[Column, Column]) -> Column:
        every = F.array(*[F.struct(size.cast("long").alias("size"), n.cast("long").alias("n")) for size, n in pairs])
        return F.when(feasible, F.filter(every, lambda p: p["n"] > 0))

    return {"balanced": rows((even, groups - over), (even + 1, over)), "concentrated": rows((F.lit(2), groups - full - some), (2 + part, some), (2 + room, full))}


def summed(kernel: Callable[[Column, Column, Column], Column], population: Column, test: Column, histogram: Column) -> Column:
    """The sum of a kernel over an array of (size, n)."""
    return F.aggregate(histogram, F.lit(0.0), lambda a, p: a + p["n"] * kernel(population, test, p["size"]))


def bounds(params: DataFrame) -> DataFrame:
    """U8: adds crossing_low, crossing_high, exposed_low, exposed_high to (population, test, files, groups, cap): sharp bounds from the sums alone.

    Both kernels rise with size, ever less, so the uneven allocation is least and the even one greatest. Null where nothing is feasible.
    """
    population, test = F.col("population"), F.col("test")
    a = allocations(F.col("groups"), F.col("files"), F.col("cap"))
    made = params.withColumns({"__low": a["concentrated"], "__high": a["balanced"]})
    values = {f"{name}_{side}": F.round(summed(k, population, test, F.col(f"__{side}")), 9) for name, k in (("crossing", crossing), ("exposed", exposed)) for side in ("low", "high")}
    return made.withColumns(values).drop("__low", "__high")


def decision(low: Column, high: Column, threshold: Column) -> Column:
    """whether bounds lie above a threshold, below it, or on both sides."""
    return F.when(low >= threshold, "certify-high").when(high < threshold, "certify-low").otherwise("inconclusive")

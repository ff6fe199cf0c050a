"""Array and matrix expressions for nested case records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def magnitude(matrix: Column) -> Column:
    """|re + i im| of a matrix of (re, im) structs."""
    return F.transform(matrix, lambda row: F.transform(row, lambda z: F.hypot(z["re"], z["im"])))


def last_slice(stack: Column, index: int = -1) -> Column:
    """One time slice of a stack of matrices; negative counts from the end."""
    return F.element_at(stack, index if index < 0 else index + 1)


def thin(matrix: Column, row_step: int | None = None, col_step: int | None = None) -> Column:
    """Every k-th row and every k-th column."""
    rows = F.filter(matrix, lambda _, i: i % (row_step or 1) == 0)
    return F.transform(rows, lambda row: F.filter(row, lambda _, j: j % (col_step or 1) == 0))


def _at(n_in: Column, n_out: int, i: Column) -> tuple[Column, Column, Column]:
    pos = i * (n_in - 1) / F.lit(float(max(n_out - 1, 1)))
    lo = F.floor(pos).cast("int")
    return lo, F.least(lo + 1, n_in - 1), pos - lo


def resample(matrix: Column, rows: int, cols: int) -> Column:
    """Linear interpolation to a fixed shape with the corners kept."""

    def line(row: Column) -> Column:
        def point(j: Column) -> Column:
            lo, hi, w = _at(F.size(row), cols, j)
            return F.get(row, lo) * (1 - w) + F.get(row, hi) * w

        return F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), point)

    def blend(i: Column) -> Column:
        lo, hi, w = _at(F.size(matrix), rows, i)
        return F.zip_with(F.get(matrix, lo), F.get(matrix, hi), lambda a, b: a * (1 - w) + b * w)

    return F.transform(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), blend), line)


def at_fraction(profile: Column, grid: Column, fraction: float = 0.95) -> Column:
    """profile[int(fraction * (len(grid) - 1))], clipped to the profile; NULL for one-point grids."""
    i = F.floor(F.lit(fraction) * (F.size(grid) - 1)).cast("int")
    return F.when(F.size(grid) > 1, F.get(profile, F.least(i, F.size(profile) - 1)))


def only(array: str, i: int, n: int) -> Column:
    """Position ``i`` of an array that has ``n`` positions at most (NULL past its end); a longer one is an error."""
    longer = F.raise_error(F.lit(f"{array} has more than {n} positions"))
    return F.when(F.size(array) > n, longer).otherwise(F.get(array, F.lit(i)))

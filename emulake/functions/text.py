"""Small text rules: assignment lines, slugs, id lists, durations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as a number on the right of an assignment.
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"


def to_number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def name_pattern(name: str) -> str:
    """The name as a whole token: bounded by line ends, white space, '.' or '='."""
    return r"(^|[\s.=])" + re.escape(name) + r"($|[\s.=])"


def left_side(line: Column) -> Column:
    return F.substring_index(line, "=", 1)


def right_side(line: Column) -> Column:
    return line.substr(F.length(left_side(line)) + 2, F.length(line))


def assigns(line: Column, name: str) -> Column:
    """True when the line sets ``name``."""
    return line.contains("=") & left_side(line).rlike(name_pattern(name))


def assigned_number(line: Column) -> Column:
    """The number on the right; comments after '!' or '#' are ignored, other text gives NULL."""
    return to_number(F.trim(F.regexp_replace(right_side(line), r"[!#].*$", "")))


def slug(c: Column, default: str = "model") -> Column:
    """Letters, digits, '_', '.', '-' only; at most 120 characters."""
    bare = F.regexp_replace(c, r"^\s+|\s+$", "")
    safe = F.substring(F.regexp_replace(bare, "[^a-zA-Z0-9_.-]+", "_"), 1, 120)
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit(default))


def id_tokens(c: Column) -> Column:
    """Tokens of a queue id list such as ``[1-3,7%4]``: brackets and throttle suffixes removed."""
    bare = F.regexp_replace(c, r"[\[\]\s]", "")
    return F.transform(F.split(bare, ","), lambda t: F.substring_index(t, "%", 1))


def expand_ids(token: Column) -> Column:
    """Array of ids for ``a-b`` or ``a``; anything else is empty."""
    lo = F.regexp_extract(token, r"^(\d+)", 1).try_cast("bigint")
    hi = F.regexp_extract(token, r"-(\d+)$", 1).try_cast("bigint")
    empty = F.array().cast("array<bigint>")
    return (
        F.when(token.rlike(r"^\d+$"), F.array(lo))
        .when(token.rlike(r"^\d+-\d+$") & (lo <= hi), F.sequence(lo, F.greatest(lo, hi)))
        .otherwise(empty)
    )


def duration(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds."""
    s = seconds.cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def tenths(x: Column) -> Column:
    """A non-negative number in whole tenths, rounded by its exact binary value with ties to even.

    The built-in formatter rounds the shortest decimal text half up instead (6.25 to 6.3). Twice the tenths is
    20 x = 16 x + 4 x; the rounding error of that one addition tells on which side of a midpoint x lies.
    """
    a, b = x * 16.0, x * 4.0
    s = a + b
    back = s - a
    error = (a - (s - back)) + (b - back)
    k = F.floor(s)
    nearest = F.floor(s / 2.0 + 0.5)
    midpoint = (s == k) & (k % 2 == 1)
    low = F.floor(s / 2.0)
    return F.when(~midpoint, nearest).when(error > 0, low + 1).when(error < 0, low).otherwise(low + low % 2)


def percent(part: Column, whole: Column) -> Column:
    """``x.x%``; 0.0% of nothing."""
    t = tenths(F.try_divide(part * 100.0, whole))
    shown = F.concat((F.floor(t / 10)).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit("%"))
    return F.when(whole == 0, F.lit("0.0%")).otherwise(shown)


def number_text(value: Column) -> Column:
    """Value as written into an input file: integers without a decimal point."""
    whole = F.abs(value - F.bround(value)) < 1e-10
    return F.when(whole, F.bround(value).cast("bigint").cast("string")).otherwise(value.cast("string"))

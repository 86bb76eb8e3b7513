"""Column expressions shared by the operators. NULL is the only missing value; NaN never leaves an operator."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

Z95 = 1.959963984540054
MAD_SCALE = 0.67448975

#: State and territory codes and names.
STATE_NAMES = {
    1: "Alabama", 2: "Alaska", 4: "Arizona", 5: "Arkansas", 6: "California", 8: "Colorado", 9: "Connecticut", 10: "Delaware",
    11: "District of Columbia", 12: "Florida", 13: "Georgia", 15: "Hawaii", 16: "Idaho", 17: "Illinois", 18: "Indiana", 19: "Iowa",
    20: "Kansas", 21: "Kentucky", 22: "Louisiana", 23: "Maine", 24: "Maryland", 25: "Massachusetts", 26: "Michigan", 27: "Minnesota",
    28: "Mississippi", 29: "Missouri", 30: "Montana", 31: "Nebraska", 32: "Nevada", 33: "New Hampshire", 34: "New Jersey",
    35: "New Mexico", 36: "New York", 37: "North Carolina", 38: "North Dakota", 39: "Ohio", 40: "Oklahoma", 41: "Oregon",
    42: "Pennsylvania", 44: "Rhode Island", 45: "South Carolina", 46: "South Dakota", 47: "Tennessee", 48: "Texas", 49: "Utah",
    50: "Vermont", 51: "Virginia", 53: "Washington", 54: "West Virginia", 55: "Wisconsin", 56: "Wyoming", 66: "Guam",
    72: "Puerto Rico", 78: "Virgin Islands",
}


def number(c: Column | str) -> Column:
    """Text and numbers as double; what isn't a number, and NaN, as NULL."""
    v = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(v), v)


def valid_weight(w: Column | str) -> Column:
    v = number(w)
    return F.coalesce((v > 0) & (v < F.lit(float("inf"))), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def kish(sw: Column, sw2: Column) -> Column:
    """Effective sample size of weights from their sum and their sum of squares."""
    return ratio(sw * sw, sw2)


def phi(sw: Column, sa: Column, sb: Column, sab: Column) -> Column:
    """Weighted phi from the sums of weights of all, of either and of both; NULL where a margin is 0 or 1."""
    pa, pb, pab = ratio(sa, sw), ratio(sb, sw), ratio(sab, sw)
    spread = pa * (1 - pa) * pb * (1 - pb)
    return F.when(spread > 1e-15, (pab - pa * pb) / F.sqrt(spread))


def wilson(p: Column, n: Column) -> tuple[Column, Column, Column]:
    """Standard error and 95 % Wilson bounds of a proportion; NULL without trials."""
    n = F.when(n > 0, n.cast("double"))
    low = 1 + Z95**2 / n
    centre = (p + Z95**2 / (2 * n)) / low
    radius = Z95 * F.sqrt(p * (1 - p) / n + Z95**2 / (4 * n * n)) / low
    return F.sqrt(p * (1 - p) / n), centre - radius, centre + radius


def r(c: Column | str, digits: int = 8) -> Column:
    """Rounded for comparison between engines, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def state_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in STATE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, code.cast("int")), F.format_string("Unknown (%02d)", code.cast("int")))


def graph_id(year: int, state: Column, definition: str | None, category: Column) -> Column:
    middle = f"_{definition}_" if definition else "_"
    return F.concat(F.lit(f"{year}_"), F.lpad(state.cast("string"), 2, "0"), F.lit(middle), category)


def average_rank(value: Column | str, partition: list[str]) -> Column:
    """Rank within partition, ties by their mean."""
    value = F.col(value) if isinstance(value, str) else value
    ties = Window.partitionBy(*partition, value)
    return F.rank().over(Window.partitionBy(*partition).orderBy(value)) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def correlation(x: str, y: str) -> Column:
    """Pearson correlation, NULL where either side doesn't vary (an aggregate; corr() divides by zero there)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def bh(p: Column, partition: list[Column | str]) -> Column:
    """Benjamini-Hochberg q over valid p of the partition; others stay NULL."""
    ok = F.coalesce(p.between(0.0, 1.0) & ~F.isnan(p), F.lit(False))
    w = Window.partitionBy(*partition, ok)
    up = w.orderBy(p.asc())
    raw = p * F.count(F.lit(1)).over(w) / F.row_number().over(up)
    # the smallest raw value at or above a rank: rows of equal p share it
    q = F.min(raw).over(up.rowsBetween(0, Window.unboundedFollowing))
    return F.when(ok, F.least(q, F.lit(1.0)))


def holm(p: Column, partition: list[Column | str], order: Column) -> Column:
    """Holm's step-down p; `order` breaks ties."""
    w = Window.partitionBy(*partition)
    by = w.orderBy(p, order)
    raw = (F.count(F.lit(1)).over(w) - F.row_number().over(by) + 1) * p
    return F.least(F.lit(1.0), F.max(raw).over(by.rowsBetween(Window.unboundedPreceding, 0)))


def bits(mask: Column | str) -> Column:
    return F.bit_count(mask).cast("int")


def contains(graph: Column, motif: Column) -> Column:
    return graph.bitwiseAND(motif) == motif


def jaccard(a: Column, b: Column) -> Column:
    union = bits(a.bitwiseOR(b))
    return F.when(union == 0, F.lit(1.0)).otherwise(bits(a.bitwiseAND(b)) / union)


def hashed(*parts: Column | str | int) -> Column:
    """31 bits or so of md5 over the parts joined by '|': the same number in any engine."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def whole(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)

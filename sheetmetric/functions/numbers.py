"""Exact sums and half-up rounding."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(col: Column) -> Column:
    """Order-independent sum of doubles: added up as decimals with six places.

    Values beyond a decimal (10^22) are left out; ``out_of_range`` counts them.
    """
    return F.sum(col.try_cast("decimal(28,6)"))


def out_of_range(col: Column) -> Column:
    """Number of values that ``exact_sum`` leaves out."""
    return F.count(F.when(col.isNotNull() & col.try_cast("decimal(28,6)").isNull(), 1))


def half_up(col: Column, places: int) -> Column:
    """Rounded once, half up, on the shortest decimal form; what is beyond a decimal stays as it is."""
    value = col.cast("double")
    return F.coalesce(value.try_cast(f"decimal(38,{places})").cast("double"), value)

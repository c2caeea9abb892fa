"""Vector expressions, natively over arrays of numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """Whether a double vector isn't null and all its components are finite."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def comparable(v: Column) -> Column:
    """Whether a double vector has a direction: it is finite, and one component isn't zero."""
    return F.coalesce(finite(v) & F.exists(v, lambda x: x != 0), F.lit(False))

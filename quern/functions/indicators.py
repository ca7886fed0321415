"""Column expressions over ordered rows; each takes the window that orders them."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def per_unit_price(amount: str, quantity: str) -> Column:
    """Null where the quantity is zero."""
    return F.col(amount) / F.nullif(F.col(quantity), F.lit(0))


def change(value: str, ordered: WindowSpec, rows: int = 1) -> Column:
    """Relative change against the row ``rows`` before; null for the first ones and after a zero."""
    before = F.lag(value, rows).over(ordered)
    return F.col(value) / F.nullif(before, F.lit(0)) - 1


def drawdown(value: str, ordered: WindowSpec) -> Column:
    """How far ``value`` lies below its highest so far, as a share of that."""
    highest = F.max(value).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return 1 - F.col(value) / highest

from quern.functions.indicators import change, drawdown, per_unit_price

__all__ = ["change", "drawdown", "per_unit_price"]

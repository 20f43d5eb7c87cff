from hazardframe.functions.columns import at_risk, days_since, hash31, hash31_sql, rounded, running, steps_below, window_exposure
from hazardframe.functions.numbers import clock_cell, hash_cell, numbered, running_sum, value_cell

__all__ = ["at_risk", "clock_cell", "days_since", "hash31", "hash31_sql", "hash_cell", "numbered", "rounded", "running", "running_sum", "steps_below", "value_cell", "window_exposure"]

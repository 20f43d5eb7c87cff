"""Errors of the engine."""


class ValidationError(ValueError):
    """Rows that break a rule of the counting-process layout."""


class UndefinedMetricError(ValueError):
    """A metric that the rows do not determine, such as a concordance without pairs."""

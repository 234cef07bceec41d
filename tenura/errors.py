"""Errors raised by gates and argument checks."""


class DataError(ValueError):
    """Input data or arguments break an operator's contract."""


class QualityError(DataError):
    """A blocking data-quality suite found bad rows."""


class StaleFeaturesError(DataError):
    """Feature rows are older than the freshness limit."""


class InfeasibleError(DataError):
    """No allocation can satisfy the constraints."""

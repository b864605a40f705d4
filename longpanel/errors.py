"""Exceptions raised by the library; a broken invariant is an error, never a log line."""


class PanelError(Exception):
    """Base class."""


class SchemaMismatch(PanelError):
    """A table does not carry the schema its reader was promised."""


class PointInTimeError(PanelError):
    """A label window is not strictly after the feature it is paired with."""


class LeakageError(PanelError):
    """Training data can see the evaluation data."""


class ParityError(PanelError):
    """Two PnL tables that must agree do not."""


class UniverseError(PanelError):
    """A universe rule cannot be resolved point-in-time."""

"""Errors of fitting, transforming and loading."""


class MlframeError(Exception):
    """Base of all errors here."""


class EmptyData(MlframeError):
    """There are no rows to learn from."""


class FeatureMismatch(MlframeError):
    """Columns are missing, or a different number of them than were fitted."""


class InvalidParameter(MlframeError, ValueError):
    """A setting, or a value met while fitting, is out of range."""


class MissingValues(MlframeError):
    """Missing values where none are allowed."""


class NumericalError(MlframeError):
    """A result that is not finite where it has to be."""


class SerializationError(MlframeError):
    """A saved object cannot be read."""

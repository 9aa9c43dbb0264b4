"""Errors by the part of the engine that raises them."""


class LogloomError(Exception):
    """Any error of this package."""


class ConfigError(LogloomError):
    """A configuration that can't be read or makes no sense."""


class SourceError(LogloomError):
    """A source that can't be opened or read."""


class PipelineError(LogloomError):
    """A module that can't be built or run."""


class SinkError(LogloomError):
    """An output that can't be written."""

"""The closed set of errors."""


class EngineError(Exception):
    """Any error of the engine."""


class NotFound(EngineError):
    """No visible value."""


class Corruption(EngineError):
    """Stored data contradict themselves."""


class NotSupported(EngineError):
    """A form that this engine does not read."""


class InvalidArgument(EngineError):
    """The caller's mistake, or a database in a state that the options forbid."""


class IoError(EngineError):
    """The file system failed."""


def describe(error: BaseException) -> str:
    return f"{type(error).__name__}: {error}" if isinstance(error, EngineError) else f"unexpected error: {error}"

"""Error categories of the engine's contract."""


class EngineError(Exception):
    """Base of all errors the engine raises itself."""


class InvalidArgument(EngineError, ValueError):
    """A value outside its domain."""


class LimitExceeded(EngineError):
    """A documented limit would be passed."""


class NullArgument(EngineError, ValueError):
    """A null where none is allowed."""


class NotPermitted(EngineError, PermissionError):
    """A path or an operation the configuration forbids."""


class StateConflict(EngineError):
    """The stored state does not allow the operation."""


class HashCollision(EngineError):
    """Two long terms share a key."""

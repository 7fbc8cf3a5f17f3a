"""Errors by cause. Each is also the closest built-in error, so callers may catch either."""


class GraphError(Exception):
    """Base of all errors of the package."""


class InvalidError(GraphError, ValueError):
    """An argument or a piece of metadata breaks a rule."""


class MissingKeyError(GraphError, KeyError):
    """A named type, property, label or layout isn't there."""

    def __str__(self) -> str:
        return str(self.args[0]) if self.args else ""


class TypeMismatchError(GraphError, TypeError):
    """A value or column has another type than declared."""


class IndexRangeError(GraphError, IndexError):
    """A vertex id or chunk number is out of range."""


class StorageError(GraphError, OSError):
    """A file can't be read or written."""


class YamlError(GraphError, ValueError):
    """A metadata file isn't what it should be."""

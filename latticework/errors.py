"""Errors of the package; all are also the closest built-in kind."""


class MatrixError(Exception):
    """Base of the package's errors."""


class InvalidArgument(MatrixError, ValueError):
    pass


class Unsupported(MatrixError, NotImplementedError):
    pass


class FormatError(MatrixError, ValueError):
    """A file that breaks its format."""


class FileError(MatrixError, OSError):
    pass

"""Errors with the column, coder or file they concern."""

from __future__ import annotations


class QuernError(Exception):
    """Base of all errors of the library."""


class SchemaError(QuernError):
    def __init__(self, reason: str, column: str | None = None) -> None:
        super().__init__(f"column {column!r}: {reason}" if column is not None else reason)
        self.column, self.reason = column, reason


class CoderError(QuernError):
    """An encoder was given what it can't take."""

    def __init__(self, coder: str, reason: str) -> None:
        super().__init__(f"coder {coder!r}: {reason}")
        self.coder, self.reason = coder, reason


class CorruptedError(CoderError):
    """A decoder was given malformed bytes."""


class UnknownCoderError(CoderError):
    def __init__(self, coder: str) -> None:
        super().__init__(coder, "no such coder is registered")


class ParameterError(CoderError):
    def __init__(self, coder: str, parameter: str, reason: str) -> None:
        super().__init__(coder, f"parameter {parameter!r}: {reason}")
        self.parameter = parameter


class PipelineError(QuernError):
    """Stages in an order or with types that don't fit."""


class FormatError(QuernError):
    """A dataset or file that isn't what it should be."""


class ConversionError(QuernError):
    """A value that the target type can't hold."""

    def __init__(self, column: str, reason: str) -> None:
        super().__init__(f"column {column!r}: {reason}")
        self.column, self.reason = column, reason

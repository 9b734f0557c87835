"""Errors a caller can act on."""


class QuerytideError(Exception):
    """Base class; `code` is the machine-readable name of the failure."""

    code = "INTERNAL_ERROR"


class WordsNotFoundError(QuerytideError):
    """None of the words to delete is in the stop list."""

    code = "WORDS_NOT_FOUND"


class InvalidArgumentError(QuerytideError, ValueError):
    """A parameter is outside its allowed range."""

    code = "INVALID_ARGUMENT"

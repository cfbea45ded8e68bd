"""Exceptions of the engine."""


class SondageError(Exception):
    """Base of all errors raised here."""


class InvalidPattern(SondageError):
    """A regular expression that does not compile, or a signature pattern without a target."""


class InvalidMode(SondageError):
    """A search mode that is none of text, semantic, ast, hybrid."""


class IndexNotFound(SondageError):
    """No index under the given path."""


class IndexVersionMismatch(SondageError):
    """An index written by another version of the tables."""


class EmbedderError(SondageError):
    """An embedder that cannot be made or fails."""

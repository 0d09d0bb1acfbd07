"""Exceptions raised on the driver; data errors are rows of the ``errors`` frame instead."""

from __future__ import annotations


class QuarryError(Exception):
    """Base class; *details* is merged into the message."""

    def __init__(self, message: str, **details) -> None:
        self.details = details
        extra = ", ".join(f"{key}={value!r}" for key, value in details.items())
        super().__init__(f"{message} ({extra})" if extra else message)


class InvalidConfiguration(QuarryError):
    """A setting has a value that cannot work."""


class SourceError(QuarryError):
    """A document source cannot be read."""


class PathOutsideRoot(SourceError):
    """A document id points outside its root folder."""


class UnsupportedFormat(SourceError):
    """No parser is available for a content type."""


class StoreError(QuarryError):
    """The document store cannot do what was asked."""


class EmbeddingError(QuarryError):
    """An embedding cannot be computed or has the wrong size."""


class PromptNotFound(QuarryError):
    """The prompt id is unknown."""


class EvaluationError(QuarryError):
    """An evaluation is not well defined."""


class ServiceError(QuarryError):
    """An external model failed after all retries."""

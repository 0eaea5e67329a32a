"""Errors of the engine.  Spark's own are told apart by kind and kept as the cause."""

from __future__ import annotations

from contextlib import contextmanager


class EngineError(Exception):
    """Base of all."""


class CatalogError(EngineError):
    """A database or table exists already, or does not exist."""


class NotFoundError(CatalogError):
    """What is named does not exist."""


class AlreadyExistsError(CatalogError):
    """What is to be made exists."""


class StatementError(EngineError):
    """A text holds no statement that can be run."""


class ParseError(StatementError):
    """A text is no SQL."""


class PlanningError(EngineError):
    """A statement names what is not there, or what does not fit."""


class ExecutionError(EngineError):
    """A plan failed while it ran."""


class ConfigError(EngineError):
    """A setting or a configuration file is wrong."""


class InvalidArgumentError(EngineError, ValueError):
    """A value that an operation does not take."""


class SourceError(EngineError):
    """A file or an in-memory table cannot be read or written."""


class StorageError(EngineError):
    """A stored table is missing or in the way."""


@contextmanager
def told_apart():
    """Gives Spark's errors the kind they have here."""
    from pyspark.errors import AnalysisException, IllegalArgumentException, ParseException, PySparkException

    try:
        yield
    except ParseException as e:
        raise ParseError(str(e)) from e
    except AnalysisException as e:
        name = e.getCondition() or ""
        if "PATH_NOT_FOUND" in name or "UNABLE_TO_INFER_SCHEMA" in name:
            raise SourceError(str(e)) from e
        if name.endswith("_ALREADY_EXISTS"):
            raise AlreadyExistsError(str(e)) from e
        if name.startswith(("TABLE_OR_VIEW_NOT_FOUND", "SCHEMA_NOT_FOUND")):
            raise NotFoundError(str(e)) from e
        raise PlanningError(str(e)) from e
    except IllegalArgumentException as e:
        raise InvalidArgumentError(str(e)) from e
    except PySparkException as e:
        raise ExecutionError(str(e)) from e

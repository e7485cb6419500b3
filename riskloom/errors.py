"""Errors of the engine."""

from __future__ import annotations

from collections.abc import Iterable


class RiskloomError(Exception):
    """Base of all own errors."""


class ValidationError(RiskloomError, ValueError):
    """A value that an operator cannot take."""


class InputTypeError(RiskloomError, TypeError):
    """An input of the wrong type."""


class ColumnNotFoundError(RiskloomError, KeyError):
    """A column that the table lacks."""


class NotFittedError(RiskloomError, RuntimeError):
    """A model used before it was fitted."""


def require_columns(df, columns: Iterable[str], what: str = "the table") -> None:
    """Raise unless ``df`` has all ``columns``."""
    missing = sorted({*columns} - {*df.columns})
    if missing:
        raise ColumnNotFoundError(f"{what} lacks {missing}; it has {df.columns}")


def require_rows(df, what: str = "the table") -> None:
    if df.isEmpty():
        raise ValidationError(f"{what} is empty")


def require_numeric(df, columns: Iterable[str]) -> None:
    """Raise unless all columns hold numbers."""
    require_columns(df, columns)
    kinds = dict(df.dtypes)
    wrong = [c for c in columns if not kinds[c].startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"))]
    if wrong:
        raise InputTypeError(f"not numeric: {wrong}")


def split_kinds(df, features: Iterable[str] | None = None) -> dict[str, list[str]]:
    """Names of numeric, text, date and other columns."""
    kinds, out = dict(df.dtypes), {"numeric": [], "text": [], "date": [], "other": []}
    for c in features if features is not None else df.columns:
        k = kinds[c]
        out["numeric" if k.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")) else "text" if k in ("string", "boolean") else "date" if k.startswith(("date", "timestamp")) else "other"].append(c)
    return out

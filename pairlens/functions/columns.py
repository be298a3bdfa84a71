"""Small Column combinators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``, which may use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text(value: str) -> Column:
    return F.lit(value)


def string_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def is_true(flag: Column) -> Column:
    """Null counts as false, as a filter on a nullable flag does."""
    return F.coalesce(flag, F.lit(False))


def present(parts: Iterable[Column], separator: str) -> Column:
    """Join the non-null parts."""
    return F.array_join(F.array_compact(F.array(*parts)), separator)


def ratio(part: Column, whole: Column, digits: int | None = None) -> Column:
    """``part / whole`` as double, 0.0 for an empty whole."""
    value = F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))
    return value if digits is None else F.round(value, digits)


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add costly columns so that each is computed once per row.

    A filter on a plain computed column is moved below the projection with a copy of its expression
    per use. A one-element explode is a step filters do not pass, at no shuffle.
    """
    added = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(added)).alias("_settled")).select(*kept, "_settled.*")

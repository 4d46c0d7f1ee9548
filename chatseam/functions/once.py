"""Evaluate costly expressions once per row."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(
    rows: DataFrame,
    columns: Mapping[str, Column],
    keep: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add columns, optionally keeping only the rows whose new values satisfy ``keep``.

    A filter over a projected column is pushed below the projection with the
    expression copied into it, so parsing or cleaning would run again for every
    mention. Filters stop at a generator; unpacking a one-element array of
    structs gives each row its new values, computed once, or drops the row.
    """
    value = F.array(F.struct(*[column.alias(name) for name, column in columns.items()]))
    if keep is not None:
        value = F.filter(value, keep)
    replaced = set(columns)
    return rows.select(*[name for name in rows.columns if name not in replaced], F.inline(value))

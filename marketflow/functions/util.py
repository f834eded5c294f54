"""Small helpers shared by the expression builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_valid_number(c) -> Column:
    """Not NULL and not NaN."""
    c = as_col(c)
    return c.isNotNull() & ~F.isnan(c)


def with_once(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with columns that are computed once a row.  The optimizer copies a
    projected expression into the filters over it; what a generator made (here of
    one row each) is read there."""
    made = F.inline(F.array(F.struct(*[c.alias(f"_once_{n}") for n, c in cols.items()])))
    return df.select("*", made).withColumns({n: F.col(f"_once_{n}") for n in cols}).drop(*[f"_once_{n}" for n in cols])

"""Price and commodity series sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trailing_prices(prices: DataFrame, symbols: DataFrame | None = None, key: str = "symbol",
                    ts: str = "ts", period: str | None = "1 year", as_of=None) -> DataFrame:
    """The last ``period`` of history for a set of symbols.

    ``symbols`` restricts by a ``left_semi`` join (no collect of the symbol
    list).  ``as_of`` defaults to the newest timestamp of the table, computed
    as a lazy scalar subquery, so the filter stays a plain comparison that
    reaches the scan.
    """
    df = prices
    if symbols is not None:
        df = df.join(symbols.select(key), key, "left_semi")
    if period is None:
        return df
    ref = F.lit(as_of).cast(prices.schema[ts].dataType) if as_of is not None else prices.select(F.max(ts)).scalar()
    return df.filter(F.col(ts) > ref - F.expr(f"INTERVAL {period}"))


COMMODITY_POINT = T.StructType([T.StructField("date", T.StringType()), T.StructField("value", T.StringType())])


def commodity_series(responses: DataFrame, body_col: str = "body", name_col: str | None = "commodity",
                     point_schema: T.StructType = COMMODITY_POINT) -> DataFrame:
    """A10: the ``data`` array of each API response body -> one row per point.

    Point values arrive as text; ``value`` is typed with ``try_cast`` and the
    date with ``try_to_date`` so a ``"."`` placeholder becomes NULL.
    """
    body = F.from_json(F.col(body_col), T.StructType([T.StructField("data", T.ArrayType(point_schema))]))
    keep = [F.col(name_col)] if name_col else []
    pts = responses.select(*keep, F.explode(body.getField("data")).alias("p"))
    return pts.select(*keep,
                      F.try_to_date(F.col("p.date")).alias("date"),
                      F.col("p.value").try_cast("double").alias("value"))

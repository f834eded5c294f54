"""Column expressions for returns, brackets, allocations and goal values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketflow.constants import ASSET_CLASSES, DEFAULT_ANNUAL_RETURN, RISK_BRACKETS
from marketflow.functions.util import as_col, is_valid_number


def risk_bracket(risk) -> Column:
    """Bracket id 1..8 of a risk-aversion value; NULL for NULL/NaN.

    Brackets are half open ``(lower, upper]``; the NaN guard comes first since
    NaN sorts above every number in Spark.
    """
    r = as_col(risk)
    expr = F.when(~is_valid_number(r), F.lit(None).cast("int"))
    for bid, _lo, hi, _ret, _w in RISK_BRACKETS:
        cond = (r <= F.lit(hi)) if hi is not None else F.lit(True)
        expr = expr.when(cond, F.lit(bid))
    return expr


def bracket_return(risk) -> Column:
    """Expected annual return of the risk bracket; 0.05 when none matches.

    The bracket id indexes a literal array, so the bracket CASE is evaluated
    once per row.
    """
    return bracket_lookup_return(risk_bracket(risk))


def bracket_lookup_return(bracket: Column) -> Column:
    """Return of a bracket id; 0.05 for NULL (the index is guarded: a NULL
    ``element_at`` index is not relied on)."""
    returns = F.array(*[F.lit(float(ret)) for _bid, _lo, _hi, ret, _w in RISK_BRACKETS])
    return F.when(bracket.isNull(), F.lit(DEFAULT_ANNUAL_RETURN)).otherwise(F.element_at(returns, bracket))


def _allocation_table() -> Column:
    rows = []
    for _bid, _lo, _hi, _ret, weights in RISK_BRACKETS:
        rows.append(F.array(*[F.struct(F.lit(a).alias("asset_class"), F.lit(float(w)).alias("weight"))
                              for a, w in zip(ASSET_CLASSES, weights)]))
    return F.array(*rows)


def allocation_array(risk) -> Column:
    """``array<struct<asset_class string, weight double>>`` of the bracket;
    NULL when no bracket.  A pure expression (no lookup join): the eight
    weight vectors are one literal array indexed by the bracket id."""
    return bracket_lookup_allocation(risk_bracket(risk))


def bracket_lookup_allocation(bracket: Column) -> Column:
    """Allocation array of a bracket id; NULL for a NULL id."""
    return F.when(bracket.isNotNull(), F.element_at(_allocation_table(), bracket))


def future_value(initial, monthly, annual_return, years) -> Column:
    """Future value of an initial amount plus monthly contributions.

    ``P(1+r)^n + C((1+r)^n - 1)/r`` with ``r = annual/12``, ``n = 12*years``;
    the zero-rate limit ``P + C*n`` replaces the division by zero.
    """
    p, c, a, t = (as_col(x) for x in (initial, monthly, annual_return, years))
    r = a / F.lit(12.0)
    n = t * F.lit(12.0)
    g = F.pow(F.lit(1.0) + r, n)
    return F.when(r == 0, p + c * n).otherwise(p * g + c * (g - F.lit(1.0)) / r)

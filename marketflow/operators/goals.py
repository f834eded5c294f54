"""Risk brackets, allocations and SMART-goal checks.

Each step is a column expression, so a goal table of any size is scored in
one projection: no per-row Python and no shuffle (except the transcript,
which groups turns by conversation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketflow.constants import CONFIRM_PHRASE, HISTORY_PREFIX  # noqa: F401 (re-exported)
from marketflow.functions.finance import (bracket_lookup_allocation, bracket_lookup_return, future_value,
                                          risk_bracket)
from marketflow.functions.text import contains_phrase
from marketflow.functions.util import as_col


def with_risk_bracket(df: DataFrame, risk: str = "risk_aversion") -> DataFrame:
    """F1: bracket id and expected annual return (0.05 when no bracket)."""
    out = df.withColumn("bracket", risk_bracket(risk))
    return out.withColumn("annual_return", bracket_lookup_return(F.col("bracket")))


def allocation_long(df: DataFrame, risk: str = "risk_aversion", keep=("investor_id",),
                    rescale: bool = False) -> DataFrame:
    """one row per (investor, asset class) with its weight.

    ``weight_sum`` exposes the brackets whose weights do not add up to 1;
    ``rescale=True`` divides by it.  Investors without a bracket get no rows.
    """
    b = df.select(*keep, risk_bracket(risk).alias("bracket"))
    arr = bracket_lookup_allocation(F.col("bracket"))
    total = F.aggregate(F.transform(arr, lambda x: x["weight"]), F.lit(0.0), lambda a, b: a + b)
    out = b.select(*keep, "bracket", total.alias("weight_sum"), F.inline(arr))
    if rescale:
        out = out.withColumn("weight", F.col("weight") / F.col("weight_sum"))
    return out


def to_monthly(contribution, period) -> Column:
    """F8: an annual contribution becomes monthly (divided by 12)."""
    c, p = as_col(contribution), as_col(period)
    return F.when(F.lower(p) == "annual", c / F.lit(12.0)).otherwise(c)


def smt_flags(df: DataFrame, goal: str = "goal", target: str = "target_value",
              monthly: str = "monthly_contribution", initial: str = "initial_investment",
              horizon: str = "time_horizon") -> DataFrame:
    """specific / measurable / time-bound flags as total booleans."""
    specific = F.coalesce(as_col(goal) != F.lit(""), F.lit(False))
    measurable = F.coalesce((as_col(target) > 0) & ((as_col(monthly) > 0) | (as_col(initial) > 0)), F.lit(False))
    timed = F.coalesce(as_col(horizon) > 0, F.lit(False))
    return df.withColumns({"is_specific": specific, "is_measurable": measurable, "is_time": timed})


def evaluate_goals(df: DataFrame, goal: str = "goal", initial: str = "initial_investment",
                   monthly: str = "monthly_contribution", annual_return: str = "annual_return",
                   target: str = "target_value", horizon: str = "time_horizon") -> DataFrame:
    """F3 -> F4 -> F5 -> F6 -> F7 for a table of goals.

    Adds the three flags, ``future_value``, ``is_achievable`` (unrounded FV >=
    target, only for SMART goals), ``outcome`` (smart / not_smart),
    ``failed_criterion`` and the tool line ``achievable_text``.
    """
    df = smt_flags(df, goal, target, monthly, initial, horizon)
    fv = future_value(initial, monthly, annual_return, horizon)
    smt = F.col("is_specific") & F.col("is_measurable") & F.col("is_time")
    df = df.withColumn("future_value", fv)
    df = df.withColumn("is_achievable", smt & F.coalesce(F.col("future_value") >= as_col(target), F.lit(False)))
    df = df.withColumn("outcome", F.when(F.col("is_achievable"), F.lit("smart")).otherwise(F.lit("not_smart")))
    df = df.withColumn("failed_criterion",
                       F.when(~F.col("is_specific"), F.lit("specific"))
                        .when(~F.col("is_measurable"), F.lit("measurable"))
                        .when(~F.col("is_time"), F.lit("time"))
                        .when(~F.col("is_achievable"), F.lit("achievable")))
    return df.withColumn("achievable_text", achievable_text("is_achievable", "future_value"))


def achievable_text(flag, fv) -> Column:
    """``"Achievable: True, Future Value: 10077.71"``."""
    b = F.when(as_col(flag), F.lit("True")).otherwise(F.lit("False"))
    return F.format_string("Achievable: %s, Future Value: %.2f", b, F.coalesce(as_col(fv), F.lit(0.0)))


def goal_summary(goal: str = "goal", initial: str = "initial_investment", monthly: str = "monthly_contribution",
                 annual_return: str = "annual_return", target: str = "target_value",
                 horizon: str = "time_horizon") -> Column:
    """labelled summary line of the extracted goal fields and flags."""
    def tf(c):
        return F.when(F.col(c), F.lit("True")).otherwise(F.lit("False"))
    return F.format_string(
        "goal: %s | initial_investment: %.2f | monthly_contribution: %.2f | annual_return: %.4f | "
        "target_value: %.2f | time_horizon: %d | is_specific: %s | is_measurable: %s | is_time: %s",
        F.col(goal), F.col(initial), F.col(monthly), F.col(annual_return), F.col(target), F.col(horizon),
        tf("is_specific"), tf("is_measurable"), tf("is_time"))


def transcript(turns: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text",
               role: str | None = "role", answer_role: str = "assistant",
               prefix: str = HISTORY_PREFIX, turns_per_part: int = 1000) -> DataFrame:
    """the starting text followed by the answers of each conversation in
    turn order.

    Two levels, so no group sorts more than ``turns_per_part`` turns: the
    answers are first joined per (conversation, part) by ``transcript_parts``
    (spread over tasks however long a conversation is), then the part texts
    are concatenated in part order.  The one row per conversation holds its
    whole history, the operator's result.
    """
    parts = transcript_parts(turns, key, order, text, role, answer_role, turns_per_part)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("part").alias("p"), F.col("text").alias("t"))))
    return parts.groupBy(key).agg(
        F.concat(F.lit(prefix), F.array_join(F.transform(ordered, lambda x: x["t"]), "")).alias("history"),
        F.sum("n_answers").alias("n_answers"))


def transcript_parts(turns: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text",
                     role: str | None = "role", answer_role: str = "assistant",
                     turns_per_part: int = 1000) -> DataFrame:
    """F9 with bounded groups: the answers of each conversation as ordered parts.

    Turns are grouped by ``floor(turn / turns_per_part)``, so no group holds
    more than ``turns_per_part`` turns however long a conversation is.  The
    history is the starting text followed by the conversation's ``text``
    parts in ``part`` order, the same string ``transcript`` builds in one row.
    """
    df = turns
    if role is not None:
        df = df.filter(F.col(role) == answer_role)
    part = F.floor(F.col(order) / F.lit(int(turns_per_part))).cast("long")
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(key, part.alias("part")).agg(
        F.array_join(F.transform(items, lambda x: x["t"]), "").alias("text"),
        F.count(F.lit(1)).alias("n_answers"))


def needs_confirmation(df: DataFrame, text: str = "text", phrase: str = CONFIRM_PHRASE) -> DataFrame:
    """an answer asks to confirm preferences (any case)."""
    return df.withColumn("needs_confirmation", F.coalesce(contains_phrase(text, phrase), F.lit(False)))

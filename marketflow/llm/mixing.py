"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a token budget.  While the budget holds all of a source, whole
epochs are taken; the rest is a weighted sample without replacement: a document
of quality weight w draws the key ``-ln(u) / w`` (u from a hash of its id and
text, so reruns agree), documents are sorted by key within their source, and
sizes are prefix-summed until the budget is met.

A source may hold a third of all rows, so its documents are never sorted in one
task.  Keys fall into cells; the prefix sum over cells finds the one cell in
which the budget ends, that cell is cut into finer ones, and only the documents
of the last cell (some millionths of a source) are sorted.  Every other
document is decided by comparing its cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketflow.llm.common import RID, ROW, stored_rows, white_word_count
from marketflow.session import materialize

MAX_EPOCHS = 3
CELLS = 4096
BROADCAST_SOURCES = 50_000


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, sk, source_size)`` -> the same with ``target``.

    Sources in code point order (null last) weigh 1, 2, 3, repeating, and share
    the total.  A target stops at ``max_epochs`` times its source's size and
    the excess goes to the others by weight: with sources sorted by cap per
    weight, the first one whose share fits its cap fixes the common level.
    One row per source, so the windows below see a small table.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", 1 + F.pmod(F.row_number().over(by_name) - 1, F.lit(3)))
    w = w.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    rank = Window.orderBy("ratio", "sk")
    everything = Window.partitionBy(F.lit(1))
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything)
    level = ((total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    w = w.withColumn("level", level).withColumn("place", F.row_number().over(rank))
    fits = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(everything)
    return w.select("source", "sk", "source_size", F.coalesce(F.least(F.col("cap"), fits["level"] * F.col("weight")),
                                                              F.col("cap")).alias("target"))


def quality_weight(text: Column, size: Column) -> Column:
    """1 for a text without symbols, falling to 0.05 with their share of its words."""
    t = F.coalesce(text, F.lit(""))
    symbols = F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))
    return F.greatest(F.lit(0.05), 1.0 - symbols / F.greatest(size, F.lit(1)))


def _crossing(cells: DataFrame, cell: str, rest: str) -> DataFrame:
    """Per source the cell in which the running sum passes ``rest``, and the sum before it."""
    run = F.sum("s").over(Window.partitionBy("sk").orderBy(cell))
    return (cells.withColumn("after", run).withColumn("before", F.col("after") - F.col("s"))
            .filter((F.col("before") <= F.col(rest)) & (F.col(rest) < F.col("after"))))


def mix_sources(docs: DataFrame, carry: list[str] | None = None, weight: Column | None = None,
                max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per input row: ``__row`` (the ``carry`` columns, all by default),
    ``size`` (words), ``source_size``, ``target``, ``copies`` (how often the
    mix takes the document), ``taken`` (words taken).

    ``weight`` is the quality weight of a document (positive; default
    ``quality_weight``).  The document at which a budget ends is taken if that
    comes nearer to the target.  Null texts have size 0; null sources form one
    source; repeated rows are separate documents; an empty table stays empty.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)])
    w = quality_weight(F.col("text"), F.col("__size")) if weight is None else weight
    h = F.xxhash64(F.col("doc_id"), F.col("text"))
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    sized = docs.select(kept.alias(ROW), "doc_id", "text", "source", white_word_count(F.col("text")).alias("__size"))
    rows = stored_rows(sized.select(
        ROW, F.col("source"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("sk"),
        F.col("__size").alias("size"), (-F.log(u) / w).alias("__e"), F.xxhash64(h).alias("tie"))
        .withColumn("t", F.col("__e") / (1.0 + F.col("__e"))).drop("__e"), "mix-rows")
    rows = (rows.withColumn("c1", F.floor(F.col("t") * CELLS).cast("int"))
            .withColumn("c2", F.floor((F.col("t") * CELLS - F.col("c1")) * CELLS).cast("int")))

    totals = rows.groupBy("sk").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    plan = source_targets(totals, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = materialize(plan.withColumn("epochs", epochs.cast("int"))
                       .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-plan")

    def near(df):      # one row per source; broadcast behind a check of its number
        return F.broadcast(df) if few else df
    few = plan.count() <= BROADCAST_SOURCES
    cells = rows.groupBy("sk", "c1").agg(F.sum("size").alias("s")).join(near(plan.select("sk", "rest")), "sk")
    first = materialize(_crossing(cells, "c1", "rest").select(
        "sk", "c1", (F.col("rest") - F.col("before")).alias("rest1")), "mix-cells")
    cells = (rows.join(near(first), ["sk", "c1"]).groupBy("sk", "c1", "c2", "rest1").agg(F.sum("size").alias("s")))
    second = materialize(_crossing(cells, "c2", "rest1").select(
        "sk", "c1", "c2", (F.col("rest1") - F.col("before")).alias("rest2")), "mix-cells")
    order = Window.partitionBy("sk").orderBy("t", "tie", RID)
    last = (rows.select("sk", "c1", "c2", "t", "tie", RID, "size").join(near(second), ["sk", "c1", "c2"])
            .withColumn("after", F.sum("size").over(order)))
    taken = (F.col("after") <= F.col("rest2")) | (2 * (F.col("rest2") - F.col("after")) >= -F.col("size"))
    cut = last.filter(taken).groupBy("sk").agg(F.max(F.struct("t", "tie", RID)).alias("cut"))
    decided = materialize(plan.join(second.select("sk", F.col("c1").alias("k1"), F.col("c2").alias("k2")), "sk", "left")
                          .join(cut, "sk", "left"), "mix-decided")

    both = rows.join(near(decided.drop("source")), "sk")
    same = (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2"))
    chosen = F.coalesce((F.struct("c1", "c2") < F.struct("k1", "k2"))
                        | (same & (F.struct("t", "tie", RID) <= F.col("cut"))), F.lit(False))
    copies = F.col("epochs") + chosen.cast("int")
    return both.select(ROW, RID, "size", "source_size", "target", copies.alias("copies"),
                       (copies * F.col("size")).cast("long").alias("taken"))

"""The corpus pipeline: quality rules, SimHash near-dedup, benchmark
decontamination, mixing to target weights, sharding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and works on all its predecessor kept.  ``run`` writes each stage's result as
Parquet below spark.checkpoint.dir and reads it again as the next one's docs.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

import functools
import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from marketflow.llm.common import ROW, unpacked, without_rids  # noqa: E402
from marketflow.llm.decontam import find_spans  # noqa: E402
from marketflow.llm.mixing import mix_sources  # noqa: E402
from marketflow.llm.quality import quality_rules  # noqa: E402
from marketflow.llm.shards import histogram_shards  # noqa: E402
from marketflow.llm.simhash import drop_near_duplicates  # noqa: E402
from marketflow.session import SCRATCH, drop_scratch, materialize  # noqa: E402

_made: list[str] = []          # scratch tables of the stage before


def _stage(fn):
    """A stage that first drops the scratch tables of the stage before it, whose
    result has been written by then (written, not only cached).  If ``docs``
    still reads them (stages composed without writing), they stay."""
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = "\n".join(docs.inputFiles()) if _made else ""
        if not any(path.rsplit("/", 1)[-1] in read for path in _made):
            drop_scratch(spark, _made)
        _made.clear()
        before = len(SCRATCH)
        out = fn(spark, docs, sf_dir)
        _made.extend(SCRATCH[before:])
        return out
    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the likelihood ratio."""
    got = quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # the row number keeps the filter above the scores: pushed below them, it would score every document again
    return unpacked(got.withColumn("__at", F.monotonically_increasing_id()).filter("kept AND __at >= 0"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return drop_near_duplicates(docs)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    rows, found = find_spans(docs, benchmark)
    return unpacked(without_rids(rows, found, "contaminated-rows"))


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    got = mix_sources(docs).filter("copies > 0")
    return unpacked(got.select(ROW, F.explode(F.array_repeat(F.lit(1), F.col("copies")))))


@_stage
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``shard`` (0 to 7, near equal bytes) and ``slot``."""
    got = histogram_shards(docs, F.octet_length(F.coalesce("text", F.lit(""))) + 1, 8)
    return unpacked(got, shard=F.col("shard"), slot=F.col("slot"))


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("benchmark_decontamination", decontaminate),
          ("mix_to_weights", mix), ("histogram_shards", shard)]

#: The hashes of the first two stages have no SQL counterpart; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", partitions=None)
    return docs

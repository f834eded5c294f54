"""C2 and D16 in one pass; asset classes of messages."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketflow.operators import quality as C
from marketflow.operators import silver
from marketflow.operators import split as S

RECORD = T.StructType([T.StructField("k", T.LongType()), T.StructField("s", T.StringType())])


def test_payload_keys_are_split_and_counted_in_one_job(spark, scratch):
    rows = [(1, '{"a":1,"b":2}'), (2, '{"a":1}'), (3, '{"a":1,"b":2,"c":3}'), (4, None), (5, "no json"), (6, '{"b":1,"a":2}'), (6, '{"b":1,"a":2}')]
    got = S.split_payload_keys(spark.createDataFrame(rows, "id int, payload string"), f"{scratch}/c2", expected=("a", "b"))
    assert got.counts == {"accepted": 3, "rejected": 4, "extra": 1, "missing a": 2, "missing b": 3}
    assert sorted(r.id for r in got.rows("accepted").collect()) == [1, 6, 6]
    assert sorted((r.id, r.missing, r.extra) for r in got.rows("rejected").collect()) == [(2, "b", ""), (3, "", "c"), (4, "a,b", ""), (5, "a,b", "")]
    accepted, rejected = C.split_keys(spark.createDataFrame(rows, "id int, payload string"), expected=("a", "b"))
    assert (accepted.count(), rejected.count()) == (got.counts["accepted"], got.counts["rejected"])


def test_a_verdict_reads_its_own_folder(spark, scratch):
    df = spark.range(100).withColumn("payload", F.when(F.col("id") % 3 == 0, '{"a":1}').otherwise("{}"))
    got = S.split_payload_keys(df, f"{scratch}/c2", expected=("a",))
    plan = got.rows("accepted")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "verdict" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert got.rows("accepted").count() == 34


def test_messages_are_parsed_once_and_sorted_by_verdict(spark, scratch):
    rows = [("t", '[{"k":1,"s":"x"},{"k":"bad","s":"y"},{"k":2}]'), ("t", '{"k":1}'), ("t", "nothing"), ("t", None), ("t", "[]"), ("t", "[3]"),
            ("u", '[{"k":9}]'), (None, '[{"k":8}]')]
    bronze = spark.createDataFrame(rows, "message_type string, data string")
    got = S.split_bronze(bronze, f"{scratch}/d16", "t", RECORD)
    assert got.counts == {"accepted": 2, "record": 2, "message": 3, "failed k": 1, "failed s": 0}
    assert sorted((r.k, r.s) for r in got.rows("accepted").collect()) == [(1, "x"), (2, None)]
    assert sorted((r._record, r._failed) for r in got.rows("record").collect()) == [("3", "*"), ('{"k":"bad","s":"y"}', "k")]
    assert sorted((r._record or "") for r in got.rows("message").collect()) == ["", "nothing", '{"k":1}']
    every = S.split_bronze(bronze, f"{scratch}/all", None, RECORD)
    assert every.counts["accepted"] == silver.unnest_bronze(bronze, None, RECORD).count() == 4
    assert every.counts["record"] == silver.record_rejects(bronze, None, RECORD).count()
    assert every.counts["message"] == silver.bronze_rejects(bronze, RECORD).count()


def test_one_scan_feeds_both_sides(spark, scratch):
    spark.createDataFrame([("t", '[{"k":1}]')], "message_type string, data string").write.parquet(f"{scratch}/in")
    judged = silver.bronze_verdicts(spark.read.parquet(f"{scratch}/in"), None, RECORD)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("parse_json") <= 2 and "Exchange" not in plan


def test_empty_tables_are_split_into_nothing(spark, scratch):
    got = S.split_payload_keys(spark.createDataFrame([], "id int, payload string"), f"{scratch}/c2", expected=("a",))
    assert got.counts == {"accepted": 0, "rejected": 0, "extra": 0, "missing a": 0}
    assert got.rows("accepted", "rejected").collect() == []
    spark.createDataFrame([], "message_type string, data string").write.parquet(f"{scratch}/none")
    got = S.split_bronze(spark.read.parquet(f"{scratch}/none"), f"{scratch}/d16", None, RECORD)
    assert set(got.counts.values()) == {0} and got.table.count() == 0


def test_asset_classes(spark):
    df = spark.createDataFrame([("usa",), ("south_korea",), ("Bond_Funds",), ("bonds",), ("commodity",), ("Usa",), (None,)], "message_type string")
    got = sorted(map(tuple, C.with_asset_class(df).collect()), key=str)
    assert got == [("Bond_Funds", "fund"), ("Usa", None), ("bonds", "bond"), ("commodity", "commodity"), ("south_korea", "stock"), ("usa", "stock"), (None, None)]

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketflow.operators import quality as C
from marketflow.operators import silver
from marketflow.sources import envelope as A


def test_decode_envelope_cases(spark):
    vals = ['{"type": "bonds", "data": "[{\\"a\\": 1}]"}', '{"type": "x", "data": [1, 2]}', "garbage",
            '{"data": "[]"}', '{"type": "bonds", "data": "{\\"error in bonds_scraper\\": \\"boom\\"}"}']
    df = spark.createDataFrame([(v,) for v in vals], "value string")
    out = A.decode_envelope(df).collect()
    assert (out[0].message_type, out[0].data) == ("bonds", '[{"a": 1}]')
    assert out[1].data == "[1,2]"              # a real array comes back as its JSON text
    assert (out[2].message_type, out[2].data) == (None, None)
    assert out[3].message_type is None and out[3].data == "[]"


def test_publish_feed_spreads_identical_records(spark):
    recs = spark.range(3000).select(F.lit("hot").alias("feed"), F.lit(7).alias("id"),
                                    F.lit("x" * 40).alias("pad"))
    limit = 4096
    packed = A.publish_feed(recs, "feed", ["id", "pad"], max_bytes=limit).collect()
    assert sum(r.n_records for r in packed) == 3000
    assert all(r.fits for r in packed) and len(packed) > 20


def test_publish_feed_bounds_and_round_trip(spark):
    recs = spark.range(0, 3000).select(
        F.when(F.col("id") < 2000, F.lit("hot")).otherwise(F.lit("cold")).alias("feed"),
        F.col("id"), F.repeat(F.lit("x"), 40).alias("pad"))
    limit = 16 * 1024
    packed = A.publish_feed(recs, "feed", ["id", "pad"], max_bytes=limit)
    stats = packed.agg(F.bool_and("fits").alias("ok"), F.max(F.octet_length("value")).alias("mx"),
                       F.sum("n_records").alias("n")).collect()[0]
    assert stats.ok and stats.mx <= limit and stats.n == 3000
    assert packed.filter("message_type = 'hot'").count() > 1
    back = silver.unnest_bronze(A.decode_envelope(packed), None,
                                T.StructType([T.StructField("id", T.LongType()), T.StructField("pad", T.StringType())]))
    assert sorted(r.id for r in back.collect()) == list(range(3000))


def test_conform_reports_failed_fields(spark):
    df = spark.createDataFrame([("A", "Acme", "1.5", "x", "10")], "symbol string, name string, real_time_price string, "
                                                                  "change string, volume string")
    out = C.conform(df, "stock").collect()[0]
    assert out.real_time_price == 1.5 and out.volume == 10 and not out.is_valid
    assert out.failed_fields.split(",") == ["change", "percent_change", "avg_vol_3months", "market_cap",
                                            "pe_ratio", "country", "sector"]


def test_check_keys(spark):
    ok = json.dumps({c: 1 for c in ["age", "education", "occupation", "kids", "income", "net_worth", "risk",
                                    "married"]})
    bad = json.dumps({"age": 1, "zeta": 2, "alpha": 3})
    df = spark.createDataFrame([(ok,), (bad,), ("not json",)], "payload string")
    out = C.check_keys(df).collect()
    assert out[0].accepted and not out[1].accepted
    assert out[1].extra == "alpha,zeta"
    assert out[1].missing == "education,income,kids,married,net_worth,occupation,risk"
    assert out[2].missing.count(",") == 7


def test_check_member_folding(spark):
    df = spark.createDataFrame([("brent",), ("WTI",), ("gold",), (None,)], "c string")
    ok, bad = C.check_member(spark, df, "c", ["WTI", "BRENT"], fold="upper")
    assert sorted(r.c for r in ok.collect()) == ["WTI", "brent"]
    assert bad.count() == 2
    allowed = spark.createDataFrame([("france",), ("usa",)], "value string")
    ok2, _ = C.check_member(spark, spark.createDataFrame([("France",), ("Peru",)], "c string"), "c", allowed,
                            fold="lower")
    assert [r.c for r in ok2.collect()] == ["France"]
    flags = [r.accepted for r in C.member_flag(df, "c", ["WTI", "BRENT"], fold="upper").collect()]
    assert flags == [True, True, False, False]


def test_keep_new_passes_changed_and_unseen(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (3, "c"), (3, "c")], "k long, v string")
    assert sorted(map(tuple, C.keep_new(new, old, ["k"]).collect())) == [(2, "B"), (3, "c")]


def test_gold_filters(spark):
    df = spark.createDataFrame([("A", "n", 0.1, 1.0, 1.0, 1.0, 1.0), ("B", "n", 0.1, 1.0, None, 1.0, 1.0),
                                ("C", "n", -0.1, 1.0, 1.0, 1.0, float("nan"))],
                               "symbol string, name string, adjusted_expense_ratio double, asset_under_management "
                               "double, total_return_pct double, std_dev double, sharpe_ratio double")
    assert [r.symbol for r in C.gold(df).collect()] == ["A"]


def test_scalar_stats_plan_has_no_cartesian(spark):
    from marketflow.operators import features as E
    df = spark.createDataFrame([(float(i), i % 3) for i in range(10)], "age double, risk int")
    plan = E.scale(df, E.fit_scaler(df, ["age", "risk"]), ["age", "risk"])._jdf.queryExecution() \
            .executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_write_messages_files(spark, scratch):
    recs = spark.range(0, 50).select(F.lit("feed").alias("t"), F.col("id"))
    packed = A.publish_feed(recs, "t", ["id"], max_bytes=400)
    A.write_messages(packed, fmt="text", path=scratch + "/out", max_bytes=400)
    back = A.decode_envelope(spark.read.text(scratch + "/out"))
    assert back.filter("message_type = 'feed'").count() == packed.count()


def test_oversized_records_are_returned_and_a_rerun_makes_the_same_envelopes(spark, scratch):
    recs = spark.range(0, 500).select(F.lit("feed").alias("t"), (F.col("id") % 100).alias("id"),
                                      F.when(F.col("id") == 7, F.repeat(F.lit('"'), 3000)).otherwise(F.lit('"q"')).alias("pad"))
    packed = A.publish_feed(recs, "t", ["id", "pad"], max_bytes=2000)
    again = A.publish_feed(recs.repartition(7), "t", ["id", "pad"], max_bytes=2000)
    key = lambda df: sorted((r.message_type, r.chunk, r.value) for r in df.collect())
    assert key(packed) == key(again)
    rest = A.write_messages(packed, fmt="text", path=scratch + "/out", max_bytes=2000)
    assert rest.count() == packed.filter("NOT fits").count() >= 1
    sent = silver.unnest_bronze(A.decode_envelope(spark.read.text(scratch + "/out")), None,
                                T.StructType([T.StructField("id", T.LongType()), T.StructField("pad", T.StringType())]))
    held = silver.unnest_bronze(A.decode_envelope(rest), None, T.StructType([T.StructField("id", T.LongType())]))
    assert sent.count() + held.count() == 500
    assert packed.filter("fits").agg(F.max(F.octet_length("value"))).first()[0] <= 2000

import math
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marketflow.operators import silver
from marketflow.plans.jobs import process_funds


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_percent_and_amount_parsing(spark):
    df = spark.createDataFrame(
        [("0.45%", "500 Mil"), ("—", "12.5 Mil"), ("", "1,234 Mil"), ("1.2%", "3.2 Bil"), (None, "abc")],
        "e string, a string")
    out = df.select(silver.scale_amount("a").alias("a"), silver.scale_amount("a", compat=True).alias("c"),
                    silver.percent_to_number("e").alias("p"))
    got = {r["a"] for r in out.collect()}
    assert 500e6 in got and 12.5e6 in got and 1.234e9 in got and 3.2e9 in got and None in got
    compat = sorted((r["c"] for r in out.collect() if r["c"] is not None))
    # the original replacement scales only whole numbers
    assert compat == sorted([500000000.0, 12.5])
    ps = sorted((r["p"] for r in out.collect() if r["p"] is not None))
    assert ps == [0.45, 1.2]


def test_require_drops_nan_and_null(spark):
    df = spark.createDataFrame([("a", 1.0, "1 Mil"), ("b", float("nan"), "1 Mil"), (None, 1.0, "1 Mil"),
                                ("c", 1.0, None)],
                               "symbol string, adjusted_expense_ratio double, asset_under_management string")
    assert [r.symbol for r in silver.require(df).collect()] == ["a"]


def test_clean_funds_dedupes_and_keeps_bad_amount_null(spark):
    raw = spark.createDataFrame(
        [("A", "n", "c", "t", "0.5%", "10 Mil"), ("A", "n", "c", "t", "0.5%", "10 Mil"),
         ("B", "n", "c", "t", "—", "10 Mil"), ("C", "n", "c", "t", "1%", "lots")],
        "symbol string, name string, category string, fund_type string, adjusted_expense_ratio string, "
        "asset_under_management string")
    out = silver.clean_funds(raw)
    assert out.columns == silver.FUND_COLUMNS
    assert rows(out, "symbol", "asset_under_management") == [("A", 10e6), ("C", None)]


def _prices(spark, data):
    base = datetime(2024, 1, 1)
    return spark.createDataFrame([(s, base + timedelta(days=d), p) for s, d, p in data],
                                 "symbol string, ts timestamp, adj_close double")


def test_metrics_edge_cases(spark):
    data = [("one", 0, 10.0),                      # one price: sd, sharpe NULL
            ("flat", 0, 5.0), ("flat", 1, 5.0), ("flat", 2, 5.0),   # sd 0: sharpe NULL
            ("zero", 0, 0.0), ("zero", 1, 2.0), ("zero", 2, 3.0),   # first 0: total return NULL
            ("up", 0, 100.0), ("up", 1, 110.0), ("up", 40, 121.0)]
    m = {r.symbol: r for r in silver.symbol_metrics(_prices(spark, data)).collect()}
    assert m["one"].std_dev is None and m["one"].sharpe_ratio is None
    assert m["flat"].std_dev == 0 and m["flat"].sharpe_ratio is None
    assert m["zero"].total_return_pct is None
    assert math.isclose(m["up"].total_return_pct, 21.0)
    assert math.isclose(m["up"].mean_return, 0.1) and math.isclose(m["up"].std_dev, 0.0, abs_tol=1e-12)


def test_bucketed_lag_equals_plain_lag(spark):
    import random
    rnd = random.Random(3)
    data = [("hot", d, rnd.uniform(1, 100)) for d in range(400)]
    data += [(f"s{i}", d, rnd.uniform(1, 100)) for i in range(20) for d in rnd.sample(range(300), 7)]
    p = _prices(spark, data)
    cols = ["symbol", "ts", "adj_close", "prev_price", "daily_return"]
    a = silver.daily_returns(p, bucket_seconds=None).select(*cols).collect()
    for b in (86400, 7 * 86400, 90 * 86400, "auto"):
        got = silver.daily_returns(p, bucket_seconds=b, hot_rows=50, rows_per_bucket=30).select(*cols).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, a))


def _close(rows):
    return sorted(([round(v, 9) if isinstance(v, float) else v for v in r] for r in rows), key=str)


def test_metrics_are_the_same_for_any_piece(spark):
    """Against the returns of the whole series, also for NULL keys, times and prices."""
    import random
    import statistics
    rnd = random.Random(3)
    data = [("hot", d, rnd.uniform(1, 100)) for d in range(400)] + [(f"s{i}", d, rnd.uniform(1, 100)) for i in range(20) for d in rnd.sample(range(300), 7)]
    p = _prices(spark, data)
    got = [silver.symbol_metrics(p, piece=w).collect() for w in (86_400.0, 7 * 86_400.0, 30 * 86_400.0, 1e12)]
    assert all(_close(g) == _close(got[0]) for g in got)
    by = {}
    for s, d, v in sorted(data):
        by.setdefault(s, []).append(v)
    for r in got[0]:
        series = by[r.symbol]
        ret = [b / a - 1 for a, b in zip(series, series[1:])]
        assert (r.first_price, r.last_price, r.n_returns) == (series[0], series[-1], len(ret))
        assert math.isclose(r.mean_return, statistics.fmean(ret)) and math.isclose(r.std_dev, statistics.stdev(ret))
    odd = _odd_prices(spark)
    forms = [silver.symbol_metrics(odd, tiebreak=("n",), piece=w).collect() for w in (1, 4, 17, 1e9)]
    assert len(forms[0]) == 5 and all(_close(f) == _close(forms[0]) for f in forms)
    whole = silver.daily_returns(odd, tiebreak=("n",), bucket_seconds=None).groupBy("symbol").agg(
        F.count("daily_return"), F.avg("daily_return"), F.when(F.count("daily_return") > 1, F.stddev_samp("daily_return")))
    assert _close((r.symbol, r.n_returns, r.mean_return, r.std_dev) for r in forms[0]) == _close(map(tuple, whole.collect()))
    assert silver.symbol_metrics(p.limit(0)).count() == 0


def test_metrics_plan_reads_once_and_counts_nothing(spark, scratch):
    _prices(spark, [("a", 0, 1.0), ("a", 1, 2.0)]).write.parquet(f"{scratch}/p")
    plan = silver.symbol_metrics(spark.read.parquet(f"{scratch}/p"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("FileScan") == 1
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_enrich_symbol_without_prices(spark):
    raw = spark.createDataFrame([("A", "n", "c", "t", "0.5%", "1 Mil"), ("Z", "n", "c", "t", "0.5%", "1 Mil")],
                                "symbol string, name string, category string, fund_type string, "
                                "adjusted_expense_ratio string, asset_under_management string")
    p = _prices(spark, [("A", 0, 1.0), ("A", 1, 2.0), ("A", 2, 3.0), ("Q", 0, 1.0)])
    out = {r.symbol: r for r in process_funds(raw, p, period=None).collect()}
    assert set(out) == {"A", "Z"}
    assert out["Z"].total_return_pct is None and math.isclose(out["A"].total_return_pct, 200.0)
    ref = process_funds(raw, p, period=None, reference_names=True)
    assert "Sharpe Ratio" in ref.columns


def test_unnest_bronze_quarantines_error_objects(spark):
    from pyspark.sql import types as T
    b = spark.createDataFrame([("bonds", '[{"k": 1}, {"k": 2}]'), ("bonds", '{"error in bonds_scraper": "x"}'),
                               ("bonds", None), ("other", '[{"k": 3}]')], "message_type string, data string")
    sch = T.StructType([T.StructField("k", T.LongType())])
    assert sorted(r.k for r in silver.unnest_bronze(b, "bonds", sch).collect()) == [1, 2]
    assert silver.bronze_rejects(b, sch).count() == 2


def test_record_rejects_keep_unparsed_fields_apart(spark):
    from pyspark.sql import types as T
    b = spark.createDataFrame([("t", '[{"k":"abc"},{"k":2},{"k":null},{},5,null]')], "message_type string, data string")
    sch = T.StructType([T.StructField("k", T.LongType())])
    assert sorted((r.k is None, r.k) for r in silver.unnest_bronze(b, "t", sch).collect()) == [(False, 2), (True, None), (True, None)]
    got = sorted((r.record or "", r.failed_fields) for r in silver.record_rejects(b, "t", sch).collect())
    assert got == [("", "*"), ("5", "*"), ('{"k":"abc"}', "k")]


def test_hot_keys_found_beforehand(spark):
    from marketflow.operators.series import hot_keys
    data = [("hot", d, float(d % 13 + 1)) for d in range(300)] + [("c", d, 1.0 + d) for d in range(5)]
    p = _prices(spark, data)
    hot = hot_keys(p, "symbol", hot_rows=100)
    assert [r.symbol for r in hot.collect()] == ["hot"]
    a = sorted(map(str, silver.daily_returns(p, bucket_seconds=None).collect()))
    b = sorted(map(str, silver.daily_returns(p, bucket_seconds=hot, rows_per_bucket=40).select("symbol", "ts", "adj_close", "prev_price", "daily_return").collect()))
    assert a == b
    assert hot_keys(p, "symbol", hot_rows=1000) is None


def test_hot_key_buckets_are_bounded(spark):
    """One symbol holds a third of all rows, most of them in one second: no
    (symbol, bucket) group is much larger than ``rows_per_bucket``, and the
    other symbols keep a single bucket."""
    from marketflow.operators.series import hot_keys, split_hot
    data = [("hot", d, 0, 1.0) for d in range(300)] + [("hot", 100, i, 1.0) for i in range(1, 3000)]
    data += [(f"s{i}", d, 0, 1.0) for i in range(200) for d in range(30)]
    p = spark.createDataFrame(data, "symbol string, ts long, n long, adj_close double")
    cut = split_hot(p, "symbol", ["ts", "n"], hot_keys(p, "symbol", 1000), rows_per_bucket=200)
    sizes = cut.groupBy("symbol", "_bucket").count()
    hot = sizes.filter("symbol = 'hot'").agg(F.max("count").alias("mx"), F.count("*").alias("n")).collect()[0]
    assert hot.mx <= 2 * 200 and hot.n >= 3300 // 400
    assert sizes.filter("symbol != 'hot'").groupBy("symbol").count().filter("count > 1").count() == 0


def _odd_prices(spark):
    """NULL symbols, NULL times, NULL prices, ties and one dense second."""
    rows = [("a", None if i % 9 == 0 else i // 3, i, None if i % 7 == 0 else float(i % 11 + 1)) for i in range(60)]
    rows += [(None, None if i % 5 == 0 else i, i, float(i + 1)) for i in range(40)]
    rows += [("burst", 5, i, float(i % 13 + 1)) for i in range(80)] + [("b", 1, 1, 2.0), ("n", None, 1, None)]
    return spark.createDataFrame(rows, "symbol string, ts long, n long, adj_close double")


def test_split_and_plain_plans_agree_on_odd_rows(spark):
    p = _odd_prices(spark)
    key = lambda rs: sorted((tuple(r) for r in rs), key=str)
    forms = [{"bucket_seconds": None}, {"hot_rows": 1, "rows_per_bucket": 7}, {"hot_rows": 50, "rows_per_bucket": 9},
             {"bucket_seconds": 4}]
    for fill in (False, True):
        got = [key(silver.daily_returns(p, tiebreak=("n",), fill=fill, **f).collect()) for f in forms]
        assert len(got[0]) == p.count() and all(g == got[0] for g in got)


def test_split_session_state_and_pages_agree_on_odd_rows(spark):
    from marketflow.operators import sessions as S
    from marketflow.operators.pages import until_empty_page
    names = [S.INITIALIZE, S.GOAL_TEXT, S.GOAL_ACHIEVABLE, S.PREFERENCES, S.RESET, "smalltalk", None]
    rows = [(None if i % 4 == 0 else i % 3, None if i % 10 == 0 else i // 5, i, names[i * 5 % 7]) for i in range(150)]
    ev = spark.createDataFrame(rows, "conv_id long, ts long, event_id long, intent string")
    key = lambda rs: sorted((tuple(r) for r in rs), key=str)
    plain = key(S.session_state(ev, order=("ts", "event_id"), bucket_seconds=None).collect())
    assert len(plain) == 150
    assert key(S.session_state(ev, order=("ts", "event_id"), hot_rows=1, rows_per_bucket=6).collect()) == plain
    assert key(S.session_state(ev, order=("ts", "event_id"), bucket_seconds=3).collect()) == plain
    pages = spark.createDataFrame([(None if i % 5 == 0 else f"f{i % 2}", i, i > 60 and i % 13 == 0) for i in range(120)],
                                  "feed string, page long, is_empty boolean")
    plain = key(until_empty_page(pages, cap=30, bucket_seconds=None).collect())
    assert any(r[0] is None for r in plain)
    assert key(until_empty_page(pages, cap=30, hot_rows=1, rows_per_bucket=8).collect()) == plain


def test_record_fields_by_their_json_kind(spark):
    """One parse per payload; a text is no number, 1.5 is no whole number, any scalar is a text."""
    from pyspark.sql import types as T
    data = '[{"k":"12"}, {"k":1.5}, {"k":12, "s":5, "d":1, "b":true}, {"k":null,"s":"x","d":"1","t":"2024-01-02"},{"o":{"a":1},"s":{"a" : 1}}, [1], "x", {}]'
    b = spark.createDataFrame([("t", data), ("t", '[{"k":1},'), ("t", '{"k":1}'), ("t", None), ("u", " [{\"k\": 7}]"), ("t", '[{"k":1,"k":2}]')], "message_type string, data string")
    sch = T.StructType().add("k", T.LongType()).add("s", T.StringType()).add("d", T.DoubleType()).add("b", T.BooleanType()).add("t", T.DateType())
    got = silver.bronze_records(b, "t", sch).collect()
    assert [(r.k, r.s, r.d, r.b, str(r.t), r._failed) for r in got] == [
        (None, None, None, None, "None", "k"), (None, None, None, None, "None", "k"), (12, "5", 1.0, True, "None", ""),
        (None, "x", None, None, "2024-01-02", "d"), (None, '{"a":1}', None, None, "None", ""), (None,) * 4 + ("None", "*"), (None,) * 4 + ("None", "*"),
        (None,) * 4 + ("None", "")]
    assert [r.k for r in silver.unnest_bronze(b, "u", sch).collect()] == [7]
    assert silver.bronze_rejects(b, sch).count() == 4
    assert [r.record for r in silver.record_rejects(b, "t", sch).collect()] == ['{"k":"12"}', '{"k":1.5}', '{"k":null,"s":"x","d":"1","t":"2024-01-02"}', "[1]", "x"]
    plan = silver.unnest_bronze(b, "t", sch)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") <= 2 and "from_json" not in plan


def test_small_buckets_cost_no_tasks(spark):
    """The ranges of hot rows follow rows and cores; a bucket holds ``rows_per_bucket`` rows of its key at most."""
    from marketflow.operators.series import hot_keys, split_hot
    p = spark.range(4000).selectExpr("concat('s', id % 50) AS symbol", "id DIV 7 AS ts", "id AS n", "cast(id % 13 + 1 AS double) AS adj_close")
    cut = split_hot(p, "symbol", ["ts", "n"], hot_keys(p, "symbol", 2), rows_per_bucket=5)
    held = cut.groupBy("symbol", "_bucket").agg(F.count("*").alias("rows"), F.min("n").alias("low"), F.max("n").alias("high"))
    assert cut.count() == 4000 and held.agg(F.max("rows")).first()[0] <= 5
    assert cut.select(F.shiftright("_bucket", 33)).distinct().count() <= spark.sparkContext.defaultParallelism
    last = {}
    for r in held.orderBy("symbol", "_bucket").collect():
        assert r.low > last.get(r.symbol, -1)
        last[r.symbol] = r.high

import pytest
from pyspark.sql import functions as F

from marketflow.constants import FEATURE_COLUMNS, STOCK_LAYOUT
from marketflow.operators import features as E
from marketflow.operators import pages as B

TABLE = """<table><tbody>
<tr><th><a href="/f1">Fund One</a><div>FONE</div></th><td> 1.2% </td><td><span>4</span></td></tr>
<tr><th><a href="/f2">Fund Two</a></th><td>3%</td><td>5</td></tr>
<tr><td></td></tr><tr></tr>
</tbody></table>"""


def test_table_rows_and_name_symbol(spark):
    pages = spark.createDataFrame([(1, "u", TABLE)], "page_id long, url string, html string")
    rows = B.extract_rows(pages)
    got = [(r.row_pos, r.cells) for r in rows.orderBy("row_pos").collect()]
    assert got[0] == (0, ["1.2%", "4"]) and got[2] == (2, [""]) and got[3] == (3, [])
    kept, rej = B.drop_bad_rows(rows)
    assert kept.count() == 3 and rej.count() == 1
    named = B.extract_name_symbol(rows, columns=["expense", "rating"]).collect()
    assert [(r.name, r.symbol, r.expense, r.rating) for r in named] == [("Fund One", "FONE", "1.2%", "4")]


def test_zip_headers_stops_at_shorter(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],)], "cells array<string>")
    out = [r.record for r in B.zip_headers(df, ["", "Country", "Yield"][:2]).collect()]
    assert out == [{"": "a", "Country": "b"}, {"": "a"}]


def test_page_offsets_and_until_empty(spark):
    plan = spark.createDataFrame([("https://x/?offset={i}&count=250", 3)], "url_template string, max_pages int")
    assert [r.url for r in B.page_offsets(plan).orderBy("page").collect()] == [
        "https://x/?offset=0&count=250", "https://x/?offset=250&count=250", "https://x/?offset=500&count=250"]
    pages = spark.createDataFrame([("f", 1, False), ("f", 2, False), ("f", 3, True), ("f", 4, False),
                                   ("g", 1, False), ("g", 2, False), ("g", 3, False)],
                                  "feed string, page int, is_empty boolean")
    out = sorted((r.feed, r.page) for r in B.until_empty_page(pages, cap=2).collect())
    assert out == [("f", 1), ("f", 2), ("g", 1), ("g", 2)]
    import random
    rnd = random.Random(7)
    rows = [("hot", p, rnd.random() < 0.01) for p in range(1, 400)] + \
           [(f"f{i}", p, rnd.random() < 0.2) for i in range(10) for p in range(1, 30)]
    big = spark.createDataFrame(rows, "feed string, page int, is_empty boolean")
    for cap in (None, 5, 150):
        want = sorted(map(tuple, B.until_empty_page(big, cap=cap, bucket_seconds=None).collect()))
        for b in (7, "auto"):
            got = sorted(map(tuple, B.until_empty_page(big, cap=cap, bucket_seconds=b, hot_rows=100,
                                                       rows_per_bucket=25).collect()))
            assert got == want


def test_dedupe_first_and_merge_tabs(spark):
    rows = spark.createDataFrame([("x", 2, 0, "late"), ("x", 1, 5, "early"), ("y", 1, 0, "only")],
                                 "name string, page_id int, row_pos int, v string")
    assert sorted((r.name, r.v) for r in B.dedupe_first(rows).collect()) == [("x", "early"), ("y", "only")]
    t0 = spark.createDataFrame([(0, 0, "A", 1.0), (0, 1, "B", 2.0), (0, 2, "C", 3.0)],
                               "feed int, pos int, name string, price double")
    t1 = spark.createDataFrame([(0, 0, "A2", 9), (0, 1, None, 8), (0, 5, "Z", 7)],
                               "feed int, pos int, name string, rating int")
    m = sorted(map(tuple, B.merge_tabs([t0, t1]).collect()))
    assert m == [(0, 0, "A2", 1.0, 9), (0, 1, "B", 2.0, 8), (0, 2, "C", 3.0, None)]


def test_apply_layout_and_unknown_feed(spark):
    df = spark.createDataFrame([("stocks", [str(i) for i in range(11)])], "feed string, cells array<string>")
    out = B.apply_layout(df, {"stocks": STOCK_LAYOUT}, "feed").collect()[0]
    assert out.symbol == "0" and out.sector == "10"
    bad = spark.createDataFrame([("nope", ["a"])], "feed string, cells array<string>")
    with pytest.raises(Exception):
        B.apply_layout(bad, {"stocks": STOCK_LAYOUT}, "feed").collect()
    assert B.apply_layout(bad, {"stocks": STOCK_LAYOUT}, "feed", on_unknown="null").collect()[0].symbol is None


def test_crawl_plan_and_cache(spark):
    countries = spark.createDataFrame([("usa", "usa"), ("peru", "frontier"), ("uk", "medium")],
                                      "country string, tier string")
    sectors = spark.createDataFrame([("Finance", "heavy"), ("Energy", "light")], "sector string, sector_class string")
    plan, rej = B.crawl_plan(countries, sectors, B.tier_caps(spark))
    caps = sorted((r.country, r.sector, r.max_pages) for r in plan.collect())
    assert caps == [("uk", "Energy", 4), ("uk", "Finance", 5), ("usa", "Energy", 5), ("usa", "Finance", 5)]
    assert [r.country for r in rej.collect()] == ["peru"]
    writes = spark.createDataFrame([("usa_finance", "u1", 1), ("usa_finance", "u2", 2)],
                                   "cache_key string, url string, written_at int")
    req = plan.select(B.cache_key("country", "sector").alias("cache_key"))
    looked, miss = B.cache_lookup(req, B.cache_upsert(writes))
    hits = {r.cache_key: r.url for r in looked.filter("hit").collect()}
    assert hits == {"usa_finance": "u2"} and miss.count() == 3


def test_encode_split_scaler(spark, scratch):
    form = spark.createDataFrame([(i, str(20 + i), ["PhD", "Bachelor degree", "Astronaut"][i % 3], "Managerial",
                                   "1", "100.5", "x", "3", "1") for i in range(300)],
                                 "id long, age string, education string, occupation string, kids string, "
                                 "income string, net_worth_income string, risk string, married string")
    f = E.encode_form(form)
    r = f.select("education", "occupation", "net_worth").distinct().collect()
    assert {x.education for x in r} == {4, 2, 0} and {x.occupation for x in r} == {2}
    assert {x.net_worth for x in r} == {None}
    tr, te = E.split(f, "id")
    a = {x.id for x in tr.collect()}
    b = {x.id for x in te.collect()}
    assert not (a & b) and len(a) + len(b) == 300 and 30 < len(b) < 90
    tr2, _ = E.split(f.repartition(7), "id")
    assert {x.id for x in tr2.collect()} == a
    feats = ["age", "income", "kids"]
    sc = E.fit_scaler(tr, feats)
    scaled = E.scale(tr, sc, feats)
    st = scaled.agg(F.avg("age").alias("m"), F.stddev_pop("age").alias("s"), F.max("kids").alias("k")).collect()[0]
    assert abs(st.m) < 1e-9 and abs(st.s - 1) < 1e-9 and st.k == 0.0     # constant column: sd 0 -> / 1
    E.save_scaler(sc, scratch + "/scaler", feats)
    back = E.load_scaler(spark, scratch + "/scaler", feats).collect()[0].asDict()
    assert back == pytest.approx(sc.collect()[0].asDict())


def test_rename_survey_and_order(spark):
    cols = ["Unnamed: 0", "AGE07", "EDCL07", "MARRIED07", "KIDS07", "LIFECL07", "OCCAT107", "INCOME07", "RISK07",
            "WSAVED07", "SPENDMOR07", "NETWORTH07", "TrueRiskTol"]
    df = spark.createDataFrame([tuple(range(len(cols)))], cols)
    out = E.feature_order(E.rename_survey(df))
    assert out.columns == FEATURE_COLUMNS + ["TrueRiskTol"]


def test_pick_best_tie_and_latest_version(spark):
    err = spark.createDataFrame([("rf", 0, 1.0), ("xgb", 1, 1.0), ("cat", 2, 2.0)], "model string, ordinal int, mse double")
    assert E.pick_best(err).collect()[0].best_model == "rf"
    reg = spark.createDataFrame([("m", 1, "None", "u1"), ("m", 3, "Archived", "u3"), ("m", 2, "Production", "u2")],
                                "model_name string, version int, stage string, model_uri string")
    r = E.latest_version(reg, ["None", "Staging", "Production"]).collect()[0]
    assert (r.latest_version, r.model_uri) == (2, "u2")


def test_log_run_versions(spark, scratch):
    reg = scratch + "/registry"
    E.log_run(spark, reg, "BestModel", {"n": 1}, 4.0, "models:/BestModel/1")
    E.log_run(spark, reg, "BestModel", {"n": 2}, 1.0, "models:/BestModel/2", stage="Production")
    E.log_run(spark, reg, "Other", {}, 2.0, "models:/Other/1")
    r = {x.model_name: x for x in E.latest_version(spark.read.parquet(reg)).collect()}
    assert r["BestModel"].latest_version == 2 and r["Other"].latest_version == 1
    rows = spark.read.parquet(reg).filter("model_name = 'BestModel' AND version = 2").collect()
    assert rows[0].rmse == 1.0


def test_log_run_fails_on_an_unreadable_registry(spark, scratch):
    import os

    import pytest
    reg = scratch + "/registry"
    os.makedirs(reg)
    with open(reg + "/part-0.parquet", "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        E.log_run(spark, reg, "BestModel", {}, 1.0, "models:/BestModel/1")


def test_model_kinds_differ_and_every_parameter_takes_effect():
    import pytest
    from marketflow.operators.models import _estimator
    a, b = (_estimator(k, "label", 1) for k in ("boosted_a", "boosted_b"))
    assert a.getStepSize() != b.getStepSize() and a.getSubsamplingRate() != b.getSubsamplingRate()
    f = _estimator("forest", "label", 1, {"n_estimators": 7, "max_depth": None, "min_samples_split": 9, "min_samples_leaf": 2})
    assert (f.getNumTrees(), f.getMaxDepth(), f.getMinInstancesPerNode()) == (7, 30, 5)
    v = _estimator("boosted_b", "label", 1, {"validation_col": "held", "validation_tol": 0.5})
    assert v.getValidationIndicatorCol() == "held" and v.getValidationTol() == 0.5
    with pytest.raises(ValueError):
        _estimator("forest", "label", 1, {"max_depth": 31})


def test_cell_text_as_displayed(spark):
    from marketflow.functions.text import strip_tags
    cases = {" a &amp;lt; <b>b</b>\n  c ": "a &lt; b c", "&#39;x&#x2019;&#8217;": "'x\u2019\u2019", "&#;&#zz; &copy;": "&#;&#zz; \u00a9",
             "": "", "&quot;q&quot;&nbsp;": '"q"\u00a0', "&#128512;": "\U0001f600"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.s for r in df.select("t", strip_tags("t").alias("s")).collect()}
    assert got == {**cases, None: None}


def test_a_cluster_needs_a_shared_folder():
    import pytest
    from types import SimpleNamespace
    from marketflow.session import ensure_checkpoint_dir
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="shared"):
        ensure_checkpoint_dir(cluster)


def test_fund_layouts_constants_and_conform(spark):
    from marketflow.operators import quality as C
    cells = ["Gold", "4.1%", "3.9%", "6.2", "1.5", "2.5", "0.45", "1200"]
    rows = spark.createDataFrame([("Core", "Bond_Funds", "Fund A", "FA", cells),
                                  ("Large", "Equity_US_Index_Funds", "Fund B", "FB", ["Large Blend"] + cells[:7])],
                                 "category string, fund_type string, name string, symbol string, cells array<string>")
    named = B.add_fund_constants(B.apply_fund_layout(rows))
    r = {x.fund_type: x for x in named.collect()}
    assert r["Bond_Funds"].medalist_rating == "Gold" and r["Bond_Funds"].asset_under_management == "1200"
    assert r["Bond_Funds"].region == "US Bonds" and r["Bond_Funds"].funds_repartition_strategy == "Bonds"
    assert r["Equity_US_Index_Funds"].morningstar_category == "Large Blend"
    assert r["Equity_US_Index_Funds"].funds_repartition_strategy == "Index_Funds"
    compat = {x.fund_type: x for x in B.apply_fund_layout(rows, compat=True).collect()}
    assert compat["Equity_US_Index_Funds"].medalist_rating == "Large Blend"      # upstream mislabelling kept
    typed = C.conform(named.filter("fund_type = 'Bond_Funds'").withColumn("ttm_yield", F.lit("3.9")),
                      "bond_fund").collect()[0]
    assert typed.ttm_yield == 3.9 and "sec_30_day_yield" in typed.failed_fields    # "4.1%" is not a number


def test_reference_configs(spark):
    countries, sectors = B.reference_crawl_inputs(spark)
    plan, rej = B.crawl_plan(countries, sectors, B.tier_caps(spark))
    assert plan.count() == 20 * 11 and rej.count() == 0
    # ≤ 13,750 rows per country: 11 sectors x 5 pages x 250 rows at most
    per = plan.groupBy("country").agg(F.sum("max_pages").alias("p")).collect()
    assert max(r.p for r in per) * 250 <= 13750
    caps = {(r.country, r.sector_class): r.max_pages for r in plan.select("country", "sector_class", "max_pages")
            .distinct().collect()}
    assert caps[("usa", "light")] == 5 and caps[("uk", "light")] == 4 and caps[("japan", "heavy")] == 4
    bonds = spark.createDataFrame([(["", "Germany", "2.3", "0.01", "0.1", "0.2", "0.5", "Jan/1"],), (["x", "US"],)],
                                  "cells array<string>")
    recs = [r.record for r in B.zip_bond_quotes(bonds).collect()]
    assert recs[0]["Country"] == "Germany" and recs[0]["Date"] == "Jan/1" and recs[1] == {"": "x", "Country": "US"}
    t0 = B.etf_tab(spark.createDataFrame([("f", 0, ["E1", "SYM", "10", "1%", "0.2", "Eq"])],
                                         "feed string, pos int, cells array<string>"), 0)
    t1 = B.etf_tab(spark.createDataFrame([("f", 0, ["E1", "0.1", "0.2", "0.3", "0.4", "0.5"])],
                                         "feed string, pos int, cells array<string>"), 1)
    m = B.merge_tabs([t0, t1]).collect()[0]
    assert m["Symbol"] == "SYM" and m["6-Month Yield"] == "0.5"


def test_cells_and_names_are_cut_once(spark):
    """The filter on names and cells reads what was cut, it doesn't cut again."""
    from marketflow.operators import pages as B
    html = '<table><tr><th><a>N &amp; &#65;</a><div>S</div></th><td>1 &lt;</td><td></td></tr><tr><th><a></a><div>T</div></th></tr></table>'
    df = spark.createDataFrame([(1, html), (2, None), (1, html)], "page_id long, html string").repartition(2)
    got = B.extract_name_symbol(B.extract_rows(df), columns=("a",))
    assert sorted((r.page_id, r.row_pos, r.name, r.symbol, r.a, r.cells) for r in got.collect()) == [(1, 0, "N & A", "S", "1 <", ["1 <", ""])] * 2
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(x) for x in (B.TABLE_CELL, "<a[^>]*>(.*?)</a>", "<div[^>]*>(.*?)</div>")] == [1, 1, 1]

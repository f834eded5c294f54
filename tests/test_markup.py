"""Character references, the table parser, gapless places and the ETF chain."""

import html
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from marketflow.constants import ETF_TABS
from marketflow.functions.text import decode_entities
from marketflow.operators import pages as B
from marketflow.operators.markup import page_rows, table_rows


def test_references_equal_the_standard_library(spark):
    fixed = ["&#9999999;", "&#xD800;", "&#0;", "&#38;lt;", "&eacute;", "&amp;lt;", "&notit;", "&notin;", "&#65 b", "&#x1F600;", "&#128;", "&#129;x", "&#1;", "&",
             "a & b", "&&amp;&", "&#;", "&#x;", "&copy", "&copyright;", "&zzz;", "&#99999999999999999999;", "&#0000000065;", "&#xfffe;", "&NotEqualTilde;", "&lt", "&#13;", "", "plain"]
    r = random.Random(0)
    parts = ["&", "#", "x", "6", "5", "amp", "lt", ";", "not", "in", " ", "<", "copy", "0", "é", "X", "F", "nbsp;", "&#39;"]
    texts = fixed + ["".join(r.choice(parts) for _ in range(r.randint(1, 9))) for _ in range(2_000)]
    got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", decode_entities("t").alias("d")).collect()
    assert all(x.d == (None if x.t is None else html.unescape(x.t)) for x in got)


def test_nested_tables_comments_scripts_and_attributes():
    page = ('<table><tr><th><a title="a>b">N &eacute;</a><div>S</div><td>x<table><tr><td>in<!-- <td>no --></table>y<td>z<script>"</td>"</script></tr>'
            '<tr><td data-x="1>2"> q\n r </table>out<table><td>no row tag</td><tr></tr><tr><td>open')
    assert page_rows(page) == [(1, 0, 0, None, None, ["in"]), (0, None, 0, "N é", "S", ["xy", "z"]), (0, None, 1, None, None, ["q r"]),
                               (2, None, 0, None, None, ["no row tag"]), (2, None, 1, None, None, []), (2, None, 2, None, None, ["open"])]
    assert page_rows(None) == page_rows("") == page_rows("<td>stray</td></table>") == []
    assert page_rows("<![x[ <table>]]><table><tr><td>&#38;lt;</table>")[-1][-1] == ["&lt;"]
    assert page_rows("<table><tr>" + "<td>x" * 100_000)[0][-1] == ["x"] * 100_000


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "<a>", "</a>", "<div>", "x", "&", "<", "<!--", "-->", "<![", "<script>", "</script>", "\n"]), max_size=40))
def test_no_markup_crashes_the_parser(parts):
    rows = page_rows("".join(parts))
    places = [(r[0], r[2]) for r in rows]
    assert len(places) == len(set(places)) and all(r[1] is None or r[1] < r[0] for r in rows)


def test_table_rows_keep_their_columns(spark):
    df = spark.createDataFrame([(1, "a", "<table><tr><td>1<td>2</table>"), (2, None, None), (3, "c", "no table")], "page_id long, feed string, html string")
    got = table_rows(df, keep=("page_id", "feed")).collect()
    assert [tuple(r) for r in got] == [(1, "a", 0, None, 0, None, None, ["1", "2"])]
    assert table_rows(df.limit(0)).count() == 0


def test_places_are_gapless_in_groups_of_any_size(spark):
    r = random.Random(2)
    rows = [("hot", r.randint(0, 50), i) for i in range(3_000)] + [(f"g{i % 40}", i, i) for i in range(200)] + [(None, None if i % 2 else i, i) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, o long, i long").repartition(6)
    got = B.number_rows(df, ["g"], ["o", "i"]).collect()
    by = {}
    for x in got:
        by.setdefault(x.g, []).append(x)
    assert len(got) == len(rows)
    for mine in by.values():
        mine.sort(key=lambda x: x.pos)
        assert [x.pos for x in mine] == list(range(len(mine)))
        assert mine == sorted(mine, key=lambda x: (x.o is not None, x.o or 0, x.i))
    assert B.number_rows(df.limit(0), ["g"], ["o"]).count() == 0


def test_etf_tabs_with_repeats_become_typed_records(spark):
    def page(tab, names):
        cells = {0: ["S", "1.5", "2", "3", "cat"], 3: ["1", "2", "7", "4", "5"], 4: ["1", "box", "style", "2", "BB"], 5: ["low", "1", "2", "3", "4"]}.get(tab, ["1", "2", "3", "4", "5"])
        return "<table><tr><th>Name</th></tr>" + "".join(f"<tr><td>{n}</td>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>" for n in names) + "</table>"
    rows = [("m", t, p, page(t, names)) for t in range(len(ETF_TABS)) for p, names in enumerate((["A", "B", "A"], ["B", "C &amp; D"], []))]
    got = B.etf_records(spark.createDataFrame(rows, "feed string, tab int, page int, html string")).orderBy("pos").collect()
    assert [(r.pos, r.name, r.symbol, r.manager_seniority, r.management, r.is_valid) for r in got] == [
        (0, "A", "S", 7, "m", True), (1, "B", "S", 7, "m", True), (2, "C & D", "S", 7, "m", True)]

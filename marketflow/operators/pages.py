"""Page-to-table extraction as jobs over a pages table.

Pages arrive as rows ``(page_id, url, html)``; rows and cells are cut out
with regular-expression column functions, so every page is processed by
the executor that holds it.  Row/cell patterns are arguments.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketflow.constants import (BOND_QUOTE_HEADERS, COUNTRY_TIERS, ETF_FIELD_NAMES, ETF_TABS, FEED_CONSTANTS, FEED_LAYOUTS,
                                  FEED_LAYOUTS_COMPAT, FUND_RECORD_NAMES, HEAVY_SECTORS, LIGHT_SECTORS, ROWS_PER_STOCK_PAGE,
                                  TIER_PAGE_CAPS)
from marketflow.functions.text import strip_tags
from marketflow.functions.util import with_once
from marketflow.operators.quality import conform
from marketflow.schemas import RAW_FUND
from marketflow.session import materialize
from marketflow.operators.series import DEFAULT_HOT_ROWS, DEFAULT_ROWS_PER_BUCKET, join_carry, plan_buckets

TABLE_ROW = r"(?s)<tr[^>]*>(.*?)</tr>"
TABLE_CELL = r"(?s)<td[^>]*>(.*?)</td>"
LIST_ROW = r"(?s)<li(?:\s[^>]*)?>(.*?)</li>"
LINK_CELL = r"(?s)<a[^>]*>(.*?)</a>"


def extract_rows(pages: DataFrame, html: str = "html", row_pattern: str = TABLE_ROW,
                 cell_pattern: str = TABLE_CELL, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """B1: every row of a page -> ``row_pos``, ``row_html`` and the array of
    trimmed, tag-free cell texts ``cells``."""
    rows = F.regexp_extract_all(F.col(html), F.lit(row_pattern), 1)
    out = pages.select(*keep, F.posexplode(rows).alias("row_pos", "row_html"))
    cells = F.transform(F.regexp_extract_all(F.col("row_html"), F.lit(cell_pattern), 1), strip_tags)
    return with_once(out, cells=cells)


def extract_name_symbol(rows: DataFrame, row_html: str = "row_html",
                        name_pattern: str = r"(?s)<th[^>]*>.*?<a[^>]*>(.*?)</a>",
                        symbol_pattern: str = r"(?s)<th[^>]*>.*?<div[^>]*>(.*?)</div>",
                        columns: Sequence[str] = (), cells: str = "cells") -> DataFrame:
    """B2: header link text = name, header div text = symbol, then the named
    cells in order.  A row without name or symbol, or with fewer cells than
    names, fails and is dropped (see ``name_symbol_rejects``)."""
    name = strip_tags(F.regexp_extract(F.col(row_html), name_pattern, 1))
    symbol = strip_tags(F.regexp_extract(F.col(row_html), symbol_pattern, 1))
    df = with_once(rows, name=name, symbol=symbol)
    for i, c in enumerate(columns):
        df = df.withColumn(c, F.get(F.col(cells), i))
    return df.filter(_name_symbol_ok(len(columns), cells))


def _name_symbol_ok(n: int, cells: str) -> Column:
    return (F.col("name") != "") & (F.col("symbol") != "") & (F.size(F.col(cells)) >= n)


def name_symbol_rejects(rows: DataFrame, n_columns: int = 0, cells: str = "cells") -> DataFrame:
    """Rows that ``extract_name_symbol`` drops (computed on its output columns)."""
    return rows.filter(~_name_symbol_ok(n_columns, cells))


def zip_headers(df: DataFrame, headers: Sequence[str] | Column, cells: str = "cells",
                out: str = "record") -> DataFrame:
    """Pair header names with cells, stopping at the shorter list."""
    h = F.array(*[F.lit(x) for x in headers]) if not isinstance(headers, Column) else headers
    n = F.least(F.size(h), F.size(F.col(cells)))
    return df.withColumn(out, F.map_from_arrays(F.slice(h, 1, n), F.slice(F.col(cells), 1, n)))


def drop_bad_rows(rows: DataFrame, cells: str = "cells") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): a row without cells is rejected."""
    ok = F.coalesce(F.size(F.col(cells)) > 0, F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def page_offsets(plan: DataFrame, url_template: str = "url_template", max_pages: str = "max_pages",
                 rows_per_page: int = ROWS_PER_STOCK_PAGE) -> DataFrame:
    """One row per page to fetch: ``page`` 0..cap-1, ``offset`` = page x
    rows per page, ``url`` with ``{i}`` replaced by the offset."""
    pages = F.sequence(F.lit(0), F.col(max_pages) - 1)
    df = plan.withColumn("page", F.explode(pages))
    off = F.col("page") * F.lit(rows_per_page)
    return (df.withColumn("offset", off)
              .withColumn("url", F.replace(F.col(url_template), F.lit("{i}"), off.cast("string"))))


def until_empty_page(pages: DataFrame, feed: str = "feed", page: str = "page", is_empty: str = "is_empty",
                     cap: int | None = None, bucket_seconds="auto", hot_rows: int = DEFAULT_HOT_ROWS,
                     rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Keep the pages of each feed before its first empty page, and at
    most ``cap`` pages (in page order).

    Plain form: one window over the feed.  A feed with more than ``hot_rows``
    pages (``"auto"``), or every feed (an int width over the page order), is
    split into page-range buckets: rank and empty count run inside each
    bucket, and the counts of all earlier buckets are carried in from a small
    per-bucket table joined back on (feed, bucket).
    """
    bucketed = plan_buckets(pages, feed, [page], bucket_seconds, hot_rows, rows_per_bucket)
    empty = F.when(F.col(is_empty), 1).otherwise(0)
    if bucketed is None:
        w = Window.partitionBy(feed).orderBy(page)
        run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = pages.withColumn("_seen_empty", F.sum(empty).over(run)).withColumn("_rank", F.row_number().over(w))
    else:
        w1 = Window.partitionBy(feed, "_bucket").orderBy(page)
        run = w1.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = bucketed.withColumn("_e_in", F.sum(empty).over(run)).withColumn("_r_in", F.row_number().over(w1))
        wb = Window.partitionBy(feed).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        carry = (rows.groupBy(feed, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum(empty).alias("_e"))
                     .withColumn("_c_n", F.coalesce(F.sum("_n").over(wb), F.lit(0)))
                     .withColumn("_c_e", F.coalesce(F.sum("_e").over(wb), F.lit(0)))
                     .select(feed, "_bucket", "_c_n", "_c_e"))
        df = (join_carry(rows, carry, feed)
                  .withColumn("_seen_empty", F.col("_c_e") + F.col("_e_in"))
                  .withColumn("_rank", F.col("_c_n") + F.col("_r_in"))
                  .drop("_bucket", "_e_in", "_r_in", "_c_n", "_c_e"))
    if cap is not None:
        df = df.filter(F.col("_rank") <= cap)
    return df.filter(F.col("_seen_empty") == 0).drop("_seen_empty", "_rank")


def dedupe_first(rows: DataFrame, key: str = "name", order: Sequence[str] = ("page_id", "row_pos")) -> DataFrame:
    """The first occurrence of each key in (page, position) order wins.

    ``min_by`` over the whole row: a partial aggregate, so a key repeated on
    every page is reduced before the shuffle.
    """
    others = [c for c in rows.columns if c != key]
    o = F.struct(*[F.col(c) for c in order])
    best = F.min_by(F.struct(*[F.col(c) for c in others]), o)
    return rows.groupBy(key).agg(best.alias("_r")).select(key, "_r.*")


def number_rows(rows: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "pos") -> DataFrame:
    """Gapless places 0, 1, 2, ... of the rows of each group in ``order``, for
    groups of any size: no window runs over a whole group.

    The rows are range-partitioned by (group, order) and written once; within
    a partition each counts its predecessors, and a table of one row per
    (group, partition) carries on the counts of the partitions before.  Rows
    equal in every order column may stand either way.  NULLs come first.  Runs
    one job when called."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "numbered-rows", partitions=None)
    inside = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)) - 1)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = (ranged.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
              .withColumnsRenamed({c: f"_of_{c}" for c in ("_part", *by)}))
    same = inside["_part"] == counts["_of__part"]
    for c in by:
        same = same & inside[c].eqNullSafe(counts[f"_of_{c}"])
    return inside.join(counts, same).select(*rows.columns, (F.col("_at") + F.col("_before")).cast("long").alias(out))


def etf_records(pages: DataFrame, feed: str = "feed", tab: str = "tab", page: str = "page", html: str = "html") -> DataFrame:
    """ETF screener pages -> typed ETF records.

    Each tab lists the funds of a ``feed`` over several pages.  Rows come from
    the pages' outer tables; of the rows of a name the first in (page, place)
    stays; the rest are numbered without gaps, and the tabs are merged by that
    place.  ``management`` is the feed.  Fields are typed by the ETF model with
    ``failed_fields`` and ``is_valid``; ``pos`` is the place in the listing."""
    from marketflow.operators.markup import table_rows
    rows = table_rows(pages.select(feed, tab, page, html), html, keep=(feed, tab, page))
    rows = rows.filter("parent_pos IS NULL AND size(cells) > 0").select(
        F.struct(F.col(feed), F.col(tab), F.col("cells")[0].alias("name")).alias("_who"), feed, tab, page, "table_pos", "row_pos", "cells")
    first = dedupe_first(rows, "_who", (page, "table_pos", "row_pos")).drop("_who")
    placed = number_rows(first, (feed, tab), (page, "table_pos", "row_pos"))
    placed = materialize(placed, "etf-rows", partitions=None)           # each tab reads it
    merged = merge_tabs([etf_tab(placed.filter(F.col(tab) == i), i, feed, typed=True) for i in range(len(ETF_TABS))], on=(feed, "pos"))
    return conform(merged.withColumn("management", F.col(feed)), "etf", keep=("pos",))


def merge_tabs(tabs: Sequence[DataFrame], on: Sequence[str] = ("feed", "pos")) -> DataFrame:
    """Stitch column groups of the same listing into one wide record.

    The first tab fixes the rows; each later tab is left-joined on ``on``
    (by position by default, as upstream; ``on=("name",)`` joins by name).
    Shared columns take the later tab's value when present; rows of a later
    tab beyond the first tab's length are ignored.
    """
    out = tabs[0]
    keys = list(on)
    for t in tabs[1:]:
        shared = [c for c in t.columns if c in out.columns and c not in keys]
        new = [c for c in t.columns if c not in out.columns]
        r = t.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in shared], *new)
        j = out.join(r, keys, "left")
        out = j.select(*keys, *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in shared else F.col(c)
                               for c in out.columns if c not in keys], *new)
    return out


def union_feeds(feeds: Mapping[str, DataFrame], category_col: str = "category",
                tags: Mapping[str, str] | None = None) -> DataFrame:
    """Stack feeds with different columns; tag each with its category and
    the literal ``tags`` columns."""
    out = None
    for name, df in feeds.items():
        d = df.withColumn(category_col, F.lit(name))
        for k, v in (tags or {}).items():
            d = d.withColumn(k, F.lit(v))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def apply_layout(rows: DataFrame, layouts: Mapping[str, Sequence[str]], layout_key: str | Column,
                 cells: str = "cells", keep: Sequence[str] = (), on_unknown: str = "error") -> DataFrame:
    """Positional renaming per feed.

    ``layouts`` maps a feed to its column names; each output column takes the
    cell at that name's position in the row's layout.  A feed without layout
    raises (``on_unknown="error"``, as upstream) or yields NULL columns
    (``"null"``).
    """
    key = F.col(layout_key) if isinstance(layout_key, str) else layout_key
    names: list[str] = []
    for cols in layouts.values():
        names += [c for c in cols if c not in names]
    out = {}
    for n in names:
        expr = None
        for feed, cols in layouts.items():
            if n in cols:
                v = F.get(F.col(cells), cols.index(n))
                expr = F.when(key == feed, v) if expr is None else expr.when(key == feed, v)
        out[n] = expr
    df = rows
    if on_unknown == "error":
        known = key.isin(list(layouts))
        df = df.withColumn("_chk", F.when(known, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("unsupported feed: "), F.coalesce(key.cast("string"), F.lit("NULL"))))))
        df = df.filter(F.col("_chk")).drop("_chk")
    return df.select(*keep, *[out[n].alias(n) for n in names])


def add_constants(df: DataFrame, constants: Mapping[str, object] | None = None,
                  by_feed: Mapping[str, Mapping[str, object]] | None = None,
                  feed: str | None = None) -> DataFrame:
    """Literal columns; ``by_feed`` gives per-feed values chosen with a
    CASE on the ``feed`` column (no join)."""
    out = df
    for k, v in (constants or {}).items():
        out = out.withColumn(k, F.lit(v) if not isinstance(v, Column) else v)
    if by_feed:
        cols = sorted({k for vals in by_feed.values() for k in vals})
        for c in cols:
            expr = None
            for f, vals in by_feed.items():
                if c in vals:
                    lit = F.lit(vals[c])
                    expr = F.when(F.col(feed) == f, lit) if expr is None else expr.when(F.col(feed) == f, lit)
            out = out.withColumn(c, expr)
    return out


def apply_fund_layout(rows: DataFrame, feed: str = "fund_type", cells: str = "cells",
                      keep: Sequence[str] = ("name", "symbol", "category", "fund_type"),
                      compat: bool = False, on_unknown: str = "error") -> DataFrame:
    """B10 for the seven fund feeds: the td cells of each row named by its
    feed's column layout (``compat=True``: the bond layout that upstream laid
    over US index and actively managed funds)."""
    layouts = FEED_LAYOUTS_COMPAT if compat else FEED_LAYOUTS
    return apply_layout(rows, layouts, feed, cells=cells, keep=keep, on_unknown=on_unknown)


def fund_records(named: DataFrame, names=FUND_RECORD_NAMES) -> DataFrame:
    """Laid-out fund rows (``apply_fund_layout``) as raw fund records: columns
    that a feed calls differently take the record's name, and each row keeps
    the one that its feed's layout has."""
    out = named
    for layout_name, record_name in names.items():
        if layout_name in out.columns:
            both = ([F.col(record_name)] if record_name in out.columns else []) + [F.col(layout_name)]
            out = out.withColumn(record_name, F.coalesce(*both))
    return out.select(*[f.name for f in RAW_FUND.fields])


def add_fund_constants(df: DataFrame, feed: str = "fund_type") -> DataFrame:
    """B11 for the fund feeds: ``region`` and ``funds_repartition_strategy``
    literals of each feed (NULL for feeds without them)."""
    by_feed = {f: {"region": r, "funds_repartition_strategy": st} for f, (r, st) in FEED_CONSTANTS.items()}
    return add_constants(df, by_feed=by_feed, feed=feed)


def zip_bond_quotes(rows: DataFrame, cells: str = "cells", out: str = "record") -> DataFrame:
    """B3 for the bond quote tables: cells paired with the fixed headers."""
    return zip_headers(rows, BOND_QUOTE_HEADERS, cells=cells, out=out)


def etf_tab(rows: DataFrame, tab: int, feed: str = "feed", pos: str = "pos", cells: str = "cells",
            typed: bool = False) -> DataFrame:
    """One ETF screener tab as named columns (``ETF_TABS[tab]``), ready for
    ``merge_tabs`` on (feed, pos) or on ``Name``.  ``typed=True`` uses the field
    names of the typed ETF record (C1)."""
    names = [ETF_FIELD_NAMES[n] for n in ETF_TABS[tab]] if typed else ETF_TABS[tab]
    return rows.select(feed, pos, *[F.get(F.col(cells), i).alias(n) for i, n in enumerate(names)])


def reference_crawl_inputs(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(countries, sectors) of the stock crawl configuration: the twenty
    countries with their tier, the eleven sectors with their class.  Fixed
    tables of known size."""
    countries = [(c, tier) for tier, cs in COUNTRY_TIERS.items() for c in cs]
    sectors = [(x, "heavy") for x in HEAVY_SECTORS] + [(x, "light") for x in LIGHT_SECTORS]
    return (F.broadcast(spark.createDataFrame(countries, "country string, tier string")),
            F.broadcast(spark.createDataFrame(sectors, "sector string, sector_class string")))


def tier_caps(spark: SparkSession, caps=TIER_PAGE_CAPS) -> DataFrame:
    """Page cap per (tier, sector class); a fixed eight-row table."""
    rows = [(t, "heavy", h) for t, h, _l in caps] + [(t, "light", lo) for t, _h, lo in caps]
    return F.broadcast(spark.createDataFrame(rows, "tier string, sector_class string, max_pages int"))


def crawl_plan(countries: DataFrame, sectors: DataFrame, caps: DataFrame,
               url_template: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(plan, rejected countries).

    ``countries(country, tier)``, ``sectors(sector, sector_class)``,
    ``caps(tier, sector_class, max_pages)``.  Every country gets every sector
    of each class with its tier's cap: two equi-joins (country -> caps on
    tier, then caps -> sectors on class), no cross product.  A country whose
    tier has no caps is rejected.
    """
    plan = countries.join(caps, "tier", "inner").join(sectors, "sector_class", "inner")
    if url_template is not None:
        plan = plan.withColumn("url_template", url_template)
    rejected = countries.join(caps.select("tier"), "tier", "left_anti")
    return plan, rejected


def cache_key(country, sector) -> Column:
    """``country_sector`` in lower case."""
    c = F.col(country) if isinstance(country, str) else country
    s = F.col(sector) if isinstance(sector, str) else sector
    return F.concat(F.lower(c), F.lit("_"), F.lower(s))


def cache_upsert(writes: DataFrame, key: str = "cache_key", value: str = "url",
                 order: Sequence[str] = ("written_at",)) -> DataFrame:
    """The cache table after a batch of writes; the last write of a key
    wins (``max_by`` on the write order, a partial aggregate)."""
    o = F.struct(*[F.col(c) for c in order])
    return writes.groupBy(key).agg(F.max_by(F.col(value), o).alias(value))


def cache_lookup(requests: DataFrame, cache: DataFrame, key: str = "cache_key",
                 value: str = "url") -> tuple[DataFrame, DataFrame]:
    """(requests with ``hit`` and the cached value, misses to generate)."""
    c = cache.select(key, value, F.lit(True).alias("_hit"))
    looked = (requests.join(c, key, "left")
                      .withColumn("hit", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit"))
    misses = requests.join(cache.select(key), key, "left_anti")
    return looked, misses

"""Queries for profiles, roles, keys, the mapping proposal and sheet layouts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tidemark.constants import MONTHLY
from tidemark.operators import intake, profile, reshape
from tidemark.plans.catalog import query, table
from tidemark.plans.panels import trunc_sql


def _stats_sql(source: str, columns: dict[str, str]) -> str:
    """columns: name to native kind."""
    parts = []
    for place, (name, kind) in enumerate(columns.items()):
        number = kind == "numeric"
        parts.append(
            f"""SELECT '{name}' AS name, {place} AS position, '{kind}' AS native, COUNT(*) AS rows,
              COUNT(*) - COUNT("{name}") AS null_count,
              COUNT(DISTINCT "{name}") + CASE WHEN COUNT("{name}") < COUNT(*) THEN 1 ELSE 0 END AS distinct_count,
              {f'MIN("{name}")' if number else 'NULL'}::DOUBLE AS low, {f'MAX("{name}")' if number else 'NULL'}::DOUBLE AS high,
              {'NULL' if number else f'MIN("{name}")'}::VARCHAR AS first_text, {'NULL' if number else f'MAX("{name}")'}::VARCHAR AS last_text,
              {f'AVG("{name}")' if number else 'NULL'}::DOUBLE AS mean_value FROM {source}"""
        )
    return " UNION ALL ".join(parts)


_SALES_COLUMNS = {
    "order_date": "date",
    "net_revenue": "numeric",
    "units": "numeric",
    "discount_rate": "numeric",
    "region": "text",
    "status": "text",
    "line_id": "numeric",
    "constant": "numeric",
}
_SALES_SQL = """(SELECT CAST(l_shipdate AS DATE) AS order_date, l_extendedprice AS net_revenue,
    CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS units, l_discount AS discount_rate,
    'Area ' || (l_suppkey % 5) AS region, CASE WHEN l_linestatus = 'O' THEN l_returnflag END AS status,
    l_orderkey * 8 + l_linenumber AS line_id, 1 AS constant FROM lineitem) AS sales"""


def _sales(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("order_date"),
        F.col("l_extendedprice").alias("net_revenue"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("units"),
        F.col("l_discount").alias("discount_rate"),
        F.concat(F.lit("Area "), (F.col("l_suppkey") % 5).cast("string")).alias("region"),
        F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).alias("status"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_id"),
        F.lit(1).alias("constant"),
    )


@query(
    "column_statistics",
    "name:str position:int native:str rows:int null_count:int distinct_count:int low:2 high:2 first_text:str "
    "last_text:str mean_value:4",
    _stats_sql(_SALES_SQL, _SALES_COLUMNS),
)
def column_statistics(spark, folder):
    stats = profile.column_statistics(_sales(spark, folder))
    number = F.col("native") == "numeric"
    return stats.select(
        "*",
        F.when(number, F.col("min_value").cast("double")).alias("low"),
        F.when(number, F.col("max_value").cast("double")).alias("high"),
        F.when(~number, F.col("min_value")).alias("first_text"),
        F.when(~number, F.col("max_value")).alias("last_text"),
    )


# What each name says: date, strong, weak, weight, identifier, dimension, money.
_SIGNALS = """(VALUES ('order_date', 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, false), ('net_revenue', 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, true),
    ('units', 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, false), ('discount_rate', 0.0, 0.0, 0.6, 0.0, 0.0, 0.0, false),
    ('region', 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, false), ('status', 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, false),
    ('line_id', 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, false), ('constant', 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, false))
    AS s(name, s_date, s_strong, s_weak, s_weight, s_id, s_dim, money)"""
_PROFILE = f"""stats AS ({_stats_sql(_SALES_SQL, _SALES_COLUMNS)}),
    kinds AS (SELECT *, distinct_count / rows AS share, CASE WHEN native <> 'text' THEN native
        WHEN rows > null_count AND distinct_count <= LEAST(GREATEST(50, (rows - null_count) * 0.2), 200) THEN 'categorical'
        ELSE 'text' END AS kind FROM stats),
    scored AS (SELECT k.*, s.*, CASE WHEN kind = 'date' THEN GREATEST(0, LEAST(1, 0.6 + 0.25 * s_date
          + CASE WHEN share > 0.9 THEN 0.15 WHEN share > 0.05 THEN 0.08 ELSE 0 END - 0.2 * null_count / rows)) ELSE 0 END AS date_score,
        CASE WHEN kind = 'numeric' THEN GREATEST(0, LEAST(1, 0.4 + CASE WHEN s_strong > 0 THEN 0.4 * s_strong ELSE 0.18 * s_weak END
          + CASE WHEN money THEN 0.08 ELSE 0 END - CASE WHEN s_weight >= 1 AND s_strong = 0 THEN 0.12 ELSE 0 END
          - CASE WHEN share > 0.98 AND s_id > 0 THEN 0.5 ELSE 0 END - CASE WHEN distinct_count <= 1 THEN 0.4 ELSE 0 END
          - CASE WHEN null_count / rows > 0.3 THEN 0.2 ELSE 0 END
          + CASE WHEN distinct_count > 1 THEN 0.02 * LEAST(1, share * 4) ELSE 0 END)) ELSE 0 END AS target_score
      FROM kinds k JOIN {_SIGNALS} USING (name)),
    ranked AS (SELECT *, row_number() OVER (ORDER BY date_score DESC, position) AS dr,
        row_number() OVER (ORDER BY target_score DESC, position) AS tr FROM scored)"""


@query(
    "column_roles",
    "name:str kind:str date_score:4 target_score:4 role:str",
    f"""WITH {_PROFILE} SELECT name, kind, date_score, target_score,
      CASE WHEN dr = 1 AND date_score >= 0.5 THEN 'time' WHEN tr = 1 THEN 'target'
        WHEN kind = 'categorical' AND distinct_count <= 60 THEN 'dimension'
        WHEN kind = 'numeric' AND s_weight >= 1 THEN 'weight' WHEN kind = 'numeric' THEN 'measure' ELSE 'ignored' END AS role
      FROM ranked""",
)
def column_roles(spark, folder):
    return profile.profile(_sales(spark, folder))


@query(
    "grain_size",
    "series_at_most:int",
    f"""WITH stats AS ({_stats_sql(_SALES_SQL, _SALES_COLUMNS)})
      SELECT CAST(product(distinct_count) AS BIGINT) AS series_at_most FROM stats WHERE name IN ('region', 'status', 'discount_rate')""",
)
def grain_size(spark, folder):
    return profile.grain_size(profile.column_statistics(_sales(spark, folder)), ["region", "status", "discount_rate"])


@query(
    "mixed_measures",
    "column:str labels:int ratio:6 mixed:bool",
    """WITH facts AS (
        SELECT 'price' AS what, l_returnflag AS flag, 'n/a' AS kpi, l_extendedprice AS value FROM lineitem
        UNION ALL SELECT 'units', l_returnflag, 'n/a', l_quantity FROM lineitem),
      tall AS (SELECT 'what' AS col, what AS label, abs(value) AS size FROM facts
        UNION ALL SELECT 'flag', flag, abs(value) FROM facts UNION ALL SELECT 'kpi', kpi, abs(value) FROM facts),
      mids AS (SELECT col, label, quantile_cont(size, 0.5) AS mid FROM tall GROUP BY col, label)
      SELECT col AS "column", COUNT(*) AS labels, CASE WHEN COUNT(*) >= 2 THEN MAX(mid) / MIN(mid) END AS ratio,
        col = 'kpi' OR (COUNT(*) BETWEEN 2 AND 20 AND MAX(mid) / MIN(mid) >= 50) AS mixed FROM mids GROUP BY col""",
)
def mixed_measures(spark, folder):
    rows = table(spark, folder, "lineitem")
    pairs = F.array(
        F.struct(F.lit("price").alias("what"), F.col("l_extendedprice").alias("value")),
        F.struct(F.lit("units").alias("what"), F.col("l_quantity").alias("value")),
    )
    facts = rows.select(F.col("l_returnflag").alias("flag"), F.lit("n/a").alias("kpi"), F.explode(pairs).alias("p")).select(
        "flag", "kpi", "p.*"
    )
    return profile.mixed_measures(facts, "value", ["what", "flag", "kpi"])


_SUPPLIER_MONTHS = f"""(SELECT {trunc_sql('l_shipdate', MONTHLY)} AS month, r_name AS region, n_name AS nation, s_name AS supplier,
    l_linestatus AS status FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY ALL) AS m"""
_DIMENSIONS = ("region", "nation", "supplier", "status")


def _supplier_months(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month"),
        "l_suppkey",
        F.col("l_linestatus").alias("status"),
    )
    places = (
        table(spark, folder, "supplier")
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return (
        rows.distinct()
        .join(places, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            "month",
            F.col("r_name").alias("region"),
            F.col("n_name").alias("nation"),
            F.col("s_name").alias("supplier"),
            "status",
        )
    )


def _key_sql() -> str:
    parts = []
    for subset in profile.key_subsets(_DIMENSIONS):
        keys = ", ".join(["month", *subset])
        series = f"(SELECT COUNT(DISTINCT ({', '.join(subset)},)) FROM {_SUPPLIER_MONTHS})" if subset else "1"
        if len(subset) == 1:
            series = f"(SELECT COUNT(DISTINCT {subset[0]}) FROM {_SUPPLIER_MONTHS})"
        elif subset:
            series = f"(SELECT COUNT(*) FROM (SELECT DISTINCT {', '.join(subset)} FROM {_SUPPLIER_MONTHS}))"
        parts.append(
            f"""SELECT {len(subset)} AS width, '{','.join(subset)}' AS keys, SUM(c - 1) AS duplicate_rows, {series} AS series_count
              FROM (SELECT COUNT(*) AS c FROM {_SUPPLIER_MONTHS} GROUP BY {keys})"""
        )
    return " UNION ALL ".join(parts)


@query("key_search", "width:int keys:str duplicate_rows:int series_count:int", _key_sql())
def key_search(spark, folder):
    found = profile.key_search(_supplier_months(spark, folder), "month", _DIMENSIONS)
    return found.withColumn("keys", F.array_join("keys", ","))


_WIDE = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "year", "quarter", "weekday")
_WIDE_SQL = """(SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey % 5 AS o_orderkey, o_custkey % 7 AS o_custkey, o_orderstatus, o_orderpriority,
    year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, dayofweek(o_orderdate) + 1 AS weekday FROM orders) AS wide"""


@query(
    "key_search_wide",
    "width:int keys:str duplicate_rows:int series_count:int",
    " UNION ALL ".join(
        f"""SELECT {len(s)} AS width, '{','.join(s)}' AS keys, COUNT(*) - COUNT(DISTINCT {'(' + ', '.join(['day', *s]) + ')' if s else 'day'}) AS duplicate_rows,
          {f"COUNT(DISTINCT ({', '.join(s)},))" if s else '1'} AS series_count FROM {_WIDE_SQL}"""
        for s in profile.key_subsets(_WIDE)
    ),
)
def key_search_wide(spark, folder):
    """Seven dimensions: every subset of up to four, and the whole set."""
    day = F.col("o_orderdate").cast("date")
    rows = table(spark, folder, "orders").select(
        day.alias("day"),
        (F.col("o_orderkey") % 5).alias("o_orderkey"),
        (F.col("o_custkey") % 7).alias("o_custkey"),
        "o_orderstatus",
        "o_orderpriority",
        F.year(day).alias("year"),
        F.quarter(day).alias("quarter"),
        F.dayofweek(day).alias("weekday"),
    )
    found = profile.key_search(rows, "day", _WIDE)
    return found.withColumn("keys", F.array_join("keys", ","))


#: Twenty dimensions of a delivered line; it takes two of them to tell lines apart.
_LINES = {
    "orderkey": "l_orderkey", "suppkey": "l_suppkey", "linenumber": "l_linenumber", "quantity": "l_quantity",
    "discount": "l_discount", "tax": "l_tax", "returnflag": "l_returnflag", "linestatus": "l_linestatus",
    "partkey": "l_partkey", "part_class": "l_partkey % 7", "supplier_band": "l_suppkey % 10",
    "supplier_class": "l_suppkey % 3", "order_band": "l_orderkey % 10", "order_class": "l_orderkey % 6",
    "year": "year(l_shipdate)", "quarter": "quarter(l_shipdate)", "month": "month(l_shipdate)",
    "bulk": "l_quantity > 25", "cheap": "l_discount > 0.05", "taxed": "l_tax > 0.04",
}


def _exact_sql() -> str:
    lines = f"SELECT date_trunc('month', l_shipdate) AS ds, {', '.join(f'{e} AS {n}' for n, e in _LINES.items())} FROM lineitem"
    subsets = [s for width in range(3) for s in combinations(_LINES, width)]
    tried = " UNION ALL ".join(
        f"""SELECT {len(s)} AS width, '{','.join(s)}' AS keys, (SELECT COUNT(*) FROM (SELECT DISTINCT {', '.join(['ds', *s])} FROM lines)) AS groups,
          {f"(SELECT COUNT(*) FROM (SELECT DISTINCT {', '.join(s)} FROM lines))" if s else '1'} AS series_count"""
        for s in subsets
    )
    return f"""WITH lines AS MATERIALIZED ({lines}), tried AS ({tried}), exact AS (SELECT * FROM tried WHERE groups = (SELECT COUNT(*) FROM lines))
      SELECT width, keys, 0 AS duplicate_rows, series_count FROM exact WHERE width = (SELECT MIN(width) FROM exact)"""


@query("exact_keys", "width:int keys:str duplicate_rows:int series_count:int", _exact_sql())
def exact_keys(spark, folder):
    """The narrowest of the keys that twenty dimensions offer, width by width."""
    lines = table(spark, folder, "lineitem").select(
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("ds"), *[F.expr(e).alias(n) for n, e in _LINES.items()]
    )
    rows = profile.exact_keys(lines, "ds", list(_LINES))
    found = spark.createDataFrame(rows, "width int, keys array<string>, duplicate_rows long, series_count long")
    return found.withColumn("keys", F.array_join("keys", ","))


@query(
    "key_dependencies",
    "child:str parent:str determined:bool",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS child, '{p}' AS parent, MAX(d) <= 1 AS determined FROM
          (SELECT COUNT(DISTINCT {p}) + MAX(CASE WHEN {p} IS NULL THEN 1 ELSE 0 END) AS d FROM {_SUPPLIER_MONTHS} GROUP BY {c})"""
        for c in _DIMENSIONS
        for p in _DIMENSIONS
        if c != p
    ),
)
def key_dependencies(spark, folder):
    months = _supplier_months(spark, folder)
    out = None
    for child in _DIMENSIONS:
        others = [name for name in _DIMENSIONS if name != child]
        one = profile.dependency(months, [child], others).withColumn("child", F.lit(child))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "resolved_keys",
    "series_keys:str hierarchy:str duplicate_rows:int series_count:int",
    # Suppliers lie in one nation and one region each: month and supplier are
    # the key, and the three levels the hierarchy.
    f"""WITH m AS (SELECT DISTINCT month, region, nation, supplier FROM {_SUPPLIER_MONTHS})
      SELECT CASE WHEN (SELECT COUNT(*) FROM m) = (SELECT COUNT(*) FROM (SELECT DISTINCT month, supplier FROM m))
          THEN 'region,nation,supplier' END AS series_keys,
        'region,nation,supplier' AS hierarchy, 0 AS duplicate_rows, (SELECT COUNT(DISTINCT supplier) FROM m) AS series_count""",
)
def resolved_keys(spark, folder):
    months = _supplier_months(spark, folder).drop("status").distinct()
    found = profile.resolve_keys(months, "month", ["region", "nation", "supplier"])
    row = (",".join(found.series_keys), ",".join(found.hierarchy), found.duplicate_rows, found.series_count)
    return spark.createDataFrame(
        [row], "series_keys string, hierarchy string, duplicate_rows bigint, series_count bigint"
    )


@query(
    "duplicate_keys",
    "repeated:int examples:str",
    """WITH c AS (SELECT CAST(l_shipdate AS DATE) AS d, l_suppkey AS s, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1),
      e AS (SELECT 'shipped=' || d || ' / l_suppkey=' || s || ' x' || n AS t FROM c ORDER BY t LIMIT 5)
      SELECT (SELECT SUM(n - 1) FROM c) AS repeated, (SELECT string_agg(t, '; ' ORDER BY t) FROM e) AS examples""",
)
def duplicate_keys(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_shipdate").cast("date").alias("shipped"), "l_suppkey")
    found = profile.duplicate_keys(rows, "shipped", ["l_suppkey"])
    return found.withColumn("examples", F.array_join("examples", "; "))


@query(
    "history_gate",
    "series:str periods:int required:int",
    f"""SELECT series, periods, 24 AS required FROM (
        SELECT CAST(l_partkey AS VARCHAR) AS series, COUNT(DISTINCT {trunc_sql('l_shipdate', MONTHLY)}) AS periods
        FROM lineitem GROUP BY 1) WHERE periods < 24""",
)
def history_gate(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month"), "l_partkey"
    )
    return profile.history_gate(profile.series_lengths(rows, "month", ["l_partkey"]), MONTHLY)


@query(
    "monotonic_share",
    "ascending:int steps:int share:6",
    """SELECT COUNT(*) FILTER (WHERE d >= p) AS ascending, COUNT(p) AS steps, COUNT(*) FILTER (WHERE d >= p) / COUNT(p) AS share
      FROM (SELECT CAST(o_orderdate AS DATE) AS d, lag(CAST(o_orderdate AS DATE)) OVER (ORDER BY o_orderkey) AS p FROM orders)""",
)
def monotonic_share(spark, folder):
    return profile.monotonic_share(table(spark, folder, "orders"), "o_orderdate", "o_orderkey")


@query(
    "repeat_shares",
    "column:str values:int share:6",
    f"""SELECT 'region' AS "column", COUNT(*) AS "values", AVG(CAST(d > 1 AS INTEGER)) AS share FROM
        (SELECT COUNT(DISTINCT order_date) AS d FROM {_SALES_SQL} GROUP BY region)
      UNION ALL SELECT 'line_id', COUNT(*), AVG(CAST(d > 1 AS INTEGER)) FROM
        (SELECT COUNT(DISTINCT order_date) AS d FROM {_SALES_SQL} GROUP BY line_id)""",
)
def repeat_shares(spark, folder):
    return profile.repeat_shares(_sales(spark, folder), ["region", "line_id"], "order_date")


@query(
    "fill_down",
    "o_orderkey:int label:str",
    """SELECT o_orderkey, last_value(CASE WHEN o_orderkey % 7 = 3 THEN o_orderpriority END IGNORE NULLS)
        OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS label FROM orders""",
)
def fill_down(spark, folder):
    sheet = table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 == 3, F.col("o_orderpriority")).alias("label")
    )
    return reshape.fill_down(sheet, "o_orderkey")


def _wide_sheet(spark, folder):
    """A column for every month of the table."""
    month = F.date_format("l_shipdate", "yyyy-MM-01")
    facts = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", month.alias("m"), "l_extendedprice")
    heading = F.date_format(F.col("m").cast("date"), "MMM yyyy").alias("heading")
    months = {row["m"]: row["heading"] for row in facts.select("m").distinct().orderBy("m").select("m", heading).collect()}
    wide = facts.groupBy("l_returnflag", "l_linestatus").pivot("m", list(months)).sum("l_extendedprice")
    return wide.select(
        "l_returnflag",
        "l_linestatus",
        *[F.concat(F.lit("$"), F.format_number(F.col(f"`{m}`"), 2)).alias(name) for m, name in months.items()],
    )


@query(
    "wide_to_long",
    "l_returnflag:str l_linestatus:str period:date value:1",
    f"""SELECT l_returnflag, l_linestatus, {trunc_sql('l_shipdate', MONTHLY)} AS period, SUM(l_extendedprice) AS value
      FROM lineitem GROUP BY ALL""",
)
def wide_to_long(spark, folder):
    return reshape.unpivot_periods(_wide_sheet(spark, folder)).filter(F.col("value").isNotNull())


@query(
    "promoted_header",
    "region:str nation:str revenue:1",
    """SELECT r_name AS region, n_name AS nation, SUM(l_extendedprice) AS revenue FROM lineitem
      JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      GROUP BY ALL""",
)
def promoted_header(spark, folder):
    from tidemark.plans.panels import supplier_cells

    totals = supplier_cells(spark, folder).groupBy("region", "nation").agg(F.sum("value").alias("v"))
    body = totals.select(
        (F.xxhash64("region", "nation").bitwiseAND(0x7FFFFFFF) + 10).cast("bigint").alias("_row"),
        F.col("region").alias("column_1"),
        F.col("nation").alias("column_2"),
        F.format_number("v", 2).alias("column_3"),
    )
    schema = "_row bigint, column_1 string, column_2 string, column_3 string"
    above = spark.createDataFrame([(1, None, None, None), (2, "region", "nation", "revenue")], schema)
    sheet, _ = reshape.promote_header(above.unionByName(body), "_row")
    return sheet


@query(
    "mapping_proposal",
    "date:str target:str series_keys:str frequency:str aggregation:str warnings:str series_count:int needs_confirmation:bool",
    # A month and supplier table: revenue is the target, supplier the key.
    f"""SELECT 'month' AS date, 'revenue' AS target, 'supplier' AS series_keys, 'monthly' AS frequency, 'sum' AS aggregation,
        '' AS warnings, COUNT(DISTINCT l_suppkey) AS series_count, false AS needs_confirmation FROM lineitem""",
)
def mapping_proposal(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.date_format("l_shipdate", "MMM yyyy").alias("month"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("supplier"),
        "l_extendedprice",
        "l_quantity",
    )
    sheet = rows.groupBy("month", "supplier").agg(
        F.format_number(F.sum("l_extendedprice"), 2).alias("revenue"), F.sum("l_quantity").alias("qty")
    )
    found, _ = profile.propose(sheet)
    row = (
        found.date,
        found.target,
        ",".join(found.series_keys),
        found.frequency,
        found.aggregation,
        ",".join(found.warnings),
        found.series_count,
        found.needs_confirmation,
    )
    return spark.createDataFrame(
        [row],
        "date string, target string, series_keys string, frequency string, aggregation string, warnings string, "
        "series_count bigint, needs_confirmation boolean",
    )


@query(
    "intake_verdict",
    "verdict:str questions:str unreadable:int repeated:int",
    """SELECT 'confirm' AS verdict, 'duplicate_keys' AS questions,
        COUNT(*) FILTER (WHERE l_linenumber = 7) AS unreadable,
        COUNT(*) - COUNT(DISTINCT (CAST(l_shipdate AS DATE), l_returnflag)) AS repeated FROM lineitem""",
)
def intake_verdict(spark, folder):
    raw = table(spark, folder, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("order_date"),
        F.when(F.col("l_linenumber") == 7, "call us").otherwise(F.format_number("l_extendedprice", 2)).alias("revenue"),
        F.col("l_returnflag").alias("flag"),
    )
    typed, parsed, ambiguous = profile.normalise(raw)
    profiled = profile.profile(typed).collect()
    repeated = profile.duplicate_keys(typed, "order_date", ["flag"]).first()["repeated"]
    verdict = profile.intake_verdict(
        profiled,
        row_count=profiled[0]["rows"],
        ambiguous_dates=ambiguous,
        unreadable=profile.unreadable_counts(raw, typed, parsed),
        repeated_rows=repeated,
        frequency="daily",
    )
    row = (verdict["verdict"], ",".join(verdict["questions"]), verdict["quarantined"].get("revenue", 0), repeated)
    return spark.createDataFrame([row], "verdict string, questions string, unreadable bigint, repeated bigint")


@query(
    "preview",
    "o_orderkey:int o_orderstatus:str o_orderpriority:str",
    "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 8",
)
def preview(spark, folder):
    return profile.preview(table(spark, folder, "orders").orderBy("o_orderkey"))


@query(
    "sample_values",
    "name:str place:int value:str",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS name, row_number() OVER (ORDER BY o_orderkey) AS place, CAST(v AS VARCHAR) AS value FROM
          (SELECT o_orderkey, {e} AS v FROM orders WHERE {e} IS NOT NULL ORDER BY o_orderkey LIMIT 5)"""
        for c, e in (("o_custkey", "o_custkey"), ("open", "CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END"))
    ),
)
def sample_values(spark, folder):
    """Five filled values of a column without gaps and of one with many."""
    held = table(spark, folder, "orders").withColumn("open", F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")))
    return profile.sample_values(held, "o_orderkey", ["o_custkey", "open"])


@query(
    "quarantined_values",
    "l_orderkey:int l_linenumber:int l_partkey:int revenue:str",
    "SELECT l_orderkey, l_linenumber, l_partkey, 'call us' AS revenue FROM lineitem WHERE l_linenumber = 7",
)
def quarantined_values(spark, folder):
    from tidemark.functions.text import number_value

    raw = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.when(F.col("l_linenumber") == 7, "call us").otherwise(F.format_number("l_extendedprice", 2)).alias("revenue"),
    )
    return profile.quarantine(raw, number_value(F.col("revenue"), "."), "revenue")


@query(
    "remembered_mapping",
    "fingerprint:str date:str target:str saved_at:int",
    """SELECT fingerprint, date, target, saved_at FROM (
        SELECT 's' || l_suppkey AS fingerprint, CASE WHEN l_suppkey % 3 = 0 THEN 'shipped' ELSE 'ordered' END AS date,
          CASE WHEN l_suppkey % 3 = 0 THEN 'revenue' ELSE 'units' END AS target, CASE WHEN l_suppkey % 3 = 0 THEN 2 ELSE 1 END AS saved_at
        FROM lineitem GROUP BY l_suppkey)""",
)
def remembered_mapping(spark, folder):
    """Mappings by fingerprint: every third one is saved anew."""
    keys = table(spark, folder, "lineitem").select("l_suppkey").distinct()
    digest = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("fingerprint")

    def saved(frame, date, target, at):
        return frame.select(digest, F.lit(date).alias("date"), F.lit(target).alias("target"), F.lit(at).alias("saved_at"))

    store = saved(keys, "ordered", "units", 1)
    return profile.remember_mapping(store, saved(keys.filter("l_suppkey % 3 = 0"), "shipped", "revenue", 2))


@query(
    "intake_findings",
    "kind:str code:str column:str count:int",
    """WITH rows AS (SELECT CAST(l_shipdate AS DATE) AS day, l_partkey % 500 AS part, l_linenumber AS line FROM lineitem),
      n AS (SELECT COUNT(*) AS n, COUNT(*) - COUNT(DISTINCT (day, part)) AS repeated, COUNT(*) FILTER (WHERE line = 7) AS held FROM rows),
      short AS (SELECT COUNT(*) AS short FROM (SELECT part FROM rows GROUP BY part HAVING COUNT(DISTINCT day) < 14)),
      found AS (SELECT 'note' AS kind, 'all_null' AS code, 'comment' AS "column", n AS "count" FROM n
        UNION ALL SELECT 'question', 'duplicate_keys', 'order_date', repeated FROM n
        UNION ALL SELECT 'quarantined', 'unreadable', 'revenue', held FROM n
        UNION ALL SELECT 'gated', 'short_history', NULL, short FROM short)
      SELECT * FROM found WHERE "count" > 0
      UNION ALL SELECT 'verdict', CASE WHEN repeated > 0 THEN 'confirm' ELSE 'proceed' END, NULL, n FROM n""",
)
def intake_findings(spark, folder):
    """All rules over sales by day and part, where one line in seven has no figure."""
    raw = table(spark, folder, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("order_date"),
        F.when(F.col("l_linenumber") == 7, "call us").otherwise(F.format_number("l_extendedprice", 2)).alias("revenue"),
        (F.col("l_partkey") % 500).cast("string").alias("part"),
        F.lit(None).cast("string").alias("comment"),
    )
    return intake.assess(raw, ["part"])

"""Queries that read numbers, dates and layouts back from text.

Each query prints columns of the given tables in the styles people write, reads
them back, and is compared with the columns themselves.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import number_parts, parts_value
from tidemark.operators import coercion
from tidemark.operators.diagnostics import spread_out
from tidemark.plans.catalog import query, table
from tidemark.session import cut_lineage

_SIGNED_SQL = "CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END"
_CENTS_SQL = "round(l_extendedprice * 100)"

#: style: Spark text of how a price is written, label and decimal mark it is
#: read with, and the value in SQL. Indian grouping sets pairs above the last
#: three digits.
_STYLES = {
    "currency": ("concat('$', format_number(price, 2))", "currency", ".", "l_extendedprice"),
    "european": ("translate(format_number(price, 2), ',.', '.,')", "european", ",", "l_extendedprice"),
    "euro": ("concat(translate(format_number(price, 2), ',.', '.,'), ' €')", "european", ",", "l_extendedprice"),
    "french": ("translate(format_number(price, 2), ',.', '\u00a0,')", "european", ",", "l_extendedprice"),
    "accounting": (
        "if(flag = 'R', concat('(', format_number(price, 2), ')'), format_number(price, 2))",
        "accounting", ".", _SIGNED_SQL,
    ),
    "trailing_minus": (
        "if(flag = 'R', concat(format_number(price, 2), '-'), format_number(price, 2))",
        "accounting", ".", _SIGNED_SQL,
    ),
    "percent": ("concat(format_number(price, 2), ' %')", "percent", ".", "l_extendedprice"),
    "unit": ("concat('approx. ', format_number(price, 2), ' kg')", "currency", ".", "l_extendedprice"),
    "grouped": ("format_number(price, 2)", "grouped", ".", "l_extendedprice"),
    "indian": (
        "concat(reverse(regexp_replace(reverse(substring(cents, 1, length(cents) - 3)), '(..)(?=.)', '$1,')),"
        " ',', right(cents, 3))",
        "grouped", ".", _CENTS_SQL,
    ),
    "dots": ("translate(format_number(round(price * 100), 0), ',', '.')", "european", ",", _CENTS_SQL),
    "scientific": ("format_string('%.8e', price)", "grouped", ".", "l_extendedprice"),
}


def _number_sql() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS style, '{label}' AS read_as, '{mark}' AS mark, COUNT(*) AS present, COUNT(*) AS matched,
          SUM({value}) AS total, MIN({value}) AS lowest, MAX({value}) AS highest FROM lineitem"""
        for name, (_, label, mark, value) in _STYLES.items()
    )


@query(
    "read_numbers",
    "style:str read_as:str mark:str present:int matched:int total:1 lowest:2 highest:2",
    _number_sql(),
)
def read_numbers(spark, folder):
    # Few bytes and much computing per row: spread over all tasks.
    lines = spread_out(
        table(spark, folder, "lineitem").select(F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag")),
        ["price", "flag"],
    )
    # Lines of one price and flag write the same texts: read once, weighed by the lines.
    rows = cut_lineage(lines.groupBy("price", "flag").agg(F.count("*").alias("lines")), "prices")
    cents = F.round(F.col("price") * 100).cast("bigint").cast("string")
    texts = rows.withColumn("cents", cents).select("lines", *[F.expr(text).alias(name) for name, (text, *_) in _STYLES.items()])
    names = list(_STYLES)
    how = coercion.read_numbers_how(texts, names, "lines")
    # Out of an array, so that a text is taken apart once for all measures.
    parts = coercion.tall(texts, names, "lines").select(F.col("column").alias("style"), "rows", F.explode(F.array(number_parts(F.col("text")))).alias("parts"))
    comma = F.col("style").isin([n for n, h in how.items() if h.decimal == ","])
    read = F.when(comma, parts_value(F.col("parts"), ",")).otherwise(parts_value(F.col("parts"), "."))
    values = parts.select("style", "rows", F.explode(F.array(read)).alias("value"))
    stats = values.groupBy("style").agg(
        F.sum("rows").alias("present"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("rows")).otherwise(0)).alias("matched"),
        F.sum(F.col("value") * F.col("rows")).alias("total"),
        F.min("value").alias("lowest"),
        F.max("value").alias("highest"),
    )
    label = F.create_map(*[F.lit(x) for n, h in how.items() for x in (n, h.style if h.accepted else "text")])
    mark = F.create_map(*[F.lit(x) for n, h in how.items() for x in (n, h.decimal)])
    return stats.withColumn("read_as", label[F.col("style")]).withColumn("mark", mark[F.col("style")])


@query(
    "decimal_marks",
    "style:str cores:int comma_last:int dot_last:int comma_only:int dot_only:int comma_grouped:int dot_grouped:int",
    """SELECT 'comma' AS style, COUNT(*) AS cores, 0 AS comma_last, 0 AS dot_last, COUNT(*) AS comma_only, 0 AS dot_only,
        0 AS comma_grouped, 0 AS dot_grouped FROM lineitem
      UNION ALL SELECT 'grouped', COUNT(*), 0, COUNT(*) FILTER (WHERE l_extendedprice >= 999.995), 0,
        COUNT(*) FILTER (WHERE l_extendedprice < 999.995), 0, 0 FROM lineitem""",
)
def decimal_marks(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_extendedprice").alias("price"))
    texts = rows.select(
        F.translate(F.col("price").cast("decimal(12,2)").cast("string"), ".", ",").alias("comma"),
        F.format_number("price", 2).alias("grouped"),
    )
    return coercion.number_evidence(texts, ["comma", "grouped"]).withColumnRenamed("column", "style")


_DAY = "CAST(l_shipdate AS DATE)"
#: layout: Spark pattern, label expected, SQL of the date read back
_DATES = {
    "iso": ("yyyy-MM-dd", "YYYY-MM-DD", _DAY),
    "slashed": ("yyyy/M/d", "YYYY/MM/DD", _DAY),
    "dotted": ("yyyy.MM.dd", "YYYY.MM.DD", _DAY),
    "stamp": ("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "ISO timestamp", _DAY),
    "spaced": ("yyyy-MM-dd HH:mm:ss'+05:30'", "ISO timestamp", _DAY),
    "month": ("yyyy-MM", "YYYY-MM", "CAST(date_trunc('month', l_shipdate) AS DATE)"),
    "compact": ("yyyyMMdd", "YYYYMMDD", _DAY),
    "day_mon": ("d MMM yyyy", "DD Mon YYYY", _DAY),
    "day_month": ("dd MMMM yyyy", "DD Month YYYY", _DAY),
    "mon_day": ("MMM d, yyyy", "Mon DD, YYYY", _DAY),
    "month_day": ("MMMM d, yyyy", "Month DD, YYYY", _DAY),
    "mon_day_plain": ("MMM dd yyyy", "Mon DD YYYY", _DAY),
    "mon_year": ("MMM yyyy", "Mon YYYY", "CAST(date_trunc('month', l_shipdate) AS DATE)"),
    "month_year": ("MMMM yyyy", "Month YYYY", "CAST(date_trunc('month', l_shipdate) AS DATE)"),
    "day_first": ("dd/MM/yyyy", "DD/MM/YYYY", _DAY),
    "month_first": ("M/d/yyyy", "MM/DD/YYYY", _DAY),
    "day_first_dash": ("dd-MM-yyyy", "DD/MM/YYYY", _DAY),
    "short_year": ("d.M.yy", "DD/MM/YYYY", _DAY),
}
_SPECIAL = {
    "mixed": ("mixed formats", _DAY),
    "quarter": ("YYYYQn", "CAST(date_trunc('quarter', l_shipdate) AS DATE)"),
    "quarter_first": ("YYYYQn", "CAST(date_trunc('quarter', l_shipdate) AS DATE)"),
    "week": ("ISO week", "CAST(date_trunc('week', l_shipdate) AS DATE)"),
    "fiscal": ("fiscal period", "CAST(date_trunc('month', l_shipdate) AS DATE)"),
    "first_of_month": ("MM/DD/YYYY", "CAST(date_trunc('month', l_shipdate) AS DATE)"),
}


def _date_sql() -> str:
    parts = [(name, label, value) for name, (_, label, value) in _DATES.items()]
    parts += [(name, label, value) for name, (label, value) in _SPECIAL.items()]
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS style, '{label}' AS read_as, false AS ambiguous, COUNT(*) AS present, COUNT(*) AS matched,
          MIN({value}) AS earliest, MAX({value}) AS latest, SUM(date_diff('day', DATE '1970-01-01', {value})) AS day_sum
          FROM lineitem"""
        for name, label, value in parts
    )


@query(
    "read_dates",
    "style:str read_as:str ambiguous:bool present:int matched:int earliest:date latest:date day_sum:int",
    _date_sql(),
)
def read_dates(spark, folder):
    day = F.col("day")
    year, quarter = F.year(day).cast("string"), F.quarter(day).cast("string")
    iso_year = F.year(F.date_add(F.trunc(day, "week"), 3)).cast("string")
    # Fiscal years here open in April and carry the year they open in.
    opening = F.add_months(day, -3)
    special = {
        "mixed": F.when(F.col("key") % 2 == 0, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "dd/MM/yyyy")),
        "quarter": F.concat(year, F.lit("-Q"), quarter),
        "quarter_first": F.concat(F.lit("Q"), quarter, F.lit(" "), year),
        "week": F.concat(iso_year, F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0")),
        "fiscal": F.concat(F.lit("FY"), F.date_format(opening, "yyyy"), F.lit("-P"), F.month(opening).cast("string")),
        "first_of_month": F.date_format(F.trunc(day, "month"), "MM/dd/yyyy"),
    }
    rows = spread_out(
        table(spark, folder, "lineitem").select(
            F.col("l_shipdate").cast("date").alias("day"), F.col("l_orderkey").alias("key")
        ),
        ["key"],
    )
    texts = rows.select(
        *[F.date_format("day", pattern).alias(name) for name, (pattern, *_) in _DATES.items()],
        *[value.alias(name) for name, value in special.items()],
    )
    names = texts.columns
    # Each text is read once, weighed by the rows that hold it.
    counts = cut_lineage(coercion.text_counts(texts, names), "texts")
    how = coercion.read_dates_how(texts, names, counts=counts)
    read = F.coalesce(*[F.when(F.col("column") == name, reading.value(F.col("text"), 4)) for name, reading in how.items()])
    # Out of an array, so that the measures below do not each hold all the readers.
    days = counts.select(F.col("column").alias("style"), "rows", F.explode(F.array(read)).alias("day"))
    stats = days.groupBy("style").agg(
        F.sum("rows").alias("present"),
        F.sum(F.when(F.col("day").isNotNull(), F.col("rows")).otherwise(0)).alias("matched"),
        F.min("day").alias("earliest"),
        F.max("day").alias("latest"),
        F.sum(F.unix_date("day") * F.col("rows")).alias("day_sum"),
    )
    label = F.create_map(*[F.lit(x) for n in names for x in (n, how[n].label if n in how else "text")])
    doubt = F.create_map(*[F.lit(x) for n in names for x in (n, n in how and how[n].ambiguous)])
    return stats.withColumn("read_as", label[F.col("style")]).withColumn("ambiguous", doubt[F.col("style")])


@query(
    "read_numeric_dates",
    "column:str reads_as:str present:int earliest:date latest:date",
    """SELECT 'ymd' AS "column", 'YYYYMMDD' AS reads_as, COUNT(*) AS present, MIN(CAST(o_orderdate AS DATE)) AS earliest,
        MAX(CAST(o_orderdate AS DATE)) AS latest FROM orders
      UNION ALL SELECT 'serial_date', 'Excel serial', COUNT(*), MIN(CAST(o_orderdate AS DATE)), MAX(CAST(o_orderdate AS DATE)) FROM orders
      UNION ALL SELECT 'unix_time', 'Unix seconds', COUNT(*), MIN(CAST(o_orderdate AS DATE)), MAX(CAST(o_orderdate AS DATE)) FROM orders
      UNION ALL SELECT 'revenue', NULL, COUNT(*), NULL, NULL FROM orders""",
)
def read_numeric_dates(spark, folder):
    day = F.col("o_orderdate").cast("date")
    rows = table(spark, folder, "orders").select(
        F.date_format(day, "yyyyMMdd").cast("bigint").alias("ymd"),
        (F.unix_date(day) + 25569).alias("serial_date"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("unix_time"),
        F.col("o_totalprice").alias("revenue"),
    )
    how = {r["column"]: r["reads_as"] for r in coercion.numeric_dates_how(rows, rows.columns).collect()}
    pairs = [
        F.struct(
            F.lit(n).alias("column"),
            F.lit(how[n]).cast("string").alias("reads_as"),
            (coercion.numeric_date(F.col(n), how[n]) if how[n] else F.lit(None).cast("date")).alias("d"),
        )
        for n in rows.columns
    ]
    tall = rows.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    return tall.groupBy("column", "reads_as").agg(
        F.count("*").alias("present"), F.min("d").alias("earliest"), F.max("d").alias("latest")
    )

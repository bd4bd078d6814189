"""Delimited text: find out how it is written, check it, read it.

A few lines off the top settle delimiter and header, all lines the encoding and
whether values run over line breaks; the whole text is then checked for rows
wider than the header and read by Spark.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import col
from tidemark.functions.text import without_null_tokens
from tidemark.operators.coercion import read_numbers, text_columns
from tidemark.operators.reshape import clean_headers, drop_empty_rows

# ---- Fixed values ----------------------------------------------------------
DELIMITERS = (",", ";", "\t", "|")
SAMPLE_LINES = 50
VOTE_LINES = 20
PREAMBLE_LINES = 14
#: Spark reads Latin-1 but not its Windows superset, whose extra characters
#: are put in place afterwards.
_SPARK_ENCODING = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp1252": "ISO-8859-1", "latin-1": "ISO-8859-1"}
_EXTRA = [(chr(code), bytes([code]).decode("cp1252", "ignore")) for code in range(0x80, 0xA0)]
#: Bytes that the Windows superset leaves open.
_UNKNOWN = "".join(control for control, shown in _EXTRA if not shown)
_QUOTED = re.compile(r'"[^"]*"')


@dataclass(frozen=True)
class Dialect:
    delimiter: str
    header_line: int
    encoding: str
    names: tuple[str, ...]


def separators_outside_quotes(line: str, delimiter: str) -> int:
    return _QUOTED.sub("", line).count(delimiter)


def sniff_delimiter(lines: list[str]) -> str:
    """The delimiter on whose count most of the first filled lines agree; of two
    that tie, the one that makes more columns."""
    filled = [line for line in lines if line.strip()][:VOTE_LINES]
    best, chosen = (0, 0), ","
    for delimiter in DELIMITERS:
        tally = Counter(filter(None, (separators_outside_quotes(line, delimiter) for line in filled)))
        for found, agreed in tally.most_common(1):
            if (agreed, found) > best:
                best, chosen = (agreed, found), delimiter
    return chosen


def header_line(lines: list[str], delimiter: str) -> int:
    """The place of the first line that splits like the filled line below it."""
    counts = [separators_outside_quotes(line, delimiter) if line.strip() else None for line in lines[:PREAMBLE_LINES]]
    below = [next((n for n in counts[i + 1 : i + 4] if n is not None), None) for i in range(len(counts))]
    return next((i for i, n in enumerate(counts) if n and n == below[i]), 0)


def fields_of(line: Column, delimiter: str) -> Column:
    bare = F.regexp_replace(line, r'"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1


@dataclass(frozen=True)
class Findings:
    """What only a look at every line can settle."""

    encoding: str
    #: Lines that open or close a quoted value without closing or opening it.
    open_quotes: int


def inspect(spark: SparkSession, path: str) -> Findings:
    """Encoding and open quotes, from all lines in one aggregate.

    Lines are taken as the bytes they are: UTF-8 if every line is, else the
    Windows superset of Latin-1 unless some line has a byte it does not know.
    """
    raw = F.col("value").cast("binary")
    shown = F.decode(raw, "ISO-8859-1")
    row = (
        spark.read.text(path)
        .agg(
            F.coalesce(F.bool_and(F.is_valid_utf8(F.col("value"))), F.lit(True)).alias("utf8"),
            F.coalesce(F.bool_or(shown.rlike(f"[{_UNKNOWN}]")), F.lit(False)).alias("unknown"),
            F.coalesce(F.bool_or(F.substring(raw, 1, 3) == F.lit(b"\xef\xbb\xbf")), F.lit(False)).alias("marked"),
            F.count_if(F.length(F.regexp_replace(shown, '[^"]', "")) % 2 == 1).alias("open_quotes"),
        )
        .first()
    )
    known = ("utf-8-sig" if row["marked"] else "utf-8") if row["utf8"] else "latin-1" if row["unknown"] else "cp1252"
    return Findings(known, row["open_quotes"])


def sniff(spark: SparkSession, path: str, *, delimiter: str | None = None, findings: Findings | None = None) -> Dialect:
    """Delimiter and header from the first lines, the encoding from all of them."""
    head = spark.read.text(path).select(F.col("value").cast("binary").alias("b")).limit(SAMPLE_LINES).collect()
    if not head:
        raise ValueError("The file holds no data.")
    encoding = (findings or inspect(spark, path)).encoding
    content = b"\n".join(bytes(row["b"]) for row in head)
    lines = content.decode(encoding, errors="replace").lstrip("\ufeff").split("\n")
    chosen = delimiter or sniff_delimiter(lines)
    place = header_line(lines, chosen)
    header = spark.createDataFrame([(lines[place],)], "line string")
    width = separators_outside_quotes(lines[place], chosen) + 1
    fields = ", ".join(f"c{i} string" for i in range(width))
    parsed = header.select(F.from_csv("line", fields, {"sep": chosen}).alias("c")).first()["c"]
    names = clean_headers([("" if value is None else value) for value in parsed])
    return Dialect(chosen, place, encoding, tuple(names))


def _reader(spark: SparkSession, dialect: Dialect, schema: T.StructType, over_lines: bool) -> DataFrameReader:
    return (
        spark.read.schema(schema)
        .option("sep", dialect.delimiter)
        .option("encoding", _SPARK_ENCODING[dialect.encoding])
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("escape", '"')
        .option("multiLine", over_lines)
    )


def ragged_rows(spark: SparkSession, path: str, dialect: Dialect, *, over_lines: bool = False) -> int:
    """Rows with more fields than the header has columns.

    Where quoted values run over line breaks, a row is the record the reader
    makes of its lines, counted as it was written.
    """
    width = len(dialect.names)
    if over_lines:
        schema = T.StructType([*_text_schema(width), T.StructField("_record", T.StringType())])
        read = _reader(spark, dialect, schema, True).option("columnNameOfCorruptRecord", "_record").option("header", False)
        # Only records of another width are kept as written; all columns are
        # read, or the reader would not look at them.
        odd = read.csv(path).select(F.concat_ws("", *[F.col(f"c{i}") for i in range(width)]).alias("_all"), "_record")
        wider = F.count_if(F.col("_record").isNotNull() & (fields_of(F.col("_record"), dialect.delimiter) > width))
        return odd.agg(wider.alias("wider"), F.max(F.length("_all"))).first()["wider"]
    lines = spark.read.text(path)
    return lines.filter(F.trim("value") != "").agg(
        F.count_if(fields_of(F.col("value"), dialect.delimiter) > width)
    ).first()[0]


def _text_schema(width: int) -> T.StructType:
    return T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])


def read_delimited(spark: SparkSession, path: str, *, delimiter: str | None = None, infer: bool = True) -> DataFrame:
    """A delimited file or folder as a typed table.

    Rows wider than the header are refused with their number, never cut. A line
    break inside quotes belongs to its value. A sheet with titles above its
    header must be one file without such breaks, since its lines are told apart
    by their place.
    """
    findings = inspect(spark, path)
    dialect = sniff(spark, path, delimiter=delimiter, findings=findings)
    over_lines = findings.open_quotes > 0
    if dialect.header_line and over_lines:
        raise ValueError(f"{findings.open_quotes} line(s) open or close a quoted value that runs over a line break, below a title.")
    if dialect.header_line and len(spark.read.text(path).inputFiles()) > 1:
        raise ValueError("Several files with titles above their headers cannot be read as one table.")
    ragged = ragged_rows(spark, path, dialect, over_lines=over_lines)
    if ragged:
        raise ValueError(f"{ragged} row(s) hold more values than the header has columns.")
    schema = _text_schema(len(dialect.names))
    if dialect.header_line == 0:
        rows = _reader(spark, dialect, schema, over_lines).option("header", True).csv(path)
    else:
        # Titles stand above the header: what lies below it is kept, by the
        # byte order the reader gives within the one file such sheets are.
        value = F.decode(F.col("value").cast("binary"), _SPARK_ENCODING[dialect.encoding]).alias("value")
        numbered = spark.read.text(path).select(value, F.monotonically_increasing_id().alias("_line"))
        body = numbered.filter((F.col("_line") > dialect.header_line) & (F.trim("value") != ""))
        parsed = F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), {"sep": dialect.delimiter, "escape": '"'})
        rows = body.select(parsed.alias("c")).select("c.*")
    if dialect.encoding == "cp1252":
        held = [(control, shown) for control, shown in _EXTRA if shown]
        found, put = "".join(c for c, _ in held), "".join(s for _, s in held)
        rows = rows.select(*[F.translate(c, found, put).alias(c) for c in rows.columns])
    named = rows.toDF(*dialect.names)
    cleaned = drop_empty_rows(named.select(*[without_null_tokens(col(n)).alias(n) for n in named.columns]))
    if not infer:
        return cleaned
    typed, _ = read_numbers(cleaned, text_columns(cleaned))
    return typed

"""Files, records, guards, stored tables and streams."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources import database, delimited, records, store
from tidemark.streaming import actuals, periods, suppression

ROWS = [(f"2024-{m:02d}-01", 100 + m) for m in range(1, 13)]


def written(tmp_path, lines, encoding="utf-8", name="sales.csv"):
    path = tmp_path / name
    path.write_bytes("\n".join(lines).encode(encoding))
    return str(path)


def body(mark=","):
    return [f"date{mark}revenue", *[f"{d}{mark}{v}" for d, v in ROWS]]


@pytest.mark.parametrize("mark", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, mark):
    frame = delimited.read_delimited(spark, written(tmp_path, body(mark)))
    assert frame.columns == ["date", "revenue"] and frame.count() == 12
    assert frame.agg(F.sum("revenue")).first()[0] == sum(v for _, v in ROWS)


@pytest.mark.parametrize("encoding", ["utf-8-sig", "cp1252", "latin-1"])
def test_encodings(spark, tmp_path, encoding):
    lines = [line.replace("revenue", "Umsätze") for line in body()]
    frame = delimited.read_delimited(spark, written(tmp_path, lines, encoding))
    assert frame.columns == ["date", "Umsätze"] and frame.count() == 12


def test_title_above_the_header_and_blank_lines(spark, tmp_path):
    frame = delimited.read_delimited(spark, written(tmp_path, ["Monthly Sales Report", "", *body(), "", ""]))
    assert frame.columns == ["date", "revenue"] and frame.count() == 12


def test_quoted_delimiter_and_null_tokens(spark, tmp_path):
    lines = ["name,revenue", '"Smith, John",10', '"Doe, Jane",N/A', "Solo,30", "Trio,40", "Quart,50"]
    rows = delimited.read_delimited(spark, written(tmp_path, lines)).collect()
    assert rows[0]["name"] == "Smith, John" and rows[1]["revenue"] is None


def test_wide_rows_are_refused_with_their_number(spark, tmp_path):
    with pytest.raises(ValueError, match="2 row"):
        delimited.read_delimited(spark, written(tmp_path, [*body(), "2025-01-01,5,6", "2025-02-01,5,6,7"]))


def test_records(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('{"data": {"items": [{"a": 1, "tags": ["x"]}, {"a": 2, "tags": []}]}}\n')
    rows = records.read_records(spark, str(path)).orderBy("a").collect()
    assert [(r["a"], r["tags"]) for r in rows] == [(1, '["x"]'), (2, "[]")]
    with pytest.raises(ValueError):
        records.read_records(spark, str(path), records="data.missing")


@pytest.mark.parametrize(
    "text", ["DROP TABLE x", "SELECT 1; SELECT 2", "WITH a AS (DELETE FROM b) SELECT 1", "update t set a = 1", "explain select 1"]
)
def test_only_reading_statements(text):
    with pytest.raises(ValueError):
        database.check_query(text)


def test_reading_statements_pass():
    assert database.check_query("SELECT 'drop; it' FROM t;") == "SELECT 'drop; it' FROM t"
    assert database.check_query("with a as (select 1) select * from a") == "with a as (select 1) select * from a"


def test_catalog_listing(spark):
    columns = spark.createDataFrame(
        [("public", "sales", "day", "date", "NO", 1), ("public", "sales", "y", "double", "YES", 2), ("pg_catalog", "x", "a", "int", "NO", 1)],
        "table_schema string, table_name string, column_name string, data_type string, is_nullable string, ordinal_position int",
    )
    rows = database.list_tables(columns).collect()
    assert len(rows) == 1 and [(c["name"], c["nullable"]) for c in rows[0]["columns"]] == [("day", False), ("y", True)]


def test_issued_rows_are_never_rewritten(spark, tmp_path):
    path = str(tmp_path / "points")
    run = spark.createDataFrame([("r1", 1.0)], "run_id string, y double")
    store.append_run(run, path)
    with pytest.raises(ValueError):
        store.append_run(run, path)
    store.append_run(run.withColumn("run_id", F.lit("r2")), path)
    assert store.read_table(spark, path).count() == 2 and set(store.columns_of(spark, path)) == {"run_id", "y"}
    with pytest.raises(ValueError):
        store.read_source(spark, "carrier pigeon", path)


def test_an_open_period_stays_back(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [("a", f"2024-01-{d:02d} 12:00:00", 1.0) for d in range(1, 11)]
    frame = spark.createDataFrame(rows, "k string, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    frame.write.parquet(path)
    totals = periods.running_totals(periods.file_stream(spark, path, frame.schema), "ts", "v", "daily", keys=["k"])
    days = [r["period"].day for r in periods.settle_available(totals).orderBy("period").collect()]
    assert days == list(range(1, 9))


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "log")

    def batch(value, day):
        row = spark.createDataFrame([("k", "2024-01-01", value, f"2024-02-0{day} 00:00:00")], "series_key string, target_date string, value double, revised_at string")
        return row.select("series_key", F.col("target_date").cast("date"), "value", F.col("revised_at").cast("timestamp"))

    for batch_id, value, day in ((0, 1.0, 1), (1, 1.0, 2), (2, 3.0, 3), (2, 3.0, 3)):
        actuals.append_readings(batch(value, day), batch_id, path)
    log = actuals.read_log(spark, path)
    assert sorted((r["value"], r["revised_at"].day) for r in log.collect()) == [(1.0, 1), (3.0, 3)]


def test_encoding_is_settled_by_all_lines(spark, tmp_path):
    lines = ["day,shop", *[f"2024-01-{1 + i % 28:02d},shop {i}" for i in range(200)], "2024-02-01,café"]
    frame = delimited.read_delimited(spark, written(tmp_path, lines, "cp1252"))
    assert frame.filter(F.col("shop") == "café").count() == 1


def test_quoted_line_breaks_belong_to_their_value(spark, tmp_path):
    lines = ["key,n,note", 'a,1,"one\ntwo, ""three"""', "b,2,plain", 'c,3,"x\n\ny"']
    rows = delimited.read_delimited(spark, written(tmp_path, lines)).orderBy("key").collect()
    assert [(row["key"], row["note"]) for row in rows] == [("a", 'one\ntwo, "three"'), ("b", "plain"), ("c", "x\n\ny")]
    with pytest.raises(ValueError, match="1 row"):
        delimited.read_delimited(spark, written(tmp_path, [*lines, "d,4,x,y"], name="wide.csv"))


def test_titles_stand_above_one_file_without_breaks(spark, tmp_path):
    folder = tmp_path / "sheets"
    folder.mkdir()
    for name in ("a.csv", "b.csv"):
        written(folder, ["Monthly Sales Report", "", *body()], name=name)
    with pytest.raises(ValueError, match="Several files"):
        delimited.read_delimited(spark, str(folder))
    with pytest.raises(ValueError, match="below a title"):
        delimited.read_delimited(spark, written(tmp_path, ["Sales Report", "", *body(), '"2025-01-01\n",5'], name="open.csv"))


def test_readings_do_not_depend_on_their_batches(spark, tmp_path):
    day = "2024-01-01"
    said = [("a", day, 1200.0, "2024-02-09 00:00:00"), ("a", day, 1340.0, "2024-03-09 00:00:00"), ("a", day, 1340.0, "2024-04-09 00:00:00"), ("a", day, 1300.0, "2024-03-20 00:00:00")]
    frame = spark.createDataFrame(said, "series_key string, target_date string, value double, revised_at string")
    frame = frame.withColumns({"target_date": F.col("target_date").cast("date"), "revised_at": F.col("revised_at").cast("timestamp")})
    logs = []
    for split in ([frame], [frame.limit(1), frame.subtract(frame.limit(1))], [frame.filter("value > 1300"), frame.filter("value <= 1300"), frame]):
        path = str(tmp_path / f"log{len(logs)}")
        for number, batch in enumerate(split):
            actuals.append_readings(batch, number, path)
            actuals.append_readings(batch, number, path)
        logs.append(sorted((row.value, str(row.revised_at)) for row in actuals.read_log(spark, path).collect()))
    assert logs[0] == logs[1] == logs[2] and len(logs[0]) == 4


def test_sources_fit_by_their_footers(spark, tmp_path):
    from datetime import date

    from pyspark.sql import functions as F

    from tidemark.sources import store

    days = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-03-31')) AS day").withColumn("price", F.lit(1.0))
    paths = {name: str(tmp_path / name) for name in ("whole", "short", "lacking", "empty")}
    store.write_table(days, paths["whole"])
    store.write_table(days.filter("day < DATE '2024-02-01'"), paths["short"])
    store.write_table(days.drop("price"), paths["lacking"])
    store.write_table(days.limit(0), paths["empty"])
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    assert store.fitting_sources(spark, paths, ["price"], "day", date(2024, 2, 1)) == ["whole"]
    assert store.reach_of(spark, paths["short"], "day") == date(2024, 1, 31)
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before


def test_changes_are_told_in_order_over_restarts(spark, tmp_path):
    """Late readings, ties, nulls and repeats, in three runs of one stream."""
    from datetime import date, datetime, timedelta

    start, day = datetime(2024, 1, 1), date(2023, 12, 1)
    schema = "series_key string, target_date date, value double, revised_at timestamp"

    def at(n):
        return start + timedelta(days=n, microseconds=n)

    runs = [
        [("a", 1.0, 0), ("a", 1.0, 4), ("b", None, 3), (None, 5.0, 1), ("a", 1.0, 0)],
        [("a", 2.0, 2), ("b", 7.0, 4), ("b", 6.0, 4), ("a", 2.0, 6), ("b", None, 5)],
        [("c", 0.0, 40), ("a", 2.0, 7)],
    ]
    path, told, state = (str(tmp_path / name) for name in ("in", "told", "state"))
    rows = []
    for place, run in enumerate(runs):
        batch = [(key, day, value, at(n)) for key, value, n in run]
        rows += batch
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{path}/run-{place}")
        stream = spark.readStream.schema(schema).parquet(f"{path}/run-*")
        suppression.issue_available(stream, told, state, late="3 days")
    found = spark.read.schema(schema).parquet(told)
    want = actuals.changes(spark.createDataFrame(rows, schema)).filter("series_key IS NULL OR series_key <> 'c'")
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and found.count() == 9


def test_a_value_in_force_expires_only_if_asked(spark, tmp_path):
    from datetime import date, datetime

    schema = "series_key string, target_date date, value double, revised_at timestamp"
    for held, count in ((None, 1), (5, 2)):
        path, told, state = (str(tmp_path / f"{name}{held}") for name in ("in", "told", "state"))
        for place, (key, month) in enumerate([("a", 1), ("z", 3), ("a", 4), ("z", 6)]):
            batch = [(key, date(2023, 12, 1), 1.0, datetime(2024, month, 1))]
            spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{path}/run-{place}")
            stream = spark.readStream.schema(schema).parquet(f"{path}/run-*")
            suppression.issue_available(stream, told, state, late="1 day", held_days=held)
        assert spark.read.schema(schema).parquet(told).filter("series_key = 'a'").count() == count

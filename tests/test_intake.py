"""All rules of the intake, each on a table that breaks it."""

from datetime import date, timedelta

from tidemark.operators.intake import assess


def findings(frame, dimensions=()):
    return {(row.kind, row.code, row.column): row["count"] for row in assess(frame, dimensions).collect()}


def daily(n, **columns):
    return [(str(date(2024, 1, 1) + timedelta(days=i)), *(make(i) for make in columns.values())) for i in range(n)]


def test_a_sound_table_proceeds(spark):
    frame = spark.createDataFrame(daily(60, revenue=lambda i: 100.0 + i, sku=lambda i: "a"), "order_date string, revenue double, sku string")
    assert findings(frame, ["sku"]) == {("verdict", "proceed", None): 60}


def test_every_rule_has_its_row(spark):
    rows = daily(40, revenue=lambda i: "n/k" if i % 10 == 0 else f"{100 + i}.5", sku=lambda i: "a" if i < 35 else "b", note=lambda i: None)
    rows += rows[:3]
    frame = spark.createDataFrame(rows, "order_date string, revenue string, sku string, note string")
    got = findings(frame, ["sku"])
    assert got["verdict", "confirm", None] == 43 and got["question", "duplicate_keys", "order_date"] == 3
    assert got["note", "all_null", "note"] == 43 and got["gated", "short_history", None] == 1
    assert got["quarantined", "unreadable", "revenue"] == 5


def test_a_column_of_several_measures_is_asked_about(spark):
    rows = [(str(date(2024, 1, 1) + timedelta(days=i)), 10.0 + i if kind == "units" else 1e6 + i, kind) for i in range(40) for kind in ("units", "revenue")]
    got = findings(spark.createDataFrame(rows, "order_date string, amount double, measure string"), ["measure"])
    assert got["question", "mixed_measures", "measure"] == 2 and ("verdict", "confirm", None) in got


def test_what_cannot_be_forecast_is_refused(spark):
    assert ("refusal", "no_dates", None) in findings(spark.createDataFrame([(1.5, 2.5), (2.5, 1.0)], "a double, b double"))
    got = findings(spark.createDataFrame([], "order_date date, revenue double"))
    assert ("refusal", "no_rows", None) in got and ("verdict", "refuse", None) in got


def test_the_rules_do_not_read_the_raw_rows_again(spark):
    """The raw rows are passed to find out how they are written, to read them, and to
    count what they hold; the rules ask what was read."""
    made = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = daily(50, revenue=lambda i: "n/k" if i == 3 else f"{100 + i}.5", sku=lambda i: "a")
    raw = spark.createDataFrame(rows, "order_date string, revenue string, sku string")
    got = findings(raw.mapInArrow(pass_on, raw.schema), ["sku"])
    assert got["quarantined", "unreadable", "revenue"] == 1 and got["verdict", "proceed", None] == 50
    assert made.value <= 5 * 50


def test_a_column_without_a_type_is_told(spark):
    frame = spark.createDataFrame(daily(60, revenue=lambda i: 100.0 + i), "order_date string, revenue double").selectExpr("*", "NULL AS note")
    assert findings(frame)["verdict", "proceed", None] == 60

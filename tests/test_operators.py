"""Aggregation, calendars, validation, reading and profiles on small tables."""

from datetime import date, timedelta
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregate, calendar, canonical, coercion, profile, reshape, validation
from tidemark.operators.preparation import fill_gaps, prepare, winsorise


def month(i, start=date(2021, 1, 1)):
    return date(start.year + (start.month - 1 + i) // 12, (start.month - 1 + i) % 12 + 1, 1)


@pytest.fixture(scope="module")
def sales(spark):
    rows = [(month(i), f"s{k}", None if k == 9 else f"r{k % 2}", float(10 * (k + 1))) for i in range(30) for k in range(20)]
    return spark.createDataFrame(rows, "day date, sku string, region string, units double")


def total(frame, column="value"):
    return frame.agg(F.sum(column)).first()[0]


def test_pooling_conserves_the_total(spark, sales):
    cells = aggregate.grouped_cells(sales, "day", "units", ["sku"], "monthly")
    bounded = aggregate.bound_keys(cells, ["k0"], "monthly", max_series=5)
    assert total(bounded) == total(cells)
    pooled = bounded.filter("pooled").select("k0", "pooled_from").distinct().collect()
    assert [tuple(r) for r in pooled] == [("(others)", 16)]
    series = aggregate.grouped_series(cells, ["k0"], "monthly", max_series=5).collect()
    assert len(series) == 5 and {r["label"] for r in series} >= {"s19", "Others"}


def test_without_a_bound_no_series_is_pooled(spark, sales):
    cells = aggregate.grouped_cells(sales, "day", "units", ["sku"], "monthly")
    whole = aggregate.bound_keys(cells, ["k0"], "monthly", max_series=None)
    bounded = aggregate.bound_keys(cells, ["k0"], "monthly", max_series=10_000)
    assert whole.dtypes == bounded.dtypes and whole.filter("pooled").isEmpty()
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, bounded.collect()))


def test_null_keys_are_named_or_left_out(spark, sales):
    grouped = aggregate.grouped_cells(sales, "day", "units", ["region"], "monthly")
    assert {r["k0"] for r in grouped.select("k0").distinct().collect()} == {"(none)", "r0", "r1"}
    segments = aggregate.segment_cells(sales, "day", "units", "region", "monthly")
    assert {r["label"] for r in segments.select("label").distinct().collect()} == {"r0", "r1"}


def test_others_survives_a_missing_member(spark):
    rows = [(month(i), f"s{k:02d}", 1.0) for i in range(4) for k in range(14) if not (k == 13 and i == 0)]
    frame = spark.createDataFrame(rows, "day date, seg string, y double")
    cells = aggregate.segment_cells(frame, "day", "y", "seg", "monthly")
    series = aggregate.segment_series(cells, "monthly").filter("label = 'Others'").orderBy("period").collect()
    assert [r["value"] for r in series] == [2.0, 3.0, 3.0, 3.0]


def test_unreadable_rows_are_counted_not_raised(spark):
    frame = spark.createDataFrame([("2024-01-05", "3"), ("soon", "4"), ("2024-01-09", "x")], "d string, v string")
    row = aggregate.scan_counts(frame, "d", "v", "monthly").first()
    assert tuple(row) == (3, 1, 0)


def test_odd_column_names(spark):
    frame = spark.createDataFrame([(date(2024, 1, 5), "a", 2.0)], "d date, k string, v double").toDF("when?", "a `b`", "net.total")
    assert aggregate.aggregate_series(frame.withColumnRenamed("net.total", "net total"), "when?", "net total", "monthly").first()["value"] == 2.0
    with pytest.raises(ValueError):
        aggregate.aggregate_series(frame, "nope", "a `b`", "monthly")


def test_alignment_leaves_holes(spark):
    frame = spark.createDataFrame(
        [("a", month(0), 1.0), ("a", month(3), 4.0), ("b", month(1), 5.0)], "series_id string, ds date, y double"
    )
    rows = calendar.align_calendar(frame, "monthly").orderBy("series_id", "t").collect()
    assert [(r["series_id"], r["t"], r["n"], r["y"]) for r in rows] == [
        ("a", 0, 4, 1.0), ("a", 1, 4, None), ("a", 2, 4, None), ("a", 3, 4, 4.0), ("b", 0, 1, 5.0),
    ]
    filled = fill_gaps(calendar.align_calendar(frame, "monthly"), "auto").filter("series_id = 'a'").orderBy("t")
    assert [r["y"] for r in filled.collect()] == [1.0, 2.0, 3.0, 4.0]


def test_fill_carries_the_edges_and_clips(spark):
    rows = [("a", t, v) for t, v in enumerate([None, 10.0, 11.0, None, 13.0, 12.0, 900.0, None])]
    frame = spark.createDataFrame(rows, "series_id string, t int, y double")
    values = [r["y"] for r in fill_gaps(frame, "interpolate").orderBy("t").collect()]
    assert values == [10.0, 10.0, 11.0, 12.0, 13.0, 12.0, 900.0, 900.0]
    clipped = [r["y"] for r in winsorise(frame).orderBy("t").collect()]
    assert clipped[6] == pytest.approx(12.0 + 3.5 * 1.4826 * 1.0) and clipped[0] is None
    assert [r["y"] for r in prepare(frame).orderBy("t").collect()] == [v for _, _, v in rows]


@pytest.mark.parametrize(
    "steps,expected",
    [([1] * 20, "daily"), ([7] * 20, "weekly"), ([31, 28, 31, 30, 31, 30], "monthly"), ([90, 91, 92, 92], "quarterly"), ([1, 1, 1, 1, 365], "quarterly")],
)
def test_frequency(spark, steps, expected):
    day, days = date(2023, 1, 1), [date(2023, 1, 1)]
    for step in steps:
        day += timedelta(days=step)
        days.append(day)
    frame = spark.createDataFrame([("a", d) for d in days], "series_id string, ds date")
    assert calendar.infer_frequency(frame).first()["frequency"] == expected


def test_horizon_is_half_the_history(spark):
    frame = spark.createDataFrame([("a", month(i), 1.0) for i in range(12)], "series_id string, ds date, y double")
    assert calendar.check_horizon(frame, 6, "monthly") == 6
    with pytest.raises(ValueError):
        calendar.check_horizon(frame, 7, "monthly")


def test_validation_routes(spark):
    rows = [("steady", month(i), 10.0 + i % 3) for i in range(24)]
    rows += [("rare", month(i), 0.0 if i % 2 else 5.0) for i in range(24)]
    rows += [("short", month(i), 1.0 + i) for i in range(4)]
    rows += [("twice", month(0), 1.0), ("twice", month(0), 2.0), ("twice", month(1), 3.0)]
    rows += [("empty", month(i), None) for i in range(5)] + [("one", month(0), 1.0)]
    panel = spark.createDataFrame(rows, "series_id string, ds date, y double")
    found = {r["series_id"]: r for r in validation.validate_panel(panel, "monthly").collect()}
    assert (found["steady"]["status"], found["steady"]["route"]) == ("ok", "model")
    assert (found["rare"]["status"], found["rare"]["route"]) == ("warn", "fallback")
    assert [f["code"] for f in found["short"]["findings"]] == ["short_history"]
    for name, code in (("twice", "duplicate_timestamps"), ("empty", "all_null"), ("one", "no_history")):
        assert found[name]["status"] == "reject" and found[name]["findings"][0]["code"] == code


def test_canonical_contract(spark, sales):
    panel = canonical.to_canonical(sales, "day", "units", "quarterly", series_keys=["region", "sku"])
    assert canonical.assert_canonical(panel) is panel
    assert total(panel, "y") == total(sales, "units")
    with pytest.raises(ValueError):
        canonical.assert_canonical(panel.unionAll(panel))
    with pytest.raises(ValueError):
        canonical.assert_canonical(panel.withColumn("extra", F.lit(1)))
    with pytest.raises(ValueError):
        canonical.to_canonical(sales, "day", "day", "monthly")


def texts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "c string")


@pytest.mark.parametrize(
    "values,decimal,style",
    [
        (["1.234,56", "99,10", "7,00"], ",", "european"),
        (["1,234,567", "12,345", "999"], ".", "grouped"),
        (["1,00,000", "25,00,000"], ".", "grouped"),
        (["1,5", "2,25"], ",", "european"),
        (["1.234.567", "2.000"], ",", "european"),
        (["12%", "40%"], ".", "percent"),
    ],
)
def test_number_conventions(spark, values, decimal, style):
    how = coercion.read_numbers_how(texts(spark, values), ["c"])["c"]
    assert (how.accepted, how.decimal, how.style) == (True, decimal, style)


def test_numbers_are_weighed_by_the_rows_they_stand_for(spark):
    """A column that says how often each text occurs counts as the texts themselves do."""
    rows = [("1.234,50", 3), ("7", 2), (None, 4), ("soon", 1), ("(12%)", 2)]
    weighed = spark.createDataFrame(rows, "c string, times int")
    plain = texts(spark, [value for value, times in rows for _ in range(times)])
    assert coercion.read_numbers_how(weighed, ["c"], "times") == coercion.read_numbers_how(plain, ["c"])
    assert coercion.number_evidence(weighed, ["c"], "times").first() == coercion.number_evidence(plain, ["c"]).first()


def test_years_are_labels_only_under_a_year_name(spark):
    frame = texts(spark, ["2021", "2022", "2023"])
    assert coercion.read_numbers_how(frame, ["c"])["c"].accepted
    assert not coercion.read_numbers_how(frame.toDF("fiscal_year"), ["fiscal_year"])["fiscal_year"].accepted


@pytest.mark.parametrize(
    "values,label,first,ambiguous",
    [
        (["15/01/2024", "03/02/2024"], "DD/MM/YYYY", date(2024, 1, 15), False),
        (["01/15/2024", "02/03/2024"], "MM/DD/YYYY", date(2024, 1, 15), False),
        (["01/02/2024", "03/04/2024"], "DD/MM/YYYY", date(2024, 2, 1), True),
        (["01/01/2024", "02/01/2024", "03/01/2024"], "MM/DD/YYYY", date(2024, 1, 1), False),
        (["5.3.99", "17.4.01"], "DD/MM/YYYY", date(1999, 3, 5), False),
        (["2024-01-05", "2024-01-06", "07/02/2024", "18/02/2024"], "mixed formats", date(2024, 1, 5), False),
    ],
)
def test_date_conventions(spark, values, label, first, ambiguous):
    frame = texts(spark, values)
    how = coercion.read_dates_how(frame, ["c"])["c"]
    assert (how.label, how.ambiguous) == (label, ambiguous)
    assert frame.limit(1).select(how.value(F.col("c")).alias("d")).first()["d"] == first


def test_hand_set_order_wins_and_words_are_no_dates(spark):
    frame = texts(spark, ["01/02/2024", "03/04/2024"])
    how = coercion.read_dates_how(frame, ["c"], day_first=False)["c"]
    assert (how.label, how.ambiguous) == ("MM/DD/YYYY", False)
    assert "c" not in coercion.read_dates_how(texts(spark, ["north", "south"]), ["c"])


def test_key_search_finds_the_smallest_key(spark, sales):
    found = profile.resolve_keys(sales, "day", ["region", "sku"])
    assert found.series_keys == ("region", "sku") and found.hierarchy == ("region", "sku")
    assert (found.duplicate_rows, found.series_count) == (0, 20)
    again = profile.resolve_keys(sales.unionAll(sales.limit(4)), "day", ["region", "sku"])
    assert again.duplicate_rows == 4


def test_exact_keys_go_by_width(spark):
    rows = [(d, a, b, a * 3 + b, "x", None) for d in range(4) for a in range(3) for b in range(3)]
    frame = spark.createDataFrame(rows, "day int, a int, b int, ab int, one string, nothing string")
    every = ["one", "nothing", "a", "b", "ab"]
    brute = profile.key_search(frame, "day", every).collect()
    for witness_rows in (1, 5, 2000):  # however few rows refute, the answer is the same
        found = profile.exact_keys(frame, "day", every, witness_rows=witness_rows)
        assert [tuple(r) for r in found] == [(1, ["ab"], 0, 9)]
        found = profile.exact_keys(frame, "day", every[:-1], witness_rows=witness_rows)
        assert {tuple(r["keys"]) for r in found} == {("a", "b")}
    assert min((r["width"], tuple(r["keys"])) for r in brute if r["duplicate_rows"] == 0) == (1, ("ab",))
    narrow = profile.exact_keys(frame, "day", every[:-1], width=1)
    assert [(r["width"], r["duplicate_rows"], r["series_count"]) for r in narrow] == [(4, 0, 9)]
    twice = profile.exact_keys(frame.unionAll(frame.limit(2)), "day", every)
    assert [(r["width"], r["duplicate_rows"]) for r in twice] == [(5, 2)]
    assert profile.exact_keys(frame.limit(0), "day", every)[0]["width"] == 0
    null_key = spark.createDataFrame([(1, None), (1, "a"), (2, None)], "day int, k string")
    assert [tuple(r) for r in profile.exact_keys(null_key, "day", ["k"])] == [(1, ["k"], 0, 2)]


def test_exact_keys_in_slices_are_the_brute_ones(spark, monkeypatch):
    """Small limits stand for a large table: slices, kept rows and hashes in several parts."""
    for name, limit in {"SLICE_RECORDS": 60, "TASK_RECORDS": 200, "MET_HASHES": 3, "WORTH_ROWS": 20}.items():
        monkeypatch.setattr(profile, name, limit)
    # a and b meet once, with different c; nested nulls leave hashes as they were.
    rows = [(i % 3, i // 20, i % 20, i % 7, i * 37 % 101, [None, i % 2] if i % 5 else [i % 2, None], None) for i in range(400)]
    rows += [(0, 0, 0, 6, 5, [1, None], 0.0), (0, 0, 0, 6, 5, [None, 1], -0.0), (None, None, 3, 2, 1, None, None)]
    columns = ["a", "b", "c", "d", "e", "f"]
    frame = spark.createDataFrame(rows, "day int, a int, b int, c int, d int, e array<int>, f double")
    plain = [tuple(tuple(v) if isinstance(v, list) else v for v in row) for row in rows]

    def different(plain, places):
        return len({tuple(row[i] for i in places) for row in plain})

    def brute(plain, considered):
        for width in range(5):
            subsets = [s for s in combinations([columns.index(c) + 1 for c in considered], width)]
            exact = [s for s in subsets if different(plain, (0, *s)) == len(plain)]
            if exact:
                return [(width, [columns[i - 1] for i in s], 0, different(plain, s)) for s in exact]
        whole = [columns.index(c) + 1 for c in considered]
        return [(len(whole), list(considered), len(plain) - different(plain, (0, *whole)), different(plain, whole))]

    for considered, witness_rows in ((columns, 1), (["a", "b", "c"], 5), (["f", "e"], 2000)):
        found = profile.exact_keys(frame, "day", considered, witness_rows=witness_rows)
        assert [tuple(r) for r in found] == brute(plain, considered)
    twice = profile.exact_keys(frame.unionAll(frame.limit(1)), "day", columns)
    assert [tuple(r) for r in twice] == brute(plain + plain[:1], columns)


def test_a_key_search_moves_hashes_and_not_the_rows(spark):
    """Fifteen pairs of six wide columns, hardly any of which meets: each is a short hash a row,
    however many other columns there are. 29 MB of 60 were moved, the values of exact pairs among them."""
    folders = [str(path) for path in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: sum(path.stat().st_size for folder in folders for path in Path(folder).rglob("*") if path.is_file())
    values = [F.md5((F.xxhash64(F.lit(j), "id") % 9000).cast("string")).alias(f"k{j}") for j in range(6)]
    others = [(F.xxhash64(F.lit(j), "id") % 50).alias(f"o{j}") for j in range(30, 44)]
    frame = spark.range(30_000).select((F.col("id") % 2).alias("day"), *values, *others)
    before = held()
    found = profile.exact_keys(frame, "day", frame.columns[1:], width=2)
    moved = held() - before
    assert moved < 60_000_000
    pairs = [list(s) for s in combinations([f"k{j}" for j in range(6)], 2)]
    alone = [s for s in pairs if frame.select("day", *s).distinct().count() == 30_000]
    assert alone and [r["keys"] for r in found] == alone


def test_proposal_and_override(spark, sales):
    mapping, _ = profile.propose(sales.select(F.col("day").alias("order_date"), "sku", F.col("units").alias("revenue")))
    assert (mapping.date, mapping.target, mapping.series_keys) == ("order_date", "revenue", ("sku",))
    assert (mapping.frequency, mapping.aggregation, mapping.needs_confirmation) == ("monthly", "sum", False)
    changed = profile.override(mapping, {"aggregation": "mean"})
    assert (changed.aggregation, changed.source, changed.confidence) == ("mean", "override", 1.0)
    with pytest.raises(ValueError):
        profile.override(mapping, {"colour": "red"})
    assert profile.fingerprint([("a", "int"), ("b", "string")]) == profile.fingerprint([("b", "string"), ("a", "int")])


def test_intake_refuses_without_dates(spark):
    frame = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "label string, revenue double")
    rows = profile.profile(frame).collect()
    verdict = profile.intake_verdict(rows, row_count=2)
    assert verdict["verdict"] == "refuse" and verdict["refusals"] == ["no_dates"]


def test_wide_sheet_becomes_long(spark):
    names = [f"2024-{m:02d}" for m in range(1, 13)]
    sheet = spark.createDataFrame([("a", *range(12)), ("b", *range(12, 24))], ["sku", *names])
    long = reshape.unpivot_periods(sheet)
    assert long.count() == 24 and long.schema["period"].dataType.simpleString() == "date"
    assert reshape.unpivot_periods(spark.createDataFrame([(1, 2)], "a int, b int")) is None


def test_headers_and_merged_labels(spark):
    assert reshape.clean_headers(["a ", "", "a", "a"]) == ["a", "column", "a_1", "a_2"]
    sheet = spark.createDataFrame(
        [(0, "Sales report", None), (1, "sku", "revenue"), (2, "a", "1,200"), (3, "b", "900")],
        "row int, column_1 string, column_2 string",
    )
    table, used = reshape.promote_header(sheet.filter("row > 0"), "row")
    assert used == 1 and table.columns == ["row", "sku", "revenue"]
    assert [r["revenue"] for r in table.orderBy("row").collect()] == [1200.0, 900.0]
    rows = [(i, f"L{i // 150_000}" if i % 150_000 == 0 else None) for i in range(0, 450_000, 15_000)]
    filled = reshape.fill_down(spark.createDataFrame(rows, "row bigint, label string"), "row", block_rows=100_000).orderBy("row").collect()
    assert [r["label"] for r in filled] == [f"L{r['row'] // 150_000}" for r in filled]


def test_settings_digest_ignores_their_order():
    one, two = profile.settings_digest({"a": 1, "b": (2, 3)}), profile.settings_digest({"b": (2, 3), "a": 1})
    assert one == two != profile.settings_digest({"a": 2, "b": (2, 3)}) and len(one) == 16


def test_a_repeated_date_is_read_once_and_weighs_its_rows(spark):
    frame = spark.range(0, 4000, 1, 4).selectExpr("concat('0', id % 4 + 1, '/02/2021') AS d", "if(id % 8 < 7, 'x', null) AS n")
    counts = coercion.text_counts(frame, ["d", "n"])
    assert counts.count() == 6 and counts.agg({"rows": "sum"}).first()[0] == 8000
    how = coercion.read_dates_how(frame, ["d", "n"])
    assert (how["d"].present, how["d"].matched) == (4000, 4000) and "n" not in how
    assert coercion.read_dates_how(frame, ["d", "n"], counts=counts) == how

import pytest

from tidemark.llm import graph, url_filter

SCHEMA = "page_id long, url string, html string"


def verdicts(frame, **settings):
    return {row.id: (row.host, row.path, row.rule, row.verdict, row.reason) for row in url_filter.judge_urls(frame, **settings).collect()}


def test_rules_and_cuts(spark):
    rows = [
        (1, "https://A.Example.org/es/x?q=1#f"),
        (2, "http://example.org/en/100"),
        (3, "http://example.org/EN/1"),
        (4, "http://myexample.org/es/"),
        (5, "http://fr.com/fr/1"),
        (6, "http://x.com/de/"),
        (7, "http://x.com/it/"),
        (8, None),
        (9, "no scheme"),
        (10, "http://org?x"),
        (11, "ftp://a.org#/es/"),
        (12, "x://y://z/"),
        (13, ""),
    ]
    found = verdicts(spark.createDataFrame([(*row, None) for row in rows], SCHEMA))
    assert found[1] == ("a.example.org", "/es/x", "example.org/es/", "block", "rule")
    assert found[2] == ("example.org", "/en/100", "example.org/en/1", "block", "rule")
    assert found[3][2:] == ("org/", "allow", "rule")
    assert found[4][2:4] == ("org/", "allow")
    assert found[5][2:4] == ("com/fr/", "allow")
    assert found[6][2:4] == ("com/de/", "block")
    assert found[7][2:] == (None, "allow", "default")
    assert found[8] == found[9] == found[13] == ("", "", None, "allow", "default")
    assert found[10][:3] == ("org", "", None) and found[11][:3] == ("a.org", "", None)
    assert found[12][:2] == ("y:", "//z/")


def test_blocks_follow_aliases_and_allows_go_first(spark):
    rows = [
        (1, "http://blocked.example.org/es/a", None),
        (2, "http://b.net/1", '<link rel="canonical" href="http://blocked.example.org/es/a">'),
        (3, "http://b.net/2", "<meta http-equiv='Refresh' content='5; url=/1'>"),
        (4, "http://c.net/", '<LINK HREF=//b.net/3 REL="x canonical">'),
        (5, "http://b.net/3", "<link rel=stylesheet href=http://blocked.example.org/es/a>"),
        (6, "http://d.net/", '<link rel=canonical href="http://fine.org/">'),
        (7, "http://fine.org/", "<link rel='canonical' href='http://z.com/de/1'>"),
        (8, "http://z.com/de/1", ""),
        (9, "http://e.net/a?x=1&y=2#z", '<link rel="canonical" href="http://z.com/de/2">'),
        (10, "http://e.net/a?x=1&y=2", None),
        (11, "http://e.net/q", '<link rel=canonical href="?x=1&amp;y=2"><meta charset="utf-8">'),
    ]
    found = verdicts(spark.createDataFrame(rows, SCHEMA))
    verdict = {key: value[3:] for key, value in found.items()}
    assert verdict[2] == verdict[3] == ("block", "alias")
    assert verdict[4] == verdict[5] == ("allow", "default")
    assert verdict[6] == ("allow", "alias") and verdict[8] == ("block", "rule")
    # z.com/de/2 is no page, so nothing is known of it.
    assert verdict[9] == verdict[10] == ("allow", "default")


def test_a_redirect_log_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", 3), (2, "http://b.com/de/y", 4)], "page_id long, url string, host long")
    log = spark.createDataFrame([("http://a.net/x", "http://m.net/"), ("http://m.net/", "http://b.com/de/y"), (None, "x"), ("http://q.net/", None)], "source string, target string")
    found = verdicts(pages, html_col=None, redirects=log)
    assert found[1][3:] == ("block", "alias") and found[2][3:] == ("block", "rule")


def test_empty_tables_and_repeated_rows(spark):
    assert verdicts(spark.createDataFrame([], SCHEMA)) == {}
    frame = spark.createDataFrame([(1, "http://a.org/", "x" * 100_000)] * 3, SCHEMA)
    assert url_filter.judge_urls(frame).count() == 3


def test_rules_must_allow_or_block():
    with pytest.raises(ValueError):
        url_filter.rule("hide", "a.org/")


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    rows = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {row.node: row.component for row in rows} == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(40)}, **{200 + i: 200 for i in range(3)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0

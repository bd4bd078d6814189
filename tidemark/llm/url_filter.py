"""URL rules carried over redirects and canonical links.

A rule names a host and a path prefix. It fits its host and all subdomains, and
the longest rule that fits a url decides. A page without a rule of its own takes
the decision of its aliases: pages that redirect to one another, or name one
another as canonical, form a component of the link graph, found by distributed
star rounds. Inside a component an explicit allow goes before any block, and a
page's own rule before both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    """From a verdict and text like ``example.org/es/``."""
    if verdict not in ("allow", "block"):
        raise ValueError(f"A rule allows or blocks; it cannot {verdict}.")
    host, slash, path = text.partition("/")
    return Rule(verdict, host.lower(), slash + path)


RULES = (rule("allow", "org/"), rule("block", "example.org/es/"), rule("block", "example.org/en/1"), rule("allow", "com/fr/"), rule("block", "com/de/"))


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(_url, locate('://', _url) + 3)")).otherwise(F.lit(""))


def host_and_path(frame: DataFrame, url_col: str) -> DataFrame:
    """Adds host, path and ``_query`` (from the question mark to the fragment)."""
    rest = F.coalesce(_after_scheme(F.col("_url")), F.lit(""))
    return (
        frame.withColumn("_url", frame[url_col].cast("string"))
        .withColumn("_rest", rest)
        .withColumn("host", F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), _UPPER, _LOWER))
        .withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1))
        .withColumn("_query", F.regexp_extract("_rest", r"^[^?#]*(\?[^#]*)?", 1))
        .drop("_rest", "_url")
    )


def _fits(held: Rule) -> Column:
    host = F.lit(True) if not held.host else (F.col("host") == held.host) | F.col("host").endswith("." + held.host)
    return (F.col("host") != "") & host & F.col("path").startswith(held.path)


def longest_rule(rules: tuple[Rule, ...]) -> Column:
    """The number of the longest rule that fits, or null. The rules are an
    argument of the call, not data: one expression tests them all."""
    out = F.lit(None).cast("int")
    order = sorted(range(len(rules)), key=lambda i: (len(rules[i].text), len(rules[i].host)))
    for number in order:
        out = F.when(_fits(rules[number]), F.lit(number)).otherwise(out)
    return out


def _key(host: Column, path: Column, query: Column) -> Column:
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.coalesce(query, F.lit("")))


_TAG = re.compile(r"<(link|meta)\b([^>]*)>", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""([\w-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_REFRESH = re.compile(r"url\s*=\s*['\"]?([^'\"]+)", re.IGNORECASE)


def page_links(url: str, html: str) -> list[str]:
    """Absolute urls that a page names as canonical or refreshes to."""
    out = []
    for tag, inside in _TAG.findall(html):
        held = {name.lower(): unescape(value.strip("\"'")).strip() for name, value in _ATTRIBUTE.findall(inside)}
        target = None
        if tag.lower() == "link" and "canonical" in held.get("rel", "").lower().split():
            target = held.get("href")
        elif tag.lower() == "meta" and held.get("http-equiv", "").lower() == "refresh":
            found = _REFRESH.search(held.get("content", ""))
            target = found[1].strip() if found else None
        if target:
            try:
                out.append(urljoin(url, target))
            except ValueError:  # not a url at all, such as an unclosed bracket
                continue
    return out


def _find_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(url, to) for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if url and html for to in page_links(url, html)]
        yield pa.RecordBatch.from_arrays([pa.array([pair[i] for pair in found], pa.string()) for i in (0, 1)], names=["source", "target"])


def keyed_edges(edges: DataFrame) -> DataFrame:
    """Edges (source, target) of urls as edges (a, b) of url keys."""
    for name, key in (("source", "a"), ("target", "b")):
        read = host_and_path(edges, name).where("host <> ''")
        edges = read.withColumn(key, _key(F.col("host"), F.col("path"), F.col("_query"))).drop("host", "path", "_query")
    return edges.select("a", "b")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, reason.

    reason is ``rule``, ``alias`` or ``default``. ``redirects`` may add rows
    (source, target) of urls, such as a crawl log's. A url that is null or holds no
    ``://`` has an empty host and path, fits no rule, has no alias and is allowed.
    Null html has no links. Repeated urls are one node. Other columns are ignored.
    """
    columns = [pages[id_col].alias("id"), pages[url_col].cast("string").alias("url")]
    if html_col is not None:
        columns.append(pages[html_col].cast("string").alias("html"))
    read = host_and_path(pages.select(*columns), "url")
    judged = read.withColumn("number", longest_rule(rules)).withColumn("key", F.when(F.col("host") != "", _key(F.col("host"), F.col("path"), F.col("_query"))))
    verdicts = F.array(*(F.lit(held.verdict) for held in rules)).cast("array<string>")
    texts = F.array(*(F.lit(held.text) for held in rules)).cast("array<string>")
    slim = judged.select(
        "id", "host", "path", "key", F.get(texts, F.col("number")).alias("rule"), F.get(verdicts, F.col("number")).alias("own")
    )
    edges = None if html_col is None else read.select("url", "html").mapInArrow(_find_links, "source string, target string")
    if redirects is not None:
        logged = redirects.select(redirects["source"].cast("string").alias("source"), redirects["target"].cast("string").alias("target"))
        edges = logged if edges is None else edges.unionByName(logged)
    if edges is None:
        carried = slim.withColumn("carried", F.lit(None).cast("string"))
    else:
        groups = components(keyed_edges(edges))
        members = slim.where("key IS NOT NULL").join(groups, F.col("key") == F.col("node"))
        # An explicit allow of any alias goes before a block.
        decided = members.where("own IS NOT NULL").groupBy("component").agg(F.min("own").alias("carried"))
        aliases = groups.join(decided, "component").select(F.col("node").alias("key"), "carried")
        carried = slim.join(aliases, "key", "left")
    return carried.select(
        "id",
        "host",
        "path",
        "rule",
        F.coalesce("own", "carried", F.lit("allow")).alias("verdict"),
        F.when(F.col("own").isNotNull(), "rule").when(F.col("carried").isNotNull(), "alias").otherwise("default").alias("reason"),
    )

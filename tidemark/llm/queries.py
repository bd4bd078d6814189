"""Registered queries of the training-data operators: each applies its operator
to its whole table and derives the contract's columns from the operator's rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, conversations, decontaminate, jaccard_join, licenses, line_dedup, media, quality, sharding, suffix_dedup, topk_search, url_filter, whitening

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class LlmQuery:
    run: Runner
    sql: str | None


QUERIES: dict[str, LlmQuery] = {}


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    def register(run: Runner) -> Runner:
        QUERIES[name] = LlmQuery(run, sql)
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op1_suffix_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    rows = suffix_dedup.dedup_substrings(table(spark, folder, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: Words of a text in DuckDB: lower-cased A-Z, then maximal runs.
_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

_OP3_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC) AS place
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.place = 1
"""

_OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT item_id, least(13, len(w)) AS m, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS k FROM b WHERE len(w) > 0),
patterns AS (SELECT DISTINCT item_id, m, w[k:k + m - 1] AS win FROM windows),
lengths AS (SELECT DISTINCT m FROM patterns),
places AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, lengths WHERE len(w) >= m),
cut AS (SELECT doc_id, m, k, w[k:k + m - 1] AS win FROM places),
hits AS (SELECT c.doc_id, p.item_id, c.k, c.m FROM cut c JOIN patterns p ON c.m = p.m AND c.win = p.win),
words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS place FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op3_url_filter", _OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """The tables hold no redirect or canonical link; the SQL has the rules only."""
    rows = url_filter.judge_urls(table(spark, folder, "pages"))
    return rows.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


@query("op5_decontaminate", _OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    rows = decontaminate.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    n_hit = decontaminate.hit_words()
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_words"), n_hit).alias("contaminated"),
    )


@query("op9_license_scan")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    rows = licenses.scan_licenses(table(spark, folder, "documents"))
    base = F.array_sort(F.array_distinct("base.label"))
    found = F.array_sort(F.array_distinct(F.concat("base.label", "notices.label")))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(found, ",").alias("labels"),
        # Whole wording is proof, a phrase alone is a hint.
        F.when(F.size("notices") > 0, 1.0).when(F.size("base") > 0, 0.5).otherwise(0.0).alias("score"),
    )


@query("op4_quality_classifier")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, table(spark, folder, "labels"))
    rows = quality.score_quality(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op10_media_webp")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    rows = media.read_media(media.store_texts(table(spark, folder, "documents")))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        "payload_bytes",
        F.sha2("samples", 256).alias("payload_sha256"),
        media.tail_crc().alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def word_vocabulary() -> str:
    """The place of the public vocabulary; the operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query("op8_bpe")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    path = word_vocabulary()
    rows = bpe.decode_ids(bpe.encode_texts(table(spark, folder, "documents"), path), path)
    return rows.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_kd_sharding")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.shard_documents(table(spark, folder, "documents"), shards=8)
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op7_line_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        "n_lines",
        F.size("dropped").cast("long").alias("n_dropped"),
        "n_near",
        F.array_join("dropped", ",").alias("dropped"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op2_jaccard_join")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    members, _ = jaccard_join.join_similar(table(spark, folder, "documents"))
    return members.select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_shingles")


#: DuckDB has no CRC-32: eight shifts a byte.
_OP11_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         [4294967295::BIGINT] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ascii(x)::BIGINT) AS codes
  FROM conversations
), fated AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(codes, lambda a, b: list_reduce([xor(a, b), 0, 1, 2, 3, 4, 5, 6, 7], lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 20 AS fate
  FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
  FROM fated WHERE fate <> 0
), shorn AS (
  SELECT *, rtrim(text, e' \t\n\x0b\x0c\r') AS core, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS n FROM damaged
), marked AS (
  SELECT conv_id, turn, role, text, n, core = '' AS blank, core <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS duplicate,
         right(core, 1) NOT IN ('.', '!', '?') AS open, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair
  FROM shorn
), rows AS (
  SELECT *, blank OR duplicate AS gone, CASE WHEN open AND NOT blank AND NOT duplicate THEN 5 ELSE 0 END AS more FROM marked
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(duplicate::INT) AS duplicate,
         sum((more > 0)::INT) AS truncated, sum((n > 1 AND pair NOT IN ('su', 'ua', 'au'))::INT) AS illegal, max(n) AS n
  FROM rows GROUP BY conv_id
), walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS n, {'c': 0, 'a': '', 't': ''} AS s0, NULL::STRUCT(c INT, a VARCHAR, t VARCHAR) AS s1,
         NULL::STRUCT(c INT, a VARCHAR, t VARCHAR) AS s2, NULL::STRUCT(c INT, a VARCHAR, t VARCHAR) AS s3
  FROM damaged
  UNION ALL
  SELECT conv_id, n, {'c': s0.c + 2, 'a': s0.a || 'D', 't': s0.t},
         list_min(list_filter([{'c': s1.c + 2, 'a': s1.a || 'D', 't': s1.t}, CASE WHEN NOT gone AND r = 's' THEN {'c': s0.c + more, 'a': s0.a || 'K', 't': s0.t || chr(10) || role || ':' || text} END], lambda x: x.c IS NOT NULL)),
         list_min(list_filter(list_concat([{'c': e2.c + 2, 'a': e2.a || 'D', 't': e2.t}], CASE WHEN gone THEN [] ELSE list_concat(
           list_transform([s0, s1, e3], lambda x: {'c': x.c + 1 + more, 'a': x.a || 'R', 't': x.t || chr(10) || 'user:' || text}),
           CASE WHEN r = 'u' THEN list_transform([s0, s1, e3], lambda x: {'c': x.c + more, 'a': x.a || 'K', 't': x.t || chr(10) || role || ':' || text}) ELSE [] END) END), lambda x: x.c IS NOT NULL)),
         list_min(list_filter([{'c': e3.c + 2, 'a': e3.a || 'D', 't': e3.t}, CASE WHEN NOT gone THEN {'c': e2.c + 1 + more, 'a': e2.a || 'R', 't': e2.t || chr(10) || 'assistant:' || text} END,
           CASE WHEN NOT gone AND r = 'a' THEN {'c': e2.c + more, 'a': e2.a || 'K', 't': e2.t || chr(10) || role || ':' || text} END], lambda x: x.c IS NOT NULL))
  FROM (
    SELECT w.conv_id, r.n, s0, s1, r.role, r.text, r.gone, r.more, r.r,
           list_min(list_filter(list_concat([s2], list_transform([s0, s1, s3], lambda x: {'c': x.c + 5, 'a': x.a || 'I', 't': x.t || chr(10) || 'user:'})), lambda x: x.c IS NOT NULL)) AS e2,
           list_min(list_filter(list_concat([s3, {'c': s2.c + 5, 'a': s2.a || 'I', 't': s2.t || chr(10) || 'assistant:'}],
             list_transform([s0, s1], lambda x: {'c': x.c + 10, 'a': x.a || 'II', 't': x.t || chr(10) || 'user:' || chr(10) || 'assistant:'})), lambda x: x.c IS NOT NULL)) AS e3
    FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n + 1
  )
), ends AS (
  SELECT w.conv_id, list_min(list_filter([s0, s3, {'c': s2.c + 5, 'a': s2.a || 'I', 't': s2.t || chr(10) || 'assistant:'},
         {'c': s1.c + 10, 'a': s1.a || 'II', 't': s1.t || chr(10) || 'user:' || chr(10) || 'assistant:'}], lambda x: x.c IS NOT NULL)) AS best
  FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.n
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""

_NOTHING = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


@query("op11_conversation_repair", _OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    repairs = conversations.repair_conversations(conversations.damage(rows), "conv", "turn", "role", "text")
    found = repairs.plans.drop("conv").join(conversations.repair_digests(repairs), "key")
    return (
        conversations.all_conversations(rows)
        .join(found, "key", "left")
        .select(
            F.col("conv").alias("conv_id"),
            *(F.coalesce(F.col(name), F.lit(0)).alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(_NOTHING)).alias("repaired_sha256"),
        )
    )


_OP12_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op12_topk_search", _OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return topk_search.search_top(table(spark, folder, "embeddings"), F.col("id") % 50 == 0)


@query("op13_embedding_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    model = whitening.fit_whitening(table(spark, folder, "embeddings"))
    error = whitening.identity_error(model)
    explained = [float(value / model.trace) for value in model.values]
    return whitening.whiten(model).select(
        F.col("id").alias("vec_id"),
        "component",
        F.lit(model.rows.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(F.lit(explained).cast("array<double>"), F.col("component") - 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )

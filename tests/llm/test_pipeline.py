import duckdb
import pytest
from check_oracle import compare, oracle
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import quality
from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("name", [name for name, item in QUERIES.items() if item.sql])
def test_queries_equal_their_sql(spark, name):
    rows, verdict = compare(spark, oracle(FOLDER), FOLDER, QUERIES[name])
    assert rows and verdict == "ok"


@pytest.mark.parametrize("name", [name for name, item in QUERIES.items() if not item.sql])
def test_queries_return_a_row_for_each_input_row(spark, name):
    key, table = ("vec_id", "embeddings") if name.startswith("op13") else ("doc_id", "documents")
    frame = QUERIES[name].run(spark, FOLDER)
    found = [row[0] for row in (frame.where("component = 1") if "component" in frame.columns else frame).select(key).collect()]
    known = {row[0] for row in duckdb.sql(f"SELECT {key} FROM '{FOLDER}/{table}.parquet'").fetchall()}
    assert len(found) == len(set(found)) and (set(found) == known or name == "pipeline" and set(found) < known)


def test_every_operator_has_a_query():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}


def test_quality_stage_keeps_what_the_classifier_accepts(spark, documents):
    kept = corpus_pipeline.keep_good(spark, documents, FOLDER)
    model = quality.fit(documents, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    good = quality.score_quality(documents, model).where("predicted = 1")
    assert kept.columns == COLUMNS and sorted(row.doc_id for row in kept.collect()) == sorted(row.doc_id for row in good.collect())


def test_line_stage_keeps_every_document(spark, documents):
    extra = spark.createDataFrame([(9001, None, "en", "s", None), (9002, "Brand-new words of one line only, seen nowhere else.", "en", "s", 52)], documents.schema)
    rows = {row.doc_id: row for row in corpus_pipeline.drop_lines(spark, documents.unionByName(extra), FOLDER).collect()}
    before = {row.doc_id: row for row in documents.unionByName(extra).collect()}
    assert set(rows) == set(before) and rows[9001].text is None and rows[9002] == before[9002]
    for key, row in rows.items():
        if row.text != before[key].text:
            held = iter((before[key].text or "").split("\n"))
            assert not row.text or all(line in held for line in row.text.split("\n"))
            assert row.n_chars == len(row.text)
    lines = [line for row in rows.values() for line in (row.text or "").split("\n") if line]
    assert len(lines) == len(set(lines))


def test_join_stage_keeps_one_of_each_group(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(3, base, "en", "s", 1), (1, base + " more", "en", "s", 1), (2, "quite another text of seven words", "en", "s", 1), (5, base, "en", "t", 1), (None, base, "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, FOLDER)
    assert kept.columns == COLUMNS
    assert sorted((row.doc_id or 0, row.text) for row in kept.collect()) == sorted([(0, base), (1, base + " more"), (2, "quite another text of seven words")])


def test_benchmark_stage_drops_what_the_rule_names(spark, documents):
    connection = oracle(FOLDER)
    clean = {row[0] for row in connection.execute(f"SELECT doc_id FROM ({QUERIES['op5_decontaminate'].sql}) WHERE NOT contaminated").fetchall()}
    kept = corpus_pipeline.drop_contaminated(spark, documents, FOLDER)
    assert kept.columns == COLUMNS and {row.doc_id for row in kept.collect()} == clean


#: What the operators call their results and helpers.
_TAKEN = "id score predicted n_lines dropped n_near kept contaminated n_words hits items class_id n_links n_shingles component block digest hash __id __drops __text __part held.out"


def test_stages_keep_columns_named_like_results(spark, documents):
    names = _TAKEN.split()
    given = documents.select("*", *(F.concat(F.lit(f"{name} "), F.col("doc_id").cast("string")).alias(name) for name in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain = {row.doc_id: row for row in stage(spark, documents, FOLDER).collect()}
        out = stage(spark, given, FOLDER)
        assert out.columns == given.columns, name
        rows = out.collect()
        assert {row.doc_id for row in rows} == set(plain), name
        for row in rows:
            assert tuple(row)[: len(COLUMNS)] == tuple(plain[row.doc_id]) and list(row)[len(COLUMNS) :] == [f"{own} {row.doc_id}" for own in names], name


def test_stages_take_null_and_repeated_ids(spark, documents):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(None, base, None, None, None), (None, base, None, None, None), (5, base, "en", "s", 1), (5, base, "en", "s", 1), (6, base * 200, "en", "s", 1), (7, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, documents.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, FOLDER).collect()
        assert len(found) <= len(rows) and {row.doc_id for row in found} <= {None, 5, 6, 7}, name
    assert corpus_pipeline.to_tokens(spark, docs, FOLDER).count() == len(rows)


def test_stages_take_empty_tables(spark, documents):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, documents.where(F.lit(False)), FOLDER)
        assert out.columns == COLUMNS and out.count() == 0, name
    assert corpus_pipeline.to_tokens(spark, documents.limit(0), FOLDER).count() == 0

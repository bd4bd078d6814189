import random

import brute
import pytest

from tidemark.llm import licenses

SCHEMA = "doc_id long, text string"


def scan(frame, **settings):
    return {row.id: row for row in licenses.scan_licenses(frame, **settings).collect()}


def test_phrases_equal_brute_force(spark):
    draw = random.Random(4)
    pool = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "MIT", "License", "x", "é", "cc-by", "CC"]
    rows = [(i, draw.choice((" ", "\n", ", ")).join(draw.choice(pool) for _ in range(draw.randrange(60)))) for i in range(60)]
    found = scan(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    for key, text in rows:
        words = brute.words(text)
        places = sorted((at, label) for phrase, label in licenses.PHRASES.items() for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split())
        assert [(place.word, place.label) for place in found[key].base] == places
        assert found[key].n_words == len(words)


def test_templates(spark):
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    )
    rows = [
        (1, "Licensed under the Apache License, Version 2.0."),
        (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "Licensed under CC BY-NC 4.0. And licensed under the terms of the GNU General Public License version 2"),
        (4, "Released under the MIT License."),
        (5, "Licensed under the Apache Licence, Version 2.0"),
        (6, mit),
        (7, mit.replace("hereby ", "")),
        (8, "licensed under the terms the gnu general public license version 3"),
        (9, None),
        (10, ""),
        (11, "licensed under"),
    ]
    found = {key: [(notice.start, notice.end, notice.label) for notice in row.notices] for key, row in scan(spark.createDataFrame(rows, SCHEMA).coalesce(1)).items()}
    assert found[1] == [(0, 8, "apache-2.0")]
    assert found[2] == [(3, 12, "gpl-3.0")]
    assert [label for _, _, label in found[3]] == ["cc-by-nc-4.0", "gpl-2.0"]
    assert found[4] == [(0, 5, "mit-notice")]
    assert [label for _, _, label in found[6]] == ["mit-text"]
    assert all(found[key] == [] for key in (5, 7, 8, 9, 10, 11))


def test_optional_regions_and_replaceable_text():
    automaton = licenses.compile_template("t", "a b [[c {{2}} d]] e {{1}}")
    accepts = lambda text: automaton.longest(lambda at: text.split()[at].encode(), 0, len(text.split()))
    assert accepts("a b e") == 3 and accepts("a b e x y") == 4
    assert accepts("a b c d e") == 5 and accepts("a b c x y d e") == 7
    assert accepts("a b c x y z d e") is None and accepts("a b c e") is None and accepts("b a e") is None


@pytest.mark.parametrize("text", ["a", "[[a b]] c", "a b [[c", "a b c]]", "a {{2}} b"])
def test_templates_that_cannot_be_compiled(text):
    with pytest.raises(ValueError):
        licenses.compile_template("t", text)


def test_empty_table_repeated_rows_and_clashing_columns(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
    frame = spark.createDataFrame([(1, "MIT License " * 3000, "b")] * 2, "doc_id long, text string, base string")
    rows = licenses.scan_licenses(frame).collect()
    assert [len(row.base) for row in rows] == [3000, 3000]

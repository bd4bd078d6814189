import random

import brute
import pytest

from tidemark.llm import decontaminate

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def expected(docs, items, window=13):
    windows = {}
    for key, text in items:
        words = brute.words(text)
        size = min(window, len(words))
        for at in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[at : at + size]), set()).add(key)
    out = []
    for key, text in docs:
        words, hit, found = brute.words(text), set(), set()
        for size in {len(held) for held in windows}:
            for at in range(len(words) - size + 1):
                if tuple(words[at : at + size]) in windows:
                    hit |= set(range(at, at + size))
                    found |= windows[tuple(words[at : at + size])]
        out.append((key, len(words), len(hit), sorted(str(item) for item in found if item is not None)))
    return sorted(out, key=str)


def found(frame, items, **settings):
    rows = decontaminate.find_contamination(frame, items, **settings).collect()
    return sorted(((row.id, row.n_words, sum(run.end - run.start for run in row.hits), row["items"]) for row in rows), key=str)


def corpus():
    draw = random.Random(3)
    word = lambda: draw.choice(("aa", "Bé", "c1", "dd", "ee", "ff"))
    items = [(i, " ".join(word() for _ in range(draw.choice((1, 3, 12, 13, 14, 30))))) for i in range(25) if i % 5]
    items += [(90, None), (91, ""), (92, "..."), (3, items[0][1]), (None, "only here these words stand"), (93, "zz " * 20)]
    docs = [(i, " ".join(word() for _ in range(draw.randrange(80)))) for i in range(40)]
    docs += [(50, "x, " + items[-7][1].upper().replace(" ", " -- ") + " y"), (51, None), (52, ""), (53, "zz " * 12), (54, "ZZ-" * 13), (55, "Only here THESE words... stand!"), (54, "zz " * 100)]
    return docs, items


@pytest.mark.parametrize("pass_words", [10, 60, 10**6])
def test_equals_brute_force(spark, pass_words):
    docs, items = corpus()
    assert found(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), pass_words=pass_words) == expected(docs, items)


def test_texts_meet_in_one_piece_but_matches_do_not_cross_them(spark):
    half = " ".join(f"w{i}" for i in range(7)), " ".join(f"w{i}" for i in range(7, 13))
    frame = spark.createDataFrame([(1, half[0]), (2, half[1])], DOCS).coalesce(1)
    rows = found(frame, spark.createDataFrame([(1, " ".join(half))], ITEMS))
    assert [row[2] for row in rows] == [0, 0]


def test_empty_tables_and_a_long_text(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([], ITEMS)
    assert found(docs, items) == [(1, 2, 0, [])]
    assert found(docs.limit(0), spark.createDataFrame([(1, "a")], ITEMS)) == []
    text = " ".join(str(i) for i in range(200_000))
    long = found(spark.createDataFrame([(1, text)], DOCS), spark.createDataFrame([(7, " ".join(str(i) for i in range(199_980, 200_000)))], ITEMS))
    assert long == [(1, 200_000, 20, ["7"])]


def test_marks_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "q " * 13, "x", 2), (1, "fine", None, 3), (None, None, "y", 4)], "doc_id long, text string, hits string, id int")
    rows = decontaminate.mark_contaminated(docs, spark.createDataFrame([(1, "q " * 13)], ITEMS)).collect()
    assert sorted((row.id, row.hits, row.contaminated) for row in rows) == [(2, "x", True), (3, None, False), (4, "y", False)]


def test_one_word_in_twenty(spark):
    hit, clean = " ".join(f"b{i}" for i in range(13)), " ".join(f"c{i}" for i in range(1000))
    words = clean.split()
    docs = [(1, f"{hit} {' '.join(words[:247])}"), (2, f"{hit} {' '.join(words[:248])}")]
    rows = decontaminate.mark_contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, hit)], ITEMS)).collect()
    assert {row.doc_id: row.contaminated for row in rows} == {1: True, 2: False}

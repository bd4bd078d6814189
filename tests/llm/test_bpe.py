import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, lexicon

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
SCHEMA = "doc_id long, text string"


def check(spark, rows, **settings):
    library = Tokenizer.from_file(PATH)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = bpe.decode_ids(bpe.encode_texts(frame, PATH, **settings), PATH).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for row in got:
        ids = library.encode(texts[row.id] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(row.ids), "<u4").tolist() == ids and row.n_tokens == len(ids)
        assert row.decoded == library.decode(ids, skip_special_tokens=False)


ODD = [
    None, "", " \n\t ", "Hello  wörld's 'tis l'eau 12 <|endoftext|>x!!'s İstanbul ΟΔΟΣ ''s 3.14\x85a\xa0b", "'ll've're'd'restaurant 'l're'm't",
    "中文字 test é ẞ ǅ '", "<|startoftext|><|endoftext|>", "'", "''", "a'", "'s", "it's", "x'\n's", "ÀÉÎ ²½ª º µ ß Ⱥ Ȿ\xad\x00\x1c", "🎉 party 🎉's", "é 'S 'LL I'M",
    "é å", "<|endoftext|", "a<|endoftext|>'s", "١٢٣ ४५", "“quoted” – dash… €5", "​﻿x", "aaaaaaaaaaaaaaaaaaaaaaaa", "the the the", "q" * 5_000,
]


@pytest.mark.parametrize("words", [0, 2, 5_000])
def test_equals_the_library(spark, words):
    check(spark, list(enumerate(ODD)), words=words)


def test_random_texts(spark):
    draw = random.Random(3)
    pool = "abeinrst ABE'  \n.,!-0129éüñçßÆœŁ’—…€漢́😀<|>"
    check(spark, [(i, "".join(draw.choice(pool) for _ in range(draw.randrange(120)))) for i in range(300)], words=50)


def test_all_short_characters(spark):
    codes = [*range(1, 0x300), *range(0x2000, 0x2070), 0x20AC]
    check(spark, [(code, f"a{chr(code)}B {chr(code)}'s 1{chr(code)}{chr(code)}") for code in codes], words=10)


def test_repeated_rows_empty_table_and_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "same text", "x")] * 2 + [(None, "same text", None)], "doc_id long, text string, ids string")
    rows = bpe.encode_texts(frame, PATH).collect()
    assert len(rows) == 3 and len({bytes(row.ids) for row in rows}) == 1
    empty = bpe.decode_ids(bpe.encode_texts(spark.createDataFrame([], SCHEMA), PATH), PATH)
    assert empty.count() == 0


def test_null_ids_and_ids_outside_the_vocabulary(spark):
    assert bpe.decode_ids(spark.createDataFrame([(1, None)], "id long, ids binary"), PATH).collect()[0].decoded == ""
    bad = spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\x00"))], "id long, ids binary")
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode_ids(bad, PATH).collect()


def test_most_frequent_words(spark):
    frame = spark.createDataFrame([(1, "b b a, a c"), (2, "A b")], SCHEMA)
    assert bpe.frequent_words(frame, PATH, words=2) == [b"a", b"b"]


def test_the_lexicon_is_minimal_and_finds_its_words():
    words = {word.encode(): [len(word), i] for i, word in enumerate("tap taps top tops stop stops a é".split())}
    held = lexicon.Lexicon(lexicon.build(words.items()))
    asked = [*words, b"", b"ta", b"tapss", b"x", "è".encode()]
    sizes = np.array([len(word) for word in asked])
    ends = np.cumsum(sizes)
    found = held.find(np.frombuffer(b"".join(asked), np.uint8), ends - sizes, ends)
    for word, place in zip(asked, found.tolist(), strict=True):
        assert (place >= 0) == (word in words)
        if place >= 0:
            assert held.ids[held.offsets[place] : held.offsets[place + 1]].tolist() == words[word]
    # "ap", "op" and their plurals share their ends: fewer states than a trie has.
    assert len(held.final) == 8
    empty = lexicon.Lexicon(lexicon.build([]))
    assert empty.find(np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2])).tolist() == [-1]

"""Encoding and decoding against the tokenizers library, text by text."""

import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from tallydesk.llm import bpe  # noqa: E402

TEXTS = [
    "Hello, world. a.b x.. 5, é. end.",
    "it's, ok. <|endoftext|>. A.<|startoftext|>b <|ENDOFTEXT|>",
    "é Å K İstanbul ΟΔΟΣ ﬁ ‍﻿ x y",
    "",
    None,
    " \t\n\x0b\x0c\r ",
    "日本語, テキスト. 😀👍🏽",
    "word " * 5000,
    "x" * 20_000,
    "\x00\x1f\x7f a\x85b",
]


@pytest.fixture(scope="module")
def definition():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def library(definition):
    tokenizer = tokenizers.Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.mark.parametrize("block_bytes", [64, 1 << 20])
def test_ids_and_text_are_those_of_the_library(spark, definition, library, block_bytes):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    coded = bpe.encode(docs, definition, block_bytes=block_bytes)
    got = {row["doc_id"]: row for row in bpe.decode(coded, definition).collect()}
    assert len(got) == len(TEXTS)
    for n, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[n]["ids"] == ids and got[n]["text"] == text
        assert got[n]["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_rows_with_null_ids_repeats_and_clashing_names_all_stay(spark, definition, library):
    rows = [(None, "a b", "x", [1]), (None, "a b", "x", [1]), (1, None, None, None), (1, "c", "y", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, ids array<int>")
    got = bpe.encode(docs.withColumn("_block", F.lit(5)).withColumn("words", F.lit("w")), definition)
    assert got.columns == ["doc_id", "text", "block", "_block", "words", "ids"]
    expected = library.encode("a b", add_special_tokens=False).ids
    assert [row["ids"] for row in got.filter("doc_id IS NULL").collect()] == [expected, expected]


def test_no_rows_give_no_rows(spark, definition):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(docs, definition), definition).count() == 0


def test_unknown_and_missing_ids_decode_to_nothing(spark, definition):
    rows = [(1, [-1, 267, 10**8, 267]), (2, None), (3, []), (4, [10**8])]
    got = bpe.decode(spark.createDataFrame(rows, "n int, ids array<int>"), definition)
    assert {row["n"]: row["decoded"] for row in got.collect()} == {1: ",</w> ,</w>", 2: "", 3: "", 4: ""}


def test_tokenizers_that_keep_white_space_are_refused(spark):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        other = file.read()
    docs = spark.createDataFrame([(1, "a b", [1])], "doc_id long, text string, ids array<int>")
    with pytest.raises(ValueError, match="white space"):
        bpe.encode(docs.drop("ids"), other)
    with pytest.raises(ValueError, match="decoder"):
        bpe.decode(docs, other)


@pytest.mark.parametrize(
    "splitter, parts",
    [
        (None, False),
        ({"type": "Whitespace"}, True),
        ({"type": "WhitespaceSplit"}, False),
        ({"type": "Sequence", "pretokenizers": []}, False),
        ({"type": "Split", "pattern": {"Regex": r" ?\p{L}+|."}, "behavior": "Removed", "invert": True}, False),
        ({"type": "Split", "pattern": {"Regex": r"\S+"}, "behavior": "Removed", "invert": True}, False),
        ({"type": "Split", "pattern": {"Regex": r"\p{L}+|[.,]"}, "behavior": "Isolated", "invert": True}, False),
        ({"type": "Split", "pattern": {"Regex": r"\p{L}+|[.,]"}, "behavior": "Removed", "invert": True}, True),
    ],
)
def test_which_splitters_part_words(splitter, parts):
    assert bpe._parts_words(splitter) == parts

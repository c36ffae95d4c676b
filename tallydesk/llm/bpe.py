"""Encoding and decoding with a byte-pair vocabulary, word by distinct word.

White space never takes part in a token, so a text's tokens are those of its words one after the
other. Documents are dealt into blocks by a hash of their values. Each block lists its distinct
words; lists are dealt by a hash of the word, so that every distinct word of the corpus is encoded
once; the ids go back to the blocks and are joined to the words of each text by position.

Per block and word bucket one row moves, with all words in it, sorted. The block works its list out
anew from its texts, so ids come back without the words.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallydesk.llm.common import blocks_for, col, fresh, row_key

# Texts of one block, in bytes: a task holds one block.
BLOCK_BYTES = 12 << 20

# Words of this many texts are looked up at a time.
_TEXTS_AT_ONCE = 512

_tokenizers: dict[int, object] = {}


def _tokenizer(definition: str):
    """A tokenizer per worker process."""
    key = hash(definition)
    if key not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(definition)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _tokenizers[key] = tokenizer
    return _tokenizers[key]


def _part(definition: str, name: str):
    """One part of a tokenizer file, without reading its vocabulary."""
    found = re.search(rf'"{name}"\s*:\s*', definition)
    return json.JSONDecoder().raw_decode(definition, found.end())[0] if found else None


def _parts_words(splitter: dict | None) -> bool:
    """Whether a pre-tokenizer drops white space, and parts stops and commas from the words before them."""
    if splitter is None:
        return False
    if splitter["type"] == "Sequence":
        return bool(splitter["pretokenizers"]) and _parts_words(splitter["pretokenizers"][0])
    if splitter["type"] == "Split" and splitter["behavior"] == "Removed" and splitter["invert"] and "Regex" in splitter["pattern"]:
        return regex.findall(splitter["pattern"]["Regex"], " ab cd.  ef,\tgh\n.\r\n") == ["ab", "cd", ".", "ef", ",", "gh", "."]
    return splitter["type"] in ("Whitespace", "BertPreTokenizer")


# A full stop or comma after an ASCII letter and before white space: there every word pattern parts them.
_TRAILING = re.compile(rb"[.,](?<=[A-Za-z][.,])(?=[ \t\n\r\f\v]|\Z)")


def _words(text: bytes | None) -> list[bytes]:
    """Runs without ASCII white space, which is white space to every tokenizer.

    A stop or comma that ends a word is a word of its own, so that fewer distinct words move.
    """
    return _TRAILING.sub(rb" \g<0>", text).split() if text else []


def _buckets(texts: list[bytes | None], buckets: int) -> list[list[bytes]]:
    """The distinct words of some texts, sorted, by bucket."""
    distinct: set[bytes] = set()
    for text in texts:
        distinct.update(_words(text))
    dealt: list[list[bytes]] = [[] for _ in range(buckets)]
    for word in sorted(distinct):
        dealt[zlib.crc32(word) % buckets].append(word)
    return dealt


def _pressed(data: bytes) -> bytes:
    """What moves between blocks is much alike and packs well."""
    return pa.Codec("zstd", compression_level=9).compress(data, asbytes=True)


def _unpressed(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, "zstd", asbytes=True) if size else b""


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs, told in the first byte."""
    width = next(n for n in (1, 2, 4) if values.size == 0 or values.max() < 1 << 8 * n)
    return bytes([width]) + _pressed(values.astype(f"<u{width}").tobytes())


def _unpacked(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(_unpressed(data[1:], data[0] * count), f"<u{data[0]}").astype(np.int64)


def encode(docs: DataFrame, definition: str, text: str = "text", ids: str = "ids", block_bytes: int = BLOCK_BYTES, keep: Sequence[str] | None = None) -> DataFrame:
    """The rows (of the columns ``keep``, else all) with their token ids as one more column.

    ``definition`` is the text of a tokenizer file; one whose tokens may hold white space is refused.
    A null or empty text has no ids. Rows that repeat are all kept. Other columns pass through; one that is called ``ids`` already is replaced.
    """
    if not _parts_words(_part(definition, "pre_tokenizer")):
        raise ValueError("the tokenizer does not part texts at white space")
    docs = docs.drop(ids)
    spark = docs.sparkSession
    n_blocks = blocks_for(docs, F.octet_length(col(text)), block_bytes)
    block, other = fresh(docs.columns, "_block"), [c for c, kind in docs.dtypes if kind in ("bigint", "int", "string") and c != text]
    in_block = docs.withColumn(block, F.pmod(row_key(text, *other), F.lit(n_blocks)))
    shipped = spark.sparkContext.broadcast(definition)

    def list_words(table: pa.Table) -> pa.Table:
        own = table.column(block)[0].as_py()
        dealt = _buckets(table.column(text).cast(pa.binary()).to_pylist(), n_blocks)
        used = [(bucket, b" ".join(words)) for bucket, words in enumerate(dealt) if words]
        return pa.table(
            {
                "bucket": pa.array([bucket for bucket, _ in used], pa.int64()),
                "block": pa.array([own] * len(used), pa.int64()),
                "size": pa.array([len(words) for _, words in used], pa.int64()),
                "words": pa.array([_pressed(words) for _, words in used], pa.binary()),
            }
        )

    def encode_words(table: pa.Table) -> pa.Table:
        sizes, pressed = table.column("size").to_pylist(), table.column("words").to_pylist()
        lists = [_unpressed(words, size).split(b" ") for words, size in zip(pressed, sizes, strict=True)]
        distinct = list({word for words in lists for word in words})
        known: dict[bytes, np.ndarray] = {}
        for start in range(0, len(distinct), 4096):
            part = distinct[start : start + 4096]
            found = _tokenizer(shipped.value).encode_batch([w.decode() for w in part], add_special_tokens=False)
            known.update((word, np.array(e.ids, np.int64)) for word, e in zip(part, found, strict=True))
        coded = [[known[word] for word in words] for words in lists]
        return pa.table(
            {
                "block": table.column("block"),
                "bucket": table.column("bucket"),
                "lengths": pa.array([_packed(np.array([len(x) for x in codes])) for codes in coded], pa.binary()),
                "codes": pa.array([_packed(np.concatenate(codes)) for codes in coded], pa.binary()),
            }
        )

    kept = [c for c in docs.columns if keep is None or c in keep]

    def join_back(left: pa.Table, right: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # of the block before
        texts = left.column(text).cast(pa.binary()).to_pylist()
        place, lengths, codes = {}, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        dealt = _buckets(texts, n_blocks)
        rows = right.sort_by("bucket")
        for bucket, sizes, data in zip(*(rows.column(c).to_pylist() for c in ("bucket", "lengths", "codes")), strict=True):
            for word in dealt[bucket]:
                place[word] = len(place)
            lengths.append(_unpacked(sizes, len(dealt[bucket])))
            codes.append(_unpacked(data, int(lengths[-1].sum())))
        length, code = np.concatenate(lengths), np.concatenate(codes).astype(np.int32)
        first = np.cumsum(length) - length
        chunks = []
        for start in range(0, len(texts), _TEXTS_AT_ONCE):
            words = [_words(t) for t in texts[start : start + _TEXTS_AT_ONCE]]
            at = np.fromiter((place[w] for ws in words for w in ws), np.int64)
            sizes = length[at]
            ends = np.concatenate(([0], np.cumsum(sizes)))
            values = code[np.repeat(first[at] - ends[:-1], sizes) + np.arange(ends[-1])]
            bounds = ends[np.concatenate(([0], np.cumsum([len(ws) for ws in words]))).astype(np.int64)]
            chunks.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32())))
        return left.select(kept).append_column(ids, pa.chunked_array(chunks, pa.list_(pa.int32())))

    lists = in_block.groupBy(block).applyInArrow(list_words, "bucket long, block long, size long, words binary")
    coded = lists.groupBy("bucket").applyInArrow(encode_words, "block long, bucket long, lengths binary, codes binary")
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return in_block.groupBy(block).cogroup(coded.groupBy("block")).applyInArrow(join_back, schema)


def pieces_of(definition: str) -> list[str | None]:
    """The piece of each id, special tokens included; None where an id is not used."""
    told = json.loads(definition)
    by_id = {number: piece for piece, number in told["model"]["vocab"].items()}
    by_id |= {token["id"]: token["content"] for token in told.get("added_tokens", [])}
    return [by_id.get(number) for number in range(max(by_id, default=-1) + 1)]


def decode(encoded: DataFrame, definition: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows with the text of their ids as one more column: the pieces, joined by spaces.

    Ids are looked up by position in the vocabulary, which a tokenizer file bounds, as one constant
    array that every task holds; no rows meet in a join. Unknown ids are left out; null ids give an
    empty text. Files with a decoder of their own are refused. A column that is called ``text``
    already is replaced.
    """
    if _part(definition, "decoder") is not None:
        raise ValueError("pieces are joined by spaces, which is not what the tokenizer's decoder does")
    pieces = F.from_json(F.lit(json.dumps(pieces_of(definition))), "array<string>")
    found = F.transform(col(ids), lambda number: F.get(pieces, number))
    return encoded.drop(text).withColumn(text, F.coalesce(F.array_join(found, " "), F.lit("")))

"""Where two tokenizers agree on token ends, over a corpus.

Texts are shuffled whole, so that every distinct one is tokenized and aligned once, however many
documents have it. Both tokenizers cut a text at a single space between two characters that are no
white space, so a text is aligned word by word and a task remembers its words. Each distinct text
gives one row with its pairs of token ids and how often it links them; beside these a task adds its
pairs up, by how many documents have the text, so that a few rows per task make the counts of the
corpus. Counts meet the pairs of the texts in slices of bounded size, and the measures of a text
meet its documents by a digest of the text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallydesk.llm.common import col, staged

# Pairs of ids whose counts a task holds at a time: some 20 MB.
SLICE_PAIRS = 1_000_000

# A pair is one number: the id of A above this bit, that of B below it.
_B_BITS = 24

_CACHED_WORDS = 400_000
_CACHED_LETTERS = 4_096
_PAIRS_AT_ONCE = 2_000_000

MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [byte for byte in range(256) if byte not in set(plain)]
    return {chr(byte): byte for byte in plain} | {chr(256 + n): byte for n, byte in enumerate(rest)}


class Aligner:
    """Tokenizes words by both vocabularies and cuts them where both tokens end.

    ``definition`` is a byte-level tokenizer file of the tokenizers library, ``model`` a file of the
    sentencepiece library that adds a space before a text and has byte pieces.
    """

    # A single space between characters that no tokenizer takes for white space.
    _SPACE = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, definition: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(definition)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        letters = byte_letters()
        vocabulary = json.loads(definition)["model"]["vocab"]
        a_bytes = {number: bytes(letters[c] for c in piece) for piece, number in vocabulary.items() if all(c in letters for c in piece)}
        self.a_bytes = [a_bytes.get(number, b"") for number in range(max(vocabulary.values(), default=-1) + 1)]
        self.b_bytes = [self._piece(number) for number in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in own] or [0], np.int64) for own in (self.a_bytes, self.b_bytes))
        # What is written for a token: its id, then what parts it from the next one.
        self.first_b = 2 * len(self.a_bytes)
        written = [f"{n}{mark}" for n in range(len(self.a_bytes)) for mark in ",|"]
        self.written = pa.array(written + [f"{n}{mark}" for n in range(len(self.b_bytes)) for mark in ",;"])
        self.forget()

    def _piece(self, number: int) -> bytes:
        piece = self.b.id_to_piece(number)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(number) else piece.replace("▁", " ").encode()

    def forget(self) -> None:
        """What is known of words: their numbers, and by number where their tokens and links begin."""
        self.place: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []

    def words(self, text: str) -> list[str]:
        return self._SPACE.split(text)

    def _tokens(self, words: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of both and, for every word, whether both give its bytes back."""
        a = [own.ids for own in self.a.encode_batch([" " + word for word in words], add_special_tokens=False)]
        b = self.b.encode(words, num_threads=1)
        whole = [b" " + word.encode() for word in words]
        same = [
            b"".join(map(self.a_bytes.__getitem__, x)) == text and b"".join(map(self.b_bytes.__getitem__, y)) == text
            for x, y, text in zip(a, b, whole, strict=True)
        ]
        return a, b, same

    def _align(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Of words, one after the other: whether bytes agree, n_a, n_b, links, written tokens; the codes of what is written, and the linked pairs."""
        a, b, same = self._tokens(words)
        a, b = ([own if good else [] for own, good in zip(x, same, strict=True)] for x in (a, b))
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        a_ids, b_ids = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        # Words have as many bytes on either side, so ends can be counted on from word to word.
        a_ends, b_ends = np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids])
        a_last, b_last = (_among(x, y) for x, y in ((a_ends, b_ends), (b_ends, a_ends)))
        a_group, b_group = (np.cumsum(x) - x for x in (a_last, b_last))
        codes = np.concatenate((2 * a_ids + a_last, self.first_b + 2 * b_ids + b_last))
        codes = codes[np.argsort(np.concatenate((2 * a_group, 2 * b_group + 1)), kind="stable")]
        pairs = a_ids[a_last] << _B_BITS | b_ids[b_last]
        owner = np.repeat(np.arange(len(words)), n_a)
        links = np.bincount(owner[a_last], minlength=len(words))
        return np.array(same, bool), n_a, n_b, links, n_a + n_b, codes.astype(np.int32), pairs

    def measure(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of every text n_a, n_b, n_groups and the digest of its groups; its linked pairs, and where those of each text end."""
        if len(self.place) > _CACHED_WORDS:
            self.forget()
        new = list(dict.fromkeys(word for words in texts for word in words if word not in self.place))
        for start in range(0, len(new), 4096):
            part = new[start : start + 4096]
            self.parts.append(self._align(part))
            known = len(self.place)
            self.place.update((word, known + n) for n, word in enumerate(part))
        if len(self.parts) > 1:
            self.parts = [tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))]
        same, n_a, n_b, links, written, codes, pairs = self.parts[0]
        sizes = np.array([len(words) for words in texts], np.int64)
        at = np.fromiter((self.place[word] for words in texts for word in words), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(texts)), sizes)
        good = np.bincount(of[~same[at]], minlength=len(texts)) == 0
        at, of = at[good[of]], of[good[of]]
        n_text = len(texts)
        sums = [np.bincount(of, weights=own[at], minlength=n_text).astype(np.int64) for own in (n_a, n_b, links, written)]
        lines = self.written.take(pa.array(codes[_spans(written, at)]))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sums[3]))), pa.int32()), lines), "")
        digests = [hashlib.sha256(line[:-1].encode()).hexdigest() if line else "" for line in joined.to_pylist()]
        linked = pairs[_spans(links, at)]
        if len(self.place) > _CACHED_WORDS or any(len(word) > _CACHED_LETTERS for word in new):
            self.forget()  # so that no task keeps what very long words come to
        return sums[0], sums[1], sums[2], digests, linked, np.cumsum(sums[2])


def _among(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which values of a sorted array another sorted one has."""
    if not len(others):
        return np.zeros(len(values), bool)
    return others[np.minimum(others.searchsorted(values), len(others) - 1)] == values


def _spans(sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of what some rows have, row after row, where all rows' values stand one after the other."""
    starts, own = (np.cumsum(sizes) - sizes)[rows], sizes[rows]
    ends = np.cumsum(own)
    return np.repeat(starts - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)


def _runs(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the sums of their weights."""
    order = np.argsort(values, kind="stable")
    sorted_values = values[order]
    starts = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return sorted_values[starts], np.add.reduceat(weights[order], starts) if len(starts) else np.zeros(0, np.int64)


def _text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


_PARTS = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("n_a", T.LongType()),
        T.StructField("n_b", T.LongType()),
        T.StructField("n_groups", T.LongType()),
        T.StructField("groups_sha256", T.StringType()),
        T.StructField("pairs", T.ArrayType(T.LongType())),
        T.StructField("times", T.ArrayType(T.LongType())),
    ]
)


def _part(keys: list, numbers: list[tuple], digests: list, pairs: list[np.ndarray], times: list[np.ndarray]) -> pa.RecordBatch:
    ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
    nothing = [np.zeros(0, np.int64)]
    lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts or nothing), pa.int64())) for parts in (pairs, times)]
    counts = [pa.array([x[n] for x in numbers], pa.int64()) for n in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *counts, pa.array(digests, pa.string()), *lists], names=_PARTS.names)


def _align_texts(texts: DataFrame, definition: str, model: bytes) -> DataFrame:
    """A row per text of (key, text, copies), and rows without key with pair counts over many texts."""
    shipped = texts.sparkSession.sparkContext.broadcast((definition, model))

    def align(batches) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*shipped.value)
        seen, sums, held = [], [], 0
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                batch = whole.slice(start, 128)
                n_a, n_b, n_groups, digests, linked, ends = aligner.measure([aligner.words(text) for text in batch.column("text").to_pylist()])
                found = [_runs(own, np.ones(len(own), np.int64)) for own in np.split(linked, ends[:-1])]
                pairs, times = [own for own, _ in found], [count for _, count in found]
                yield _part(batch.column("key").to_pylist(), list(zip(n_a, n_b, n_groups, strict=True)), digests, pairs, times)
                copies = np.repeat(batch.column("copies").to_numpy(), [len(x) for x in pairs])
                seen.append(np.concatenate(pairs))
                sums.append(np.concatenate(times) * copies)
                held += len(seen[-1])
                if held > _PAIRS_AT_ONCE:
                    own, total = _runs(np.concatenate(seen), np.concatenate(sums))
                    seen, sums, held = [own], [total], len(own)
                    if held > _PAIRS_AT_ONCE // 2:
                        yield _part([None], [(0, 0, 0)], [None], seen, sums)
                        seen, sums, held = [], [], 0
        if held:
            own, total = _runs(np.concatenate(seen), np.concatenate(sums))
            yield _part([None], [(0, 0, 0)], [None], [own], [total])

    return texts.mapInArrow(align, _PARTS)


def pair_counts(parts: DataFrame) -> DataFrame:
    """(pair, count, is_best): how many links of the corpus each pair has, and whether its B id has none with more."""
    sums = parts.filter("key IS NULL").select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = sums.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"))
    counts = staged(counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1))), "pair_counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("is_best"))


def _measured(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """The texts with n_links, n_best and count_sum as far as their pairs are among ``counts``, which the driver holds."""
    table = counts.toArrow().sort_by("pair")
    columns = [table.column(name).to_numpy() for name in ("pair", "count", "is_best")]
    shipped = parts.sparkSession.sparkContext.broadcast(tuple(np.ascontiguousarray(c) for c in columns))
    names = ["key", "n_a", "n_b", "n_groups", "groups_sha256"]
    schema = T.StructType([*[_PARTS[name] for name in names], *[T.StructField(n, T.LongType()) for n in ("n_links", "n_best", "count_sum")]])

    def measure(batches):
        pairs, count, is_best = shipped.value
        for batch in batches:
            own, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
            sizes = batch.column("pairs").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.minimum(pairs.searchsorted(own), max(0, len(pairs) - 1))
            met = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
            here = np.where(met, times, 0)
            total = count[at] if len(pairs) else here
            best = is_best[at] if len(pairs) else met
            ends = np.cumsum(sizes)
            sums = []
            for values in (here, here * best, here * total):
                running = np.concatenate(([0], np.cumsum(values)))
                sums.append(pa.array(running[ends] - running[ends - sizes], pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *sums], names=schema.names)

    return parts.select(*names, "pairs", "times").mapInArrow(measure, schema)


def _text_measures(parts: DataFrame, slice_pairs: int) -> DataFrame:
    counts = staged(pair_counts(parts), "counted_pairs")
    texts, slices = parts.filter("key IS NOT NULL"), max(1, -(-counts.count() // slice_pairs))
    if slices == 1:
        return _measured(texts, counts)
    dealt = F.pmod(F.xxhash64("pair"), F.lit(slices))
    found = reduce(DataFrame.unionByName, [_measured(texts, counts.filter(dealt == number)) for number in range(slices)])
    same = [F.first(name).alias(name) for name in ("n_a", "n_b", "n_groups", "groups_sha256")]
    return found.groupBy("key").agg(*same, *[F.sum(name).alias(name) for name in ("n_links", "n_best", "count_sum")])


def align(docs: DataFrame, definition: str, model: bytes, text: str = "text", slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """The rows with the measures of their text's alignment: ``n_a``, ``n_b`` (tokens), ``n_groups``,
    ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256``.

    A encodes a space and the text, B the text, to which it adds the space itself. Offsets where
    tokens of both end cut them into groups, and there the two tokens are linked. ``count_sum`` adds
    up, over the links of a text, how many links of the corpus have the same two ids; ``n_best``
    counts the links whose pair no other pair of the same B id exceeds. The corpus is all rows, also
    those that repeat. Null and empty texts and those that either vocabulary does not give back byte
    by byte have no tokens: zeros and an empty digest. Other columns pass through; those called like
    the new ones are replaced.
    """
    names = [name for name in docs.columns if name.lower() not in MEASURES]
    plain = [f"c{n}" for n in range(len(names))]
    given = docs.select(*[col(name).alias(new) for name, new in zip(names, plain, strict=True)], F.nullif(col(text), F.lit("")).alias("_text"))
    # Rows of a text are counted on the map side first: a text that many documents have is no hot task.
    distinct = given.filter("_text IS NOT NULL").groupBy("_text").agg(F.count(F.lit(1)).alias("copies"))
    texts = distinct.select(_text_key(F.col("_text")).alias("key"), F.col("_text").alias("text"), "copies")
    parts = staged(_align_texts(texts, definition, model), "aligned_texts")
    measures = _text_measures(parts, slice_pairs)
    keyed = given.withColumn("key", _text_key(F.col("_text"))).drop("_text")
    found = keyed.join(measures, "key", "left")
    whole = [F.coalesce(F.col(name), F.lit("" if name == "groups_sha256" else 0)).alias(name) for name in MEASURES]
    return found.select(*plain, *whole).toDF(*names, *MEASURES)

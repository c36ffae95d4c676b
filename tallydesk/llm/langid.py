"""Language of a text by sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are trained by follow-the-regularised-leader with elastic-net penalties (McMahan et al.,
"Ad Click Prediction: a View from the Trenches", 2013), which leaves most of them zero; a
temperature is then fitted on rows kept apart, so that scores are probabilities.

N-grams of whole texts are hashed into buckets. Document frequencies are counted over all rows to
learn from; the weights are fitted on a bounded sample of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallydesk.llm.common import col, plain_columns
from tallydesk.llm.sampling import class_counts, sampled

UNDETERMINED = "und"


@dataclass(frozen=True)
class NgramSettings:
    """N-grams of 1 to ``longest`` characters in 2^``bits`` buckets; the sample has about
    ``per_language`` texts of each language, none longer than ``longest_bytes``."""

    longest: int = 3
    bits: int = 15
    per_language: int = 1_500
    longest_bytes: int = 1 << 20
    epochs: int = 2
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.01


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    settings: NgramSettings


_CHARS_AT_ONCE = 1 << 20
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def has_letter(text: str) -> bool:
    """Of the Unicode categories of letters; signs for numbers are none."""
    return any(map(str.isalpha, text))


def ngram_counts(text: str, settings: NgramSettings) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole lower-cased text."""
    counts = np.zeros(1 << settings.bits, np.int64)
    shift, lowered = np.uint32(32 - settings.bits), text.lower()
    for start in range(0, len(lowered), _CHARS_AT_ONCE):
        piece = lowered[start : start + _CHARS_AT_ONCE + settings.longest - 1]
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        own = min(_CHARS_AT_ONCE, len(lowered) - start)
        mixed = np.zeros(len(codes), np.uint32)
        for n in range(settings.longest):
            if n >= len(codes):
                break
            mixed = (mixed[: len(codes) - n] ^ codes[n:]) * _FACTORS[n]
            mixed ^= mixed >> np.uint32(15)
            hashed = (mixed[: min(own, len(codes) - n)] * _FACTORS[-1]) >> shift
            counts += np.bincount(hashed, minlength=len(counts))
    return counts


def _features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their TF-IDF weights, scaled to length one."""
    used = np.flatnonzero(counts)
    weights = (1 + np.log(counts[used])) * idf[used]
    return used, weights / max(float(np.sqrt((weights * weights).sum())), 1e-12)


def document_frequencies(rows: DataFrame, text: str, settings: NgramSettings) -> tuple[int, np.ndarray]:
    """Rows with a text, and how many of them each bucket occurs in: a sum per partition, added up."""

    def count(batches):
        seen, total = np.zeros(1 << settings.bits, np.int64), 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen += ngram_counts(value, settings) > 0
                total += 1
        used = np.flatnonzero(seen)
        buckets = np.concatenate(([-1], used))
        yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(np.concatenate(([total], seen[used])))], names=["bucket", "df"])

    partial = rows.filter(col(text).isNotNull()).select(col(text).alias("text")).mapInArrow(count, "bucket long, df long")
    table = partial.groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    buckets, df = table.column("bucket").to_numpy(), table.column("df").to_numpy()
    frequency = np.zeros(1 << settings.bits)
    frequency[buckets[buckets >= 0]] = df[buckets >= 0]
    return int(df[buckets < 0].sum()), frequency


def _softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


def _ftrl(examples: list[tuple], classes: int, settings: NgramSettings) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias; ``examples`` are (buckets, values, class)."""
    size = (1 << settings.bits) + 1  # the last one is the bias, which no penalty holds down
    z, n = np.zeros((size, classes)), np.zeros((size, classes))
    l1 = np.full((size, 1), settings.l1)
    l1[-1] = 0

    def weights(rows):
        moved = z[rows] - np.sign(z[rows]) * l1[rows]
        return np.where(np.abs(z[rows]) > l1[rows], -moved / ((settings.beta + np.sqrt(n[rows])) / settings.alpha + settings.l2), 0)

    order = np.random.default_rng(7)
    for _ in range(settings.epochs):
        for at in order.permutation(len(examples)):
            buckets, values, label = examples[at]
            rows, x = np.append(buckets, size - 1), np.append(values.astype(float), 1.0)
            w = weights(rows)
            error = _softmax(x @ w)
            error[label] -= 1
            gradient = np.outer(x, error)
            squared = n[rows] + gradient * gradient
            z[rows] += gradient - (np.sqrt(squared) - np.sqrt(n[rows])) / settings.alpha * w
            n[rows] = squared
    w = weights(np.arange(size))
    return w[:-1], w[-1]


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, from a fine geometric grid."""
    if not len(labels):
        return 1.0
    grid = np.geomspace(0.02, 20, 241)
    losses = [-np.log(_softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


def fit(rows: DataFrame, label: str = "lang", text: str = "text", settings: NgramSettings = NgramSettings()) -> LanguageModel:
    """Learn from rows with a text and a label; every fifth row of the sample fits the temperature only.

    Without such rows the model knows no language and calls every text undetermined.
    """
    usable = rows.filter(col(text).isNotNull() & col(label).isNotNull())
    counts = class_counts(usable, label)
    languages = tuple(sorted(counts))
    total, frequency = document_frequencies(usable, text, settings)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    sample = sampled(usable, label, text, settings.per_language, counts, settings.longest_bytes)
    found = ((_features(ngram_counts(value, settings), idf), languages.index(name)) for value, name in sample if has_letter(value))
    examples = [(buckets.astype(np.int32), values.astype(np.float32), number) for (buckets, values), number in found]
    del sample
    if not examples:
        return LanguageModel((), idf, np.zeros((len(idf), 0)), np.zeros(0), 1.0, settings)
    apart, kept = examples[4::5], [e for n, e in enumerate(examples) if n % 5 != 4]
    weights, bias = _ftrl(kept, len(languages), settings)
    logits = np.array([values @ weights[buckets] + bias for buckets, values, _ in apart]).reshape(-1, len(languages))
    heat = _temperature(logits, np.array([e[2] for e in apart], int))
    return LanguageModel(languages, idf, weights.astype(np.float32), bias, heat, settings)


def classify(model: LanguageModel, text: str | None) -> tuple[str, float]:
    """The language of a whole text and its probability; undetermined (0) without text, letter or model.

    Of languages that are equally probable the first by name is told.
    """
    if text is None or not model.languages or not has_letter(text):
        return UNDETERMINED, 0.0
    buckets, values = _features(ngram_counts(text, model.settings), model.idf)
    shares = _softmax((values @ model.weights[buckets] + model.bias) / model.temperature)
    best = int(np.argmax(shares))
    return model.languages[best], float(shares[best])


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The rows (of the columns ``keep``, else all) with ``lang_pred`` and ``score``.

    Only the text is looked at; rows that repeat get the same. Columns called like the new ones, in
    any case, are replaced.
    """
    slim, names = plain_columns(docs, text, keep, ("lang_pred", "score"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def label_batches(batches):
        for batch in batches:
            found = [classify(model, value) for value in batch.column(len(names)).to_pylist()]
            languages = pa.array([name for name, _ in found], pa.string())
            scores = pa.array([score for _, score in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], languages, scores], names=schema.names)

    return slim.mapInArrow(label_batches, schema).toDF(*names, "lang_pred", "score")

"""Quality of a text by ordinal regression on graded ratings.

One score f(x), linear in hashed text features, is shared by all grades; ordered thresholds cut it:
P(grade >= k) = logistic(f(x) - t_k), with t_1 < t_2 < ... (McCullagh, "Regression Models for
Ordinal Data", 1980). That gives an expected grade and the probability of a tail of grades, by which
texts are selected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallydesk.llm.common import col, plain_columns
from tallydesk.llm.sampling import class_counts, labelled_sample


@dataclass(frozen=True)
class OrdinalSettings:
    """2^``bits`` buckets; the sample has about ``per_grade`` texts of each grade, none longer than
    ``longest_bytes``; ``least_grade`` starts the tail that is selected."""

    bits: int = 16
    per_grade: int = 2_000
    longest_bytes: int = 1 << 20
    steps: int = 200
    rate: float = 0.1
    ridge: float = 1e-4
    least_grade: int = 1
    least_probability: float = 0.5


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    settings: OrdinalSettings


_TOKEN = re.compile(r"\w+|[^\w\s]+")
_CACHED_TOKENS = 300_000


def _shape(token: str) -> str:
    """Kind of a token: its letters' case, digits, or the signs themselves."""
    if token.isupper() and len(token) > 1:
        return "UPPER"
    if token[0].isalpha():
        return "Title" if token[0].isupper() else "lower"
    return "digits" if token[0].isdigit() else token[:4]


class _Buckets(dict):
    """The two buckets of a token, its own and its shape's; the common ones are remembered."""

    def __init__(self, bits: int):
        super().__init__()
        self.shift = 64 - bits

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) >= _CACHED_TOKENS:
            self.clear()
        own = xxhash.xxh3_64_intdigest(token.lower()) >> self.shift
        value = self[token] = (own, xxhash.xxh3_64_intdigest(_shape(token), 1) >> self.shift)
        return value

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the whole text and their shares, scaled to length one."""
        counts = Counter()
        for token, n in Counter(_TOKEN.findall(text)).items():
            own, shape = self[token]
            counts[own] += n
            counts[shape] += n
        buckets = np.fromiter(counts, np.int64, len(counts))
        values = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        return buckets, values / max(float(np.sqrt((values * values).sum())), 1e-12)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _ordered(raw: np.ndarray) -> np.ndarray:
    """Thresholds from free numbers: the first as it is, the others by positive steps."""
    return np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def train(examples: list[tuple], grades: int, shares: np.ndarray, settings: OrdinalSettings) -> OrdinalModel:
    """``examples`` are (buckets, values, grade); ``shares`` weights them. Adam on the whole sample."""
    sizes = np.array([len(buckets) for buckets, _, _ in examples])
    starts = np.cumsum(sizes) - sizes
    buckets, values = np.concatenate([e[0] for e in examples]), np.concatenate([e[1] for e in examples])
    owner = np.repeat(np.arange(len(examples)), sizes)
    grade = np.array([e[2] for e in examples])
    parameters = [np.zeros(1 << settings.bits), np.concatenate([[-1.0], np.zeros(grades - 2)]) if grades > 1 else np.zeros(0)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    for step in range(1, settings.steps + 1):
        w, raw = parameters
        cuts = _ordered(raw)
        f = np.add.reduceat(w[buckets] * values, starts)
        # Tails P(>= k), with 1 before the first threshold and 0 after the last.
        tails = np.concatenate([np.ones((len(f), 1)), _logistic(f[:, None] - cuts), np.zeros((len(f), 1))], axis=1)
        slopes = tails * (1 - tails)
        rows = np.arange(len(f))
        chance = np.maximum(tails[rows, grade] - tails[rows, grade + 1], 1e-12)
        scale = shares / chance / shares.sum()
        to_f = -scale * (slopes[rows, grade] - slopes[rows, grade + 1])
        to_cuts = np.zeros((len(f), len(cuts) + 2))
        to_cuts[rows, grade] += scale * slopes[rows, grade]
        to_cuts[rows, grade + 1] -= scale * slopes[rows, grade + 1]
        by_cut = to_cuts[:, 1:-1].sum(axis=0)
        to_raw = np.cumsum(by_cut[::-1])[::-1] * np.concatenate([[1.0], np.exp(raw[1:])])
        to_w = np.bincount(buckets, to_f[owner] * values, 1 << settings.bits) + settings.ridge * w
        for n, gradient in enumerate((to_w, to_raw)):
            first, second = moments[n]
            first += 0.1 * (gradient - first)
            second += 0.001 * (gradient**2 - second)
            parameters[n] = parameters[n] - settings.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return OrdinalModel(parameters[0].astype(np.float32), _ordered(parameters[1]), settings)


def fit(
    docs: DataFrame,
    ratings: DataFrame,
    grade: str = "grade",
    text: str = "text",
    id_column: str = "doc_id",
    settings: OrdinalSettings = OrdinalSettings(),
) -> OrdinalModel:
    """Learn from the documents that ``ratings`` gives a grade, a whole number from 0.

    Ratings of documents that are missing or have no tokens teach nothing. Without two grades the
    model has no threshold to learn: all texts then get the one grade there is, or 0.
    """
    usable = ratings.filter((col(grade) >= 0) & col(id_column).isNotNull())
    counts = class_counts(usable, grade)
    highest = max(counts, default=0)
    known = _Buckets(settings.bits)
    sample = labelled_sample(docs, usable, grade, text, id_column, settings.per_grade, counts, settings.longest_bytes)
    examples = [(*known.features(value), number) for value, number in sample if _TOKEN.search(value)]
    if len({number for _, _, number in examples}) < 2:
        return OrdinalModel(np.zeros(1 << settings.bits, np.float32), np.full(highest, -35.0), settings)
    drawn = Counter(number for _, _, number in examples)
    shares = np.array([counts[number] / drawn[number] for _, _, number in examples], float)
    return train(examples, highest + 1, shares, settings)


def rate(docs: DataFrame, model: OrdinalModel, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The rows (of the columns ``keep``, else all) with ``expected_grade``, ``tail_probability`` and ``kept``.

    ``tail_probability`` is that of ``least_grade`` and better. A text without tokens, a null one
    too, has grade 0 and is not kept; rows that repeat are rated alike. Columns called like the new
    ones, in any case, are replaced.
    """
    new = ("expected_grade", "tail_probability", "kept")
    slim, names = plain_columns(docs, text, keep, new)
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField(new[0], T.DoubleType()), T.StructField(new[1], T.DoubleType()), T.StructField(new[2], T.BooleanType())])
    settings = model.settings

    def rate_batches(batches):
        known = _Buckets(settings.bits)
        for batch in batches:
            expected, tail = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for n, value in enumerate(batch.column(len(names)).to_pylist()):
                if value and _TOKEN.search(value):
                    buckets, values = known.features(value)
                    tails = _logistic(float(values @ model.weights[buckets]) - model.thresholds)
                    expected[n] = tails.sum()
                    wanted = settings.least_grade
                    tail[n] = 1.0 if wanted <= 0 else tails[wanted - 1] if wanted <= len(tails) else 0.0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(expected), pa.array(tail), pa.array(tail >= settings.least_probability)],
                names=schema.names,
            )

    return slim.mapInArrow(rate_batches, schema).toDF(*names, *new)

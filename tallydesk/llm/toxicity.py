"""Toxicity of a text by a small recurrent network that reads all its windows.

Words come in as a hashed word vector and the mean of hashed character-trigram vectors. A gated
recurrent unit reads them in either direction, attention pools its states, and a logistic unit gives
the window's score. A text is as toxic as its worst window; a calibration over texts turns that into
a probability. Windows overlap and cover every word. The network is trained in numpy on a bounded
sample of labelled texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallydesk.llm.common import col, plain_columns
from tallydesk.llm.sampling import class_counts, labelled_sample


@dataclass(frozen=True)
class NetworkSettings:
    """Sizes of the network, the windows (in words) and the sample: about ``per_label`` texts of each
    label, none longer than ``longest_bytes``."""

    word_bits: int = 13
    char_bits: int = 12
    word_size: int = 8
    char_size: int = 12
    state: int = 8
    attention: int = 8
    window: int = 48
    stride: int = 36
    per_label: int = 2_500
    longest_bytes: int = 1 << 20
    epochs: int = 8
    batch: int = 128
    rate: float = 0.01
    word_dropout: float = 0.3
    decay: float = 1e-5
    threshold: float = 0.3
    seed: int = 11


@dataclass
class Network:
    settings: NetworkSettings
    weights: dict[str, np.ndarray]
    calibration: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0]))
    base_rate: float = 0.0
    fitted: bool = False


_WORD = re.compile(r"\w+")
_CACHED_WORDS = 200_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def window_starts(n: int, settings: NetworkSettings) -> list[int]:
    """Starts of overlapping windows over n words; the last one ends with the last word."""
    if n == 0:
        return []
    last = max(0, n - settings.window)
    return [*range(0, last, settings.stride), last]


def _new_network(settings: NetworkSettings) -> Network:
    draw = np.random.default_rng(settings.seed)

    def normal(*shape, scale):
        return (draw.standard_normal(shape) * scale).astype(np.float32)

    size, h = settings.word_size + settings.char_size, settings.state
    weights = {
        "words": normal(1 << settings.word_bits, settings.word_size, scale=0.1),
        "chars": normal(1 << settings.char_bits, settings.char_size, scale=0.3),
        "attend": normal(2 * h, settings.attention, scale=(2 * h) ** -0.5),
        "focus": normal(settings.attention, scale=0.5),
        "out": normal(2 * h, scale=(2 * h) ** -0.5),
        "out_bias": np.zeros(1, np.float32),
    }
    for way in ("f", "b"):
        weights["in_" + way] = normal(size, 3 * h, scale=size**-0.5)
        weights["bias_" + way] = np.zeros(3 * h, np.float32)
        weights["rec_" + way] = normal(h, 3 * h, scale=h**-0.5)
    return Network(settings, weights)


def _inputs(words: Sequence[str], settings: NetworkSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket of each word; character-trigram buckets of all words in a row, and how many each has."""
    buckets = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    buckets = (buckets >> np.uint64(64 - settings.word_bits)).astype(np.int64)
    joined = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(w) for w in words), np.int64, len(words))  # a word of n letters has n trigrams
    ends = np.cumsum(sizes + 2)
    inside = np.ones(len(joined), bool)
    inside[ends - 1] = inside[ends - 2] = False
    at = np.flatnonzero(inside)
    mixed = joined[at] * np.uint32(0x9E3779B1) ^ joined[at + 1] * np.uint32(0x85EBCA77) ^ joined[at + 2] * np.uint32(0xC2B2AE3D)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    return buckets, (mixed >> np.uint32(32 - settings.char_bits)).astype(np.int64), sizes


def _word_vectors(weights: dict, buckets: np.ndarray, trigrams: np.ndarray, sizes: np.ndarray, heard: np.ndarray | None = None) -> np.ndarray:
    starts = np.cumsum(sizes) - sizes
    chars = np.add.reduceat(weights["chars"][trigrams], starts, axis=0) / sizes[:, None].astype(np.float32)
    word = weights["words"][buckets]
    return np.concatenate([word if heard is None else word * heard[:, None], chars], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _read(inputs: np.ndarray, rows: np.ndarray, mask: np.ndarray, recurrent: np.ndarray, backward: bool, trace: list | None) -> np.ndarray:
    """States [window, step, state] of one direction. ``inputs`` holds each word's projection."""
    windows, steps = rows.shape
    h = recurrent.shape[0]
    state, states = np.zeros((windows, h), np.float32), np.zeros((windows, steps, h), np.float32)
    for t in reversed(range(steps)) if backward else range(steps):
        given, past = inputs[rows[:, t]], state @ recurrent
        gates = _sigmoid(given[:, : 2 * h] + past[:, : 2 * h])
        reset, update = gates[:, :h], gates[:, h:]
        new = np.tanh(given[:, 2 * h :] + reset * past[:, 2 * h :])
        on = mask[:, t, None]
        following = state + on * (1 - update) * (new - state)
        if trace is not None:
            trace.append((t, state, past, reset, update, new, on))
        state = following
        states[:, t] = state
    return states


def _forward(weights: dict, vectors: np.ndarray, rows: np.ndarray, mask: np.ndarray, traces: dict | None = None):
    """Logits of the windows whose words are ``rows`` of ``vectors``, and what the way back needs."""
    states = []
    for way in ("f", "b"):
        trace = None if traces is None else traces.setdefault(way, [])
        states.append(_read(vectors @ weights["in_" + way] + weights["bias_" + way], rows, mask, weights["rec_" + way], way == "b", trace))
    both = np.concatenate(states, axis=2)
    attended = np.tanh(both @ weights["attend"])
    focus = np.where(mask > 0, attended @ weights["focus"], -1e9)
    share = np.exp(focus - focus.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    pooled = np.einsum("wt,wts->ws", share, both)
    return pooled @ weights["out"] + weights["out_bias"], (both, attended, share, pooled)


def _summed(places: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Rows of ``values`` added up by place."""
    order = np.argsort(places, kind="stable")
    found, starts = np.unique(places[order], return_index=True)
    total = np.zeros((size, values.shape[1]), np.float32)
    total[found] = np.add.reduceat(values[order], starts, axis=0)
    return total


def _gradients(weights: dict, given: tuple, vectors: np.ndarray, rows: np.ndarray, mask: np.ndarray, labels: np.ndarray, heard: np.ndarray) -> dict:
    """Gradients of the mean log loss, by going back through attention and time."""
    buckets, trigrams, sizes = given
    traces: dict[str, list] = {}
    logits, (both, attended, share, pooled) = _forward(weights, vectors, rows, mask, traces)
    h = weights["rec_f"].shape[0]
    error = ((_sigmoid(logits) - labels) / len(labels)).astype(np.float32)
    found = {"out": pooled.T @ error, "out_bias": error.sum(keepdims=True)}
    to_pooled = error[:, None] * weights["out"]
    to_share = np.einsum("ws,wts->wt", to_pooled, both)
    to_focus = share * (to_share - (share * to_share).sum(axis=1, keepdims=True))
    found["focus"] = np.einsum("wt,wta->a", to_focus, attended)
    to_attended = to_focus[:, :, None] * weights["focus"] * (1 - attended**2)
    found["attend"] = np.einsum("wts,wta->sa", both, to_attended)
    to_both = share[:, :, None] * to_pooled[:, None, :] + to_attended @ weights["attend"].T
    to_vectors = np.zeros_like(vectors)
    for way, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
        to_state = np.zeros((len(labels), h), np.float32)
        to_given = np.zeros((*rows.shape, 3 * h), np.float32)
        recurrent = weights["rec_" + way]
        to_recurrent = np.zeros_like(recurrent)
        for t, state, past, reset, update, new, on in reversed(traces[way]):
            to_state = to_state + to_both[:, t, part]
            to_new = to_state * on * (1 - update) * (1 - new**2)
            to_update = to_state * on * (state - new) * update * (1 - update)
            to_reset = to_new * past[:, 2 * h :] * reset * (1 - reset)
            to_past = np.concatenate([to_reset, to_update, to_new * reset], axis=1)
            to_given[:, t] = np.concatenate([to_reset, to_update, to_new], axis=1)
            to_recurrent += state.T @ to_past
            to_state = to_state * (1 - on * (1 - update)) + to_past @ recurrent.T
        to_inputs = _summed(rows.ravel(), to_given.reshape(-1, 3 * h), len(vectors))
        found["rec_" + way], found["bias_" + way] = to_recurrent, to_inputs.sum(axis=0)
        found["in_" + way] = vectors.T @ to_inputs
        to_vectors += to_inputs @ weights["in_" + way].T
    size = weights["words"].shape[1]
    found["words"] = _summed(buckets, to_vectors[:, :size] * heard[:, None], len(weights["words"]))
    spread = np.repeat(to_vectors[:, size:] / sizes[:, None].astype(np.float32), sizes, axis=0)
    found["chars"] = _summed(trigrams, spread, len(weights["chars"]))
    return found


def _rows_of(windows: Sequence[tuple[np.ndarray, int]], settings: NetworkSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of some windows (a text and a start each), the windows as rows of them, and which places are filled."""
    places = np.stack([_places(np.array([start]), len(text), settings)[0] for text, start in windows])
    words = np.stack([np.where(at >= 0, text[at], text[0]) for (text, _), at in zip(windows, places, strict=True)])
    numbers, rows = np.unique(words, return_inverse=True)
    return numbers, rows.reshape(words.shape), (places >= 0).astype(np.float32)


class CodedTexts:
    """Texts as numbers of their words, with the inputs of every distinct word: some bytes a word, no strings."""

    def __init__(self, texts: Iterable[Sequence[str]], settings: NetworkSettings):
        place: dict[str, int] = {}
        self.texts = [np.array([place.setdefault(word, len(place)) for word in words], np.int32) for words in texts]
        names = list(place)
        parts = [_inputs(names[n : n + 10_000], settings) for n in range(0, len(names), 10_000)]
        nothing = [np.zeros(0, np.int64)]
        self.buckets, self.trigrams, sizes = (np.concatenate([p[n].astype(np.int32) for p in parts] or nothing) for n in range(3))
        self.ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))

    def inputs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_inputs``, of the words with these numbers."""
        sizes = self.ends[numbers + 1] - self.ends[numbers]
        ends = np.cumsum(sizes)
        at = np.repeat(self.ends[numbers] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.buckets[numbers].astype(np.int64), self.trigrams[at].astype(np.int64), sizes

    def window_logits(self, weights: dict, texts: Sequence[np.ndarray], settings: NetworkSettings) -> list[np.ndarray]:
        numbers = np.unique(np.concatenate(texts))
        vectors = _word_vectors(weights, *self.inputs(numbers))
        inputs = {way: vectors @ weights["in_" + way] + weights["bias_" + way] for way in ("f", "b")}
        return _window_logits(weights, inputs, [np.searchsorted(numbers, text) for text in texts], settings)


def _logits(weights: dict, inputs: dict, rows: np.ndarray, mask: np.ndarray) -> np.ndarray:
    states = [_read(inputs[way], rows, mask, weights["rec_" + way], way == "b", None) for way in ("f", "b")]
    both = np.concatenate(states, axis=2)
    focus = np.where(mask > 0, np.tanh(both @ weights["attend"]) @ weights["focus"], -1e9)
    share = np.exp(focus - focus.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    return np.einsum("wt,wts->ws", share, both) @ weights["out"] + weights["out_bias"]


def _places(starts: np.ndarray, size: int, settings: NetworkSettings) -> np.ndarray:
    """Places of the words of some windows over ``size`` words; -1 where a window has no word."""
    places = starts[:, None] + np.arange(settings.window)
    return np.where(places < size, places, -1)


def _window_logits(weights: dict, inputs: dict, texts: Sequence[np.ndarray], settings: NetworkSettings) -> list[np.ndarray]:
    """The logits of all windows of each text, given as rows of ``inputs``."""
    counts, parts = [], []
    for at in texts:
        starts = window_starts(len(at), settings)
        counts.append(len(starts))
        if starts:
            places = _places(np.array(starts), len(at), settings)
            parts.append(np.where(places >= 0, at[places], -1))
    rows = np.concatenate(parts) if parts else np.zeros((0, settings.window), np.int64)
    logits = [np.zeros(0, np.float32)]
    for start in range(0, len(rows), 4096):
        part = rows[start : start + 4096]
        logits.append(_logits(weights, inputs, np.maximum(part, 0), (part >= 0).astype(np.float32)))
    return np.split(np.concatenate(logits), np.cumsum(counts)[:-1]) if counts else []


class Scorer:
    """Logits of whole texts. Each word's vector and projections are worked out once and remembered."""

    def __init__(self, network: Network):
        self.network, self.place = network, {}
        self.projected: list[dict[str, np.ndarray]] = []

    def _remember(self, words: list[str]) -> None:
        weights, settings = self.network.weights, self.network.settings
        vectors = _word_vectors(weights, *_inputs(words, settings))
        self.projected.append({way: vectors @ weights["in_" + way] + weights["bias_" + way] for way in ("f", "b")})
        known = len(self.place)
        self.place.update({word: known + n for n, word in enumerate(words)})

    def window_logits(self, texts: Sequence[Sequence[str]]) -> list[np.ndarray]:
        """The logits of all windows of each text, given as its words."""
        weights, settings = self.network.weights, self.network.settings
        if len(self.place) > _CACHED_WORDS:
            self.place, self.projected = {}, []
        unknown = list(dict.fromkeys(w for words in texts for w in words if w not in self.place))
        if unknown:
            self._remember(unknown)
        inputs = {way: np.concatenate([p[way] for p in self.projected]) for way in ("f", "b")} if self.projected else {}
        self.projected = [inputs] if inputs else []
        return _window_logits(weights, inputs, [np.fromiter(map(self.place.__getitem__, words), np.int64, len(words)) for words in texts], settings)

    def worst_windows(self, texts: Iterable[str | None]) -> list[tuple[float | None, int]]:
        """Of each text the highest logit over all its windows (None without words) and their number."""
        found = self.window_logits([words_of(text) for text in texts])
        return [(float(logits.max()) if len(logits) else None, len(logits)) for logits in found]

def _train(network: Network, coded: CodedTexts, kept: Sequence[int], labels: np.ndarray) -> None:
    """Windows inherit the text's label: random ones at first, later the worst one of a text and a random one."""
    settings, weights = network.settings, network.weights
    texts = [coded.texts[n] for n in kept]
    draw = np.random.default_rng(settings.seed)
    first, second, step = {k: np.zeros_like(w) for k, w in weights.items()}, {k: np.zeros_like(w) for k, w in weights.items()}, 0
    for epoch in range(settings.epochs):
        chosen, targets, worst = [], [], None
        if epoch >= settings.epochs // 2:
            worst = [int(np.argmax(x)) for n in range(0, len(texts), 64) for x in coded.window_logits(weights, texts[n : n + 64], settings)]
        for n, (words, label) in enumerate(zip(texts, labels, strict=True)):
            starts = window_starts(len(words), settings)
            if worst is None:
                picked = {int(s) for s in draw.choice(starts, min(3, len(starts)), replace=False)}
            else:
                picked = {starts[worst[n]]} if label else {starts[worst[n]], int(draw.choice(starts))}
            chosen += [(n, start) for start in sorted(picked)]
            targets += [label] * len(picked)
        order = draw.permutation(len(chosen))
        for start in range(0, len(order), settings.batch):
            part = order[start : start + settings.batch]
            numbers, rows, mask = _rows_of([(texts[n], at) for n, at in (chosen[x] for x in part)], settings)
            given = coded.inputs(numbers)
            heard = (draw.random(len(numbers)) >= settings.word_dropout).astype(np.float32)
            vectors = _word_vectors(weights, *given, heard)
            found = _gradients(weights, given, vectors, rows, mask, np.array([targets[n] for n in part], np.float32), heard)
            step += 1
            rate = settings.rate * (1 - epoch / settings.epochs)
            for name, gradient in found.items():
                first[name] += 0.1 * (gradient - first[name])
                second[name] += 0.001 * (gradient**2 - second[name])
                weights[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8) + rate * settings.decay * weights[name]).astype(np.float32)


def _calibrated(worst: np.ndarray, windows: np.ndarray, labels: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Logistic coefficients over (worst logit, log of windows, 1), weighted back to the true shares."""
    x = np.stack([worst, np.log(windows), np.ones(len(worst))], axis=1)
    beta, ridge = np.array([1.0, 0.0, 0.0]), np.diag([1e-3, 1e-1, 1e-3]) * len(worst) / 100
    for _ in range(50):
        p = _sigmoid(x @ beta)
        gradient = x.T @ (shares * (p - labels)) + ridge @ (beta - np.array([1.0, 0, 0]))
        change = np.linalg.solve((x * (shares * p * (1 - p))[:, None]).T @ x + ridge, gradient)
        beta = beta - np.clip(change, -2, 2)
    return beta if beta[0] > 0 else np.array([1.0, 0.0, 0.0])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    text: str = "text",
    id_column: str = "doc_id",
    settings: NetworkSettings = NetworkSettings(),
) -> Network:
    """Learn from the documents that ``labels`` gives a 0 or 1; every fifth one of the sample calibrates only.

    Labels of documents that are missing or have no words teach nothing. Without words under both
    labels every text scores the share of ones.
    """
    usable = labels.filter(col(label).isin(0, 1) & col(id_column).isNotNull())
    counts = class_counts(usable, label)
    network = _new_network(settings)
    network.base_rate = counts.get(1, 0) / max(1, sum(counts.values()))
    sample = labelled_sample(docs, usable, label, text, id_column, settings.per_label, counts, settings.longest_bytes)
    sample = [(value, name) for value, name in sample if _WORD.search(value)]
    names = np.array([name for _, name in sample], np.float32)
    coded = CodedTexts((words_of(value) for value, _ in sample), settings)
    del sample  # its strings are many times the size of the numbers
    kept, apart = [n for n in range(len(names)) if n % 5 != 4], [n for n in range(len(names)) if n % 5 == 4]
    if set(names[kept].tolist()) != {0, 1}:
        return network
    _train(network, coded, kept, names[kept])
    network.fitted = True
    labels = names[apart].astype(float)
    if set(labels.tolist()) == {0, 1}:
        scored = [x for n in range(0, len(apart), 64) for x in coded.window_logits(network.weights, [coded.texts[m] for m in apart[n : n + 64]], settings)]
        drawn = {name: max(1, int((labels == name).sum())) for name in (0, 1)}
        shares = np.array([counts[int(n)] / drawn[int(n)] for n in labels]) / sum(counts.values()) * len(labels)
        network.calibration = _calibrated(np.array([x.max() for x in scored], float), np.array([len(x) for x in scored], float), labels, shares)
    return network


def score(docs: DataFrame, network: Network, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The rows (of the columns ``keep``, else all) with ``score`` and ``predicted``.

    Only the text is looked at, all of it. A text without words, null ones too, scores the share of
    toxic texts; rows that repeat score alike. Columns called like the new ones, in any case, are
    replaced.
    """
    slim, names = plain_columns(docs, text, keep, ("score", "predicted"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def score_batches(batches):
        scorer = Scorer(network)
        known = scorer.network
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                if known.fitted:
                    worst = scorer.worst_windows(part.column(len(names)).to_pylist())
                    x = np.array([(w, np.log(n), 1.0) if n else (np.nan,) * 3 for w, n in worst])
                    scores = _sigmoid(x @ known.calibration)
                    scores = np.where(np.isnan(scores), known.base_rate, scores)
                else:
                    scores = np.full(part.num_rows, known.base_rate)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(scores), pa.array((scores >= known.settings.threshold).astype(np.int32))],
                    names=schema.names,
                )

    return slim.mapInArrow(score_batches, schema).toDF(*names, "score", "predicted")

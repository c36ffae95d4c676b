"""Language, toxicity and quality models on small invented texts: held-out accuracy and odd input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallydesk.llm import langid, quality, sampling, toxicity

SYLLABLES = {"aa": "ba be bi bo bu".split(), "bb": "zön zük zäl ßt xü".split(), "cc": "кот дом лес мир сон".split()}


def invented(draw, language, words):
    return " ".join("".join(draw.choice(SYLLABLES[language]) for _ in range(draw.randrange(1, 4))) for _ in range(words))


def odd_rows(extra):
    texts = [None, "", " \n", "123 456", "!!!", "\x00", "\ud83d".encode("utf-16", "surrogatepass").decode("utf-16", "replace")]
    return [(1000 + n, text, *extra) for n, text in enumerate(texts)]


@pytest.fixture(scope="module")
def speech(spark):
    draw = random.Random(4)
    rows = [(n, invented(draw, language, draw.choice([1, 3, 40])), language) for n, language in enumerate(["aa", "bb", "cc"] * 60)]
    return spark.createDataFrame(rows + odd_rows((None,)), "doc_id long, text string, lang string")


def test_language_of_held_out_texts(speech):
    held_out = sampling.fold_of("doc_id", 5) == 0
    model = langid.fit(speech.filter(~held_out))
    got = langid.predict(speech, model).filter(held_out & F.col("lang").isNotNull()).collect()
    assert len(got) > 20 and all(row["lang_pred"] == row["lang"] and 0 <= row["score"] <= 1 for row in got)


def test_texts_without_letters_are_undetermined(speech):
    got = langid.predict(speech, langid.fit(speech)).filter("doc_id >= 1000 AND doc_id < 1006")
    assert {(row["lang_pred"], row["score"]) for row in got.collect()} == {("und", 0.0)}


def test_weights_are_sparse_and_long_texts_are_read_whole(speech):
    model = langid.fit(speech)
    assert (model.weights == 0).mean() > 0.5
    settings = langid.NgramSettings()
    text = "ab" * 300 + "ж" + "cd" * 300
    whole = langid.ngram_counts(text, settings)
    before, langid._CHARS_AT_ONCE = langid._CHARS_AT_ONCE, 64
    try:
        assert (langid.ngram_counts(text, settings) == whole).all()
    finally:
        langid._CHARS_AT_ONCE = before
    assert whole.sum() == len(text) * 3 - 3


def test_language_without_anything_to_learn(spark):
    nothing = spark.createDataFrame([(1, "ab", None)], "doc_id long, text string, lang string")
    got = langid.predict(nothing, langid.fit(nothing)).first()
    assert (got["lang_pred"], got["score"]) == ("und", 0.0)
    assert langid.predict(nothing.limit(0), langid.fit(nothing.limit(0))).count() == 0


@pytest.fixture(scope="module")
def talk(spark):
    """Every fourth text has a bad word somewhere, long ones too."""
    draw = random.Random(9)
    rows, labels = [], []
    for n in range(600):
        words = invented(draw, "aa", draw.choice([5, 60, 300])).split()
        if n % 4 == 0:
            for _ in range(1 + len(words) // 40):
                words.insert(draw.randrange(len(words)), draw.choice(["vile", "nasty"]))
        rows.append((n, " ".join(words), "x"))
        labels.append((n, int(n % 4 == 0), n % 3))
    docs = spark.createDataFrame(rows + odd_rows(("y",)), "doc_id long, text string, score string")
    return docs, spark.createDataFrame(labels + [(5000, 1, 0), (None, 1, 0), (3, None, None)], "doc_id long, toxic int, grade int")


def test_toxicity_of_held_out_texts(talk):
    docs, labels = talk
    held_out = sampling.fold_of("doc_id", 4) == 2
    network = toxicity.fit(docs, labels.filter(~held_out))
    scored = toxicity.score(docs, network)
    assert scored.columns == ["doc_id", "text", "score", "predicted"]
    rows = scored.filter(held_out & (F.col("doc_id") < 600)).collect()
    assert np.mean([row["predicted"] == (row["doc_id"] % 4 == 0) for row in rows]) > 0.95
    assert all(0 <= row["score"] <= 1 for row in scored.collect()) and scored.count() == docs.count()


def test_gradients_are_those_of_small_changes():
    settings = toxicity.NetworkSettings(word_bits=4, char_bits=4, window=6)
    network = toxicity._new_network(settings)
    weights = network.weights = {name: w.astype(np.float64) for name, w in network.weights.items()}
    coded = toxicity.CodedTexts([["ab", "c", "ab", "def"], ["c"]], settings)
    numbers, rows, mask = toxicity._rows_of([(text, 0) for text in coded.texts], settings)
    given, labels, heard = coded.inputs(numbers), np.array([1.0, 0.0]), np.ones(3)

    def loss():
        logits, _ = toxicity._forward(weights, toxicity._word_vectors(weights, *given, heard), rows, mask)
        p = toxicity._sigmoid(logits)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    found = toxicity._gradients(weights, given, toxicity._word_vectors(weights, *given, heard), rows, mask, labels, heard)
    draw = np.random.default_rng(0)
    for name, gradient in found.items():
        for at in draw.integers(0, gradient.size, 4):
            place, step = np.unravel_index(at, gradient.shape), 1e-3
            kept = weights[name][place]
            weights[name][place] = kept + step
            more = loss()
            weights[name][place] = kept - step
            less = loss()
            weights[name][place] = kept
            assert gradient[place] == pytest.approx((more - less) / (2 * step), abs=2e-3), name


@pytest.mark.parametrize("n", [0, 1, 47, 48, 49, 84, 85, 1000])
def test_windows_overlap_and_cover_every_word(n):
    settings = toxicity.NetworkSettings()
    starts = toxicity.window_starts(n, settings)
    assert {w for s in starts for w in range(s, min(n, s + settings.window))} == set(range(n))
    assert len(set(starts)) == len(starts)
    assert all(b - a <= settings.stride for a, b in zip(starts, starts[1:], strict=False))


def test_toxicity_without_labels_scores_their_share(talk, spark):
    docs, labels = talk
    network = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert {row["score"] for row in toxicity.score(docs.limit(9), network).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_grades_of_texts(spark):
    draw = random.Random(2)
    words = {0: ["junk!!", "###"], 1: ["fair"], 2: ["fine"], 3: ["superb"]}
    rows = [(n, invented(draw, "aa", 20) + " " + " ".join(words[n % 4] * 4)) for n in range(400)]
    docs = spark.createDataFrame(rows + odd_rows(()), "doc_id long, text string").withColumn("kept", F.lit("own"))
    ratings = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 4).cast("int").alias("grade"))
    model = quality.fit(docs, ratings)
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 3
    rated = quality.rate(docs, model)
    means = {row["g"]: row["m"] for row in rated.filter("doc_id BETWEEN 200 AND 399").groupBy((F.col("doc_id") % 4).alias("g")).agg(F.avg("expected_grade").alias("m")).collect()}
    assert means[0] < means[1] < means[2] < means[3]
    unseen = rated.filter("doc_id BETWEEN 200 AND 399").collect()
    assert np.mean([row["kept"] == (row["doc_id"] % 4 >= 1) for row in unseen]) > 0.95
    assert not any(row["kept"] for row in rated.filter("doc_id IN (1000, 1001, 1002)").collect())


def test_grades_without_ratings(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, grade int"))
    assert quality.rate(docs, none).first()["expected_grade"] == 0
    one = quality.fit(docs, spark.createDataFrame([(1, 2)], "doc_id long, grade int"))
    assert quality.rate(docs, one).first()["expected_grade"] == pytest.approx(2)


def test_samples_are_bounded_and_count_repeats_once(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "'same text' AS text", "CAST(id % 2 AS STRING) AS label")
    counts = sampling.class_counts(rows, "label")
    assert counts == {"0": 2000, "1": 2000}
    assert 100 < len(sampling.sampled(rows, "label", "text", 100, counts, 1 << 20)) < 320
    same = spark.range(4000).selectExpr("1 AS doc_id", "'t' AS text", "'a' AS label")
    assert len(sampling.sampled(same, "label", "text", 5000, {"a": 4000}, 1 << 20)) == 1


def test_the_sample_is_bounded_for_any_number_of_rows():
    """A share is not rounded up beyond what the largest tables need."""
    assert sampling._GRAINS >= 10**12


def test_longer_texts_than_the_bound_teach_nothing(spark):
    rows = spark.createDataFrame([(n, "a" * n, "x") for n in range(1, 200)], "doc_id long, text string, label string")
    drawn = sampling.sampled(rows, "label", "text", 1_000, {"x": 199}, 50)
    assert sorted(len(text) for text, _ in drawn) == list(range(1, 51))


def test_signs_for_numbers_are_no_letters(spark, talk):
    docs, _ = talk
    model = langid.fit(docs.withColumn("lang", F.lit("aa")))
    for text in ("½ ² 2024", "Ⅷ 10 _", "", None):
        assert langid.classify(model, text) == ("und", 0.0)
    assert langid.classify(model, "² ª")[0] == "aa"


def test_equally_probable_languages_go_by_name():
    settings = langid.NgramSettings(bits=4)
    model = langid.LanguageModel(("aa", "bb"), np.ones(16), np.zeros((16, 2)), np.zeros(2), 1.0, settings)
    assert langid.classify(model, "any text") == ("aa", 0.5)


def test_dots_and_case_of_other_names(spark, talk):
    """Columns with dots pass through; those called like a new one in another case are replaced; repeated rows agree."""
    docs, labels = talk
    rows = spark.createDataFrame([(1, "some text", 1, 2, 3, 4, 5)] * 2, "doc_id long, text string, `a.b` int, Score int, LANG_pred int, Kept int, PREDICTED int")
    network, model = toxicity.fit(docs, labels), langid.fit(docs.withColumn("lang", F.lit("aa")))
    rated = quality.fit(docs, labels.withColumn("grade", F.col("toxic")))
    for found, names in (
        (toxicity.score(rows, network), ["doc_id", "text", "a.b", "LANG_pred", "Kept", "score", "predicted"]),
        (langid.predict(rows, model), ["doc_id", "text", "a.b", "Kept", "PREDICTED", "lang_pred", "score"]),
        (quality.rate(rows, rated), ["doc_id", "text", "a.b", "Score", "LANG_pred", "PREDICTED", "expected_grade", "tail_probability", "kept"]),
    ):
        assert found.columns == names
        assert len({tuple(row) for row in found.collect()}) == 1 and found.count() == 2
        assert quality.rate(rows.limit(0), rated).count() == 0


def test_a_very_long_text_is_scored_whole():
    """The one bad word near its end counts; scores are those of all windows, one by one."""
    settings = toxicity.NetworkSettings(word_bits=8, char_bits=8)
    network = toxicity._new_network(settings)
    words = ["fine", "words", "here"] * 40_000 + ["vile"] + ["end"] * 30
    (logits,) = toxicity.Scorer(network).window_logits([words])
    starts = toxicity.window_starts(len(words), settings)
    assert len(logits) == len(starts)
    for at in (0, len(starts) // 2, len(starts) - 1):
        window = words[starts[at] : starts[at] + settings.window]
        coded = toxicity.CodedTexts([window], settings)
        assert coded.window_logits(network.weights, coded.texts, settings)[0][0] == pytest.approx(logits[at], abs=1e-5)

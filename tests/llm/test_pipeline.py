"""The pipeline on a small invented corpus, stage by stage, against what each stage must do."""

import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

SYLLABLES = "ba be bi bo bu da de di do du".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(6)

    def words(n):
        return ["".join(draw.choice(SYLLABLES) for _ in range(draw.randrange(1, 4))) for _ in range(n)]

    passage = " ".join(words(30))
    rows, labels = [], []
    for n in range(600):
        text = words(draw.choice([8, 60, 200]))
        if n % 5 == 0:
            for _ in range(1 + len(text) // 30):
                text.insert(draw.randrange(len(text)), draw.choice(["vile", "nasty"]))
        rows.append((n, " ".join(text), "aa", "s", len(text), "x"))
        labels.append((n, 1, int(n % 5 == 0)))
    long = " ".join(words(150))
    rows += [(1000, long, "aa", "s", 1, "x"), (1001, long, "aa", "s", 1, "y"), (1002, long + " ba", None, "s", 1, "x")]
    rows += [(1100, f"{' '.join(words(50))} {passage} {' '.join(words(50))}", "aa", "s", 1, "x")]
    rows += [(1200, "12 34", "aa", "s", 1, "x"), (1201, None, None, None, None, None), (None, " ".join(words(40)), "aa", "s", 1, "x")]
    rows += [rows[1], rows[1]]
    path = str(tmp_path_factory.mktemp("corpus"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_take_effect_and_clean_documents_stay(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder).cache()
        held[name] = docs
        if name != "encoding":
            assert docs.columns == before.columns and docs.schema == before.schema
    ids = {name: {row["doc_id"] for row in df.select("doc_id").collect()} for name, df in held.items()}
    clean, toxic = {n for n in range(600) if n % 5}, set(range(0, 600, 5))
    assert len(clean - ids["toxicity"]) <= 0.05 * len(clean) and len(toxic & ids["toxicity"]) <= 0.05 * len(toxic)
    assert {1000, 1001, 1002, 1100, 1201, None} <= ids["toxicity"]
    assert ids["language"] == ids["toxicity"] - {1200, 1201}
    assert ids["near_duplicates"] == ids["language"] - {1001, 1002}
    assert ids["decontamination"] == ids["near_duplicates"] - {1100}
    assert ids["encoding"] == ids["decontamination"]
    assert held["near_duplicates"].filter("doc_id = 1").count() == 1  # of rows that repeat, one

    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {row["doc_id"]: row["text"] for row in held["decontamination"].collect()}
    for row in held["encoding"].collect():
        expected = tokenizer.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        assert row["ids"] == expected and row["n_tokens"] == len(expected)


def test_run_is_all_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "encoding"]


def test_an_empty_corpus_stays_empty(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

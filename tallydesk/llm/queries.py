"""The queries over the test tables, one per operator, with the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallydesk.llm import alignment, bpe, decontamination, html, langid, lexical, licenses, linededup, neardup, quality, sampling, sharding, topk, toxicity
from tallydesk.llm.common import table, tokenizer_definition

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the ids of every text and of what they decode to."""
    definition = tokenizer_definition()
    encoded = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), definition, keep=["doc_id"])
    decoded = bpe.decode(encoded, definition)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op10_minmax_neardup(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents that share four fifths of their word pairs."""
    return neardup.near_duplicates(table(spark, folder, "documents"), neardup.MinMax(width=2)).drop("text_hash")


@query
def op3_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in 16 shards whose counts are at most one apart."""
    sharded = sharding.shard(table(spark, folder, "documents"), shards=16)
    text = F.coalesce("text", F.lit(""))
    return sharded.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and statements of every document."""
    scanned = licenses.scan(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.transform(F.filter("places", lambda place: place["is_base"]), lambda place: place["start"])
    return scanned.select("doc_id", "n_words", base.alias("starts"), "base_labels", "labels", "score").select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", "labels").alias("labels"),
        "score",
    )


@query
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark items that documents hold."""
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_hash")


ORACLES["op9_decontamination"] = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '') AS ws FROM benchmark),
dn AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM d WHERE len(ws) > 0),
bn AS (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM b WHERE len(ws) > 0),
ds AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM dn),
bs AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 4], ' ') AS s FROM bn),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
h AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM h JOIN n USING (item_id) WHERE n_shared * 100 >= n_item * 80
"""


def _license_oracle() -> str:
    """Every template word by word, at every place of the first word of its first phrase."""

    def at(start: str, offset: int, phrase: list[str]) -> str:
        wanted = ", ".join(f"'{word}'" for word in phrase)
        return f"ws[{start} + {offset + 1}:{start} + {offset + len(phrase)}] = [{wanted}]"

    selects, firsts = [], set()
    for template in licenses.TEMPLATES:
        place, (first, *_) = template.mandatory()[0]
        firsts.add(first)
        phrases = " AND ".join(at("s", *found) for found in template.mandatory())
        source = f"(SELECT doc_id, ws, p - {place} AS s FROM hits WHERE w = '{first}')"
        same = " + ".join(f"coalesce((ws[s + {n + 1}] = '{word}')::INT, 0)" for n, word in enumerate(template.words))
        selects.append(
            f"SELECT doc_id, '{template.label}' AS label, {str(template.base).lower()} AS is_base, s, "
            f"({same})::DOUBLE / {len(template.words)} AS coverage, {template.percent} AS percent FROM {source} WHERE s >= 0 AND {phrases}"
        )
    return f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(len(ws))) AS p FROM w),
hits AS (SELECT doc_id, ws, p, ws[p + 1] AS w FROM starts WHERE ws[p + 1] IN ({', '.join(f"'{first}'" for first in sorted(firsts))})),
places AS ({' UNION ALL '.join(selects)}),
sums AS (SELECT doc_id, count(*) FILTER (is_base) AS n_base, min(s) FILTER (is_base) AS first_word, max(s) FILTER (is_base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM places WHERE coverage * 100 >= percent GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM w LEFT JOIN sums USING (doc_id)
"""


ORACLES["op6_licenses"] = _license_oracle()


@query
def op5_topk_products(spark: SparkSession, folder: str) -> DataFrame:
    """The five largest whole-number products of every fiftieth vector with all others."""
    return topk.top_products(table(spark, folder, "embeddings"), query_every=50, k=5)


ORACLES["op5_topk_products"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, coalesce(list_dot_product(q.x, c.x), 0)::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, x FROM v WHERE vec_id % 50 = 0) q JOIN v c ON len(q.x) = len(c.x) AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op8_langid(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from four of five folds."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = sampling.fold_of("doc_id", 5) == 0
    model = langid.fit(docs.filter(~held_out))
    return langid.predict(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from three of four folds of the labels."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = sampling.fold_of("doc_id", 4) == 2
    network = toxicity.fit(docs, table(spark, folder, "labels").filter(~held_out))
    return toxicity.score(docs, network, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op2_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """The visible text of every page."""
    return html.extract_text(table(spark, folder, "pages")).select("page_id", "url", "text")


@query
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Expected grade of every document: 0 for low quality, 1 for good but toxic, 2 for good and clean."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    model = quality.fit(docs, table(spark, folder, "labels").withColumn("grade", grade))
    return quality.rate(docs, model, keep=["doc_id"])


@query
def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that ten documents share, as a digest of what stays."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = linededup.kept_text(docs, linededup.keep_bitmaps(docs, linededup.LineRule(documents=10, characters=1)))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op12_line_dedup"] = """
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS place FROM cut),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT *, k IN (SELECT k FROM common) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten documents that score highest for every benchmark item."""
    return lexical.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


_LEXICAL_TERMS = "regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLES["op13_lexical_search"] = f"""
WITH d AS (SELECT doc_id, {_LEXICAL_TERMS.format(text="text")} AS ts FROM documents),
s AS (SELECT doc_id, ts, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
a AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM s),
q AS (SELECT DISTINCT item_id, unnest({_LEXICAL_TERMS.format(text="text")}) AS term FROM benchmark),
t AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM s) x WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM a) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t GROUP BY term),
m AS (SELECT doc_id, 100 - 90 + (90 * n * (SELECT docs FROM a)) // (SELECT total FROM a) AS m FROM s),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query
def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """How the tokens of two vocabularies align in every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    return alignment.align(docs, tokenizer_definition("byte_bpe_50k.json"), model).select("doc_id", *alignment.MEASURES)

"""One registered query per operator, over its whole table, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import bpe, chat, decontamination, exact_dedup, html, language, negatives, pieces, secrets, sharding, simhash, toxicity, variants
from tidewatch.llm.common import checkpointed, table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all documents, scored by a forest that learns from the findings the rule can label."""
    docs = table(spark, sf_dir, "documents")
    found = checkpointed(secrets.labelled_by_rule(secrets.candidates(docs)))
    return secrets.scan(docs, secrets.fit(found))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predictions(docs, language.fit(docs))


#: A conversation whose texts hold what a template could mistake for its own marks.
TRICKY = r"\### Assistant: </turn> ok"


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], rows.schema)
    return chat.digests(chat.format_chats(rows.union(tricky)))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether they give it back."""
    return pieces.round_trips(table(spark, sf_dir, "documents"), pieces.read_model())


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trips(table(spark, sf_dir, "documents"), bpe.read_definition()))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = variants.spelling_variants(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secrets,
        op2_decontamination,
        op3_language,
        op4_chat,
        op5_pieces,
        op6_sharding,
        op7_exact_dedup,
        op8_html,
        op9_simhash,
        op10_toxicity,
        op11_bpe,
        op12_negatives,
        op13_variants,
    )
}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op2_decontamination": rf"""
WITH bench AS (
  SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w
  FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + 9], ' ') AS gram
  FROM bench, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0
), docs AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w
  FROM documents
), lengths AS (SELECT DISTINCT k FROM grams),
positions AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM docs, lengths, unnest(range(1, len(w) - k + 2)) AS u(i)
), hits AS (
  SELECT p.doc_id, p.i, p.k, g.item_id FROM positions p JOIN grams g ON g.gram = p.gram AND g.k = p.k
), covered AS (
  SELECT doc_id, count(DISTINCT x) AS n FROM hits, unnest(range(i, i + k)) AS u(x) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
       sha256(coalesce(t.list, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN items t USING (doc_id)""",
    "op4_chat": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)
), marked AS (
  SELECT *, length(replace(text, '\', '\\'))
    - (length(text) - length(replace(text, '<turn>', '123')))
    - (length(text) - length(replace(text, '<text>', '123')))
    - (length(text) - length(replace(text, '</turn>', '123')))
    - (length(text) - length(replace(text, '<|endoftext|>', '123'))) AS body
  FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn>') + length(role) + length('<text>') + body + length('</turn>'))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id""",
    "op7_exact_dedup": f"""
WITH t AS (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM t WINDOW same AS (PARTITION BY norm)""",
    "op12_negatives": """
WITH usable AS (
  SELECT vec_id, label::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(x, lambda c: c::BIGINT) AS x, row_number() OVER () AS r
  FROM usable
), scored AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, a.label AS anchor_label, b.r AS br, b.vec_id AS id, b.label AS label,
         list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r
), positives AS (
  SELECT ar, anchor_id, br AS pr, id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id, br) <= 5
)
SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
       row_number() OVER (PARTITION BY p.ar, p.pr ORDER BY s.score DESC, s.id, s.br)::INTEGER AS rank
FROM positives p JOIN scored s ON s.ar = p.ar AND s.label <> s.anchor_label
  AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.ar, p.pr ORDER BY s.score DESC, s.id, s.br) <= 5""",
}

"""Secret scanning with a random forest that removes false positives. Built-in functions only.

Candidates are long runs of key characters. Each is described by its length, by how its
characters change class, by the share of its four-letter pieces that a dictionary of the
words around findings has, by its path (the document's source) and by the words beside it. A forest trained on labelled
findings gives the probability that it is a secret.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.llm.common import checkpointed

CANDIDATE = r"[A-Za-z0-9+/_=.@-]{16,}"
CONTEXT = 80
SAMPLE = 20_000
DICTIONARY, PIECE = 3_000, 4
TREES, DEPTH, SEED = 30, 8, 11
HASHED = 16

# Names under which secrets are kept, and words that mark examples.
KEY_NAMES = r"(?i)(token|secret|passw(or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential)"
EXAMPLES = r"(?i)(example|sample|dummy|placeholder|changeme|test|xxxx|your[_-]?)"
FEATURES = [
    "length", "digits", "uppers", "lowers", "signs", "hex_share", "changes", "letter_digit", "digit_letter", "case_changes",
    "distinct_share", "longest_letters", "word_cover", "repeats", "key_before", "assigned", "quoted", "example",
    "words_before", "digits_beside", "path_bucket", "before_bucket", "after_bucket",
]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(row, doc_id, path, ordinal, begin, finding, before, after): every candidate of every whole text.

    `begin` counts code points from 0; `before` and `after` are up to CONTEXT characters beside it."""
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs[f"`{id_col}`"].alias("doc_id"),
        F.coalesce(docs[f"`{path_col}`"].cast("string"), F.lit("")).alias("path"),
        F.split(text, CANDIDATE).alias("gaps"),
        F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"),
    ).where(F.size("found") > 0)
    # A gap before each finding; the gap after it is the next one's, so only its head is kept here.
    cells = F.transform(
        F.col("found"),
        lambda finding, i: F.struct(
            finding.alias("finding"),
            F.char_length(F.get("gaps", i)).alias("gap"),
            F.right(F.get("gaps", i), F.lit(CONTEXT)).alias("before"),
            F.substring(F.get("gaps", i + 1), 1, CONTEXT).alias("after"),
        ),
    )
    rows = rows.select("row", "doc_id", "path", F.posexplode(cells).alias("ordinal", "cell"))
    rows = rows.select("row", "doc_id", "path", "ordinal", "cell.*")
    order = Window.partitionBy("row").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begin = F.sum(F.col("gap") + F.char_length("finding")).over(order) - F.char_length("finding")
    return rows.select("row", "doc_id", "path", "ordinal", begin.alias("begin"), "finding", "before", "after")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.lower(F.coalesce(word, F.lit("")))), F.lit(HASHED)).cast("double")


def _pieces(text: Column) -> Column:
    """All pieces of PIECE characters of a lower-cased text."""
    size = F.char_length(text)
    cut = F.transform(F.sequence(F.lit(1), size - (PIECE - 1)), lambda i: F.substring(F.lower(text), i, F.lit(PIECE)))
    return F.when(size >= PIECE, cut).otherwise(F.array().cast("array<string>"))


def dictionary(found: DataFrame, most: int = DICTIONARY) -> list[str]:
    """The `most` commonest pieces of the two words before and the two behind every finding."""
    beside = F.concat(F.regexp_extract("before", r"(\S+\s+\S+)\s*$", 1), F.lit(" "), F.regexp_extract("after", r"^\s*(\S+\s+\S+)", 1))
    pieces = found.select(F.explode(_pieces(beside)).alias("piece")).where(F.col("piece").rlike(r"^\p{L}+$"))
    counts = pieces.groupBy("piece").count().orderBy(F.desc("count"), "piece").limit(most)
    return [r[0] for r in counts.collect()]


def features(found: DataFrame, known: list[str]) -> DataFrame:
    """The candidates with the columns of FEATURES; `known` is the dictionary."""
    finding, before, after = F.col("finding"), F.col("before"), F.col("after")
    size = F.char_length(finding).cast("double")
    near = F.regexp_extract(before, r"(\S+)\s*$", 1)
    bare = F.array_remove(F.split(F.lower(finding), "[^a-z]+"), "")
    longest = F.coalesce(F.array_max(F.transform(bare, F.char_length)), F.lit(0)).cast("double")
    parts = _pieces(finding)
    covered = F.size(F.filter(parts, lambda w: w.isin(known))) if known else F.lit(0)
    return found.select(
        "*",
        size.alias("length"),
        (_count(finding, "[0-9]") / size).alias("digits"),
        (_count(finding, "[A-Z]") / size).alias("uppers"),
        (_count(finding, "[a-z]") / size).alias("lowers"),
        (_count(finding, "[^A-Za-z0-9]") / size).alias("signs"),
        (_count(finding, "[0-9a-fA-F]") / size).alias("hex_share"),
        (_count(finding, "(?<=[a-zA-Z])(?=[^a-zA-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^a-zA-Z0-9])(?=[a-zA-Z0-9])") / size).alias("changes"),
        (_count(finding, "[A-Za-z](?=[0-9])") / size).alias("letter_digit"),
        (_count(finding, "[0-9](?=[A-Za-z])") / size).alias("digit_letter"),
        (_count(finding, "[a-z](?=[A-Z])") / size).alias("case_changes"),
        (F.size(F.array_distinct(F.split(finding, ""))) / size).alias("distinct_share"),
        longest.alias("longest_letters"),
        (covered / F.greatest(F.size(parts), F.lit(1))).alias("word_cover"),
        (_count(finding, r"(.)\1\1") / size).alias("repeats"),
        before.rlike(KEY_NAMES + r"\W{0,6}$").cast("double").alias("key_before"),
        before.rlike(r"[=:]\s*[\"']?$").cast("double").alias("assigned"),
        (before.rlike(r"[\"']$") & after.rlike(r"^[\"']")).cast("double").alias("quoted"),
        F.concat(before, finding, after).rlike(EXAMPLES).cast("double").alias("example"),
        F.size(F.split(before, r"\s+")).cast("double").alias("words_before"),
        F.concat(before, after).rlike("[0-9]").cast("double").alias("digits_beside"),
        _bucket(F.col("path")).alias("path_bucket"),
        _bucket(near).alias("before_bucket"),
        _bucket(F.regexp_extract(after, r"^\W*(\w+)", 1)).alias("after_bucket"),
    )


def labelled_by_rule(found: DataFrame) -> DataFrame:
    """Findings with a 0/1 `label` for training where nobody has labelled any: values without words
    that a key name assigns in quotes are secrets; findings made of words, plain numbers, mail
    addresses and hosts are not. All other findings stay without a label."""
    finding, before = F.col("finding"), F.col("before")
    mixed = finding.rlike("[0-9]") & finding.rlike("[A-Za-z]")
    secret = before.rlike(KEY_NAMES + r"\s*[=:]\s*[\"']?$") & mixed & ~F.concat(before, finding).rlike(EXAMPLES)
    named = finding.rlike(KEY_NAMES + r"[=:].*[0-9]")
    harmless = finding.rlike(r"^[A-Za-z.-]+$") | finding.rlike(r"^[0-9.-]+$") | finding.contains("@")
    label = F.when(secret | named, 1).when(harmless, 0)
    return found.withColumn("label", label).where("label IS NOT NULL")


@dataclass
class Model:
    known: list[str]
    forest: PipelineModel


def fit(findings: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A forest from labelled findings: at most about `sample` of each label, chosen by a hash.

    None if there are no findings of either label; every candidate is then reported unscored."""
    sizes = {r[0]: r[1] for r in findings.groupBy("label").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    share = F.lit(0.0)
    for label in (0, 1):
        share = F.when(F.col("label") == label, F.lit(min(1.0, sample / sizes[label]))).otherwise(share)
    known = dictionary(findings)
    place = F.pmod(F.xxhash64("doc_id", "ordinal", "finding"), F.lit(1_000_003))
    rows = features(findings.where(place < share * 1_000_003), known).withColumn("label", F.col("label").cast("double"))
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, probabilityCol="p"
    )
    stages = [VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]
    return Model(known, Pipeline(stages=stages).fit(checkpointed(rows.select("label", *FEATURES))))


def scan(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, ordinal, begin, finding, score, secret.

    Null and empty texts have none; null ids and paths are kept; rows that repeat an id give their
    findings once each; an empty table gives no rows. Without a model score is null and every
    candidate is kept as a secret, for nothing shows it to be false."""
    found = candidates(docs)
    kept = ["doc_id", "ordinal", "begin", "finding"]
    if model is None:
        return found.select(*kept, F.lit(None).cast("double").alias("score"), F.lit(True).alias("secret"))
    scored = model.forest.transform(features(found, model.known))
    scored = scored.withColumn("score", F.get(vector_to_array("p"), F.lit(1)))
    return scored.select(*kept, "score", (F.col("score") >= threshold).alias("secret"))

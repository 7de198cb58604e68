"""A training-corpus pipeline over ``documents``, as stages that can be written and read again.

language: documents without letters or whose language is not recognised with confidence go; near_duplicates: one
document of each group of similar texts stays; decontamination: documents that hold a window of a benchmark item
go; pseudonyms: personal data is replaced; tokens: what is left is encoded.

Every stage takes a null, empty or very long text whole, keeps all columns, gives an empty table for an empty one,
and treats rows one by one: repeated rows and rows that share an id are separate documents, but where its own
docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phyloquarry.llm.bpe import TOKENIZER, bpe_encode, digests, public_path
from phyloquarry.llm.common import table, written
from phyloquarry.llm.decontamination import contaminated_words, row_key
from phyloquarry.llm.jaccard_join import WORDED, near_duplicates, text_class
from phyloquarry.llm.language_id import UNKNOWN, fit, identify
from phyloquarry.llm.pii import pseudonymise, query_key

#: A prediction below this probability is no recognised language.
CONFIDENT = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what is recognised; the model is learned from the labelled documents themselves.

    Null texts and texts without letters are not recognised and go, and so do all where no document is labelled.
    """
    own = docs.select("text", *[F.col(c).alias(f"own_{c}") for c in docs.columns if c != "text"])
    found = identify(own, fit(docs)).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= CONFIDENT))
    return found.select(*["text" if c == "text" else F.col(f"own_{c}").alias(c) for c in docs.columns])


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of similar texts: the text of the group's smallest id.

    Decided by id and text together: of rows alike in both one stays, the least by the order of its columns; of two
    unlike texts with one id both. Rows without words and rows with a null id are similar to nothing and stay. Ids all of
    whose rows go are dropped by id; only rows whose id others share, and of which some stay, are looked at with their text.
    """
    found = written(near_duplicates(docs).where("doc_id is not null").select(F.col("doc_id").alias("id"), "text_class", "stays"))
    ids = found.groupBy("id").agg(F.bool_or("stays").alias("some"), F.count(F.lit(1)).alias("n"))
    ids = written(ids.where("not some or n > 1"))
    own = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("own_id"), "text")
    gone = ids.select("id").hint("merge")  # grows with the documents, so never a broadcast
    single = own.join(gone, F.col("own_id") == F.col("id"), "left_anti").select("doc.*")
    shared = ids.where("some").select("id")
    if not shared.take(1):
        return single
    digest = F.when(F.col("text").rlike(WORDED), F.hex(text_class("text")))
    rows = own.join(shared, F.col("own_id") == F.col("id")).select("doc", "id", digest.alias("text_class"))
    stay = found.join(shared, "id", "left_semi").where("stays and text_class is not null").select("id", "text_class").distinct()
    once = rows.join(stay, ["id", "text_class"]).groupBy("id", "text_class").agg(F.min("doc").alias("doc")).select("doc.*")
    return single.unionByName(once).unionByName(rows.where("text_class is null").select("doc.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents. Each row is judged by its own text, whatever its id, a null one among them."""
    _, found = contaminated_words(docs, table(spark, sf_dir, "benchmark"))
    hit = found.select("doc.a", "doc.b").distinct()
    own = docs.select(F.struct(*docs.columns).alias("row"), row_key("doc_id", "text").alias("doc"))
    return own.select("row", "doc.a", "doc.b").join(hit.hint("merge"), ["a", "b"], "left_anti").select("row.*")


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, under the published key unless one is set; n_chars follows the text (0 for a null one). All rows stay."""
    found = pseudonymise(docs, query_key(spark))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of each document's ids and of its decoded text, a row each; a null text counts as empty."""
    return digests(bpe_encode(docs, public_path(TOKENIZER)))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontaminate),
    ("pseudonyms", pseudonyms),
    ("tokens", encode),
]

#: SQL has no counterpart for the fitted classifier, the pseudonyms and the merges; tests compare each stage with a
#: plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

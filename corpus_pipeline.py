"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is stored and read back as
the next one's ``docs``: a lost executor never repeats an earlier stage. All stages but the last
return the columns of ``docs``, whatever they are besides ``doc_id`` and ``text``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossledger.llm.common import removed_after, staged, table
from lossledger.llm.decontaminate import contamination_filter
from lossledger.llm.jaccard import one_of_each_class
from lossledger.llm.packing import pack, token_pieces
from lossledger.llm.secrets import redact_secrets
from lossledger.llm.toxicity import without_toxic


#: The law of the jaccard_join stage: shingles of so many words, linked from so many per cent on. op8 has its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go.

    Null and empty texts have no strings and stay; rows are judged one by one, whatever their id, so
    repeated rows stay or go together. Without toxic or clean labels to learn from nothing goes. An
    empty table gives no rows.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"), labelled_docs=table(spark, sf_dir, "documents"))


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by the Jaccard join (five words, 0.8), the one with the smallest id stays.

    Null and wordless texts, null and repeated ids: see ``one_of_each_class``.
    """
    return one_of_each_class(docs, n=NEAR_WORDS, percent=NEAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go.

    Null and empty texts have no words and stay; repeated rows stay or go together; with an empty
    benchmark, or items without words only, all stay. An empty table gives no rows.
    """
    return contamination_filter(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced; ``n_chars`` follows the text, if there is such a column.

    Every row stays. A null text stays null and keeps its ``n_chars``; an empty text stays empty.
    """
    clean = redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return clean
    kind = dict(docs.dtypes)["n_chars"]
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(
        F.length("text").cast(kind)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the sequence and the place each goes to.

    A null text is packed as an empty one, which is its end mark alone; each row is a document of its
    own, whatever its id; an empty table gives no rows.
    """
    return pack(token_pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", keep_one_of_each_class),
    ("decontamination", drop_contaminated),
    ("secret_scan", hide_secrets),
    ("packing", pack_sequences),
]

#: SQL cannot express the toxicity machine and the tokenizer; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row; what they store is removed, but for the last result and two tables of the Jaccard join."""
    docs = table(spark, sf_dir, "documents")
    with removed_after(spark):
        for place, (_, stage) in enumerate(STAGES, 1):
            docs = staged(stage(spark, docs, sf_dir), keep=place == len(STAGES))
    return docs

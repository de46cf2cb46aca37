"""The corpus pipeline: quality, near-duplicates, repeated passages, personal data, packing.

Each stage takes all documents that its predecessor kept, as (doc_id, text, lang, source, n_chars), and all but the last return the
same columns. ``run`` writes what a stage returns to the cluster's shared folder and reads it again for the next.

* Nulls in any column, empty and very long texts are ordinary values (each operator states what it makes of them);
  an empty table passes through every stage as one.
* Columns of ``documents`` beyond those five are not carried on.
* SQL cannot express the stages (trained models, shingle sets, byte positions, token ids), so there is no check
  SQL; the tests hold every stage against a brute-force version or labelled rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.llm import near_copies, packing, pii, quality, repeats
from shoebox.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    return quality.score_documents(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).filter("keep").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id. Candidates come from SimHash and from MinHash bands; what counts
    is a Jaccard similarity of 0.8 or more of the five-word shingles, tested exactly."""
    return near_copies.one_per_group(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages of over 50 words or of 400 bytes; ``n_chars`` is counted anew where something went."""
    return repeats.without_repeats(docs.select(*COLUMNS), words=repeats.WORDS)


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.mask_personal_data(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token windows of all documents, as pieces."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("repeated_passages", cut_repeats),
    ("personal_data", mask_personal),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

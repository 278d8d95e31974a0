"""A corpus pipeline of five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its result
is written as Parquet in the shared folder and read again as the next stage's
documents.  All but the last return the columns of ``documents``.

1. quality: documents scored under 0.5 by the co-trained classifier go;
2. line dedup: later occurrences of three-line windows go from the texts;
3. near dedup: one document of each group linked by a Jaccard similarity of 0.8
   or more over five-word shingles stays;
4. mixing: sources are dealt to tempered weights, each document at least once
   (a document comes once per block, so ids may repeat from here on);
5. BPE: the mixed texts are encoded and decoded.

Edge cases: an empty table gives no rows at every stage; extra columns are not
carried on; what each stage does with nulls, empty and repeated rows stands at
its function and in the operator it calls.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.bpe_chunks import encode_documents
from gristmill.llm.common import table
from gristmill.llm.line_dedup import line_dedup
from gristmill.llm.mixing import mix_sources
from gristmill.llm.quality import quality_scores
from gristmill.llm.queries import tokenizer_path
from gristmill.llm.simhash import keep_first
from gristmill.session import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more, whole and unchanged.

    A null or empty text is scored as an empty text, null metadata as a value of
    its own; repeated rows are scored alike; without labels nothing goes.
    """
    return quality_scores(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("keep").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later occurrences of three-line windows; ``n_chars`` follows the text.

    Null and short texts and rows with a null id stay as they are; a document
    that only repeats others stays with an empty text.
    """
    clean = line_dedup(docs.select(*COLUMNS))
    size = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", size).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every component.

    Null and empty texts are one component and leave one document; rows without
    an id stay; rows that repeat an id stay or go together.
    """
    return keep_first(docs.select(*COLUMNS), size=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents dealt to tempered weights, each at least once and none more than twice and a part of a block.

    A null source is a source of its own, null and empty texts count one token,
    and repeated rows are separate documents.
    """
    return mix_sources(docs.select(*COLUMNS), repetition_limit=2.0, cover=True).select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of ids and decoded texts, one row for each row dealt; null is empty."""
    return encode_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: A trained classifier decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs

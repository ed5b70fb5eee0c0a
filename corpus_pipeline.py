"""A training corpus from ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet, and what is read back is the next stage's docs. All but the last return the
columns of ``documents``.

1. language ID drops documents without a letter and those whose margin is too narrow;
2. SimHash near-dedup keeps the smallest doc_id of each component;
3. decontamination drops documents that hold a benchmark passage;
4. the secret scan replaces each secret in what stays;
5. packing returns the pieces of all documents that are left.

No document leaves for another reason; a null text has no letter.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skein.llm import decontaminate, language_id, packing, secret_scan, simhash
from skein.llm.common import forget, fresh_path, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` whose language is told with a margin.

    Null and empty texts, and those without a letter, go. Repeated rows are judged each, rows
    without doc_id too (they don't train). Further columns are kept, whatever their names but
    for those that begin with "__". Without any lang to learn from all rows go; an empty table
    gives an empty one.
    """
    known = language_id.train(docs, language_id.crc32_of_id() % 5 != 0)
    found = language_id.identify(docs.select(*docs.columns), known, keep_columns=True, prefix="__")
    return found.where("not __rejected").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest doc_id of each group of near duplicates.

    Null and empty texts are a group. Of repeated rows one stays; rows without doc_id stay all.
    Further columns are kept; an empty table gives an empty one.
    """
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found.

    Null and empty texts stay; repeated rows, and rows without doc_id, are judged each. Further
    columns are kept. With an empty benchmark all rows stay; an empty table gives an empty one.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of ``docs``, with each secret in their texts replaced, and n_chars set where one was.

    Null and empty texts stay as they are; repeated rows, and rows without doc_id, are redacted
    each. Further columns are kept; an empty table gives an empty one.
    """
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left.

    A null or empty text is one piece with the end id; repeated rows are packed each, a null
    doc_id stays null. Further columns are not looked at; an empty table gives no piece.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secrets),
    ("packing", pack),
]

#: The stages' methods (compression sizes, latent vectors, subword ids) aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the whole table of documents. What a stage has read is deleted once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        docs = written(stage(spark, docs, sf_dir), path=path)
        if before:
            forget(spark, before)
        before = path
    return docs

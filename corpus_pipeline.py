"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``:

1. toxicity - documents that are predicted toxic go;
2. exact dedup - of equal texts one row stays;
3. SimHash near-dedup - of each group of near copies one row stays;
4. mixing - sources are brought to their target weights: rows may be there twice, and the
   row at the edge of a source's target holds the words that are taken of it;
5. packing - the rows' token ids in sequences of at most 4096 (the columns of op1_packing).

Defined results: a null text counts as empty: it scores as one without terms, equals other
empty texts, and goes in the mix, which takes nothing of it; rows with the same doc_id are
documents of their own; of equal or near texts the one named in its operator's docstring
stays, of wholly repeated rows one; null doc_ids, langs and sources are values; very long
texts are read whole; other columns go through all stages but the last; an empty table,
or one of which nothing is left, gives an empty result.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tideline.llm.common import drop_written, remove, table, written
from tideline.llm.exact_dedup import exact_dedup
from tideline.llm.mixing import mixed
from tideline.llm.packing import pack
from tideline.llm.queries import tokenizer_file
from tideline.llm.simhash import near_dedup
from tideline.llm.toxicity import keep_clean
from tideline.shared import paths_of, written_paths


_held: list[str] = []  # temporary tables of the stage before


def stage(function):
    """A stage whose temporary tables go when the next one begins: then its rows have been written.

    They stay if the next stage's plan still reads them, because nobody has written its rows.
    """

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = {p.rpartition("/")[2] for p in paths_of(docs)}
        if not any(p.rpartition("/")[2] in read for p in _held):
            for path in _held:
                remove(spark, path)
            _held.clear()
            drop_written(spark)
        before = len(written_paths())
        out = function(spark, docs, sf_dir)
        _held.extend(written_paths()[before:])
        return out

    return run


@stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, table(spark, sf_dir, "labels"))


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # less memory than alone: workers that live on hold other stages' as well
    return pack(docs, tokenizer_file("word_bpe_49k.json"), end_id=2, window=4096, max_bytes=32 << 20, batch_bytes=2 << 20)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: the first stage learns and the third hashes what SQL has no functions for
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        before, docs = docs, function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}", "zstd")
            drop_written(spark, before)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

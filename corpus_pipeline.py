"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch, packed, table
from graphloom.llm.op01_near_dedup import one_of_each
from graphloom.llm.op02_toxicity import ToxicConfig, toxicity
from graphloom.llm.op03_decontaminate import contaminated
from graphloom.llm.op06_token_orc import token_digest, write_tokens
from graphloom.llm.op07_mixing import mixed


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold.

    Null and empty texts are scored as texts without words and stay unless that score reaches the threshold; rows that
    repeat are judged each, equal texts alike; a very long text is one step of the decoder; an empty table stays empty;
    all columns come through, whatever their names.
    """
    c = ToxicConfig()
    rows, unpacked = packed(docs)
    return unpacked(toxicity(rows, table(spark, sf_dir, "labels"), c, extra=("rest",)).where(F.col("score") < c.threshold))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): the smallest doc_id.

    Texts without words are like nothing and all stay; of rows with one doc_id and one group one stays; a null doc_id
    comes first; a very long text is one row's set of shingle hashes; an empty table stays empty; all columns come through.
    """
    return one_of_each(docs)


def keep_unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Null and empty texts hold none and stay; rows that repeat are judged each; a very long text is one step; an empty
    table stays empty, an empty benchmark keeps everything; all columns come through.
    """
    rows, unpacked = packed(docs)
    return unpacked(contaminated(rows, table(spark, sf_dir, "benchmark")).where(F.size("item_ids") == 0))


def mix_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the rates that bring expected tokens by quality to the target weights.

    A document comes as often as its rate asks for, 0, 1 or more times, by a hash of its doc_id, so rows that repeat an id
    (a null one, too) are decided alike. Null and empty texts have no tokens but a rate like others; a very long text is
    one row's array of words; an empty table stays empty; all columns come through.
    """
    return mixed(docs, table(spark, sf_dir, "labels"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """ORC files of token ids; the rows (doc_id, start, n_tokens, ids_crc32) are read back from them.

    A null or empty text is its end id alone; a null doc_id comes first; rows that repeat a doc_id are kept each, in order
    of their texts; a very long text is encoded whole; an empty table gives no rows; other columns are not needed.
    """
    path = Scratch(spark, "corpus").path("ids")
    write_tokens(docs, path)
    return token_digest(spark, path)


STAGES = [("toxicity", keep_civil), ("minhash near-dedup", keep_one_of_each), ("benchmark decontamination", keep_unseen), ("mixing", mix_quality), ("token ids", to_tokens)]
#: The decoder's and the tokenizer's results are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs, f"stage{k + 1}")
        if k:  # the last stage has written its files by now, the others their tables
            scratch.drop(before)
    return docs

"""The corpus pipeline: toxicity, line dedup, near duplicates, mixing, tokens.

Each stage is a function of (spark, docs, sf_dir) and works on all that the stage before it has kept; run() writes every
result as Parquet in the shared folder and reads it again. All stages but the last return the columns of documents.

Defined results, beside those of the operators: a null text is kept by every stage and encoded as the empty text; null
ids are never near duplicates of anything; columns beyond those of documents are dropped by the first stage.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineloom.llm import byte_bpe, common, line_dedup, mixing, ngram_join, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
RUN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
NEAR_WORDS, NEAR_PERCENT = 5, 80


class _Left(threading.local):
    """The scratch folders of the stage that this thread has called last."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_left = _Left()


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """f, which first deletes the scratch folders of the stage that this thread called before if docs is a table of its own:
    then that stage's result has been written. Folders that docs still reads stay, so stages may be chained unwritten."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _left.paths:
            read = docs.inputFiles()
            if read and not any(f"/{p.rsplit('/', 1)[-1]}/" in x for p in _left.paths for x in read):
                common.remove(spark, _left.paths)
            else:
                _left.paths = []
        with common.scope() as own:
            out = f(spark, docs, sf_dir)
        _left.paths = own
        return out

    return run


@_stage
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores under the threshold; repeated rows are judged alike and all kept or all dropped. Null
    and empty texts score as any text without a hit and stay. Without labels nothing is learned and every row stays."""
    lexicon = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    scored = docs.select(*COLUMNS, toxicity.scorer(spark, lexicon)("text").alias("_score"))
    return scored.filter(F.col("_score") < toxicity.THRESHOLD).select(*COLUMNS)


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; a document of which nothing else was there goes. Null and empty texts, and
    those of blank lines only, stay as they are; of repeated rows, which are one document, all stay."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    left = (F.col("_n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.filter(left).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_stage
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 or more over five-word shingles connect, the one with the smallest id. Of rows that share
    an id the one with the smallest text stays; null and empty texts link with nothing and stay; null ids stay."""
    found = ngram_join.components(docs, NEAR_WORDS, NEAR_PERCENT)
    keep = found.filter("doc_id = component_id").select("doc_id").distinct()
    one = docs.join(keep.hint("merge"), "doc_id", "left_semi")
    one = one.withColumn("_r", F.row_number().over(W.partitionBy("doc_id").orderBy("text"))).filter("_r = 1")
    return one.select(*COLUMNS).unionByName(docs.filter("doc_id IS NULL").select(*COLUMNS))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one at a source's cut with its first words only. Texts without words
    stay once; null sources are a source of their own; repeated rows are taken one by one."""
    key = ("doc_id", "source", "text_hash")
    # rows that are alike in all three take one entry each; the entries are numbered, so no list of them is ever made
    taken = mixing.mix(docs).withColumn("_no", F.row_number().over(W.partitionBy(*key).orderBy("epochs", "cut")))
    taken = taken.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("_no").alias("_number"), F.struct("epochs", "cut", "size").alias("_take")).hint("merge")
    rows = docs.withColumn("text_hash", F.xxhash64(common.text_or_empty("text")))
    rows = rows.withColumn("_no", F.row_number().over(W.partitionBy(*key).orderBy(F.lit(1))))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    rows = rows.join(taken, same[0] & same[1] & same[2] & (F.col("_no") == F.col("_number")), "left")
    cut, size = F.col("_take.cut"), F.col("_take.size")
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(RUN), F.lit(0)), 1, F.greatest(cut, F.lit(1)).cast("int")), "")
    last = F.when(cut == 0, F.array().cast("array<string>")).when(cut >= size, F.array("text")).otherwise(F.array(part))
    # a text without words weighs nothing and stays once
    copies = F.when(size == 0, F.array("text")).otherwise(F.concat(F.array_repeat("text", F.col("_take.epochs").cast("int")), last))
    out = rows.select("doc_id", F.explode(copies).alias("text"), "lang", "source")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_stage
def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document as little-endian 32-bit integers, decoded again to check them. A null text is encoded as the
    empty one; repeated rows each have a result."""
    import public_tokenizers

    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("byte-level BPE", to_tokens),
]

#: The lexicon and the BPE merges can't be said in SQL; a test holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over the documents of sf_dir. A stage's table is removed once the next one is written. With a folder the
    tables stay in it, and stages whose tables are complete there are not run again; the folder notes which input files they
    were made from, and other input is refused."""
    docs = common.table(spark, sf_dir, "documents")
    base, before = folder or f"{common.shared_dir(spark)}/lineloom/pipeline-{common.fresh()}", None
    if folder is not None:
        mark = common.input_mark(docs.unionByName(common.table(spark, sf_dir, "labels"), allowMissingColumns=True))
        common.claim(spark, f"{base}/input-{mark}", f"{base}/input-")
    for k, (_, f) in enumerate(STAGES[:-1]):
        path = f"{base}/{k}"
        if folder is None or not common.exists(spark, f"{path}/_SUCCESS"):
            f(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if folder is None and before:
            common.delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

"""Mixing sources to target weights.

Every row gets a hash-random key. Within a source, rows are range-sorted by that key, a distributed prefix sum of the
word counts runs along the order, and the mix takes whole epochs of the source and then cuts the order at the exact
remaining budget; the row that straddles the cut gives only its first words.

The prefix sum has three levels, so that a source with any share of the rows is spread over many tasks: key ranges of a
source (more of them the more rows it has) are summed, and so are runs of RUN ranges; offsets run over the sums of a
source's runs, over the ranges inside each run, and over the rows inside each range. Only ids, keys and counts are shuffled, never texts.

Defined results: null text has size 0; null sources form a source of their own, last in order; a table without words
takes nothing; rows that agree in id, source and text share a key and are taken in no order that could be told apart;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, parallelism, saved, table, text_or_empty

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
#: Key ranges that are summed together.
RUN = 32


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """sizes(source, source_size) -> the same with `target`, the words to take of each source.

    Water filling: a source stops at most_epochs times its size, and what it can't take is shared again by weight.
    Sources in order of size a weight fill first, so one running sum over them finds the level; the input has one row
    a source.
    """
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    w = F.array(*(F.lit(float(x)) for x in weights))
    rows = sizes.withColumn("_i", F.row_number().over(order) - 1)
    rows = rows.withColumn("_w", F.element_at(w, (F.col("_i") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("_cap", F.col("source_size").cast("double") * most_epochs)
    by_fill = W.orderBy((F.col("_cap") / F.col("_w")), "_i")
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    everyone = W.partitionBy()
    total = F.sum("source_size").over(everyone).cast("double") * share
    rows = rows.withColumn("_left", total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("_open", F.sum("_w").over(everyone) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    # the level if this source and all later ones are open; the first source that isn't filled by it sets the level
    rows = rows.withColumn("_level", F.col("_left") / F.col("_open"))
    rows = rows.withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("_cap"))
    level = F.first(F.when(F.col("_fits"), F.col("_level")), ignorenulls=True).over(by_fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = rows.withColumn("_at", level)
    return rows.select("source", "source_size", F.least("_cap", F.coalesce(F.col("_at") * F.col("_w"), F.col("_cap"))).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most_epochs: int = MOST_EPOCHS,
    seed: int = 1,
) -> DataFrame:
    """Per row: id, source, size, the source's size and target, the words taken and how: whole `epochs` and `cut`,
    the words of one more partial or whole pass; `key` (the random key) and `text_hash` identify the row."""
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    rows = saved(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(text).alias("text_hash"),
        ).withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "source", "text_hash")),
        "mix-rows",
    )
    # one row a source
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    sizes = saved(sizes, "mix-sources")
    goal = targets(sizes.select("source", "source_size"), weights, share, most_epochs)
    n_rows = F.sum("_rows").over(W.partitionBy())
    ranges = F.greatest(F.lit(1), F.ceil(F.col("_rows") * (4.0 * parallelism(spark)) / n_rows)).cast("long")
    goal = saved(sizes.withColumn("_ranges", ranges).join(goal.select(F.col("source").alias("_s"), "target"), F.col("source").eqNullSafe(F.col("_s"))).select("source", "source_size", "target", "_ranges"), "mix-targets")
    here = F.col("source").eqNullSafe(F.col("_s"))
    side = goal.select(F.col("source").alias("_s"), "source_size", "target", "_ranges")
    # as many rows as sources; Spark broadcasts it where its size is under the threshold and shuffles it otherwise
    keyed = rows.join(side, here, "left").drop("_s")
    # the key's place in the 64-bit range, in equal steps: uniform, as the key is a hash
    place = (F.col("key").cast("double") / F.lit(2.0**64) + 0.5) * F.col("_ranges")
    keyed = keyed.withColumn("_range", F.least(F.floor(place), F.col("_ranges") - 1))
    sums = saved(keyed.groupBy("source", "_range").agg(F.sum("size").alias("_sum")).withColumn("_part", F.floor(F.col("_range") / RUN)), "mix-sums")
    parts = sums.groupBy(F.col("source").alias("_s"), F.col("_part").alias("_p")).agg(F.sum("_sum").alias("_total"))
    parts = parts.withColumn("_ahead", F.sum("_total").over(W.partitionBy("_s").orderBy("_p")) - F.col("_total")).drop("_total")
    offsets = sums.withColumn("_own", F.sum("_sum").over(W.partitionBy("source", "_part").orderBy("_range")) - F.col("_sum"))
    offsets = offsets.join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p"))).withColumn("_before", F.col("_own") + F.col("_ahead")).drop("_s")
    offsets = saved(offsets.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), "_before"), "mix-offsets")
    inside = W.partitionBy("source", "_range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = keyed.withColumn("_run", F.sum("size").over(inside))
    run = run.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")), "left")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    end = F.col("_before") + F.col("_run")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - (end - F.col("size")))).cast("long")
    run = run.withColumn("epochs", epochs).withColumn("cut", cut)
    return run.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("cut")).alias("taken"), "epochs", "cut", "key", "text_hash")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")

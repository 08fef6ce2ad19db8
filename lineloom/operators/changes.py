"""Change detection, baselines and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineloom.functions.text import col, hash31
from lineloom.operators.matching import match_terms


def content_hash(text: str | Column, style: str | Column | None = None) -> Column:
    """SHA-256 of the text, and of the style it is set in."""
    parts = [col(text)] + ([col(style)] if style is not None else [])
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def content_hash31(text: str | Column) -> Column:
    """I1 where values must agree with the 32-bit form."""
    return hash31(text)


def stale_rows(measured: DataFrame, current: DataFrame) -> DataFrame:
    """Keys of current(key, hash) whose measured(key, hash) differs (stale) or isn't there (missing), and measured
    keys that are gone (extra)."""
    m, c = measured.select("key", F.col("hash").alias("_m"), F.lit(1).alias("_hm")), current.select("key", F.col("hash").alias("_c"), F.lit(1).alias("_hc"))
    rows = m.join(c, "key", "full")
    state = F.when(F.col("_hm").isNull(), "missing").when(F.col("_hc").isNull(), "extra").when(~F.col("_m").eqNullSafe(F.col("_c")), "stale")
    return rows.select("key", state.alias("state")).filter("state IS NOT NULL")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix, by halving: as many steps as the length has bits."""
    least = F.least(F.length(a), F.length(b))
    begin = F.struct(F.lit(0).alias("low"), least.alias("high"))

    def step(s: Column, _: Column) -> Column:
        mid = ((s["low"] + s["high"] + 1) / 2).cast("int")
        same = F.substring(a, s["low"] + 1, mid - s["low"]) == F.substring(b, s["low"] + 1, mid - s["low"])
        return F.struct(F.when(same, mid).otherwise(s["low"]).alias("low"), F.when(same, s["high"]).otherwise(mid - 1).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), begin, lambda s, i: F.when(s["low"] < s["high"], step(s, i)).otherwise(s))["low"]


def is_new_version(versions: DataFrame, share: float = 0.5) -> DataFrame:
    """versions(key, version, text) with `changed`, the share of the longer text outside the common ends of a version
    and the one before, and `is_new` where it is over `share`."""
    rows = versions.withColumn("prev", F.lag("text").over(W.partitionBy("key").orderBy("version")))
    a, b = F.col("prev"), F.col("text")
    head = common_prefix(a, b)
    rest_a, rest_b = F.reverse(F.substring(a, head + 1, F.length(a))), F.reverse(F.substring(b, head + 1, F.length(b)))
    longer = F.greatest(F.length(a), F.length(b))
    changed = (longer - head - common_prefix(rest_a, rest_b)) / F.greatest(longer, F.lit(1))
    rows = rows.withColumn("changed", F.when(a.isNotNull(), changed))
    return rows.withColumn("is_new", F.coalesce(F.col("changed") > share, F.lit(True))).drop("prev")


def multiset_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """I4: rows of new that old doesn't have, respecting counts."""
    return new.exceptAll(old)


def positional_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """I4: (doc_id, block_no, before, after) where the text at a place differs."""
    n = new.select("doc_id", "block_no", F.col("text").alias("after"))
    o = old.select("doc_id", "block_no", F.col("text").alias("before"))
    return n.join(o, ["doc_id", "block_no"], "full").filter(~F.col("before").eqNullSafe(F.col("after")))


def tag_documents(tags: DataFrame, hits: DataFrame) -> DataFrame:
    """(tag, doc_id) of the listed tags: the baseline's lists as rows, so that a tag may hit any number of documents."""
    return tags.select("tag").distinct().join(hits.select("tag", "doc_id").distinct(), "tag")


def tag_baseline(tags: DataFrame, hits: DataFrame) -> DataFrame:
    """Per tag the number of documents; tags without any stay."""
    n = tag_documents(tags, hits).groupBy("tag").agg(F.count(F.lit(1)).alias("n_docs"))
    return tags.select("tag").distinct().join(n, "tag", "left").select("tag", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def baseline_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(tag, doc_id, change): what two tables of tag_documents don't share, added or removed."""
    b, a = before.select("tag", "doc_id", F.lit(1).alias("_b")), after.select("tag", "doc_id", F.lit(1).alias("_a"))
    rows = b.join(a, ["tag", "doc_id"], "full").filter("_a IS NULL OR _b IS NULL")
    return rows.select("tag", "doc_id", F.when(F.col("_b").isNull(), "added").otherwise("removed").alias("change"))


def compare_runs(left: DataFrame, right: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Per document both runs' columns side by side and `same`."""
    a = left.select("doc_id", F.struct(*columns).alias("left"), F.lit(1).alias("_l"))
    b = right.select("doc_id", F.struct(*columns).alias("right"), F.lit(1).alias("_r"))
    rows = a.join(b, "doc_id", "full")
    return rows.select("doc_id", "left", "right", (F.col("left").eqNullSafe(F.col("right")) & F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("same"))


def pick_accuracy(expected: DataFrame, picked: DataFrame) -> DataFrame:
    """I8: counts of each expected and picked pair; a document without a pick counts as null."""
    rows = expected.select("doc_id", "expected").join(picked.select("doc_id", "picked"), "doc_id", "left")
    return rows.groupBy("expected", "picked").agg(F.count(F.lit(1)).alias("n")).withColumn("right", F.col("expected").eqNullSafe(F.col("picked")))


def collision_test(terms: DataFrame, strings: list[DataFrame]) -> DataFrame:
    """Banned terms in any approved string of the (path, text) tables."""
    every = strings[0].select("path", "text")
    for s in strings[1:]:
        every = every.unionByName(s.select("path", "text"))
    return match_terms(every.select(F.col("path").alias("doc_id"), "text"), terms, joined=True).select(F.col("doc_id").alias("path"), "term")

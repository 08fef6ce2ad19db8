"""Merkle manifest of a table by nested-interval labels.

A leaf's label is the interval [rank, rank + 1) of its place in its group's order; a node's label is the interval that its
children's labels cover. Ranks come from a distributed range sort, never from one task a group. A level is a written table
of nodes: group, interval [lo, hi), digest, children. It is made from the level below by grouping FAN consecutive intervals,
and ends for a group as soon as one node covers all its leaves: its subroot. The subroots in order of their groups are the
leaves of one more such tree, whose top is the root.

Ancestors are attached from the top down: a node meets its parent in the bucket of the parent's level (group, lo divided by
what a node of that level spans) and by containment of the intervals, and takes over the parent's path. Its siblings are what
the parent's interval covers beyond the node's own: the children that end before it and those that begin after it, kept
apart, so that a path both proves and folds. The lowest level holds its FAN leaves in one row, so a path is carried once
per FAN leaves. Digests are 32 bytes between the tables and hexadecimal text where they are hashed.

A node has FAN children at most, and a bucket of a join one parent and FAN nodes, so a group that holds any share of the
rows is spread like the others.

Defined results: a null field is hashed as `-`, so it differs from an empty one; rows are ordered by id in their group, null
ids first, and rows that share an id by their leaf; rows that agree in all fields have equal leaves and each its own place;
a group of one row has its leaf as subroot, and a table of one group its subroot as root; the proof without any sibling is
the hash of nothing; columns that aren't hashed are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bucket, parallelism, saved, table

#: Children of a node.
FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows whose id this divides are tampered with.
TAMPER_MOD = 3


def digest(*parts: Column) -> Column:
    """32 bytes: sha256 of the parts one after the other."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hex_text(c: Column) -> Column:
    return F.lower(F.hex(c))


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**instead: Column) -> Column:
    return digest(*(field(instead.get(f, F.col(f))) for f in FIELDS))


def ranked(rows: DataFrame, group: str, order: list[str], tag: str) -> DataFrame:
    """rows with `lo`, their place from 0 in the order of their group, and `n`, the group's size: ranges of the order are
    numbered apart and moved on by the group's rows in the ranges before."""
    parts = rows.repartitionByRange(parallelism(rows.sparkSession), group, *order).withColumn("_part", F.spark_partition_id())
    parts = saved(parts, f"{tag}-order")
    counts = parts.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    # a row a range and group that it holds
    of = W.partitionBy(group)
    before = F.sum("_n").over(of.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(of).alias("n"))
    inside = F.row_number().over(W.partitionBy("_part", group).orderBy(*order)) - 1
    parts = parts.withColumn("_at", inside).join(counts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return parts.withColumn("lo", F.col("_at") + F.col("_before")).drop("_at", "_before", "_part", "_g", "_p")


def build(leaves: DataFrame, group: str, fan: int, tag: str) -> tuple[list[DataFrame], DataFrame]:
    """leaves(group, lo, n, digest, ...) -> the levels above them, lowest first, as (group, lo, hi, n, digest, children), and
    the subroots (group, digest). The lowest level's children carry the leaves' other columns."""
    extra = [c for c in leaves.columns if c not in (group, "lo", "n", "digest")]
    below, span, levels = leaves.withColumn("hi", F.col("lo") + 1), 1, []
    tops = below.filter("n = 1").select(group, "digest")
    most = leaves.agg(F.max("n")).first()[0] or 0
    while span < most:
        span *= fan
        child = F.struct("lo", "hi", "digest", *(extra if not levels else []))
        # a group whose single node is made already stays out
        nodes = below.filter(F.col("n") > span // fan).withColumn("_b", F.floor(F.col("lo") / span))
        nodes = nodes.groupBy(group, "_b", "n").agg(F.sort_array(F.collect_list(child)).alias("children"))
        joined = F.concat_ws("", F.transform("children", lambda c: hex_text(c["digest"])))
        level = saved(nodes.select(group, F.element_at("children", 1)["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"), "n", digest(joined).alias("digest"), "children"), f"{tag}-level")
        levels.append(level)
        below = level.drop("children")
        tops = tops.unionByName(level.filter(F.col("n") <= span).select(group, "digest"))
    return levels, tops


def step(children: Column, lo: Column, hi: Column) -> Column:
    """The siblings of [lo, hi) in its parent: digests of what lies before and of what lies after, one after the other."""
    beside = lambda keep: F.aggregate(F.filter(children, keep), F.unhex(F.lit("")), lambda a, c: F.concat(a, c["digest"]))
    return F.struct(beside(lambda c: c["hi"] <= lo).alias("left"), beside(lambda c: c["lo"] >= hi).alias("right"))


def attach(levels: list[DataFrame], tops: DataFrame, group: str, fan: int, tag: str) -> DataFrame:
    """The lowest level's nodes with `path`, the siblings at each level from theirs upward, and whatever `tops`
    (group as `_top`, `path`, ...) holds for the group; a subroot starts with its group's path."""
    done: DataFrame | None = None
    for k in reversed(range(len(levels))):
        nodes, span = levels[k], fan ** (k + 1)
        starts = nodes.filter(F.col("n") <= span).join(tops, F.col(group).eqNullSafe(F.col("_top"))).drop("_top")
        if done is not None:
            parents = done.select(F.col(group).alias("_g"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("children").alias("_c"), *(c for c in done.columns if c not in (group, "lo", "hi", "n", "digest", "children")))
            parents = parents.withColumn("_bucket", F.floor(F.col("_lo") / (span * fan)))
            inner = nodes.filter(F.col("n") > span).withColumn("_b", F.floor(F.col("lo") / (span * fan)))
            inside = (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
            inner = inner.join(parents.hint("merge"), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_bucket")) & inside)
            inner = inner.withColumn("path", F.concat(F.array(step(F.col("_c"), F.col("lo"), F.col("hi"))), F.col("path")))
            starts = starts.unionByName(inner.drop("_g", "_lo", "_hi", "_c", "_b", "_bucket"))
        done = saved(starts, f"{tag}-path") if k else starts
    return done


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda a, s: digest(hex_text(s["left"]), hex_text(a), hex_text(s["right"])))


def proof(path: Column) -> Column:
    """sha256 of all siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(hex_text(s["left"]), hex_text(s["right"])))), 256)


def manifest(docs: DataFrame, group: str = "lang", id_col: str = "doc_id", tampered: Column | None = None, fan: int = FAN) -> DataFrame:
    """Per row: id, group, `leaf`, `subroot`, `root`, `path` (left and right siblings by level), `proof_sha256` and
    `folded_root` of the leaf `tampered` (null: the row's own leaf) with the row's path. Digests are hexadecimal text."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(group).cast("string").alias("_group"), leaf_digest().alias("digest"), (tampered if tampered is not None else F.lit(None).cast("binary")).alias("other"))
    rows = saved(rows, "merkle-leaves")
    leaves = ranked(rows, "_group", ["_id", "digest", "other"], "merkle")
    leaves = saved(leaves, "merkle-ranks")
    levels, tops = build(leaves, "_group", fan, "merkle")
    # the tree over the groups: one group of its own
    subroots = saved(tops, "merkle-subroots")
    over = ranked(subroots.select(F.lit(0).alias("_all"), F.encode("_group", "utf-8").alias("_key"), "_group", "digest"), "_all", ["_key"], "merkle-top")
    upper, root = build(saved(over, "merkle-groups"), "_all", fan, "merkle-top")
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    root = root.select(F.col("_all").alias("_top"), F.col("digest").alias("root"))
    if upper:
        up = attach(upper, root.withColumn("path", none), "_all", fan, "merkle-top").select("root", "path", F.explode("children").alias("c"), F.col("children").alias("_c"))
        paths = up.select(F.col("c._group").alias("_top"), F.col("c.digest").alias("subroot"), "root", F.concat(F.array(step(F.col("_c"), F.col("c.lo"), F.col("c.hi"))), F.col("path")).alias("path"))
    else:
        paths = subroots.crossJoin(root.select("root")).select(F.col("_group").alias("_top"), F.col("digest").alias("subroot"), "root", none.alias("path"))  # one group, one root
    paths = saved(paths, "merkle-roots")
    out = None
    if levels:
        runs = attach(levels, paths, "_group", fan, "merkle").withColumn("c", F.explode("children"))
        out = runs.select("_group", "c._id", "c.digest", "c.other", "subroot", "root", F.concat(F.array(step(F.col("children"), F.col("c.lo"), F.col("c.hi"))), F.col("path")).alias("path"))
    lone = leaves.filter("n = 1").select("_group", "_id", "digest", "other").join(paths, F.col("_group").eqNullSafe(F.col("_top"))).select("_group", "_id", "digest", "other", "subroot", "root", "path")
    out = lone if out is None else out.unionByName(lone)
    return out.select(
        F.col("_id").alias(id_col), F.col("_group").alias(group), hex_text(F.col("digest")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"), hex_text(F.col("root")).alias("root"),
        "path", proof(F.col("path")).alias("proof_sha256"), hex_text(fold(F.coalesce("other", "digest"), F.col("path"))).alias("folded_root"),
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    other = F.when(bucket("doc_id", TAMPER_MOD) == 0, leaf_digest(text=F.translate("text", UPPER, LOWER)))
    out = manifest(docs, tampered=other)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

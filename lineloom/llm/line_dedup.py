"""Line dedup: later copies of repeated line runs are deleted. DataFrame operations only.

The lines with a word form one sequence a document; a line's id is a 128-bit hash, and the order of the ids is the order
of the alphabet. Prefix doubling sorts all suffixes of all sequences: level k holds, for every suffix that shares its
first 2^k lines with another one, the place of these lines in the order of all such beginnings. A level comes from the
one below by pairing each suffix's place with that of the suffix 2^k lines on: the different pairs that occur twice or
more are range-sorted and numbered over all partitions, and the numbers go back by a join. Suffixes that stand alone
drop out, and so do those whose beginnings are longer than any run asked for. A level is a written table.

A repeated run counts if it has min_words words or more. In the tree of longest-common-prefix intervals that cut lies,
for the suffix at a position, at its shortest run with so many words: of L lines, 2^k <= L < 2^(k+1), it is the interval
of suffixes with the same place at level k both at its start and 2^k lines before its end. The interval's member at the
smallest (doc_id, line) is the first copy and the others are later ones. Every maximal repeated run of that weight is
the union of such shortest runs, taken from the front and from the back of each of its lines, so deleting these deletes
exactly the later copies of all maximal repeated runs, and no level beyond the longest of them is made.

Places, pairs and intervals are grouped with partial sums and joined by sort and merge, so that a line or passage that
stands in a third of all documents meets in no single task; windows only run inside one document.

Defined results: a null text has no lines and stays null; lines without a word are never deleted unless they stand inside
a deleted run; documents are in order of id, null ids last, and rows that share an id, or have none, by the hash of their
text; rows that agree in id and text are the same document and get the same result; a copy that begins inside the first one
is a later copy too, so of a line or period that is repeated on the spot one stays; other columns stay as they are, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, fresh, parallelism, saved, table

MIN_WORDS = 25


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows, each with its own keys, and its place in their order: ranges of keys are numbered apart and then moved on by
    the rows before them, one count a partition."""
    parts = rows.repartitionByRange(parallelism(rows.sparkSession), *keys).withColumn("_part", F.spark_partition_id())
    parts = parts.withColumn("_at", F.row_number().over(W.partitionBy("_part").orderBy(*keys)))
    parts = saved(parts, "order")
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    # a row a partition
    counts = counts.select(F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(counts), F.col("_part") == F.col("_p")).select(*keys, (F.col("_at") + F.col("_before")).alias(name))


def place_of() -> Column:
    """The place of (doc_id, th) in the order of documents as one number: rows that share an id are told apart by the first 30
    bits of their text's hash, those without one, which come last, by all of it."""
    big = lambda c, n: c.cast(f"decimal({n},0)")
    shared = big(F.col("doc_id"), 20) * big(F.lit(2**30), 10) + big(F.shiftrightunsigned("th", 34), 10)
    alone = big(F.lit(str(2**93)), 29) + big(F.col("th"), 20) + big(F.lit(str(2**63)), 20)
    return F.when(F.col("doc_id").isNull(), big(alone, 31)).otherwise(big(shared, 31))


def sequences(docs: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, th, text) -> (d, doc_id, th) of the different documents, and their lines with words: their places,
    ids, and the shortest runs of min_words words that begin and that end there."""
    ids = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    own = docs.filter("text IS NOT NULL").select("doc_id", "th", F.filter(ids, lambda x: x["w"] > 0).alias("ls")).dropDuplicates(["doc_id", "th"])
    lines = saved(own.withColumn("d", F.monotonically_increasing_id()), "sequences")
    of = lines.select("d", "doc_id", "th")
    lines = lines.select("d", place_of().alias("no"), F.posexplode("ls").alias("seq", "x")).select("d", "no", "seq", "x.*")
    doc = W.partitionBy("d")
    in_order = doc.orderBy("seq")
    lines = lines.withColumn("after", F.sum("w").over(in_order.rowsBetween(W.unboundedPreceding, 0))).withColumn("before", F.col("after") - F.col("w"))
    ahead, back = doc.orderBy("before").rangeBetween(0, min_words - 1), doc.orderBy("after").rangeBetween(1 - min_words, 0)
    lines = lines.withColumn("_s", F.max(F.struct("seq", "line", "after")).over(ahead)).withColumn("_b", F.min(F.struct("seq", "line", "before")).over(back))
    front = F.when(F.col("_s.after") - F.col("before") >= min_words, F.struct(F.col("_s.seq").alias("seq"), F.col("_s.line").alias("line")))
    rear = F.when(F.col("after") - F.col("_b.before") >= min_words, F.struct(F.col("_b.seq").alias("seq"), F.col("_b.line").alias("line")))
    # lines from here to the first beyond which no run asked for can reach
    most = F.coalesce(F.lead(F.col("_s.seq")).over(in_order), F.col("seq")) - F.col("seq") + 1
    return of, lines.select("d", "no", "seq", "line", "a", "b", front.alias("front"), rear.alias("rear"), most.alias("most"))


def levels(lines: DataFrame) -> DataFrame:
    """(level, d, seq, place) of all suffixes that share their first 2^level lines with another one."""
    ids = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    now = lines.select("d", "seq", "most", "a", "b").join(numbered(ids.select("a", "b"), ["a", "b"], "place").hint("merge"), ["a", "b"])
    now = saved(now.select("d", "seq", "most", "place"), "level")
    every, k = now.select(F.lit(0).alias("level"), "d", "seq", "place"), 0
    while True:
        far = F.max("place").over(W.partitionBy("d").orderBy("seq").rangeBetween(2**k, 2**k))
        pairs = saved(now.withColumn("place2", far).filter((F.col("most") >= 2 ** (k + 1)) & F.col("place2").isNotNull()), "pairs")
        if pairs.isEmpty():
            return every
        more = pairs.groupBy("place", "place2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        order = numbered(more.select("place", "place2"), ["place", "place2"], "next")
        now = saved(pairs.join(order.hint("merge"), ["place", "place2"]).select("d", "seq", "most", F.col("next").alias("place")), "level")
        k += 1
        every = every.unionByName(now.select(F.lit(k).alias("level"), "d", "seq", "place"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs(doc_id, th, text) -> (doc_id, th, first, last): the lines of later copies, ranges of a document not overlapping."""
    of, lines = sequences(docs, min_words)
    lines = saved(lines, "lines")
    place = levels(lines)
    run = lambda start, first, end, last: F.struct(start.alias("start"), first.alias("first"), end.alias("end"), last.alias("last"))
    front = F.when(F.col("front").isNotNull(), run(F.col("seq"), F.col("line"), F.col("front.seq"), F.col("front.line")))
    rear = F.when(F.col("rear").isNotNull(), run(F.col("rear.seq"), F.col("rear.line"), F.col("seq"), F.col("line")))
    runs = lines.select("d", "no", F.explode(F.filter(F.array(front, rear), lambda x: x.isNotNull())).alias("r")).select("d", "no", "r.*")
    runs = runs.withColumn("len", F.col("end") - F.col("start") + 1).withColumn("level", F.floor(F.log2("len")).cast("int"))
    for name, at in (("p1", F.col("start")), ("p2", F.expr("`end` - shiftleft(1, level) + 1"))):
        side = place.select(F.col("level").alias("_l"), F.col("d").alias("_d"), F.col("seq").alias("_s"), F.col("place").alias(name)).hint("merge")
        runs = runs.withColumn("_at", at).join(side, (F.col("d") == F.col("_d")) & (F.col("_at") == F.col("_s")) & (F.col("level") == F.col("_l"))).drop("_l", "_d", "_s", "_at")
    number = F.col("no") * F.lit(2**31).cast("decimal(10,0)") + F.col("first")
    runs = saved(runs.select("d", "first", "last", "len", "p1", "p2", number.cast("decimal(38,0)").alias("place")), "runs")
    # a table of its own, so that the join below can split the runs of a very common passage
    intervals = saved(runs.groupBy("len", "p1", "p2").agg(F.min("place").alias("place0"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("len", "p1", "p2", "place0"), "intervals")
    later = runs.join(intervals.hint("merge"), ["len", "p1", "p2"]).filter("place > place0").select("d", "first", "last").distinct()
    # runs that overlap or touch become one
    doc = W.partitionBy("d")
    reach = F.max("last").over(doc.orderBy("first", "last").rowsBetween(W.unboundedPreceding, -1))
    later = later.withColumn("new", F.when(F.col("first") <= reach + 1, 0).otherwise(1))
    later = later.withColumn("part", F.sum("new").over(doc.orderBy("first", "last").rowsBetween(W.unboundedPreceding, 0)))
    later = later.groupBy("d", "part").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return later.join(of.hint("merge"), "d").select("doc_id", "th", "first", "last")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with later copies cut from the text, and `_n_lines`, `_n_removed`; these two names
    are the result's own, so columns of docs that bear them are replaced."""
    own = [c for c in docs.columns if c not in ("_n_lines", "_n_removed")]
    mark = fresh()[:8]  # names that no column of docs has
    th, d2, th2, gone_col = (f"_{x}_{mark}" for x in ("th", "id", "th2", "gone"))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    gone = repeated_runs(plain, min_words).groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias(gone_col))
    gone = saved(gone.withColumnsRenamed({"doc_id": d2, "th": th2}), "gone")
    # gone has no size bound, so it is never broadcast; rows that agree in both are one document
    out = docs.select(*own).withColumn(th, F.xxhash64(text_col))
    out = out.join(gone.hint("merge"), F.col(id_col).cast("long").eqNullSafe(F.col(d2)) & (F.col(th) == F.col(th2)), "left")
    lines = F.split(text_col, "\n", -1)
    inside = lambda i: F.exists(gone_col, lambda r: (i >= r["first"]) & (i <= r["last"]))
    kept = F.filter(lines, lambda x, i: ~inside(i))
    removed = F.aggregate(F.coalesce(gone_col, F.array().cast("array<struct<first:int,last:int>>")), F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    text: Column = F.when(F.col(gone_col).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    out = out.withColumn("_n_lines", F.coalesce(F.size(lines), F.lit(0))).withColumn("_n_removed", removed)
    return out.withColumn(text_col, text).select(*own, "_n_lines", "_n_removed")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("_n_lines")).cast("long").alias("n_lines"), F.col("_n_removed").cast("long").alias("n_removed"), "text")

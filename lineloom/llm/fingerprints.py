"""Document fingerprints by a threshold-scaled sketch.

A shingle stands at every code point of a text: that code point and the WIDTH - 1 before it, with blanks before the
beginning, so a text of n code points has n of them and half a text shares about a third of its shingles with the whole,
however short it is. A sketch holds every shingle hash below a fixed fraction 1 / SCALE of the 64-bit range, and the FLOOR
smallest hashes in any case, so that short texts keep something to compare. Both parts are decided by hashes alone, so
sketches of different scope merge: the sketch of a union is the sketch of the union of the sketches, and every estimate is
taken below the cut that both sides hold in full. That lets a page be compared with a whole source (`contained_in_groups`).

A fingerprint is the sketch as text: its hashes ascending, 16 hexadecimal digits each; the empty text's is empty.

`with_next` deals the texts out along an order without one task that sees them all: ranges of ids are cut at quantiles, an
id that fills several ranges (nulls count as one) is cut by its text's hash, and the first row of each range goes to the
range before it as well. A range's rows are then sorted and read as a stream, one text ahead. Texts are shuffled once.

Defined results: a null text is the empty text, which has no shingles; two empty sketches are alike (1.0), an empty one
and another are not (0.0). Documents are in descending order of id, null ids last, rows that share an id by the hash of
their text and then the text. A table of one row is its own next document. A text of one code point has nothing to edit and
stays. Repeated rows each get a result; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch_rows, parallelism, table, text_or_empty

#: Code points in a shingle, a power of two.
WIDTH = 16
#: Hashes below 2^64 / SCALE are kept.
SCALE = 64
#: Smallest hashes that are kept in any case.
FLOOR = 64
#: UTF-8 bytes of text that a range of ids is meant to hold, and the most cuts that the driver asks for.
RANGE_BYTES, MOST_CUTS = 64 << 20, 8192
#: Code points that are hashed at once.
STEP = 1 << 20
#: Numbers of a hot id's own ranges.
OWN = 1 << 16


def shingle_hashes(points: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hash of the shingle that ends at each code point; 0 is the blank before a text."""
    h, factor = points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
    k = 1
    with np.errstate(over="ignore"):
        while k < width:
            longer = h.copy()
            longer[k:] += h[:-k] * factor
            h, factor, k = longer, factor * factor, 2 * k
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(31))


def text_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return shingle_hashes(np.concatenate([np.zeros(width - 1, np.uint32), points + np.uint32(1)]), width)[width - 1 :]


def cut_sketch(hashes: np.ndarray, scale: int = SCALE, floor: int = FLOOR) -> np.ndarray:
    """The different hashes that a sketch keeps, ascending."""
    limit = (1 << 64) // scale
    while True:
        kept = np.unique(hashes[hashes < np.uint64(limit)] if limit < 1 << 64 else hashes)
        if len(kept) >= floor or limit >= 1 << 64:
            break
        limit *= 4
    below = int(np.searchsorted(kept, np.uint64((1 << 64) // scale))) if scale > 1 else len(kept)
    return kept[: max(below, floor)]


def sketch(text: str, width: int = WIDTH, scale: int = SCALE, floor: int = FLOOR) -> np.ndarray:
    """The sketch of a whole text; a very long one is hashed in steps, so that little more than its text is held."""
    if len(text) <= STEP:
        return cut_sketch(text_hashes(text, width), scale, floor)
    out = np.zeros(0, np.uint64)
    for k in range(0, len(text), STEP):
        begin = max(k - width + 1, 0)
        own = text_hashes(text[begin : k + STEP], width)[k - begin :]
        out = merge_sketches(out, own, scale, floor)
    return out


def merge_sketches(a: np.ndarray, b: np.ndarray, scale: int = SCALE, floor: int = FLOOR) -> np.ndarray:
    """The sketch of the union of what a and b are sketches of."""
    return cut_sketch(np.concatenate([a, b]), scale, floor)


def _shared(a: np.ndarray, b: np.ndarray, scale: int, floor: int) -> tuple[int, int, int]:
    """Hashes of a, of b and of both below the cut that both hold in full."""
    limit = (1 << 64) // scale
    ends = [max(limit - 1, int(x[-1])) for x in (a, b) if len(x) >= floor]  # fewer than floor hashes are the whole set
    if ends:
        end = np.uint64(min(ends))
        a, b = (x[: np.searchsorted(x, end, "right")] for x in (a, b))
    return len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: np.ndarray, b: np.ndarray, scale: int = SCALE, floor: int = FLOOR) -> float:
    """Estimate of the Jaccard similarity of the shingle sets."""
    x, y, both = _shared(a, b, scale, floor)
    return both / (x + y - both) if x + y else 1.0 if len(a) == len(b) else 0.0


def containment(a: np.ndarray, b: np.ndarray, scale: int = SCALE, floor: int = FLOOR) -> float | None:
    """Estimate of the share of a's shingles that b holds too; None if a has none below the common cut."""
    x, _, both = _shared(a, b, scale, floor)
    return both / x if x else None


def to_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def sketched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    batch_rows(docs.sparkSession)

    @F.pandas_udf("string")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: to_text(sketch(t)))

    return docs.select(F.col(id_col).alias("doc_id"), fingerprint(text_or_empty(text_col)).alias("fingerprint"))


def hashes_of(fingerprint: Column) -> Column:
    """The hashes as an array of 16 digits each: their order is the order of the hashes."""
    at = F.sequence(F.lit(1), F.length(fingerprint), F.lit(16))
    return F.when(F.length(fingerprint) > 0, F.transform(at, lambda i: F.substring(fingerprint, i, F.lit(16)))).otherwise(F.array().cast("array<string>"))


def _rows(fingerprints: DataFrame, *keep: str) -> DataFrame:
    return fingerprints.select(*keep, F.explode(hashes_of(F.col("fingerprint"))).alias("hash"))


def merged(fingerprints: DataFrame, by: str) -> DataFrame:
    """(by, hash): the sketch of each group's union as rows, from (by, fingerprint). A group of any size is spread by hash;
    of the hashes beyond the fraction each task passes on the FLOOR smallest of a group only."""
    rows = _rows(fingerprints, by).distinct()
    limit = F.lit(f"{(1 << 64) // SCALE:016x}")
    few = rows.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy("hash"))).filter(F.col("_r") <= FLOOR).drop("_r")
    return rows.filter(F.col("hash") < limit).union(few).distinct()


def contained_in_groups(fingerprints: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """(doc_id, by, share): the estimated share of each document's shingles that each group of merged() holds, where they
    have a hash in common. The groups are the larger sides, so the cut is the fixed fraction unless a group is small."""
    limit = F.lit(f"{(1 << 64) // SCALE - 1:016x}")
    size = groups.groupBy(F.col(by).alias("_g")).agg(F.count(F.lit(1)).alias("_n"), F.max("hash").alias("_last"))
    end = F.when(F.col("_n") >= FLOOR, F.greatest(limit, F.col("_last"))).otherwise(F.lit("f" * 16))
    own = _rows(fingerprints, "doc_id").distinct()
    hits = own.join(groups.select(F.col(by).alias("_of"), F.col("hash").alias("_h")), F.col("hash") == F.col("_h"))
    hits = hits.groupBy("doc_id", "_of").agg(F.count(F.lit(1)).alias("_both"))
    # a document's hashes below each group's cut: as many cuts as groups it meets
    pairs = hits.join(size.select("_g", end.alias("_end")), F.col("_of").eqNullSafe(F.col("_g")))
    each = fingerprints.select("doc_id", "fingerprint").distinct().withColumnRenamed("doc_id", "_d")
    pairs = pairs.join(each.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")))
    below = F.size(F.filter(hashes_of(F.col("fingerprint")), lambda h: h <= F.col("_end")))
    return pairs.select("doc_id", F.col("_of").alias(by), (F.col("_both") / below).alias("share"))


def cuts(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Quantiles of doc_id, ascending: the different ones, how many ranges each one fills, and that of null ids."""
    asked = max(n - 1, 1)
    found = rows.agg(
        F.percentile_approx("doc_id", [(k + 1) / (asked + 1) for k in range(asked)], max(10000, 20 * asked)).alias("q"),
        F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids"),
    ).first()
    values, times = np.unique(np.array(found["q"] or [], np.int64), return_counts=True)
    nulls = found["n"] - found["ids"]
    return values, times, max(1, min(OWN - 1, round(n * nulls / max(found["n"], 1))))


def range_of(ids: np.ndarray, null: np.ndarray, hashes: np.ndarray, values: np.ndarray, times: np.ndarray, nulls: int) -> np.ndarray:
    """Numbers of ranges, ascending along descending ids. Hashes are unsigned."""
    k = np.searchsorted(values, ids)
    hit = np.zeros(len(ids), bool)
    many = np.ones(len(ids), np.int64)
    if len(values):
        near = np.minimum(k, len(values) - 1)
        hit = (values[near] == ids) & (times[near] > 1)
        many = np.where(hit, np.minimum(times[near], OWN - 1), many)
    # ids above a hot one come before it
    code = 2 * (len(values) - k) + 1 - np.where(hit, 0, 1) if len(values) else np.zeros(len(ids), np.int64)
    code, many = np.where(null, 2 * len(values) + 3, code), np.where(null, nulls, many)
    own = ((hashes >> np.uint64(32)).astype(np.int64) * many) >> 32
    return code * OWN + own


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(range, ahead, doc_id, h, text) of docs, sorted in partitions by descending id, each range followed by the first row
    of the next one, marked `ahead` = 1."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = min(MOST_CUTS, max(4 * parallelism(spark), size // RANGE_BYTES + 1))
    values, times, nulls = cuts(rows.select("doc_id"), n)

    def place(ids: pd.Series, hashes: pd.Series) -> np.ndarray:
        null = ids.isna().to_numpy()
        return range_of(ids.fillna(0).astype("int64").to_numpy(), null, hashes.to_numpy(np.int64).view(np.uint64), values, times, nulls)

    # ids travel as text, so that a batch with nulls doesn't become floating point
    def exact(ids: pd.Series) -> pd.Series:
        return pd.Series(pd.array([None if x is None else int(x) for x in ids], "Int64"))

    @F.pandas_udf("long")
    def at(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(place(exact(ids), hashes))

    keyed = rows.withColumn("h", F.xxhash64("text"))
    # unsigned order of the hash, as the ranges have it
    order = (F.bitwise_not("doc_id").alias("o"), F.expr("h ^ -9223372036854775808").alias("u"))
    first = keyed.select(at(F.col("doc_id").cast("string"), "h").alias("range"), *order).groupBy("range").agg(F.min(F.struct("o", "u")).alias("m"))
    # a row a range
    found = sorted((r["range"], r["m"]["o"], r["m"]["u"]) for r in first.collect())
    before = {(o, u): found[k - 1][0] for k, (_, o, u) in enumerate(found)}

    @F.pandas_udf("array<struct<range:long,ahead:int>>")
    def all_ranges(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        ids = exact(ids)
        own, out = place(ids, hashes), []
        for r, i, h in zip(own.tolist(), ids.tolist(), hashes.tolist()):
            also = before.get((None if i is pd.NA else ~i, h ^ -(1 << 63)))
            out.append([{"range": r, "ahead": 0}] + ([] if also is None else [{"range": also, "ahead": 1}]))
        return pd.Series(out)

    dealt = keyed.withColumn("r", F.explode(all_ranges(F.col("doc_id").cast("string"), "h"))).select("r.range", "r.ahead", "doc_id", "h", "text")
    tasks = max(parallelism(spark), size // RANGE_BYTES + 1)
    # nulls sort first along the inverted id within their own range, where all are null
    return dealt.repartition(int(tasks), "range").sortWithinPartitions("range", "ahead", F.bitwise_not("doc_id"), F.expr("h ^ -9223372036854775808"), "text")


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_next double"


def edited(text: str, after: str) -> str:
    """text with its last half replaced by as much of the text after it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row against the one after it in its range."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
    held, of = None, None  # the row that waits for the next one, its range
    for batch in batches:
        out = []
        for place, ahead, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("range", "ahead", "doc_id", "text"))):
            # copies of a row that stands first in a range follow it; only the first of them is next to anything
            if ahead and (held is None or of != place):
                continue
            own = sketch(text)
            if held is not None and of == place:
                i, t, s = held
                changed = edited(t, text)
                e = s if changed == t else sketch(changed)
                shared = containment(s, own) if len(s) <= len(own) else containment(own, s)
                out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), to_text(s), to_text(e), likeness(s, e), likeness(s, own), shared))
            held, of = (None if ahead else (doc_id, text, own)), place
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its fingerprint and that of its edited text, and its likeness to the edited and to the next one;
    `contained_next`: the share of the smaller one's shingles that the larger one holds, null where the sketches can't tell."""
    batch_rows(docs.sparkSession)
    columns = with_next(docs, id_col, text_col).select("range", "ahead", "doc_id", "text")
    return columns.mapInArrow(_compare, FIELDS)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))

"""N-gram Jaccard join by grouped prefixes.

A document's set holds the distinct n-word shingles as 64-bit hashes; their numeric order is the global order. The
prefix of a set is its first tokens in that order, just long enough that two sets over the threshold must share two
tokens that are neighbours in both prefixes (see prefix_length). These neighbour pairs are the join keys; unlike single
tokens they hardly ever meet in unrelated texts, so no count of all shingles is needed for a rarest-first order.

1. Documents with the same set form a class; one row of each goes on.
2. Classes with a common key, in order of size in a window over the key, each meet the first and the one before: a key
   with k classes gives 2k rows at most, not k squared.
3. A pair goes on if sizes and parities of its sets allow a link. Parities have about a bit a token: they differ in no more
   bits than the sets in tokens, so no link is lost. What passes connects to parts.
4. A key of three classes or more that lie in several parts, such as one of a passage that unrelated texts quote, is dealt in
   blocks of bounded size, and every pair of its blocks meets in one task, which filters the pairs of different parts alike,
   except those that have met under the key that both have before it.
   So texts that only share keys never gather in a cluster, and every link lies inside one of those that 3 and 4 connect.
5. These are dealt in smaller blocks with the whole sets and verified exactly; links connect to components.
Tasks of 4 and 5 return only a spanning forest of the pairs that pass.

Defined results: null text is an empty set, which links with nothing; texts with fewer words than a shingle have the
whole sequence as their one shingle; rows with a null id take no part and get a null component; repeated rows are
equal sets and share a component, and so do rows that share an id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch_rows, parallelism, saved, table, text_or_empty

#: Classes and tokens in a block of whole sets; classes in a block of parities, which are bounded.
BLOCK, BLOCK_TOKENS = 500, 1 << 19
FILTER_BLOCK = 1000
#: Sets that are compared one by one, as whole numbers; rows of a tile of comparisons otherwise.
FEW, TILE = 12, 64
MOST_PARITY_BITS = 1 << 16
#: Edges in a file of a round of connected().
EDGES_IN_FILE = 200_000
#: Word hashes that a worker keeps.
KEPT_WORDS = 200_000


class _Words(dict):
    """64-bit hash of a word, kept."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str, width: int, words: dict) -> np.ndarray:
    """The sorted distinct shingle hashes of a text with A-Z lower-cased."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # both ASCII only
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


@lru_cache(maxsize=100_000)
def prefix_length(n: int, percent: int) -> int:
    """Tokens of a set of n that its prefix needs.

    Let x (n tokens) and y (m) have o or more tokens in common, o the least that reaches the threshold. Up to the end of
    the prefix that ends first, say x's with L tokens, there are at least L - a common tokens and a + b others, where a
    of x's n - o at most and b of y's are not common, and a + b <= n + m - 2o. Each other token parts at most one pair
    of successive common ones, so a pair stays together in both if L - a - 1 > a + b: L = 2a + b + 2 is enough, at most
    2n + m - 3o + 2 over all sizes m that can reach the threshold.
    """
    m = np.arange(-(-n * percent // 100), n * 100 // percent + 1)
    o = -(-percent * (n + m) // (100 + percent))
    return int(min(n, (2 * n + m - 3 * o).max() + 2)) if len(m) else 0


def prefix_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the neighbours in the prefix. Sets so small that only equal ones can link have none."""
    n = len(tokens)
    if n * 100 < percent * (n + 1):  # one token more is too much already, and so one less is
        return np.zeros(0, dtype=np.uint64)
    p = tokens[: prefix_length(n, percent)]
    return _mixed(p[:-1] * np.uint64(0x9E3779B97F4A7C15) + p[1:])


def parities(tokens: np.ndarray) -> bytes:
    """Per bit, whether an odd number of tokens falls on it; about a bit a token, a power of two in all."""
    size = min(MOST_PARITY_BITS, max(64, 1 << (len(tokens) - 1).bit_length()))
    bit = ((tokens >> np.uint64(20)) % np.uint64(size)).astype(np.int64)
    return np.packbits(np.bincount(bit, minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(parity: np.ndarray, words: int) -> np.ndarray:
    """Parities, a row each, in fewer 64-bit words: bits that are equal modulo the new size meet."""
    return np.bitwise_xor.reduce(parity.reshape(len(parity), -1, words), axis=1)


def may_link(a: bytes, n: int, b: bytes, m: int, percent: int) -> bool:
    """Whether the sizes and parities of two sets allow a link. Parities are compared in the smaller of their two sizes."""
    if n > m:
        a, n, b, m = b, m, a, n
    if 100 * n < percent * m:
        return False
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    size, large = 8 * len(a), 8 * len(b)
    while large > size:
        large //= 2
        y = (y >> large) ^ (y & ((1 << large) - 1))
    return (100 + percent) * (x ^ y).bit_count() <= (100 - percent) * (n + m)


def _signer(width: int, percent: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            n, set_key, keys, parity = [], [], [], []
            for text in batch.column(1).to_pylist():
                tokens = shingles(text, width, words)
                k = prefix_keys(tokens, percent)
                n.append(len(tokens))
                set_key.append(hashlib.md5(tokens.tobytes()).digest())
                keys.append(k.view(np.int64))
                parity.append(parities(tokens))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            at = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(set_key, pa.binary()), pa.ListArray.from_arrays(at, flat), pa.array(parity, pa.binary())], ["id", "n", "set_key", "keys", "parity"])

    return sign


def _set_maker(width: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            sets = [shingles(t, width, words) for t in batch.column(1).to_pylist()]
            data = [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary()), batch.column(2), batch.column(3)]
            yield pa.RecordBatch.from_arrays(data, ["id", "n", "data", "root", "blocks"])

    return make


def links(sets: list[np.ndarray], percent: int, left: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs over the threshold. left: which sets are of the first block; pairs are between
    blocks, or all if there is only one block."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(m), sizes)
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    if not len(owner):
        return []
    column = np.unique(column, return_inverse=True)[1]
    common = np.zeros((m, m), dtype=np.float32)
    step = min(int(column[-1]) + 1, max(1, (1 << 22) // m))
    cuts = np.searchsorted(column, np.arange(0, column[-1] + 1 + step, step))
    for k in range(len(cuts) - 1):
        part = np.zeros((m, step), dtype=np.float32)
        part[owner[cuts[k] : cuts[k + 1]], column[cuts[k] : cuts[k + 1]] - k * step] = 1
        common += part @ part.T
    both = common.astype(np.int64)
    return forest(100 * both >= percent * (sizes[:, None] + sizes[None, :] - both), left)


def forest(ok: np.ndarray, left: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that are ok, between blocks or, if all are of the first, among all."""
    if not left.all():
        ok = ok & (left[:, None] != left[None, :])
    label, out = np.arange(len(ok)), []
    for i in range(len(ok)):
        near = np.flatnonzero(ok[i, i + 1 :]) + i + 1
        for other, at in zip(*np.unique(label[near], return_index=True)):
            if other != label[i]:
                label[label == other] = label[i]
                out.append((i, int(near[at])))
    return out


class _BySize:
    """Sets in order of size, with their parities as rows of 64-bit words."""

    def __init__(self, at: np.ndarray, parity: list[bytes], n: np.ndarray, part: np.ndarray, before: np.ndarray) -> None:
        self.at = at[np.argsort(n[at], kind="stable")]
        self.sizes, self.parts, self.before, self.fewer = n[self.at], part[self.at], before[self.at], {}
        # longer sets have as many words or more, so those with the same number of words stand together
        words = np.array([len(parity[k]) // 8 for k in self.at], dtype=np.int64)
        self.runs = [(int(w), *(int(x) for x in np.searchsorted(words, [w, w + 1]))) for w in np.unique(words)]
        for w, start, end in self.runs:
            self.fewer[w, w] = np.frombuffer(b"".join(parity[k] for k in self.at[start:end]), np.uint64).reshape(-1, w)

    def words(self, run: tuple[int, int, int], least: int, start: int, end: int) -> np.ndarray:
        """A column for each of the sets from start to end of a run, folded to so many words."""
        if (run[0], least) not in self.fewer:
            self.fewer[run[0], least] = folded(self.fewer[run[0], run[0]], least)
        return np.ascontiguousarray(self.fewer[run[0], least][start - run[1] : end - run[1]].T)

    def near(self, others: _BySize, percent: int) -> Iterator[tuple[int, int]]:
        """The pairs that likely() compares and whose sizes and parities allow a link; each once if the others are the same."""
        for own in self.runs if len(others.at) else ():
            for x in range(own[1], own[2], TILE):
                y = min(x + TILE, own[2])
                lo = x if others is self else int(np.searchsorted(others.sizes, -(-self.sizes[x] * percent // 100)))
                hi = int(np.searchsorted(others.sizes, self.sizes[y - 1] * 100 // percent, side="right"))
                for run in others.runs:
                    start, end = max(run[1], lo), min(run[2], hi)
                    if start >= end:
                        continue
                    least = (100 - percent) * (self.sizes[x:y, None] + others.sizes[start:end])  # over 100 + percent: the most in which they may differ
                    ok = (self.parts[x:y, None] != others.parts[start:end]) & (self.before[x:y, None] != others.before[start:end])
                    ok &= abs(self.sizes[x:y, None] - others.sizes[start:end]) * (100 + percent) <= least
                    if not ok.any():
                        continue
                    width = min(own[0], run[0])
                    differ = np.zeros(ok.shape, dtype=np.int32)
                    for one, other in zip(self.words(own, width, x, y), others.words(run, width, start, end)):
                        differ += np.bitwise_count(one[:, None] ^ other)
                    for i, j in zip(*np.nonzero(ok & ((100 + percent) * differ.astype(np.int64) <= least))):
                        yield int(self.at[x + i]), int(others.at[start + j])


def likely(parity: list[bytes], n: np.ndarray, left: np.ndarray, part: np.ndarray, before: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """The pairs of different parts whose sizes and parities allow a link, as few as connect them all. left: which sets are of
    the first block; pairs are between blocks, or all if there is only one block. before: two sets with the same number have
    met elsewhere and aren't compared."""
    whole = bool(left.all())
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    def joined(i: int, j: int) -> bool:
        x, y = find(int(part[i])), find(int(part[j]))
        root[max(x, y)] = min(x, y)
        return x != y

    if len(parity) <= FEW:
        a, b = np.flatnonzero(left).tolist(), np.flatnonzero(left if whole else ~left).tolist()
        pairs = ((i, j) for i in a for j in b if (i < j or not whole) and before[i] != before[j] and find(int(part[i])) != find(int(part[j])))
        return [(i, j) for i, j in pairs if may_link(parity[i], int(n[i]), parity[j], int(n[j]), percent) and joined(i, j)]
    # each pair has a set that isn't of the largest part, and one that isn't of those with the commonest number
    alike = [x == found[times.argmax()] for x in (part, before) for found, times in (np.unique(x, return_counts=True),)]
    rest = ~max(alike, key=np.count_nonzero)
    a, a_most, b, b_most = (_BySize(np.flatnonzero(x), parity, n, part, before) for x in (left & rest, left & ~rest, ~left & rest, ~left & ~rest))
    met = ((a, a), (a, a_most)) if whole else ((a, b), (a, b_most), (b, a_most))
    return [(i, j) for x, y in met for i, j in x.near(y, percent) if joined(i, j)]


def numbers(keys: list[int | None]) -> np.ndarray:
    """A number for each key; one of its own where there is none."""
    known: dict[int, int] = {}
    return np.array([~k if x is None else known.setdefault(x, k) for k, x in enumerate(keys)])


def _closer(percent: int, whole: bool):
    """Runs over rows (root, i, j, id, n, data, part, before, own), sorted by the first three: each group is a pair of blocks."""

    def close(group: list) -> list[tuple[int, int]]:
        left = np.array([g[3] for g in group])
        if whole:
            found = links([np.frombuffer(g[2], np.uint64) for g in group], percent, left)
        else:
            found = likely([g[2] for g in group], np.array([g[1] for g in group]), left, np.array([g[4] for g in group]), numbers([g[5] for g in group]), percent)
        return [(group[a][0], group[b][0]) for a, b in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, found = None, [], []
        for batch in batches:
            for root, i, j, ident, n, data, part, before, own in zip(*(batch.column(k).to_pylist() for k in range(9))):
                if (root, i, j) != now:
                    if len(group) > 1:
                        found += close(group)
                    now, group = (root, i, j), []
                group.append((ident, n, data, i == j or own == i, part, before))
        if len(group) > 1:
            found += close(group)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return run


def _in_blocks(members: DataFrame, percent: int, whole: bool) -> DataFrame:
    """members(root, id, n, data, part, before, blocks) -> pairs that pass, from all pairs of blocks of each root. Members are
    dealt by a hash, so a block holds about its share of the classes and tokens. part and before are for parities only."""
    dealt = members.withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "n", "data", "part", "before", "own")
    dealt = dealt.repartition(parallelism(members.sparkSession), "root", "i", "j").sortWithinPartitions("root", "i", "j")
    return dealt.mapInArrow(_closer(percent, whole), "a long, b long")


def _may_link(percent: int):
    """Runs over rows (a, n, parity, b, m, parity of b) and keeps the pairs that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, n, x, b, m, y = (batch.column(k).to_pylist() for k in range(6))
            keep = pa.array([k for k in range(len(a)) if may_link(x[k], n[k], y[k], m[k], percent)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(3).take(keep)], ["a", "b"])

    return run


def _likely_edges(keys: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """keys(id, n, key) of the classes -> pairs (a, b) that connect all classes whose key, sizes and parities allow a link."""
    chain = W.partitionBy("key").orderBy("n", "id")
    every = chain.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    met = keys.select("id", "n", "key", *(f(c).over(w).alias(c + k) for k, f, w in (("0", F.lag, chain), ("1", F.first, every)) for c in ("id", "n")), F.count(F.lit(1)).over(every).alias("count"))
    # of two that meet alone one row is enough, and their key is of no use beyond it
    met = met.filter("count > 2 OR id0 IS NOT NULL").selectExpr(
        "id", "CASE WHEN count > 2 THEN key END AS key", f"CASE WHEN 100 * n0 >= {percent} * n AND id0 <> id THEN id0 END AS id0", f"CASE WHEN count > 2 AND 100 * n1 >= {percent} * n AND id1 <> id THEN id1 END AS id1"
    )
    met = saved(met.filter("key IS NOT NULL OR id0 IS NOT NULL"), "met")
    pairs = met.select("id", F.explode(F.array("id0", "id1")).alias("other")).filter("other IS NOT NULL")
    pairs = pairs.select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct()
    first, second = (classes.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"parity_{c}")).hint("merge") for c in ("a", "b"))
    pairs = pairs.join(first, "a").join(second, "b").select("a", "n_a", "parity_a", "b", "n_b", "parity_b")
    passed = saved(pairs.mapInArrow(_may_link(percent), "a long, b long"), "passed")
    parts = connected(passed)
    # what meets under a key without being in one part yet
    rows = met.filter("key IS NOT NULL").select("key", "id").distinct()
    rows = rows.join(parts.hint("merge"), F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("root", "id").alias("part"))
    rows = saved(rows, "meeting")
    open_keys = rows.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.ceil(F.count(F.lit(1)) / FILTER_BLOCK).cast("int").alias("blocks"))
    rows = rows.join(open_keys.filter("least <> most").select("key", "blocks").hint("merge"), "key")
    of_class = classes.select(F.col("class").alias("id"), "n", F.col("parity").alias("data")).hint("merge")
    # a pair shares many keys; where both have the same one before it, the pair meets there already
    rows = rows.withColumn("before", F.lag("key").over(W.partitionBy("id").orderBy("key")))
    rows = rows.join(of_class, "id").select(F.col("key").alias("root"), "id", "n", "data", "part", "before", "blocks")
    more = saved(_in_blocks(rows, percent, False), "more")
    return parts.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)


def _clusters(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, root, blocks) of all nodes of the edges; blocks: how many a cluster needs for its classes and tokens."""
    stars = connected(edges)
    nodes = stars.select(F.col("node").alias("id"), "root").unionByName(stars.select(F.col("root").alias("id"), "root").distinct())
    nodes = saved(nodes.join(classes.select(F.col("class").alias("id"), "n"), "id"), "clusters")
    needed = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS))
    sizes = saved(nodes.groupBy(F.col("root").alias("r")).agg(needed.cast("int").alias("blocks")), "cluster-sizes")
    # a root may have a large share of the nodes: merged, so that Spark can split it
    return nodes.join(sizes.hint("merge"), F.col("root") == F.col("r")).select("id", "root", "blocks")


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges -> (node, root), root the smallest node that can be reached; nodes without edges aren't listed.

    Alternates two star operations: every node hands its larger neighbours, then its smaller ones, to the smallest.
    Each round is written to the shared folder.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = saved(e, "edges")
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        # as many files as the edges need, so that rounds over few edges are a few tasks
        files = min(parallelism(e.sparkSession), 1 + now[0] // EDGES_IN_FILE)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("u2"), F.least("w", "u").alias("w"))
        large = both.join(least, F.col("u") == F.col("u2")).filter("v > u").select(F.col("v").alias("u"), F.col("w").alias("v"))
        large = saved(large.coalesce(files), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("u2"), "w")
        small = large.join(least, F.col("u") == F.col("u2"))
        small = small.filter("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v"))
        e = saved(small.unionByName(least.select(F.col("u2").alias("u"), F.col("w").alias("v"))).distinct().coalesce(files), "small-star")


def components(docs: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: `doc_id`, `n_shingles` and `component_id`, the smallest id reachable by links of percent/100 or more."""
    spark = docs.sparkSession
    batch_rows(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    signed = saved(rows.mapInArrow(_signer(width, percent), "id long, n long, set_key binary, keys array<long>, parity binary"), "signed")
    own = signed.filter("id IS NOT NULL AND n > 0")
    classes = saved(own.groupBy("set_key").agg(F.min("id").alias("class"), F.min("n").alias("n"), F.min("parity").alias("parity")), "classes")
    # ids of classes are ids of rows; a repeated id would only add keys
    keys = own.filter(F.size("keys") > 0).join(classes.select(F.col("class").alias("id")).distinct(), "id").select("id", "n", F.explode("keys").alias("key"))
    likely_ones = _clusters(_likely_edges(keys, classes, percent), classes)
    # whole sets, from the whole texts, of one row a class; the ids have no size bound, so they are never broadcast
    chosen = likely_ones.hint("merge")
    sets = rows.join(chosen, "id").select("id", "text", "root", "blocks").mapInArrow(_set_maker(width), "id long, n long, data binary, root long, blocks int")
    sets = sets.withColumns({c: F.lit(None).cast("long") for c in ("part", "before")})
    linked = connected(_in_blocks(sets, percent, True))
    # class -> component, then document -> class; both sides are plain tables, so Spark can split a class with many rows
    of_class = classes.select("set_key", "class").join(linked, F.col("class") == F.col("node"), "left").select("set_key", F.coalesce("root", "class").alias("component"))
    of_class = saved(of_class, "components")
    out = signed.select("id", "n", "set_key").join(of_class, "set_key", "left")
    component = F.when(F.col("id").isNull(), None).when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))

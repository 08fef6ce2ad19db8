"""Language-model scoring by the lattice of a subword vocabulary.

A text is a row of words and an end. A word, with a blank before it, is spelled by pieces of an existing byte-level
vocabulary and a stop; its probability sums over all its segmentations, by a forward recursion in log space. The given
vocabularies hold merge ranks and no probabilities, so a piece's own score is a Zipf law of its rank. rounds=0 scores with
these alone; by default they are the prior (PRIOR pieces' worth) to which `rounds` rounds of expected piece counts over the
training words, by forward and backward recursions, are added. Pieces that begin with a blank can only come first and the
others only later, so each kind's weights sum to one. Pieces for all single bytes give every text a probability.

The lattice of a word has one more arc, the whole word as seen in training: a word seen c times has (c - D) / N, and what
the discount D leaves, D times the different words by N, goes to the spellings, so all words together have one. D follows
from the words seen once and twice; spellings are learned from one occurrence of each different word.

A text's probability is a product over its words, so each different word is scored once however often it stands in the
corpus. Texts are packed into blocks that hold their words once and their tokens as numbers; only the words of a block
travel to be counted, scored and sent back, never tokens.

Defined results: a null text is the empty text, whose only token is the end; a null id is held out (the empty text's
remainder is 0); repeated rows are rows of their own; other columns are ignored; an empty table gives an empty result;
without training rows the vocabulary's scores are used. Words of any length have their whole lattice summed.
"""

from __future__ import annotations

import base64
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_rows, bucket, saved, table, text_or_empty

#: Tokens in a block.
BLOCK_TOKENS = 3_000_000
ROUNDS = 3
#: Occurrences that the vocabulary's own scores stand for.
PRIOR = 1000.0
#: Words of more bytes are summed one by one, along a band of the longest piece.
MANY_BYTES = 200
LOG10 = np.log(10.0)


def pieces(path: str) -> list[bytes]:
    """The pieces of a rank file that can stand in a word after a blank, best rank first, and all single bytes."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    out = [p for _, p in ranked if len((p[1:] if p[:1] == b" " else p).split()) <= 1 and not any(c in b" \t\n\v\f\r" for c in p[1:])]
    seen = set(out)
    return out + [bytes([b]) for b in range(256) if bytes([b]) not in seen]


def discount(once: int, twice: int) -> float:
    """The usual estimate from the numbers of words seen once and twice."""
    return min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5


def zipf(n: int) -> np.ndarray:
    """Weights that fall with the rank; the last place is the stop of a word."""
    return np.append(1.0 / (np.arange(n) + 10.0), 0.5)


def normal(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log weights; pieces that begin a word and the others, with the stop, each sum to one."""
    first = np.append(first, False)
    return np.log(counts / np.where(first, counts[first].sum(), counts[~first].sum()))


class Lattice:
    """Piece lookup by rolling hashes, and the recursions over many words of one length at a time."""

    STEP = np.uint64(0x100000001B3)
    SPREAD = np.uint64(0x9E3779B97F4A7C15)
    BITS = 19

    def __init__(self, vocabulary: list[bytes]) -> None:
        size = 1 << self.BITS
        self.longest = max(map(len, vocabulary))
        self.keys, self.ids = np.zeros(size + 64, np.uint64), np.full(size + 64, -1, np.int32)
        self.reach = 0
        step, wrap = int(self.STEP), (1 << 64) - 1
        hashes: dict[int, int] = {}  # of pieces and of their beginnings, which are marked -2
        for i, p in enumerate(vocabulary):
            h = 0
            for k, b in enumerate(p, 1):
                h = (h * step + b + 1) & wrap
                if k == len(p):
                    hashes[h] = i
                else:
                    hashes.setdefault(h, -2)
        starts = self.slot(np.array(list(hashes), np.uint64)).tolist()
        for start, (h, i) in zip(starts, hashes.items()):
            slot = start
            while self.ids[slot] != -1:
                slot += 1
            self.keys[slot], self.ids[slot] = h, i
            self.reach = max(self.reach, slot - start)

    def slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * self.SPREAD) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash; -2 where it only begins one, -1 where not even that."""
        at = self.slot(h)
        ids = self.ids[at]
        same = self.keys[at] == h
        out = np.where(same, ids, np.int32(-1))
        open_ = np.flatnonzero(~same & (ids != -1))
        for k in range(1, self.reach + 1):
            if not len(open_):
                break
            here = at[open_] + k
            ids, same = self.ids[here], self.keys[here] == h[open_]
            out[open_[same]] = ids[same]
            open_ = open_[~same & (ids != -1)]
        return out

    def spans(self, codes: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """(start, end) -> rows that have a piece there, and the pieces."""
        n, length = codes.shape
        out, c = {}, np.ascontiguousarray(codes.T).astype(np.uint64) + np.uint64(1)
        for i in range(length):
            rows, h = np.arange(n), np.zeros(n, np.uint64)
            for j in range(i + 1, min(length, i + self.longest) + 1):
                h = h * self.STEP + c[j - 1][rows]
                found = self.find(h)
                piece = found >= 0
                if piece.any():
                    out[i, j] = rows[piece], found[piece]
                alive = found != -1
                rows, h = rows[alive], h[alive]
                if not len(rows):
                    break
        return out

    @staticmethod
    def forward(spans, n: int, length: int, weights: np.ndarray) -> np.ndarray:
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0.0
        for j in range(1, length + 1):
            for i in range(j):
                if (i, j) in spans:
                    rows, ids = spans[i, j]
                    alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + weights[ids])
        return alpha

    @staticmethod
    def backward(spans, n: int, length: int, weights: np.ndarray) -> np.ndarray:
        beta = np.full((length + 1, n), -np.inf)
        beta[length] = 0.0
        for i in range(length - 1, -1, -1):
            for j in range(i + 1, length + 1):
                if (i, j) in spans:
                    rows, ids = spans[i, j]
                    beta[i, rows] = np.logaddexp(beta[i, rows], beta[j, rows] + weights[ids])
        return beta

    def by_length(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and byte codes of the words of each length, a blank before each; few at a time if they are long."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(sizes):
            every = np.flatnonzero(sizes == size)
            step = max(1, 2_000_000 // int(size + 1) ** 2) if size < MANY_BYTES else 1
            for k in range(0, len(every), step):
                at = every[k : k + step]
                raw = b"".join(b" " + words[x] for x in at)
                yield at, np.frombuffer(raw, np.uint8).reshape(len(at), int(size) + 1)

    def log_probs(self, words: list[bytes], weights: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability over all segmentations."""
        out = np.zeros(len(words))
        for at, codes in self.by_length(words):
            n, length = codes.shape
            if length <= MANY_BYTES:
                out[at] = self.forward(self.spans(codes), n, length, weights)[length]
            else:
                starts, ends, ids = self.edges(codes[0])
                out[at] = self.band(starts, ends, weights[ids], length)[length]
        return out + weights[-1]

    def edges(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and pieces of all pieces in one word."""
        c = code.astype(np.uint64) + np.uint64(1)
        at, h, found = np.arange(len(c)), np.zeros(len(c), np.uint64), []
        for k in range(self.longest):
            inside = at + k < len(c)
            at, h = at[inside], h[inside]
            h = h * self.STEP + c[at + k]
            ids = self.find(h)
            piece = ids >= 0
            found.append((at[piece], at[piece] + k + 1, ids[piece]))
            at, h = at[ids != -1], h[ids != -1]
            if not len(at):
                break
        starts, ends, ids = (np.concatenate(x) for x in zip(*found))
        return starts, ends, ids

    @staticmethod
    def band(starts: np.ndarray, ends: np.ndarray, cost: np.ndarray, length: int) -> np.ndarray:
        """The forward recursion over a word's edges."""
        order = np.argsort(ends, kind="stable")
        starts, cost, cuts = starts[order], cost[order], np.searchsorted(ends[order], np.arange(1, length + 2))
        alpha = np.full(length + 1, -np.inf)
        alpha[0] = 0.0
        for j in range(1, length + 1):
            own = slice(cuts[j - 1], cuts[j])
            alpha[j] = np.logaddexp.reduce(alpha[starts[own]] + cost[own])
        return alpha

    def expected(self, words: list[bytes], weights: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces and, last, of the stop, over one occurrence of each word."""
        out = np.zeros(len(weights))
        kinds, amounts = [], []
        for at, codes in self.by_length(words):
            n, length = codes.shape
            out[-1] += n
            if length > MANY_BYTES:
                starts, ends, ids = self.edges(codes[0])
                cost = weights[ids]
                alpha = self.band(starts, ends, cost, length)
                beta = self.band(length - ends, length - starts, cost, length)[::-1]
                kinds.append(ids)
                amounts.append(np.exp(alpha[starts] + cost + beta[ends] - alpha[length]))
                continue
            spans = self.spans(codes)
            alpha, beta = self.forward(spans, n, length, weights), self.backward(spans, n, length, weights)
            for (i, j), (rows, ids) in spans.items():
                kinds.append(ids)
                amounts.append(np.exp(alpha[i, rows] + weights[ids] + beta[j, rows] - alpha[length, rows]))
        return out + np.bincount(np.concatenate(kinds), np.concatenate(amounts), minlength=len(out)) if kinds else out


_lattices: dict = {}


def _lattice(path: str, shared) -> Lattice:
    """A worker's lattice, built once."""
    if path not in _lattices:
        _lattices.clear()
        _lattices[path] = Lattice(shared.value)
    return _lattices[path]


BLOCKS = "block long, words array<binary>, n_train array<int>, ids array<long>, held_out array<boolean>, lengths array<int>, tokens binary"


def packed(tokens: np.ndarray) -> bytes:
    """Numbers as compressed byte planes; frequent words have small numbers, so most planes are nearly empty."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _packer(most: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def start() -> tuple[defaultdict, list, list, list]:
            place = defaultdict()
            place.default_factory = place.__len__  # a new word takes the next number
            return place, [], [], []

        def close() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            often = np.bincount(flat, minlength=len(place))
            order = np.argsort(-often, kind="stable")
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            trained = np.bincount(flat[np.repeat(~np.array(held, bool), lengths)], minlength=len(place))[order].astype(np.int32)
            words = list(place)
            row = [[uuid.uuid4().int >> 65], [[words[k] for k in order]], [trained], [ids], [held], [lengths.astype(np.int32)], [packed(number[flat])]]
            kinds = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], [x.split()[0] for x in BLOCKS.split(", ")])

        (place, ids, held, tokens), n = start(), 0
        for batch in batches:
            for ident, out, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = text.encode("utf-8", "surrogatepass").lower().split()
                ids.append(ident)
                held.append(out)
                tokens.append(np.fromiter(map(place.__getitem__, found), np.int64, len(found)))
                n += len(found) + 1
                if n >= most:
                    yield close()
                    (place, ids, held, tokens), n = start(), 0
        if ids:
            yield close()

    return pack


def _expecter(path: str, shared, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = _lattice(path, shared), np.zeros(len(weights.value))
        for batch in batches:
            total += lattice.expected(batch.column(0).to_pylist(), weights.value)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["piece", "n"])

    return run


def _word_scorer(path: str, shared, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = _lattice(path, shared).log_probs(batch.column(0).to_pylist(), weights.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got.astype(np.float64))], ["word", "c", "log_p"])

    return run


def train(vocab: DataFrame, path: str, shared, rounds: int = ROUNDS) -> np.ndarray:
    """Log weights of the pieces, the stop last, from the words of vocab(word, c) with c > 0. A round sends at most a row a
    piece to the driver."""
    vocabulary = shared.value
    first = np.array([p[:1] == b" " for p in vocabulary])
    own = normal(zipf(len(vocabulary)), first)
    weights, sc = own, vocab.sparkSession.sparkContext
    for _ in range(rounds):
        found = vocab.filter("c > 0").select("word").mapInArrow(_expecter(path, shared, sc.broadcast(weights)), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        counts = np.zeros(len(weights))
        for row in found.collect():
            counts[row["piece"]] = row["n"]
        weights = normal(counts + PRIOR * np.exp(own), first)
    return weights


def score(docs: DataFrame, path: str, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-0.1 word frequencies) and score (the
    lattice), both log10. held_out rows are not learned from."""
    spark = docs.sparkSession
    batch_rows(spark)
    held = F.lit(False) if held_out is None else held_out
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held"), text_or_empty(text_col).alias("text"))
    blocks = saved(rows.mapInArrow(_packer(BLOCK_TOKENS), BLOCKS), "lm-blocks")
    own = blocks.select("block", F.posexplode(F.arrays_zip("words", "n_train")).alias("at", "x")).select("block", "at", F.col("x.words").alias("word"), F.col("x.n_train").alias("n"))
    vocab = saved(own.groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    docs_in = blocks.select(F.explode("held_out").alias("h")).agg(F.count_if(~F.col("h")).alias("d")).first()["d"] or 0
    seen = vocab.agg(F.sum("c").alias("c"), *(F.count_if(x).alias(k) for k, x in (("v", F.col("c") > 0), ("once", F.col("c") == 1), ("twice", F.col("c") == 2)))).first()
    n_words, v_words = seen["c"] or 0, seen["v"] or 0
    n, v = n_words + docs_in, v_words + (docs_in > 0)
    left = discount(seen["once"] or 0, seen["twice"] or 0)
    vocabulary = pieces(path)
    shared = spark.sparkContext.broadcast(vocabulary)  # bounded by the vocabulary file
    batch_rows(spark, 20_000)  # words, not texts
    weights = train(vocab, path, shared, rounds if n_words else 0)
    scored = saved(vocab.mapInArrow(_word_scorer(path, shared, spark.sparkContext.broadcast(weights)), "word binary, c long, log_p double"), "lm-scored")
    batch_rows(spark)
    back = own.select("block", "at", "word").join(scored, "word").select("block", "at", "c", "log_p")
    below = np.log10(n + 0.1 * (v + 1))
    p_end = (docs_in + 1.0) / (n + 2.0)

    def total(block: pa.Table, words: pa.Table) -> pa.Table:
        out = []
        at = words.column("at").to_numpy()
        c, p = np.zeros(len(at)), np.zeros(len(at))
        c[at], p[at] = words.column("c").to_numpy(), words.column("log_p").to_numpy() / LOG10
        base = np.log10(c + 0.1) - below
        if n_words:
            seen_as = np.log(np.maximum((c - left) / n_words, 1e-300))
            p = np.logaddexp(np.where(c > 0, seen_as, -np.inf), p * LOG10 + np.log(left * v_words / n_words)) / LOG10
        p = p + np.log10(1 - p_end)
        for ids, held, lengths, flat in zip(*(block.column(k).to_pylist() for k in ("ids", "held_out", "lengths", "tokens"))):
            tokens = unpacked(flat)
            lengths = np.array(lengths, np.int64)
            edges = np.concatenate([[0], np.cumsum(lengths)])
            owner = np.repeat(np.arange(len(lengths)), lengths)
            add = lambda x, owner=owner, tokens=tokens, m=len(lengths): np.bincount(owner, x[tokens], minlength=m)
            known = add((c > 0).astype(float)).astype(np.int64) + (docs_in > 0)
            assert edges[-1] == len(tokens)
            out.append(pa.table({
                "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held, pa.bool_()), "n_tokens": lengths + 1, "n_known": known, "train_tokens": np.full(len(lengths), n, np.int64),
                "base_score": add(base) + np.log10(docs_in + 0.1) - below, "score": add(p) + np.log10(p_end),
            }))
        return pa.concat_tables(out) if out else pa.table({k: pa.array([], t) for k, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    whole = blocks.select(F.col("block").alias("b"), "ids", "held_out", "lengths", "tokens")
    return whole.groupBy("b").cogroup(back.groupBy("block")).applyInArrow(total, schema)


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return score(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), bucket("doc_id", 10) == 0)

"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file (base64 token, rank) becomes a BPE model over the printable stand-ins of the byte-to-character table: every
way to join two tokens into a third is a merge, ordered by the third's rank. Each match of the split pattern is encoded
by itself. A worker keeps the ids of matches it has seen, up to a bound; the rest go to the library in one call a batch.

Decoding reverses the byte table. A character may be split over tokens; offsets() maps every token to the characters it
touches, so such tokens share a character.

Defined results: a null text is encoded as the empty text (no ids, decoded to the empty bytes); special-token strings
are ordinary text; other columns are ignored; rows stay apart however often they repeat.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_rows, table, text_or_empty

#: Different matches whose ids a worker keeps.
KEPT_MATCHES = 200_000


def byte_table() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = itertools.count(256)
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def model_json(path: str) -> str:
    """vocab and merges of a rank file, as JSON; as large as the file, whatever the data."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    chars = byte_table()
    stand_in = {token: "".join(map(chars.__getitem__, token)) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        cuts = ((token[:k], token[k:]) for k in range(1, len(token)))
        merges += [(stand_in[a], stand_in[b]) for a, b in cuts if a in ranks and b in ranks]
    return json.dumps({"vocab": {stand_in[token]: rank for token, rank in ranks.items()}, "merges": merges})


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, model: str, pattern: str) -> None:
        import regex
        from tokenizers import Tokenizer, models

        parts = json.loads(model)
        self.bpe = Tokenizer(models.BPE(vocab=parts["vocab"], merges=[tuple(x) for x in parts["merges"]], ignore_merges=True))
        self.matches = regex.compile(pattern).findall
        chars = byte_table()
        self.to_chars = {b: c for b, c in enumerate(chars)}
        back = {c: b for b, c in enumerate(chars)}
        self.bytes_of = [b""] * (max(parts["vocab"].values()) + 1)
        for token, i in parts["vocab"].items():
            self.bytes_of[i] = bytes(map(back.__getitem__, token))
        self.lengths = np.array([len(x) for x in self.bytes_of], dtype=np.int64)
        self.forget()

    def forget(self) -> None:
        from collections import defaultdict

        self.place = defaultdict()
        self.place.default_factory = self.place.__len__  # a new match takes the next place
        self.flat = np.zeros(0, dtype="<u4")
        self.starts = np.zeros(1, dtype=np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.place) > KEPT_MATCHES:
            self.forget()
        known = len(self.place)
        rows = []
        for text in texts:
            found = self.matches(text)
            rows.append(np.fromiter(map(self.place.__getitem__, found), dtype=np.int64, count=len(found)))
        if new := list(itertools.islice(self.place, known, None)):
            self.learn(new)
        return [self.gather(row) for row in rows]

    def learn(self, new: list[str]) -> None:
        raw = [x.encode("utf-8") for x in new]
        shown = [x.decode("latin-1").translate(self.to_chars) for x in raw]
        got = self.bpe.encode_batch_fast([shown], is_pretokenized=True, add_special_tokens=False)[0]
        ids = np.array(got.ids, dtype="<u4")
        # no token crosses two matches, so a match ends with the token that reaches its last byte
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))) + 1
        self.flat, self.starts = np.concatenate([self.flat, ids]), np.concatenate([self.starts, self.starts[-1] + ends])

    def gather(self, row: np.ndarray) -> np.ndarray:
        begin = self.starts[row]
        count = self.starts[row + 1] - begin
        ends = np.cumsum(count)
        if not len(ends):
            return np.zeros(0, dtype="<u4")
        at = np.arange(ends[-1]) + np.repeat(begin - (ends - count), count)
        return self.flat[at]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last; a split character belongs to all its tokens."""
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        ends = np.cumsum(self.lengths[ids])
        return char[ends - self.lengths[ids]], char[ends - 1] + 1


_codecs: dict[tuple[int, str], Codec] = {}


def codec(shared, pattern: str) -> Codec:
    """A worker's codec, built once."""
    key = (shared.id if hasattr(shared, "id") else hash(shared.value), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value, pattern)
    return _codecs[key]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, `ids` and the character offsets `starts` and `ends` of every token."""
    batch_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model_json(path))  # the vocabulary: bounded by its file

    @F.pandas_udf("ids array<int>, starts array<int>, ends array<int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        c = codec(shared, pattern)
        ids = c.encode(list(texts))
        at = [c.offsets(i, t) for i, t in zip(ids, texts)]
        as_int = lambda x: x.astype(np.int32)
        return pd.DataFrame({"ids": list(map(as_int, ids)), "starts": [as_int(a) for a, _ in at], "ends": [as_int(b) for _, b in at]})

    return docs.select(F.col(id_col).alias(id_col), text_or_empty(text_col).alias("_text")).withColumn("_e", run("_text")).select(id_col, "_e.*")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: its id and the `decoded` bytes; null ids decode to the empty bytes."""
    batch_rows(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(model_json(path))

    @F.pandas_udf("binary")
    def run(ids: pd.Series) -> pd.Series:
        c = codec(shared, pattern)
        return pd.Series([b"" if x is None else c.decode(np.asarray(x, dtype=np.int64)) for x in ids])

    return encoded.select(id_col, run(F.col(ids_col)).alias("decoded"))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes and decodes each text in one pass: n_tokens, n_split (tokens that begin inside a character), SHA-256 of
    the ids as little-endian 32-bit integers and of the decoded bytes, and with_ids the ids in that form."""
    batch_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model_json(path))

    columns = ["n_tokens", "n_split", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    @F.pandas_udf("n_tokens long, n_split long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
    def run(texts: pd.Series) -> pd.DataFrame:
        c = codec(shared, pattern)
        rows = []
        for ids, text in zip(c.encode(list(texts)), texts):
            back = c.decode(ids)
            raw = np.frombuffer(back, dtype=np.uint8)
            begins = np.cumsum(c.lengths[ids]) - c.lengths[ids]
            packed = ids.tobytes()
            rows.append((len(ids), int(((raw[begins] & 0xC0) == 0x80).sum()), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest()) + (packed,) * with_ids)
        return pd.DataFrame(rows, columns=columns)

    return docs.select(F.col(id_col).alias(id_col), text_or_empty(text_col).alias("_text")).withColumn("_e", run("_text")).select(id_col, "_e.*")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)

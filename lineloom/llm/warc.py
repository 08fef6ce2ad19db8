"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by (page_id, hash of page, address and payload), null ids last. Ids, hashes and sizes alone are
sorted first: their bytes are summed along the order by a distributed prefix sum, and a shard begins at the first record that
begins in the next multiple of the shard's size. The shards' first keys, MOST_SHARDS at most, then tell each record its shard,
so payloads are shuffled once, shards hold ranges of ids whatever the ids are, and the cuts follow from the rows alone,
whatever the partitions or the cluster. A task a shard streams its records in order into gzip members, one a record, and
starts a new file when the compressed size reaches the bound. Headers and digests are made anew from the payload.

Commit: files get a temporary name of their own for each attempt of a task; the rows of the attempts that count form a
manifest; a second job moves the listed files to their final names, which may be repeated after a failure; the manifest
is written last, and readers open only what it lists. What lost attempts have left goes with the temporary folder.
Readers compare bytes, records and SHA-256 of each file with the manifest, and a cut member is an error.

Equal payloads (same SHA-1 and length) are stored once: the record with the largest page_id is the response, the others
are revisits of it. The choice is made on ids and digests only; it travels to the writers as small rows that sort just
before the record, so that payloads are shuffled once.

Defined results: a null html is the empty payload; a null url gives a record without a target address; null page_ids
revisit the largest id of their payload, and are responses where there is none; repeated rows that tie for the largest
page_id are all responses; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch_rows, delete, parallelism, saved, scratch, table

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes in a shard, if that doesn't make more than MOST_SHARDS of them; headers of a record.
SHARD_BYTES, MOST_SHARDS = 8 << 20, 100_000
HEADER_BYTES = 600
FILE_BYTES = 64 << 20
LEVEL = 6

MANIFEST = "name string, temporary string, shard long, n_records long, n_bytes long, sha256 string"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, uncompressed."""
    digest = sha1(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(4, f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member without a time stamp: equal data, equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Roller:
    """Writes members to files of a shard, a new one when the bound is reached."""

    def __init__(self, fs, root: str, attempt: str, shard: int, most: int) -> None:
        self.fs, self.root, self.attempt, self.shard, self.most = fs, root, attempt, shard, most
        self.files, self.out = [], None

    def write(self, data: bytes) -> None:
        if self.out is None:
            name = f"shard-{self.shard:08d}-{len(self.files):05d}.warc.gz"
            self.at = f"{self.root}/_temporary/{self.attempt}/{name}"
            self.fs.create_dir(self.at.rpartition("/")[0], recursive=True)
            self.name, self.out, self.n, self.size, self.sum = name, self.fs.open_output_stream(self.at, compression=None), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.sum.update(data)
        self.n, self.size = self.n + 1, self.size + len(data)
        if self.size >= self.most:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files.append((self.name, self.at, self.shard, self.n, self.size, self.sum.hexdigest()))
            self.out = None


def _writer(uri: str, most: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(uri)
        attempt, roller, done, link = uuid.uuid4().hex, None, [], None
        for batch in batches:
            for shard, key, page, url, payload, refers, is_link in zip(batch["shard"], batch["key"], batch["page"], batch["url"], batch["payload"], batch["refers"], batch["link"]):
                if is_link:
                    link = (key, page, refers)
                    continue
                if roller is None or roller.shard != shard:
                    if roller is not None:
                        roller.close()
                        done += roller.files
                    roller = _Roller(fs, root, attempt, int(shard), most)
                revisit = link is not None and link[:2] == (key, page)
                roller.write(member(record(int(page) if page is not None else None, url, payload or b"", int(link[2]) if revisit else None, revisit)))
        if roller is not None:
            roller.close()
            done += roller.files
        yield pd.DataFrame(done, columns=[x.split()[0] for x in MANIFEST.split(", ")])

    return write


def _mover(uri: str):
    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            fs.create_dir(f"{root}/data", recursive=True)
            for name, temporary, size in zip(batch["name"], batch["temporary"], batch["n_bytes"]):
                final = f"{root}/data/{name}"
                try:
                    fs.move(temporary, final)
                except OSError:  # an earlier attempt has moved it
                    if fs.get_file_info(final).size != size:
                        raise
            yield batch

    return move


def shard_starts(light: DataFrame, shard_bytes: int) -> list[tuple[int, int | None, int]]:
    """light(page, key, size) -> (shard, page, key) of each shard's first record, in order."""
    order = [F.asc_nulls_last("page"), F.asc("key")]
    parts = light.repartitionByRange(parallelism(light.sparkSession), *order).select("page", "key", (F.col("size") + HEADER_BYTES).alias("b"), F.spark_partition_id().alias("part"))
    parts = saved(parts, "warc-order")
    # a row a range
    sums = parts.groupBy("part").agg(F.sum("b").alias("_b"))
    sums = sums.select(F.col("part").alias("_p"), (F.sum("_b").over(W.orderBy("part")) - F.col("_b")).alias("before"))
    inside = F.sum("b").over(W.partitionBy("part").orderBy(*order, "b").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("b")
    at = parts.withColumn("at", inside).join(F.broadcast(sums), F.col("part") == F.col("_p"))
    at = at.withColumn("shard", F.floor((F.col("at") + F.col("before")) / shard_bytes))
    first = at.groupBy("shard").agg(F.min(F.struct(F.col("page").isNull().alias("none"), "page", "key")).alias("f"))
    return sorted((r["shard"], r["f"]["page"], r["f"]["key"]) for r in first.collect())  # MOST_SHARDS rows at most


def shard_of(starts: list[tuple[int, int | None, int]]):
    """A column function (page as text, key) -> shard."""
    shards = np.array([s for s, _, _ in starts] or [0], np.int64)
    pages = np.array([p for _, p, _ in starts if p is not None], np.int64)
    keys = np.array([k for _, _, k in starts], np.int64)

    @F.pandas_udf("long")
    def shard(page: pd.Series, key: pd.Series) -> pd.Series:
        null = page.isna().to_numpy()
        ids, own = np.array([0 if x is None else int(x) for x in page], np.int64), key.to_numpy(np.int64)
        low, high = np.searchsorted(pages, ids, "left"), np.searchsorted(pages, ids, "right")
        low[null], high[null] = len(pages), len(keys)
        at = low.copy()
        # the few shards that begin inside an id are told apart by their keys
        for a, b in {(a, b) for a, b in zip(low.tolist(), high.tolist()) if a < b}:
            here = (low == a) & (high == b)
            at[here] = a + np.searchsorted(keys[a:b], own[here], "right")
        return pd.Series(shards[np.maximum(at - 1, 0)])

    return shard


def write_archives(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes all rows under `uri` and returns the manifest."""
    spark = pages.sparkSession
    batch_rows(spark)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("key", F.xxhash64("page", "url", "digest"))
    light = saved(rows.select("page", "key", "digest", "size"), "warc-digests")
    total = light.agg(F.sum(F.col("size") + HEADER_BYTES)).first()[0] or 0
    shard_bytes = max(shard_bytes, -(-total // MOST_SHARDS))
    shard = shard_of(shard_starts(light, shard_bytes))
    # payloads that are there more than once, with the id that keeps them
    kept = saved(
        light.filter(F.col("size") >= min_revisit_bytes).groupBy("digest", "size").agg(F.max("page").alias("refers"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND refers IS NOT NULL").select("digest", "size", "refers"), "warc-kept",
    )
    links = light.join(kept, ["digest", "size"]).filter("page IS NULL OR page <> refers").select("page", "key", "refers").distinct()
    both = rows.select("page", "key", "url", "payload", F.lit(None).cast("long").alias("refers"), F.lit(0).alias("link")).unionByName(
        links.select("page", "key", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "refers", F.lit(1).alias("link"))
    )
    # ids travel as decimal text: pandas would turn longs with nulls into doubles
    dealt = both.withColumn("shard", shard(F.col("page").cast("string"), "key").cast("int"))
    dealt = dealt.repartitionById(total // shard_bytes + 1, "shard").sortWithinPartitions("shard", F.asc_nulls_last("page"), "key", F.desc("link"))
    dealt = dealt.select("shard", "key", F.col("page").cast("string").alias("page"), "url", "payload", F.col("refers").cast("string").alias("refers"), "link")
    made = saved(dealt.mapInPandas(_writer(uri, file_bytes), MANIFEST), "warc-made")
    moved = made.repartition(max(1, min(made.count(), MOST_SHARDS)), "name").mapInPandas(_mover(uri), MANIFEST)
    moved.select("name", "shard", "n_records", "n_bytes", "sha256").write.mode("overwrite").parquet(f"{uri}/manifest")
    delete(spark, f"{uri}/_temporary")
    return spark.read.parquet(f"{uri}/manifest")


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC headers, HTTP head and body of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if sha1(block) != fields["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, http, body


class _Counted:
    """A stream that keeps the size and the SHA-256 of what has been read."""

    def __init__(self, stream) -> None:
        self.stream, self.size, self.sum = stream, 0, hashlib.sha256()

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.size += len(data)
        self.sum.update(data)
        return data


def members(stream, piece: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, read piece by piece."""
    z, parts, begun = zlib.decompressobj(31), [], False
    data = stream.read(piece)
    while data:
        begun = True
        parts.append(z.decompress(data))
        if z.eof:
            yield b"".join(parts)
            data, z, parts, begun = z.unused_data, zlib.decompressobj(31), [], False
            data = data or stream.read(piece)
        else:
            data = stream.read(piece)
    if begun:
        raise ValueError("the last member is cut")


def _reader(uri: str, with_payload: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(uri)
        columns, rows, size = [x.split()[0] for x in RECORDS.split(", ")], [], 0
        frame = lambda: pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
        for batch in batches:
            for name, n_records, n_bytes, digest_of in zip(batch["name"], batch["n_records"], batch["n_bytes"], batch["sha256"]):
                with fs.open_input_stream(f"{root}/data/{name}", compression=None) as raw:  # the name would have it unpacked
                    stream, found = _Counted(raw), 0
                    for data in members(stream):
                        found += 1
                        fields, http, body = parse(data)
                        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                        if kind == "response" and sha1(body) != digest:
                            raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
                        n = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                        page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                        rows.append((int(page) if page else None, fields.get("WARC-Target-URI"), kind, n, digest, int(refers) if refers else None, body if with_payload and kind == "response" else None))
                        size += len(body) if with_payload else 200
                        if size > 16 << 20:
                            yield frame()
                            rows, size = [], 0
                    if (found, stream.size, stream.sum.hexdigest()) != (n_records, n_bytes, digest_of):
                        raise ValueError(f"{name} isn't what the manifest lists")
        if rows:
            yield frame()

    return read


def read_archives(spark: SparkSession, uri: str, with_payload: bool = True) -> DataFrame:
    """All records that the manifest under `uri` lists, files and digests checked."""
    names = spark.read.parquet(f"{uri}/manifest").select("name", "n_records", "n_bytes", "sha256")
    return names.repartition(max(1, min(names.count(), MOST_SHARDS)), "name").mapInPandas(_reader(uri, with_payload), RECORDS)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), uri)
    return read_archives(spark, uri, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

"""Fingerprints, the Merkle manifest and centroid clustering against brute force on small tables."""

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lineloom.llm import centroids, fingerprints, lattice_lm, line_dedup, merkle, nn_descent, pii_boost, queries, warc
from lineloom.llm.common import scratch

from ..conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def texts(n, seed=7):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghiäßé", k=rng.randint(2, 8))) for _ in range(300)]
    out = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 5, 40, 400]))) for _ in range(n)]
    return [*out, None, "", "x", "ab", "ÄÖ\n\U0001f600", out[3], out[3], out[4]]


# fingerprints


def true_shingles(t, width=fingerprints.WIDTH):
    padded = "\0" * (width - 1) + t
    return {padded[k : k + width] for k in range(len(t))}


def plain_sketch(t):
    """By definition: one hash a different shingle, those below the fraction and the smallest ones."""
    hashes = {int(fingerprints.text_hashes(s.lstrip("\0"))[-1]) for s in true_shingles(t)}
    below = sorted(h for h in hashes if h < (1 << 64) // fingerprints.SCALE)
    return below if len(below) >= fingerprints.FLOOR else sorted(hashes)[: fingerprints.FLOOR]


def test_sketch_is_the_definition():
    for t in texts(60):
        t = t or ""
        assert fingerprints.sketch(t).tolist() == plain_sketch(t)
        assert fingerprints.from_text(fingerprints.to_text(fingerprints.sketch(t))).tolist() == plain_sketch(t)


def test_sketch_of_a_long_text_goes_in_steps(monkeypatch):
    t = " ".join(x for x in texts(80) if x)
    whole = fingerprints.sketch(t)
    monkeypatch.setattr(fingerprints, "STEP", 1000)
    assert fingerprints.sketch(t).tolist() == whole.tolist()


def test_estimates_are_near_the_truth():
    own = [t for t in texts(120) if t and len(t) > 200]
    for a, b in zip(own, own[1:]):
        mixed = a + b
        x, y = true_shingles(a), true_shingles(mixed)
        sa, sm = fingerprints.sketch(a), fingerprints.sketch(mixed)
        assert abs(fingerprints.likeness(sa, sm) - len(x & y) / len(x | y)) < 0.25
        assert abs(fingerprints.containment(sa, sm) - len(x & y) / len(x)) < 0.25
        assert fingerprints.likeness(sa, sa) == 1.0


def test_short_texts_are_compared_in_full():
    x, y = fingerprints.sketch("a short line"), fingerprints.sketch("a short time")
    a, b = true_shingles("a short line"), true_shingles("a short time")
    assert fingerprints.likeness(x, y) == len(a & b) / len(a | b)
    assert fingerprints.likeness(fingerprints.sketch(""), fingerprints.sketch("")) == 1.0
    assert fingerprints.likeness(fingerprints.sketch(""), x) == 0.0


def brute_op11(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        own = fingerprints.sketch(t)
        out[i] = (len(t), sha(e), fingerprints.to_text(own), fingerprints.to_text(fingerprints.sketch(e)), fingerprints.likeness(own, fingerprints.sketch(e)), fingerprints.likeness(own, fingerprints.sketch(after)))
    return out


def found_op11(df):
    return {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in df.collect()}


@pytest.mark.parametrize("n", [1, 2, 3, 150])
def test_fingerprints_with_next(spark, n):
    rng = random.Random(n)
    own = texts(150)[-n:]
    ids = rng.sample(range(-(10**18), 10**18), n)
    ids[0] = None
    rows = list(zip(ids, own))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, range long")
    assert found_op11(fingerprints.compare_with_next(df)) == brute_op11(rows)


def test_fingerprints_of_rows_that_share_an_id(spark):
    own = [f"text number {k} of the same id" for k in range(400)]
    rows = [(5, t) for t in own] + [(None, t) for t in own] + [(k, "w " * k) for k in range(6, 30)] + [(5, own[0]), (9, "w " * 9), (9, "w " * 9)]
    out = fingerprints.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in out) == sorted((str(i), fingerprints.to_text(fingerprints.sketch(t))) for i, t in rows)
    # every row but one of each repeat has another next one: the ring is whole
    assert sum(r["near_next"] for r in out) > 0
    assert fingerprints.compare_with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_op11_over_the_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert found_op11(fingerprints.op11_fingerprints(spark, SF)) == brute_op11(rows)


def test_merged_sketches_and_containment(spark):
    own = [t for t in texts(100) if t]
    rows = [(k, t, "ab"[k % 2]) for k, t in enumerate(own)] + [(1000, own[1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    prints = fingerprints.sketched(df).join(df.select("doc_id", "source"), "doc_id")
    groups = fingerprints.merged(prints, "source")
    want = {}
    for _, t, s in rows:
        want[s] = fingerprints.merge_sketches(want.get(s, np.zeros(0, np.uint64)), fingerprints.sketch(t))
    got = {}
    for r in groups.collect():
        got.setdefault(r["source"], []).append(int(r["hash"], 16))
    assert {s: sorted(h) for s, h in got.items()} == {s: h.tolist() for s, h in want.items()}
    shares = {(r["doc_id"], r["source"]): r["share"] for r in fingerprints.contained_in_groups(prints, groups, "source").collect()}
    for k, t, s in rows:
        expected = fingerprints.containment(fingerprints.sketch(t), want[s])
        assert shares.get((k, s)) == (expected or None)
        if expected is not None:
            assert expected == 1.0


# Merkle manifest


def brute_op12(rows, fan=8):
    """rows of (doc_id, text, lang, source, n_chars) -> sorted result rows."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    fold = str.maketrans(merkle.UPPER, merkle.LOWER)

    def tree(nodes):
        """Top and, for each node, its siblings by level."""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
        while len(level) > 1:
            runs = [level[k : k + fan] for k in range(0, len(level), fan)]
            for k, a in enumerate(at):
                run = runs[a // fan]
                paths[k].append((run[: a % fan], run[a % fan + 1 :]))
            at, level = [a // fan for a in at], [sha("".join(r)) for r in runs]
        return level[0], paths

    groups = {}
    for i, t, lang, source, n in rows:
        leaf = sha("".join(map(part, (i, source, lang, n, t))))
        other = sha("".join(map(part, (i, source, lang, n, t and t.translate(fold)))))
        hit = zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 0
        groups.setdefault(lang, []).append(((i is not None, i or 0), leaf, i, other if hit else leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {g: tree([x[1] for x in sorted(groups[g])]) for g in order}
    root, above = tree([below[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for (_, leaf, i, start), path in zip(sorted(groups[g]), below[g][1]):
            got = start
            for left, right in path + above[k]:
                got = sha("".join([*left, got, *right]))
            out.append((str(i), leaf, below[g][0], root, sha("".join(x for left, right in path + above[k] for x in left + right)), got, got == root))
    return sorted(out)


def found_op12(spark, rows):
    df = spark.createDataFrame([(*r, 7) for r in rows], DOCS + ", _id int")
    other = merkle.F.when(merkle.bucket("doc_id", 3) == 0, merkle.leaf_digest(text=merkle.F.translate("text", merkle.UPPER, merkle.LOWER)))
    out = merkle.manifest(df, tampered=other).collect()
    return sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["folded_root"] == r["root"]) for r in out)


@pytest.mark.parametrize("n", [1, 8, 9, 65, 600])
def test_merkle(spark, n):
    rng = random.Random(n)
    rows = []
    for k, t in enumerate(texts(n + 5)[:n]):
        lang = rng.choice(["en", "en", "en", "de", None, "", "Zü", f"lone{k}"] if n > 60 else ["en"])
        rows.append((rng.choice([k, None]) if k < 3 else k, t and t.title(), lang, rng.choice(["a", None]), rng.choice([k, None])))
    rows += rows[-1:] * 3  # repeated rows
    assert found_op12(spark, rows) == brute_op12(rows)


def test_merkle_of_nothing(spark):
    assert found_op12(spark, []) == []


# centroid clustering


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [int((Fraction(x) * 64).__floor__()) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (sha(f"1:{'' if r[0] is None else r[0]}"), r[1]))
    c = [v for _, v in kept[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    return sorted((str(i), near(v)[1], near(v)[0]) for i, v in kept), c


def clustered(spark, rows):
    found, c = centroids.cluster(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cluster int"))
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in found.collect()), c.tolist()


def test_centroids(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 64))
    rows = [(k, (base[k % 6] + 0.3 * rng.normal(size=64)).tolist()) for k in range(300)]
    rows += [(None, rows[0][1]), (None, None), (400, []), (401, [0.0] * 63), (402, [0.0] * 63 + [None]), (403, [0.0] * 63 + [float("nan")]), (404, [0.0] * 63 + [float("inf")]), (405, [0.0] * 64), *rows[:4]]
    got, c = clustered(spark, rows)
    want, truth = brute_clusters(rows)
    assert c == truth and got == want


@pytest.mark.parametrize("n", [0, 1, 5])
def test_centroids_of_few_and_equal_vectors(spark, n):
    rows = [(k, [1.5 if k < 3 else -20000.25] * 64) for k in range(n)]
    got, c = clustered(spark, rows)
    want, truth = brute_clusters(rows)
    assert c == truth and got == want


def test_few_distances_are_taken_in_full():
    rng = np.random.default_rng(5)
    c = rng.integers(-4000, 4000, (16, 64))
    v = c[rng.integers(0, 16, 500)] + rng.integers(-50, 50, (500, 64))
    mean, turned = v.mean(0), np.linalg.eigh(np.cov(v.T))[1][:, ::-1]
    *args, = (*centroids.rotate(v, mean, turned, 16), c, *centroids.rotate(c, mean, turned, 16))
    _, _, taken = centroids.nearest(v, *args)
    assert taken < 1000  # of 8,000


@pytest.mark.parametrize("name", ["op12_merkle", "op13_centroids"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(str(tuple(r[c] for c in rel.columns)) for r in df.collect()) == sorted(map(str, rel.fetchall()))


# faults of the operators before


def test_redact_by_id_and_text(spark):
    rows = [(1, "mail x.y@z.org or call"), (1, "a plain line, nothing, in words and x"), (None, "no mark here at all"), (None, "q@w.example.com first"), (None, None)]
    got = sorted((str(r[0]), str(r[1])) for r in pii_boost.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("1", "mail [email] or call"), ("1", rows[1][1]), ("None", rows[2][1]), ("None", "[email] first"), ("None", "None")])


def test_cosine_of_very_small_and_large_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    sizes = [1.0, 1e-200, 1e200, 5e-320, 1e300]
    rows = [(k, (base[k] * sizes[k % 5]).tolist()) for k in range(40)]
    got = nn_descent.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") < 10).collect()
    assert len(got) == 50
    truth = base / np.linalg.norm(base, axis=1, keepdims=True)
    for r in got:
        # subnormal components have few bits
        assert abs(r["score"] - truth[r["query_id"]] @ truth[r["vec_id"]]) < (1e-2 if 3 in (r["query_id"] % 5, r["vec_id"] % 5) else 1e-9)


def test_queries_that_the_graph_leaves_alone(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(60)]
    # a graph without the edges of some nodes
    whole = nn_descent.graph
    monkeypatch.setattr(nn_descent, "graph", lambda units, **kw: whole(units, **kw).filter("node > 3 AND near > 3"))
    got = nn_descent.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") < 6).collect()
    v = np.array([r[1] for r in rows])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(4):
        s = u @ u[q]
        s[q] = -2
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == np.argsort(-s)[:5].tolist()


def test_lm_without_training_rows(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(1, "two words"), (2, None)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in lattice_lm.score(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), F.lit(True)).collect()}
    assert [out[i]["base_score"] for i in (1, 2)] == [0.0, 0.0] and [out[i]["n_tokens"] for i in (1, 2)] == [3, 1]
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] < 0 for r in out.values())


def test_warc_shards_are_ranges_of_uneven_and_null_ids(spark):
    rows = [(k, f"u{k}", f"page {k} " * 20) for k in range(3000)] + [(9 * 10**18, "far", "x")] + [(None, f"n{k}", "null " * 9) for k in range(50)]
    uri = scratch(spark, "warc-test")
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7), uri, shard_bytes=100_000)
    assert manifest.select("shard").distinct().count() > 10
    shards = {}
    for r in manifest.collect():
        one = spark.createDataFrame([r], manifest.schema).select("name", "n_records", "n_bytes", "sha256")
        shards[r["name"]] = [x["page_id"] for x in one.mapInPandas(warc._reader(uri, False), warc.RECORDS).collect()]
    order = [p for name in sorted(shards) for p in shards[name]]
    known = [p for p in order if p is not None]
    assert len(order) == len(rows) and known == sorted(known) and order[len(known) :] == [None] * 50


def test_line_dedup_of_documents_without_ids(spark):
    passage = "\n".join(" ".join(f"w{i}x{j}" for j in range(15)) for i in range(3))
    rows = [(None, f"first\n{passage}"), (None, f"other\n{passage}\nend"), (None, f"third\n{passage}"), (7, "alone"), (None, None)]
    out = [r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sum(passage in (t or "") for t in out) == 1 and len(out) == 5
    rows = [(3, f"first\n{passage}"), (3, f"other\n{passage}"), (9, passage + "\nz")]
    out = [r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sum(passage in t for t in out) == 1

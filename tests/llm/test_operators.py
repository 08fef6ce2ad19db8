"""The ten operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineloom.llm import byte_bpe, lattice_lm, line_dedup, mixing, ngram_join, nn_descent, pii_boost, rule_ledger, toxicity, warc
from lineloom.llm.common import scratch

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "é", "中", "Re"]) for _ in range(r.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage = line(60)
    out = {0: None, 1: "", 2: " \n\t\n", 3: "one", 4: "One", 5: "two words", 6: "x" * 30_000, 7: "1 " * 6_000, 8: "a@b.c." + "d." * 4_000}
    for i in range(10, 60):
        out[i] = "\n".join(line(r.randint(3, 40)) for _ in range(r.randint(1, 6)))
    for i in range(60, 70):
        out[i] = out[i - 50] + "\n" + passage
    for i in range(70, 80):
        w = out[12].split(" ")
        w[r.randrange(len(w))] = "zz"
        out[i] = " ".join(w)
    for i in range(80, 90):
        out[i] = out[11]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", ["a", "b", None][i % 3], 0, 7) for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_rule_ledger(docs, texts, empty):
    got = by_id(rule_ledger.ledger(docs))
    for i, t in texts.items():
        t = t or ""
        w, ls = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = Counter(windows)
        marked = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(5)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(marked))
    assert rule_ledger.ledger(empty).count() == 0
    led = rule_ledger.ledger(docs)
    total = {(r["policy"], r["rule_name"]): r for r in rule_ledger.ablations(led).collect()}
    bits = [r["fail_bits"] for r in got.values()]
    m = rule_ledger.mask(rule_ledger.POLICIES["v2"])
    assert total["v2", "few_words"]["n_rejected"] == sum(bool(b & m) for b in bits)
    assert total["v2", "few_words"]["n_only_this_rule"] == sum((b & m) == 1 for b in bits)


def test_mixing(docs, texts, empty):
    rows = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for i, t in texts.items():
        sizes[["a", "b", None][i % 3]] += len(WORD.findall(t or ""))
    goal, left, open_ = {}, 1.5 * sum(sizes.values()), {"a": 3, "b": 1, None: 2}
    while True:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            goal[s] = 2 * sizes[s]
            left -= goal[s]
            del open_[s]
    goal |= share
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["size"] == len(WORD.findall(texts[r["doc_id"]] or ""))
        assert math.isclose(r["target"], goal[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert taken[s] == round(goal[s])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(mixing, "RUN", 2)
        again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}
    assert mixing.mix(empty).count() == 0


def test_byte_bpe(docs, texts, empty):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(byte_bpe.round_trip(docs, PATH, public_tokenizers.PATTERN))
    for i, t in texts.items():
        ids = np.array(own.encode_ordinary(t or ""), "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    coded = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    back = by_id(byte_bpe.decode(coded, PATH, public_tokenizers.PATTERN))
    for r in coded.filter("doc_id BETWEEN 10 AND 20").collect():
        t = texts[r["doc_id"]]
        assert bytes(back[r["doc_id"]]["decoded"]).decode() == t
        assert r["starts"][0] == 0 and r["ends"][-1] == len(t) and all(a < b for a, b in zip(r["starts"], r["ends"]))
    assert byte_bpe.round_trip(empty, PATH, public_tokenizers.PATTERN).count() == 0


def test_line_dedup(docs, texts, empty):
    least = line_dedup.MIN_WORDS
    seqs, where = {}, defaultdict(list)
    for i in sorted(texts):
        seqs[i] = [(k, x, len(WORD.findall(x))) for k, x in enumerate((texts[i] or "").split("\n")) if WORD.search(x)]
        for k, (_, x, _) in enumerate(seqs[i]):
            where[x].append((i, k))
    got = by_id(line_dedup.dedup_lines(docs))
    for i, t in texts.items():
        gone, q = set(), seqs[i]
        for k in range(len(q)):
            best = 0
            for e, j in where[q[k][1]]:
                if (e, j) < (i, k):
                    n = 0
                    while k + n < len(q) and j + n < len(seqs[e]) and q[k + n][1] == seqs[e][j + n][1]:
                        n += 1
                    best = max(best, n)
            if best and sum(x[2] for x in q[k : k + best]) >= least:
                gone |= set(range(q[k][0], q[k + best - 1][0] + 1))
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        assert (got[i]["text"], got[i]["_n_removed"]) == (want, len(gone))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_of_repeated_rows(spark):
    passage = "\n".join(" ".join(f"l{k}w{j}" for j in range(10)) for k in range(4))
    rows = [(1, "head one\n" + passage), (1, "head one\n" + passage), (2, passage + "\ntail two"), (None, passage), (None, passage), (4, None), (4, None)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, rows[0][1], 0), (1, rows[0][1], 0), (2, "tail two", 4), (4, None, 0), (4, None, 0), (None, "", 4), (None, "", 4)]
    assert sorted(((r["doc_id"], r["text"], r["_n_removed"]) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_ngram_join(docs, texts, empty, width, percent):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = by_id(ngram_join.components(docs, width, percent))
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (len(sets[i]), find(i))
    assert ngram_join.components(empty, width, percent).count() == 0


def test_prefix_keys_never_miss_a_link():
    r = np.random.default_rng(5)
    for _ in range(300):
        n, percent = int(r.integers(3, 200)), int(r.choice([80, 90]))
        x = np.unique(r.integers(0, 1 << 62, n, dtype=np.uint64))
        cut = int(r.integers(0, max(1, len(x) * (100 - percent) // 100) + 1))
        y = np.unique(np.concatenate([r.permutation(x)[cut:], r.integers(0, 1 << 62, int(r.integers(0, cut + 1)), dtype=np.uint64)]))
        common = len(np.intersect1d(x, y))
        if 100 * common >= percent * (len(x) + len(y) - common) and not np.array_equal(x, y):
            assert len(np.intersect1d(ngram_join.prefix_keys(x, percent), ngram_join.prefix_keys(y, percent)))


@pytest.mark.parametrize("percent", [80, 90])
def test_prefix_keys_of_small_sets(percent):
    r = np.random.default_rng(6)
    for n in range(1, 31):
        for m in (n - 1, n, n + 1):
            for _ in range(20):
                large = np.unique(r.integers(0, 1 << 62, max(n, m), dtype=np.uint64))
                small = np.sort(r.permutation(large)[: min(n, m)])
                if n == m:  # one token is another
                    small = np.unique(np.concatenate([small[1:], r.integers(0, 1 << 62, 1, dtype=np.uint64)]))
                common = len(np.intersect1d(small, large))
                if 100 * common >= percent * (n + m - common):
                    assert len(np.intersect1d(ngram_join.prefix_keys(small, percent), ngram_join.prefix_keys(large, percent)))


@pytest.mark.parametrize("width, percent, n_words", [(3, 90, 11), (5, 80, 8)])
def test_ngram_join_of_one_word_more(spark, width, percent, n_words):
    words = [f"w{k}" for k in range(n_words + 1)]
    rows = [(1, " ".join(words[:-1])), (2, " ".join(words)), (3, "other " * 12), (4, " ".join(f"v{k}" for k in range(n_words)))]
    got = by_id(ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), width, percent))
    assert {i: r["component_id"] for i, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_lattice(docs, texts, empty):
    vocabulary = lattice_lm.pieces(PATH)
    first = np.array([p[:1] == b" " for p in vocabulary])
    w = lattice_lm.normal(lattice_lm.zipf(len(vocabulary)), first)
    lattice, number = lattice_lm.Lattice(vocabulary), {p: i for i, p in enumerate(vocabulary)}
    words = [b"the", "état".encode(), b"zzzzqqq", b"q", "中中".encode(), b"ab" * 150]
    for word, got in zip(words, lattice.log_probs(words, w)):
        x = b" " + word
        alpha = [0.0] + [-math.inf] * len(x)
        for j in range(1, len(x) + 1):
            terms = [alpha[i] + w[number[x[i:j]]] for i in range(max(0, j - lattice.longest), j) if x[i:j] in number]
            alpha[j] = np.logaddexp.reduce(terms)
        assert math.isclose(got, alpha[-1] + w[-1], rel_tol=1e-9)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    got = by_id(lattice_lm.score(docs, PATH, held, rounds=1))
    plain = by_id(lattice_lm.score(docs, PATH, held, rounds=0))
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in texts.items()}
    c = Counter(x for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 10 for x in t)
    n, v = sum(c.values()), len(c)
    ends, words = c[None], [x for x in c if x is not None]

    def lattice_of(word, w):
        """Log probability over all segmentations, and the expected count of each piece."""
        x, cost = b" " + word, lambda y: w[number[y]]
        near = lambda i: [j for j in range(i + 1, min(len(x), i + lattice.longest) + 1) if x[i:j] in number]
        alpha, beta = [0.0] + [-math.inf] * len(x), [-math.inf] * len(x) + [0.0]
        for i in range(len(x)):
            for j in near(i):
                alpha[j] = np.logaddexp(alpha[j], alpha[i] + cost(x[i:j]))
        for i in reversed(range(len(x))):
            for j in near(i):
                beta[i] = np.logaddexp(beta[i], beta[j] + cost(x[i:j]))
        return alpha[-1], [(number[x[i:j]], math.exp(alpha[i] + cost(x[i:j]) + beta[j] - alpha[-1])) for i in range(len(x)) for j in near(i)]

    counts = lattice_lm.PRIOR * np.exp(w)
    for x in words:
        counts[-1] += 1
        for k, share in lattice_of(x, w)[1]:
            counts[k] += share
    learned = lattice_lm.normal(counts, first)
    d = lattice_lm.discount(sum(c[x] == 1 for x in words), sum(c[x] == 2 for x in words))
    n_words, p_end = n - ends, (ends + 1) / (n + 2)
    assert abs(sum((c[x] - d) / n_words for x in words) + d * len(words) / n_words - 1) < 1e-9
    for i, t in tokens.items():
        r = got[i]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 10 == 0, len(t), sum(c[x] > 0 for x in t), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-6)
        for row, weights in ((r, learned), (plain[i], w)):
            score = math.log10(p_end)
            for x in t[:-1]:
                spelled = math.log(d * len(words) / n_words) + lattice_of(x, weights)[0] + weights[-1]
                score += (np.logaddexp(math.log((c[x] - d) / n_words) if c[x] else -math.inf, spelled)) / math.log(10) + math.log10(1 - p_end)
            assert math.isclose(row["score"], score, rel_tol=1e-5), (i, row["score"], score)
    assert lattice_lm.score(empty, PATH, held).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, "<p>x</p>"), (4, "http://a/ é\n", None), (5, "u", ""), (None, "u", "<p>x</p>"), (6, "u", "é" * 40_000), (6, "v", "tie"), (6, "w", "tie")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    uri = scratch(spark, "warc-test")
    manifest = warc.write_archives(pages, uri, file_bytes=500)
    assert manifest.agg(F.sum("n_records")).first()[0] == len(rows)
    got = warc.read_archives(spark, uri).collect()
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == Counter([(1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (4, "revisit", 5), (5, "response", None), (None, "revisit", 3), (6, "response", None), (6, "response", None), (6, "response", None)])
    for r in got:
        if r["page_id"] == 6 and r["payload_bytes"] > 10:
            assert bytes(r["payload"]) == ("é" * 40_000).encode()
    again = warc.write_archives(pages.repartition(5), scratch(spark, "warc-test"), file_bytes=500)
    assert sorted(r["sha256"] for r in again.collect()) == sorted(r["sha256"] for r in manifest.collect())
    none = scratch(spark, "warc-test")
    warc.write_archives(pages.limit(0), none)
    assert warc.read_archives(spark, none).count() == 0


def test_warc_shards_follow_from_the_rows(spark):
    rows = [(i, f"u{i}", f"<p>{i % 40}</p>" + "x" * 200) for i in range(300)] + [(7, f"hot{i}", "y" * 900) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    made = []
    for n in (3, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        made.append(warc.write_archives(pages.repartition(n), scratch(spark, "warc-test"), shard_bytes=50_000, file_bytes=4_000))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    a, b = ({(r["name"], r["sha256"]) for r in m.collect()} for m in made)
    assert a == b and len({n.split("-")[1] for n, _ in a}) > 8
    by_shard = made[0].groupBy("shard").agg(F.sum("n_records").alias("n"))
    assert by_shard.agg(F.sum("n")).first()[0] == 600 and by_shard.agg(F.max("n")).first()[0] < 130


def test_warc_reader_refuses_cut_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>") for i in range(20)], "page_id long, url string, html string")
    uri = f"file://{tmp_path}/a"
    warc.write_archives(pages, uri)
    (path,) = (tmp_path / "a/data").glob("*.gz")
    whole = path.read_bytes()
    import gzip

    assert gzip.decompress(whole).startswith(b"WARC/1.1") and gzip.decompress(whole).count(b"WARC/1.1\r\n") == 20
    ends = [k for k in range(len(whole) - 1) if whole[k : k + 3] == b"\x1f\x8b\x08"]
    for data in (whole[:-5], whole[: ends[-1]]):
        path.write_bytes(data)
        with pytest.raises(Exception, match="cut|manifest"):
            warc.read_archives(spark, uri).collect()
    assert not (tmp_path / "a/_temporary").exists()


def test_toxicity(spark):
    r = random.Random(1)
    plain = lambda: " ".join(r.choice(["good", "day", "rain", "road", "lamp", "tree"]) for _ in range(20))
    rows = [(i, plain() + (" you moron" if i % 5 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, plain() + " you m0r0n!!"), (1003, plain() + " мoron")], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, int(i % 5 == 0)) for i in range(600)), (700, None)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels)
    assert " moron " in lexicon.weights
    got = by_id(docs.select("doc_id", toxicity.scorer(spark, lexicon)("text").alias("score")))
    assert all((got[i]["score"] >= 0.3) == (i % 5 == 0) for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2)
    assert got[1002]["score"] >= 0.3 and got[1003]["score"] >= 0.3 and got[1000]["score"] < 0.3 and got[1001]["score"] < 0.3
    assert toxicity.fit(docs.limit(0), labels.limit(0)).weights == {}
    found = toxicity.Lexicon({" clown ": 3.0}).automaton()
    assert toxicity.features(toxicity.fold("a clown fish"), found)[0] == 0 and toxicity.features(toxicity.fold("a clown"), found)[0] == 3.0


def test_pii(spark, docs, texts, empty):
    more = {
        201: "mail x.y@a-b.c.de_z@q.rs, 10.0.0.255 and 1.2.3.256 or 1.2.3.4.5.6.7.8", 202: "card 4111 1111 1111 1111 and 4111111111111112; tel +1 (269) 555-3296 4524132264652876",
        203: "é中 a@b.c..d @x.y +12 3-", 204: "4111-1111-1111-1111 " * 3, 205: None,
    }
    every = {**texts, **more}
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(more.items()), "doc_id long, text string"))
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(int(x) if k % 2 == 0 else int(x) * 2 - 9 * (int(x) > 4) for k, x in enumerate(reversed(d))) % 10 == 0

    got = by_id(pii_boost.find_spans(df))
    for i, t in every.items():
        want = []
        for k, (kind, p) in enumerate(rules.items()):
            for m in re.finditer(p, t or ""):
                d = re.sub("[^0-9]", "", m[0])
                if {"email": lambda: True, "ip": lambda: max(map(int, m[0].split("."))) <= 255, "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]():
                    want.append((m.start(), k, m.end()))
        assert [(s["start"], s["kind"], s["end"]) for s in got[i]["spans"] if s["base"]] == sorted(want), i
    red = by_id(pii_boost.redact(df))
    assert "[email]" in red[201]["redacted"] and red[205]["redacted"] is None
    assert pii_boost.find_spans(empty).count() == 0


def test_nn_descent(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(8, 16))
    v = (centres[r.integers(0, 8, 1500)] + r.normal(size=(1500, 16))).astype(np.float32)
    v[100:400] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0] * 3), (None, [1.0] * 16)]
    got = defaultdict(list)
    for x in nn_descent.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 20):
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(1500), -np.round(s, 12)))[:5]
        assert len(got[q]) == 5
        hits += sum(x >= s[best[-1]] - 1e-9 for _, x in got[q])
        if 100 <= q < 400:
            assert [a for a, _ in got[q]] == [i for i in range(100, 107) if i != q][:5]
    assert hits / (75 * 5) >= 0.9
    big = spark.createDataFrame([(0, [1e60, 1.0], 1), (1, [1e60, 2.0], 1), (1, [1.0, 1e60], 1), (2, [0.1 + 0.2, 0.0], 1)], "vec_id long, embedding array<double>, node int")
    got = [(r["vec_id"], r["score"]) for r in nn_descent.search(big, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert [a for a, _ in got] == [1, 2, 1][: len(got)] or [a for a, _ in got] == [1, 2]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in nn_descent.search(few, F.col("vec_id") == 0).collect()] == [(0, 1)]


def test_nn_descent_goes_on_until_nothing_is_open(spark, monkeypatch):
    # a candidate a round: six rounds leave open ones in a beam of 12
    monkeypatch.setattr(nn_descent, "EXPAND", 1)
    monkeypatch.setattr(nn_descent, "BEAM", 12)
    found, plain = [], nn_descent.saved

    def saved(df, tag):
        out = plain(df, tag)
        if tag == "nn-found":
            found.append(out)
        return out

    monkeypatch.setattr(nn_descent, "saved", saved)
    v = np.random.default_rng(2).normal(size=(200, 12)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    assert nn_descent.search(df, F.col("vec_id") % 30 == 0).count() == 7 * 5
    assert found[-1].count() == 7 * 12 and found[-1].filter("open").count() == 0


def test_without_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nn_descent.search(none, F.col("vec_id") % 20 == 0).count() == 0


def test_line_dedup_keeps_clashing_columns(spark):
    passage = "\n".join(" ".join(f"l{k}w{j}" for j in range(10)) for k in range(4))
    names = "doc_id long, text string, th long, _th long, d long, seq int, place int, first int, last int, _gone string, _n_lines int"
    rows = [(1, "a\n" + passage, *range(8), 0), (2, passage + "\n\nb", *range(8), 0), (3, "c", *range(8), 0)]
    df = spark.createDataFrame([(*r[:9], "x", 0) for r in rows], names)
    out = line_dedup.dedup_lines(df)
    assert out.columns == [c for c in df.columns if c != "_n_lines"] + ["_n_lines", "_n_removed"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert [got[i]["text"] for i in (1, 2, 3)] == [rows[0][1], "\nb", "c"] and got[1]["place"] == 4 and got[2]["_n_removed"] == 4


def test_line_dedup_of_many_short_lines(spark):
    r = random.Random(4)
    unit = [f"{k} x" for k in range(6)]
    texts = {i: "\n".join(r.choice(unit) if r.random() < 0.2 else unit[(k + i) % 6] for k in range(r.randint(5, 60))) for i in range(30)}
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    lines = {i: t.split("\n") for i, t in texts.items()}
    for i, q in lines.items():
        gone = set()
        for k in range(len(q)):
            best = 0
            for e, s in lines.items():
                for j in range(len(s)):
                    n = 0
                    if (e, j) < (i, k):
                        while k + n < len(q) and j + n < len(s) and q[k + n] == s[j + n]:
                            n += 1
                    best = max(best, n)
            if 2 * best >= line_dedup.MIN_WORDS:
                gone |= set(range(k, k + best))
        assert got[i]["text"] == "\n".join(x for k, x in enumerate(q) if k not in gone)


def test_pii_adds_unmarked_forms(spark):
    r = random.Random(9)
    words = lambda n: " ".join(r.choice(["rain", "road", "lamp", "tree", "door", "blue"]) for _ in range(n))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    card = lambda: next(c for c in iter(lambda: digits(16), "") if sum(int(x) if k % 2 else int(x) * 2 - 9 * (int(x) > 4) for k, x in enumerate(c)) % 10 == 0)
    token = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    plain = [lambda: f"{r.choice('abc')}.{digits(2)}@mail{digits(1)}.example.com", lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), card, lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f'token = "{token()}"']
    texts = {i: f"{words(8)} {r.choice(plain)()} {words(6)} order {digits(8)} of {digits(4)}-{digits(2)}-{digits(2)} {'tree' * r.randint(5, 9)} {words(3)}" for i in range(900)}
    typo = lambda c: c[:-1] + str((int(c[-1]) + 1) % 10)
    unmarked = {1000: ("card", typo(card())), 1001: ("secret", token()), 1002: ("email", "ann.33 (at) mail3.example.com"), 1003: ("phone", f"1 (234) {digits(3)}-{digits(4)}"), 1004: ("ip", "12,200,33,4")}
    for i, (_, x) in unmarked.items():
        texts[i] = f"{words(8)} {x} {words(6)}"
    texts |= {2000: f"{words(9)} order {digits(8)} {words(5)}", 2001: words(30) + " " + "tree" * 9}
    got = by_id(pii_boost.find_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    seen = {i: [(pii_boost.KINDS[s["kind"]], texts[i][s["start"] : s["end"]]) for s in got[i]["spans"] if not s["base"]] for i in texts}
    assert sum(unmarked[i] in seen[i] for i in unmarked) >= 4, {i: seen[i] for i in unmarked}
    assert not seen[2000] and not seen[2001]
    secrets = [i for i in range(900) if "token" in texts[i]]
    assert sum(any(k == "secret" for k, _ in seen[i]) for i in secrets) >= 0.95 * len(secrets)
    assert sum(bool(seen[i]) for i in range(900) if i not in secrets) <= 0.03 * 900
    red = by_id(pii_boost.redact(spark.createDataFrame(list(texts.items()), "doc_id long, text string").filter("doc_id IN (1001, 2000)")))
    assert red[2000]["redacted"] == texts[2000]


def test_pii_beside_and_thresholds(spark):
    r = random.Random(2)
    span = lambda: (lambda a: (r.randint(0, 3), a, a + r.randint(1, 9)))(r.randint(0, 60))
    base, own = [span() for _ in range(20)], [(*span(), k) for k in range(150)]
    got = pii_boost.beside(spark.createDataFrame(own, "row long, start int, end int, k int"), spark.createDataFrame(base, "row long, start int, end int"))
    want = {k for row, s, e, k in own if not any(b == row and x < e and s < y for b, x, y in base)}
    assert {x["k"] for x in got.collect()} == want and want and len(want) < 150
    scored = [("a", 1.0, 0.99)] * 3 + [("a", 0.0, 0.97)] + [("a", 1.0, 0.9)] * 60 + [("a", 0.0, 0.5)] * 5 + [("b", 1.0, 0.9)] * 9 + [("c", 0.0, 0.9)] * 9
    cuts = {x["kind"]: x["cut"] for x in pii_boost.thresholds(spark.createDataFrame(scored, "kind string, label double, score double")).collect()}
    assert cuts == {"a": 0.9}


def test_toxicity_matches_as_a_plain_search_does():
    r = random.Random(8)
    words = ["bad", "badly", "ugh", "rot", "rotten", "pie", "of", "a", "x" * 40]
    lexicon = toxicity.Lexicon({" bad ": 2.0, " bad": 1.5, " rott": 1.0, " ugh ": 0.7, " a ": 0.2}, ("rotten pie", "a bad of", "ugh ugh"))
    automaton = lexicon.automaton()
    for _ in range(300):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 25)))
        folded = toxicity.fold(text)
        safe = {k for p in lexicon.exceptions for a in range(len(folded)) if folded.startswith(f" {p} ", a) for k in range(a, a + len(p) + 1)}
        once = {}
        for k in range(len(folded)):
            hits = [w for e, w in lexicon.weights.items() if folded.startswith(e, k)]
            if hits and k not in safe:
                word = folded[k + 1 :].split(" ")[0]
                once[word] = max([once.get(word, 0.0), *hits])
        n = len(folded.split())
        want = (max(once.values()), sum(once.values()) / n**0.5, len(once) / n) if once else (0.0, 0.0, 0.0)
        assert np.allclose(toxicity.features(folded, automaton), want)
    long = " ".join(["rotten pie", "bad"] * 50_000)
    assert toxicity.features(toxicity.fold(long), automaton)[2] == 1 / 150_000


def test_toxicity_folds():
    for shown, want in (("M0R0N", "moron"), ("mоrоn", "moron"), ("mörön", "moron"), ("b@d", "bad"), ("b@", "b"), ("a\u200bb", "ab"), ("ΒΑD", "bad"), ("5h!t", "shit")):
        assert toxicity.fold(shown).split() == [want], shown


def test_toxicity_learns_short_words_and_exceptions(spark):
    r = random.Random(3)
    plain = lambda n=15: " ".join(r.choice(["good", "day", "rain", "road", "lamp", "tree"]) for _ in range(n))
    rows = [(i, plain() + (" you ugh" if i % 4 == 0 else " old ugh boot" if i % 9 == 1 else "")) for i in range(900)]
    docs = spark.createDataFrame([*rows, (2000, plain() + " old ugh boot"), (2001, plain() + " you ugh")], "doc_id long, text string")
    lexicon = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(900)], "doc_id long, toxic int"))
    assert " ugh " in lexicon.weights and {"old ugh", "ugh boot"} & set(lexicon.exceptions)
    got = by_id(docs.select("doc_id", toxicity.scorer(spark, lexicon)("text").alias("score")))
    assert got[2000]["score"] < 0.3 <= got[2001]["score"]

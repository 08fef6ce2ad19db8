"""The pipeline's stages, each on what the one before has kept."""

import hashlib
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from lineloom.llm.common import saved

from ..conftest import SF


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing", "byte-level BPE"]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        out = saved(f(spark, docs, SF), "stage-test")
        if k < 4:
            assert out.columns == list(corpus_pipeline.COLUMNS)
            assert out.filter("n_chars <> length(text)").count() == 0
        if k < 3:
            ids = [r[0] for r in out.select("doc_id").collect()]
            assert len(ids) == len(set(ids)) and set(ids) <= {r[0] for r in docs.select("doc_id").collect()}
        if k == 3:
            words = lambda df: Counter({r["source"]: r["n"] for r in df.selectExpr("source", "size(regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)) AS n").groupBy("source").sum("n").withColumnRenamed("sum(n)", "n").collect()})
            before, after = words(docs), words(out)
            assert all(after[s] <= 2 * before[s] for s in after) and abs(sum(after.values()) - 1.5 * sum(before.values())) <= len(before)
        docs = out
    assert docs.count() > 0 and {"doc_id", "n_tokens", "ids"} <= set(docs.columns)


def test_edges(spark):
    rows = [(1, None, "en", None, 0), (None, "a b c", "en", "s", 5), (2, "", "en", "s", 0), (3, "x y z w v u", None, "s", 11), (3, "x y z w v u", None, "s", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in corpus_pipeline.STAGES:
        docs = saved(f(spark, docs, SF), "edge-test")
    assert docs.count() > 0
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in corpus_pipeline.STAGES:
        docs = saved(f(spark, docs, SF), "edge-test")
    assert docs.count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def without_later_copies(texts, least):
    """Every line run of `least` words or more that stood before, at a smaller (id, line), is cut."""
    seqs = {i: [(k, x, len(WORD.findall(x))) for k, x in enumerate(t.split("\n")) if WORD.search(x)] for i, t in texts.items()}
    out = {}
    for i, t in texts.items():
        gone, q = set(), seqs[i]
        for k in range(len(q)):
            best = 0
            for e, s in seqs.items():
                for j in range(len(s)):
                    n = 0
                    while (e, j) < (i, k) and k + n < len(q) and j + n < len(s) and q[k + n][1] == s[j + n][1]:
                        n += 1
                    best = max(best, n)
            if sum(x[2] for x in q[k : k + best]) >= least:
                gone |= set(range(q[k][0], q[k + best - 1][0] + 1))
        out[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
    return {i: t for i, t in out.items() if t == texts[i] or WORD.search(t)}


def one_of_each_group(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: t for i, t in texts.items() if find(i) == i}


def test_against_brute_force(spark, tmp_path):
    r = random.Random(11)
    line = lambda n: " ".join(r.choice("rain road lamp tree door blue sand wind hill lake".split()) + str(r.randint(0, 40)) for _ in range(n))
    texts = {i: "\n".join(line(r.randint(4, 30)) for _ in range(r.randint(1, 5))) for i in range(120)}
    texts[2], passage = line(120), line(40)
    for i in range(0, 120, 3):
        texts[i] += " you moron"
    for i in range(1, 40, 3):
        texts[i] += "\n" + passage
    for i in range(200, 210):
        w = texts[2].split(" ")
        w[r.randrange(len(w))] = "zz"
        texts[i] = " ".join(w)
    texts |= {300: texts[4], 301: "", 302: "one two"}
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int("moron" in texts[i])) for i in range(120)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path), f"{tmp_path}/stages")
    rows_out = out.collect()
    of = lambda k: [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{tmp_path}/stages/{k}").collect()]
    clean = {i: t for i, t in texts.items() if "moron" not in t}
    assert dict(of(0)) == clean
    once = without_later_copies(clean, 25)
    assert dict(of(1)) == once and any(once[i] != clean[i] for i in once)
    single = one_of_each_group(once)
    assert dict(of(2)) == single and len(single) < len(once)
    size = lambda t: len(WORD.findall(t))
    sizes, taken = Counter(), Counter()
    for i, t in single.items():
        sizes[["a", "b", None][i % 3]] += size(t)
    for i, t in of(3):
        taken[["a", "b", None][i % 3]] += size(t)
        assert single[i].startswith(t)
    weight = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), (3, 1, 2)))
    goal = {s: w * 1.5 * sum(sizes.values()) / sum(weight.values()) for s, w in weight.items()}
    while over := [s for s in goal if goal[s] > 2 * sizes[s] + 1e-9]:
        spare = sum(goal[s] - 2 * sizes[s] for s in over)
        goal |= {s: 2 * sizes[s] for s in over}
        rest = {s: weight[s] for s in goal if goal[s] < 2 * sizes[s]}
        goal |= {s: goal[s] + spare * w / sum(rest.values()) for s, w in rest.items()}
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes), (taken, goal, sizes)
    # ids decode to the texts of the mix, and a second run over complete tables gives the same rows
    codes = {x["doc_id"]: x["decoded_sha256"] for x in rows_out}
    assert Counter(x["decoded_sha256"] for x in rows_out) == Counter(hashlib.sha256(t.encode()).hexdigest() for _, t in of(3)) and codes
    again = corpus_pipeline.run(spark, str(tmp_path), f"{tmp_path}/stages")
    assert Counter(x["ids_sha256"] for x in again.collect()) == Counter(x["ids_sha256"] for x in rows_out)


def test_stages_chain_without_writing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = saved(corpus_pipeline.drop_repeated_lines(spark, docs, SF), "chain-test")
    want = saved(corpus_pipeline.keep_one_of_each_group(spark, one, SF), "chain-test").collect()
    got = corpus_pipeline.keep_one_of_each_group(spark, corpus_pipeline.drop_repeated_lines(spark, docs, SF), SF).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_a_folder_is_resumed_for_its_own_input_only(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"in{k}").mkdir()
        spark.range(20).selectExpr("id AS doc_id", f"'some words {k}' AS text", "'en' AS lang", "'s' AS source", "12L AS n_chars").write.parquet(f"{tmp_path}/in{k}/documents.parquet")
        spark.range(2).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/in{k}/labels.parquet")
    run = lambda k: corpus_pipeline.run(spark, f"file://{tmp_path}/in{k}", f"file://{tmp_path}/out").count()
    assert run(1) == run(1)
    with pytest.raises(ValueError):
        run(2)

"""Candidate pairs of the n-gram join: texts that only share passages, near copies about the threshold, narrow matrices."""

import random
import tracemalloc

import numpy as np
import pytest

from lineloom.llm import ngram_join


def made(seed: int) -> dict[int, str]:
    """Unrelated texts that quote one passage, and families of copies with ever more other words."""
    r = random.Random(seed)
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    passage = words(40)
    texts = [[*words(k := r.randrange(60)), *passage, *words(60 - k)] for _ in range(80)]
    for size in (25, 60, 200):
        source = words(size)
        for k in range(30):
            copy = list(source)
            for at in r.sample(range(size), r.randrange(max(2, size // 25))):
                copy[at] = words(1)[0]
            texts.append(copy[r.randrange(1 + size // 20) :] + (passage[: r.randrange(8)] if k % 3 == 0 else []))
    return {i: " ".join(x) for i, x in enumerate(texts)}


def brute(texts: dict[int, str], width: int, percent: int) -> dict[int, int]:
    sets = {i: {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} for i, t in texts.items() for w in (t.split(),)}
    root = {i: i for i in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("width, percent, block", [(3, 90, 1000), (5, 80, 1000), (5, 80, 20)])
def test_ngram_join_of_passages_and_near_copies(spark, monkeypatch, width, percent, block):
    clusters, real = [], ngram_join._clusters

    def seen(*args):
        clusters.append((out := real(*args)).select("id", "root").distinct().collect())
        return out

    monkeypatch.setattr(ngram_join, "_clusters", seen)
    monkeypatch.setattr(ngram_join, "FILTER_BLOCK", block)
    texts = made(width)
    want = brute(texts, width, percent)
    got = ngram_join.components(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), width, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert 30 < len(set(want.values())) < len(want) - 30
    # the 80 texts that quote a passage are no candidates of each other
    assert clusters and not any(r["id"] < 80 for x in clusters for r in x)


def test_sets_that_met_elsewhere_are_left_out():
    r = np.random.default_rng(3)
    base = np.unique(r.integers(0, 1 << 62, 300, dtype=np.uint64))
    sets = [np.unique(np.concatenate([r.permutation(base)[4:], r.integers(0, 1 << 62, 4, dtype=np.uint64)])) for _ in range(40)]
    n, parity, part = np.array([len(x) for x in sets]), [ngram_join.parities(x) for x in sets], np.arange(40)
    for k in (8, 40):  # one by one, and in tiles
        for left in (np.ones(k, bool), np.arange(k) % 2 == 0):
            call = lambda part, before: ngram_join.likely(parity[:k], n[:k], left, part[:k], ngram_join.numbers(before[:k]), 90)  # noqa: B023, E731
            assert len(call(part, [None] * 40)) == k - 1
            assert call(part, [7] * 40) == [] == call(part * 0, [None] * 40)
            found = call(part, [7] * 39 + [None] if k == 40 else [7] * 7 + [None] * 33)
            assert found and all(k - 1 in pair for pair in found)


def test_links_of_small_sets_need_little_memory():
    sets = [np.arange(10, dtype=np.uint64), np.arange(1, 11, dtype=np.uint64)]
    tracemalloc.start()
    try:
        assert ngram_join.links(sets, 80, np.ones(2, bool)) == [(0, 1)]
        assert tracemalloc.get_traced_memory()[1] < 1 << 20
    finally:
        tracemalloc.stop()

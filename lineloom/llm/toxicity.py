"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, strips accents, replaces look-alike letters of other scripts and digits or signs that stand for
letters, and turns everything else into blanks. Lexicon entries are whole words of any length and word beginnings with the
lower end of the log-odds of their document frequencies in labelled rows; one automaton finds all of them in one pass. A
hit inside an exception phrase doesn't count: the given ones, and pairs of a lexicon word and its neighbour whose own
log-odds are below nothing even at their upper end. The weights of a document's hits, each word counted once by its heaviest entry, are normalised by
length, and a logistic curve fitted on labelled rows that the lexicon hasn't seen turns them into a score.

Fitting reads a bounded sample of the labelled rows (LEXICON_ROWS and CURVE_ROWS, by hash order), which bounds the lexicon
too; scoring reads all rows.

Defined results: null and empty texts have no hits and get the curve's value for none; rows with a null label aren't
learned from; without labelled rows the lexicon is empty and every score is the default prior; other columns are
ignored; repeated rows get the same score.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_rows, bucket, table, text_or_empty

LEXICON_ROWS = 12_000
CURVE_ROWS = 4_000
MIN_DOCS = 4
DOUBTS, LEAST_WEIGHT = 1.5, 0.5
#: Toxic documents of an entry to others: rarer ones are words of the language.
LEAST_SHARE = 0.5
#: Letters of a word beginning.
SHORTEST, LONGEST = 4, 12
THRESHOLD = 0.3
PRIOR = 0.05

# Look-alike letters and signs -> the letter they stand for.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "і": "i", "ї": "i", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ј": "j", "ԁ": "d", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b",
}

# Signs that stand for a letter inside a word.
SIGNS = {"@": "a", "$": "s", "!": "i", "€": "e", "+": "t"}

# Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("clown fish", "clownfish", "trash can", "trash bin", "idiot proof", "sore loser rule", "pond scum")


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        plain = "".join(LOOK_ALIKES.get(x, x) for x in plain.lower())
        if unicodedata.combining(chr(code)) or unicodedata.category(chr(code)) == "Cf":
            out = ""
        else:
            out = plain if plain and all(map(str.isalnum, plain)) else " "
        if len(self) < 100_000:
            self[code] = out
        return out


_table = _Fold()
_inside = re.compile(r"(?<=\w)[@$!€+](?=\w)")


def fold(text: str) -> str:
    """Folded text with a blank at both ends. A sign stands for a letter only between letters or digits."""
    if any(x in text for x in SIGNS):
        text = _inside.sub(lambda m: SIGNS[m[0]], text)
    return f" {text.translate(_table)} "


def entries_of(folded: str) -> set[str]:
    """The whole words of a text, ' word ', and their beginnings, ' wor'."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(SHORTEST, min(len(w), LONGEST + 1)))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, ...] = (log(PRIOR / (1 - PRIOR)), 0.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            shown = fold(phrase)
            found.add_word(f" {' '.join(shown.split())} ", (len(" ".join(shown.split())) + 2, None))
        found.make_automaton()
        return found


def features(folded: str, automaton) -> tuple[float, float, float]:
    """Heaviest hit; summed weight over the root of the length in words; words hit, by the length.

    A word counts once however often it stands in the text."""
    best: dict[int, float] = {}
    safe: list[tuple[int, int]] = []
    if len(automaton):
        for end, (n, weight) in automaton.iter(folded):
            start = end - n + 1
            if weight is None:
                safe.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
    if safe and best:
        # in order of their starts, one sweep over the hits
        reach, left, kept = -1, sorted(safe, reverse=True), {}
        for k in sorted(best):
            while left and left[-1][0] <= k:
                reach = max(reach, left.pop()[1])
            if k >= reach:
                kept[k] = best[k]
        best = kept
    if not best:
        return 0.0, 0.0, 0.0
    once: dict[str, float] = {}
    for start, weight in best.items():
        word = folded[start + 1 : folded.find(" ", start + 1)]
        once[word] = max(weight, once.get(word, 0.0))
    words = len(folded.split())
    return max(once.values()), sum(once.values()) / words**0.5, len(once) / words


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Newton's method on a few features."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (y - p) - ridge * np.array([0, *w[1:]]))
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _labelled(docs: DataFrame, labels: DataFrame, folds: list[int], rows: int) -> DataFrame:
    """At most `rows` labelled documents of these folds."""
    picked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & bucket("doc_id", 4).isin(folds))
    picked = picked.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # bounded by `rows`, so safe to broadcast
    joined = docs.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(picked), "doc_id")
    return joined.select("text", F.col("toxic").cast("int").alias("toxic"))


def phrases_of(folded: str, automaton) -> set[str]:
    """The pairs of a word with a hit and the word before or after it."""
    starts = {end - n + 1 for end, (n, weight) in automaton.iter(folded) if weight is not None} if len(automaton) else set()
    out = set()
    for k in starts:
        after = folded.find(" ", k + 1)
        before = folded.rfind(" ", 0, k)
        if before >= 0 and k - before > 1:
            out.add(folded[before : after + 1])
        if (end := folded.find(" ", after + 1)) > after + 1:
            out.add(folded[k : end + 1])
    return out


def _odds(counts: DataFrame, side: int) -> DataFrame:
    """counts(entry, pos, neg), with a row '' for all documents -> (entry, odds), the log-odds moved by DOUBTS deviations;
    of entries in MIN_DOCS documents of either kind."""
    # one row
    every = F.broadcast(counts.filter("entry = ''").select(F.col("pos").alias("_p"), F.col("neg").alias("_n")))
    odds = F.log((F.col("pos") + 0.2) / (F.col("_p") + 1)) - F.log((F.col("neg") + 0.2) / (F.col("_n") + 1))
    doubt = F.sqrt(1 / (F.col("pos") + 0.2) + 1 / (F.col("neg") + 1))
    rows = counts.filter((F.col("entry") != "") & (F.greatest("pos", "neg") >= MIN_DOCS)).crossJoin(every)
    return rows.select("entry", "pos", "neg", (odds + side * DOUBTS * doubt).alias("odds"))


def fit(docs: DataFrame, labels: DataFrame, lexicon_rows: int = LEXICON_ROWS, curve_rows: int = CURVE_ROWS, exceptions: Iterable[str] = EXCEPTIONS) -> Lexicon:
    """Lexicon and its exceptions from folds 0 and 1 of the labelled rows, curve from fold 3; fold 2 is never read."""
    spark = docs.sparkSession
    batch_rows(spark)

    def counted(entries) -> DataFrame:
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            of = entries()
            for batch in batches:
                seen: tuple[Counter, Counter] = (Counter(), Counter())
                for text, toxic in zip(batch["text"], batch["toxic"]):
                    seen[1 if toxic else 0].update(of(fold(text)))
                yield pd.DataFrame([(k, n, seen[0][k]) for k, n in seen[1].items()] + [(k, 0, n) for k, n in seen[0].items() if k not in seen[1]], columns=["entry", "pos", "neg"])
                yield pd.DataFrame([("", sum(map(bool, batch["toxic"])), len(batch) - sum(map(bool, batch["toxic"])))], columns=["entry", "pos", "neg"])

        train = _labelled(docs, labels, [0, 1], lexicon_rows)
        return train.mapInPandas(count, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))

    # the lower end of the log-odds, so that chance finds among many candidates weigh little or nothing; what is collected
    # is bounded by the sampled rows
    found = _odds(counted(lambda: entries_of), -1).filter((F.col("pos") >= MIN_DOCS) & (F.col("pos") >= LEAST_SHARE * F.col("neg")) & (F.col("odds") > LEAST_WEIGHT)).collect()
    lexicon = Lexicon({r["entry"]: round(r["odds"], 4) for r in sorted(found, key=lambda r: r["entry"])}, tuple(exceptions))
    if not found:
        return lexicon

    def phrases():
        automaton = lexicon.automaton()
        return lambda folded: phrases_of(folded, automaton)

    harmless = _odds(counted(phrases), 1).filter((F.col("neg") >= MIN_DOCS) & (F.col("odds") < 0)).select("entry").collect()  # bounded likewise
    lexicon.exceptions += tuple(sorted(r["entry"].strip() for r in harmless))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for batch in batches:
            rows = [(*features(fold(t), automaton), int(y)) for t, y in zip(batch["text"], batch["toxic"])]
            yield pd.DataFrame(rows, columns=["a", "b", "c", "toxic"])

    found = _labelled(docs, labels, [3], curve_rows).mapInPandas(measure, "a double, b double, c double, toxic int").collect()  # bounded by `curve_rows`
    if found and len({r["toxic"] for r in found}) == 2:
        data = np.array(sorted((r["a"], r["b"], r["c"], r["toxic"]) for r in found), dtype=float)
        lexicon.curve = tuple(float(x) for x in _logistic(data[:, :3], data[:, 3]))
    return lexicon


def scorer(spark: SparkSession, lexicon: Lexicon):
    """A column function text -> score from 0 to 1."""
    batch_rows(spark)
    built: dict = {}

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = built.get("a") or lexicon.automaton()
        w = np.array(lexicon.curve)
        for part in texts:
            x = np.array([(1.0, *features(fold(t), automaton)) for t in part]).reshape(-1, 4)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))

    return lambda col: score(text_or_empty(col))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = scorer(spark, fit(docs, table(spark, sf_dir, "labels")))
    rows = docs.select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

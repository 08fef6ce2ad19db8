"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. A rule that fails sets its bit in `fail_bits`; the measurements behind the
rules are stored beside it. Policies are versioned sets of rules, applied afterwards by one bitwise AND, so a new
policy or an ablation never reads the texts again.

Defined results: a null text counts as the empty text (no words, so it fails); repeated rows are rows of their own;
other columns of the input are ignored whatever their names; an empty table gives an empty ledger.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, table, text_or_empty

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_letters long, n_upper long, n_bare_words long, longest_word long"
)


def _repeated(words: list[bytes], width: int = 5) -> int:
    """Words in windows of `width` words that are found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    first: dict[tuple[bytes, ...], int] = {}
    marked = bytearray(len(words))
    ones = b"\1" * width
    hit = False
    for i, w in enumerate(zip(*(words[k:] for k in range(width)))):
        j = first.setdefault(w, i)
        if j != i:
            marked[i : i + width] = marked[j : j + width] = ones
            hit = True
    return sum(marked) if hit else 0


UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
NOT_LEADING = bytes(range(192))
PUNCTUATION = string.punctuation.encode()


def measure(text: str) -> tuple[int, ...]:
    """n_letters counts ASCII letters and all code points beyond ASCII; n_upper ASCII capitals."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # splits at exactly the six ASCII white-space characters
    blanks = sum(text.count(c) for c in SPACES)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    letters = len(raw) - len(raw.translate(None, LETTERS)) + len(raw.translate(None, NOT_LEADING))
    return (
        len(words), len(text) - blanks, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), _repeated(words),
        len(lines), letters, len(raw) - len(raw.translate(None, UPPER)), sum(not w.translate(None, PUNCTUATION) for w in words), max(map(len, words), default=0),
    )


#: Rule number (its bit) -> name and the SQL predicate that is true where the rule fails. Numbers are never reused.
RULES: dict[int, tuple[str, str]] = {
    0: ("few_words", "n_words < 10"),
    1: ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    2: ("symbols", "10 * n_symbols > 3 * n_words AND 20 * n_symbols > word_chars"),
    3: ("duplicate_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    4: ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    5: ("letters", "2 * n_letters < word_chars"),
    6: ("shouting", "n_letters >= 40 AND 10 * n_upper > 6 * n_letters"),
    7: ("bare_marks", "n_words >= 10 AND 10 * n_bare_words > 3 * n_words"),
    8: ("giant_word", "longest_word > 1000"),
}
BASE_RULES = (0, 1)

#: Version -> rules that reject. The latest is the default.
POLICIES: dict[str, tuple[int, ...]] = {
    "v1": (0, 1, 2, 3),
    "v2": (0, 1, 2, 3, 4, 5, 6, 7, 8),
}


def mask(rules: tuple[int, ...]) -> int:
    return sum(1 << r for r in rules)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, all measurements and the bits of the rules that it fails."""
    batch_rows(docs.sparkSession)
    columns = [x.split()[0] for x in MEASURES.split(", ")]

    @F.pandas_udf(MEASURES)
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(x) for x in texts], columns=columns, dtype="int64")

    rows = docs.select(F.col(id_col).alias(id_col), text_or_empty(text_col).alias("_text")).withColumn("_m", measured("_text"))
    out = rows.select(id_col, "_m.*")
    bits = sum((F.when(F.expr(sql), 1 << r).otherwise(0) for r, (_, sql) in RULES.items()), F.lit(0))
    return out.withColumn("fail_bits", bits.cast("long"))


def passes(policy: str = "v2", bits: str | Column = "fail_bits") -> Column:
    col = F.col(bits) if isinstance(bits, str) else bits
    return col.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablations(led: DataFrame) -> DataFrame:
    """Per policy and rule: documents that fail the rule, and documents kept if only that rule were dropped.

    The ledger first shrinks to a count per distinct bitmask, at most 2^rules rows however many documents there are.
    """
    counts = led.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    plan = [(p, r, RULES[r][0], mask(rules), 1 << r) for p, rules in POLICIES.items() for r in rules]
    rules = led.sparkSession.createDataFrame(plan, "policy string, rule int, rule_name string, mask long, bit long")
    failing = counts.crossJoin(F.broadcast(rules))  # distinct bitmasks x rules: both are bounded by the rule table
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return (
        failing.groupBy("policy", "rule", "rule_name")
        .agg(
            F.sum("n").alias("n_docs"),
            F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
            F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failing_rule"),
            F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this_rule"),
        )
    )


def together(led: DataFrame, by: Iterator[str] | list[str]) -> DataFrame:
    """Per group: rules that any document fails and rules that all fail, by bitwise aggregation."""
    return led.groupBy(*by).agg(F.bit_or("fail_bits").alias("any_bits"), F.bit_and("fail_bits").alias("all_bits"), F.count(F.lit(1)).alias("n_docs"))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    led = ledger(table(spark, sf_dir, "documents"))
    base = led.withColumn("base_failed", ~passes_base())
    return base.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & passes()).alias("kept"), "fail_bits",
    )


def passes_base() -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(BASE_RULES)).cast("long")) == 0

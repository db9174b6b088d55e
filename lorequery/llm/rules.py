"""Quality rules as a bitmask ledger.

Every rule is evaluated once per text. The ledger keeps the measurements and one
failure bit per rule; policies are versioned masks over those bits, so that
changing a policy, or asking what a rule alone costs, never reads a text again.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorequery.llm.common import WORD, free_name, materialize_texts

_WORD = re.compile(WORD)
_LETTER = re.compile(r"[^\W\d_]")
_SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words"]

Measure = Callable[[str], Column]

#: Failing conditions in the order of their bits. Only ever append: stored bits keep their meaning.
RULES: dict[str, Callable[[Measure], Column]] = {
    "few_words": lambda m: m("n_words") < 50,
    "repeated_phrases": lambda m: 100 * m("n_repeat_words") > 50 * m("n_words"),
    "many_symbols": lambda m: 10 * m("n_symbols") > 2 * m("n_words"),
    "duplicate_lines": lambda m: 10 * m("n_dup_lines") > 5 * m("n_lines"),
    "short_or_long_words": lambda m: ~m("word_chars").between(2 * m("n_words"), 20 * m("n_words")),
    "few_letter_words": lambda m: 10 * m("n_letter_words") < 6 * m("n_words"),
}
#: Versions of the policy, each a set of rules; every one holds the two base rules.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_phrases"],
    "v1": list(RULES),
}
BASE, CURRENT = "base", "v1"


def mask_of(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def _repeat_words(words: list[str]) -> int:
    """Words inside a three-word window that is found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    _, pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)
    _, windows, counts = np.unique(
        pairs[:-1] * np.int64(len(known)) + ids[2:], return_inverse=True, return_counts=True
    )
    again = counts[windows] >= 2
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift : shift + n - 2] |= again
    return int(covered.sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``; all 0 for null."""
    text = text or ""
    words = _WORD.findall(text)
    lines = [line for line in text.split("\n") if line.strip(_SPACE)]
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in _SYMBOLS),
        len(lines),
        len(lines) - len(set(lines)),
        _repeat_words(words),
        sum(1 for w in words if _LETTER.search(w)),
    )


_MEASURED = T.StructType([T.StructField(name, T.LongType()) for name in MEASURES])


@F.pandas_udf(_MEASURED)
def _measure(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure_text(t) for t in texts], columns=MEASURES, dtype="int64")


def failed_bits(measure: Measure = F.col) -> Column:
    """Bit i is set where rule i fails."""
    bits = F.lit(0).cast("long")
    for i, fails in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(fails(measure), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the measurements and ``failed_bits``, as a written table.

    Null and empty texts have all measurements 0, which fails ``few_words``. Rows are
    never joined, so repeated ids stay repeated; other columns are not read.
    """
    measured = docs.select(F.col(id_col), _measure(F.col(text_col)).alias("m"))
    ledger = measured.select(id_col, *[F.col(f"m.{name}").alias(name) for name in MEASURES])
    return materialize_texts(ledger.withColumn("failed_bits", failed_bits()), "ledger")


def passes(policy: str, bits: Column | None = None) -> Column:
    bits = F.col("failed_bits") if bits is None else bits
    return bits.bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0


def keep_passing(docs: DataFrame, policy: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text passes the policy, with the same columns, as a written table."""
    name = free_name(docs, "measured")
    marked = docs.withColumn(name, _measure(F.col(text_col)))
    bits = failed_bits(lambda measure: F.col(f"{name}.{measure}"))
    return materialize_texts(marked.filter(passes(policy, bits)).drop(name), "passing")


def ablation(ledger: DataFrame, policy: str = CURRENT) -> DataFrame:
    """What each rule of the policy does: ``rule, n_failed, n_only, n_kept, n_kept_without``.

    The ledger is aggregated to one row per bit pattern first, so that the rest
    works on at most 2^rules rows. An empty ledger gives no rows.
    """
    names = list(RULES)
    patterns = ledger.groupBy(
        F.col("failed_bits").bitwiseAND(F.lit(mask_of(policy)).cast("long")).alias("bits")
    ).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(
        *[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]]
    )
    per_rule = patterns.select("bits", "n", F.inline(rules))

    def count_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")

    others = F.expr("bits & ~bit")
    return per_rule.groupBy("rule").agg(
        count_where(F.expr("(bits & bit) != 0")).alias("n_failed"),
        count_where(F.col("bits") == F.col("bit")).alias("n_only"),
        count_where(F.col("bits") == 0).alias("n_kept"),
        count_where(others == 0).alias("n_kept_without"),
    )

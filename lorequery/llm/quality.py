"""Quality scores from histogram gradient-boosted trees over document statistics.

The statistics of every document are computed where it is read. Trees are grown in numpy
on a bounded sample of labelled rows and flattened into arrays, one row of nodes per tree,
which a batch of documents walks level by level.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequery.llm.common import WORD, held_out, materialize_texts
from lorequery.llm.rules import measure_text

#: Expected bound of the labelled rows that a model is fitted on.
SAMPLE_ROWS = 40_000
BINS = 64
DEPTH = 4
ROUNDS = 80
RATE = 0.15
MIN_ROWS = 10
PENALTY = 1.0

_WORD = re.compile(WORD)
_FINE = 1 << 30
_KINDS = {
    "upper": re.compile(r"[A-Z]"),
    "digit": re.compile(r"[0-9]"),
    "stop": re.compile(r"[.!?]"),
    "comma": re.compile(r"[,;:]"),
    "quote": re.compile(r"[\"'()\[\]{}=_/\\@]"),
}
STATISTICS = [
    "words", "word_length", "symbols", "lines", "duplicate_lines", "repeated", "letter_words",
    *_KINDS, "distinct_words", "top_word", "doubled_words", "bang", "bar", "line_words", "not_ascii",
]


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text; shares are per word or character, all 0 for empty ones."""
    text = text or ""
    n_words, word_chars, symbols, lines, doubles, repeated, letters = measure_text(text)
    n, chars, m = max(1, n_words), max(1, len(text)), max(1, lines)
    words = _WORD.findall(text)
    counts = Counter(words)
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False))
    kinds = [(len(text) - len(pattern.sub("", text))) / chars for pattern in _KINDS.values()]
    return [
        np.log1p(n_words), word_chars / n, symbols / n, np.log1p(lines), doubles / m, repeated / n, letters / n,
        *kinds, len(counts) / n, max(counts.values(), default=0) / n, doubled / n, text.count("!") / n,
        text.count("|") / n, n_words / m, (len(text.encode("utf-8", "surrogatepass")) - len(text)) / chars,
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table ``id, held_out, statistics`` with one row per document."""

    def compute(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [np.asarray(statistics(t), dtype=np.float32) for t in part["text"]]
            yield pd.DataFrame({"id": part["id"], "held_out": part["held_out"], "statistics": rows})

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(
        F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")
    )
    computed = rows.mapInPandas(compute, f"id {kind}, held_out boolean, statistics array<float>")
    return materialize_texts(computed, "statistics")


@dataclass
class BoostedTrees:
    """Complete trees in arrays: node i of a tree has the children 2i + 1 and 2i + 2."""

    base: float
    features: np.ndarray  # trees x inner nodes
    cuts: np.ndarray  # trees x inner nodes; values above go right
    leaves: np.ndarray  # trees x leaves

    def score(self, rows: np.ndarray) -> np.ndarray:
        raw = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        for features, cuts, leaves in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[every, features[node]] > cuts[node])
            raw += leaves[node - (len(features))]
        return 1 / (1 + np.exp(-raw))


def fit_trees(rows: np.ndarray, labels: np.ndarray) -> BoostedTrees:
    """Logistic loss, second-order gains over histograms of binned statistics.

    Without labels, or with one class only, the score is the smoothed share of label 1.
    """
    share = (labels.sum() + 1) / (len(labels) + 2)
    base = float(np.log(share / (1 - share)))
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    if len(np.unique(labels)) < 2:
        return BoostedTrees(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(e, rows[:, f]) for f, e in enumerate(edges)], axis=1)
    raw = np.full(len(rows), base)
    features = np.zeros((ROUNDS, inner), dtype=np.int64)
    cuts = np.full((ROUNDS, inner), np.inf)
    values = np.zeros((ROUNDS, leaves))
    for tree in range(ROUNDS):
        p = 1 / (1 + np.exp(-raw))
        slope, curve = p - labels, p * (1 - p)
        node = np.zeros(len(rows), dtype=np.int64)
        for level in range(DEPTH):
            first, width = (1 << level) - 1, 1 << level
            best = np.zeros(width)
            for f, own in enumerate(edges):
                if not len(own):
                    continue
                at = (node - first) * (BINS + 1) + binned[:, f]
                shape = (width, BINS + 1)
                g, h, n = (
                    np.bincount(at, w, width * (BINS + 1)).reshape(shape).cumsum(axis=1)
                    for w in (slope, curve, np.ones(len(rows)))
                )
                g_all, h_all, n_all = g[:, -1:], h[:, -1:], n[:, -1:]
                gain = g**2 / (h + PENALTY) + (g_all - g) ** 2 / (h_all - h + PENALTY) - g_all**2 / (h_all + PENALTY)
                gain[(n < MIN_ROWS) | (n_all - n < MIN_ROWS)] = 0
                gain = gain[:, : len(own)]
                top = gain.argmax(axis=1)
                better = gain[np.arange(width), top] > best + 1e-9
                where = first + np.flatnonzero(better)
                best[better] = gain[np.arange(width), top][better]
                features[tree, where], cuts[tree, where] = f, own[top[better]]
            node = 2 * node + 1 + (rows[np.arange(len(rows)), features[tree, node]] > cuts[tree, node])
        leaf = node - inner
        g, h = np.bincount(leaf, slope, leaves), np.bincount(leaf, curve, leaves)
        values[tree] = -RATE * g / (h + PENALTY)
        raw += values[tree, leaf]
    return BoostedTrees(base, features, cuts, values)


def fit(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> BoostedTrees:
    """Fit on the statistics of labelled rows outside the held-out fold.

    Null labels and ids are left out. A row is in the sample by the hash of its id, at a rate that gives
    ``SAMPLE_ROWS`` rows.
    """
    known = labels.filter(F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")
    )
    known = known.filter(F.col("id").isNotNull() & ~held_out("id"))
    n = known.count()
    rate = _FINE if n <= SAMPLE_ROWS else int(_FINE * SAMPLE_ROWS / n)
    chosen = known.filter(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(_FINE)) < rate)
    found = table.join(chosen, "id").select("id", "statistics", "label").orderBy("id", "label").collect()
    rows = np.array([r["statistics"] for r in found], dtype=np.float64).reshape(-1, len(STATISTICS))
    # as the scorer sees them
    return fit_trees(rows.astype(np.float32).astype(np.float64), np.array([r["label"] for r in found], dtype=float))


def score(table: DataFrame, model: BoostedTrees, id_col: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """``id, held_out, score, predicted`` for every row of the statistics; empty texts are scored too."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = np.stack(part["statistics"].to_numpy()).astype(np.float64) if len(part) else np.zeros((0, 1))
            scores = shared.value.score(rows)
            yield pd.DataFrame(
                {
                    "id": part["id"],
                    "held_out": part["held_out"],
                    "score": scores,
                    "predicted": (scores >= threshold).astype(np.int32),
                }
            )

    kind = dict(table.dtypes)["id"]
    scored = table.mapInPandas(judge, f"id {kind}, held_out boolean, score double, predicted int")
    return scored.withColumnRenamed("id", id_col)

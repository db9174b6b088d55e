"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed character n-grams; a softmax over
a linear map of that mean names the language. Both are learned together by
stochastic gradient descent on a bounded sample. A temperature is then fitted
on rows that the descent did not see, and with it the confidence under which a
prediction is rejected. As everything up to the softmax is linear, embeddings and
map fold into one table of logits per bucket for prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequery.llm.common import held_out, materialize_texts

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
DIMS = 16
#: Bound of the training sample: expected rows per language, and languages (the most frequent).
ROWS_PER_LANG = 500
MAX_LANGS = 256
#: Accepted predictions are to be right in this share of the calibration rows.
PRECISION = 0.995
UNKNOWN = "und"

_SLICE = 1 << 18
_FINE = 1 << 30


def subword_counts(text: str) -> np.ndarray:
    """Counts of the hashed character n-grams of the whole lower-cased text, slice by slice."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    text = text.lower()
    for at in range(0, len(text), _SLICE):
        # a slice reaches into the next one by the longest n-gram less one
        piece = text[at : at + _SLICE + ORDERS[-1] - 1]
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        starts = min(_SLICE, len(text) - at)
        rolling = np.zeros(len(codes), dtype=np.uint64)
        for order in range(1, ORDERS[-1] + 1):
            n = len(codes) - order + 1
            if n <= 0:
                break
            rolling = rolling[:n] * np.uint64(1_000_003) + codes[order - 1 :]
            if order in ORDERS:
                mixed = (rolling[: min(n, starts)] + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
                counts += np.bincount((mixed >> np.uint64(64 - 14)).astype(np.int64), minlength=BUCKETS)
    return counts


@dataclass
class LanguageModel:
    langs: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        raw = (counts @ self.logits / max(1, counts.sum()) + self.bias) / self.temperature
        raw = np.exp(raw - raw.max())
        return raw / raw.sum()


def _softmax(raw: np.ndarray) -> np.ndarray:
    raw = np.exp(raw - raw.max(axis=-1, keepdims=True))
    return raw / raw.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 1.0) -> LanguageModel:
    """Fit on ``(lang, buckets, counts)``; every fifth row is kept for the calibration."""
    langs = sorted({lang for lang, _, _ in rows}) or [UNKNOWN]
    rng = np.random.default_rng(7)
    embed = rng.normal(0, 1 / DIMS, (BUCKETS, DIMS))
    out, bias = np.zeros((DIMS, len(langs))), np.zeros(len(langs))
    examples = [(langs.index(lang), at, n / n.sum()) for lang, at, n in rows if len(at)]
    rng.shuffle(examples)
    held = examples[::5] if len(examples) >= 10 * len(langs) else examples
    fitted = [e for i, e in enumerate(examples) if i % 5] if held is not examples else examples
    steps = max(1, epochs * len(fitted))
    for step in range(epochs * len(fitted)):
        label, at, share = fitted[step % len(fitted)]
        mean = share @ embed[at]
        slope = _softmax(mean @ out + bias)
        slope[label] -= 1
        now = rate * (1 - step / steps)
        back = out @ slope
        out -= now * np.outer(mean, slope)
        bias -= 0.1 * now * slope
        # the mean spreads a step over many buckets, so each takes a larger one
        embed[at] -= 20 * now * np.outer(share, back)
    logits = embed @ out
    raw = np.array([share @ logits[at] + bias for _, at, share in held]).reshape(-1, len(langs))
    labels = np.array([label for label, _, _ in held], dtype=int)
    temperature, threshold = 1.0, 0.0
    if len(labels):
        grid = np.geomspace(0.05, 20, 60)
        losses = [-np.log(_softmax(raw / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
        temperature = float(grid[int(np.argmin(losses))])
        probabilities = _softmax(raw / temperature)
        sure, right = probabilities.max(axis=1), probabilities.argmax(axis=1) == labels
        order = np.argsort(-sure)
        precise = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION
        threshold = float(sure[order][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0
    return LanguageModel(langs, logits, bias, temperature, threshold)


def sample(docs: DataFrame, lang_col: str, id_col: str, text_col: str) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Subword counts of a bounded sample of the rows that may be learned from.

    A row is in by the hash of its id, at a rate by language that gives
    ``ROWS_PER_LANG`` rows; the texts themselves stay where they are.
    """
    learnable = docs.filter(F.col(lang_col).isNotNull() & ~held_out(id_col))
    sizes = learnable.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(MAX_LANGS).collect()
    if not sizes:
        return []
    rates = {r[lang_col]: min(_FINE, int(_FINE * ROWS_PER_LANG / r["count"]) + 1) for r in sizes}
    limit = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])
    chosen = learnable.filter(
        F.col(text_col).isNotNull()
        & (F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(_FINE)) < F.element_at(limit, F.col(lang_col)))
    ).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [subword_counts(text) for text in part["text"]]
            at = [np.flatnonzero(c) for c in found]
            yield pd.DataFrame(
                {
                    "lang": part["lang"],
                    "at": [a.astype("<u2").tobytes() for a in at],
                    "n": [c[a].astype("<u4").tobytes() for a, c in zip(at, found, strict=True)],
                }
            )

    rows = materialize_texts(chosen.mapInPandas(count, "lang string, at binary, n binary"), "lang-sample")
    return [
        (r["lang"], np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<u4").astype(float))
        for r in rows.orderBy("lang", "at", "n").collect()
    ]


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> LanguageModel:
    return train(sample(docs, lang_col, id_col, text_col))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, lang_pred, score, accepted`` of every row, from its whole text alone.

    Null texts and texts without a letter are ``und`` with score 0. Ties go to the first
    language by name. ``accepted`` is false under the calibrated confidence.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for part in parts:
            langs, scores = [], []
            for text, letters in zip(part["text"], part["letters"], strict=True):
                if not letters:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = own.probabilities(subword_counts(text))
                langs.append(own.langs[int(p.argmax())])
                scores.append(float(min(1.0, p.max())))
            sure = [s > 0 and s >= own.threshold for s in scores]
            yield pd.DataFrame(
                {"id": part["id"], "held_out": part["held_out"], "lang_pred": langs, "score": scores, "accepted": sure}
            )

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(
        F.col(id_col).alias("id"),
        held_out(id_col).alias("held_out"),
        F.col(text_col).alias("text"),
        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    schema = f"id {kind}, held_out boolean, lang_pred string, score double, accepted boolean"
    return materialize_texts(rows.mapInPandas(judge, schema), "languages").withColumnRenamed("id", id_col)

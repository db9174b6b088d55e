"""Straightforward single-node versions that the Spark operators are compared with."""

import math
from collections import Counter


def bm25(documents, questions, k):
    """documents: {pos: text}, questions: {id: text} -> {(id, rank, pos, score)}."""
    words = {p: t.split() for p, t in documents.items()}
    n = len(words)
    mean = sum(map(len, words.values())) / n
    df = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf) if idf else 0.0
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    out = set()
    for qid, question in questions.items():
        scores = []
        for pos, ws in words.items():
            tf, s = Counter(ws), 0.0
            for w in question.split():
                if tf[w]:
                    s += idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean))
            scores.append((round(s, 6) + 0.0, pos))
        scores.sort(reverse=True)
        out |= {(qid, r, pos, s) for r, (s, pos) in enumerate(scores[:k], 1)}
    return out


def nearest(vectors, questions, k):
    """vectors: {pos: list}, questions: {id: list} -> {(id, rank, pos, score)}."""
    out = set()
    for qid, q in questions.items():
        scored = sorted((round(sum((float(a) - float(b)) ** 2 for a, b in zip(q, v)), 6), pos) for pos, v in vectors.items())
        out |= {(qid, r, pos, s) for r, (s, pos) in enumerate(scored[:k], 1)}
    return out

"""Encoding into pieces of a SentencePiece vocabulary by streaming Viterbi, and decoding.

The scores of a unigram vocabulary are log-probabilities: the ids of a text are the segmentation
with the largest sum. Those of a merge vocabulary are ranks, and no sum of them means anything:
the ids are what merging the best-ranked neighbours, the leftmost of equals, leaves in the end. A
segmentation is that one exactly if merging any two neighbouring pieces on their own gives these two
pieces, so the search allows only such neighbours, and one path leads to each position.

Either way the text is read once and only the last few positions are kept: as soon as the back
pointers of all positions that a later piece can start from meet in one boundary, everything
before it is settled and its ids are committed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from lorequery.llm.common import materialize_texts

MARK = "▁"
#: Words whose ids a worker remembers, and the longest of them; as many pairs of neighbours.
REMEMBERED, REMEMBERED_CHARS = 500_000, 32
#: A character without a piece costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0
_NEVER = float("-inf")
#: Positions between two looks for a common boundary, in lengths of the longest piece.
_LOOK = 4


class PieceVocabulary:
    """Pieces, scores and byte pieces of a model file; ``encode`` and ``decode`` on one text.

    ``ranked`` tells that scores are merge ranks; by default they are if all are whole numbers.
    """

    def __init__(self, model_path: str, ranked: bool | None = None) -> None:
        model = SentencePieceProcessor(model_file=model_path)
        self.names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes: dict[int, int] = {}
        self.scores: dict[str, tuple[float, int]] = {}
        for i, name in enumerate(self.names):
            if model.is_byte(i):
                self.bytes[int(name[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.scores[name] = (model.get_score(i), i)
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.ranked = all(score == int(score) for score, _ in self.scores.values()) if ranked is None else ranked
        self.ranks = {name: score for name, (score, _) in self.scores.items()}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.scores))
        self.penalty = min(score for score, _ in self.scores.values()) - UNKNOWN_PENALTY
        # no piece goes on with a mark after another character: a word is then a stretch of its own
        self.splits = not any(MARK in name.lstrip(MARK) for name in self.scores)
        self.prefixes = {name[:n] for name in self.scores for n in range(1, len(name) + 1)}
        # a node: those one character further, and the piece that ends here; a character is a symbol of its own
        self.tree: dict[str, tuple[dict, str | None]] = {}
        for name in sorted(self.scores, key=len):
            nodes = self.tree
            for n in range(1, len(name)):
                nodes = nodes.setdefault(name[n - 1], ({}, name[0] if n == 1 else None))[0]
            nodes[name[-1]] = ({}, name)
        self.surfaces = [name.replace(MARK, " ") for name in self.names]
        self.byte_ids = set(self.byte_of)
        self.known: dict[str, tuple[int, ...]] = {}

    def _spell(self, char: str) -> list[int]:
        """A character without a piece: its bytes, or the unknown id where there are no byte pieces."""
        if len(self.bytes) < 256:
            return [self.unknown]
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]

    def _merged(self, text: str) -> list[str]:
        """What merging leaves of a short text: each time the best pair, the leftmost of equals."""
        score, symbols = self.ranks.get, list(text)
        ranks = [score(a + b, _NEVER) for a, b in zip(symbols, symbols[1:])]
        while ranks and (best := max(ranks)) > _NEVER:
            at = ranks.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = score(symbols[at - 1] + symbols[at], _NEVER)
            if at < len(ranks):
                ranks[at] = score(symbols[at] + symbols[at + 1], _NEVER)
        return symbols

    def _learn(self, before: str, piece: str) -> bool:
        """Find out and remember whether merging leaves ``before`` and ``piece`` side by side.

        Nothing is before the first piece of a text.
        """
        if self.n_pairs >= REMEMBERED:
            self.pairs.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        meet = self._merged(before + piece) == ([before, piece] if before else [piece])
        self.pairs.setdefault(before, {})[piece] = meet
        return meet

    def _neighbours(self, text: str) -> Iterator[list[int]]:
        """``viterbi`` over merge ranks: the window holds the one piece that the path to each position ends with."""
        tree, pairs, nothing = self.tree, self.pairs, {}
        size, longest, look = len(text), self.longest, _LOOK * self.longest
        first = 0  # position of last[0]; everything before it is committed
        last: list[str | None] = [None] * (min(size, look + self.longest) + 1)
        last[0] = ""
        for start in range(size):
            if start - first >= look:
                fronts = {first + i for i in range(start - first, len(last)) if last[i] is not None}
                while len(fronts) > 1:
                    at = max(fronts)
                    fronts.remove(at)
                    fronts.add(max(first, at - len(last[at - first])))
                meet = min(fronts.pop(), start)
                if meet > first:
                    yield self._ids(last, meet - first)
                    last = last[meet - first :] + [None] * (meet - first)
                    first = meet
            before = last[start - first]
            known = pairs.get(before, nothing)
            nodes, to = tree, start - first
            for char in text[start : start + longest]:
                # a character that begins no piece is a symbol too
                node = nodes.get(char) or ((nothing, char) if nodes is tree else None)
                if node is None:
                    break
                nodes, piece = node
                to += 1
                if piece is not None and last[to] is None:
                    meets = known.get(piece)
                    if meets or (meets is None and self._learn(before, piece)):
                        last[to] = piece
        yield self._ids(last, size - first)

    def _ids(self, last: list[str | None], end: int) -> list[int]:
        path = []
        while end > 0:
            path.append(last[end])
            end -= len(last[end])
        scores, out = self.scores, []
        for piece in reversed(path):
            hit = scores.get(piece)
            if hit is not None:
                out.append(hit[1])
            else:
                out += self._spell(piece)
        return out

    def viterbi(self, text: str) -> Iterator[list[int]]:
        """Committed ids of ``text`` in order, run by run."""
        return self._neighbours(text) if self.ranked else self._sums(text)

    def _sums(self, text: str) -> Iterator[list[int]]:
        """``viterbi`` over log-probabilities; equal sums prefer the longer last piece."""
        scores, prefixes, penalty = self.scores, self.prefixes, self.penalty
        size, look = len(text), _LOOK * self.longest
        first = 0  # position of best[0]; everything before it is committed
        # reachable ends are filled ahead of the reading position, so the window is a look plus a piece wide
        best, back, ids = [0.0], [0], [-1]
        start = 0
        while start < size:
            at = start - first
            here = best[at]
            if at + 1 == len(best):
                best.append(_NEVER)
                back.append(0)
                ids.append(-1)
            end = start + 1
            piece = text[start:end]
            if piece not in scores and here + penalty > best[at + 1]:
                best[at + 1], back[at + 1], ids[at + 1] = here + penalty, start, -1
            while piece in prefixes:
                hit = scores.get(piece)
                to = end - first
                while to >= len(best):
                    best.append(_NEVER)
                    back.append(0)
                    ids.append(-1)
                if hit is not None and here + hit[0] > best[to]:
                    best[to], back[to], ids[to] = here + hit[0], start, hit[1]
                if end >= size:
                    break
                end += 1
                piece = text[start:end]
            start += 1
            if start - first >= look:
                meet = self._meeting(first, start, back, best)
                if meet > first:
                    yield self._trace(text, first, meet, back, ids)
                    keep = meet - first
                    best, back, ids, first = best[keep:], back[keep:], ids[keep:], meet
        yield self._trace(text, first, size, back, ids)

    @staticmethod
    def _meeting(first: int, start: int, back: list[int], best: list[float]) -> int:
        """The boundary through which the paths to all positions from ``start`` on lead."""
        fronts = {first + i for i in range(start - first, len(best)) if best[i] > _NEVER}
        while len(fronts) > 1:
            last = max(fronts)
            fronts.remove(last)
            fronts.add(max(first, back[last - first]))
        return min(fronts.pop(), start)

    def _trace(self, text: str, first: int, end: int, back: list[int], ids: list[int]) -> list[int]:
        runs = []
        while end > first:
            own, start = ids[end - first], back[end - first]
            runs.append([own] if own >= 0 else self._spell(text[start:end]))
            end = start
        return [i for run in reversed(runs) for i in run]

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a mark and a word, which no piece reaches out of."""
        runs = list(self.viterbi(MARK + word))
        own = tuple(runs[0]) if len(runs) == 1 else tuple(i for run in runs for i in run)
        if len(word) <= REMEMBERED_CHARS:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = own
        return own

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text; the empty text has none. Spaces become marks, with one more in front."""
        out: list[int] = []
        if not text:
            return out
        text = text.replace(" ", MARK)
        if not self.splits:
            for run in self.viterbi(MARK + text):
                out += run
            return out
        known, marks = self.known.get, 0
        # a mark after another character starts a stretch that no piece reaches into from before
        for word in text.split(MARK):
            if word and not marks:
                out += known(word) or self._word(word)
            elif word:
                for run in self.viterbi(MARK * (marks + 1) + word):
                    out += run
                marks = 0
            else:
                marks += 1
        if marks:
            for run in self.viterbi(MARK * marks):
                out += run
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        if not self.byte_ids.intersection(ids):
            return "".join(map(self.surfaces.__getitem__, ids))[1:]
        out, pending = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            out.append(self.surfaces[i])
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out)[1:]


@lru_cache(maxsize=1)
def vocabulary(model_path: str) -> PieceVocabulary:
    """Loaded once per worker; ``model_path`` is a file that every node has."""
    return PieceVocabulary(model_path)


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` ids with ``ids array<int>``; null and empty texts have none. One row per input row."""

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = vocabulary(model_path)
        for part in parts:
            ids = [np.array(own.encode(t or ""), dtype=np.int32) for t in part["text"]]
            yield pd.DataFrame({"id": part["id"], "ids": ids})

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(encode, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, text`` of encoded rows; null ids give the empty text."""

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = vocabulary(model_path)
        for part in parts:
            texts = [own.decode([] if ids is None else list(ids)) for ids in part["ids"]]
            yield pd.DataFrame({"id": part["id"], "text": texts})

    kind = dict(encoded.dtypes)[id_col]
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInPandas(decode, f"id {kind}, text string").withColumnRenamed("id", id_col)


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_ids, ids_crc32, round_trip`` per row: what encoding and decoding the whole text gives.

    The crc is over little-endian 32-bit ids; ``round_trip`` is true where decoding gives the text back,
    null counting as empty.
    """

    def digest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = vocabulary(model_path)
        for part in parts:
            rows = []
            for text in part["text"]:
                ids = own.encode(text or "")
                crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
                rows.append((len(ids), crc, own.decode(ids) == (text or "")))
            out = pd.DataFrame(rows, columns=["n_ids", "ids_crc32", "round_trip"])
            out.insert(0, "id", part["id"].to_numpy())
            yield out

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, n_ids long, ids_crc32 long, round_trip boolean"
    return materialize_texts(rows.mapInPandas(digest, schema), "pieces").withColumnRenamed("id", id_col)

"""Phrase collocations, counted in tries with hash containers.

Each task counts the phrases of its texts in a trie over word ids: below the first word stands a hash
container of the remaining ids, which bursts into containers by the next word when it grows. When a
task holds too many entries it spills its largest subtrees as sorted runs, which all tasks together
write as a table. Runs are merged by ranges of phrases, so that the phrases of a prefix come
together, and a prefix with very many of them covers several ranges. Words and pairs are
counted first; longer phrases only where both their parts are frequent.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorequery.llm.common import materialize, materialize_texts
from lorequery.operators.ranking import top_k
from lorequery.session import tidied

#: Entries of a container before it bursts, entries of all tries of a task before subtrees are spilled, and
#: different words of a task before it starts afresh.
BURST, ENTRIES, VOCABULARY = 4096, 3_000_000, 1_000_000
#: Bits of the filter of frequent phrases: 8 MB, whatever their number. A full filter costs time, not results.
FILTER_BITS = 26
#: Rows of an Arrow batch of a run, and words of text that are counted at once, about.
_RUN_ROWS, _CHUNK = 50_000, 1 << 18
#: Occurrences of a candidate, at least; percentage of them inside a longer candidate from which on it goes.
LEAST, INSIDE = 10, 50
UNKNOWN = "und"

#: Lower-cases A-Z and makes every character that ends a piece of text the same, which stands for itself between words.
_STOP, _STOP_ID = b".", 0
_LOWER_AND_STOP = bytes(_STOP[0] if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ID_BITS = 32
_END = -1
#: Stands between phrase and language in the key of a run; no phrase has one.
_TAB = "\t"


class Vocabulary(dict):
    """Word ids in order of appearance, and a hash of each word."""

    def __init__(self) -> None:
        super().__init__()
        self.marks = array("I")
        self[_STOP]  # takes _STOP_ID

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.marks.append(zlib.crc32(word))
        return number


class _Node(dict):
    """A burst container: containers of the remaining ids by the next one, which stands above ``shift``."""

    def __init__(self, container: dict[int, int], shift: int) -> None:
        super().__init__()
        self.shift, self.mask = shift, (1 << shift) - 1
        for rest, n in container.items():
            self.setdefault(rest >> shift, {})[rest & self.mask] = n


class HatTrie:
    """Counts of id sequences: a first id, and the packed remaining ones (_END for none)."""

    def __init__(self, size: int) -> None:
        self.size, self.root, self.entries = size, {}, 0

    def add(self, firsts: Iterable[int], rests: Iterable[int], counts: Iterable[int]) -> None:
        root, top, last, own = self.root, _ID_BITS * (self.size - 2), None, {}
        for first, rest, n in zip(firsts, rests, counts, strict=False):
            if first != last:
                last, own = first, root.get(first)
                if own is None:
                    own = root[first] = {}
            above, at, shift, held = root, first, top, own
            while type(held) is _Node:
                above, at, shift, rest = held, rest >> held.shift, held.shift - _ID_BITS, rest & held.mask
                held = above.get(at)
                if held is None:
                    held = above[at] = {}
            if rest in held:
                held[rest] += n
            else:
                held[rest] = n
                self.entries += 1
                if shift > 0 and len(held) > BURST:
                    above[at] = _Node(held, shift)
                    last = None

    def largest(self) -> list[int]:
        """First ids by descending size of their subtrees."""

        def size(held: dict) -> int:
            return sum(size(below) for below in held.values()) if type(held) is _Node else len(held)

        sizes = {first: size(held) for first, held in self.root.items()}
        return sorted(sizes, key=sizes.get, reverse=True)

    def _leaves(self, held: dict, before: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], dict]]:
        if type(held) is _Node:
            for first, below in held.items():
                yield from self._leaves(below, (*before, first))
        else:
            yield before, held

    def take(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Whole subtrees, the largest first, of ``least`` entries or more: rows of ids (_END after the last) and their counts."""
        by_depth: dict[int, list[tuple[tuple[int, ...], dict]]] = {1: []}
        taken = 0
        for first in list(self.root) if least >= self.entries else self.largest():
            if taken >= least:
                break
            held = self.root.pop(first)
            if type(held) is not _Node:
                by_depth[1].append(((first,), held))
                taken += len(held)
                continue
            for before, below in self._leaves(held, (first,)):
                by_depth.setdefault(len(before), []).append((before, below))
                taken += len(below)
        self.entries -= taken
        rows, counts = [np.zeros((0, self.size), dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for depth, leaves in by_depth.items():
            if not leaves:
                continue
            sizes = [len(held) for _, held in leaves]
            left = self.size - depth
            rests = np.fromiter(chain.from_iterable(held for _, held in leaves), np.int64 if left < 3 else object, sum(sizes))
            own = np.full((len(rests), self.size), _END, dtype=np.int64)
            own[:, :depth] = np.repeat(np.array([before for before, _ in leaves], dtype=np.int64), sizes, axis=0)
            there = rests != _END
            for i in range(left):
                own[there, depth + i] = (rests[there] >> (_ID_BITS * (left - 1 - i))) & ((1 << _ID_BITS) - 1)
            rows.append(own)
            counts.append(np.fromiter(chain.from_iterable(held.values() for _, held in leaves), np.int64, len(rests)))
        return np.concatenate(rows), np.concatenate(counts)


class _Counter:
    """The tries of a task, one for each language, and the sorted runs they spill."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.tries: dict[str, tuple[Vocabulary, HatTrie]] = {}
        self.words: Counter[str] = Counter()

    def totals(self) -> pa.RecordBatch:
        """The words of each language, under the key of the empty phrase."""
        return pa.record_batch(
            {"key": pa.array([_TAB + lang for lang in self.words], pa.string()), "n": pa.array(list(self.words.values()), pa.int64())}
        )

    def of(self, lang: str) -> tuple[Vocabulary, HatTrie]:
        if lang not in self.tries:
            self.tries[lang] = (Vocabulary(), HatTrie(self.size))
        return self.tries[lang]

    def full(self) -> bool:
        return sum(trie.entries for _, trie in self.tries.values()) > ENTRIES or any(
            len(words) > VOCABULARY for words, _ in self.tries.values()
        )

    def spill(self, everything: bool) -> Iterator[pa.RecordBatch]:
        """Sorted runs of the largest subtrees, half the entries at least; or of all of them, then words start afresh."""
        for lang, (words, trie) in list(self.tries.items()):
            whole = everything or len(words) > VOCABULARY
            rows, counts = trie.take(trie.entries if whole else trie.entries // 2)
            names = list(words)
            ranks = np.zeros(len(names) + 1, dtype=np.int64)  # the last one is for no word
            used = np.unique(rows[rows != _END]).tolist()
            ranks[sorted(used, key=names.__getitem__)] = np.arange(1, len(used) + 1)
            if self.size == 2:
                order = np.argsort((ranks[rows[:, 0]] << _ID_BITS) | ranks[rows[:, 1]])
            else:
                order = np.lexsort([ranks[rows[:, i]] for i in range(self.size - 1, -1, -1)])
            rows, counts, names = rows[order], counts[order], pa.array(names, pa.string())
            for at in range(0, len(rows), _RUN_ROWS):
                own, n = rows[at : at + _RUN_ROWS], counts[at : at + _RUN_ROWS]
                parts = [names.take(pa.array(own[:, i], mask=own[:, i] == _END)) for i in range(self.size)]
                phrases = pc.binary_join_element_wise(*parts, " ", null_handling="skip")
                keys = pc.binary_join_element_wise(phrases, lang, _TAB)
                yield pa.RecordBatch.from_arrays([keys, pa.array(n)], names=["key", "n"])
            if whole:
                del self.tries[lang]


# The filter's hash of a phrase folds the hashes of its words; every step fits 63 bits in numpy and in Spark.
_FOLD_BITS, _FOLD_BY, _FOLD_DOWN = 30, 1_000_003, 20


def _place(lang: str, marks: list[np.ndarray]) -> np.ndarray:
    x = np.full(len(marks[0]), zlib.crc32(lang.encode("utf-8")), dtype=np.int64)
    for own in marks:
        x = (x & ((1 << _FOLD_BITS) - 1)) * _FOLD_BY + own
    return (x ^ (x >> _FOLD_DOWN)) & ((1 << FILTER_BITS) - 1)


def _filter(frequent: DataFrame) -> np.ndarray:
    """A bit for the hash of each phrase of ``frequent``, in a fixed number of bytes."""
    fold = F.aggregate(
        F.split("phrase", " "),
        F.crc32("lang"),
        lambda x, w: x.bitwiseAND((1 << _FOLD_BITS) - 1) * F.lit(_FOLD_BY).cast("long") + F.crc32(w),
    )
    place = F.col("x").bitwiseXOR(F.shiftright("x", _FOLD_DOWN)).bitwiseAND((1 << FILTER_BITS) - 1)
    set_bits = (
        frequent.select(fold.alias("x"))
        .select(place.alias("place"))
        .groupBy(F.shiftright("place", 6).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
    )
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    rows = set_bits.toPandas()  # as many rows as the filter has words, at most
    bits[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return bits.view(np.uint8)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Words of one language with _STOP between pieces of text and at the end, about _CHUNK of them at once."""
    held: dict[str, list[bytes]] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
            own = held.setdefault(lang, [])
            own += text.translate(_LOWER_AND_STOP).replace(_STOP, b" " + _STOP + b" ").split()
            own.append(_STOP)
            start = 0
            while len(own) - start >= _CHUNK:
                # a very long text is handed over in parts that end between pieces
                end = own.index(_STOP, start + _CHUNK - 1) + 1
                yield lang, own[start:end]
                start = end
            if start:
                held[lang] = own[start:]
    yield from held.items()


def _add_pairs(trie: HatTrie, ids: np.ndarray, piece: np.ndarray) -> None:
    """Count the words and the pairs of a chunk of text, in the order of their first words."""
    single, n = np.unique(ids, return_counts=True)
    trie.add(single.tolist(), repeat(_END), n.tolist())
    inside = piece[:-1] == piece[1:]
    pairs, n = np.unique((ids[:-1][inside] << _ID_BITS) | ids[1:][inside], return_counts=True)
    trie.add((pairs >> _ID_BITS).tolist(), (pairs & ((1 << _ID_BITS) - 1)).tolist(), n.tolist())


def _add_longer(words: Vocabulary, trie: HatTrie, ids: np.ndarray, piece: np.ndarray, lang: str, known: np.ndarray) -> None:
    """Count the phrases of a chunk whose first and last parts, one word shorter, are both in the filter."""
    n = len(ids) - trie.size + 1
    if n < 1:
        return
    marks = np.array(words.marks, dtype=np.int64)[ids]
    at = _place(lang, [marks[i : n + 1 + i] for i in range(trie.size - 1)])
    good = (known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    found = np.flatnonzero(good[:-1] & good[1:] & (piece[:n] == piece[trie.size - 1 :]))
    wide = ids if trie.size < 4 else ids.astype(object)
    rests = wide[found + 1]
    for i in range(2, trie.size):
        rests = (rests << _ID_BITS) | wide[found + i]
    trie.add(ids[found].tolist(), rests.tolist(), repeat(1))


def _runs(docs: DataFrame, size: int, known: np.ndarray | None) -> DataFrame:
    """``key, n``: counts per task of words and pairs, or of the ``size``-word phrases whose parts are in the filter.

    A key is a phrase and its language, so that the runs of a prefix lie together.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(size)
        for lang, own in _chunks(batches):
            words, trie = counter.of(lang)
            ids = np.fromiter(map(words.__getitem__, own), np.int64, len(own))
            stops = ids == _STOP_ID
            piece = np.cumsum(stops)[~stops]
            ids = ids[~stops]
            counter.words[lang] += len(ids)
            if known is None:
                _add_pairs(trie, ids, piece)
            else:
                _add_longer(words, trie, ids, piece, lang, known)
            if counter.full():
                yield from counter.spill(False)
        yield from counter.spill(True)
        if known is None:
            yield counter.totals()

    return docs.mapInArrow(scan, "key string, n long")


def _merged(runs: DataFrame, least: int) -> DataFrame:
    """``lang, phrase, words, n``: whole counts of ``least`` or more, merged by ranges of phrases."""
    runs = runs.filter(~F.col("key").startswith(_TAB))
    whole = runs.repartitionByRange("key").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    phrase = F.substring_index("key", _TAB, 1)
    return materialize(
        whole.select(
            F.substring("key", F.length(phrase) + 2, F.length("key")).alias("lang"),
            phrase.alias("phrase"),
            F.size(F.split(phrase, " ")).alias("words"),
            "n",
        ),
        "frequent-phrases",
    )


def count_phrases(docs: DataFrame, most_words: int, least: int) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, n`` of the words and phrases found ``least`` times or more, and ``lang, n`` of all word occurrences.

    ``docs`` has ``lang, text`` without nulls.
    """
    runs = materialize_texts(_runs(docs, 2, None), "phrase-runs")
    lang = F.substring("key", F.lit(2), F.length("key"))
    totals = runs.filter(F.col("key").startswith(_TAB)).groupBy(lang.alias("lang")).agg(F.sum("n").alias("n"))
    totals = materialize(totals, "language-words")
    frequent = _merged(runs, least)
    for size in range(3, most_words + 1):
        known = _filter(frequent.filter(F.col("words") == size - 1))
        frequent = frequent.unionByName(_merged(materialize_texts(_runs(docs, size, known), "phrase-runs"), least))
    return frequent, totals


def _part(first: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice("own", first, size), " ")


def _scored(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """``a, l, r, score`` of each candidate's lowest-scoring cut, ties to the first."""
    cuts = (
        candidates.withColumn("own", F.split("phrase", " "))
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
        .select("lang", "phrase", "words", "a", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    )
    for side, name in (("left", "l"), ("right", "r")):
        counts = frequent.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
        cuts = cuts.join(counts, ["lang", side])
    exact = "cast({} as decimal(18, 0)) * cast({} as decimal(18, 0))"
    score = F.expr(f"({exact.format('a', 'a')} * 1000000) div ({exact.format('l', 'r')})")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return cuts.groupBy("lang", "phrase", "words", "a").agg(best.alias("best")).select(
        "lang", "phrase", "words", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score")
    )


def _covering(candidates: DataFrame, most_words: int) -> DataFrame:
    """``lang, phrase, longest``: for each phrase inside longer candidates, the count of the most frequent of them."""
    inner = F.explode(
        F.flatten(
            F.transform(
                F.sequence(F.lit(2), F.col("words") - 1),
                lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: _part(at, size)),
            )
        )
    )
    longer = candidates.filter("words > 2").withColumn("own", F.split("phrase", " "))
    return longer.select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))


@tidied
def collocations(
    docs: DataFrame,
    first: int = 2000,
    most_words: int = 3,
    least: int = LEAST,
    inside: int = INSIDE,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """The ``first`` collocations of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Candidates are phrases of 2 to ``most_words`` words found ``least`` times or more inside a piece of text. Of a
    candidate's cuts into a first part (found l times) and a rest (r times) the one with the lowest score
    floor(1000000 * a * a / (l * r)) counts, ties to the shortest first part. Candidates of which ``inside`` percent
    or more lie in one longer candidate are dropped. Order: score and a descending, then phrase in byte order. A null
    text is empty, a null language is UNKNOWN; equal rows count each; texts without words and empty tables give nothing.
    """
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    frequent, totals = count_phrases(texts, most_words, least)
    candidates = frequent.filter("words > 1").withColumnRenamed("n", "a")
    covering = _covering(candidates, most_words)
    staying = candidates.join(covering, ["lang", "phrase"], "left").filter(
        F.col("longest").isNull() | (100 * F.col("longest") < inside * F.col("a"))
    )
    scored = _scored(staying.drop("longest"), frequent)
    ranked = top_k(scored, first, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")])
    return materialize(
        ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"),
        "collocations",
    )

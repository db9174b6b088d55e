"""Collocations, decontamination and hard negatives against brute force, with nulls, ties, repeated rows and odd columns."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorequery.llm import collocations, decontaminate, negatives, topk

DOCS = "doc_id long, text string, lang string, `Row` int, words string, n int"
LOWER = {i: i + 32 for i in range(65, 91)}


def prose(rng, n, words="alpha Beta gamma delta épsilon ÉTA İota ΣΑΣ K9 x".split()):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def items():
    rng = random.Random(1)
    rows = [(i, prose(rng, 14)) for i in range(6)]
    rows += [(10, rows[0][1]), (0, rows[0][1]), (0, "short one"), (11, "alpha"), (12, ""), (13, None), (None, prose(rng, 12)), (14, " .,!  ")]
    rows += [(15, "the the the the the the the the the the the the"), (16, "never seen words stand here")]
    return rows


@pytest.fixture(scope="module")
def rows(items):
    rng = random.Random(2)
    texts = [None, "", "!! ..", "Short, ONE", "short two one", "the " * 40, "alpha", "a\tb\nc\x00d\U0001f600e", prose(rng, 20000)]
    texts += [prose(rng, rng.randint(5, 60)) for _ in range(12)]
    for _, text in items[:6]:
        words = text.split(" ")
        texts += [prose(rng, 9) + "\n" + text.upper() + "; " + prose(rng, 9), " ".join(words[:9]), ",".join(words[1:12]), text + " " + text]
    langs = ["en", None, "und", "fr"]
    out = [(i, t, langs[i % 4], i, "w", 1) for i, t in enumerate(texts)]
    return out + [out[12], out[12], (12, "another text of one id alpha", "en", 0, None, None), (None, texts[21], None, 0, None, None)]


def hits(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for item, text in items:
        w = word.findall((text or "").translate(LOWER))
        n = min(len(w), 10)
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for r in rows:
        w = word.findall((r[1] or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i : i + n]))
                if own:
                    found |= own
                    hit |= set(range(i, i + n))
        out.append((r[0], len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in df.collect()), key=repr)


def test_decontamination(spark, rows, items, monkeypatch):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    assert found(decontaminate.find_contamination(docs, bench)) == hits(rows, items)
    # without broadcasts the result is the same
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    assert found(decontaminate.find_contamination(docs, bench)) == hits(rows, items)


def test_decontamination_of_nothing(spark, rows, items):
    docs, none = spark.createDataFrame(rows, DOCS), spark.createDataFrame([], DOCS)
    bench, nothing = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert found(decontaminate.find_contamination(docs, nothing)) == hits(rows, [])
    assert found(decontaminate.find_contamination(none, bench)) == []


def test_proximity(spark):
    texts = ["a b c x x", "a x x x b", "b a", "c " + "x " * 30 + "a b", "x c x a x b x"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    words = decontaminate.item_words(spark.createDataFrame([(1, "a b"), (2, "a c b"), (3, "a zz"), (4, "a zz c")], "item_id int, text string"), "item_id", "text")
    index = decontaminate.build_index(docs, None, "doc_id", "text")
    near = decontaminate.proximity_matches(index, words, 3, 5).join(index.documents, "row")
    got = {(r.item, r.id) for r in near.collect()}
    want = set()
    for item, terms in (("1", "ab"), ("2", "abc"), ("4", "ac")):
        for i, t in enumerate(texts):
            w = t.split()
            if any(set(terms) <= set(w[k : k + 5]) for k in range(len(w))):
                want.add((item, i))
    assert got == want


def test_no_python_in_decontamination(spark, rows, items):
    """The operator plans expressions and joins only."""
    import ast
    import inspect

    names = {n.id for n in ast.walk(ast.parse(inspect.getsource(decontaminate))) if isinstance(n, ast.Name)}
    assert not names & {"pandas_udf", "udf", "pd", "pa", "np"}


def best_phrases(rows, first=2000, least=10):
    f, total = {}, Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for size in (1, 2, 3):
                for i in range(len(w) - size + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + size])] += 1
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and p in (q[:2], q[1:]) for q, b in cand.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(ranked)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def _runs_of(text, size):
    out = []
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        w = re.findall(r"[^\x20\x09]+", piece)
        out += [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)]
    return out


def test_collocations(spark, rows):
    rng = random.Random(3)
    words = [rng.choice("abcdé") + rng.choice("xyz\x1c ") for _ in range(8)]
    own = rows + [(100 + i, ", ".join(prose(rng, rng.randint(1, 9), words) for _ in range(6)), "fr" if i % 9 else "a b\tc", 0, None, None) for i in range(60)]
    docs = spark.createDataFrame(own, DOCS).repartition(3)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = sorted(tuple(r[c] for c in columns) for r in collocations.collocations(docs).collect())
    assert got == best_phrases(own) and got
    few = sorted(tuple(r[c] for c in columns) for r in collocations.collocations(docs, first=3, least=2).collect())
    assert few == best_phrases(own, 3, 2)
    longer = collocations.collocations(docs, most_words=5, least=3, inside=101).filter("size(split(phrase, ' ')) > 3")
    counts = Counter(w for r in own if r[2] == "fr" for w in _runs_of(r[1], 4) + _runs_of(r[1], 5))
    got = {r.phrase: r.a for r in longer.filter("lang = 'fr'").collect()}
    assert got == {w: a for w, a in counts.items() if a >= 3}
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_trie(monkeypatch):
    """Bursts and spills lose nothing and runs are sorted."""
    monkeypatch.setattr(collocations, "BURST", 3)
    rng = random.Random(4)
    counter, want = collocations._Counter(4), Counter()
    got = Counter()

    def read(batches):
        for b in batches:
            phrases = b["key"].to_pylist()
            assert phrases == sorted(phrases, key=lambda p: p.encode())
            for p, n in zip(phrases, b["n"].to_pylist(), strict=True):
                assert p.endswith("\ten")
                got[p[:-3]] += n

    for step in range(20):
        words, trie = counter.of("en")
        for _ in range(100):
            own = [rng.choice("abcdefgh").encode() * rng.randint(1, 2) for _ in range(4)]
            ids = [words[w] for w in own]
            trie.add([ids[0]], [(ids[1] << 64) | (ids[2] << 32) | ids[3]], [1])
            want[b" ".join(own).decode()] += 1
        if step % 4 == 0:
            before = trie.entries
            read(counter.spill(False))
            assert trie.entries <= before - before // 2
    assert any(type(held) is collocations._Node for held in counter.of("en")[1].root.values())
    read(counter.spill(True))
    assert got == want


def test_counts_pass_sixty_four_bits(spark):
    frame = spark.createDataFrame([("en", "a b", 2, 3 * 10**12)], "lang string, phrase string, words int, a long")
    counts = spark.createDataFrame([("en", "a", 1, 4 * 10**12 + 1), ("en", "b", 1, 3 * 10**12)], "lang string, phrase string, words int, n long")
    score = collocations._scored(frame, counts).first().score
    assert score == 10**6 * (3 * 10**12) ** 2 // ((4 * 10**12 + 1) * 3 * 10**12)


VECTORS = "id long, embedding array<float>, label int, score string"


def mined(spark, rows, every=4, **more):
    table = spark.createDataFrame(rows, VECTORS).select("id", "label", "score", topk.quantize(F.col("embedding"), 256).alias("vector"))
    out = negatives.hard_negatives(table, table.filter(f"id % {every} = 0"), **more)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in out.collect())


def mined_by_hand(rows, every=4, positives=5, n=10):
    ok = {}
    for i, v, label, _ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok[i] = ([math.floor(256 * float(np.float32(x))) for x in v], label)
    out = []
    for a, (v, label) in ok.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, own) for i, (w, own) in ok.items() if i != a)
        for ps, p, _ in [s for s in scores if s[2] == label][:positives]:
            inside = [(s, i) for s, i, own in scores if own != label and -30 * ps <= -100 * s <= -90 * ps][:n]
            out += [(a, p, rank, i, -ps, -s) for rank, (s, i) in enumerate(inside, 1)]
    return sorted(out)


def test_negatives(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0.3, 0.5, 7) * (1 + i % 3)], i % 4, "x") for i in range(160)]
    rows += [(200 + i, [0.5] * 7, i % 2, None) for i in range(30)] + [(300 + i, [0.0] * 7, i % 2, None) for i in range(8)]
    rows += [(400, None, 1, ""), (404, [1.0, None], 1, ""), (408, [float("nan")] * 7, 1, ""), (412, [float("-inf")] * 7, 1, "")]
    rows += [(416, [1.0] * 7, None, ""), (None, [1.0] * 7, 1, ""), (420, [], 1, ""), (424, [1.0, 2.0], 2, ""), (428, [-1.0] * 7, 9, "")]
    assert mined(spark, rows) == mined_by_hand(rows)
    assert mined(spark, rows + rows[:30]) == mined_by_hand(rows)
    assert mined(spark, [(0, [1.0], 1, "")]) == [] and mined(spark, []) == []


def test_negatives_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_VALUES", 40)
    monkeypatch.setattr(negatives, "BLOCKS_EACH", 2)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(0.5, 0.5, 5)], i % 3, "") for i in range(120)]
    assert mined(spark, rows, 5, positives=3, negatives=4) == mined_by_hand(rows, 5, 3, 4)
    big = [(i, [float(2.0**18 * (i + 1)), 2.0**19], i % 2, "") for i in range(16)]
    assert mined(spark, big) == mined_by_hand(big)


def test_intervals():
    """The bounds hold every product, also of short and zero vectors."""
    rng = np.random.default_rng(7)
    for dims in (1, 3, 64, 100):
        vectors = np.concatenate([rng.integers(-300, 300, (80, dims)), np.zeros((2, dims)), rng.integers(-1, 2, (20, dims))]).astype(np.int64)
        asked, codes = negatives.Anchors(vectors[::7]), negatives.Codes(vectors)
        low, high = asked.intervals(codes)
        exact = vectors[::7] @ vectors.T
        assert (low <= exact).all() and (exact <= high).all()

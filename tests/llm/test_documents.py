"""Operators over documents against brute force, with nulls, empty and long texts, ties, repeated rows and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import corpus_pipeline
from lorequery.llm import jaccard, langid, packing, pieces, pii, quality, repeats, rules, sharding
from lorequery.llm.catalog import public_encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tag int, `Measured` string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _texts():
    rng = random.Random(5)
    words = [rng.choice("bcdfglmnprst") + rng.choice("aeiouéü") + rng.choice("lnrst") + str(i % 7) * (i % 11 == 0) for i in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    base, passage = prose(300), prose(70)
    near = base.split(" ")
    near[10] = "changed"
    out = [None, "", " \n\t ", "one two", base, base, " ".join(near), base.upper(), "a b c d " * 400, prose(9000)]
    out += [prose(rng.randint(20, 200)) for _ in range(25)]
    out += [prose(60) + "\n" + passage + " " + prose(rng.randint(5, 60)) for _ in range(8)]
    out += ["x" * 300, "x" * 300 + "é" * 60, "line\n" * 90, "€" * 120 + prose(5), "mail a.b@c.example.com x@y z@q.de_w@v.fr " + prose(40)]
    out += [
        "ip 10.0.0.255 1.2.3.256 007.1.1.1 call +49 (0) 30 1234567-8 now 4111 1111 1111 1111, 4111-1111-1111-1112 " + prose(20),
        "9" * 5000 + "." + "1" * 30 + "@" * 3,
        "\U0001f600 a@b.io \U0001f600 +1 234 567 8901",
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (i * 3, text, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", 0, i, "m")
        for i, text in enumerate(_texts())
    ]
    rows += [rows[4], rows[20], (12, "another text of a repeated id", "en", "s1", 0, 1, None), (None, _texts()[11], "en", "s1", 0, 1, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def unique(spark, docs):
    """Ids once each, as the brute-force versions want them."""
    return docs.filter("doc_id is not null and not (text = 'another text of a repeated id')").dropDuplicates(["doc_id"]).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def test_rules(docs, empty):
    ledger = rules.rule_ledger(docs)
    assert ledger.count() == docs.count() and rules.rule_ledger(empty).count() == 0
    got = {(r.doc_id, r.n_words, r.n_dup_lines, r.n_repeat_words) for r in ledger.collect()}
    for r in docs.collect():
        words, text = WORD.findall(r.text or ""), r.text or ""
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        inside = {i + s for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for s in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.doc_id, len(words), len(lines) - len(set(lines)), len(inside)) in got
    kept = rules.keep_passing(docs)
    assert kept.columns == docs.columns
    assert kept.count() == ledger.filter(rules.passes(rules.CURRENT)).count()
    rows = {r.rule: r for r in rules.ablation(ledger).collect()}
    mask = rules.mask_of(rules.CURRENT)
    bits = [r.failed_bits & mask for r in ledger.collect()]
    for i, name in enumerate(rules.RULES):
        assert rows[name].n_failed == sum(b >> i & 1 for b in bits)
        assert rows[name].n_only == sum(b == 1 << i for b in bits)
        assert rows[name].n_kept_without == sum(b & ~(1 << i) == 0 for b in bits)
    assert rules.ablation(rules.rule_ledger(empty)).count() == 0


def test_sharding(docs, empty, spark):
    got = sharding.assign_shards(docs, 7).collect()
    grown = {r.doc_id: r.shard for r in sharding.assign_shards(docs, 8).collect()}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 7 and r.grown_shard in (r.shard, 7) and grown[r.doc_id] == r.grown_shard
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert sharding.assign_shards(empty, 40).count() == 0
    many = sharding.assign_shards(spark.range(4000).selectExpr("id as doc_id", "'' as text"), 10)
    sizes = [r["count"] for r in many.groupBy("shard").count().collect()]
    assert len(sizes) == 10 and min(sizes) > 300
    moved = many.filter("shard != grown_shard").count()
    assert 250 < moved < 480


def test_jaccard(unique, docs, empty):
    texts = texts_of(unique)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, text in texts.items():
        w = WORD.findall(text.translate(lower))
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in jaccard.near_duplicates(unique).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), root(i)) for i in sets}
    kept = jaccard.drop_near_duplicates(unique)
    assert kept.columns == unique.columns and {r.doc_id for r in kept.collect()} == {i for i in sets if not sets[i] or root(i) == i}
    whole = jaccard.near_duplicates(docs)
    assert whole.count() == docs.count() and whole.filter("component_id is null and n_shingles > 0").count() == 0
    again = jaccard.drop_near_duplicates(docs)
    assert again.groupBy("doc_id", "text").count().filter("count > 1 and text like '% %'").count() == 0
    assert jaccard.near_duplicates(empty).count() == 0


def test_jaccard_blocks(spark, monkeypatch):
    """Lists and clusters larger than a block, and n-grams that come last, give the same components."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(120)] = rng.choice(words)
        rows.append((i, " ".join(own if i % 3 else base[:40] + [rng.choice(words) for _ in range(60)])))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in jaccard.near_duplicates(table).collect()}
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(table).collect()} == want
    monkeypatch.setattr(jaccard, "HOT", 10)
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(table).collect()} == want


def brute_repeats(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        data = texts[i].encode()
        gone = np.zeros(len(data), dtype=bool)
        for at in range(len(data) - 99):
            piece = data[at : at + 100]
            if piece in seen:
                gone[at : at + 100] = True
            seen.add(piece)
        kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"))
    return out


def test_repeats(unique, docs, empty, monkeypatch):
    want = brute_repeats(texts_of(unique))

    def result(table):
        rows = repeats.remove_repeats(table).collect()
        return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.kept) for r in rows}

    assert result(unique) == want
    monkeypatch.setattr(repeats, "GROUP", 3)
    assert result(unique) == want
    assert repeats.remove_repeats(docs).count() == docs.count() and repeats.remove_repeats(empty).count() == 0
    left = repeats.drop_repeats(unique)
    assert left.columns == unique.columns
    assert {r.doc_id: r.text or "" for r in left.collect()} == {i: w[4] for i, w in want.items() if not w[1] or w[1] < w[0]}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text):
    found = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        found += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text) if _holds(kind, m.group())]
    return sorted(found)


def test_pii(unique, docs, empty, spark):
    got = {r.doc_id: r.spans for r in pii.find_spans(unique).collect()}
    for i, text in texts_of(unique).items():
        assert [(s.start, s.end, s.kind) for s in got[i] if s.kind != "context"] == [(s, e, k) for s, _, e, k in base_spans(text)]
    assert pii.find_spans(docs).count() == docs.count() and pii.find_spans(empty).count() == 0
    rows = [(i, f"name: customer id {f'10.0.0.{i}' if i < 12 else f'AB{i}77{i}91'} and more") for i in range(16)]
    rows += [(i + 100, f"version 2.{i} of chapter 12 in 19{i}") for i in range(10)]
    found = {r.doc_id: r.spans for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        names = [text[s.start : s.end] for s in found[i] if s.kind == "context"]
        assert names == ([f"AB{i}77{i}91"] if 12 <= i < 100 else [])
    masked = pii.redact(unique)
    assert masked.columns == unique.columns and masked.count() == unique.count()
    for r in masked.filter("text is not null").collect():
        assert not any(k == "email" for *_, k in base_spans(r.text)) and (got[r.doc_id] or r.text == texts_of(unique)[r.doc_id])


def test_packing(docs, empty):
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in docs.collect():
        want[(r.doc_id, len(encoder.encode(r.text or "", add_special_tokens=False).ids) + 1)] += 1
    rows = packing.pack_documents(docs, public_encoder(), window_tokens=4096).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(length for own in sequences.values() for _, length in own)
    assert len(sequences) == -(-total // 1024) and sorted(sequences) == list(range(len(sequences)))
    assert packing.pack_documents(empty, public_encoder()).count() == 0
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id not in (12, 60, None)}
    for r in rows:
        if r.doc_id in texts:
            ids = [*encoder.encode(texts[r.doc_id], add_special_tokens=False).ids, 0][r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_mixture(spark):
    """Every window holds the target shares up to a document, also for sources in different partitions."""
    table = spark.range(3000).selectExpr("id as doc_id", "repeat('ab ', 20) as text", "if(id < 1000, 'a', 'b') as source")
    rows = packing.pack_documents(table, public_encoder(), targets={"a": 0.5, "b": 0.5}, window_tokens=5000).collect()
    tokens = defaultdict(Counter)
    for r in rows:
        tokens[r.window][r.source] += r.length
    mixed = [t for w, t in tokens.items() if t["a"] and t["b"]][:-1]
    assert mixed and all(abs(t["a"] - t["b"]) <= 120 for t in mixed)


def test_languages(spark, docs, empty):
    rng = random.Random(1)
    vowels = {"aa": "aeou", "bb": "iyxq", "cc": "éüöä"}
    rows = []
    for i in range(240):
        lang = list(vowels)[i % 3]
        rows.append((i, " ".join(rng.choice("bdfgk") + rng.choice(vowels[lang]) + rng.choice("lnr") for _ in range(30)), lang))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(table)
    held = langid.predict(table, model).join(table, "doc_id").filter("held_out")
    assert held.count() > 20 and held.filter("lang_pred = lang").count() >= 0.95 * held.count()
    odd = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert odd[0].lang_pred == odd[3].lang_pred == odd[6].lang_pred == "und" and odd[0].score == 0
    assert langid.predict(docs, langid.fit(empty)).count() == docs.count() and langid.predict(empty, model).count() == 0
    whole, long = langid.subword_counts("abc" * 200_000), "abc" * 200_000
    assert whole.sum() == sum(len(long) - n + 1 for n in langid.ORDERS)


def test_quality(spark, docs, empty):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(600):
        good = i % 2
        rows.append((i, " ".join(rng.choice("abcde") * 4 + ("" if good else "!!$$") for _ in range(40))))
        marks.append((i, good if i % 7 else None))
    table = quality.document_statistics(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    model = quality.fit(table, labels)
    scored = {r.doc_id: r for r in quality.score(table, model).collect()}
    assert all(r.predicted == i % 2 and (r.predicted == 1) == (r.score >= 0.3) for i, r in scored.items())
    other = quality.document_statistics(docs)
    assert quality.score(other, model).count() == docs.count()
    plain = quality.fit(quality.document_statistics(empty), labels.limit(0))
    assert {round(r.score, 3) for r in quality.score(other, plain).collect()} == {0.5}
    assert quality.score(quality.document_statistics(empty), model).count() == 0


def test_pieces(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode_pieces(docs, path)
    back = pieces.decode_pieces(encoded, path)
    assert Counter(r.text for r in back.collect()) == Counter(r.text or "" for r in docs.collect())
    assert pieces.piece_digests(docs, path).filter("round_trip").count() == docs.count()
    assert pieces.piece_digests(empty, path).count() == 0
    # scores as log-probabilities: against a search that keeps all positions
    own = pieces.PieceVocabulary(path, ranked=False)
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice("theoninst ▁abé€\U0001f600aaaa") for _ in range(rng.randint(1, 400)))
        streamed = [i for run in own.viterbi(text) for i in run]
        best, back = [0.0] + [-1e300] * len(text), [None] * (len(text) + 1)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - own.longest), end):
                hit = own.scores.get(text[start:end])
                if hit and best[start] + hit[0] > best[end]:
                    best[end], back[end] = best[start] + hit[0], (start, [hit[1]])
            if text[end - 1] not in own.scores and best[end - 1] + own.penalty > best[end]:
                best[end], back[end] = best[end - 1] + own.penalty, (end - 1, own._spell(text[end - 1]))
        want, end = [], len(text)
        while end:
            end, ids = back[end]
            want = ids + want
        assert streamed == want


def test_pieces_are_those_of_the_library(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    own, library = pieces.vocabulary(path), SentencePieceProcessor(model_file=path)
    assert own.ranked
    rng = random.Random(5)
    letters = ["theoninst abé€\U0001f600aaaa", "    ab", "aaaa", "\n\t<s>unk0xA1 ▁", "引き日本語 的", "estionra  in"]
    texts = ["".join(rng.choice(chosen) for _ in range(rng.randint(0, 300))) for chosen in letters * 60]
    texts += ["a" * 50_000, " " * 5_000, "estion" * 20_000, "\x00", "é" * 700]
    for text in texts:
        want = library.encode(text)
        assert own.encode(text) == want
        # the whole text as one stretch, settled run by run
        runs = list(own.viterbi(pieces.MARK + text.replace(" ", pieces.MARK))) if text else []
        assert [i for run in runs for i in run] == want
        assert len(text) < 1000 or text.isspace() or max(map(len, runs)) < 200
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text_of = {r.doc_id: r.text or "" for r in small.collect()}
    encoded = {r.doc_id: list(r.ids) for r in pieces.encode_pieces(small, path).collect()}
    assert encoded == {i: library.encode(text) for i, text in text_of.items()}
    digests = {r.doc_id: (r.n_ids, r.ids_crc32) for r in pieces.piece_digests(small, path).collect()}
    assert digests == {i: (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())) for i, ids in encoded.items()}


def test_pieces_are_found_without_cutting_the_text_at_each():
    class Text(str):
        cuts = 0

        def __getitem__(self, key):
            Text.cuts += 1
            return super().__getitem__(key)

    own = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    text = pieces.MARK + "reconsiderations\u20ac\U0001f600estionra\ue000x" * 30
    assert [i for run in own.viterbi(Text(text)) for i in run] == [i for run in own.viterbi(text) for i in run]
    assert Text.cuts == len(text)


def test_pipeline(spark, tmp_path, docs, empty):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near duplicates", "repeated passages", "personal data", "packing"]
    texts = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns and 0 < kept.count() <= before, name
        if name == "near duplicates":
            texts = {r.doc_id: r.text for r in kept.collect()}
        if name == "repeated passages":
            want = brute_repeats({i: t for i, t in texts.items() if i is not None})
            assert all(r.text == want[r.doc_id][4] and r.n_chars == len(r.text) for r in kept.collect() if r.doc_id is not None)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0

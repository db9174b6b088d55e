"""Hot anchors, repeated rows without n-grams, weights of 0, long texts, and the columns of every registered query."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lorequery.llm import jaccard, packing, repeats
from lorequery.llm.catalog import QUERIES, public_encoder

SMALL = "/root/testdata/sf0.001"


def brute(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        data = texts[i].encode()
        gone = np.zeros(len(data), dtype=bool)
        for at in range(len(data) - 99):
            if data[at : at + 100] in seen:
                gone[at : at + 100] = True
            seen.add(data[at : at + 100])
        out[i] = (int(gone.sum()), hashlib.sha256(np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("group", [1, 4, 1000])
def test_hot_anchors(spark, monkeypatch, group):
    """A passage in ever different surroundings: its anchors have many contexts, of which parts are equal."""
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    passage = " ".join(rng.choice(words) for _ in range(50))
    texts = {}
    for i in range(60):
        start, end = rng.randint(0, 30), rng.randint(len(passage) - 40, len(passage))
        before, after = (" ".join(rng.choice(words[:6]) for _ in range(12)) for _ in range(2))
        texts[i] = f"{before} {passage[start:end]} {after}" + (f" {passage[10:125]}" if i % 7 == 0 else "")
    rows = repeats.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in rows} == brute(texts)


def test_rows_without_grams_all_stay(spark):
    rows = [(1, ""), (1, ""), (2, None), (2, None), (3, " \n"), (4, "some words that are here"), (4, "some words that are here")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in jaccard.drop_near_duplicates(table).collect()), key=repr)
    assert kept == sorted(rows[:6], key=repr)


def test_weight_zero_comes_last(spark):
    rows = [(i, "word " * (5 + i % 9), f"s{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack_documents(docs, public_encoder(), {"s0": 0.0, "s1": 3.0, "s2": 1.0}, window_tokens=64).collect()
    order = [p.source for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset))]
    assert order.index("s0") == sum(s != "s0" for s in order) and len({p.doc_id for p in pieces}) == 60


def test_very_long_texts_have_the_ids_of_the_tokenizer():
    encode, rng = public_encoder(), random.Random(3)
    text = " ".join(rng.choice(["über", "the", "naïve", "12 345", "\n\n", "#x", "日本", "a" * 40]) for _ in range(200_000))
    assert len(text) > packing._FAST_CHARS
    want = Tokenizer.from_file(encode.json_path).encode(text, add_special_tokens=False).ids
    assert encode(text) == want
    assert packing._fast_encoder(encode.ranks_path, encode.pattern).encode_ordinary(text) == want
    assert encode.id_type() == "<u2"


COLUMNS = {
    "op1_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op2_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op3_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op4_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op5_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op7_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op8_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_repeats": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op10_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op11_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op12_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op13_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows_of_queries(spark, name):
    found = QUERIES[name](spark, SMALL)
    kinds = dict(found.dtypes)
    for column in COLUMNS[name].split(", "):
        label, kind = column.split(" ")
        assert kinds[label] == kind, (label, kinds[label])
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    if "doc_id" in kinds:
        assert found.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    else:
        assert found.filter(F.col("rank") == 1).count() > 0

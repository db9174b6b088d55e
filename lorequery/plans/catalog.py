"""The registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorequery.functions.text import clean_answer, normalize_question, sanitize_answer, strip, strip_prompt
from lorequery.functions.vectors import squared_distance
from lorequery.operators import lexical
from lorequery.operators.dense import add_vectors, build_vector_index, dense_search
from lorequery.operators.embedding import hash_embedder
from lorequery.operators.generation import model_generator, quoting_generator
from lorequery.operators.hybrid import largest_top_k, resolve_requests, retrieve
from lorequery.operators.quantised import build_code_index, code_search
from lorequery.operators.ranking import number_rows
from lorequery.plans.answer import answer_questions, context_blocks, find_items, prompts
from lorequery.plans.build import add_to_index, build_index
from lorequery.session import materialize, scratch_path, spread
from lorequery.sources.collection import add_documents, document_ids, to_documents
from lorequery.sources.events import add_event_files, fold_events, read_event_files, token_events
from lorequery.sources.faq_csv import normalize_qa, preprocess_csv, preprocess_splits, write_qa_csv
from lorequery.sources.tables import row_count
from lorequery.streaming.history import number_exchanges, numbered_exchanges, session_history
from lorequery.streaming.requests import answer_stream, read_exchanges

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows, joined on (conversation, turn)."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    replies = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(replies, ["conv_id", "turn"]).withColumn("doc_pos", F.expr("conv_id * 1000 + turn"))


def qa_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs as they are indexed: question normalised, answer stripped."""
    pairs = qa_pairs(spark, sf_dir).select("doc_pos", "question", "answer")
    return normalize_qa(pairs, "question", "answer")


def qa_index(spark: SparkSession, sf_dir: str):
    return build_index(qa_corpus(spark, sf_dir), scratch_path(spark, "index"))


def qa_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question of the pairs, as it was asked."""
    return qa_pairs(spark, sf_dir).select(F.col("doc_pos").alias("query_id"), "question")


def faq_normalize(spark, sf_dir):
    return qa_pairs(spark, sf_dir).select(
        "doc_pos",
        normalize_question(F.col("question")).alias("question"),
        strip(F.col("answer")).alias("answer"),
    )


def csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    rows = qa_pairs(spark, sf_dir).select(
        "doc_pos", F.col("question").alias("Question"), F.col("answer").alias("Answer")
    )
    write_qa_csv(rows, path)
    return preprocess_csv(spark, path).select(
        F.col("doc_pos").cast("long").alias("doc_pos"),
        F.col("Question").alias("question"),
        F.col("Answer").alias("answer"),
    )


def csv_splits(spark, sf_dir):
    """Questions and answers on several lines, with quotes in them, written as CSV and read in splits."""
    path = scratch_path(spark, "csv")
    lines = F.concat("answer", F.lit('\n"'), "question", F.lit('",\n\n'), "answer")
    rows = qa_pairs(spark, sf_dir).select("doc_pos", F.col("question").alias("Question"), lines.alias("Answer"))
    write_qa_csv(rows, path)
    return preprocess_splits(spark, path).select(
        F.col("doc_pos").cast("long").alias("doc_pos"),
        F.col("Question").alias("question"),
        F.col("Answer").alias("answer"),
    )


def doc_ids(spark, sf_dir):
    pairs = qa_pairs(spark, sf_dir).select("doc_pos", "question")
    numbered = number_rows(pairs, [F.asc("doc_pos")], "doc_ids", "position")
    return numbered.select("doc_pos", document_ids().alias("id"), "question")


def tokens(spark, sf_dir):
    return lexical.token_positions(spread(table(spark, sf_dir, "documents")), "doc_id", "text")


def bm25_term_freq(spark, sf_dir):
    return lexical.term_frequencies(spread(table(spark, sf_dir, "documents")), "doc_id", "text")


def bm25_doc_stats(spark, sf_dir):
    stats = lexical.document_stats(spread(table(spark, sf_dir, "documents")), "doc_id", "text")
    return stats.withColumn("avgdl", F.round("avgdl", 6))


def bm25_idf(spark, sf_dir):
    idf = lexical.inverse_document_frequencies(spread(table(spark, sf_dir, "documents")), "doc_id", "text")
    return idf.withColumn("idf", F.round("idf", 6))


def documents_index(spark, sf_dir) -> lexical.LexicalIndex:
    documents = table(spark, sf_dir, "documents")
    return lexical.build_lexical_index(documents, scratch_path(spark, "lexical"), "text", "doc_id")


def index_postings(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    texts = index.texts.select("digest", "text_id")
    copies = index.docs.select("digest", F.col("doc_pos").alias("doc_id")).join(texts, "digest").select("doc_id", "text_id")
    # a text's postings travel as one row
    packed = index.packed.join(copies.hint("shuffle_hash"), "text_id")
    return lexical.unpacked(packed, "doc_id", "dl").select("doc_id", "term", "tf", "dl")


def bm25_topk(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    questions = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )
    return lexical.bm25_search(index, questions, 3).withColumnRenamed("doc_pos", "doc_id")


def bm25_topk_pruned(spark, sf_dir):
    """The search by impact bounds, which large posting lists get."""
    questions = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )
    found = lexical.bm25_search(documents_index(spark, sf_dir), questions, 3, direct_hits=0)
    return found.withColumnRenamed("doc_pos", "doc_id")


def bm25_topk_padded(spark, sf_dir):
    """Every word of the benchmark texts as a question of its own: many match fewer than k documents."""
    index = documents_index(spark, sf_dir)
    words = lexical.token_positions(table(spark, sf_dir, "benchmark"), "item_id", "text")
    questions = words.select(F.col("token").alias("query_id"), F.col("token").alias("question")).distinct()
    return lexical.bm25_search(index, questions, 3).withColumnRenamed("doc_pos", "doc_id")


def embeddings_index(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return build_vector_index(vectors, scratch_path(spark, "vectors"), "vec_id")


def semantic_topk(spark, sf_dir):
    questions = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    found = dense_search(embeddings_index(spark, sf_dir), questions, 3)
    return found.withColumnRenamed("doc_pos", "vec_id")


def semantic_topk_cells(spark, sf_dir):
    """The exact search over many cells, in two rounds of visits."""
    vectors = table(spark, sf_dir, "embeddings")
    index = build_vector_index(vectors, scratch_path(spark, "vectors"), "vec_id", cell_rows=64)
    questions = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    return dense_search(index, questions, 3).withColumnRenamed("doc_pos", "vec_id")


def ann_quality(spark, sf_dir):
    """The approximate search next to the exact one: how many answers, all with their true distances, and enough of the nearest."""
    vectors = table(spark, sf_dir, "embeddings")
    questions = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    near = code_search(build_code_index(vectors, scratch_path(spark, "codes"), "vec_id"), questions, 3)
    exact = dense_search(embeddings_index(spark, sf_dir), questions, 3).select("query_id", "rank", F.col("score").alias("best"))
    found = near.join(exact, ["query_id", "rank"]).join(vectors.select(F.col("vec_id").alias("doc_pos"), F.col("embedding").alias("own")), "doc_pos")
    found = found.join(questions, "query_id")
    true = F.abs(F.col("score") - squared_distance(F.col("embedding"), F.col("own"))) < 2e-6
    return found.agg(
        F.countDistinct("query_id").alias("n_questions"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~true).alias("n_wrong_distances"),
        # as near as the exact neighbour of that rank
        (F.avg(F.when(F.col("score") <= F.col("best"), 1.0).otherwise(0.0)) >= 0.9).alias("recalled"),
    )


def ann_topk(spark, sf_dir):
    """Approximate search: only the nearest cells of a finer partition are visited."""
    vectors = table(spark, sf_dir, "embeddings")
    index = build_vector_index(vectors, scratch_path(spark, "vectors"), "vec_id", cell_rows=64)
    questions = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    return dense_search(index, questions, 3, n_probe=4).withColumnRenamed("doc_pos", "vec_id")


def vector_reopen(spark, sf_dir):
    """Half the vectors in fine cells, the others added, then reopened with other parameters."""
    vectors, path = table(spark, sf_dir, "embeddings"), scratch_path(spark, "vectors")
    build_vector_index(vectors.filter("vec_id % 2 = 0"), path, "vec_id", cell_rows=64)
    add_vectors(vectors, path, "vec_id")
    index = build_vector_index(vectors, path, "vec_id")
    questions = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    return dense_search(index, questions, 3).withColumnRenamed("doc_pos", "vec_id")


def bm25_topk_added(spark, sf_dir):
    """Three additions to the statistics of a part of the documents: the same as all at once."""
    documents, path = table(spark, sf_dir, "documents"), scratch_path(spark, "lexical")
    index = lexical.build_lexical_index(documents.filter("doc_id % 3 = 0"), path, "text", "doc_id")
    for rest in (1, 2):
        index = lexical.add_to_lexical_index(documents.filter(F.expr("doc_id % 3") <= rest), path, "text", "doc_id")
    questions = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )
    return lexical.bm25_search(index, questions, 3).withColumnRenamed("doc_pos", "doc_id")


def add_then_answer(spark, sf_dir):
    """An index of the opening exchanges, to which all are added: contexts quote old and new ones."""
    corpus, path = qa_corpus(spark, sf_dir), scratch_path(spark, "index")
    index = build_index(corpus.filter("doc_pos % 1000 = 0"), path)
    items = find_items(qa_questions(spark, sf_dir), add_to_index(corpus, path, index))
    return context_blocks(items).select("query_id", "context")


def _two_adds(spark, sf_dir) -> DataFrame:
    """First the opening exchange of each conversation, then all: known ids are left alone."""
    path = scratch_path(spark, "collection")
    pairs = qa_pairs(spark, sf_dir)
    columns = ["doc_pos", "question", "answer"]
    opening = pairs.filter("turn = 0").select(*columns)
    add_documents(path, to_documents(opening, hash_embedder()).withColumn("batch", F.lit(1)))
    return add_documents(path, to_documents(pairs.select(*columns), hash_embedder()).withColumn("batch", F.lit(2)))


def vector_add(spark, sf_dir):
    return _two_adds(spark, sf_dir).select(
        "id", "document", F.col("metadata.question").alias("question"), "batch"
    )


def collection_count(spark, sf_dir):
    return row_count(_two_adds(spark, sf_dir))


def hash_embed(spark, sf_dir):
    embedded = hash_embedder()(spread(qa_pairs(spark, sf_dir).select("doc_pos", "answer")), "answer")
    return (
        embedded.select("doc_pos", F.posexplode_outer("embedding").alias("dim", "weight"))
        .filter("weight > 0")
        .withColumn("weight", F.round(F.col("weight").cast("double"), 6))
    )


def hybrid_topk(spark, sf_dir):
    index = qa_index(spark, sf_dir)
    resolved = resolve_requests(qa_questions(spark, sf_dir))
    return retrieve(index, resolved, 3).select("query_id", "method", "rank", "doc_pos", "score")


def mixed_requests(spark, sf_dir):
    """The questions with different modes (also empty, unknown and missing ones) and depths."""
    modes = F.array(*[F.lit(m) for m in ["bm25", "semantic", "hybrid", "", "typo", None]])
    return qa_pairs(spark, sf_dir).select(
        F.col("doc_pos").alias("query_id"),
        "question",
        F.get(modes, F.expr("conv_id % 6")).alias("retrieval_mode"),
        F.expr("if(conv_id % 5 = 0, null, cast(conv_id % 5 as int))").alias("top_k"),
    )


def mode_dispatch(spark, sf_dir):
    resolved = resolve_requests(mixed_requests(spark, sf_dir))
    rows = retrieve(qa_index(spark, sf_dir), resolved, largest_top_k(resolved))
    return rows.select("query_id", "method", "rank", "doc_pos", "score")


def deep_request(spark, sf_dir):
    """The questions of one conversation ask for more than the corpus has; the others stay at their depth."""
    deep = F.when(F.expr("query_id div 1000 = 7"), F.lit(1_000_000)).otherwise(F.col("top_k"))
    resolved = resolve_requests(mixed_requests(spark, sf_dir).withColumn("top_k", deep))
    return retrieve(qa_index(spark, sf_dir), resolved).select("query_id", "method", "rank", "doc_pos", "score")


def jaccard_rerank(spark, sf_dir):
    items = find_items(qa_questions(spark, sf_dir), qa_index(spark, sf_dir))
    return items.select(
        "query_id", "final_rank", "method", "rank", "doc_pos", F.round("rerank_score", 6).alias("rerank_score")
    )


def context_block(spark, sf_dir):
    items = find_items(qa_questions(spark, sf_dir), qa_index(spark, sf_dir))
    return context_blocks(items).select("query_id", "context")


def prompt_render(spark, sf_dir):
    """Each pair as the only context item of its own question."""
    own = qa_pairs(spark, sf_dir).select(
        F.col("doc_pos").alias("query_id"), "question", "answer", F.lit(1).alias("final_rank")
    )
    return prompts(own, own).select("query_id", "prompt")


def rag_prompts(spark, sf_dir):
    requests = mixed_requests(spark, sf_dir)
    items = find_items(requests, qa_index(spark, sf_dir))
    return prompts(requests, items).select("query_id", "prompt")


def generated_answers(spark, sf_dir):
    answers = answer_questions(qa_questions(spark, sf_dir), qa_index(spark, sf_dir), quoting_generator())
    return answers.select("query_id", "answer")


def _word_counter():
    """A model that states how many words a prompt has and fails on round numbers."""

    def complete(batch, max_tokens, temperature):
        sizes = [len(prompt.split()) for prompt in batch]
        if any(n % 10 == 0 for n in sizes):
            raise ValueError("round number")
        return [f"{prompt}\nA:  {n} words" for prompt, n in zip(batch, sizes, strict=True)]

    return complete


def model_answers(spark, sf_dir):
    """Answers of a Python model that fails on some of the prompts."""
    answers = answer_questions(mixed_requests(spark, sf_dir), qa_index(spark, sf_dir), model_generator(_word_counter))
    return answers.select("query_id", "answer", "error")


def _wrapped(spark, sf_dir, *forms: str) -> DataFrame:
    """Assistant turns inside one of the given SQL forms, by conversation."""
    cases = " ".join(f"when {i} then {form}" for i, form in enumerate(forms))
    return table(spark, sf_dir, "conversations").filter("role = 'assistant'").select(
        "conv_id", "turn", F.expr(f"case conv_id % {len(forms)} {cases} end").alias("raw")
    )


# Lines that are not one whole JSON object.
JUNK_LINES = ["", "  ", "{broken", '{"token":"x"', '{"token":"x"} y', '{"final":"x"}{"final":"y"}', "{'token':'x'}", "[1]", "7"]

# The forms are plain SQL on the column text and mean the same in both engines.
SANITIZE_FORMS = [
    "concat('q: ', text, ' A: ', text)",
    "concat(text, chr(10), 'User: ', text)",
    "concat('a:  ', text)",
    "concat('Context: ', text)",
    "text",
    "concat('Q: x A: ', text, chr(10), 'ASSISTANT: y')",
]
CLEAN_FORMS = [
    "concat('ANSWER: A: ', text)",
    "concat('a: ', text)",
    "concat('Q: x A: y A: ', text)",
    "concat('Q: ', text)",
    "text",
    "concat('  Answer:', text)",
]
GENERATED_FORMS = [
    "concat(question, answer)",
    "concat('  ', question, answer, question)",
    "concat(answer, chr(10))",
    "concat(question, question, answer)",
]


def sanitized(spark, sf_dir):
    return _wrapped(spark, sf_dir, *SANITIZE_FORMS).select(
        "conv_id", "turn", sanitize_answer(F.col("raw")).alias("cleaned")
    )


def cleaned(spark, sf_dir):
    return _wrapped(spark, sf_dir, *CLEAN_FORMS).select(
        "conv_id", "turn", clean_answer(F.col("raw")).alias("cleaned")
    )


def stripped(spark, sf_dir):
    cases = " ".join(f"when {i} then {form}" for i, form in enumerate(GENERATED_FORMS))
    generated = F.expr(f"case conv_id % {len(GENERATED_FORMS)} {cases} end")
    return qa_pairs(spark, sf_dir).select(
        "conv_id", "turn", strip_prompt(generated, F.col("question")).alias("cleaned")
    )


def _exchanges(spark, sf_dir):
    return spread(qa_pairs(spark, sf_dir)).select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("seq"),
        F.col("question").alias("user"),
        F.col("answer").alias("assistant"),
    )


def events(spark, sf_dir):
    return token_events(_exchanges(spark, sf_dir), "session_id", "seq", answer_col="assistant")


def folded(spark, sf_dir):
    """Events with blank and broken lines between them; every second session lost its final line."""
    lines = events(spark, sf_dir).filter("session_id % 2 = 0 or not startswith(json, '{\"final\"')")
    noise = lines.select(
        "session_id", "seq", "pos", F.explode(F.array(F.lit(""), F.lit("{broken"))).alias("json")
    )
    return fold_events(lines.unionByName(noise), "session_id", "seq")


def event_files(spark, sf_dir):
    """Event lines written in two additions, with junk among them, read back in order and folded."""
    path = scratch_path(spark, "event-files")
    lines = events(spark, sf_dir)
    junk = lines.select("session_id", "seq", "pos", F.explode(F.array(*[F.lit(x) for x in JUNK_LINES])).alias("json"))
    for part in (0, 1):
        own = F.col("session_id") % 2 == part
        add_event_files(lines.filter(own).unionByName(junk.filter(own)), path, "session_id", "seq", n_files=8)
    back = read_event_files(spark, path, "session_id bigint, seq bigint")
    return fold_events(back, "session_id", "seq")


def history(spark, sf_dir):
    pages = session_history(_exchanges(spark, sf_dir), page_rows=4)
    text = F.array_join(F.transform("history", lambda e: F.concat(e["user"], F.lit(" => "), e["assistant"])), " | ")
    return pages.select("session_id", "page", "n", text.alias("history"))


def stream_history(spark, sf_dir):
    """Exchanges that arrive in four folders, numbered by a stream that is stopped and started again in between."""
    out, numbers, progress = (scratch_path(spark, name) for name in ("exchanges", "numbers", "progress"))
    pairs = _exchanges(spark, sf_dir).withColumnRenamed("seq", "place").withColumn("session_id", F.col("session_id").cast("string"))
    quarter = F.ntile(4).over(Window.partitionBy("session_id").orderBy("place"))
    arriving = materialize(pairs.withColumn("quarter", quarter - 1), "arriving")
    for batch in range(4):
        arriving.filter(F.col("quarter") == batch).drop("quarter").write.parquet(f"{out}/batch_id={batch}")
        if batch % 2:
            number_exchanges(spark, out, numbers, progress, files=8).awaitTermination()
    pages = session_history(numbered_exchanges(spark, out, numbers), page_rows=4)
    text = F.array_join(F.transform("history", lambda e: F.concat(e["user"], F.lit(" => "), e["assistant"])), " | ")
    return pages.select("session_id", "page", "n", text.alias("history"))


def index_tables(spark, sf_dir):
    """Sizes of the index tables after two builds into the same folder."""
    path = scratch_path(spark, "index")
    build_index(qa_corpus(spark, sf_dir), path)
    index = build_index(qa_corpus(spark, sf_dir), path)
    parts = {
        "corpus": index.corpus,
        "docs": index.lexical.docs,
        "texts": index.lexical.texts,
        "postings": index.lexical.postings,
        "terms": index.lexical.terms,
        "vectors": index.vectors.vectors,
    }
    counts = [row_count(df).select(F.lit(name).alias("name"), "n") for name, df in parts.items()]
    merged = counts[0]
    for more in counts[1:]:
        merged = merged.unionByName(more)
    return merged


def stream_answers(spark, sf_dir):
    """User turns as a file stream, answered micro-batch by micro-batch."""
    index = qa_index(spark, sf_dir)
    schema = table(spark, sf_dir, "conversations").schema
    # a pattern, since the table is a file or a folder of files, and a stream follows no single file
    turns = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parque[t]")
    requests = turns.filter("role = 'user'").select(
        F.expr("cast(conv_id * 1000 + turn as string)").alias("request_id"),
        F.col("text").alias("question"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.lit(None).cast("string").alias("retrieval_mode"),
        F.lit(None).cast("int").alias("top_k"),
    )
    out = scratch_path(spark, "exchanges")
    query = answer_stream(requests, index, quoting_generator(), out, scratch_path(spark, "progress"))
    query.awaitTermination()
    return read_exchanges(spark, out).select("request_id", "session_id", "user", "assistant")


QUERIES: dict[str, Query] = {
    "faq_normalize": faq_normalize,
    "csv_round_trip": csv_round_trip,
    "csv_splits": csv_splits,
    "doc_ids": doc_ids,
    "tokens": tokens,
    "bm25_term_freq": bm25_term_freq,
    "bm25_doc_stats": bm25_doc_stats,
    "bm25_idf": bm25_idf,
    "index_postings": index_postings,
    "bm25_topk": bm25_topk,
    "bm25_topk_pruned": bm25_topk_pruned,
    "bm25_topk_padded": bm25_topk_padded,
    "semantic_topk": semantic_topk,
    "semantic_topk_cells": semantic_topk_cells,
    "ann_topk": ann_topk,
    "ann_quality": ann_quality,
    "vector_reopen": vector_reopen,
    "bm25_topk_added": bm25_topk_added,
    "add_then_answer": add_then_answer,
    "vector_add": vector_add,
    "collection_count": collection_count,
    "hash_embed": hash_embed,
    "hybrid_topk": hybrid_topk,
    "mode_dispatch": mode_dispatch,
    "deep_request": deep_request,
    "jaccard_rerank": jaccard_rerank,
    "context_block": context_block,
    "prompt_render": prompt_render,
    "rag_prompts": rag_prompts,
    "generated_answers": generated_answers,
    "model_answers": model_answers,
    "strip_prompt": stripped,
    "sanitize_answer": sanitized,
    "clean_answer": cleaned,
    "token_events": events,
    "token_fold": folded,
    "event_files": event_files,
    "session_history": history,
    "stream_history": stream_history,
    "index_tables": index_tables,
    "stream_answers": stream_answers,
}

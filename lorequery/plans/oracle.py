"""The same queries as plain SQL for a single-node database, written independently of the Spark plans."""

from __future__ import annotations

import re

from lorequery.functions.text import DEFAULT_TEMPLATE
from lorequery.plans.catalog import CLEAN_FORMS, GENERATED_FORMS, SANITIZE_FORMS

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
DIM = 64


def _strip(s: str) -> str:
    return f"regexp_replace({s}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _tokens(s: str) -> str:
    return f"list_filter(string_split_regex({s}, '{SPACE}+'), lambda w: w <> '')"


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PAIRS = """pairs AS (
  SELECT u.conv_id * 1000 + u.turn AS doc_pos, u.conv_id, u.turn, u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

_Q, _A = _strip("question"), _strip("answer")
CORPUS = f"""{PAIRS}, corpus AS (
  SELECT doc_pos, conv_id, turn, upper(substr({_Q}, 1, 1)) || lower(substr({_Q}, 2)) AS question,
         {_A} AS answer FROM pairs)"""


def _bm25(corpus: str, id_col: str, key: str, asked: str) -> str:
    """CTEs from corpus and ``asked(query_id, question)`` to ``lexical(query_id, doc_pos, score)``, all pairs."""
    return f"""
  lists AS (SELECT {id_col} AS doc_pos, {_tokens(key)} AS words FROM {corpus}),
  lengths AS (SELECT doc_pos, len(words) AS dl FROM lists),
  stats AS (SELECT count(*)::DOUBLE AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM lengths),
  freqs AS (SELECT doc_pos, term, count(*) AS tf
            FROM (SELECT doc_pos, unnest(words) AS term FROM lists) GROUP BY doc_pos, term),
  raw_idf AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5e0) - ln(count(*) + 0.5e0) AS idf
              FROM freqs, stats GROUP BY term),
  idfs AS (SELECT term, df, CASE WHEN idf < 0 THEN (SELECT 0.25e0 * avg(idf) FROM raw_idf) ELSE idf END AS idf
           FROM raw_idf),
  asked_terms AS (SELECT query_id, term, count(*) AS qtf
                  FROM (SELECT query_id, unnest({_tokens('question')}) AS term FROM {asked})
                  GROUP BY query_id, term),
  matches AS (SELECT q.query_id, f.doc_pos,
                round(sum(q.qtf * i.idf * f.tf * 2.5e0
                  / (f.tf + 1.5e0 * (0.25e0 + 0.75e0 * l.dl / s.avgdl))), 6) AS score
              FROM asked_terms q JOIN idfs i USING (term) JOIN freqs f USING (term)
                JOIN lengths l ON l.doc_pos = f.doc_pos CROSS JOIN stats s
              GROUP BY q.query_id, f.doc_pos),
  lexical AS (SELECT a.query_id, l.doc_pos, coalesce(m.score, 0e0) AS score
              FROM {asked} a CROSS JOIN lengths l
                LEFT JOIN matches m ON m.query_id = a.query_id AND m.doc_pos = l.doc_pos)"""


def _ranked(source: str, order: str, k: str = "3") -> str:
    return f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_pos, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM {source}) WHERE rank <= {k}"""


def _hashed(name: str, source: str, id_col: str, text: str) -> str:
    """CTEs to ``name(id, embedding)``: token counts by md5 bucket, scaled to length 1."""
    return f"""
  {name}_counts AS (SELECT id, bucket, count(*)::DOUBLE AS c FROM (
      SELECT id, CAST(('0x' || substr(md5(term), 1, 8))::UBIGINT % {DIM} AS BIGINT) AS bucket
      FROM (SELECT {id_col} AS id, unnest({_tokens(text)}) AS term FROM {source})) GROUP BY id, bucket),
  {name}_norms AS (SELECT id, sqrt(sum(c * c)) AS norm FROM {name}_counts GROUP BY id),
  {name} AS (SELECT s.{id_col} AS id,
        list(coalesce((c.c / n.norm)::FLOAT, 0::FLOAT) ORDER BY r.bucket)::DOUBLE[] AS embedding
      FROM {source} s CROSS JOIN (SELECT unnest(range({DIM})) AS bucket) r
        LEFT JOIN {name}_counts c ON c.id = s.{id_col} AND c.bucket = r.bucket
        LEFT JOIN {name}_norms n ON n.id = s.{id_col} GROUP BY s.{id_col})"""


def _distances(asked: str, documents: str) -> str:
    return f"""dense AS (SELECT a.id AS query_id, d.id AS doc_pos,
      round(list_sum(list_transform(list_zip(a.embedding, d.embedding), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6)
        AS score FROM {asked} a CROSS JOIN {documents} d)"""


def _hybrid(asked: str) -> str:
    """CTEs to ``hits(query_id, method, method_ord, rank, doc_pos, score)`` for ``asked`` with mode and top_k."""
    return f"""{_bm25("corpus", "doc_pos", "question", asked)},
  {_hashed("doc_vectors", "corpus", "doc_pos", "answer")},
  {_hashed("ask_vectors", asked, "query_id", "question")},
  {_distances("ask_vectors", "doc_vectors")},
  hits AS (
    SELECT h.*, a.mode, a.top_k FROM (
      SELECT query_id, 'bm25' AS method, 0 AS method_ord, rank, doc_pos, score
        FROM ({_ranked("lexical", "score DESC, doc_pos DESC", "10")})
      UNION ALL SELECT query_id, 'semantic', 1, rank, doc_pos, score
        FROM ({_ranked("dense", "score, doc_pos", "10")})) h
    JOIN {asked} a USING (query_id)
    WHERE rank <= a.top_k AND a.mode IN (method, 'hybrid'))"""


PLAIN = f"""{CORPUS}, asked AS (
  SELECT doc_pos AS query_id, question, 'hybrid' AS mode, 3 AS top_k FROM pairs)"""
MIXED = f"""{CORPUS}, asked AS (
  SELECT doc_pos AS query_id, question,
    CASE conv_id % 6 WHEN 0 THEN 'bm25' WHEN 1 THEN 'semantic' ELSE 'hybrid' END AS mode,
    CASE WHEN conv_id % 5 = 0 THEN 3 ELSE conv_id % 5 END AS top_k FROM pairs)"""
USER_TURNS = f"""{CORPUS}, asked AS (
  SELECT conv_id * 1000 + turn AS query_id, conv_id, text AS question, 'hybrid' AS mode, 3 AS top_k
  FROM conversations WHERE role = 'user')"""

ITEMS = f"""
  sets AS (SELECT h.*, a.question AS asked_question, c.question, c.answer,
      list_distinct({_tokens("lower(a.question)")}) AS s1, list_distinct({_tokens("lower(c.question)")}) AS s2
    FROM hits h JOIN asked a USING (query_id) JOIN corpus c ON c.doc_pos = h.doc_pos),
  scored AS (SELECT *, coalesce(len(list_intersect(s1, s2))::DOUBLE
      / nullif(len(s1) + len(s2) - len(list_intersect(s1, s2)), 0), 0e0) AS rerank_score FROM sets),
  items AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (
      PARTITION BY query_id ORDER BY rerank_score DESC, method_ord, rank) AS INTEGER) AS final_rank FROM scored)
    WHERE final_rank <= top_k)"""

_CONTEXT = (
    "string_agg('Q: ' || question || chr(10) || 'A: ' || answer, chr(10) || chr(10) ORDER BY final_rank)"
)


def _prompt(context: str, question: str) -> str:
    parts = [p for p in re.split(r"(\{context\}|\{question\})", DEFAULT_TEMPLATE) if p]
    slots = {"{context}": context, "{question}": question}
    return " || ".join(slots[p] if p in slots else _literal(p) for p in parts)


def _case(forms: list[str]) -> str:
    return f"CASE conv_id % {len(forms)} " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END"


def _sanitize(raw: str, source: str, keys: str) -> str:
    """CTEs to ``sane(keys, s)``."""
    steps = [f"s0 AS (SELECT {keys}, {_strip(f'coalesce({raw}, {_literal('')})')} AS s FROM {source})"]
    steps.append(
        f"s1 AS (SELECT {keys}, CASE WHEN upper(left(s, 2)) = 'Q:' AND contains(s, 'A:') "
        f"THEN {_strip("string_split(s, 'A:')[-1]")} ELSE s END AS s FROM s0)"
    )
    markers = ["'Context:'", "'CONTEXT:'"] + [
        f"chr(10) || '{m}:'" for m in ["User", "Assistant", "USER", "ASSISTANT"]
    ]
    for i, marker in enumerate(markers, 2):
        steps.append(
            f"s{i} AS (SELECT {keys}, {_strip(f'string_split(s, {marker})[1]')} AS s FROM s{i - 1})"
        )
    last = len(markers) + 1
    steps.append(
        f"labelled AS (SELECT {keys}, CASE WHEN upper(left(s, 2)) = 'A:' "
        f"THEN {_strip('substr(s, 3)')} ELSE s END AS s FROM s{last})"
    )
    steps.append(f"sane AS (SELECT {keys}, regexp_replace(s, '{SPACE}+', ' ', 'g') AS s FROM labelled)")
    return ",\n  ".join(steps)


def _clean(raw: str, source: str, keys: str) -> str:
    """CTEs to ``clean(keys, s)``."""
    return f"""c0 AS (SELECT {keys}, {_strip(f"coalesce({raw}, '')")} AS s FROM {source}),
  c1 AS (SELECT {keys}, CASE WHEN starts_with(lower(s), 'answer:') THEN {_strip("substr(s, 8)")} ELSE s END AS s FROM c0),
  c2 AS (SELECT {keys}, CASE WHEN starts_with(s, 'A:') THEN {_strip("substr(s, 3)")} ELSE s END AS s FROM c1),
  clean AS (SELECT {keys}, CASE WHEN starts_with(s, 'Q:') AND contains(s, 'A:')
    THEN {_strip("substr(s, instr(s, 'A:') + 2)")} ELSE s END AS s FROM c2)"""


_DOCS_ASKED = "asked AS (SELECT item_id AS query_id, text AS question FROM benchmark)"
_WORDS_ASKED = f"""asked AS (SELECT DISTINCT word AS query_id, word AS question
  FROM (SELECT unnest({_tokens("text")}) AS word FROM benchmark))"""
_DOCS = _bm25("documents", "doc_id", "text", "asked")
_TOP_DOCS = _ranked("lexical", "score DESC, doc_pos DESC").replace("doc_pos, score FROM", "doc_pos AS doc_id, score FROM", 1)

SQL: dict[str, str] = {
    "faq_normalize": f"WITH {CORPUS} SELECT doc_pos, question, answer FROM corpus",
    "csv_round_trip": f"WITH {CORPUS} SELECT doc_pos, question, answer FROM corpus",
    "csv_splits": f"""WITH {CORPUS}, several AS (
    SELECT doc_pos, p.answer || chr(10) || '"' || p.question || '",' || chr(10) || chr(10) || p.answer AS answer FROM pairs p)
  SELECT doc_pos, c.question, {_strip("s.answer")} AS answer FROM several s JOIN corpus c USING (doc_pos)""",
    "doc_ids": f"""WITH {PAIRS} SELECT doc_pos,
  'qa_' || CAST(row_number() OVER (ORDER BY doc_pos) - 1 AS VARCHAR) AS id, question FROM pairs""",
    "tokens": f"""SELECT doc_id, CAST(generate_subscripts(words, 1) - 1 AS INTEGER) AS pos, unnest(words) AS token
  FROM (SELECT doc_id, {_tokens("text")} AS words FROM documents)""",
    "bm25_term_freq": f"""SELECT doc_id, term, count(*) AS tf
  FROM (SELECT doc_id, unnest({_tokens("text")}) AS term FROM documents) GROUP BY doc_id, term""",
    "bm25_doc_stats": f"""WITH l AS (SELECT doc_id, CAST(len({_tokens("text")}) AS BIGINT) AS dl FROM documents)
  SELECT doc_id, dl, round((SELECT sum(dl)::DOUBLE / count(*) FROM l), 6) AS avgdl FROM l""",
    "bm25_idf": f"""WITH freqs AS (
    SELECT DISTINCT doc_id, unnest({_tokens("text")}) AS term FROM documents),
  counts AS (SELECT term, count(*) AS df FROM freqs GROUP BY term),
  raw AS (SELECT term, df, ln((SELECT count(*) FROM documents) - df + 0.5e0) - ln(df + 0.5e0) AS idf FROM counts)
  SELECT term, df, round(CASE WHEN idf < 0 THEN 0.25e0 * (SELECT avg(idf) FROM raw) ELSE idf END, 6) AS idf FROM raw""",
    "index_postings": f"""WITH {_DOCS_ASKED}, {_DOCS}
  SELECT f.doc_pos AS doc_id, f.term, f.tf, CAST(l.dl AS BIGINT) AS dl
  FROM freqs f JOIN lengths l ON l.doc_pos = f.doc_pos""",
    "bm25_topk": f"WITH {_DOCS_ASKED}, {_DOCS} {_TOP_DOCS}",
    "bm25_topk_padded": f"WITH {_WORDS_ASKED}, {_DOCS} {_TOP_DOCS}",
    "semantic_topk": f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS embedding FROM embeddings),
  {_distances("v", "v")} {_ranked("dense", "score, doc_pos").replace("doc_pos, score FROM", "doc_pos AS vec_id, score FROM", 1)}""",
    "vector_add": f"""WITH {PAIRS} SELECT 'qa_' || CAST(doc_pos AS VARCHAR) AS id, answer AS document, question,
  CAST(CASE WHEN turn = 0 THEN 1 ELSE 2 END AS INTEGER) AS batch FROM pairs""",
    "collection_count": f"WITH {PAIRS} SELECT count(*) AS n FROM pairs",
    "hash_embed": f"""WITH {PAIRS}, {_hashed("v", "pairs", "doc_pos", "answer")}
  SELECT id AS doc_pos, CAST(i AS INTEGER) AS dim, round(embedding[i + 1], 6) AS weight
  FROM v CROSS JOIN (SELECT unnest(range({DIM})) AS i) WHERE embedding[i + 1] > 0""",
    "hybrid_topk": f"WITH {PLAIN}, {_hybrid('asked')} SELECT query_id, method, rank, doc_pos, score FROM hits",
    "mode_dispatch": f"WITH {MIXED}, {_hybrid('asked')} SELECT query_id, method, rank, doc_pos, score FROM hits",
    "jaccard_rerank": f"""WITH {PLAIN}, {_hybrid('asked')}, {ITEMS}
  SELECT query_id, final_rank, method, rank, doc_pos, round(rerank_score, 6) AS rerank_score FROM items""",
    "context_block": f"""WITH {PLAIN}, {_hybrid('asked')}, {ITEMS}
  SELECT query_id, {_CONTEXT} AS context FROM items GROUP BY query_id""",
    "prompt_render": f"""WITH {PAIRS} SELECT doc_pos AS query_id,
  {_prompt("'Q: ' || question || chr(10) || 'A: ' || answer", "question")} AS prompt FROM pairs""",
    "rag_prompts": f"""WITH {MIXED}, {_hybrid('asked')}, {ITEMS},
  blocks AS (SELECT query_id, {_CONTEXT} AS context FROM items GROUP BY query_id)
  SELECT query_id, {_prompt("coalesce(context, '')", "question")} AS prompt
  FROM asked LEFT JOIN blocks USING (query_id)""",
    "generated_answers": f"""WITH {PLAIN}, {_hybrid('asked')}, {ITEMS},
  drafts AS (SELECT query_id, 'A: ' || answer AS raw FROM items WHERE final_rank = 1),
  {_sanitize("raw", "drafts", "query_id")} SELECT query_id, s AS answer FROM sane""",
    "strip_prompt": f"""WITH {PAIRS} SELECT conv_id, turn,
  {_strip(f"replace({_case(GENERATED_FORMS)}, question, '')")} AS cleaned FROM pairs""",
    "sanitize_answer": f"""WITH drafts AS (SELECT conv_id, turn, {_case(SANITIZE_FORMS)} AS raw
    FROM conversations WHERE role = 'assistant'),
  {_sanitize("raw", "drafts", "conv_id, turn")} SELECT conv_id, turn, s AS cleaned FROM sane""",
    "clean_answer": f"""WITH drafts AS (SELECT conv_id, turn, {_case(CLEAN_FORMS)} AS raw
    FROM conversations WHERE role = 'assistant'),
  {_clean("raw", "drafts", "conv_id, turn")} SELECT conv_id, turn, s AS cleaned FROM clean""",
    "token_events": f"""WITH {PAIRS}, w AS (
    SELECT conv_id AS session_id, turn AS seq, {_tokens("answer")} AS words FROM pairs)
  SELECT session_id, seq, CAST(pos AS INTEGER) AS pos, CAST(json_object('token', token) AS VARCHAR) AS json
  FROM (SELECT session_id, seq, generate_subscripts(words, 1) - 1 AS pos, unnest(words) AS token FROM w)
  UNION ALL SELECT session_id, seq, CAST(len(words) AS INTEGER),
    CAST(json_object('final', array_to_string(words, ' '), 'session_id', CAST(session_id AS VARCHAR)) AS VARCHAR)
  FROM w""",
    "token_fold": f"""WITH {PAIRS}, joined AS (
    SELECT conv_id AS session_id, turn AS seq, array_to_string({_tokens("answer")}, ' ') AS raw FROM pairs),
  {_clean("raw", "joined", "session_id, seq")} SELECT session_id, seq, s AS final FROM clean""",
    "session_history": f"""WITH {PAIRS} SELECT conv_id AS session_id, turn // 4 AS page, count(*) AS n,
  string_agg(question || ' => ' || answer, ' | ' ORDER BY turn) AS history FROM pairs GROUP BY conv_id, turn // 4""",
    "index_tables": f"""WITH {CORPUS}, w AS (SELECT {_tokens("question")} AS words FROM corpus),
  texts AS (SELECT DISTINCT words FROM w)
  SELECT 'corpus' AS name, count(*) AS n FROM corpus
  UNION ALL SELECT 'docs', count(*) FROM corpus
  UNION ALL SELECT 'texts', count(*) FROM texts
  UNION ALL SELECT 'postings', CAST(sum(len(list_distinct(words))) AS BIGINT) FROM texts
  UNION ALL SELECT 'terms', count(DISTINCT term) FROM (SELECT unnest(words) AS term FROM texts)
  UNION ALL SELECT 'vectors', count(answer) FROM corpus""",
    "stream_answers": f"""WITH {USER_TURNS}, {_hybrid('asked')}, {ITEMS},
  drafts AS (SELECT query_id, 'A: ' || answer AS raw FROM items WHERE final_rank = 1),
  {_sanitize("raw", "drafts", "query_id")}
  SELECT CAST(a.query_id AS VARCHAR) AS request_id, CAST(a.conv_id AS VARCHAR) AS session_id,
    a.question AS "user", s.s AS assistant FROM asked a JOIN sane s USING (query_id)""",
}

# an index that grew in steps, or was reopened, answers like one that was built at once
SQL["vector_reopen"] = SQL["semantic_topk"]
SQL["bm25_topk_added"] = SQL["bm25_topk"]
SQL["add_then_answer"] = SQL["context_block"]
SQL["stream_history"] = f"""WITH {PAIRS}, numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq FROM pairs)
  SELECT CAST(conv_id AS VARCHAR) AS session_id, seq // 4 AS page, count(*) AS n,
    string_agg(question || ' => ' || answer, ' | ' ORDER BY seq) AS history FROM numbered GROUP BY conv_id, seq // 4"""
SQL["model_answers"] = f"""WITH {MIXED}, {_hybrid('asked')}, {ITEMS},
  blocks AS (SELECT query_id, {_CONTEXT} AS context FROM items GROUP BY query_id),
  counted AS (SELECT query_id, len({_tokens(_prompt("coalesce(context, '')", "question"))}) AS words
    FROM asked LEFT JOIN blocks USING (query_id))
  SELECT query_id, CASE WHEN words % 10 <> 0 THEN words || ' words' END AS answer,
    CASE WHEN words % 10 = 0 THEN 'ValueError: round number' END AS error FROM counted"""
SQL["bm25_topk_pruned"] = SQL["bm25_topk"]
SQL["semantic_topk_cells"] = SQL["semantic_topk"]
_DEEP = MIXED.replace("CASE WHEN conv_id % 5 = 0", "CASE WHEN conv_id = 7 THEN 1000000 WHEN conv_id % 5 = 0")
SQL["deep_request"] = f"""WITH {_DEEP}, {_hybrid('asked').replace("rank <= 10)", "rank <= 1000000)")}
  SELECT query_id, method, rank, doc_pos, score FROM hits"""
SQL["ann_quality"] = """SELECT count(*) AS n_questions, 3 * count(*) AS n_rows, CAST(0 AS BIGINT) AS n_wrong_distances,
  true AS recalled FROM embeddings"""
SQL["event_files"] = SQL["token_fold"]

"""Text functions as native column expressions.

Every step refers to its input column once, so that chains stay linear in size
and inside code generation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space, the labels a generator may
# echo, and the layout of a context item.
WHITESPACE = r"[\s\x1c-\x1f]"
_UNICODE = "(?U)"  # makes \s match all Unicode white space
ECHO_MARKERS = ["Context:", "CONTEXT:", "\nUser:", "\nAssistant:", "\nUSER:", "\nASSISTANT:"]
QUESTION_LABEL = "Q: "
ANSWER_LABEL = "A: "
ITEM_SEPARATOR = "\n\n"

DEFAULT_TEMPLATE = (
    "You answer questions from the reference items below and from nothing else. "
    "Be brief and polite; if the items do not hold the answer, say that you do not know.\n\n"
    "Reference items:\n{context}\n\n"
    "Question:\n{question}\n\n"
    "Answer:\n"
)


def strip(text: Column) -> Column:
    """Drop leading and trailing Unicode white space."""
    return F.regexp_replace(text, f"{_UNICODE}^{WHITESPACE}+|{WHITESPACE}+$", "")


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(strip(text), f"{_UNICODE}{WHITESPACE}+", " ")


def normalize_question(text: Column) -> Column:
    """Strip, first character upper case, all others lower case."""
    head = F.regexp_replace(text, f"{_UNICODE}^{WHITESPACE}+", "")
    body = strip(text)
    return F.concat(F.upper(F.substring(head, 1, 1)), F.lower(F.substring(body, 2, 2**31 - 1)))


def tokens(text: Column) -> Column:
    """Lexical tokens: split on white space, case and punctuation kept, no empty tokens."""
    return F.array_remove(F.split(text, f"{_UNICODE}{WHITESPACE}+"), "")


def token_set(text: Column | str) -> Column:
    """Distinct lower-cased tokens, as the reranker compares them."""
    return F.array_distinct(tokens(F.lower(text)))


def jaccard(left_set: Column, right_set: Column) -> Column:
    """Jaccard similarity of two token sets; two empty sets give 0."""
    shared = F.size(F.array_intersect(left_set, right_set))
    either = F.size(F.array_union(left_set, right_set))
    return F.coalesce(F.try_divide(shared.cast("double"), either.cast("double")), F.lit(0.0))


def context_item(question: Column, answer: Column) -> Column:
    return F.concat(F.lit(QUESTION_LABEL), question, F.lit("\n" + ANSWER_LABEL), answer)


def render_prompt(template: str, context: Column, question: Column) -> Column:
    """Fill the template's two slots; values that look like slots stay as they are."""
    slots = {"{context}": context, "{question}": question}
    parts = [p for p in re.split(r"(\{context\}|\{question\})", template) if p]
    return F.concat(
        *[
            F.coalesce(slots[p], F.lit("")) if p in slots
            else F.lit(p.replace("{{", "{").replace("}}", "}"))
            for p in parts
        ]
    )


def strip_prompt(generated: Column, prompt: Column) -> Column:
    """Remove every copy of the prompt from the generated text."""
    return strip(F.replace(generated, prompt, F.lit("")))


def sanitize_answer(text: Column) -> Column:
    """Server-side clean-up of a generated answer."""
    s = strip(F.coalesce(text, F.lit("")))
    # a transcript: keep what follows the last answer label
    s = strip(F.regexp_replace(s, "(?s)^[Qq]:.*A:", ""))
    for marker in ECHO_MARKERS:
        s = strip(F.substring_index(s, marker, 1))
    s = F.regexp_replace(s, "^[Aa]:", "")
    return collapse_whitespace(s)


def clean_answer(text: Column) -> Column:
    """Client-side clean-up: case and first/last rules differ from the server's."""
    s = strip(F.coalesce(text, F.lit("")))
    s = strip(F.regexp_replace(s, "(?i)^answer:", ""))
    s = strip(F.regexp_replace(s, "^A:", ""))
    return strip(F.regexp_replace(s, "(?s)^Q:.*?A:", ""))

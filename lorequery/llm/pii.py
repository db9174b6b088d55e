"""Personal data: base patterns, and identifiers found by bootstrapping from them.

Base matches are the seeds. Words around them, with what is glued to the front of a token,
make lexical patterns; tokens with digits or an @ are the possible instances. Spark
scores the graph of patterns and instances in rounds: a pattern is as good as the
instances it meets, an instance as good as the patterns that meet it. Tokens in
patterns of high confidence that no base pattern covers are reported as ``context``.
Everything is DataFrame expressions; no text leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequery.llm.common import free_name, materialize
from lorequery.session import tidied

#: Kinds in the order in which they are listed at equal starts.
KINDS = ["email", "ip", "card", "phone", "context"]
# The loops are possessive and start where a run starts, which finds the same matches
# as plain greedy loops but takes linear time on long runs. \G: right after the match before.
_LOCAL = "A-Za-z0-9._%+-"
_SPACE = r"\x20\x09-\x0D"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # a token with a digit or an @, from the start of the token
    "token": rf"(?<![^{_SPACE}])[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+",
}
#: Characters kept of the text before a token.
CONTEXT_CHARS = 64
ROUNDS = 3
#: A pattern counts from this confidence, met by this many good instances.
CONFIDENCE, SUPPORT = 0.6, 3.0
#: An unseen identifier has so many characters and digits at least.
MIN_CHARS, MIN_DIGITS = 6, 3
_DAMPING = 0.9


def _pieces(text: Column, kind: str) -> Column:
    """Matches in order, each with the length and the end of the text since the match before."""
    pattern = F.lit(PATTERNS[kind])
    # one gap more than matches: the zipped last one has no match and is dropped
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("value"), F.split(text, PATTERNS[kind], -1).alias("gap")
    )
    return F.transform(
        F.filter(pairs, lambda p: p["value"].isNotNull()),
        lambda p, i: F.struct(
            F.lit(kind).alias("kind"),
            i.cast("int").alias("at"),
            p["value"].alias("value"),
            F.length(p["gap"]).alias("skipped"),
            F.right(p["gap"], F.lit(CONTEXT_CHARS)).alias("left"),
        ),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, less 9 above 9; the sum ends in 0."""
    places = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 1, (d.cast("int") * 2) - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(
            d.cast("int")
        ),
    )
    return F.aggregate(places, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    """The checks that a match has to pass besides its pattern."""
    digits = _digits(value)
    n = F.length(digits)
    # parts of any length: leading zeros aside, three digits at most
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255"))))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", small)
        .when(kind == "card", n.between(14, 19) & _luhn(digits))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(F.lit(False))
    )


def _matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written table of all matches with code point offsets; a document without one has a row of nulls.

    ``row`` tells input rows apart, ``digest`` texts of one id.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    every = F.concat(*[_pieces(F.col("text"), kind) for kind in PATTERNS])
    found = rows.select(
        "row",
        "id",
        F.xxhash64("text").alias("digest"),
        # no pattern can match without one of these
        F.inline_outer(F.when(F.col("text").rlike("[0-9@]"), every)),
    )
    running = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("skipped") + F.length("value")).over(running).cast("int")
    placed = found.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    return materialize(
        placed.withColumn("base", F.coalesce(_valid(F.col("kind"), F.col("value")), F.lit(False))).drop("skipped", "at"),
        "pii-matches",
    )


def _occurrences(matches: DataFrame) -> DataFrame:
    """Tokens with their instance, patterns, and whether a base span covers a part of them."""
    spans = matches.filter("base or kind = 'token'")
    place = Window.partitionBy("row").orderBy("start")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(place.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(place.rangeBetween(0, Window.unboundedFollowing))
    covered = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    tokens = spans.withColumn("seed", covered).filter("kind = 'token'")
    glued = F.regexp_extract("value", r"""^(?:[^0-9@]*[=:"'(\[<])?""", 0)
    tokens = tokens.withColumn("glued", glued)
    instance = F.regexp_replace(
        F.substring("value", F.length("glued") + 1, F.length("value")), r"""[.,;:!?"')\]>]+$""", ""
    )
    words = F.filter(F.split(F.lower("left"), rf"[{_SPACE}]+"), lambda w: w != "")
    last = F.coalesce(F.get(F.reverse(words), F.lit(0)), F.lit("^"))
    second = F.coalesce(F.get(F.reverse(words), F.lit(1)), F.lit("^"))
    near = F.concat_ws(" ", last, F.lower("glued"))
    return tokens.select(
        "row",
        "id",
        "digest",
        "seed",
        (F.col("start") + F.length("glued")).alias("start"),
        instance.alias("instance"),
        F.array(near, F.concat_ws(" ", second, near)).alias("patterns"),
    )


def score_graph(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Confidence of patterns and scores of instances after the rounds.

    ``edges``: ``pattern, instance, seed``, one row per pair. Each round has two aggregates over
    the edges; the scores are written tables, so a lost executor costs at most one round.
    """
    instances = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    patterns = None
    for _ in range(rounds):
        patterns = materialize(
            edges.join(instances, "instance")
            .groupBy("pattern")
            .agg(F.sum("score").alias("support"), (F.sum("score") / (F.count(F.lit(1)) + 1)).alias("confidence")),
            "pii-patterns",
        )
        good = F.when(F.col("support") >= SUPPORT, F.col("confidence")).otherwise(F.lit(0.0))
        missed = F.exp(F.sum(F.log(1 - _DAMPING * good)))
        instances = materialize(
            edges.join(patterns, "pattern")
            .groupBy("instance")
            .agg(F.greatest(F.max(F.col("seed").cast("double")), 1 - missed).alias("score")),
            "pii-instances",
        )
    return patterns, instances


@tidied
def _discovered(matches: DataFrame) -> DataFrame:
    """Spans of identifiers that no base pattern covers: ``row, id, digest, start, end``."""
    occurrences = materialize(_occurrences(matches), "pii-tokens")
    edges = materialize(
        occurrences.select(F.explode(F.array_distinct("patterns")).alias("pattern"), "instance", "seed")
        .groupBy("pattern", "instance")
        .agg(F.max("seed").alias("seed")),
        "pii-edges",
    )
    patterns, instances = score_graph(edges)
    confident = patterns.filter((F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT)).select("pattern")
    shaped = (F.length("instance") >= MIN_CHARS) & (F.length(_digits(F.col("instance"))) >= MIN_DIGITS)
    fresh = occurrences.filter(~F.col("seed") & shaped)
    likely = instances.filter(F.col("score") >= CONFIDENCE * _DAMPING).select("instance")
    return (
        fresh.withColumn("pattern", F.explode("patterns"))
        .join(confident, "pattern")
        .join(likely, "instance", "left_semi")
        .select("row", "id", "digest", "start", (F.col("start") + F.length("instance")).alias("end"))
        .distinct()
    )


@tidied
def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest, spans`` per input row; ``spans`` is an array of ``start, order, end, kind``.

    Offsets are code points, ends exclusive; the array is sorted by start, then kind in the order of
    ``KINDS``. Null and empty texts have no spans; rows are never merged, so repeated ids
    stay repeated. ``digest`` is a hash of the text, which tells texts of one id apart.
    """
    matches = _matches(docs, id_col, text_col)
    added = _discovered(matches)
    base = matches.filter("base").select("row", "id", "digest", "kind", "start", "end")
    every = matches.select("row", "id", "digest").distinct()
    spans = base.unionByName(added.withColumn("kind", F.lit("context"))).unionByName(
        every, allowMissingColumns=True
    )
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    span = F.when(
        F.col("kind").isNotNull(), F.struct("start", order.alias("order"), "end", "kind")
    )
    # a group holds the spans of one document
    return (
        spans.groupBy("row", "id", "digest")
        .agg(F.sort_array(F.collect_list(span)).alias("spans"))
        .select(F.col("id").alias(id_col), "digest", "spans")
    )


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@tidied
def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets, overlapping spans by one; same columns.

    Null texts stay null. Rows with equal id and text share their spans.
    """
    key, digest, spans = (free_name(docs, name) for name in ("span_id", "span_digest", "spans"))
    found = (
        find_spans(docs, id_col, text_col)
        .filter(F.size("spans") > 0)
        .select(F.col(id_col).alias(key), F.col("digest").alias(digest), F.col("spans").alias(spans))
        .dropDuplicates([key, digest])
    )
    text = F.col(text_col)
    # pieces between spans and marks, with the end of what is covered so far
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("upto"))

    def add(state: Column, s: Column) -> Column:
        apart = s["start"] >= state["upto"]
        between = F.substring(text, state["upto"] + 1, s["start"] - state["upto"])
        marked = F.concat(state["out"], between, F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(
            F.when(apart, marked).otherwise(state["out"]).alias("out"),
            F.greatest(state["upto"], s["end"]).alias("upto"),
        )

    def close(state: Column) -> Column:
        return F.concat(state["out"], F.substring(text, state["upto"] + 1, F.length(text)))

    masked = F.when(F.col(spans).isNull(), text).otherwise(F.aggregate(F.col(spans), start, add, close))
    same = F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(digest))
    return docs.join(found, same, "left").withColumn(text_col, masked).select(*docs.columns)

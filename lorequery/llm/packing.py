"""Mixture-controlled packing of token streams into sequences.

Each source is a queue of documents. Deficit round-robin gives every queue a quantum of
tokens per window, in proportion to its target share; what a queue does not use is
carried over. Served tokens of a queue up to a document decide in which window it goes:
the first one by whose end the queue's summed quanta cover it. So the schedule
follows from running totals per source, whatever the number of windows and
partitions, and deficits carry over both.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lorequery.llm.common import BATCH_TEXTS, batches_of, materialize, running_total
from lorequery.session import scratch_path, tidied

SEQUENCE_TOKENS = 1024
#: Tokens of a window, in which every source gets its share.
WINDOW_TOKENS = 64 * SEQUENCE_TOKENS
END_ID = 0
#: Window of the sources that no window has a share for.
LAST_WINDOW = 1 << 62
#: Longest text for the rank-file encoder; longer ones go to the slower one, whose stack use is constant.
_FAST_CHARS = 1 << 20


@lru_cache(maxsize=2)
def _fast_encoder(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _encoder(json_path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(json_path)
    tokenizer.encode_special_tokens = True
    return tokenizer


class BytePairEncoder:
    """Ids of a byte-level BPE vocabulary given as a tokenizer file and as a rank file of the same ids.

    The rank file is encoded several times faster. Strings of special tokens are ordinary text.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str) -> None:
        self.json_path, self.ranks_path, self.pattern = json_path, ranks_path, pattern

    def id_type(self) -> str:
        """Little-endian type that holds every id of the vocabulary."""
        return "<u2" if _encoder(self.json_path).get_vocab_size() <= 1 << 16 else "<u4"

    def __call__(self, text: str) -> list[int]:
        if len(text) > _FAST_CHARS:
            return _encoder(self.json_path).encode(text, add_special_tokens=False).ids
        return _fast_encoder(self.ranks_path, self.pattern).encode_ordinary(text)


def encode_documents(
    docs: DataFrame, encode: BytePairEncoder, id_col: str, text_col: str, source_col: str
) -> DataFrame:
    """A written table ``row, id, source, n_tokens, ids``: ids of the encoder's type, the end id last."""
    id_type = encode.id_type()

    def tokens(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids = [np.array([*encode(text or ""), END_ID], dtype=id_type) for text in part["text"]]
            yield pd.DataFrame(
                {
                    "id": part["id"],
                    "source": part["source"],
                    "n_tokens": [len(own) for own in ids],
                    "ids": [own.tobytes() for own in ids],
                }
            )

    kind = dict(docs.dtypes)[id_col]
    encoded = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.col(text_col).alias("text"),
    ).mapInPandas(tokens, f"id {kind}, source string, n_tokens long, ids binary")
    path = scratch_path(docs.sparkSession, "tokens")
    with batches_of(docs.sparkSession, BATCH_TEXTS):
        numbered = encoded.withColumn("row", F.monotonically_increasing_id())
        numbered.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(numbered.schema).parquet(path)


@tidied
def schedule(tokens: DataFrame, targets: dict[str, float] | None, window_tokens: int) -> DataFrame:
    """Place of every document in the packed stream: ``row, window, position``.

    ``targets`` are weights by source, whatever their sum; sources without one share
    like their tokens do. Without targets every window has the proportions of the corpus.
    Once a queue is empty the others go on; a queue of weight 0 comes after all others.
    """
    narrow = tokens.select("row", "id", "source", "n_tokens")
    sums = narrow.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    total = sums.agg(F.sum("source_tokens")).first()[0] or 1
    weight = F.col("source_tokens") / F.lit(float(total))
    for source, own in (targets or {}).items():
        weight = F.when(F.col("source") == source, F.lit(float(own))).otherwise(weight)
    quanta = sums.select("source", (weight * window_tokens).alias("quantum"))
    queued = running_total(narrow, ["source"], ["id", "row"], F.col("n_tokens"), "served", "queues")
    placed = queued.join(quanta, "source").select(
        "row",
        "source",
        "n_tokens",
        "served",
        F.when(F.col("quantum") > 0, F.ceil((F.col("served") + F.col("n_tokens")) / F.nullif("quantum", F.lit(0.0))))
        .otherwise(F.lit(LAST_WINDOW))
        .cast("long")
        .alias("window"),
    )
    placed = materialize(placed, "windows")
    stream = running_total(
        placed, [], ["window", "source", "served", "row"], F.col("n_tokens"), "position", "stream"
    )
    return stream.select("row", "window", "position")


@tidied
def pack_documents(
    docs: DataFrame,
    encode: BytePairEncoder,
    targets: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    sequence_tokens: int = SEQUENCE_TOKENS,
    window_tokens: int = WINDOW_TOKENS,
) -> DataFrame:
    """Pieces of documents in sequences: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, source``.

    The scheduled documents form one stream that is cut every ``sequence_tokens``
    tokens, so only the very last sequence is short. A null text is empty and has its
    end id only; a null source is the queue of the empty name; repeated ids are
    separate documents, in the order in which they are read. No documents give no pieces.
    """
    tokens = encode_documents(docs, encode, id_col, text_col, source_col)
    plan = schedule(tokens, targets, window_tokens)
    id_type = encode.id_type()
    kind = dict(tokens.dtypes)["id"]

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for doc in part.itertuples(index=False):
                ids = np.frombuffer(doc.ids, dtype=id_type).astype("<u4")
                start = 0
                while start < len(ids):
                    at = doc.position + start
                    room = sequence_tokens - at % sequence_tokens
                    piece = ids[start : start + room]
                    crc = zlib.crc32(piece.tobytes())
                    out.append(
                        (doc.id, start, len(piece), crc, len(ids), at // sequence_tokens, at % sequence_tokens,
                         doc.window, doc.source)
                    )
                    start += len(piece)
            yield pd.DataFrame(out, columns=columns)

    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "source"]
    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in columns[1:-1]) + ", source string"
    # one plan at every size: a broadcast would end where the schedule outgrows it
    joined = tokens.join(plan.hint("merge"), "row").select("id", "ids", "position", "window", "source")
    with batches_of(docs.sparkSession, BATCH_TEXTS):
        pieces = materialize(joined.mapInPandas(cut, schema), "pieces")
    return pieces.withColumnRenamed("id", id_col)

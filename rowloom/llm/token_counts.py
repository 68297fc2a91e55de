"""Token counts of the parts of a document, from one encoding of the whole document.

A document is the concatenation of its parts (fields, sections, lines). It is encoded once, as a model would read it, so
that merges across part boundaries are kept. The bytes of the tokens give their spans, an interval join with the
spans of the parts says where each token lies, and a token that crosses a boundary is allocated by a stated rule.
The join happens inside the row's own task, since both sides come from the same document: nothing is shuffled.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .registry import query, table
from .words import list_array

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# fixed value: how this family of vocabularies cuts a text before merging
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "last", "largest", "split")
GROUP_ROWS = 200  # documents whose parts are held as numbers at the same time

_loaded: dict[int, tuple] = {}


def read_vocabulary(path: str) -> bytes:
    """The rank file, read once by the driver; a bounded file that travels to the executors."""
    with open(path, "rb") as f:
        return f.read()


def _encoder(data: bytes):
    """The encoder of a rank file and the number of bytes of each token."""
    if id(data) not in _loaded:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _loaded.clear()
        _loaded[id(data)] = (tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes)
    return _loaded[id(data)]


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each part, and how many of the tokens that touch it cross one of its boundaries.

    Tokens are the spans [start, end), parts lie between consecutive bounds; empty parts get none. ``first`` and ``last`` give a
    crossing token to the part of its first or last byte, ``largest`` to the part with most of its bytes (the earlier
    one of equals), ``split`` to all of them in proportion to the bytes.
    """
    parts = len(bounds) - 1
    a = np.searchsorted(bounds, starts, "right") - 1
    b = np.searchsorted(bounds, ends - 1, "right") - 1
    counts = np.bincount(b if rule == "last" else a, minlength=parts).astype(np.float64) if len(a) else np.zeros(parts)
    crossing = np.zeros(parts, np.int64)
    for t in np.flatnonzero(a != b):
        touched = np.arange(a[t], b[t] + 1)
        inside = np.minimum(bounds[touched + 1], ends[t]) - np.maximum(bounds[touched], starts[t])
        crossing[touched[inside > 0]] += 1
        if rule in ("largest", "split"):
            counts[a[t]] -= 1
        if rule == "largest":
            counts[touched[inside.argmax()]] += 1
        if rule == "split":
            counts[touched] += inside / inside.sum()
    return counts, crossing


def count_tokens(docs: DataFrame, parts: Column, id_col: str = "doc_id", vocabulary: str = VOCABULARY, rule: str = "largest") -> DataFrame:
    """One row per part of each input row: id, part (0, 1, ...), start and end (characters in the document), tokens, crossing, document_tokens.

    ``parts`` is an array of strings; the document is their concatenation and null parts count as empty. A null array is a document without
    parts and gives one row with a null part and no tokens, as does an empty array. Repeated rows are counted each. Other columns
    are ignored; an empty table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    rows = docs.select(F.col(id_col).alias("id"), parts.alias("parts"))

    def encode(batches):
        encoder, sizes = _encoder(shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, GROUP_ROWS):
                part = batch.slice(low, GROUP_ROWS)
                chars, counts, crossings, totals = [], [], [], []
                for texts in part.column("parts").to_pylist():
                    texts = [x or "" for x in texts or []]
                    tokens = np.asarray(encoder.encode_ordinary("".join(texts)), np.int64)
                    ends = np.cumsum(sizes[tokens])
                    bounds = np.concatenate([[0], np.cumsum([len(x.encode()) for x in texts])]).astype(np.int64)
                    n, crossing = attribute(ends - sizes[tokens], ends, bounds, rule)
                    chars.append(np.cumsum([len(x) for x in texts]).astype(np.int64))
                    counts.append(n)
                    crossings.append(crossing)
                    totals.append(len(tokens))
                yield pa.record_batch({
                    "id": part.column("id"), "ends": list_array(chars, pa.int64()), "tokens": list_array(counts, pa.float64()),
                    "crossing": list_array(crossings, pa.int64()), "document_tokens": pa.array(totals, pa.int64()),
                })

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(encode, f"id {kind}, ends array<bigint>, tokens array<double>, crossing array<bigint>, document_tokens bigint")
    each = found.select("id", "document_tokens", F.posexplode_outer(F.arrays_zip("ends", "tokens", "crossing")).alias("part", "x"), "ends")
    start = F.when(F.col("part") > 0, F.element_at("ends", F.col("part"))).when(F.col("part") == 0, F.lit(0))
    tokens = F.coalesce("x.tokens", F.lit(0.0))
    return each.select(
        F.col("id").alias(id_col), "part", start.cast("bigint").alias("start"), F.col("x.ends").alias("end"),
        (tokens if rule == "split" else tokens.cast("bigint")).alias("tokens"), F.coalesce("x.crossing", F.lit(0)).cast("bigint").alias("crossing"), "document_tokens",
    )


def lines(text_col: str = "text") -> Column:
    """The lines of a text, each with the line break that ends it."""
    return F.split(F.col(text_col), r"(?<=\n)")


@query("op6_token_counts")
def op6_token_counts(spark, sf):
    return count_tokens(table(spark, sf, "documents"), lines())

"""Language identification by prediction by partial matching.

For each language a tree of byte contexts, up to four bytes and never across the start of a word, is counted from a
bounded sample of labelled texts. A byte costs -log2 of its share in the longest context in which it was seen;
every longer context that was seen without it adds the cost of an escape (method C: as likely as the number of
different bytes seen there). The trees are frozen, so the code length of a word is a constant: each task
computes it once for each distinct word of a slice and adds it up over whole texts. The shortest total wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..operators.joins import lookup
from .common import fold, unit
from .registry import query, table
from .words import pieces, split_words

ORDER = 4
SAMPLE_ROWS = 400  # whole texts of each language
NEVER = 8.0  # bits of a byte that no context has seen


def _positions(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each word, written with a space on both sides and without the first: the byte and up to
    ``ORDER`` bytes before it packed into one number, and the word. Words without letters have none."""
    plain = pc.replace_substring_regex(pc.utf8_lower(vocab), r"\P{L}+", "")
    padded = pc.if_else(pc.greater(pc.binary_length(plain), 0), pc.binary_join_element_wise(" ", plain, " ", ""), "").cast(pa.large_binary())
    bounds = np.frombuffer(padded.buffers()[1], np.int64)[padded.offset : padded.offset + len(padded) + 1]
    raw = padded.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]].astype(np.uint64) if raw is not None and len(padded) else np.empty(0, np.uint64)
    sizes = np.diff(bounds)
    word = np.repeat(np.arange(len(padded)), sizes)
    at = np.arange(len(data)) - np.repeat(bounds[:-1] - bounds[0], sizes)
    keys = data.copy()
    for d in range(1, ORDER + 1):
        held = at >= d
        keys[held] |= data[np.flatnonzero(held) - d] << np.uint64(8 * d)
    return keys[at > 0], word[at > 0]


def _shorter(keys: np.ndarray, length: int) -> np.ndarray:
    """The last ``length`` bytes of each packed number."""
    return keys & np.uint64((1 << (8 * length)) - 1)


class ContextTrees:
    """Frozen counts of all languages: ``grams`` (packed context and byte), ``counts`` per language."""

    def __init__(self, langs: list[str], grams: np.ndarray, counts: np.ndarray, full: np.ndarray):
        self.langs, self.grams, self.counts = langs, grams, counts
        above = grams >> np.uint64(8)
        # the context of no bytes has key 0 for itself; single bytes lie in it
        self.contexts, of = np.unique(above, return_inverse=True)
        self.totals = np.zeros((len(self.contexts), len(langs)))
        self.kinds = np.zeros_like(self.totals)
        np.add.at(self.totals, of, counts)
        np.add.at(self.kinds, of, counts > 0)
        self.known = full
        self.known_cost = self.slow_cost(full).astype(np.float32)

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
        return at, (table[at] == keys if len(table) else np.zeros(len(keys), bool))

    def slow_cost(self, keys: np.ndarray) -> np.ndarray:
        """Bits of each byte after its context, from the longest context down."""
        cost = np.zeros((len(keys), len(self.langs)))
        open_ = np.ones(cost.shape, bool)
        for length in range(ORDER + 1, 0, -1):
            mine = _shorter(keys, length)
            present = np.ones(len(keys), bool) if length == 1 else (keys >> np.uint64(8 * (length - 1))) & np.uint64(255) > 0
            at, hit = self._find(self.grams, mine)
            ctx, seen = self._find(self.contexts, mine >> np.uint64(8))
            c = np.where((hit & present)[:, None], self.counts[at], 0) if len(self.grams) else np.zeros(cost.shape)
            t = np.where((seen & present)[:, None], self.totals[ctx], 0) if len(self.grams) else np.zeros(cost.shape)
            u = np.where((seen & present)[:, None], self.kinds[ctx], 0) if len(self.grams) else np.zeros(cost.shape)
            got, left = open_ & (c > 0), open_ & (c == 0) & (t > 0)
            cost[got] -= np.log2(c[got] / (t[got] + u[got]))
            cost[left] -= np.log2(u[left] / (t[left] + u[left]))
            open_ &= ~got
        return cost + NEVER * open_

    def word_bits(self, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Code length of each word in each language, and its number of coded bytes."""
        keys, word = _positions(vocab)
        at, hit = self._find(self.known, keys)
        bits = self.known_cost[at] if len(self.known) else np.zeros((len(keys), len(self.langs)), np.float32)
        if (~hit).any():
            rare, back = np.unique(keys[~hit], return_inverse=True)
            bits[~hit] = self.slow_cost(rare)[back]
        out = np.zeros((len(vocab), len(self.langs)))
        for i in range(len(self.langs)):
            out[:, i] = np.bincount(word, bits[:, i], len(vocab))
        return out, np.bincount(word, minlength=len(vocab))


def fit_context_trees(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ContextTrees:
    """Trees from rows (text, lang, draw). Rows without text or language are not used. Each language learns from all its whole
    texts, or from about ``sample_rows`` of them: those whose ``draw``, a number in [0, 1), lies below the wanted share."""
    known = rows.filter("text is not null and lang is not null").select("lang", "text", "draw")
    shares = known.groupBy("lang").agg((F.lit(float(sample_rows)) / F.count(F.lit(1))).alias("share"))
    sample = lookup(known, shares, ["lang"], "inner", salt_by=["draw"]).filter("draw < share")

    def count(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                langs = part.column("lang").dictionary_encode()
                of = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                offsets, codes, vocab = split_words(part.column("text"))
                pairs, times = np.unique(np.repeat(of, np.diff(offsets)) * max(1, len(vocab)) + codes, return_counts=True)
                keys, word = _positions(vocab)
                first = np.searchsorted(word, np.arange(len(vocab) + 1))
                for k, name in enumerate(langs.dictionary.to_pylist()):
                    mine = pairs // max(1, len(vocab)) == k
                    weight = np.zeros(len(vocab))
                    weight[pairs[mine] % max(1, len(vocab))] = times[mine]
                    use = np.repeat(weight, np.diff(first)) > 0
                    k_keys, k_weight = keys[use], np.repeat(weight, np.diff(first))[use]
                    for length in range(1, ORDER + 2):
                        deep = np.ones(len(k_keys), bool) if length == 1 else (k_keys >> np.uint64(8 * (length - 1))) & np.uint64(255) > 0
                        grams, back = np.unique(_shorter(k_keys[deep], length), return_inverse=True)
                        n = np.bincount(back, k_weight[deep], len(grams)).astype(np.int64)
                        yield pa.record_batch({
                            "lang": pa.array([name] * len(grams), pa.string()), "gram": pa.array(grams.view(np.int64)), "n": pa.array(n), "whole": pa.array(np.zeros(len(grams), np.int32)),
                        })
                    grams = np.unique(k_keys)
                    yield pa.record_batch({
                        "lang": pa.array([name] * len(grams), pa.string()), "gram": pa.array(grams.view(np.int64)), "n": pa.array(np.zeros(len(grams), np.int64)), "whole": pa.array(np.ones(len(grams), np.int32)),
                    })

    found = sample.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint, whole int")
    found = found.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.max("whole").alias("whole")).toArrow()  # bounded by the sample
    langs = sorted(set(found["lang"].to_pylist()))
    lang_of = {x: i for i, x in enumerate(langs)}
    gram, n = found["gram"].to_numpy().view(np.uint64), found["n"].to_numpy()
    of = np.array([lang_of[x] for x in found["lang"].to_pylist()], np.int64)
    grams, row = np.unique(gram, return_inverse=True)
    counts = np.zeros((len(grams), len(langs)))
    np.add.at(counts, (row, of), n)
    full = np.unique(gram[found["whole"].to_numpy() > 0]) if len(gram) else gram
    return ContextTrees(langs, grams, counts, full)


def identify(docs: DataFrame, trees: ContextTrees, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and bits_per_byte; columns of these names are replaced.

    ``score`` is the share of the predicted language when each language is as likely as its code length says. Texts that are null or
    have no letter are ``und`` with score 0, as is every text when nothing was learned. Ties go to the first language in order.
    Repeated rows are judged alike; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("struct<lang string, score double, bits double>")
    def judge(texts):
        import pandas as pd

        trees = shared.value
        whole = pa.record_batch({"text": pa.Array.from_pandas(texts, type=pa.string())})
        names, scores, bits = [], [], []
        for part in pieces(whole, "text"):
            offsets, codes, vocab = split_words(part.column("text"), lower=False)
            cost, size = trees.word_bits(vocab)
            rows = np.repeat(np.arange(part.num_rows), np.diff(offsets))
            coded = np.bincount(rows, size[codes], part.num_rows)
            total = np.stack([np.bincount(rows, cost[codes, i], part.num_rows) for i in range(len(trees.langs))], 1) if trees.langs else np.zeros((part.num_rows, 1))
            best = total.argmin(1)
            least = total.min(1)
            share = 1 / np.exp2(-np.minimum(total - least[:, None], 1000)).sum(1)
            for i in range(part.num_rows):
                ok = coded[i] > 0 and bool(trees.langs)
                names.append(trees.langs[best[i]] if ok else "und")
                scores.append(float(share[i]) if ok else 0.0)
                bits.append(float(least[i] / coded[i]) if ok else None)
        return pd.DataFrame({"lang": names, "score": scores, "bits": bits})

    out = docs.withColumn("_judged", judge(F.col(text_col)))
    return out.withColumns({"lang_pred": F.col("_judged.lang"), "score": F.col("_judged.score"), "bits_per_byte": F.col("_judged.bits")}).drop("_judged")


@query("op10_language_id")
def op10_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    learn = docs.filter(fold(F.col("doc_id"), 3) != 1)
    trees = fit_context_trees(learn.select("text", "lang", unit("text", "doc_id").alias("draw")))
    out = identify(docs.select("doc_id", "text"), trees)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "bits_per_byte")

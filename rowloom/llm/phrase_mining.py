"""Phrase collocations by Toivonen's sampling.

A sample of the documents proposes phrases of one to three words, level by level. One pass over all texts counts the candidates: every word,
and every longer phrase whose two largest parts were proposed, which are the proposed phrases and their negative border. Candidates are
counted by hash buckets, so a count can only be too high; what stays below the support is settled. A second pass counts by the
phrases themselves whatever is left, and with it the expansion of the border failures: phrases whose parts came out frequent though they had
not been proposed, so that they were no candidates. All parts of a frequent phrase are frequent, hence reach the second pass, hence so does
the phrase: no third pass can find more.

Proposals and frequent buckets reach the tasks as bit arrays of phrase hashes, of a bounded size. A bit set by another phrase causes
a phrase to be counted in vain, never to be missed, and a phrase is counted at all of its occurrences or at none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.joins import lookup
from ..session import materialize
from .registry import query, table
from .words import _factor, pieces, scramble

LONGEST = 4
SAMPLE_ONE_IN = 8
LOWERED = {1: 0.25, 2: 0.5, 3: 0.5}  # of the support expected in the sample, by the number of words
BITS_A_PHRASE = 16
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27  # 16 MB; the bound holds for any corpus
PART_ENTRIES = 1 << 20  # counts that are added up together, on average
TOP_SALTS = 64

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(_SEPARATORS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """The words of some texts: distinct words, code and text number of each word, and whether it follows the one before in a piece."""

    vocab: pa.Array
    codes: np.ndarray
    texts: np.ndarray
    follows: np.ndarray


def split_pieces(texts: pa.Array) -> Words:
    """Words of texts cut at punctuation and line breaks, then at spaces and tabs; A-Z lower-cased."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = _KIND[data]
    word = kind == 0
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = word[first]
    starts = np.flatnonzero(start)
    bounds = np.append(np.flatnonzero(start[word]), int(word.sum())).astype(np.int64)
    letters = _LOWER[data[word]]
    listed = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
    numbers = np.searchsorted(offsets, starts, side="right") - 1
    cuts = np.cumsum(kind == 2, dtype=np.int64)[starts]
    follows = np.zeros(len(starts), bool)
    follows[1:] = (numbers[1:] == numbers[:-1]) & (cuts[1:] == cuts[:-1])
    return Words(listed.dictionary, listed.indices.to_numpy(zero_copy_only=False).astype(np.int64), numbers, follows)


def _hashes(values: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values.to_pylist()), np.uint64, len(values))


def _phrase_hash(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of phrases given by the hashes of their words."""
    total = np.full(len(parts[0]), len(parts), np.uint64)
    with np.errstate(over="ignore"):
        for i, h in enumerate(parts):
            total += h * _factor(i)
    return scramble(total)


class Marks:
    """A bit array of phrase hashes."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 64 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def mark_buckets(buckets: DataFrame, bucket_bits: int) -> Marks:
    """Bits of the buckets, which are the low bits of phrase hashes; their number sets the size, within fixed bounds."""
    n = buckets.count()
    bits = min(max(1 << (BITS_A_PHRASE * max(n, 1) - 1).bit_length(), LEAST_BITS), MOST_BITS, 1 << bucket_bits)
    at = F.col("bucket").bitwiseAND(F.lit(bits - 1))
    slots = buckets.groupBy(F.shiftright(at, 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bucket & 63 as int))")).alias("bits"))
    found = slots.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Marks(out)


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


class Tokens:
    """The words of a batch (lang, text), each with its language, and the phrases that begin at them."""

    def __init__(self, batch: pa.RecordBatch):
        self.words = split_pieces(batch.column("text"))
        self.langs = batch.column("lang").dictionary_encode()
        self.size = len(self.words.codes)
        self.lang_of = self.langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[self.words.texts]
        if not self.size:
            return
        kinds = len(self.words.vocab)
        self.tokens, self.ids = np.unique(self.lang_of * kinds + self.words.codes, return_inverse=True)
        of_lang = _hashes(self.langs.dictionary.cast(pa.large_binary()))
        self.hashes = scramble(_hashes(self.words.vocab)[self.tokens % kinds] ^ of_lang[self.tokens // kinds])
        self.begins = self.shifted(self.words.follows)  # a pair begins here

    def shifted(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size, bool)
        out[:-1] = flags[1:]
        return out

    def both(self, flags: np.ndarray, k: int) -> np.ndarray:
        """Where a phrase of ``k`` words begins both of whose largest parts are flagged."""
        return flags & self.shifted(flags) & (self.begins if k == 2 else True)

    def phrase_hashes(self, places: np.ndarray, k: int) -> np.ndarray:
        return _phrase_hash([self.hashes[self.ids[places + i]] for i in range(k)])

    def among(self, places: np.ndarray, k: int, marks: Marks) -> np.ndarray:
        """The flagged ``places`` whose phrase is marked."""
        out = np.zeros(self.size, bool)
        at = np.flatnonzero(places)
        out[at] = marks.has(self.phrase_hashes(at, k))
        return out

    def candidates(self, proposed: list[Marks], longest: int) -> list[np.ndarray]:
        """Per length, where the phrases to count begin: all words, and phrases with both largest parts proposed."""
        out = [np.ones(self.size, bool)]
        for k in range(2, longest + 1):
            out.append(self.both(self.among(out[-1], k - 1, proposed[k - 2]), k))
        return out

    def counted(self, places: np.ndarray, k: int) -> pa.RecordBatch:
        """(lang, phrase, k, n) of the phrases of ``k`` words that begin at the places."""
        key = self.ids[places]
        for i in range(1, k):
            key = (_dense(key) if i > 1 else key) * len(self.tokens) + self.ids[places + i]
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        chosen = [self.tokens[self.ids[places[first] + i]] for i in range(k)]
        kinds = len(self.words.vocab)
        parts = [self.words.vocab.take(pa.array(c % kinds)) for c in chosen]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if k > 1 else parts[0]
        lang = self.langs.dictionary.take(pa.array(chosen[0] // kinds))
        return _counts(lang, phrase.cast(pa.string()), k, counts)

    def totals(self) -> pa.RecordBatch:
        """(lang, '', 0, n): the number of words."""
        n = np.bincount(self.lang_of, minlength=len(self.langs.dictionary))
        return _counts(self.langs.dictionary, pa.array([""] * len(n), pa.string()), 0, n)


def _counts(lang: pa.Array, phrase: pa.Array, k: int, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"lang": lang.cast(pa.string()), "phrase": phrase, "k": pa.array(np.full(len(n), k, np.int32)), "n": pa.array(n.astype(np.int64))})


def frequent_buckets(texts: DataFrame, least: int, proposed: list[Marks], levels: range, entries: int) -> Marks:
    """Marks of the candidate phrases of the given lengths whose bucket counts ``least`` occurrences or more.

    About four buckets an expected entry, so that few are shared. A task sends the counts of a part of the buckets as one row: the gaps between
    them and the counts. Parts are as many as the entries ask for, and hashes fill them evenly.
    """
    parts = 1 << max(4, (entries // PART_ENTRIES).bit_length())
    bucket_bits = max(20, (4 * entries).bit_length())
    width = bucket_bits - parts.bit_length() + 1  # bits of a bucket inside its part
    shared = texts.sparkSession.sparkContext.broadcast([m.bits for m in proposed])

    def blocks(batches):
        proposed = [Marks(b) for b in shared.value]
        for batch in batches:
            for piece in pieces(batch, "text"):
                tokens = Tokens(piece)
                if not tokens.size:
                    continue
                found = tokens.candidates(proposed, levels[-1])
                hashes = [tokens.phrase_hashes(np.flatnonzero(found[k - 1]), k) for k in levels]
                buckets, counts = np.unique(np.concatenate(hashes) & np.uint64((1 << bucket_bits) - 1), return_counts=True)
                if not len(buckets):
                    continue
                of = (buckets >> np.uint64(width)).astype(np.int64)
                begin = np.flatnonzero(np.diff(of, prepend=-1))
                inside = (buckets & np.uint64((1 << width) - 1)).astype(np.int64)
                gaps = np.diff(inside, prepend=0)
                gaps[begin] = inside[begin]
                ends = np.append(begin[1:], len(of))
                yield pa.record_batch([
                    pa.array(of[begin]), pa.array([gaps[a:b].astype(np.uint32).tobytes() for a, b in zip(begin, ends)], pa.binary()),
                    pa.array([counts[a:b].astype(np.uint32).tobytes() for a, b in zip(begin, ends)], pa.binary()),
                ], names=["part", "gaps", "counts"])

    def added(key, table):
        at = np.concatenate([np.cumsum(np.frombuffer(g.as_py(), np.uint32).astype(np.int64)) for g in table.column("gaps")])
        n = np.concatenate([np.frombuffer(c.as_py(), np.uint32) for c in table.column("counts")])
        order = np.argsort(at, kind="stable")
        at, n = at[order], n[order].astype(np.int64)
        begin = np.flatnonzero(np.diff(at, prepend=-1))
        total = np.add.reduceat(n, begin)
        frequent = at[begin][total >= least] + (int(key[0].as_py()) << width)
        return pa.table({"bucket": pa.array(frequent, pa.int64())})

    rows = texts.select("lang", "text").mapInArrow(blocks, "part bigint, gaps binary, counts binary")
    found = materialize(rows.groupBy("part").applyInArrow(added, "bucket bigint"), "frequent-buckets")
    return mark_buckets(found, bucket_bits)


def exact_counts(texts: DataFrame, proposed: list[Marks], frequent: Marks) -> DataFrame:
    """(lang, phrase, k, n): the number of words (k = 0), and exact counts of all phrases that can be frequent.

    Those are candidates in a frequent bucket, and phrases that were no candidates although both largest parts can be frequent.
    """
    shared = texts.sparkSession.sparkContext.broadcast(([m.bits for m in proposed], frequent.bits))

    def phrases(batches):
        proposed, frequent = [Marks(b) for b in shared.value[0]], Marks(shared.value[1])
        for batch in batches:
            for piece in pieces(batch, "text"):
                tokens = Tokens(piece)
                if not tokens.size:
                    continue
                yield tokens.totals()
                candidates = tokens.candidates(proposed, LONGEST)
                possible = tokens.among(candidates[0], 1, frequent)
                for k in range(1, LONGEST + 1):
                    if k > 1:
                        open_places = tokens.both(possible, k)
                        known = open_places & candidates[k - 1]
                        possible = tokens.among(known, k, frequent) | (open_places & ~known)
                    places = np.flatnonzero(possible)
                    if len(places):
                        yield tokens.counted(places, k)

    found = texts.select("lang", "text").mapInArrow(phrases, "lang string, phrase string, k int, n bigint")
    return found.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, support: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, k, n): every phrase of one to four words found ``support`` times or more, and per language its number of words (k = 0)."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    sample = materialize(texts.filter(F.pmod(F.xxhash64("id", "text"), F.lit(SAMPLE_ONE_IN)) == 0).select("lang", "text"), "phrase-sample")
    texts = texts.select("lang", "text")
    letters = sample.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    entries = max(letters // 3, 1 << 16)  # words and pairs of the sample, roughly
    proposed: list[Marks] = []
    for k in range(1, LONGEST):
        least = max(1, math.ceil(support * LOWERED[k] / SAMPLE_ONE_IN))
        proposed.append(frequent_buckets(sample, least, proposed, range(k, k + 1), entries))
    frequent = frequent_buckets(texts, support, proposed, range(1, LONGEST + 1), entries * min(SAMPLE_ONE_IN, 1 << 10))
    found = exact_counts(texts, proposed, frequent)
    return materialize(found.filter((F.col("k") == 0) | (F.col("n") >= support)), "frequent-phrases")


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(2000000 a / (l + r)) in exact integers."""
    wide = "decimal(19,0)"
    return F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * a.cast(wide), l.cast(wide) + r.cast(wide)).cast("bigint")


def collocations(docs: DataFrame, support: int = 30, top: int = 2000, absorbed: int = 80, id_col: str = "doc_id", text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two to four words of each language.

    A phrase scores by its weakest cut into two parts. A phrase inside a longer frequent one with ``absorbed`` percent of its count or more is
    dropped. Null texts count as empty, a null language is ``und``. Repeated rows and copies count as often as they occur; null and equal ids
    only matter to the draw of the sample, which changes the work, not the result. Texts of any length are read whole, one at a time at
    least. Ties in score and count go by the bytes of the phrase. Other columns are ignored; an empty table gives an empty result.
    """
    found = frequent_phrases(docs, support, id_col, text_col, lang_col)
    counts = found.filter("k > 0").select("lang", "phrase", "n")
    totals = found.filter("k = 0").select("lang", F.col("n").alias("total"))
    chosen = found.filter("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))

    cuts = chosen.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("left"),
        F.array_join(F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"),
    )
    cuts = lookup(cuts, counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"], "inner", salt_by=["phrase"])
    cuts = lookup(cuts, counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"], "inner", salt_by=["phrase"])
    cuts = cuts.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")

    places = F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1))
    longer = chosen.filter("k > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1))).withColumn("place", places)
    longer = longer.select("lang", F.array_join(F.slice("words", F.col("place"), F.col("size")), " ").alias("phrase"), F.col("a").alias("longest"))
    longer = materialize(longer.groupBy("lang", "phrase").agg(F.max("longest").alias("longest")), "longer-phrases")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = lookup(scored, longer, ["lang", "phrase"], salt_by=["phrase"])
    scored = scored.filter(F.col("longest").isNull() | (wide("longest") * 100 < wide("a") * absorbed)).drop("longest")

    # the first of every salt, then the first of those: no language is sorted in one task
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(TOP_SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top).drop("rank", "salt")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    out = lookup(ranked, totals, ["lang"], "inner")
    return out.select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = rf"""
    WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]'), lambda x: x <> '') AS w FROM t),
    total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
    p AS (SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase, k
          FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
    f AS (SELECT lang, phrase, k, count(*) AS a FROM p GROUP BY ALL HAVING count(*) >= 30),
    c AS (SELECT lang, phrase, a, k, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
    cut AS (SELECT c.*, unnest(range(1, k)) AS part FROM c),
    s AS (SELECT cut.lang, cut.phrase, cut.a, part, l.a AS l, r.a AS r, (2000000::HUGEINT * cut.a // (l.a + r.a))::BIGINT AS score
          FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(cut.w[1:part], ' ')
          JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(cut.w[part + 1:], ' ')),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, part) = 1),
    inside AS (SELECT lang, a, w, k, unnest(range(2, k)) AS size FROM c),
    sub AS (SELECT lang, a, unnest(list_transform(range(1, k - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM inside),
    most AS (SELECT lang, phrase, max(a) AS longest FROM sub GROUP BY ALL),
    kept AS (SELECT b.* FROM b LEFT JOIN most m ON m.lang = b.lang AND m.phrase = b.phrase WHERE longest IS NULL OR 100::HUGEINT * longest < 80::HUGEINT * b.a)
    SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM kept JOIN total ON total.lang = kept.lang QUALIFY rank <= 2000"""


@query("op13_phrase_mining", SQL)
def op13_phrase_mining(spark, sf):
    return collocations(table(spark, sf, "documents"))

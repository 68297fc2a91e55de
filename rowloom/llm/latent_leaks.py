"""Benchmark passages in documents, found by latent semantic retrieval.

Benchmark items are TF-IDF vectors over their words; the document frequencies come from all passages of the corpus. A
distributed randomised singular value decomposition gives a latent space. Stretches of a document are candidates for an item
if they hold enough of its weight: what is accepted in the end holds ``COMMON_WITH_ANSWER`` of it, so of its rarer words, all but
``LEFT_OUT`` of the weight, a stretch holds the difference at least. The stretches are found from the places of those words alone. Windows of a
stretch, at several lengths so that one fits the item, are projected and compared with it by cosine. Every word of a window
weighs by its own document frequency. Tasks know those of the benchmark's words and of all words found in one passage of
``LISTED`` or more; a rarer word weighs the least it can there, which bounds the cosine from above, and what passes is weighed
again with the frequencies from a written table. What
remains is aligned in full with the item: the weight of the longest common subsequence and the words of its answer
(the last sentence) decide, so a passage with words changed, dropped or inserted is found as well.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..operators.joins import lookup
from ..session import materialize
from .registry import query, table
from .words import pieces, split_words

BLOCK = 64  # words of a passage for the document frequencies
LISTED = 4096  # words of one passage in so many are known to every task: at most LISTED * BLOCK at any size of the corpus
RANK = 256
TERM_BITS = 17  # terms are hashed beyond this many, which bounds the basis
POWER = 2
COSINE = 0.45
COMMON = 0.75  # weight share of the item in the longest common subsequence
COMMON_WITH_ANSWER = 0.55
ANSWER = 0.9
LEFT_OUT = 0.3  # weight share of an item's most common words, which are not looked up
STRETCH = 3  # an item is found within so many times its own length
ITEM_BLOCK = 4096


def plain_words(text: str | None) -> list[str]:
    """Words of a text: runs without white space, lower-cased, letters and digits only."""
    return [w for w in (re.sub(r"[\W_]+", "", x) for x in (text or "").lower().split()) if w]


def _plain(vocab: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_lower(vocab), r"[^\p{L}\p{N}]+", "")


def _term(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word) & ((1 << TERM_BITS) - 1)


def _plain_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Like ``split_words``, for plain words."""
    offsets, codes, vocab = split_words(texts, lower=False)
    coded = _plain(vocab).dictionary_encode()
    names = coded.dictionary
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes]
    keep = (pc.binary_length(names).to_numpy(zero_copy_only=False) > 0)[codes] if len(codes) else np.empty(0, bool)
    before = np.concatenate([[0], np.cumsum(keep)])
    return before[offsets], codes[keep], names


def passage_counts(docs: DataFrame) -> DataFrame:
    """(term, n): the passages of ``BLOCK`` words in which each word of the corpus is found, and for the null term all passages."""

    def count(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                offsets, codes, names = _plain_codes(part.column("text"))
                sizes = np.diff(offsets)
                at = np.arange(len(codes)) - np.repeat(offsets[:-1], sizes)
                passages = -(-sizes // BLOCK)
                block = np.repeat(np.cumsum(passages) - passages, sizes) + at // BLOCK
                n = np.bincount(np.unique(block * max(1, len(names)) + codes) % max(1, len(names)), minlength=len(names))
                some = np.flatnonzero(n)
                terms = pa.concat_arrays([names.cast(pa.string()).take(pa.array(some)), pa.nulls(1, pa.string())])
                yield pa.record_batch({"term": terms, "n": pa.array(np.append(n[some], passages.sum()), pa.int64())})

    found = docs.select("text").mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return materialize(found, "passage-counts")


def inverse_frequency(n, total: float):
    return np.log((1 + total) / (1 + n)) + 1.0


def word_weights(counts: DataFrame, terms: list[str]) -> tuple[list[str], np.ndarray, float]:
    """(words, weights, passages): the inverse document frequencies of the terms, then of all other words of one passage in ``LISTED`` or
    more, and last the least that any word beyond these weighs."""
    total = float(counts.filter("term is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    known = counts.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    own = {r["term"]: r["n"] for r in lookup(known, counts.filter("term is not null"), ["term"], "inner").collect()}
    often = counts.filter("term is not null").filter(F.col("n") * LISTED >= total)  # at most LISTED * BLOCK
    others = [(r["term"], r["n"]) for r in lookup(often, known, ["term"], "left_anti").collect()]
    n = np.array([own.get(t, 0) for t in terms] + [k for _, k in others] + [total / LISTED], float)
    return [*terms, *(t for t, _ in others)], inverse_frequency(n, total), total


def window_sizes(lengths: list[int]) -> list[int]:
    """Powers of two that fit the items, from the shortest to the longest; a window moves on by half its size."""
    low, high = (max(1, (n - 1).bit_length()) for n in (min(lengths), max(lengths)))
    return [1 << k for k in range(low, high + 1)]


def item_vectors(items: DataFrame, terms: list[str], idf: np.ndarray) -> DataFrame:
    """(item_id, at, value): unit TF-IDF rows, at most one entry for each hashed term."""
    shared = items.sparkSession.sparkContext.broadcast({t: (_term(t), float(w)) for t, w in zip(terms, idf)})

    def vectors(batches):
        weights = shared.value
        for batch in batches:
            ids, ats, values = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                tf: dict[int, float] = {}
                for word in plain_words(text):
                    at, w = weights[word]
                    tf[at] = tf.get(at, 0.0) + w * w  # the square of sqrt(tf) * idf
                norm = sum(tf.values())
                ids.append(i)
                ats.append(sorted(tf))
                values.append([float(np.sqrt(tf[k] / norm)) for k in sorted(tf)])
            yield pa.record_batch({"item_id": batch.column("item_id"), "at": pa.array(ats, pa.list_(pa.int64())), "value": pa.array(values, pa.list_(pa.float64()))})

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(vectors, f"item_id {kind}, at array<bigint>, value array<double>")


def _added(key, parts):
    total = np.stack([np.asarray(x.as_py()) for x in parts["sums"]]).sum(0)
    return pa.table({"row": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([total], pa.list_(pa.float64()))})


def latent_basis(vectors: DataFrame, rank: int = RANK, power: int = POWER, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(terms, basis): the leading right singular vectors of the rows, by a randomised range finder with power steps.

    Rows stay distributed. A step sends the current basis (at most 2^TERM_BITS x (rank + 8) numbers) to the tasks and gets one sum per term back.
    """
    spark = vectors.sparkSession
    terms = np.array(sorted(r["t"] for r in vectors.select(F.explode("at").alias("t")).distinct().collect()), np.int64)  # at most 2^TERM_BITS
    width = min(rank + 8, max(1, len(terms)))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((max(1, len(terms)), width)))[0]

    def rows_of(batch):
        ats, values = batch.column("at"), batch.column("value")
        sizes = np.diff(ats.offsets.to_numpy())
        return np.repeat(np.arange(batch.num_rows), sizes), np.searchsorted(terms, ats.flatten().to_numpy()), values.flatten().to_numpy()

    def product(shared, gram):
        def run(batches):
            q = shared.value
            total = np.zeros((q.shape[1], q.shape[1])) if gram else np.zeros(q.shape)
            for batch in batches:
                row, at, value = rows_of(batch)
                y = np.zeros((batch.num_rows, q.shape[1]))
                np.add.at(y, row, value[:, None] * q[at])
                if gram:
                    total += y.T @ y
                else:
                    np.add.at(total, at, value[:, None] * y[row])
            some = np.flatnonzero(np.abs(total).sum(1))
            yield pa.record_batch({"row": pa.array(some, pa.int64()), "sums": pa.array(list(total[some]), pa.list_(pa.float64()))})

        return run

    def summed(q, gram):
        parts = vectors.mapInArrow(product(spark.sparkContext.broadcast(q), gram), "row bigint, sums array<double>")
        sums = parts.groupBy("row").applyInArrow(_added, "row bigint, sums array<double>")  # one row per term
        out = np.zeros((q.shape[1] if gram else q.shape[0], q.shape[1]))
        for r in sums.toLocalIterator():
            out[r["row"]] += np.array(r["sums"])
        return out

    if not len(terms):
        return terms, np.zeros((0, 0))
    for _ in range(power + 1):
        basis = np.linalg.qr(summed(basis, False))[0]
    values, turn = np.linalg.eigh(summed(basis, True))
    keep = np.argsort(-values)[: min(rank, int((values > 1e-10).sum()))]
    return terms, basis @ turn[:, keep]


def aligned_weight(item: np.ndarray, weights: np.ndarray, text: np.ndarray) -> float:
    """Greatest weight of a common subsequence of an item (codes, weights) and a text, as a share of the item."""
    row = np.zeros(len(text) + 1)
    for code, w in zip(item, weights):
        nxt = row.copy()
        nxt[1:] = np.maximum(row[1:], np.where(text == code, row[:-1] + w, 0.0))
        row = np.maximum.accumulate(nxt)
    total = weights.sum()
    return float(row[-1] / total) if total else 0.0


def answer_of(text: str) -> set[str]:
    """Words of the last sentence of an item, its answer."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text or "") if plain_words(s)]
    return set(plain_words(sentences[-1])) if len(sentences) > 1 else set(plain_words(text))


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", cosine: float = COSINE) -> DataFrame:
    """One row per document row and item found in it: id, item_id, cosine, common (aligned weight), answer (share of its answer's words).

    A leak has ``common`` of at least ``COMMON``, or ``COMMON_WITH_ANSWER`` if at least ``ANSWER`` of its answer is there too. Null and empty texts
    contain nothing, items without words are found nowhere. Repeated rows and items give repeated matches. Other columns are
    ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = items.select("item_id", "text").filter("text is not null")
    kind, item_kind = rows.schema["id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"id {kind}, item_id {item_kind}, cosine double, common double, answer double"

    words = items.mapInArrow(_item_words, "term string").distinct()
    terms = sorted(r["term"] for r in words.collect())  # the benchmark's vocabulary
    if not terms:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    counts = passage_counts(rows)
    listed_words, weights, total = word_weights(counts, terms)
    vectors = materialize(item_vectors(items, terms, weights[: len(terms)]), "item-vectors")
    used, basis = latent_basis(vectors)
    term_rows = np.searchsorted(used, np.array([_term(t) for t in terms]))

    listed = materialize(items.filter("text rlike '[\\\\p{L}\\\\p{N}]'").withColumn("at", F.monotonically_increasing_id()), "items")
    bounds = [r["at"] for r in listed.select("at").orderBy("at").collect()]
    out = None
    for low in range(0, len(bounds), ITEM_BLOCK):
        block = listed.filter(F.col("at").between(bounds[low], bounds[min(low + ITEM_BLOCK, len(bounds)) - 1])).orderBy("at").collect()
        model = spark.sparkContext.broadcast((pa.array(listed_words, pa.string()), weights, len(terms), term_rows, basis.astype(np.float32), [(r["item_id"], r["text"]) for r in block]))
        found = rows.mapInArrow(_search(model, cosine), schema.replace("cosine double", "windows array<struct<dot:double,square:double,rare:array<string>>>"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    return weighed(materialize(out.withColumn("at", F.monotonically_increasing_id()), "bounded-leaks"), counts, total, cosine).withColumnRenamed("id", id_col)


def weighed(found: DataFrame, counts: DataFrame, total: float, cosine: float) -> DataFrame:
    """The found rows of which a window reaches the cosine once its rare words weigh by their own passages."""
    windows = found.select("at", F.posexplode("windows").alias("w", "of")).select("at", "w", "of.*")
    rare = windows.select("at", "w", F.explode("rare").alias("term"))
    rare = lookup(rare, counts.filter("term is not null"), ["term"], "left", salt_by=["at", "w"])
    weight = F.log(F.lit(1 + total) / (1 + F.coalesce("n", F.lit(0)))) + 1
    rare = materialize(rare.groupBy("at", "w").agg(F.sum(weight * weight).alias("more")), "rare-weights")
    windows = lookup(windows.drop("rare"), rare, ["at", "w"], "left")
    like = F.col("dot") / F.sqrt(F.col("square") + F.coalesce("more", F.lit(0.0)))
    best = windows.groupBy("at").agg(F.max(like).alias("cosine")).filter(F.col("cosine") >= cosine)
    return lookup(found.drop("windows"), materialize(best, "leak-cosines"), ["at"], "inner").select("id", "item_id", "cosine", "common", "answer")


def _item_words(batches):
    for batch in batches:
        seen = {w for text in batch.column("text").to_pylist() for w in plain_words(text)}
        yield pa.record_batch({"term": pa.array(sorted(seen), pa.string())})


def _search(model, cosine):
    kind = pa.list_(pa.struct([("dot", pa.float64()), ("square", pa.float64()), ("rare", pa.list_(pa.string()))]))

    def search(batches):
        listed, weights, n_terms, term_rows, basis, items = model.value
        idf = weights[:n_terms]
        code_of = {t: i for i, t in enumerate(listed[:n_terms].to_pylist())}
        item_codes = [np.array([code_of[w] for w in plain_words(text)]) for _, text in items]
        item_latent = np.zeros((len(items), basis.shape[1]), np.float32)
        for i, codes in enumerate(item_codes):
            mass = np.bincount(term_rows[codes], idf[codes] ** 2, len(basis))
            some = np.flatnonzero(mass)
            item_latent[i] = np.sqrt(mass[some] / mass.sum()).astype(np.float32) @ basis[some]
        item_latent /= np.maximum(np.linalg.norm(item_latent, axis=1, keepdims=True), 1e-12)
        lengths = window_sizes([len(codes) for codes in item_codes])
        reach = np.array([STRETCH * len(codes) for codes in item_codes])
        first, holders, shares_of = _holders(item_codes, idf)
        answers = [np.array(sorted(code_of[w] for w in answer_of(text))) for _, text in items]

        for batch in batches:
            for part in pieces(batch, "text"):
                offsets, codes, names = _plain_codes(part.column("text"))
                names = names.cast(pa.string())
                of = pc.fill_null(pc.index_in(names, listed), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                of = of[codes] if len(codes) else np.empty(0, np.int64)
                square = weights[of] ** 2  # the last weight for words that are not listed
                own = (of >= 0) & (of < n_terms)
                all_, known = (np.concatenate([[0], np.cumsum(x)]) for x in (square, np.where(of >= 0, square, 0.0)))
                of = np.where(own | (of < 0), of, -2)  # -1 rare, -2 listed but in no item
                near: dict[tuple[int, int], list] = {}
                for r, j, a, b in _stretches(of, offsets, first, holders, shares_of, reach):
                    start, end = _windows(a, b, lengths)
                    latent = np.stack([_project(of[x:y], idf, term_rows, basis) for x, y in zip(start, end)])
                    dots = latent @ item_latent[j]
                    total = all_[end] - all_[start]
                    for w in np.flatnonzero((total > 0) & (dots >= cosine * np.sqrt(total))):
                        near.setdefault((r, j), []).append((int(start[w]), int(end[w]), float(dots[w])))
                ids, which, windows, commons, shares = [], [], [], [], []
                for (r, j), spans in sorted(near.items()):
                    beside = len(item_codes[j])
                    best = (0.0, 0.0)
                    for a, b in _joined([(max(offsets[r], a - beside), min(offsets[r + 1], b + beside)) for a, b, _ in spans]):
                        text = of[a:b]
                        common = aligned_weight(item_codes[j], idf[item_codes[j]], text)
                        answer = float(np.isin(answers[j], text).mean()) if len(answers[j]) else 0.0
                        best = max(best, (common, answer))
                    if best[0] >= COMMON or (best[0] >= COMMON_WITH_ANSWER and best[1] >= ANSWER):
                        ids.append(r)
                        which.append(items[j][0])
                        windows.append([{"dot": d, "square": float(known[b] - known[a]), "rare": names.take(pa.array(codes[a:b][of[a:b] == -1])).to_pylist()} for a, b, d in spans])
                        commons.append(best[0])
                        shares.append(best[1])
                if ids:
                    yield pa.record_batch({"id": part.column("id").take(pa.array(ids)), "item_id": pa.array(which), "windows": pa.array(windows, kind), "common": pa.array(commons), "answer": pa.array(shares)})

    return search


def _holders(item_codes: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word the items it is looked up for, as (first, items, weight shares): ``first[w]`` to ``first[w + 1]`` are those of word w.

    Of every item the most common words are left out, up to ``LEFT_OUT`` of its weight.
    """
    words, items, shares = [], [], []
    for j, codes in enumerate(item_codes):
        own, times = np.unique(codes, return_counts=True)
        share = times * idf[own]
        share = share / share.sum()
        order = np.argsort(share / times, kind="stable")  # most common first
        kept = order[np.cumsum(share[order]) > LEFT_OUT]
        words.append(own[kept])
        items.append(np.full(len(kept), j))
        shares.append(share[kept])
    words, items, shares = np.concatenate(words), np.concatenate(items), np.concatenate(shares)
    order = np.argsort(words, kind="stable")
    first = np.searchsorted(words[order], np.arange(len(idf) + 1))
    return first, items[order], shares[order]


def _stretches(of: np.ndarray, offsets: np.ndarray, first: np.ndarray, holders: np.ndarray, shares: np.ndarray, reach: np.ndarray):
    """(row, item, start, end): the stretches of a text, not longer than the item's reach, in which the looked-up words of the item weigh enough.

    Overlapping ones are joined. A word that occurs twice counts twice, so the weight is never too low.
    """
    at = np.flatnonzero((of >= 0) & (of < len(first) - 1))
    times = first[of[at] + 1] - first[of[at]]
    at, times = at[times > 0], times[times > 0]
    if not len(at):
        return
    begin = np.cumsum(times) - times
    entry = np.arange(times.sum()) - np.repeat(begin, times) + np.repeat(first[of[at]], times)
    place, item, share = np.repeat(at, times), holders[entry], shares[entry]
    row = np.searchsorted(offsets, place, side="right") - 1
    span = int(offsets[-1]) + int(reach.max()) + 1
    # places of an item in a text, all texts one after the other and far enough apart
    key = item * (span + len(offsets) * int(reach.max() + 1)) + place + row * int(reach.max() + 1)
    order = np.argsort(key, kind="stable")
    key, place, item, row = key[order], place[order], item[order], row[order]
    weight = np.concatenate([[0.0], np.cumsum(share[order])])
    last = np.searchsorted(key, key + reach[item], side="left")
    good = np.flatnonzero(weight[last] - weight[:-1] >= COMMON_WITH_ANSWER - LEFT_OUT - 1e-9)
    held = None
    for i in good.tolist():
        r, j, a, b = int(row[i]), int(item[i]), int(place[i]), int(place[last[i] - 1]) + 1
        if held and held[:2] == (r, j) and a <= held[3]:
            held = (r, j, held[2], max(b, held[3]))
            continue
        if held:
            yield _widened(held, offsets, reach)
        held = (r, j, a, b)
    if held:
        yield _widened(held, offsets, reach)


def _widened(stretch: tuple, offsets: np.ndarray, reach: np.ndarray) -> tuple[int, int, int, int]:
    """A stretch with as much text beside it as the item is long."""
    r, j, a, b = stretch
    beside = int(reach[j]) // STRETCH
    return r, j, max(int(offsets[r]), a - beside), min(int(offsets[r + 1]), b + beside)


def _windows(a: int, b: int, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows of a stretch at all lengths; a window moves on by half its size, the last ends with the stretch."""
    starts, ends = [], []
    for size in lengths:
        steps = max(0, -(-(b - a - size) // (size // 2))) + 1
        start = np.minimum(a + np.arange(steps) * (size // 2), max(a, b - size))
        starts.append(start)
        ends.append(np.minimum(start + size, b))
    return np.concatenate(starts), np.concatenate(ends)


def _project(codes: np.ndarray, idf: np.ndarray, term_rows: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A window in the latent space, not normalised."""
    at, back = np.unique(term_rows[codes[codes >= 0]], return_inverse=True)
    mass = np.bincount(back, idf[codes[codes >= 0]] ** 2, len(at))
    return np.sqrt(mass).astype(np.float32) @ basis[at]


def _joined(spans: list[tuple[int, int]]):
    """Overlapping spans as one."""
    last = None
    for a, b in sorted(spans):
        if last and a <= last[1]:
            last = (last[0], max(last[1], b))
        else:
            if last:
                yield last
            last = (a, b)
    if last:
        yield last


@query("op9_latent_leaks")
def op9_latent_leaks(spark, sf):
    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))

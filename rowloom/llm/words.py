"""Words of Arrow text batches as numbers: helpers that run inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE_BYTES = 2 << 20
_MASK = (1 << 64) - 1


def pieces(batch: pa.RecordBatch, text_col: str, limit: int = PIECE_BYTES):
    """Slices of a batch with about ``limit`` bytes of text, one whole row at least.

    Workers live on from stage to stage, so memory that a batch no longer uses is given back at its end.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Bounds of each text in the list of word codes, the codes, and the distinct words.

    Words are runs without the six ASCII white-space characters; null counts as the empty text.
    """
    texts = pc.fill_null(texts, "")
    texts = pc.ascii_lower(texts) if lower else texts
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    codes, vocab = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    blank = np.flatnonzero(pc.binary_length(vocab).to_numpy(zero_copy_only=False) == 0)
    if len(blank):  # leading, trailing or only white space
        keep = codes != blank[0]
        before = np.concatenate([[0], np.cumsum(keep)])
        codes, offsets = codes[keep], before[offsets]
    return offsets, codes, vocab


def word_hashes(vocab: pa.Array) -> np.ndarray:
    """64-bit hashes of the distinct words."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocab.to_pylist()), np.uint64, len(vocab))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits look independent."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _factor(i: int) -> np.uint64:
    return np.uint64((0x9E3779B97F4A7C15 * (2 * i + 3) | 1) & _MASK)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the distinct n-word shingles of one text, sorted; with fewer words the whole sequence is one."""
    if not len(hashes):
        return hashes
    with np.errstate(over="ignore"):
        if len(hashes) < n:
            total = np.uint64(len(hashes))
            for i, h in enumerate(hashes):
                total = total + h * _factor(i)
            return scramble(np.array([total], np.uint64))
        total = np.full(len(hashes) - n + 1, n, np.uint64)
        for i in range(n):
            total += hashes[i : len(hashes) - n + 1 + i] * _factor(i)
    return np.unique(scramble(total))


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one numpy array per row."""
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))

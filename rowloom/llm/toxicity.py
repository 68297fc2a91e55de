"""A toxicity classifier that does not react to which group is mentioned.

A logistic model over the words of a text and their beginnings (so that inflected forms share evidence) is fitted
to labelled rows. For every labelled sentence that mentions an identity term, counterfactual sentences with
other terms of the same kind are formed, and the fit pays for the squared change of the score. Counts that select the
features cover all labelled rows; the fit itself uses a bounded sample of them. Scoring reads each whole text once and needs
no shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..operators.joins import lookup
from ..session import materialize
from .common import fold, unit
from .registry import query, table
from .words import list_array, pieces, split_words

FEATURES = 2048
MIN_DOCS = 3
MIN_GAIN = 8.0  # a log likelihood ratio that chance hardly reaches among thousands of features
FIT_ROWS = 10_000  # expected rows of each class in the fit
FIT_PAIRS = 20_000  # expected counterfactual pairs in the fit
PENALTY = 10.0
RIDGE = 2e-4
STEMS = (4, 5, 6)

# fixed values: groups of interchangeable identity terms
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender"), ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european", "arab"), ("gay", "straight", "lesbian", "bisexual", "heterosexual"),
    ("immigrants", "refugees", "natives", "foreigners"), ("old", "young", "elderly"), ("disabled", "blind", "deaf"),
    ("frauen", "männer"), ("juden", "christen", "muslime"), ("femmes", "hommes"), ("juifs", "chrétiens", "musulmans"), ("mujeres", "hombres"), ("judíos", "cristianos", "musulmanes"),
)


def word_features(vocab: pa.Array) -> list[pa.Array]:
    """Features of each word, one array a kind: the word's letters and their first four, five and six; null where too short."""
    plain = pc.replace_substring_regex(pc.utf8_lower(vocab), r"\P{L}+", "")
    size = pc.utf8_length(plain)
    out = [pc.if_else(pc.greater(size, 0), pc.binary_join_element_wise("w", plain, ":"), None)]
    for n in STEMS:
        out.append(pc.if_else(pc.greater_equal(size, n), pc.binary_join_element_wise(str(n), pc.utf8_slice_codeunits(plain, 0, n), ":"), None))
    return out


def _document_features(texts: pa.Array) -> list[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """For each kind: the distinct features, and distinct pairs (row, feature code)."""
    offsets, codes, vocab = split_words(texts)
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
    pairs = np.unique(rows * max(1, len(vocab)) + codes)
    rows, codes = pairs // max(1, len(vocab)), pairs % max(1, len(vocab))
    out = []
    for kind in word_features(vocab):
        coded = kind.dictionary_encode()
        of = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
        known = of >= 0
        width = max(1, len(coded.dictionary))
        pairs = np.unique(rows[known] * width + of[known])
        out.append((coded.dictionary, pairs // width, pairs % width))
    return out


def select_features(labelled: DataFrame, features: int) -> list[str]:
    """The features that tell the labels apart best, by the likelihood ratio, counted over all labelled rows."""

    def count(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                toxic = part.column("label").to_numpy(zero_copy_only=False)
                for names, rows, codes in _document_features(part.column("text")):
                    yield pa.record_batch({
                        "feature": names.cast(pa.string()),
                        "bad": pa.array(np.bincount(codes, toxic[rows], len(names)).astype(np.int64)),
                        "docs": pa.array(np.bincount(codes, minlength=len(names)).astype(np.int64)),
                    })

    total = labelled.agg(F.sum("label"), F.count(F.lit(1))).first()
    bad_rows, rows = float(total[0] or 0), float(total[1])
    if not 0 < bad_rows < rows:
        return []
    counts = labelled.mapInArrow(count, "feature string, bad bigint, docs bigint").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("docs").alias("docs"))
    a, n = F.col("bad") + 0.5, F.col("docs") + 1.0
    share = a / n
    base = bad_rows / rows
    gain = a * F.log(share / F.lit(base)) + (n - a) * F.log((F.lit(1.0) - share) / F.lit(1 - base))
    best = counts.filter(F.col("docs") >= MIN_DOCS).withColumn("gain", gain).filter(F.col("gain") >= MIN_GAIN).orderBy(F.desc("gain"), "feature").limit(features)
    return [r["feature"] for r in best.select("feature").collect()]


def _counterfactuals(text: str, index: dict[str, int]):
    """Feature differences of each sentence of a text with an identity term swapped for its alternatives."""
    for sentence in re.split(r"(?<=[.!?])\s+|\n+", text.lower()):
        words = set(re.findall(r"[^\W\d_]+", sentence))
        for group in IDENTITY:
            for term in words & set(group):
                for other in group:
                    if other not in words:
                        yield _term_features(term, index), _term_features(other, index)


def _term_features(term: str, index: dict[str, int]) -> list[int]:
    names = [f"w:{term}"] + [f"{n}:{term[:n]}" for n in STEMS if len(term) >= n]
    return [index[x] for x in names if x in index]


def fit_weights(rows: list[tuple[float, np.ndarray]], pairs: list[tuple[list[int], list[int]]], width: int, penalty: float) -> np.ndarray:
    """Weights and, last, the intercept: balanced logistic loss + ridge + penalty on counterfactual changes, by limited-memory BFGS."""
    y = np.array([r[0] for r in rows])
    sizes = np.array([len(r[1]) for r in rows])
    row_of, col_of = np.repeat(np.arange(len(rows)), sizes), np.concatenate([r[1] for r in rows] or [np.empty(0, int)]).astype(np.int64)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    d_row = np.concatenate([np.full(len(a) + len(b), i) for i, (a, b) in enumerate(pairs)] or [np.empty(0)]).astype(np.int64)
    d_col = np.concatenate([np.array(a + b) for a, b in pairs] or [np.empty(0)]).astype(np.int64)
    d_val = np.concatenate([np.concatenate([np.ones(len(a)), -np.ones(len(b))]) for a, b in pairs] or [np.empty(0)])

    def loss(w):
        z = w[-1] + np.bincount(row_of, w[col_of], len(rows))
        p = 0.5 * (1 + np.tanh(z / 2))
        value = (share * (np.logaddexp(0, z) - y * z)).sum() + RIDGE * (w[:-1] ** 2).sum()
        e = share * (p - y)
        grad = np.append(np.bincount(col_of, e[row_of], width), e.sum())
        grad[:-1] += 2 * RIDGE * w[:-1]
        if len(pairs):
            diff = np.bincount(d_row, d_val * w[d_col], len(pairs))
            value += penalty * (diff**2).mean()
            grad[:-1] += 2 * penalty / len(pairs) * np.bincount(d_col, d_val * diff[d_row], width)
        return value, grad

    w, memory = np.zeros(width + 1), []
    value, grad = loss(w)
    for _ in range(200):
        q, alphas = grad.copy(), []
        for s, t in reversed(memory):
            alphas.append((s @ q) / (t @ s))
            q -= alphas[-1] * t
        if memory:
            s, t = memory[-1]
            q *= (s @ t) / (t @ t)
        for (s, t), a in zip(memory, reversed(alphas)):
            q += s * (a - (t @ q) / (t @ s))
        step = 1.0
        while step > 1e-8:
            new_value, new_grad = loss(w - step * q)
            if new_value <= value - 1e-4 * step * (q @ grad):
                break
            step /= 2
        else:
            break
        s, t = -step * q, new_grad - grad
        if s @ t > 1e-12:
            memory = [*memory[-9:], (s, t)]
        done = value - new_value < 1e-8
        w, value, grad = w - step * q, new_value, new_grad
        if done:
            break
    return w


def fit_toxicity(labelled: DataFrame, penalty: float = PENALTY, features: int = FEATURES) -> tuple[list[str], np.ndarray]:
    """(features, weights) learned from rows (text, label). Without both labels there are no features and the score is the share of label 1."""
    labelled = labelled.filter("label is not null").select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("double").alias("label"), "draw")
    names = select_features(labelled, features)
    if not names:
        share = labelled.agg(F.avg("label")).first()[0]
        share = min(max(share or 0.0, 1e-3), 1 - 1e-3)
        return [], np.array([np.log(share / (1 - share))])
    known = set(names)
    terms = [x for group in IDENTITY for term in group for x in [f"w:{term}"] + [f"{n}:{term[:n]}" for n in STEMS if len(term) >= n]]
    names += [x for x in dict.fromkeys(terms) if x not in known]  # so that the penalty can reach every term
    index = {x: i for i, x in enumerate(names)}
    listed = pa.array(names)

    def encode(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                at = [[] for _ in range(part.num_rows)]
                for kinds, rows, codes in _document_features(part.column("text")):
                    of = pc.fill_null(pc.index_in(kinds.cast(pa.string()), listed), -1).to_numpy(zero_copy_only=False)[codes]
                    for r, i in zip(rows[of >= 0], of[of >= 0]):
                        at[r].append(i)
                yield pa.record_batch({"label": part.column("label"), "at": list_array([np.array(sorted(x), np.int32) for x in at], pa.int32())})

    def swap(batches):
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for a, b in _counterfactuals(text, index):
                    yield pa.record_batch({"a": list_array([np.array(a, np.int32)], pa.int32()), "b": list_array([np.array(b, np.int32)], pa.int32())})

    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chance = F.lit(0.0)
    for label, n in counts.items():
        chance = F.when(F.col("label") == label, F.lit(FIT_ROWS / n)).otherwise(chance)
    rows = labelled.filter(F.col("draw") < chance).mapInArrow(encode, "label double, at array<int>")
    rows = sorted(((r["label"], tuple(r["at"])) for r in rows.collect()))
    mentions = labelled.filter(F.col("text").rlike(r"(?iu)(?<![\p{L}])(" + "|".join(t for g in IDENTITY for t in g) + r")(?![\p{L}])"))
    pairs = materialize(mentions.select("text").mapInArrow(swap, "a array<int>, b array<int>"), "pairs")
    many = pairs.count()
    pairs = pairs.filter(unit("a", "b", F.monotonically_increasing_id()) < F.lit(FIT_PAIRS / max(1, many)))
    pairs = sorted((tuple(r["a"]), tuple(r["b"])) for r in pairs.collect())
    weights = fit_weights([(y, np.array(at, np.int64)) for y, at in rows], [(list(a), list(b)) for a, b in pairs], len(names), penalty)
    return names, weights


def score_toxicity(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score in (0, 1) of each whole text; a column of that name is replaced.

    Null and empty texts get the score of a text without known features. Repeated rows score alike; an empty table stays empty.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")  # texts stay Arrow buffers: as Python strings a batch takes several times its size
    def score(texts: pa.Array) -> pa.Array:
        names, w = shared.value
        listed = pa.array(names, pa.string())
        out = []
        for part in pieces(pa.record_batch({"text": texts}), "text"):
            z = np.full(part.num_rows, w[-1])
            if names:
                for kinds, rows, codes in _document_features(part.column("text")):
                    at = pc.fill_null(pc.index_in(kinds.cast(pa.string()), listed), -1).to_numpy(zero_copy_only=False)
                    value = np.where(at >= 0, w[at], 0.0)[codes]
                    z += np.bincount(rows, value, part.num_rows)
            out.append(0.5 * (1 + np.tanh(z / 2)))
        return pa.array(np.concatenate(out) if out else np.empty(0))

    return docs.withColumn(name, score(F.col(text_col)))


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, label, draw) of the rows with a label; of contradicting labels of an id the larger counts. ``draw`` decides about the bounded sample."""
    said = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    rows = docs.select("doc_id", "text")
    return lookup(rows, said, ["doc_id"], "inner").select("text", "label", unit("text", "doc_id").alias("draw"))


THRESHOLD = 0.7


@query("op2_toxicity")
def op2_toxicity(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    learn = docs.filter(fold(F.col("doc_id"), 3) != 1)
    model = fit_toxicity(labelled_rows(learn, table(spark, sf, "labels")))
    out = score_toxicity(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

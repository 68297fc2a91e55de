"""Labels: dictionary lookup, embeddings, nearest labels and condition fidelity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.vectors import bce_with_logits
from ..session import materialize
from .joins import lookup

BLOCK_ROWS = 4096
MAX_PIVOTS = 1024
TOGETHER = 256  # vectors that are compared with all pivots, or all labels of a block, at once
SENT = 8192  # opened rows sent at once


def label_to_iri(df: DataFrame, dictionary: DataFrame, label: str = "label", name: str = "iri") -> DataFrame:
    """Add the key of each label; a label that is not in the dictionary gets null."""
    table = dictionary.select(F.col("label").alias(label), F.col("iri").alias(name))
    return lookup(df, table, [label])


def normalise_key(df: DataFrame, label: str, pattern: str, replacement: str, name: str | None = None) -> DataFrame:
    """Rewrite a label prefix so that it matches the keys of the embedding table."""
    return df.withColumn(name or label, F.regexp_replace(F.col(f"`{label}`"), pattern, replacement))


def with_embedding(df: DataFrame, embeddings: DataFrame, key: str, size: int, on_missing: str = "error",
                   name: str = "embedding") -> DataFrame:
    """Add the vector of each row's key. A missing key is an error, or zeros if asked for."""
    if on_missing not in ("error", "zeros"):
        raise ValueError("on_missing must be 'error' or 'zeros'")
    table = embeddings.select(F.col("key").alias(key), F.col("embedding").alias("_vector"))
    out = lookup(df, table, [key])
    vector = F.transform("_vector", lambda x: x.cast("double"))
    if on_missing == "zeros":
        other = F.array_repeat(F.lit(0.0), size)
    else:
        text = F.concat(F.lit("no embedding for key "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
        other = F.raise_error(text).cast("array<double>")
    return out.withColumn(name, F.when(F.col("_vector").isNotNull(), vector).otherwise(other)).drop("_vector")


def label_fidelity(rows: DataFrame, embeddings: DataFrame, requested: str, produced: str) -> DataFrame:
    """(requested, rows, loss): how far the produced labels are from the requested ones.

    Mean cross entropy between the embedding read from the produced label (as logits) and
    the requested label's embedding, times five. The loss depends on the two labels only,
    so rows are counted per label pair first and the vectors meet once per pair.
    """
    pairs = rows.groupBy(F.col(f"`{requested}`").alias("requested"), F.col(f"`{produced}`").alias("produced")).agg(
        F.count(F.lit(1)).alias("n")
    )
    left = embeddings.select(F.col("key").alias("produced"), F.col("embedding").alias("_x"))
    right = embeddings.select(F.col("key").alias("requested"), F.col("embedding").alias("_y"))
    met = lookup(lookup(pairs, left, ["produced"], how="inner"), right, ["requested"], how="inner")
    loss = bce_with_logits(F.transform("_x", lambda v: v.cast("double")), F.transform("_y", lambda v: v.cast("double")))
    met = met.withColumn("_loss", loss)
    return met.groupBy("requested").agg(
        F.sum("n").alias("rows"), (F.sum(F.col("_loss") * F.col("n")) / F.sum("n") * 5.0).alias("loss")
    )


def label_quota(labels: DataFrame, ids: DataFrame, id_col: str, label: str = "label", order: str = "position") -> DataFrame:
    """Give each id a label so that the labels' shares differ by one row at most.

    ``labels`` carries a dense ``position``; id i gets the label at position i mod k.
    """
    k = labels.count()
    table = labels.select(F.col(f"`{order}`").alias("_position"), F.col(f"`{label}`"))
    placed = ids.withColumn("_position", F.col(f"`{id_col}`") % F.lit(k))
    return lookup(placed, table, ["_position"], how="inner", salt_by=[id_col]).drop("_position")


def _unit(vectors: np.ndarray) -> np.ndarray:
    out = np.asarray(vectors, float)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def _matrix(rows) -> np.ndarray:
    """The embeddings of a batch or table, all of one width, as unit rows."""
    vectors = rows.column("embedding")
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return _unit(vectors.flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1))


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _slices(rows, size: int):
    """A batch or table in slices of at most ``size`` rows."""
    for low in range(0, rows.num_rows, size):
        yield rows.slice(low, size)


class PivotIndex:
    """Seen labels in blocks around pivots, so that a search opens only blocks that can hold a neighbour.

    Angles between vectors obey the triangle inequality: no label of a block is nearer to a query than the query's angle to the pivot less the
    block's radius. Pivots are at most ``MAX_PIVOTS`` of the labels themselves; every label belongs to its nearest one, and the
    labels of a pivot are cut into blocks of about ``block_rows``.
    """

    def __init__(self, seen: DataFrame, block_rows: int = BLOCK_ROWS):
        self.block_rows, self.opened = block_rows, []
        rows = seen.select(F.col("key").cast("string").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
        self.rows = rows.count()
        wanted = min(MAX_PIVOTS, -(-self.rows // block_rows))
        chosen = rows.orderBy(F.xxhash64("key"), "key").limit(max(wanted, 1)).select("embedding").collect()
        self.pivots = _unit([r["embedding"] for r in chosen]) if chosen else np.empty((0, 0))
        self.shared = rows.sparkSession.sparkContext.broadcast(self.pivots)
        placed = rows.mapInArrow(self._placing(), "key string, embedding array<double>, pivot int, angle double")
        self.placed = materialize(placed, "placed-labels")
        facts = self.placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()  # one row per pivot
        self.count, self.radius = np.zeros(len(self.pivots), int), np.full(len(self.pivots), -np.inf)
        for r in facts:
            self.count[r["pivot"]], self.radius[r["pivot"]] = r["n"], r["radius"]

    def _placing(self):
        shared = self.shared

        def place(batches):
            for batch in batches:
                for some in _slices(batch, TOGETHER):
                    angles = _angles(_matrix(some), shared.value)
                    yield pa.record_batch({
                        "key": some.column("key"), "embedding": some.column("embedding"), "pivot": pa.array(angles.argmin(axis=1), pa.int32()),
                        "angle": pa.array(angles.min(axis=1)),
                    })

        return place

    def search(self, unseen: DataFrame, k: int) -> DataFrame:
        """(key, neighbour, similarity) of the ``k`` nearest labels of every query, among others.

        First the nearest pivots' blocks are opened that hold ``k`` labels together. Their k-th angle then bounds which other blocks can matter.
        """
        queries = unseen.select(F.col("key").cast("string").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
        first = self._meet(self._opening(queries.withColumn("bound", F.lit(None).cast("double")), k), k, "first")
        if len(self.pivots) < 2:
            return first
        ranked = first.withColumn("_nth", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("similarity"), "neighbour")))
        bound = F.max(F.when(F.col("_nth") == k, F.acos(F.greatest(F.least("similarity", F.lit(1.0)), F.lit(-1.0)))))
        bounds = materialize(ranked.groupBy("key").agg(F.coalesce(bound, F.lit(np.pi)).alias("bound")), "search-bounds")
        rest = self._opening(lookup(queries, bounds, ["key"], "inner"), k)
        return first.unionByName(self._meet(rest, k, "rest"))

    def _opening(self, queries: DataFrame, k: int) -> DataFrame:
        """(key, embedding, pivot): the pivots whose blocks a query opens; with a ``bound`` those that were not among the first."""
        shared, count, radius = self.shared, self.count, self.radius

        def opening(batches):
            for batch in batches:
                for some in _slices(batch, TOGETHER):
                    angles = _angles(_matrix(some), shared.value)
                    order = np.argsort(angles, axis=1, kind="stable")
                    before = np.cumsum(count[order], axis=1) - count[order]
                    first = np.zeros(angles.shape, bool)
                    np.put_along_axis(first, order, before < k, axis=1)
                    bounds = some.column("bound").to_numpy(zero_copy_only=False).astype(float)[:, None]
                    opened = np.where(np.isnan(bounds), first, ~first & (angles - radius <= bounds + 1e-9)) & (count > 0)
                    at, pivots = np.nonzero(opened)
                    for low in range(0, len(at), SENT):  # a query may open all blocks
                        rows = pa.array(at[low : low + SENT])
                        yield pa.record_batch({
                            "key": some.column("key").take(rows), "embedding": some.column("embedding").take(rows), "pivot": pa.array(pivots[low : low + SENT], pa.int32()),
                        })

        return queries.mapInArrow(opening, "key string, embedding array<double>, pivot int")

    def _meet(self, opened: DataFrame, k: int, tag: str) -> DataFrame:
        """The best ``k`` of every opened block for every query that opened it; a task sees one block and about as many queries."""
        opened = materialize(opened, f"opened-{tag}")
        self.opened.append(opened)
        asked = opened.groupBy("pivot").agg(F.count(F.lit(1)).alias("asked"))
        held = self.placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("held"))
        cuts = asked.join(held, "pivot").select(
            "pivot", F.ceil(F.col("held") / self.block_rows).cast("int").alias("_blocks"), F.ceil(F.col("asked") / self.block_rows).cast("int").alias("_groups")
        )
        cuts = F.broadcast(materialize(cuts, "cuts"))  # at most MAX_PIVOTS rows
        part = lambda stream, parts: F.pmod(F.xxhash64("key", F.lit(stream)), F.col(parts)).cast("int")
        every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
        left = opened.join(cuts, "pivot").withColumn("_group", part("u", "_groups")).withColumn("_block", every("_blocks"))
        right = self.placed.join(cuts, "pivot").withColumn("_block", part("s", "_blocks")).withColumn("_group", every("_groups"))
        by = ["pivot", "_block", "_group"]

        def block(asked, held):
            held = held.sort_by("key").combine_chunks()
            if not asked.num_rows or not held.num_rows:
                return pa.table({"key": pa.array([], pa.string()), "neighbour": pa.array([], pa.string()), "similarity": pa.array([], pa.float64())})
            seen, found = _matrix(held), []
            for some in _slices(asked.combine_chunks(), TOGETHER):
                close = _matrix(some) @ seen.T
                best = np.argsort(-close, axis=1, kind="stable")[:, :k]
                at = np.repeat(np.arange(some.num_rows), best.shape[1])
                found.append(pa.table({
                    "key": some.column("key").take(pa.array(at)), "neighbour": held.column("key").take(pa.array(best.ravel())), "similarity": pa.array(close[at, best.ravel()]),
                }))
            return pa.concat_tables(found)

        left, right = left.select("key", "embedding", *by), right.select("key", "embedding", *by)
        met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(block, "key string, neighbour string, similarity double")
        return materialize(met, f"met-{tag}")


def nearest_labels(unseen: DataFrame, seen: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, neighbour, similarity, rank, weight): exact k most similar seen labels per unseen label.

    Both sides hold (key, embedding). The seen labels are searched through a ``PivotIndex``; block winners are merged by a window
    filter. Weights are the softmax of the similarities.
    """
    met = PivotIndex(seen, block_rows).search(unseen, k)
    w = Window.partitionBy("key").orderBy(F.desc("similarity"), "neighbour")
    top = met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    total = F.sum(F.exp("similarity")).over(Window.partitionBy("key"))
    return top.withColumn("weight", F.exp("similarity") / total)


def mixed_weights(neighbours: DataFrame, counts: DataFrame, label: str, values: list[str], weight: str = "n",
                  scale: float = 1e12) -> DataFrame:
    """Frequency table of the unseen labels: the weighted mix of their neighbours' shares.

    ``counts`` holds (label, values..., n) of the seen labels. Shares become integers by
    ``scale``, so later sums are exact.
    """
    keys = [v for v in values if v in ("pair", "column")]
    totals = counts.groupBy(*keys, label).agg(F.sum(weight).alias("_total"))
    shares = lookup(counts, totals, keys + [label], null_safe=True)
    shares = shares.withColumn("_share", F.col(weight) / F.col("_total")).drop("_total", weight)
    near = neighbours.select("key", F.col("neighbour").alias(label), "weight")
    # k neighbours per unseen label: every frequency row meets the unseen labels that use it
    met = shares.join(near, label)
    mixed = met.groupBy(F.col("key").alias("_unseen"), *values).agg(F.sum(F.col("_share") * F.col("weight")).alias("_p"))
    out = mixed.withColumn(weight, F.round(F.col("_p") * F.lit(scale)).cast("bigint")).drop("_p")
    return out.withColumnRenamed("_unseen", label)


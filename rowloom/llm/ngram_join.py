"""Near duplicates by exact Jaccard similarity of word shingles, through groups of similar documents.

Documents with equal shingle sets form a class. Classes are first put into groups: those that share a
min-hash are compared with one of them, and verified links make a group. Each group keeps the union of its
members' rarest shingles (the token-group matrix): a set of n shingles can only reach the wanted similarity with
a set that shares some of its n - ceil(t n) + 1 first shingles in a common order. The ones shared with the union bound the overlap with
any member, and a class opens another group only where that bound and the sizes allow the similarity.

An opened group is first met through its hub, the member with most links, then through a few members under each shingle; what that links is
merged, and groups that fell into one component are closed again. All members of the groups still open are found by the fewest
shingles that one of them must show.
A bit map of each set then bounds every pair, exactly, and only pairs that pass it are compared in full. Members of one group are
linked already and never compared again, so the square of a large group of copies is met nowhere. Similar sets that no min-hash
brought into one group still meet one by one.

The common order puts shingles that a sample found in many documents last, most frequent at the very end, and the others by hash.
The order affects how many members are opened, never the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..session import discard, materialize, written_bytes
from .common import BROADCAST_FILES, components, light_lookup as lookup
from .phrase_mining import Marks, mark_buckets
from .registry import query, table
from .words import list_array, pieces, scramble, shingles, split_words, word_hashes

MIN_HASHES = 6  # of a class
SAMPLE_ONE_IN = 16
FREQUENT = 4  # times in the sample
FREQUENT_TOKENS = 1 << 18  # longest list of frequent shingles; the order only
SALT_ROWS = 512  # classes of one shingle that look into groups under one key
SOME_MEMBERS = 4  # members of a group under each shingle that a class meets before the others
MAP_BITS = 2048  # of the bit map of a set


def _light(table: DataFrame) -> bool | None:
    """Whether a written table, or a part of its columns, may be broadcast; null for a table that has to be measured."""
    size = written_bytes(table)
    return None if size is None else size <= BROADCAST_FILES


def _sets(batches, n: int):
    """For each slice of a batch: the slice and the sorted shingle hashes of each row."""
    for batch in batches:
        for part in pieces(batch, "text"):
            offsets, codes, vocab = split_words(part.column("text"))
            hashes = word_hashes(vocab)[codes] if len(codes) else np.empty(0, np.uint64)
            yield part, [shingles(hashes[a:b], n) for a, b in zip(offsets[:-1], offsets[1:])]


def _key(tokens: np.ndarray) -> bytes:
    """128 bits that name a set of shingles."""
    with np.errstate(over="ignore"):
        a = scramble(np.array([tokens.sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64))
        b = scramble(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return a.tobytes() + b.tobytes()


def frequent_shingles(texts: DataFrame, n: int) -> np.ndarray:
    """Shingles found ``FREQUENT`` times or more in a sample of the texts, rarest first; at most ``FREQUENT_TOKENS``."""

    def explode(batches):
        for _, sets in _sets(batches, n):
            yield pa.record_batch({"token": pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64())})

    sample = texts.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_ONE_IN)) == 0).select("text")
    counts = sample.mapInArrow(explode, "token bigint").groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT)
    top = counts.orderBy(F.desc("n"), "token").limit(FREQUENT_TOKENS).select("token").toArrow()
    return top.column("token").to_numpy()[::-1].astype(np.int64).view(np.uint64)


def set_features(rows: DataFrame, n: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """(id, row, n, key, prefix, mins, bits) of each row (id, text): a hash of the row, set size, set name, first shingles in the common order,
    min-hashes, and the set as a bit map."""
    order = np.argsort(frequent)
    known, rank = frequent[order], order.astype(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast((known, rank))

    def features(batches):
        known, rank = shared.value
        for part, sets in _sets(batches, n):
            keys, firsts, mins, maps = [], [], [], []
            for s in sets:
                keys.append(_key(s))
                bits = np.zeros(MAP_BITS, bool)
                bits[(s >> np.uint64(24)) & np.uint64(MAP_BITS - 1)] = True
                maps.append(np.packbits(bits).view(np.int64))
                place = s >> np.uint64(1)
                if len(known) and len(s):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    place = np.where(known[at] == s, np.uint64(1 << 63) + rank[at], place)
                size = len(s)
                length = size - -(-num * size // den) + 1 if size else 0
                firsts.append(s[np.argsort(place, kind="stable")[:length]].view(np.int64))
                mins.append(np.array([scramble(s ^ np.uint64((i + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1))).min() for i in range(MIN_HASHES)], np.uint64).view(np.int64) if size else np.empty(0, np.int64))
            yield pa.record_batch({
                "id": part.column("id"), "row": part.column("row"), "n": pa.array([len(s) for s in sets], pa.int64()), "key": pa.array(keys, pa.binary()),
                "prefix": list_array(firsts, pa.int64()), "mins": list_array(mins, pa.int64()), "bits": list_array(maps, pa.int64()),
            })

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, row bigint, n bigint, key binary, prefix array<bigint>, mins array<bigint>, bits array<bigint>"
    return rows.select("id", "text", _row()).mapInArrow(features, schema)


def _row():
    return F.xxhash64("id", "text").alias("row")


def whole_sets(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(cid, tokens) of the wanted classes (cid, row, key): the whole texts of their rows are read again."""

    def tokens(batches):
        for _, sets in _sets(batches, n):
            yield pa.record_batch({"key": pa.array([_key(s) for s in sets], pa.binary()), "tokens": list_array([s.view(np.int64) for s in sets], pa.int64())})

    some = lookup(rows.select("text", _row()), wanted, ["row"], "left_semi")
    found = some.select("text").mapInArrow(tokens, "key binary, tokens array<bigint>")
    found = found.join(wanted.select("key", "cid"), "key")
    return found.groupBy("cid").agg(F.first("tokens").alias("tokens"))


def within_bounds(pairs: DataFrame, maps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose bit maps (cid, n, bits) allow the similarity.

    A bit of one map that the other lacks stands for a shingle or more that the other set lacks.
    """
    side = lambda c, s: maps.select(F.col("cid").alias(c), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"m{s}"))
    both = lookup(pairs, side("a", "a"), ["a"], "inner", salt_by=["b"], fits=False)
    both = lookup(both, side("b", "b"), ["b"], "inner", salt_by=["a"], fits=False, counted=pairs)
    lacks = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda t, v: t + v)
    most = F.least(F.col("na") - lacks("ma", "mb"), F.col("nb") - lacks("mb", "ma"))
    return both.filter(_reached(most, "na", "nb", num, den)).select("a", "b")


def verified(pairs: DataFrame, rows: DataFrame, of_class: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes (cid, row, key, n, bits) whose whole sets reach the similarity. Sets are shuffled to their pairs at every size."""
    ends = lambda p: p.select(F.col("a").alias("cid")).union(p.select(F.col("b").alias("cid"))).distinct()
    asked = materialize(pairs.distinct(), "asked")
    if asked.isEmpty():
        return asked
    maps = materialize(of_class.select("cid", "n", "bits").join(ends(asked), "cid", "left_semi"), "maps")
    pairs = materialize(within_bounds(asked, maps, num, den), "candidates")
    if pairs.isEmpty():
        discard(asked, maps)
        return pairs
    wanted = materialize(of_class.select("cid", "row", "key").join(ends(pairs), "cid", "left_semi"), "opened")
    sets = materialize(whole_sets(rows, wanted, n), "sets")
    left = lookup(pairs, sets.select(F.col("cid").alias("a"), F.col("tokens").alias("ta")), ["a"], "inner", salt_by=["b"], fits=False)
    both = lookup(left, sets.select(F.col("cid").alias("b"), F.col("tokens").alias("tb")), ["b"], "inner", salt_by=["a"], fits=False, counted=pairs)
    both = both.withColumn("i", F.size(F.array_intersect("ta", "tb")).cast("bigint"))
    links = materialize(both.filter(F.col("i") * den >= (F.size("ta") + F.size("tb") - F.col("i")) * num).select("a", "b"), "links")
    discard(asked, maps, pairs, wanted, sets)
    return links


def _size_bound(a: str, b: str, num: int, den: int):
    return F.least(a, b) * den >= F.greatest(a, b) * num


def _fits(size: str, num: int, den: int):
    """Whether sets between ``lo`` and ``hi`` can be similar to one of that size."""
    return (F.col("lo") * num <= F.col(size) * den) & (F.col("hi") * den >= F.col(size) * num)


def _behind(size: str, num: int, den: int):
    """Shingles of a set after its prefix."""
    return F.floor((F.col(size) * num + (den - 1)) / F.lit(den)) - 1


def _reached(overlap, a: str, b: str, num: int, den: int):
    return overlap * (num + den) >= F.lit(num) * (F.col(a) + F.col(b))


def linked_groups(of_class: DataFrame, rows: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) that make groups, and the groups (node, root).

    In a turn each class is compared with two classes under each of its min-hashes, the first and the last by a hash that changes with the turn, if
    several min-hashes agree and the two are not in one group yet. Turns go on as long as they add a tenth of the links there are.
    """
    mins = materialize(of_class.select("cid", "n", F.posexplode("mins").alias("k", "m")), "min-hashes")
    shared = mins.groupBy("k", "m").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("k", "m")
    mins = materialize(lookup(mins, materialize(shared, "shared-min-hashes"), ["k", "m"], "left_semi", salt_by=["cid"]), "min-hashes")
    links = groups = None
    found, turn = 0, 0
    while True:
        by, who = F.xxhash64("cid", F.lit(turn)), F.struct("cid", "n")
        hubs = materialize(mins.groupBy("k", "m").agg(F.array(F.min_by(who, by), F.max_by(who, by)).alias("ends")), "hubs")
        stars = lookup(mins, hubs, ["k", "m"], "inner", salt_by=["cid"]).select("cid", "n", F.explode("ends").alias("hub"))
        stars = stars.select("cid", "n", F.col("hub.cid").alias("hub"), F.col("hub.n").alias("hub_n"))
        stars = stars.filter((F.col("cid") != F.col("hub")) & _size_bound("n", "hub_n", num, den))
        stars = stars.select(F.least("hub", "cid").alias("a"), F.greatest("hub", "cid").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("same"))
        stars = stars.filter(F.col("same") >= 2).select("a", "b")
        if groups is not None:
            root = lambda c, name: groups.select(F.col("node").alias(c), F.col("root").alias(name))  # noqa: E731, B023
            fits = _light(groups)
            stars = lookup(lookup(stars, root("a", "ra"), ["a"], "left", salt_by=["b"], fits=fits), root("b", "rb"), ["b"], "left", salt_by=["a"], fits=fits)
            stars = stars.filter(~F.coalesce("ra", "a").eqNullSafe(F.coalesce("rb", "b"))).select("a", "b")
        new = verified(stars, rows, of_class, n, num, den)
        discard(hubs)
        added = new.count()
        links = new if links is None else links.unionByName(new)
        if groups is None:
            groups = materialize(components(links, "a", "b"), "groups")
        elif added:
            groups = merged(groups, new)
        found, turn = found + added, turn + 1
        if 10 * added <= found - added or not added:
            discard(mins)
            return links, groups


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The groups (node, root) after the links (a, b): only their roots are met by the component rounds."""
    root = lambda c, name: groups.select(F.col("node").alias(c), F.col("root").alias(name))
    fits = _light(groups)
    tops = lookup(lookup(links, root("a", "ra"), ["a"], "left", salt_by=["b"], fits=fits), root("b", "rb"), ["b"], "left", salt_by=["a"], fits=fits)
    tops = tops.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).filter("a <> b")
    tops = materialize(components(tops, "a", "b"), "tops")
    below = lookup(groups, tops.select(F.col("node").alias("root"), F.col("root").alias("top")), ["root"], "left", salt_by=["node"], fits=_light(tops))
    below = below.select("node", F.coalesce("top", "root").alias("root"))
    fresh = tops.join(groups.select("node"), "node", "left_anti")
    out = materialize(below.unionByName(fresh.select("node", "root")), "groups")
    discard(tops)
    return out


def joined_by(groups: DataFrame, links: DataFrame) -> DataFrame:
    return groups if links.isEmpty() else merged(groups, links)


def grouped_classes(of_class: DataFrame, groups: DataFrame) -> DataFrame:
    """(cid, n, prefix, grp, k): each class with its group and the number of classes in it. A class without a group is its own."""
    sizes = materialize(groups.groupBy("root").agg(F.count(F.lit(1)).alias("k")), "group-sizes")
    named = materialize(lookup(groups, sizes, ["root"], "inner", salt_by=["node"]).withColumnRenamed("node", "cid"), "group-members")
    members = lookup(of_class.select("cid", "n", "prefix"), named, ["cid"], "left")
    return materialize(members.select("cid", "n", "prefix", F.coalesce("root", "cid").alias("grp"), F.coalesce("k", F.lit(1)).alias("k")), "members")


def group_hubs(links: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, hub): the class of each group that has most links."""
    degree = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    of = lookup(degree, groups, ["node"], "inner")
    return materialize(of.groupBy(F.col("root").alias("grp")).agg(F.max_by("node", F.struct("d", -F.col("node"))).alias("hub")), "hubs-of-groups")


def shared_tokens(of_class: DataFrame) -> Marks:
    """Marks of the shingles that the prefixes of two classes or more hold, and of a few others.

    Shingles are counted by hash buckets, many more than there are shingles. A task sends the counts of a part of the buckets as one row: the gaps
    between them and the counts.
    """
    entries = max(of_class.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0], 1 << 10)
    parts = 1 << max(4, (entries >> 20).bit_length())
    bucket_bits = max(20, (64 * entries).bit_length())
    width = bucket_bits - parts.bit_length() + 1  # bits of a bucket inside its part

    def blocks(batches):
        for batch in batches:
            tokens = batch.column("prefix").flatten().to_numpy().view(np.uint64)
            buckets, counts = np.unique(tokens & np.uint64((1 << bucket_bits) - 1), return_counts=True)
            if not len(buckets):
                continue
            of, inside = (buckets >> np.uint64(width)).astype(np.int64), (buckets & np.uint64((1 << width) - 1)).astype(np.int64)
            begin = np.flatnonzero(np.diff(of, prepend=-1))
            gaps = np.diff(inside, prepend=0)
            gaps[begin] = inside[begin]
            cuts = list(zip(begin, np.append(begin[1:], len(of))))
            yield pa.record_batch([
                pa.array(of[begin]), pa.array([gaps[a:b].astype(np.uint32).tobytes() for a, b in cuts], pa.binary()),
                pa.array([np.minimum(counts[a:b], 2).astype(np.uint8).tobytes() for a, b in cuts], pa.binary()),
            ], names=["part", "gaps", "counts"])

    def added(key, held):
        at = np.concatenate([np.cumsum(np.frombuffer(g.as_py(), np.uint32).astype(np.int64)) for g in held.column("gaps")])
        n = np.concatenate([np.frombuffer(c.as_py(), np.uint8) for c in held.column("counts")])
        order = np.argsort(at, kind="stable")
        at, n = at[order], n[order].astype(np.int64)
        begin = np.flatnonzero(np.diff(at, prepend=-1))
        return pa.table({"bucket": pa.array(at[begin][np.add.reduceat(n, begin) > 1] + (int(key[0].as_py()) << width), pa.int64())})

    rows = of_class.select("prefix").mapInArrow(blocks, "part bigint, gaps binary, counts binary")
    found = materialize(rows.groupBy("part").applyInArrow(added, "bucket bigint"), "shared-buckets")
    marks = mark_buckets(found, bucket_bits)
    discard(found)
    return marks


def token_rows(members: DataFrame, shared: Marks) -> DataFrame:
    """(cid, n, grp, k, token, salts): the shingles of the prefixes that two classes or more show; the others open nothing."""
    bits = members.sparkSession.sparkContext.broadcast(shared.bits)

    def some(batches):
        marks = Marks(bits.value)
        for batch in batches:
            prefix = batch.column("prefix")
            tokens = prefix.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(prefix).to_numpy(zero_copy_only=False))
            keep = marks.has(tokens.view(np.uint64))
            at = pa.array(row[keep])
            yield pa.record_batch({**{c: batch.column(c).take(at) for c in ("cid", "n", "grp", "k")}, "token": pa.array(tokens[keep])})

    rows = members.select("cid", "n", "grp", "k", "prefix").mapInArrow(some, "cid bigint, n bigint, grp bigint, k bigint, token bigint")
    tokens = materialize(rows, "possible-tokens")
    shown = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    shown = materialize(shown.select("token", F.ceil(F.col("rows") / SALT_ROWS).cast("int").alias("salts")), "shown-tokens")
    out = materialize(lookup(tokens, shown, ["token"], "inner", salt_by=["cid"]), "token-rows")
    discard(tokens, shown)
    return out


def token_groups(tokens: DataFrame) -> DataFrame:
    """(token, grp, k, salts, lo, hi, shown): the token-group matrix. One row for each distinct shingle of the group's prefixes, with the sizes of
    the sets that show it and their number."""
    return tokens.groupBy("token", "grp", "k", "salts").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count(F.lit(1)).alias("shown"))


def opened_groups(tokens: DataFrame, matrix: DataFrame, num: int, den: int) -> DataFrame:
    """(a, na, grp, k, seen, lo, hi): the groups a class may have a similar set in, and among which sizes. Of two groups, the members of the smaller look into the larger.

    The shingles of the class's prefix in the group's union are at least those it shares with the prefix of any member. Shingles of many
    classes are split among salts, so that a key meets about ``SALT_ROWS`` classes.
    """
    left = tokens.select("token", F.col("cid").alias("a"), F.col("n").alias("na"), F.col("grp").alias("ga"), F.col("k").alias("ka"), F.pmod(F.xxhash64("cid"), "salts").cast("int").alias("salt"))
    right = matrix.drop("shown").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    met = left.join(right, ["token", "salt"]).filter((F.col("ka") < F.col("k")) | ((F.col("ka") == F.col("k")) & (F.col("ga") < F.col("grp"))))
    met = met.filter(_fits("na", num, den))
    met = met.groupBy("a", "na", "grp", "k").agg(F.count(F.lit(1)).alias("seen"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    met = met.withColumn("lo", F.greatest("lo", F.ceil(F.col("na") * num / F.lit(den)))).withColumn("hi", F.least("hi", F.floor(F.col("na") * den / F.lit(num))))
    # among sets up to na the smallest needs least; among larger ones the largest shows most behind its prefix, give or take one for rounding
    small = (F.col("lo") <= F.col("na")) & _reached(F.col("seen") + _behind("na", num, den), "na", "lo", num, den)
    more = F.when(F.col("lo") < F.col("hi"), 1).otherwise(0)
    large = (F.col("hi") >= F.col("na")) & _reached(F.col("seen") + _behind("hi", num, den) + more, "na", "hi", num, den)
    return materialize(met.filter(small | large), "opened-groups")


def still_open(opened: DataFrame, groups: DataFrame) -> DataFrame:
    """The opened groups (a, grp, ...) that are not in one component (node, root) with the class yet."""
    root = lambda c, name: groups.select(F.col("node").alias(c), F.col("root").alias(name))
    fits = _light(groups)
    both = lookup(lookup(opened, root("a", "ra"), ["a"], "left", salt_by=["grp"], fits=fits), root("grp", "rg"), ["grp"], "left", salt_by=["a"], fits=fits)
    return materialize(both.filter(~F.coalesce("ra", "a").eqNullSafe(F.coalesce("rg", "grp"))).drop("ra", "rg"), "still-open")


def member_pairs(opened: DataFrame, members: DataFrame, tokens: DataFrame, matrix: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of a class and the members of its opened groups that can be similar.

    All shared shingles of two sets that the pair of prefixes does not show lie behind one of the prefixes, which leaves a least number of shared
    ones to the prefixes. A member that shows so many of the ``seen`` ones shows at least one of any ``seen`` - least + 1 of
    them: those that the fewest members show are looked up.
    """
    need = lambda b: F.ceil((F.col("na") + b) * num / F.lit(num + den))
    small = F.when(F.col("lo") <= F.col("na"), need(F.col("lo")) - _behind("na", num, den))
    large = F.when(F.col("hi") >= F.col("na"), need(F.col("hi")) - _behind("hi", num, den))
    least = F.greatest(F.least(small, large) - 1, F.lit(1))  # one less for rounding
    looking = lookup(opened.withColumn("most", F.col("seen") - least + 1), members.select(F.col("cid").alias("a"), "prefix"), ["a"], "inner", salt_by=["grp"], fits=_light(members), counted=opened)
    looking = looking.select("a", "na", "grp", "most", F.explode("prefix").alias("token"))
    of_group = matrix.filter("k > 1").select("grp", "token", "shown", "lo", "hi")
    shown = lookup(looking, of_group, ["grp", "token"], "inner", salt_by=["a"], fits=_light(matrix)).filter(_fits("na", num, den))
    nth = F.row_number().over(Window.partitionBy("a", "grp").orderBy("shown", "token"))
    few = shown.withColumn("nth", nth).filter("nth <= most").select("a", "na", "grp", "token")
    inside = tokens.filter("k > 1").select("grp", F.col("cid").alias("b"), F.col("n").alias("nb"), "token")
    met = lookup(few, inside, ["grp", "token"], "inner", salt_by=["a"], fits=False).filter(_size_bound("na", "nb", num, den))
    return met.select("a", "b").distinct()


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable by links, itself included).

    Two documents link when ``den * intersection >= num * union`` over their sets of distinct n-word shingles, A-Z lower-cased; a
    text with fewer words is one shingle. Null and empty texts have no shingles and link with nothing: their component is their own
    id. Repeated rows have equal sets and link. Null ids take part, but are no component id unless all ids of the component are null. Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = set_features(rows, n, num, den, frequent_shingles(rows, n)).withColumn("at", F.monotonically_increasing_id())
    found = materialize(found, "features")
    classes = found.filter("n > 0").groupBy("key").agg(F.min("id").alias("id"), F.min("at").alias("cid"))  # a class is named by one of its rows
    classes = materialize(classes, "classes")
    of_class = lookup(found.select("row", "key", "n", "prefix", "mins", "bits", F.col("at").alias("cid")), classes.select("cid"), ["cid"], "inner", fits=_light(classes))
    of_class = materialize(of_class, "class-features")

    links, groups = linked_groups(of_class, rows, n, num, den)

    # opened groups: classes of their own and hubs first, then the members of what is still open
    members = grouped_classes(of_class, groups)
    tokens = token_rows(members, shared_tokens(of_class))
    matrix = materialize(token_groups(tokens), "token-groups")
    opened = opened_groups(tokens, matrix, num, den)
    first = lookup(opened, group_hubs(links, groups), ["grp"], "left", salt_by=["a"]).select("a", F.coalesce("hub", "grp").alias("b"))
    joined = joined_by(groups, verified(first, rows, of_class, n, num, den))
    still = still_open(opened.filter("k > 1"), joined)
    if not still.isEmpty():
        inside = tokens.filter("k > 1")
        some = inside.withColumn("nth", F.row_number().over(Window.partitionBy("grp", "token").orderBy(F.xxhash64("cid", "token")))).filter(F.col("nth") <= SOME_MEMBERS)
        tried = materialize(member_pairs(still, members, some, matrix, num, den), "tried")
        joined = joined_by(joined, verified(tried, rows, of_class, n, num, den))
        rest = still_open(still, joined)
        if not rest.isEmpty():
            pairs = member_pairs(rest, members, inside, matrix, num, den).join(tried, ["a", "b"], "left_anti")
            joined = joined_by(joined, verified(pairs, rows, of_class, n, num, den))
        discard(tried, rest)
    discard(members, tokens, matrix, opened, still, of_class)
    named = lookup(classes, joined.withColumnRenamed("node", "cid"), ["cid"], "left", fits=_light(joined)).withColumn("root", F.coalesce("root", "cid"))
    named = materialize(named, "rooted")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = lookup(named.select("key", "root"), materialize(least, "least-ids"), ["root"], "inner", salt_by=["key"]).select("key", "component_id")
    out = lookup(found.select("id", "n", "key"), materialize(named, "class-components"), ["key"], "left", salt_by=["id"])
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


@query("op3_ngram_join")
def op3_ngram_join(spark, sf):
    return ngram_join(table(spark, sf, "documents"))

"""Conversation structure repair by iterative-deepening A*.

A conversation is sound when its role initials read ``(s?(ua)+)?`` and no row is blank or a repetition. Rows are kept (K, no cost),
deleted (D, 3), given the role that is due (R, 2), or such a row with an empty text is inserted (I, 2); a row that is cut short and
not deleted costs 1. The search goes depth first through the edits in ASCII order under a cost bound that rises until a path is
accepted, which is then the first of the cheapest. A path is left when its cost and a lower bound of the rest pass the
bound, or when its state (row, last role) failed before with as much left to spend. The lower bound is the cost of the remaining rows
if a conversation might end with any role, from one backward sweep; it misses the least cost by a few edits at the end at most,
so the search stays linear in the rows.

Only one sign per row reaches the search, which takes a whole conversation: about 100 bytes of a task's memory a row. Texts are streamed
past the found edits in sorted order and never gathered.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators.joins import lookup
from ..session import materialize
from .registry import query, table

DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1  # fixed values: costs of the edits, and of a row cut short
RUN_BITS = 8  # turn numbers 0-255, 256-511, ... meet before their conversation does
SHORT = 64  # signs up to which found edits are remembered
NOTHING = hashlib.sha256(b"").hexdigest()

# signs of a row: its role initial (- for any other); upper case or = if it is cut short, a digit if it must go
_PLAIN, _CUT, _GONE = "sua-", "SUA=", "0123"
_KIND = {c: (_PLAIN[i], gone, cut) for signs, gone, cut in ((_PLAIN, False, 0), (_CUT, False, CUT), (_GONE, True, 0)) for i, c in enumerate(signs)}

# states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant
_KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_DUE = (2, 2, 3, 2)
_ENDS = (True, False, False, True)
# the lower bound does not tell a system row from an assistant's
_SEEN_AS = (0, 1, 2, 1)


def _rest_costs(kinds: list[tuple[str, bool, int]]) -> list[tuple[int, int, int]]:
    """For every row and state of the bound: least cost from there on, wherever the conversation ends."""
    out = [(0, 0, 0)]
    for initial, gone, cut in reversed(kinds):
        after = out[-1]
        costs = []
        for state in (0, 1, 2):
            due = _SEEN_AS[_DUE[state]]
            best = DELETE + after[state]
            if not gone:
                best = min(best, REROLE + cut + after[due])
                kept = _KEEP.get((state, initial))
                if kept is not None:
                    best = min(best, cut + after[_SEEN_AS[kept]])
            costs.append(best)
        once = [min(costs[s], INSERT + costs[_SEEN_AS[_DUE[s]]]) for s in (0, 1, 2)]
        out.append(tuple(min(once[s], INSERT + once[_SEEN_AS[_DUE[s]]]) for s in (0, 1, 2)))
    out.reverse()
    return out


def _step(edit: str, i: int, state: int, kinds) -> tuple[int, int, int] | None:
    """(row, state, cost) after an edit; None if it is not allowed."""
    if edit == "I":
        return i, _DUE[state], INSERT
    if i == len(kinds):
        return None
    initial, gone, cut = kinds[i]
    if edit == "D":
        return i + 1, state, DELETE
    if gone:
        return None
    if edit == "R":
        return i + 1, _DUE[state], REROLE + cut
    kept = _KEEP.get((state, initial))
    return None if kept is None else (i + 1, kept, cut)


def search_edits(signs: str) -> tuple[int, str]:
    """Cost and initials of the first of the cheapest edits, in ASCII order."""
    kinds = [_KIND[c] for c in signs]
    rest = _rest_costs(kinds)
    bound = rest[0][0]
    failed: dict[int, int] = {}  # (row, state) -> most that was left to spend when it failed
    while True:
        path: list[str] = []
        open_nodes = [[0, 0, bound, 0]]  # row, state, left to spend, edits tried
        while open_nodes:
            node = open_nodes[-1]
            i, state, left, tried = node
            if tried == 0 and i == len(kinds) and _ENDS[state]:
                return bound, "".join(path)
            for edit in "DIKR"[tried:]:
                node[3] += 1
                found = _step(edit, i, state, kinds)
                if found is None:
                    continue
                row, then, cost = found
                spare = left - cost
                if rest[row][_SEEN_AS[then]] <= spare and failed.get(row * 4 + then, -1) < spare:
                    open_nodes.append([row, then, spare, 0])
                    path.append(edit)
                    break
            else:
                failed[i * 4 + state] = max(left, failed.get(i * 4 + state, -1))
                open_nodes.pop()
                if path:
                    path.pop()
        bound += 1


@lru_cache(1 << 16)
def _remembered(signs: str) -> tuple[int, str]:
    return search_edits(signs)


@F.pandas_udf(T.StructType([T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))
def _found_edits(signs: pd.Series) -> pd.DataFrame:
    found = [_remembered(s) if len(s) <= SHORT else search_edits(s) for s in signs]
    return pd.DataFrame(found, columns=["cost", "audit"])


def _blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def _whole(text: Column) -> Column:
    return text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def placed_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """Written rows (conv_id, turn, role, text, at, sign, fault): ``at`` rises along each conversation, ``fault`` is the first that applies.

    Rows are range-partitioned, so a conversation with a third of all rows lies in many tasks.
    """
    keys = ["conv_id", "turn", *order]
    short = [F.left("role", F.lit(32)) if c == "role" else F.col(c) for c in keys if c != "text"]
    placed = rows.repartitionByRange(*short).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    # texts are equal if their roles and SHA-256 are
    placed = placed.select("conv_id", "turn", "role", "text", "at", F.unhex(F.sha2("text", 256)).alias("digest"))
    placed = materialize(placed, "placed-turns")
    firsts = placed.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    found = lookup(placed, materialize(firsts, "repeated-turns"), ["conv_id", "role", "digest"], null_safe=True, salt_by=["at"])
    fault = F.when(_blank(F.col("text")), "blank").when(F.col("at") > F.col("first"), "duplicate").when(~_whole(F.col("text")), "truncated")
    initial = F.left("role", F.lit(1))
    place = F.when(initial.isin("s", "u", "a"), F.instr(F.lit(_PLAIN), initial)).otherwise(len(_PLAIN))
    out = found.withColumn("fault", fault)
    signs = F.when(F.col("fault") == "truncated", _CUT).when(F.col("fault").isNotNull(), _GONE).otherwise(_PLAIN)
    return out.select("conv_id", "turn", "role", "text", "at", "fault", F.substr(signs, place, F.lit(1)).alias("sign"))


def repair_plans(placed: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    rows = placed.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "at", "sign", "fault")
    item = F.struct("at", "turn", "sign")
    faults = ("blank", "duplicate", "truncated")
    counts = [F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in faults]
    runs = rows.groupBy("conv_id", F.shiftright("turn", RUN_BITS).alias("run")).agg(
        F.sort_array(F.collect_list(item)).alias("items"), F.min("turn").alias("low"), F.max("turn").alias("high"), *counts
    )
    runs = runs.withColumns({
        "signs": F.array_join(F.transform("items", lambda t: t["sign"]), ""),
        "turns": F.when(F.col("run").isNull(), 0).otherwise(F.size(F.array_distinct(F.transform("items", lambda t: t["turn"])))),
    })
    whole = runs.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("run", "signs"))).alias("runs"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum("turns").alias("turns"), *[F.sum(f).alias(f) for f in faults]
    )
    whole = whole.withColumn("signs", F.array_join(F.col("runs.signs"), "")).drop("runs")
    initials = F.translate("signs", _CUT + _GONE, _PLAIN * 2)
    legal = F.regexp_count(initials, F.lit("(?=su|ua|au)"))
    whole = whole.withColumn("found", _found_edits("signs"))
    return whole.select(
        "conv_id", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps"), *faults,
        (F.length("signs") - 1 - legal).cast("bigint").alias("illegal"), "found.cost", "found.audit",
    )


def _replay(batches):
    """Sorted rows of conversations, each led by its edits (at = -1): the rows that remain, in order."""
    edits, position, due_assistant, place, conv = "", 0, False, 0, None
    out: list[tuple] = []

    def emit(edit, role, text):
        nonlocal due_assistant, place
        role = role if edit == "K" else ("assistant" if due_assistant else "user")
        due_assistant = role.startswith("u")
        out.append((conv, place, edit, role, text))
        place += 1

    def insert():
        nonlocal position
        while position < len(edits) and edits[position] == "I":
            position += 1
            emit("I", None, "")

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "at", "role", "text")]
        for owner, at, role, text in zip(*columns):
            if at < 0:
                insert()
                edits, position, due_assistant, place, conv = text, 0, False, 0, owner
                continue
            insert()
            edit = edits[position]
            position += 1
            if edit != "D":
                emit(edit, role, text)
        yield _batch(out, batch.schema.field("conv_id").type)
        out.clear()
    kind = batch.schema.field("conv_id").type if edits else pa.int64()
    insert()
    if out:
        yield _batch(out, kind)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
    parts = list(zip(*rows)) or [()] * len(kinds)
    return pa.record_batch([pa.array(p, k) for p, k in zip(parts, kinds)], names=["conv_id", "place", "edit", "role", "text"])


def repaired_rows(placed: DataFrame, plans: DataFrame) -> DataFrame:
    """The sound conversations: (conv_id, place, edit, role, text), sorted inside partitions that hold whole conversations."""
    led = plans.select("conv_id", F.lit(-1).cast("bigint").alias("at"), F.lit("").alias("role"), F.col("audit").alias("text"))
    stream = led.unionByName(placed.select("conv_id", "at", "role", "text"))
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    kind = placed.schema["conv_id"].dataType.simpleString()
    return stream.mapInArrow(_replay, f"conv_id {kind}, place bigint, edit string, role string, text string")


def _hashed(batches):
    conv, state, out = None, None, []
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for owner, place, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")]):
            if place == 0:
                if state is not None:
                    out.append((conv, state.hexdigest()))
                conv, state = owner, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        yield pa.record_batch([pa.array([o[0] for o in out], kind), pa.array([o[1] for o in out], pa.string())], names=["conv_id", "repaired_sha256"])
        out = []
    if state is not None:
        yield pa.record_batch([pa.array([conv], kind), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                         order: tuple[str, ...] = ("role", "text")) -> tuple[DataFrame, DataFrame]:
    """Faults and cheapest edits of each conversation, and the rows of the sound conversations.

    The first table is (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), the second (conv_id, place, edit, role, text). Rows come
    by turn, nulls first; equal turns by the columns ``order``, by default role and text, so that repeated rows lie side by side and all
    but the first are duplicates. Null roles and texts count as one space: such a text is blank, such a role never fits.
    An empty role has no initial and never fits either. Rows with a null conversation id are one conversation. Texts of any length are
    only read past. Other columns are ignored; an empty table gives two empty ones.
    """
    named = rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), *[F.col(c) for c in order if c not in ("role", "text")],
    )
    placed = materialize(placed_rows(named, list(order)), "judged-turns")
    plans = materialize(repair_plans(placed), "repair-plans")
    return plans, repaired_rows(placed, plans)


def damaged(rows: DataFrame) -> DataFrame:
    """The conversations with faults set by a hash of (conv_id, turn); ``was_role``, ``was_text`` and ``copy`` order rows of one turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    copies = F.when(F.col("kind") == 0, F.array().cast("array<int>")).when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = rows.select("conv_id", "turn", space("role").alias("was_role"), space("text").alias("was_text"), kind.alias("kind"))
    out = out.withColumn("copy", F.explode(copies))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("was_text", "[.!?]", "")).otherwise(F.col("was_text"))
    return out.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("was_role")).alias("role"), text.alias("text"), "was_role", "was_text", "copy"
    )


def repair_report(original: DataFrame) -> DataFrame:
    """Damages the conversations, repairs them and gives one row for every original conversation."""
    plans, repaired = repair_conversations(damaged(original), order=("was_role", "was_text", "copy"))
    hashes = repaired.mapInArrow(_hashed, f"conv_id {plans.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ids = original.select("conv_id").distinct()
    out = lookup(ids, plans, ["conv_id"], null_safe=True)
    out = lookup(out, materialize(hashes, "repaired-hashes"), ["conv_id"], null_safe=True)
    return out.select(
        "conv_id", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"),
    )


def _sql() -> str:
    """The same as a table of least (cost, edits) per state, filled row by row."""
    add = lambda x, cost, edit: f"lpad((substr({x}, 1, 8)::INT + {cost})::VARCHAR, 8, '0') || substr({x}, 9) || '{edit}'"
    kept = lambda x, initial: f"CASE WHEN NOT gone AND initial = '{initial}' THEN {add(x, 'cut', 'K')} END"
    turned = lambda x: f"CASE WHEN NOT gone THEN {add(x, f'{REROLE} + cut', 'R')} END"
    closed = f"""SELECT conv_id, i, b0, b1,
        least(b2, {add('b0', INSERT, 'I')}, {add('b1', INSERT, 'I')}, {add('b3', INSERT, 'I')}) AS u,
        least(b3, {add('b2', INSERT, 'I')}, {add('b0', 2 * INSERT, 'II')}, {add('b1', 2 * INSERT, 'II')}) AS a FROM best"""
    return f"""
    WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
                           lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    named AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    d AS (SELECT conv_id, turn, coalesce(role, ' ') AS r0, coalesce(text, ' ') AS x0,
                 xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda p: ascii(substr(k, p, 1))::BIGINT)),
                     lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM named, tab),
    e AS (SELECT conv_id, turn, r0, x0, unnest(CASE kind WHEN 0 THEN []::INT[] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy,
                 CASE kind WHEN 4 THEN 'user' ELSE r0 END AS role,
                 CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x0, '[.!?]', '', 'g') ELSE x0 END AS text FROM d),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r0, x0, copy) AS i FROM e),
    f AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair,
                 CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
                      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS fault FROM o),
    g AS (SELECT *, fault IN ('b', 'd') AS gone, CASE WHEN fault = 't' THEN {CUT} ELSE 0 END AS cut FROM f),
    best AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, '00000000' AS b0, NULL::VARCHAR AS b1, NULL::VARCHAR AS b2, NULL::VARCHAR AS b3 FROM conversations
             UNION ALL
             SELECT c.conv_id, g.i, {add('b0', DELETE, 'D')}, least({add('b1', DELETE, 'D')}, {kept('b0', 's')}),
                    least({add('u', DELETE, 'D')}, {kept('least(b0, b1, a)', 'u')}, {turned('least(b0, b1, a)')}),
                    least({add('a', DELETE, 'D')}, {kept('u', 'a')}, {turned('u')})
             FROM ({closed}) c JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id AND g.i = c.i + 1),
    last AS (SELECT conv_id, least(b0, a) AS found FROM ({closed}) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
    x AS (SELECT conv_id, unnest(range(1, length(found) - 7)) AS p, substr(found, p + 8, 1) AS edit FROM last),
    y AS (SELECT *, sum((edit <> 'I')::INT) OVER w AS i, sum((edit <> 'D')::INT) OVER w AS j FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
    z AS (SELECT y.*, role, text, max((edit = 'K' AND initial = 's')::INT) OVER (PARTITION BY y.conv_id) AS led
          FROM y LEFT JOIN g ON edit <> 'I' AND g.conv_id IS NOT DISTINCT FROM y.conv_id AND g.i = y.i),
    lines AS (SELECT *, CASE WHEN edit = 'K' THEN role WHEN (j - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
                        || CASE WHEN edit = 'I' THEN '' ELSE text END AS line FROM z),
    shas AS (SELECT conv_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE edit <> 'D'), '')) AS s FROM lines GROUP BY conv_id),
    facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
                     count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
                     count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
    SELECT l.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
           coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, substr(found, 1, 8)::BIGINT AS cost,
           substr(found, 9) AS audit, coalesce(s, '{NOTHING}') AS repaired_sha256
    FROM last l LEFT JOIN shas ON shas.conv_id IS NOT DISTINCT FROM l.conv_id LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM l.conv_id"""


@query("op12_conversation_repair", _sql())
def op12_conversation_repair(spark, sf):
    return repair_report(table(spark, sf, "conversations"))

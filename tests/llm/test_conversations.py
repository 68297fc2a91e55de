"""Chat formatting and conversation repair against plain Python."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from rowloom.llm import chat_format, conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, run int, piece string"
PARTS = ["</s>", "[INST]", "[/INST]", " [/INST]", "<s> ", "<<SYS>>\n", "\n<</SYS>>\n", "[TURN] ", " [SAYS] ", " [/TURN]", "\\", "\\\\", "[", "<", "<\\", "a", "é", " ", "\n", "😀", "$1"]


def chat_rows():
    pick = random.Random(4)
    out = []
    for c in range(60):
        for t in range(pick.randrange(0, 7)):
            text = "".join(pick.choice(PARTS) for _ in range(pick.randrange(0, 9)))
            out.append((c, t, pick.choice(["system", "user", "assistant", "assistant", "tool [SAYS] x", "", "[\\TURN] "]), text))
    out += [(100, None, "user", "first"), (100, 5, None, "no role"), (100, 5, "assistant", None), (100, 5, "assistant", None), (None, 1, "assistant", "no id")]
    out += [(101, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(-300, 900)]
    out += [(102, 0, "user", "long [INST] " * 40_000), (102, 1, "assistant", "\\" * 3000)]
    return out


@pytest.fixture(scope="module")
def chats(spark):
    rows = chat_rows()
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    return rows, chat_format.format_chats(df).cache()


def by_conversation(rows):
    groups = {}
    for c, t, role, text in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: [(r[2], r[3]) for r in sorted(g)] for c, g in groups.items()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chats_are_read_back(chats):
    rows, formatted = chats
    want = by_conversation(rows)
    got = {r["conv_id"]: r for r in chat_format.chat_digests(formatted).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        learned = "".join(x for role, x in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == sha("".join(f"{role}\n{x}\n" for role, x in turns))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learned), sha(learned))


def test_spans_and_levels(chats):
    rows, formatted = chats
    want = by_conversation(rows)
    for r in formatted.collect():
        turns = want[r["conv_id"]]
        bodies = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss"]]
        plain = [x for role, x in turns if role == "assistant"]
        assert len(bodies) == len(plain)
        harmless = [b == x for b, x in zip(bodies, plain) if not any(p in x for p in ["<", "[", "\\"])]
        assert all(harmless)
        free = "".join(x for _, x in turns)
        if "\\" not in free and not any(c in free for c in chat_format.LLAMA.controls()):
            assert r["level"] == 0
        else:
            assert r["level"] >= 1
        # the body of a turn holds no control string
        assert not any(c in b for b in bodies for c in chat_format.LLAMA.controls())


@pytest.mark.parametrize("level", [1, 2])
def test_escapes_are_reversible(spark, level):
    pick = random.Random(level)
    texts = ["".join(pick.choice(PARTS) for _ in range(pick.randrange(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    out = chat_format.escaped(F.col("text"), level)
    for r in df.select("text", out.alias("e"), chat_format.unescaped(out).alias("back")).collect():
        assert r["back"] == r["text"]
        assert not any(c in r["e"] for c in chat_format.LLAMA.controls())


def test_other_template(spark):
    marks = (("user", "<|user|>\n", "<|end|>\n"), ("assistant", "<|model|>\n", "<|end|>\n"))
    made = chat_format.Template(marks, ("<|turn|>\n", "<|says|>\n", "<|over|>\n"), "^")
    df = spark.createDataFrame([(1, 0, "user", "a <|end|>\n b"), (1, 1, "assistant", "^<|model|>^"), (1, 2, "tool", "<|says|>")], "conv_id int, turn int, role string, text string")
    out = chat_format.format_chats(df, made, learned=("user", "tool"))
    r = out.withColumn("turns", chat_format.parsed(F.col("formatted"), made)).first()
    assert [tuple(t) for t in r["turns"]] == [("user", "a <|end|>\n b"), ("assistant", "^<|model|>^"), ("tool", "<|says|>")]
    assert r["formatted"] == "<|user|>\na <^|end|>\n b<|end|>\n<|model|>\n^^<^|model|>^^<|end|>\n<|turn|>\ntool<|says|>\n<^|says|><|over|>\n"
    assert [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss"]] == ["a <^|end|>\n b", "<^|says|>"]


def test_no_chats(spark):
    assert chat_format.chat_digests(chat_format.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0


def test_chat_format_is_native(spark, sf):
    plan = chat_format.op11_chat_format(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


# -- repair --------------------------------------------------------------------------------

REPAIR_SCHEMA = "conv_id long, turn long, role string, text string, at string, fault int, audit long"


def repair_rows():
    pick = random.Random(8)
    texts = ["Yes.", "No!", "cut", "", " \n", "a.b", "Same?", "Same?", "...", "word. "]
    out = []
    for c in range(250):
        for t in range(pick.randrange(1, 9)):
            role = pick.choice(["user", "assistant"]) if pick.random() < 0.5 else ["user", "assistant"][t % 2]
            out.append((c, t if pick.random() < 0.9 else t + 3, "system" if t == 0 and pick.random() < 0.4 else role, pick.choice(texts) + (str(pick.randrange(9)) + "." if pick.random() < 0.5 else "")))
    out += [(300, None, "user", "a."), (300, 7, None, "b."), (300, 7, "tool", None), (300, 7, "", "c."), (300, 9, "unit", "d"), (None, 1, "assistant", "e."), (None, 1, "assistant", "e.")]
    out += [(301, t, ["user", "assistant"][t % 2], f"t{t}" + "." * (t % 5 > 0)) for t in range(1500)]
    out += [(302, 0, "user", "x" * 200_000), (302, 1, "assistant", "y. " + " " * 5000)]
    return out


def plain_damage(rows):
    """Rows by conversation after damage, in order."""
    groups = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        was = (turn is not None, turn or 0, role, text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        groups[conv] += [(*was, copy, turn, role, text) for copy in range(2 if kind == 3 else 1)]
    return {c: [r[-3:] for r in sorted(g, key=lambda r: r[:5])] for c, g in groups.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def least_edits(rows, found):
    """Least cost, and of the cheapest edits the least by ASCII, by a table over all states."""
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "")}

    def offer(table, state, cost, edits):
        if state not in table or (cost, edits) < table[state]:
            table[state] = (cost, edits)

    def inserted(table):
        out = dict(table)
        for _ in range(3):
            for state, (cost, edits) in list(out.items()):
                offer(out, due[state], cost + 2, edits + "I")
        return out

    for (_, role, _), fault in zip(rows, found):
        after = {}
        for state, (cost, edits) in inserted(best).items():
            offer(after, state, cost + 3, edits + "D")
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                offer(after, due[state], cost + 2 + cut, edits + "R")
                if role[:1] == due[state] or (state == "" and role[:1] == "s"):
                    offer(after, role[:1], cost + cut, edits + "K")
        best = after
    return min(v for k, v in inserted(best).items() if k in ("", "a"))


def repaired(rows, edits):
    lines, state, i = [], "", 0
    for e in edits:
        role, text = (None, "") if e == "I" else rows[i][1:]
        i += e != "I"
        if e != "D":
            role = role if e == "K" else "assistant" if state == "u" else "user"
            state = role[0]
            lines.append(f"{role}:{text}")
    assert i == len(rows)
    return "\n".join(lines)


def test_repair_against_a_table_of_states(spark):
    rows = repair_rows()
    df = spark.createDataFrame([(*r, "clash", 1, 1) for r in rows], REPAIR_SCHEMA)
    got = {r["conv_id"]: r for r in conversation_repair.repair_report(df).collect()}
    want = plain_damage(rows)
    assert got.keys() == want.keys()
    for c, after in want.items():
        found = faults(after)
        cost, audit = least_edits(after, found)
        turns = {t for t, _, _ in after if t is not None}
        initials = [role[:1] for _, role, _ in after]
        r = got[c]
        assert (r["blank"], r["duplicate"], r["truncated"]) == tuple(found.count(f) for f in ("blank", "duplicate", "truncated"))
        assert r["gaps"] == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
        assert r["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        assert (r["cost"], r["audit"]) == (cost, audit)
        assert r["repaired_sha256"] == sha(repaired(after, audit))


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Hello."), (1, 2, "user", "Again?"), (2, 0, "assistant", ""), (3, 0, "system", "Be kind."), (3, 1, "assistant", "Hm")]
    plans, fixed = conversation_repair.repair_conversations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in plans.collect()} == {1: (5, "KDR"), 2: (3, "D"), 3: (3, "KIK")}
    assert [tuple(r) for r in fixed.orderBy("conv_id", "place").collect()] == [
        (1, 0, "K", "user", "Hello."), (1, 1, "R", "assistant", "Again?"), (3, 0, "K", "system", "Be kind."), (3, 1, "I", "user", ""), (3, 2, "K", "assistant", "Hm"),
    ]


def test_search_is_linear_in_the_rows():
    pick = random.Random(1)
    signs = "".join(pick.choice("suaSUA01-=") for _ in range(30_000))
    cost, audit = conversation_repair.search_edits(signs)
    assert len(audit) - audit.count("I") == len(signs)
    spent = audit.count("D") * 3 + (audit.count("I") + audit.count("R")) * 2
    row = iter(signs)
    spent += sum(e != "D" and next_sign in "SUA=" for e, next_sign in ((e, next(row)) for e in audit if e != "I"))
    assert spent == cost


def test_no_conversations(spark):
    assert conversation_repair.repair_report(spark.createDataFrame([], REPAIR_SCHEMA)).count() == 0


def test_a_large_conversation_stays_spread(spark):
    """A conversation with most of the rows lies in several tasks until only its signs are left."""
    df = spark.range(40_000).select(
        F.lit(5).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id", F.lit(".")).alias("text")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a few small partitions would be put together
    try:
        placed = conversation_repair.placed_rows(df, ["role", "text"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert placed.select(F.shiftright("at", 33)).distinct().count() > 1
    r = conversation_repair.repair_plans(placed).first()
    assert (r["cost"], r["illegal"], r["gaps"], r["audit"]) == (0, 0, 0, "K" * 40_000)

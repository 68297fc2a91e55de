"""Chat formatting with a grammar round trip.

Every turn is rendered between the marks of its role, the rendered text is read back by a deterministic parser, and what does
not come back as it was is escaped more strongly until it does:

* level 0: the text as it is
* level 1: the escape sign is doubled, and a sign that begins one of the template's control strings is followed by an escape sign
* level 2: so is every sign that could begin a control string

The parser cuts a text behind every end mark, tells the role from the start mark and drops the escape signs. Control strings hold no
escape sign, so an escaped text holds no control string, and level 2 is always read back. Turns are judged one by one, then whole
conversations; a conversation that does not come back would be an error.

Turns are joined in runs of neighbouring turn numbers before they meet in their conversation, where only rendered runs are left. A
formatted conversation is one value, so its length is bounded by what one string can hold (2 GB).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .registry import query, table

LEVELS = 3
RUN_BITS = 8  # turn numbers 0-255, 256-511, ... are joined first


@dataclass(frozen=True)
class Template:
    """Start and end mark of each role; ``other`` marks a turn of any other role, whose name stands before ``says``.

    Marks contain no escape sign, and no mark begins with another one's control string.
    """

    marks: tuple[tuple[str, str, str], ...] = (
        ("system", "<<SYS>>\n", "\n<</SYS>>\n"), ("user", "[INST] ", " [/INST]"), ("assistant", "<s> ", " </s>"),
    )
    other: tuple[str, str, str] = ("[TURN] ", " [SAYS] ", " [/TURN]")
    escape: str = "\\"

    def controls(self) -> list[str]:
        """The control strings: all marks without the white space around them."""
        found = [m.strip() for _, start, end in self.marks for m in (start, end)] + [m.strip() for m in self.other]
        return list(dict.fromkeys(found))

    def ends(self) -> list[str]:
        return [end for _, _, end in self.marks] + [self.other[2]]


LLAMA = Template()


def _any(strings: list[str]) -> str:
    return "|".join(re.escape(s) for s in sorted(strings, key=len, reverse=True))


def escaped(text: Column, level: int, template: Template = LLAMA) -> Column:
    """``text`` at an escape level."""
    if level == 0:
        return text
    sign = template.escape
    doubled = F.replace(text, F.lit(sign), F.lit(sign * 2))
    first = sorted({c[0] for c in template.controls()})
    if level == 1:
        pattern = "|".join(f"{re.escape(f)}(?={_any([c[1:] for c in template.controls() if c[0] == f])})" for f in first)
    else:
        pattern = _any(first)
    return F.regexp_replace(doubled, f"({pattern})", f"$1{re.escape(sign)}")


def unescaped(text: Column, template: Template = LLAMA) -> Column:
    """``text`` without escape signs: a sign stands for what follows it."""
    return F.regexp_replace(text, f"(?s){re.escape(template.escape)}(.?)", "$1")


def rendered(role: Column, body: Column, template: Template = LLAMA) -> Column:
    """A turn between its marks; ``body`` is escaped already. The name of another role is escaped at level 2."""
    start, says, end = template.other
    out = F.concat(F.lit(start), escaped(role, LEVELS - 1, template), F.lit(says), body, F.lit(end))
    for name, a, b in reversed(template.marks):
        out = F.when(role == name, F.concat(F.lit(a), body, F.lit(b))).otherwise(out)
    return out


def body_start(role: Column, template: Template = LLAMA) -> Column:
    """Code points of a rendered turn before its body."""
    start, says, _ = template.other
    out = F.length(escaped(role, LEVELS - 1, template)) + len(start) + len(says)
    for name, a, _ in reversed(template.marks):
        out = F.when(role == name, F.lit(len(a))).otherwise(out)
    return out


def _parsed_turn(piece: Column, template: Template) -> Column:
    """(role, text) of one rendered turn; null if it is none, or if a control string stands in its body."""
    start, says, end = template.other
    size, control = F.length(piece), _any(template.controls())
    says_at = F.instr(piece, says)
    inner = F.substr(piece, F.lit(len(start) + 1), says_at - 1 - len(start))
    rest = F.substr(piece, says_at + len(says), size - says_at - len(says) + 1 - len(end))
    fits = piece.startswith(start) & piece.endswith(end) & (says_at > len(start)) & ~inner.rlike(control) & ~rest.rlike(control)
    out = F.when(fits, F.struct(unescaped(inner, template).alias("role"), unescaped(rest, template).alias("text")))
    for name, a, b in template.marks:
        body = F.substr(piece, F.lit(len(a) + 1), size - len(a) - len(b))
        fits = piece.startswith(a) & piece.endswith(b) & (size >= len(a) + len(b)) & ~body.rlike(control)
        out = F.when(fits, F.struct(F.lit(name).alias("role"), unescaped(body, template).alias("text"))).otherwise(out)
    return out


def parsed(text: Column, template: Template = LLAMA) -> Column:
    """The turns array<struct<role, text>> of a rendered text; a piece that is no turn gives null."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).*?(?:{_any(template.ends())}|\z)"), F.lit(0))
    return F.transform(F.filter(pieces, lambda p: p != ""), lambda p: _parsed_turn(p, template))


def _same(found: Column, role: Column, text: Column) -> Column:
    """Whether the parser found exactly the one turn (role, text)."""
    one = F.element_at(found, 1)
    return (F.size(found) == 1) & F.coalesce((one["role"] == role) & (one["text"] == text), F.lit(False))


def rendered_turns(turns: DataFrame, template: Template = LLAMA) -> DataFrame:
    """Adds ``piece``, the rendered turn at its lowest level that is read back, and ``level``. A stronger level is tried only where it is needed."""
    role, text = F.col("role"), F.col("text")
    at = lambda i: rendered(role, escaped(text, i, template), template)
    chosen = lambda i: F.struct(F.lit(i).alias("level"), at(i).alias("piece"))
    best = chosen(LEVELS - 1)
    for i in reversed(range(LEVELS - 1)):
        best = F.when(_same(parsed(at(i), template), role, text), chosen(i)).otherwise(best)
    return turns.withColumn("best", best).select("*", "best.level", "best.piece").drop("best")


def format_chats(rows: DataFrame, template: Template = LLAMA, learned: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss (array of <start, length> in code points), turns (as read back), level.

    ``loss`` names the bodies of the turns of the ``learned`` roles in ``formatted``, ``turns`` is what the parser makes of ``formatted``, ``level`` is
    the highest escape level used. Turns come by turn number, nulls first; equal numbers by role, then rendered text, and repeated rows are all
    kept. Null texts and roles count as empty; an empty text is a turn with an empty body, an empty role a role of its own. Rows with a null
    conversation id are one conversation. Other columns are ignored. Long texts are handled whole. An empty table gives an empty
    result. A conversation that is not read back raises an error.
    """
    turns = rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    turns = rendered_turns(turns, template).withColumn("mark", F.xxhash64("role", "text"))

    # runs of turns
    item = F.struct("turn", "role", "piece", "mark", "level")
    runs = turns.groupBy("conv_id", F.shiftright(F.col("turn").cast("bigint"), RUN_BITS).alias("run")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    runs = runs.select(
        "conv_id", "run", F.array_join(F.transform("items", lambda t: t["piece"]), "").alias("formatted"), F.array_max(F.transform("items", lambda t: t["level"])).alias("level"),
        F.transform("items", lambda t: t["mark"]).alias("marks"), _spans(F.col("items"), learned, template).alias("spans"),
    )

    # whole conversations: where each run starts, then all runs in order
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("at", F.coalesce(F.sum("spans.at").over(before), F.lit(0)))
    moved = F.transform("spans.out", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), s["length"].alias("length")))
    whole = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("run", "formatted", "marks", moved.alias("loss")))).alias("runs"), F.max("level").alias("level"))
    whole = whole.select(
        "conv_id", "level", F.array_join(F.col("runs.formatted"), "").alias("formatted"), F.flatten("runs.marks").alias("marks"), F.flatten("runs.loss").alias("loss")
    )
    whole = whole.withColumn("turns", parsed(F.col("formatted"), template))
    found = F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"]))
    checked = F.when(found.eqNullSafe(F.col("marks")), F.col("turns")).otherwise(
        F.raise_error(F.concat(F.lit("a conversation is not read back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    )
    return whole.select("conv_id", F.size("marks").cast("bigint").alias("n_turns"), "formatted", "loss", checked.alias("turns"), "level")


def _spans(items: Column, learned: tuple[str, ...], template: Template) -> Column:
    """<at, out>: the code points of a run, and <start, length> of its learned bodies from its beginning."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("out"))
    tails = {name: len(b) for name, _, b in template.marks}
    tail = lambda role: F.coalesce(*[F.when(role == n, F.lit(k)) for n, k in tails.items()], F.lit(len(template.other[2])))

    def step(state, t):
        size, head = F.length(t["piece"]), body_start(t["role"], template)
        span = F.struct((state["at"] + head).alias("start"), (size - head - tail(t["role"])).cast("bigint").alias("length"))
        out = F.when(t["role"].isin(*learned), F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct((state["at"] + size).cast("bigint").alias("at"), out.alias("out"))

    return F.aggregate(items, zero, step)


def chat_digests(chats: DataFrame, template: Template = LLAMA) -> DataFrame:
    """What is read back from formatted conversations: turns by the parser, learned text by the spans."""
    learned = F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")), template))
    out = chats.withColumn("learned_text", F.array_join(learned, ""))
    return out.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned_text").cast("bigint").alias("loss_chars"), F.sha2("learned_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


PROBE = "</s>[INST] ok [/INST]"
PROBE_ID = -7


def with_probe(rows: DataFrame) -> DataFrame:
    """The conversations and one more whose texts hold the template's control strings."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    probe = rows.sparkSession.range(2).select(
        F.lit(PROBE_ID).cast(kind["conv_id"]).alias("conv_id"), F.col("id").cast(kind["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)


# fixed values: the template's control strings, as above
_CONTROL = r"<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[TURN\]|\[SAYS\]|\[/TURN\]"

SQL = rf"""
    WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE}' UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE}'),
    e AS (SELECT *, CASE WHEN contains(text, '\') OR regexp_matches(text, '{_CONTROL}')
                         THEN length(replace(text, '\', '\\')) + len(regexp_extract_all(replace(text, '\', '\\'), '{_CONTROL}')) ELSE length(text) END AS body,
                    CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9
                              ELSE 23 + length(regexp_replace(replace(role, '\', '\\'), '([<\[])', '\1\\', 'g')) END AS marks FROM r)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           sum(body + marks)::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id"""


@query("op11_chat_format", SQL)
def op11_chat_format(spark, sf):
    return chat_digests(format_chats(with_probe(table(spark, sf, "conversations"))))

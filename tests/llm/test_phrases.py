"""Phrase mining against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowloom.llm import phrase_mining

SCHEMA = "doc_id long, text string, lang string, phrase string, k int, n long"


def plain_pieces(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split(r"[\x20\x09]+", piece) if w] for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def plain_collocations(rows, support, top, absorbed=80):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in plain_pieces(text):
            totals[lang or "und"] += len(piece)
            for k in range(1, 5):
                for i in range(len(piece) - k + 1):
                    counts[lang or "und"][tuple(piece[i : i + k])] += 1
    out = set()
    for lang, found in counts.items():
        frequent = {p: a for p, a in found.items() if a >= support}
        longest = Counter()
        for p, a in frequent.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longest[p[i : i + size]] = max(longest[p[i : i + size]], a)
        kept = []
        for p, a in frequent.items():
            if len(p) > 1 and 100 * longest[p] < absorbed * a:
                score, _, left, right = min((2_000_000 * a // (found[p[:i]] + found[p[i:]]), i, found[p[:i]], found[p[i:]]) for i in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def phrase_rows():
    pick = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Über", "CAFÉ", "ﬁ", "a\x0bb", "it's"]
    weights = [1 / (i + 1) for i in range(len(words))]
    out = []
    for i in range(700):
        parts = []
        for _ in range(pick.randrange(0, 30)):
            parts += ["new", "York", "city", "hall"] if pick.random() < 0.08 else pick.choices(words, weights)
            if pick.random() < 0.15:
                parts[-1] += pick.choice([".", ",", "\n", "\r\n", "?!", "\t"])
        out.append((i % 650, pick.choice([" ", "  "]).join(parts), pick.choice(["en", "en", "en", "de", None])))
    # phrases that stand in a few documents only, so that a sample may not see them
    out += [(10_000 + i, "rare pearl diver sings . " * 45, "fr") for i in range(3)]
    out += [(20_000, "aa aa aa aa aa aa " * 50, "fr"), (20_001, None, "en"), (20_002, "", None), (None, " . , \n", "xx"), (20_003, "x " * 60_000, "long")]
    return out + out[:3]


@pytest.fixture(scope="module")
def table(spark):
    rows = phrase_rows()
    return rows, spark.createDataFrame([(*r, "clash", 1, 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("support,top", [(30, 2000), (5, 40)])
def test_collocations(table, support, top):
    rows, df = table
    got = {tuple(r) for r in phrase_mining.collocations(df, support, top).collect()}
    assert got == plain_collocations(rows, support, top)


def test_a_poor_sample_changes_nothing(table, monkeypatch):
    """Nothing is proposed: everything is found by the expansion of border failures."""
    rows, df = table
    monkeypatch.setattr(phrase_mining, "SAMPLE_ONE_IN", 1 << 38)
    assert {tuple(r) for r in phrase_mining.collocations(df, 20, 500).collect()} == plain_collocations(rows, 20, 500)


def test_full_marks_change_nothing(table, monkeypatch):
    """Every bit set: everything is counted."""
    rows, df = table
    monkeypatch.setattr(phrase_mining, "LEAST_BITS", 64)
    monkeypatch.setattr(phrase_mining, "MOST_BITS", 64)
    assert {tuple(r) for r in phrase_mining.collocations(df, 20, 500).collect()} == plain_collocations(rows, 20, 500)


def test_frequent_phrases_are_exact(table):
    rows, df = table
    got = {(r["lang"], r["phrase"], r["n"]) for r in phrase_mining.frequent_phrases(df, 30).filter("k > 0").collect()}
    counts = Counter()
    for _, text, lang in rows:
        for piece in plain_pieces(text):
            counts.update((lang or "und", " ".join(piece[i : i + k])) for k in range(1, 5) for i in range(len(piece) - k + 1))
    assert got == {(*p, n) for p, n in counts.items() if n >= 30}


def test_split_pieces():
    texts = ["One  two,three\tFOUR. five", None, "", "six", "seven\n\x0beight", "\x0c", "ÀB c"]
    got = phrase_mining.split_pieces(pa.array(["skipped", *texts]).slice(1))
    words = [got.vocab[i].as_py().decode() for i in got.codes]
    assert words == ["one", "two", "three", "four", "five", "six", "seven", "eight", "Àb", "c"]
    assert got.texts.tolist() == [0, 0, 0, 0, 0, 3, 4, 4, 6, 6]
    assert got.follows.tolist() == [False, True, False, True, False, False, False, False, False, True]
    assert not len(phrase_mining.split_pieces(pa.array([], pa.string())).codes)


def test_score_passes_64_bits(spark):
    row = spark.range(1).select(phrase_mining._score(F.lit(9_000_000_000_000_000_000), F.lit(9_000_000_000_000_000_001), F.lit(9_100_000_000_000_000_000)).alias("s")).first()
    assert row["s"] == 2_000_000 * 9_000_000_000_000_000_000 // 18_100_000_000_000_000_001


def test_buckets_never_count_too_little(spark, table):
    """All words and all candidate pairs found often are marked, whatever the number of buckets."""
    rows, df = table
    texts = df.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = phrase_mining.frequent_buckets(texts, 1, [], range(1, 2), 1 << 16)
    for entries in (16, 1 << 22):
        marks = phrase_mining.frequent_buckets(texts, 30, [words], range(1, 3), entries)
        tokens = phrase_mining.Tokens(pa.RecordBatch.from_pylist([{"lang": lang or "und", "text": text} for _, text, lang in rows], pa.schema([("lang", pa.string()), ("text", pa.string())])))
        for k in (1, 2):
            places = np.flatnonzero(tokens.both(np.ones(tokens.size, bool), 2)) if k == 2 else np.arange(tokens.size)
            often = Counter(zip(*[tokens.ids[places + i].tolist() for i in range(k)]))
            marked = marks.has(tokens.phrase_hashes(places, k))
            keys = list(zip(*[tokens.ids[places + i].tolist() for i in range(k)]))
            assert all(m for m, key in zip(marked, keys) if often[key] >= 30)
            if entries > 1 << 20:
                assert not any(m for m, key in zip(marked, keys) if often[key] < 30)


def test_no_documents(spark):
    assert phrase_mining.collocations(spark.createDataFrame([], SCHEMA)).count() == 0

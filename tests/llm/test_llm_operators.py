"""Each operator against a brute-force version, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from rowloom.llm import context_mixing, exact_dedup, kd_shards, language_id, latent_leaks, mixing, ngram_join, token_counts, toxicity, url_rules
from rowloom.llm.common import components

LONG = " ".join(f"w{i % 977}" for i in range(20_000))
EDGES = [
    (900_001, "one two three four five six seven", "en", "s1", 33), (900_001, "one two three four five six seven", "en", "s1", 33),
    (900_002, None, None, None, None), (None, "one  two\tthree four five six seven", "en", None, 33), (900_003, "", "de", "s2", 0),
    (900_004, " \n ", "fr", "s2", 3), (900_005, LONG, "en", "s1", len(LONG)), (900_006, "ONE two", "es", "s3", 7), (900_007, "one TWO", "es", "s3", 7),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = ["size", "shard", "keep_id", "score", "at", "token", "id", "copies", "component_id", "held_out", "kept", "label", "norm", "h", "n"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    """Real documents, rows for each special case, and columns named like the operators' own."""
    real = spark.read.parquet(f"{sf}/documents.parquet").select(*[c.split()[0] for c in SCHEMA.split(", ")])
    return real.unionByName(spark.createDataFrame(EDGES, SCHEMA)).withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def test_content_sort(docs, plain, none):
    groups = defaultdict(list)
    for i, text, _ in plain:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    want = Counter()
    for text, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda x: (x is None, x))):
            want[i, least, len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in exact_dedup.content_sort(docs).collect()) == want
    assert exact_dedup.content_sort(none).count() == 0


def test_content_sort_of_a_hot_text(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot  text").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    got = exact_dedup.content_sort(rows.repartition(7))
    hot = got.filter("group_size > 1")
    assert hot.count() == 1334 and [tuple(r) for r in hot.select("keep_id", "group_size").distinct().collect()] == [(0, 1334)]
    assert [r["doc_id"] for r in hot.filter("kept").collect()] == [0] and got.filter("kept").count() == 4000 - 1333


PAGES = [
    (1, "http://bad.com/x", None), (2, "https://www.copy.net/x?utm_source=a", '<link rel="canonical" href="http://bad.com/x">'), (3, "http://third.net/y", '<meta http-equiv="refresh" content="0; url=http://copy.net/x">'),
    (4, "http://good.org/z", '<link href="http://bad.com/x" rel=canonical>'), (5, None, None), (6, "no scheme", "x"), (7, "HTTP://Sub.BAD.com/x#f", ""), (8, "http://notbad.com/x", None), (9, "http://far.net/q", None), (9, "http://far.net/q", None),
    (10, "http://alone.net/", None), (11, "http://alone.net", None),
]


def test_url_classes(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "alias", "verdict", "node")})
    rules = spark.createDataFrame([("bad.com", "/", "block")], "host string, path string, verdict string")
    more = spark.createDataFrame([("http://far.net/q", "http://third.net/y"), (None, "http://x.net")], "from_url string, to_url string")
    got = {r["page_id"]: r for r in url_rules.judge_urls(pages, rules, redirects=more).collect()}
    assert {i for i, r in got.items() if r["verdict"] == "block"} == {1, 2, 3, 4, 7, 9}
    assert got[7]["host"] == "Sub.BAD.com".lower() and got[7]["rule"] == "bad.com/" and got[2]["rule"] is None
    assert (got[5]["host"], got[5]["path"], got[6]["host"], got[6]["alias"]) == ("", "", "", None) and got[10]["alias"] == got[11]["alias"]
    allow = rules.unionByName(spark.createDataFrame([("good.org", "/", "allow")], rules.schema))
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge_urls(pages, allow, redirects=more).collect()}
    assert {i for i, v in got.items() if v == "block"} == {1, 7}  # an allowed alias wins over an inherited block, not over an own rule
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0


def brute_components(plain, n, num, den):
    sets = []
    for _, text, _ in plain:
        w = words(text)
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    up = list(range(len(plain)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both * den >= num * (len(sets[a]) + len(sets[b]) - both):
                up[max(top(a), top(b))] = min(top(a), top(b))
    ids = defaultdict(list)
    for k, (i, _, _) in enumerate(plain):
        ids[top(k)].append(i)
    return Counter((i, len(sets[k]), min((x for x in ids[top(k)] if x is not None), default=None) if sets[k] else i) for k, (i, _, _) in enumerate(plain))


def test_ngram_join(spark, docs, plain, none):
    assert Counter(tuple(r) for r in ngram_join.ngram_join(docs).collect()) == brute_components(plain, 4, 85, 100)
    assert ngram_join.ngram_join(none).count() == 0


def test_ngram_join_of_a_chain_and_common_passages(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"v{i}" for i in range(400)]
    passage, rows = list(rng.choice(vocabulary, 60)), []
    base = list(rng.choice(vocabulary, 120))
    for i in range(60):  # a chain of texts that drift apart
        base = [w if rng.random() > 0.01 else str(rng.choice(vocabulary)) for w in base]
        rows.append((i, " ".join(base)))
    for i in range(60, 140):
        rows.append((i, " ".join(passage + list(rng.choice(vocabulary, int(rng.integers(1, 60)))))))
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), n=5, num=80)
    assert Counter(tuple(r) for r in got.collect()) == brute_components([(*r, None) for r in rows], 5, 80, 100)


def test_ngram_join_looks_into_groups(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sizes = [int(x) for x in rng.integers(16, 28, 120)]
    sets = [sorted(int(x) for x in rng.choice(30, k, replace=False)) for k in sizes]  # prefixes: the first shingles
    prefix = [s[: len(s) - -(-80 * len(s) // 100) + 1] for s in sets]
    root = [40 * (i // 40) if i < 80 else i for i in range(120)]  # two groups of 40 and classes of their own
    of_class = spark.createDataFrame([(i, len(s), p) for i, (s, p) in enumerate(zip(sets, prefix))], "cid bigint, n bigint, prefix array<bigint>")
    groups = spark.createDataFrame([(i, root[i]) for i in range(80)], "node bigint, root bigint")
    monkeypatch.setattr(ngram_join, "SALT_ROWS", 7)  # several salts for a shingle
    members = ngram_join.grouped_classes(of_class, groups)
    tokens = ngram_join.token_rows(members, ngram_join.shared_tokens(of_class))
    table = ngram_join.token_groups(tokens).cache()
    matrix = [(r["token"], r["grp"]) for r in table.collect()]
    times = Counter(t for p in prefix for t in p)
    assert Counter(matrix) == Counter({(t, root[i]) for i, p in enumerate(prefix) for t in p if times[t] > 1})
    opened = ngram_join.opened_groups(tokens, table, 80, 100)
    inside = ngram_join.member_pairs(opened.filter("k > 1"), members, tokens, table, 80, 100)
    got = Counter(tuple(sorted(r)) for r in opened.filter("k = 1").select("a", "grp").union(inside).collect())
    want = Counter()
    for b in range(120):
        for a in range(b):
            seen, (na, nb) = len(set(prefix[a]) & set(prefix[b])), (len(sets[a]), len(sets[b]))
            behind = max(-(-80 * n // 100) - 1 for n in (na, nb))
            if root[a] != root[b] and seen and min(na, nb) * 100 >= max(na, nb) * 80 and (seen + behind) * 180 >= 80 * (na + nb):
                want[a, b] += 1
    # no pair is lost or met twice, and each is of different groups and fitting sizes
    assert want and set(want) <= set(got) and max(got.values()) == 1
    assert all(root[a] != root[b] and min(len(sets[a]), len(sets[b])) * 100 >= max(len(sets[a]), len(sets[b])) * 80 for a, b in got)


def test_bit_maps_bound_every_pair(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 400)
    sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(300, 400)), replace=False), rng.integers(0, 1 << 62, int(rng.integers(0, 90)))])) for _ in range(60)]
    rows = []
    for i, s in enumerate(sets):
        bits = np.zeros(ngram_join.MAP_BITS, bool)
        bits[(s.astype(np.uint64) >> np.uint64(24)) & np.uint64(ngram_join.MAP_BITS - 1)] = True
        rows.append((i, len(s), np.packbits(bits).view(np.int64).tolist()))
    maps = spark.createDataFrame(rows, "cid bigint, n bigint, bits array<bigint>")
    pairs = [(a, b) for b in range(60) for a in range(b)]
    kept = {tuple(r) for r in ngram_join.within_bounds(spark.createDataFrame(pairs, "a bigint, b bigint"), maps, 80, 100).collect()}
    similar = {(a, b) for a, b in pairs if len(np.intersect1d(sets[a], sets[b])) * 100 >= len(np.union1d(sets[a], sets[b])) * 80}
    assert similar and similar <= kept and len(kept) < len(pairs) / 2


def test_ngram_join_of_near_copies_meets_no_square(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [f"v{i}" for i in range(300)]
    rows = []
    for i in range(150):  # different near copies of one text
        w = list(base)
        w[int(rng.integers(0, 300))] = f"x{i}"
        rows.append((i, " ".join(w)))
    met, write = {}, ngram_join.materialize
    monkeypatch.setattr(ngram_join, "discard", lambda *tables: None)  # they are read below
    monkeypatch.setattr(ngram_join, "materialize", lambda df, tag="table": met.setdefault(tag, write(df, tag)) if tag in ("token-groups", "members") else write(df, tag))
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert {r["component_id"] for r in got} == {0}
    pairs = met["members"].select(F.col("grp").alias("ga"), F.explode("prefix").alias("token")).join(met["token-groups"], "token")
    old = sum(n * n for n in Counter(t for r in met["members"].collect() for t in r["prefix"]).values())
    assert pairs.filter("ga <> grp").count() < old / 10


def test_mixing(docs, plain, none):
    got = mixing.mix(docs).collect()
    size = defaultdict(int)
    for _, text, source in plain:
        size[source] += len(words(text))
    weights = {s: float((3, 1, 2)[k % 3]) for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    left, target = 1.5 * sum(size.values()), {}
    free = set(size)
    while free:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 2 * size[s]}
        target |= {s: 2.0 * size[s] if s in over else level * weights[s] for s in (over or free)}
        left -= sum(2 * size[s] for s in over)
        free = free - over if over else set()
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["taken"]
    largest = {s: max(r["size"] for r in got if r["source"] == s) for s in size}  # a source of one long text cannot come nearer than half of it
    assert len(got) == len(plain) and all(abs(taken[s] - target[s]) <= max(0.02 * target[s], 40, largest[s] / 2) for s in size)
    again = mixing.mix(docs.repartition(3)).groupBy("doc_id").agg(F.sum("taken")).collect()
    first = defaultdict(int)
    for r in got:
        first[r["doc_id"]] += r["taken"]
    assert {r[0]: r[1] for r in again} == dict(first)
    assert mixing.mix(none).count() == 0


def test_k_d_shards(docs, plain, none):
    got = kd_shards.kd_shards(docs, kd_shards.document_dims(), kd_shards.text_size(), shards=4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in plain)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert set(by) == {0, 1, 2, 3} and all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values())
    sums, largest = [sum(r["size"] for r in rs) for rs in by.values()], max(r["size"] for r in got)
    assert max(sums) - min(sums) <= 2 * largest
    assert kd_shards.kd_shards(none, kd_shards.document_dims(), kd_shards.text_size(), shards=4).count() == 0


def test_token_counts(docs, plain, none):
    encoder, sizes = token_counts._encoder(token_counts.read_vocabulary(token_counts.VOCABULARY))
    got = defaultdict(list)
    for r in token_counts.count_tokens(docs, token_counts.lines()).collect():
        got[r["doc_id"]].append(r)
    for i, text, _ in plain:
        if i in (None, 900_001):
            continue
        rows = sorted(got[i], key=lambda r: r["part"] or 0)
        tokens = encoder.encode_ordinary(text or "")
        assert sum(r["tokens"] for r in rows) == len(tokens) == rows[0]["document_tokens"]
        assert text is None or [text[r["start"] : r["end"]] for r in rows] == re.findall(r"[^\n]*\n|[^\n]+$|^$", text)[: len(rows)]
    assert len(got[900_001]) == 2 and got[900_002][0]["part"] is None
    assert token_counts.count_tokens(none, token_counts.lines()).count() == 0


@pytest.mark.parametrize("rule, want", [("first", [2, 0, 0, 1]), ("last", [1, 0, 1, 1]), ("largest", [1, 0, 1, 1]), ("split", [1 + 1 / 3, 0, 2 / 3, 1])])
def test_crossing_tokens(rule, want):
    counts, crossing = token_counts.attribute(np.array([0, 3, 6]), np.array([3, 6, 8]), np.array([0, 4, 4, 6, 8]), rule)
    assert counts.tolist() == pytest.approx(want) and crossing.tolist() == [1, 0, 1, 0]


def test_language_model(docs, plain, none):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    from rowloom.llm.common import fold

    got = context_mixing.score_texts(docs, fold(F.col("doc_id"), 10) == 0).collect()
    counts = Counter(w for i, t, _ in plain if not held(i) for w in [*words(t), "\n"])
    total, distinct = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in [*words(t), "\n"])
    want = Counter((i, held(i), len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), "\n"]), total, round(base(t), 4)) for i, t, _ in plain)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 and 0 < r["bits_per_byte"] < 8.5 for r in got if r["n_tokens"] > 1)
    # a text without words is its end alone, one byte that comes once in a text: it costs about what its share of all tokens says
    surprise = math.log2(total / counts["\n"])
    ends = [r["bits_per_byte"] for r in got if r["n_tokens"] == 1]
    assert ends and all(abs(b - surprise) < 3 for b in ends)
    assert context_mixing.score_texts(none, fold(F.col("doc_id"), 10) == 0).count() == 0


def test_bits_of_a_byte_are_a_distribution():
    import pyarrow as pa

    model = context_mixing.MixingModel([np.zeros(1 << b, np.uint16) for b in context_mixing.SLOT_BITS], np.zeros(1 << 24, bool))
    model.tables[0][:] = np.random.default_rng(1).integers(0, 1 << 16, len(model.tables[0]))
    some = [bytes([a]).decode() for a in range(128) if a not in (9, 10, 11, 12, 13, 32)]
    bits = model.word_bits(pa.array(some), np.zeros(len(some), np.int64))
    assert 0 < np.exp2(-bits).sum() <= 1.0


def test_weights_learn_from_every_training_pair(spark):
    import pyarrow as pa

    texts = [(i, " ".join(f"w{i % 97}x{j * i}" for j in range(90))) for i in range(1000)]  # 90,000 words, most of them once or twice
    rows = spark.createDataFrame(texts, "doc_id int, text string").withColumn("held_out", F.col("doc_id") % 10 == 0)
    signs = pa.array([], pa.string())
    pairs = context_mixing.count_pairs(rows, signs)
    model = context_mixing.MixingModel([np.zeros(1 << b, np.uint16) for b in context_mixing.SLOT_BITS], np.zeros(1 << 24, bool))
    weights, hits = context_mixing.learned(pairs, model, still=True)
    learn = [w for i, t in texts if i % 10 for w in t.split()]
    assert hits.sum() == 8 * (sum(len(w) + 1 for w in learn) + 900)  # every bit of every word, and the ends
    assert np.isfinite(weights).all()
    whole = context_mixing.fit_model(pairs, sorted(set(learn)))
    some = sorted(set(learn))[:300]
    alone = [whole.word_bits(pa.array([w]), np.zeros(1, np.int64))[0] for w in some]
    assert whole.word_bits(pa.array(some), np.zeros(300, np.int64)).tolist() == pytest.approx(alone)  # beginnings coded once
    start = context_mixing.MixingModel(whole.tables, whole.known)
    assert sum(alone) < start.word_bits(pa.array(some), np.zeros(300, np.int64)).sum()


@pytest.mark.parametrize("n", [3_000, 520_000])
def test_weights_settle_at_every_size(spark, n):
    word = F.concat(F.conv(F.pmod(F.xxhash64("id"), F.lit(40_000)).cast("string"), 10, 30), F.when(F.col("id") % 3 == 0, "a").otherwise(F.conv(F.col("id").cast("string"), 10, 7)))
    pairs = spark.range(n).select(word.alias("word"), (F.col("id") % 32).cast("int").alias("cls"), F.expr("1 + 5000 div (1 + id)").alias("train"))
    pairs = pairs.sortWithinPartitions(F.xxhash64("cls", F.substring("word", 1, 3)), "cls", "word").cache()
    model = context_mixing.fit_model(pairs, [r["word"] for r in pairs.limit(100).collect()])
    learner, rows = context_mixing.Learner(model, still=True), pairs.toArrow()
    for batch in rows.to_batches(max_chunksize=10_000):
        learner.learn(*(batch.column(c) if c == "word" else batch.column(c).to_numpy() for c in ("word", "cls", "train")))
    pairs.unpersist()
    pull, curve, hits = learner.found()
    pull = pull - context_mixing.RIDGE * (model.weights - context_mixing.start_weights())
    promised = (pull * np.linalg.solve(curve + context_mixing.RIDGE * np.eye(curve.shape[-1]), pull[..., None])[..., 0]).sum() / 2
    assert hits.sum() > 8 * n and promised < 2e-5 * hits.sum()  # nats that another step over all pairs would save, against the decisions
    ones, total = hits.reshape(256, -1, 2)[..., 1], hits.reshape(256, -1, 2).sum(2)
    prior = 1 / (1 + np.exp(-((np.arange(context_mixing.BUCKETS) + 0.5) / context_mixing.BUCKETS * 28 - 14)))
    assert np.abs(model.refined - (ones + 30 * prior) / (total + 30)).max() < 0.01  # counted under the weights that it refines


def test_toxicity_scores_arrow_texts(spark):
    from pyspark.util import PythonEvalType

    model = (["w:bad"], np.array([2.0, -1.0]))
    rows = spark.createDataFrame([(1, "a BAD ä word"), (2, None), (3, ""), (4, "fine")], "doc_id int, text string")
    found = toxicity.score_toxicity(rows, model)
    assert f", {PythonEvalType.SQL_SCALAR_ARROW_UDF}" in next(x for x in plan_of(found).splitlines() if "ArrowEvalPython" in x)  # no strings of Python's own
    sure, base = 1 / (1 + math.exp(-1)), 1 / (1 + math.exp(1))
    assert [r["score"] for r in found.orderBy("doc_id").collect()] == pytest.approx([sure, base, base, base])


def test_leaks(spark, docs, sf, none):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = {r["item_id"]: r["text"] for r in items.collect()}
    clean = docs.filter("doc_id >= 900000 or doc_id is null")
    altered = {}
    for k, text in list(texts.items())[:5]:
        w = text.split()
        del w[len(w) // 2]  # a paraphrase: one word less, one swapped
        w[3] = "otherword"
        altered[700_000 + k] = "some words before it " + " ".join(w) + " and some after"
    planted = spark.createDataFrame([(i, t, None, None, None) for i, t in altered.items()], SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES})
    got = {(r["doc_id"], r["item_id"]) for r in latent_leaks.find_leaks(docs.unionByName(planted), items.withColumn("at", F.lit(1))).collect()}
    norm = lambda t: " ".join((t or "").split())
    verbatim = {(r["doc_id"], i) for r in docs.collect() for i, t in texts.items() if norm(t) in norm(r["text"])}
    assert verbatim <= got and {(700_000 + k, k) for k in list(texts)[:5]} <= got
    assert not {i for i, _ in got} & {r["doc_id"] for r in clean.collect()}
    assert latent_leaks.find_leaks(none, items).count() == 0 and latent_leaks.find_leaks(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("n, listed", [(200, 4096), (3000, 4096), (3000, 2)])
def test_leaks_in_common_words_at_any_size(spark, monkeypatch, n, listed):
    """Paraphrased words are common in the corpus but not in the benchmark; with ``listed`` of 2 they all are weighed from the table."""
    monkeypatch.setattr(latent_leaks, "LISTED", listed)
    rng = np.random.default_rng(11)
    inside, outside = [f"b{chr(97 + i % 26)}{i}" for i in range(150)], [f"c{chr(97 + i % 26)}{i}" for i in range(150)]
    items = [(k, list(rng.choice(inside, 30))) for k in range(5)]
    rows = [(i, list(rng.choice(inside + outside, 64))) for i in range(n)]
    for k, w in items:
        w = list(w)
        for at in (2, 7, 12, 17, 22, 27):
            w[at] = str(rng.choice(outside))
        rows[10 * k] = (10 * k, [*rng.choice(outside, 16), *w, *rng.choice(outside, 18)])
    text = lambda table, name: spark.createDataFrame([(int(i), " ".join(w)) for i, w in table], f"{name} bigint, text string")
    got = latent_leaks.find_leaks(text(rows, "doc_id"), text(items, "item_id")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(10 * k, k) for k in range(5)}
    assert all(0.45 <= r["cosine"] <= 1.0 for r in got)


def test_windows_follow_the_items():
    assert latent_leaks.window_sizes([15, 59]) == [16, 32, 64] and latent_leaks.window_sizes([3, 400]) == [4, 8, 16, 32, 64, 128, 256, 512]


def test_language_id(docs, none):
    rows = docs.filter("doc_id < 900000").withColumn("draw", F.lit(0.0))
    trees = language_id.fit_context_trees(rows.filter("doc_id % 3 <> 1").select("text", "lang", "draw"))
    got = {(r["doc_id"], r["text"]): r for r in language_id.identify(docs, trees).collect()}
    held = [r for r in got.values() if r["doc_id"] is not None and r["doc_id"] < 900_000 and r["doc_id"] % 3 == 1]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.9
    assert all(got[i, t]["lang_pred"] == "und" and got[i, t]["score"] == 0 for i, t in ((900_002, None), (900_003, ""), (900_004, " \n ")))
    assert language_id.identify(none, trees).count() == 0
    empty = language_id.fit_context_trees(rows.limit(0).select("text", "lang", "draw"))
    assert {r["lang_pred"] for r in language_id.identify(docs.limit(3), empty).collect()} == {"und"}


def test_code_lengths_by_hand(spark):
    rows = spark.createDataFrame([("ab ab ac", "x", 0.0), ("b", "y", 0.0)], "text string, lang string, draw double")
    trees = language_id.fit_context_trees(rows)
    import pyarrow as pa

    bits, size = trees.word_bits(pa.array(["ab", "12"]))
    # x: a after a space 3 of 3 (+1 kind), b after " a" 2 of 3 (+2 kinds), the space after " ab" 2 of 2 (+1 kind)
    assert bits[0][trees.langs.index("x")] == pytest.approx(-math.log2(3 / 4) - math.log2(2 / 5) - math.log2(2 / 3), abs=1e-4)
    assert size.tolist() == [3, 0] and bits[1].tolist() == [0, 0]


def test_toxicity(spark, docs, sf, none):
    labels = spark.read.parquet(f"{sf}/labels.parquet").unionByName(spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id bigint, quality int, toxic int"))
    model = toxicity.fit_toxicity(toxicity.labelled_rows(docs, labels))
    got = toxicity.score_toxicity(docs, model).collect()
    score = {(r["doc_id"], r["text"]): r["score"] for r in got}
    assert len(got) == docs.count() and all(0 < s < 1 for s in score.values())
    assert score[900_002, None] == score[900_003, ""] == score[900_004, " \n "]
    assert toxicity.score_toxicity(none, model).count() == 0
    assert len(toxicity.fit_toxicity(toxicity.labelled_rows(docs, labels.limit(0)))[1]) == 1


def test_counterfactual_penalty(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):  # one group is named in most toxic rows
        bad = i % 2 == 0
        group = "muslims" if rng.random() < (0.9 if bad else 0.1) else "christians"
        rows.append((f"the {group} {'awful nasty' if bad and rng.random() < 0.8 else 'live work'} here {rng.integers(50)}", int(bad), float(rng.random())))
    labelled = spark.createDataFrame(rows, "text string, label int, draw double")
    gap = {}
    for penalty in (0.0, 10.0):
        probe = spark.createDataFrame([("the muslims live here",), ("the christians live here",), ("the awful nasty here",)], "text string")
        scores = [r["score"] for r in toxicity.score_toxicity(probe, toxicity.fit_toxicity(labelled, penalty)).collect()]
        gap[penalty] = abs(scores[0] - scores[1])
        assert scores[2] > 0.7
    assert gap[10.0] < 0.1 * gap[0.0]


def test_ngram_join_takes_few_jobs(spark):
    """Each job and plan of a session costs memory of the driver."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice([f"w{k}" for k in range(300)], 40))) for i in range(40)]
    rows += [(100 + i, f"{t} {i}") for i, t in rows[:20]]
    context = spark.sparkContext
    context.setJobGroup("few jobs", "")
    try:
        got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id bigint, text string"), num=80)
        assert Counter(tuple(r) for r in got.collect()) == brute_components([(*r, None) for r in rows], 4, 80, 100)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("few jobs")) < 160


def test_components_of_stars_and_chains(spark):
    edges = [(1, 2), (1, 3), (9, 8), (8, 7), (7, 6), (20, 20), (None, 4), (30, 31), (31, 30)]
    found = components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b")
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1), (2, 1), (3, 1), (6, 6), (7, 6), (8, 6), (9, 6), (30, 30), (31, 30)]


def test_bit_counts_travel_as_the_cells_that_hold_any():
    counts = np.zeros(1 << 17, np.uint32)
    assert context_mixing._unpacked(context_mixing._packed(counts))[0].size == 0
    counts[[0, 5, 70_000, (1 << 17) - 1]] = 1, 300, (1 << 32) - 1, 2
    at, found = context_mixing._unpacked(context_mixing._packed(counts))
    assert at.tolist() == [0, 5, 70_000, (1 << 17) - 1] and found.tolist() == [1, 300, (1 << 32) - 1, 2]

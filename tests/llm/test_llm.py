"""The training-data operators: brute force, round trips and planted cases, with hard inputs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import p02_near_duplicates as p2
from skein.llm import p03_vectors as p3
from skein.llm import p05_personal as p5
from skein.llm import p07_new_text as p7
from skein.llm import p08_encoding as p8
from skein.llm import p09_contamination as p9
from skein.llm import p10_residue as p10
from skein.llm._groups import runs, whole_groups
from skein.llm._ranks import midranks
from skein.llm.p01_rank_aggregation import aggregate_ranks, full_ranking, top_places
from skein.llm import _spread
from skein.llm.p04_conversations import assemble, rebuild
from skein.llm.p06_splitting import split_spans, split_texts


def rows_of(df):
    return {tuple(r) for r in df.collect()}


# 1


def test_midranks(spark):
    rows = [("g", float(x)) for x in (5, 3, 3, -1, 0)] + [("g", None), ("h", float("nan")), ("h", 1e-9)]
    df = spark.createDataFrame(rows, "g string, s double")
    got = {(r.g, str(r.s)): r["rank"] for r in midranks(df, ["g"], "s").collect()}
    assert got == {("g", "5.0"): 1.0, ("g", "3.0"): 2.5, ("g", "0.0"): 4.0, ("g", "-1.0"): 5.0, ("g", "None"): None, ("h", "nan"): None, ("h", "1e-09"): 1.0}


def test_rank_aggregation(spark):
    rng = random.Random(1)
    rows = []
    for q in (1, 2):
        for i in range(40):
            good = i < 4
            t, v = (1000.0**q + i if good else rng.uniform(0, 5)), (0.9 + i / 1000 if good else rng.uniform(0.1, 0.2))
            if i == 10:
                t, v = 1e9, float("nan")
            if i == 11:
                t, v = None, 0.99
            rows += [(q, i, t, v)] * (2 if i % 7 == 0 else 1)
    df = spark.createDataFrame(rows, "query_id long, rowid long, text_score double, vector_score double").withColumn("rank", F.lit("clash"))
    ranked = aggregate_ranks(df, ["text_score", "vector_score"])
    wanted = spark.createDataFrame([(1, 4), (2, 4), (3, 5), (1, None)], "query_id long, top_n long")
    assert {(r.query_id, r.rowid) for r in top_places(ranked, wanted).collect()} == {(q, i) for q in (1, 2) for i in range(4)}
    full = full_ranking(ranked).where("query_id = 1").orderBy("position").collect()
    assert [r.position for r in full] == list(range(1, 41)) and {r.rowid for r in full[:4]} == {0, 1, 2, 3}
    classic = aggregate_ranks(df, ["text_score", "vector_score"], support=1.0)
    place = lambda r: full_ranking(r).where("query_id = 1 and rowid = 10").first().position
    assert place(classic) < place(ranked)  # one excellent rank is enough there
    assert not ranked.where("query_id = 1 and rowid = 10").first().supported
    assert aggregate_ranks(df.limit(0), ["text_score", "vector_score"]).count() == 0
    with pytest.raises(ValueError):
        aggregate_ranks(df, ["text_score"], support=0)


def test_rank_significance_is_the_corrected_minimum(spark):
    """Against a simulation of random lists, with three scores; an item's minimum may lie at any order statistic."""
    rng = np.random.default_rng(4)
    n = 50
    scores = rng.normal(size=(n, 3))
    df = spark.createDataFrame([(1, i, *map(float, s)) for i, s in enumerate(scores)], "query_id long, rowid long, a double, b double, c double")
    got = {r.rowid: r.significance for r in aggregate_ranks(df, ["a", "b", "c"]).collect()}
    ranks = (np.argsort(np.argsort(-scores, axis=0), axis=0) + 1) / n
    random_lists = np.sort(rng.uniform(size=(200_000, 3)), axis=1)
    at = set()
    for i in range(n):
        tests = [(random_lists[:, k] <= np.sort(ranks[i])[k]).mean() for k in range(3)]
        at.add(int(np.argmin(tests)))
        assert abs(min(1, 3 * min(tests)) - got[i]) < 0.01
    assert at == {0, 1, 2}


def test_equal_items_are_ordered_by_id(spark):
    df = spark.createDataFrame([(1, i, 0.0, None) for i in range(500)], "query_id long, rowid long, text_score double, vector_score double")
    full = full_ranking(aggregate_ranks(df, ["text_score", "vector_score"])).orderBy("position").collect()
    assert [r.rowid for r in full] == list(range(500)) and [r.position for r in full] == list(range(1, 501))


# 2


def shingles(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return None if len(w) < 20 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


@pytest.fixture(scope="module")
def edited():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(40):
        base = rng.choices(words, k=rng.randint(25, 120))
        for k in range(rng.randint(1, 4)):
            text = list(base)
            for _ in range(k * 2):
                text[rng.randrange(len(text))] = "edit"
            rows.append((n, " ".join(text)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "short text"), (n + 3, rows[0][1].upper()), (n + 4, rows[0][1]), (n + 4, rows[0][1]), (n + 5, "word " * 30_000), (n + 6, "word " * 30_000)]
    return rows


def test_near_duplicates_equal_brute_force(spark, edited):
    df = spark.createDataFrame(edited, "id long, text string").withColumn("a", F.lit(1)).withColumn("words", F.lit("x"))
    links, members = p2.near_duplicates(df, "id", F.col("text"))
    sets = {i: s for i, t in edited if t and (s := shingles(t))}
    ids = sorted(sets)
    expected = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    got = rows_of(p2.all_pairs(links, members))
    near = {p for p in expected if len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) < 0.65}
    assert got <= expected and expected - got <= near
    labels = {r.id: r.group for r in p2.groups(links, members).collect()}
    assert labels.keys() == sets.keys() and all(labels[a] == labels[b] for a, b in got)
    links, members = p2.near_duplicates(df.limit(0), "id", F.col("text"))
    assert p2.all_pairs(links, members).count() == 0


def test_split_buckets_lose_nothing(spark, edited, monkeypatch):
    df = spark.createDataFrame(edited, "id long, text string")
    whole = rows_of(p2.all_pairs(*p2.near_duplicates(df, "id", F.col("text"))))
    monkeypatch.setattr(p2, "BLOCK", 2)
    monkeypatch.setattr(p2, "SAMPLE", 1)
    assert rows_of(p2.all_pairs(*p2.near_duplicates(df, "id", F.col("text")))) == whole


def test_a_dense_bucket_is_compared_in_slices():
    """20,000 records in one bucket, all near one another: 200 million pairs, of which one slice is held at a time."""
    import resource

    import pandas as pd

    n = 20_000
    bucket = pd.DataFrame({"band": np.int64(7), "id": np.arange(n), "block": np.int32(0), "sketch": np.int64(5)})
    before, pairs = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, 0
    for part in p2._candidates(24)(iter([bucket])):
        assert len(part) <= 2 * p2.SLICE
        pairs += len(part)
    assert pairs == n * (n - 1) // 2
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000


def test_copies_of_a_frequent_text_are_joined_in_blocks(spark, edited, monkeypatch):
    rows = [(i, edited[0][1]) for i in range(1000, 1060)] + edited
    df = spark.createDataFrame(rows, "id long, text string")
    whole = rows_of(p2.all_pairs(*p2.near_duplicates(df, "id", F.col("text"))))
    monkeypatch.setattr(_spread, "HOT", 7)
    assert rows_of(p2.all_pairs(*p2.near_duplicates(df, "id", F.col("text")))) == whole and len(whole) > 1770


@pytest.mark.parametrize("threshold", [0.5, 0.6])
def test_pairs_at_the_threshold_are_found(spark, threshold):
    own = 24 if threshold == 0.5 else 15
    shared, rows = (2 * own if threshold == 0.5 else 3 * own), []
    for i in range(800):
        common = [f"c{i}x{j}" for j in range(shared)]
        rows += [(2 * i + k, " ".join(common + [f"u{i}x{k}x{j}" for j in range(own)])) for k in (0, 1)]
    links, _ = p2.near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", F.col("text"), threshold, size=1)
    assert links.where("b = a + 1").count() >= 0.98 * 800


def test_prob_minhash_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    b = np.concatenate([a[:200], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    s = p2.prob_minhash(np.concatenate([a, a, b]), np.repeat([0, 0, 1], 300), 2, 2000)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.05
    weights = np.concatenate([np.where(np.arange(300) < 200, 5.0, 1.0)] * 2)
    w = p2.prob_minhash(np.concatenate([a, b]), np.repeat([0, 1], 300), 2, 2000, weights)
    assert abs((w[0] == w[1]).mean() - 1000 / 1200) < 0.05


# 3


def test_similar_vectors_recall(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(600, 64))
    near = base[:200] + 0.15 * rng.normal(size=(200, 64))
    x = np.concatenate([base, near * 3.0])
    rows = [("m", i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [("m", 0, rows[0][2]), ("n", 0, rows[0][2]), ("m", 9001, None), ("m", 9002, [0.0] * 64), ("m", 9003, [1.0] * 63), ("m", 9004, [float("nan")] * 64), ("m", 9005, [float("inf")] * 64), (None, 9006, rows[1][2]), ("m", 9007, [None] * 64)]
    df = spark.createDataFrame(rows, "space string, rowid long, vector array<float>").withColumn("bucket", F.lit(0))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    expected = {(int(i), int(j)) for i, j in zip(*np.nonzero(u @ u.T >= 0.9)) if i != j}
    result = p3.similar_vectors(df, "space", "rowid", "vector")
    got = {(r.rowid, r.neighbour) for r in result.collect()}
    assert got <= expected and len(got) >= 0.97 * len(expected)
    monkeypatch.setattr(p3, "BLOCK", 3)
    assert {(r.rowid, r.neighbour) for r in p3.similar_vectors(df, "space", "rowid", "vector").collect()} == got
    monkeypatch.setattr(p3, "MOST_BROADCAST", 0)
    assert {(r.rowid, r.neighbour) for r in p3.similar_vectors(df, "space", "rowid", "vector").collect()} == got
    assert p3.similar_vectors(df.limit(0), "space", "rowid", "vector").count() == 0


@pytest.mark.parametrize("hot", [100_000, 6])
def test_equal_vectors_are_folded(spark, monkeypatch, hot):
    """40 copies of one vector, 3 of another near it, one more near both: each has its ten nearest, ties by id."""
    monkeypatch.setattr(_spread, "HOT", hot)
    rng = np.random.default_rng(9)
    x = rng.normal(size=64)
    y, z = x + 0.05 * rng.normal(size=64), x + 0.1 * rng.normal(size=64)
    vectors = {**dict.fromkeys(range(100, 140), x), **dict.fromkeys((7, 300, 301), y), 200: z}
    df = spark.createDataFrame([("m", i, v.tolist()) for i, v in vectors.items()], "space string, rowid long, vector array<double>").withColumn("vector", F.col("vector").cast("array<float>"))
    got = {}
    for r in p3.similar_vectors(df, "space", "rowid", "vector").collect():
        got.setdefault(r.rowid, {})[r["rank"]] = r.neighbour
    u = {i: v.astype(np.float32).astype(float) / np.linalg.norm(v.astype(np.float32).astype(float)) for i, v in vectors.items()}
    for i in vectors:
        nearest = sorted((j for j in vectors if j != i), key=lambda j: (-round(float(u[i] @ u[j]), 9), j))[:10]
        assert [got[i][n + 1] for n in range(10)] == nearest


def test_many_near_vectors_keep_their_best():
    """3,000 different vectors of one narrow cone: far more near pairs than the k best of each."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=64) + 0.2 * rng.normal(size=(3000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    i, j = p3.near_pairs(x, 0.9, 10, p3.layouts_inside(0.9))
    assert len(i) <= 3000 * p3.KEPT * 10
    found = set(zip(i.tolist(), j.tolist()))
    s = x @ x.T
    np.fill_diagonal(s, -2)
    kept = sum((min(a, b), max(a, b)) in found for a in range(3000) for b in np.argpartition(-s[a], 10)[:10].tolist())
    assert kept >= 0.95 * 30_000


def test_packed_cosines_have_their_margin():
    rng = np.random.default_rng(11)
    spiky = np.zeros((500, 64))
    spiky[np.arange(500), rng.integers(0, 64, 500)] = 1
    x = np.concatenate([rng.normal(size=(1000, 64)), spiky + 0.03 * rng.normal(size=(500, 64)), rng.exponential(size=(500, 64))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    packed = pack = np.array(p3.pack(x @ p3.rotation(64)), dtype=object)
    assert len(packed[0]) == 48
    y = p3.unpack(pack, 64)
    assert np.abs(y @ y.T - x @ x.T).max() < p3.MARGIN


@pytest.mark.parametrize("similarity", [0.9, 0.91, 0.95])
@pytest.mark.parametrize("rows", [30_000, 350_000, 3_500_000, 30_000_000, 10**9, 10**10])
def test_recall_does_not_fall_with_size(rows, similarity):
    rng = np.random.default_rng(6)
    a, other = rng.normal(size=(2, 3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    other -= (other * a).sum(axis=1, keepdims=True) * a
    b = similarity * a + (1 - similarity**2) ** 0.5 * other / np.linalg.norm(other, axis=1, keepdims=True)
    hasher, salt = p3.Hasher(64, *p3.layout_for(rows, 0.9)), np.zeros(3000, dtype=np.uint64)
    x, y = ([h.copy() for h in hasher.buckets(v.astype(np.float32), salt)] for v in (a, b))
    own = np.sort(np.stack(x, axis=1), axis=1)
    met = np.zeros(3000, dtype=bool)
    for h in y:
        met |= (own == h[:, None]).any(axis=1)
    assert met.mean() >= (0.975 if similarity == 0.9 else 0.98 if similarity == 0.91 else 0.993)


def test_candidates_at_the_layout_of_millions_of_rows(spark):
    rng = np.random.default_rng(7)
    a, other = rng.normal(size=(2, 400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    other -= (other * a).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + (1 - 0.9**2) ** 0.5 * other / np.linalg.norm(other, axis=1, keepdims=True)
    rows = [(1, i, [float(v) for v in r]) for i, r in enumerate(np.concatenate([a, b]))]
    df = spark.createDataFrame(rows, "space long, id long, vector array<float>")
    pairs = p3.candidate_pairs(df, 0.9, *p3.layout_for(3_500_000, 0.9), p3.BLOCK, 64)
    assert pairs.where("b = a + 400").count() >= 0.95 * 400


def test_large_buckets_lose_few_pairs():
    """A bucket of 40,000 rows, hashed again inside its task: pairs right at the bound."""
    rng = np.random.default_rng(8)
    a, other = rng.normal(size=(2, 2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    other -= (other * a).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + (1 - 0.9**2) ** 0.5 * other / np.linalg.norm(other, axis=1, keepdims=True)
    rest = rng.normal(size=(36_000, 64))
    x = np.concatenate([a, b, rest / np.linalg.norm(rest, axis=1, keepdims=True)]).astype(np.float32)
    layouts = p3.layouts_inside(0.9)
    assert layouts[16][1] > 0
    i, j = p3.near_pairs(x, 0.9, 10, layouts)
    assert (j == i + 2000).sum() >= 0.995 * 2000


def test_search_reaches_its_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    rows = [("m", i, [float(v) for v in r]) for i, r in enumerate(x)] + [("m", 0, [float(v) for v in x[0]]), ("m", 9000, None)]
    df = spark.createDataFrame(rows, "space string, rowid long, vector array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[::50] @ u.T
    s[np.arange(60), np.arange(0, 3000, 50)] = -2
    expected = {(int(50 * i), int(j)) for i, row in enumerate(np.argsort(-s, axis=1)[:, :10]) for j in row}
    result = p3.search_vectors(df, df.where("rowid % 50 = 0"), "space", "rowid", "vector", block=100).collect()
    assert len(result) == 600 and len({(r.rowid, r.neighbour) for r in result} & expected) >= 0.9 * len(expected)
    assert p3.search_vectors(df.limit(0), df, "space", "rowid", "vector").count() == 0


# 4


def test_conversations(spark):
    fts = [
        (1, "chat:a:0", "User", "hi", "a "), (2, "chat:a:1", "BOT", "yes", None), (3, "chat:a:1", "assistant", "later copy", "a"), (4, "kb:1", "KB", "shared", "a"),
        (5, "chat:b:1", "human", "q", "b"), (6, "chat:b:2", "ai", "r", "b"),
        (7, "chat:c:0", "user", "q", "c"), (8, "chat:c:2", "assistant", "gap", "c"),
        (9, "chat:d:0", "user", "q", "d"), (10, "chat:d:1", "tool", "r", "d"),
        (11, "chat:e:0", "user", "q", "e"), (12, "chat:e:1", "assistant", " ?! ", "e"),
        (13, "chat:f:0", "user", "q", "f"), (14, "chat:f:1", "assistant", "r", "f"), (15, "chat:f:2", "user", "no reply", "f"),
        (16, "chat:g:0", "assistant", "r", "g"), (17, "chat:g:1", "user", "q", "g"),
        (18, "x", "user", "q", "h"), (19, "chat:h:1", "assistant", "r", "h"),
        (20, "chat:i:0", "user", "q", "i"), (21, "chat:i:1", "assistant", "r", "i"), (22, "chat:i:1b1", "assistant", "again", "i"),
        (23, None, "user", "q", None), (24, "chat:j:0", None, None, "j"),
    ]
    meta = [(2, 0, "a", None), (5, 0, "b", 1), (5, 0, "b", 1), (19, 0, "h", 1)]
    a = spark.createDataFrame(fts, "rowid long, memId string, role string, content string, sessionId string").withColumn("turnIndex", F.lit("clash"))
    b = spark.createDataFrame(meta, "rowid long, dateMs long, sessionId string, turnIndex long")
    got = rebuild(a, b)
    assert rows_of(got.select("sessionId", "position", "rowid")) == {("a", 0, 1), ("a", 1, 2), ("b", 0, 5), ("b", 1, 6)}
    assert rebuild(a.limit(0), b.limit(0)).count() == 0


def test_long_and_hot_chats(spark, monkeypatch):
    """Chats over many windows, from 0 and from 1, whole and with a gap; one is hot."""
    sizes = {"a": (0, 200), "b": (1, 34), "c": (1, 16), "d": (0, 16), "e": (0, 18), "f": (1, 2)}
    rows = [(1000 * k + n, f"chat:{s}:{n}", "user" if (n - low) % 2 == 0 else "assistant", f"m{n}", s) for k, (s, (low, size)) in enumerate(sizes.items()) for n in range(low, low + size)]
    rows += [(9000 + n, f"chat:gap:{n}", "user" if n % 2 == 0 else "assistant", "m", "gap") for n in range(40) if n not in (16, 17)]
    rows += [(9500 + n, f"chat:late:{n}", "user" if n % 2 == 0 else "assistant", "m", "late") for n in range(2, 40)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "rowid long, memId string, role string, content string, sessionId string")
    meta = spark.createDataFrame([], "rowid long, dateMs long, sessionId string, turnIndex long")
    expected = {(s, n, 1000 * k + low + n) for k, (s, (low, size)) in enumerate(sizes.items()) for n in range(size)}
    assert rows_of(rebuild(df, meta).select("sessionId", "position", "rowid")) == expected
    monkeypatch.setattr(_spread, "HOT", 30)
    assert rows_of(rebuild(df, meta).select("sessionId", "position", "rowid")) == expected


def test_overlapping_exports_are_assembled(spark):
    """Random overlapping stretches of known sequences, repeated and contained ones too; a gap and an ambiguous place."""
    rng = random.Random(6)
    fragments = []
    for s in range(6):
        whole, at = [s * 1000 + i for i in range(rng.randint(30, 90))], 0
        while True:
            end = min(len(whole), at + rng.randint(4, 12))
            fragments += [whole[at:end]] * rng.choice((1, 1, 2))
            if end - at > 5:
                fragments.append(whole[at + 1 : end - 2])
            if end == len(whole):
                break
            at = end - rng.randint(2, 3)
        if s == 0:
            lengths = len(whole)
    fragments += [[9000, 9001, 9002], [9003, 9004]]  # a gap: two paths
    fragments += [[8000, 8001], [8001, 8002], [8001, 8003]]  # ambiguous
    rng.shuffle(fragments)
    df = spark.createDataFrame(list(enumerate(fragments)), "fragment long, messages array<long>")
    got = assemble(df).collect()
    paths = {}
    for r in got:
        paths.setdefault(r.path, []).append((r.position, r.message))
    found = sorted([m for _, m in sorted(p)] for p in paths.values())
    assert len(found) == 8 and found[0] == list(range(lengths)) and found[-2:] == [[9000, 9001, 9002], [9003, 9004]]
    assert all(p == list(range(p[0], p[0] + len(p))) for p in found) and not any(8000 <= m < 9000 for p in found for m in p)
    assert assemble(df.limit(0)).count() == 0


# 5


NAMES = "Anna Berg <anna.berg@x.example>, \"Lind, Otto\" <OTTO.LIND@X.EXAMPLE>, Index Notifier <notify@indexer.example>"


@pytest.fixture(scope="module")
def finder(spark):
    mails = spark.createDataFrame([(NAMES,)] * 20 + [(None,)], "from_ string")
    fit = ["Dear Anna Berg,\nTel. +44 20 7946 0018, order 370-555-1234\nOtto Lind\n12 Mill Lane, Oxford"] * 20
    return p5.Finder(p5.learn_lexicon(mails, ["from_"]), fit)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Dear Anna Berg,\nsee you", [("name", "Anna Berg")]),
        ("Berg's plan", [("name", "Berg")]),
        ("ask Lind, Otto or Dr. Berg today", [("name", "Lind, Otto"), ("name", "Berg")]),
        ("the search index and Project Berg", []),
        ("write to anna dot berg AT x dot example or <otto@x.example>", [("email", "anna dot berg AT x dot example"), ("email", "otto@x.example")]),
        ("handle @berg and tag x@v1", []),
        ("Tel. +44 20 7946 0018 ext. 5", [("phone", "+44 20 7946 0018 ext. 5")]),
        ("My passport number: AB1234567 is here, again AB1234567.", [("id_number", "AB1234567"), ("id_number", "AB1234567")]),
        ("It goes to Flat 6, 12 Mill Lane, Oxford today, row 12 too", [("street_address", "Flat 6, 12 Mill Lane, Oxford")]),
        ("Calle Mayor 45 und Hauptstr. 7, 5 rue de Lille", [("street_address", "Calle Mayor 45"), ("street_address", "Hauptstr. 7"), ("street_address", "5 rue de Lille")]),
        ("On 2024-05-06 and 04.06.2024 we met 7 times", []),
        ("", []),
    ],
)
def test_personal(finder, text, expected):
    assert [(k, text[a:b]) for k, a, b in finder([text])[0]] == expected


@pytest.mark.parametrize("address", [
    "anna{at}example.org", "anna(AT)example.org", "anna [AT] example.org", "anna{At}example.org",
    " dot ".join(f"part{i}" for i in range(30)) + " (at) example.org", "a" * 200 + "@example.org", "anna@" + ".".join(f"part{i}" for i in range(40)) + ".org",
])
def test_addresses_of_every_sign_and_length(address):
    text = f"Please write to: {address}, thanks."
    found = [c for c in p5.candidates(text, lambda w: (0, 0)) if c.label == p5.EMAIL]
    assert [text[c.start : c.end] for c in found] == [address]


def test_skip_links_reach_equal_tokens(finder):
    text = "Dear Anna,\n" + "filler words here. " * 40 + "Anna"
    assert [k for k, _, _ in finder([text])[0]] == ["name", "name"]
    assert finder([None, "x" * 300_000]) == [[], []]
    assert len(finder(["Dear Anna, mail a@x.example or +44 20 7946 0018.\n" * 5000])[0]) == 15_000


def test_skip_links_decide_what_a_token_leaves_open(spark, finder):
    """An unknown word with no sign of its own is a person where a greeting names it and none where it is a project."""
    person, thing = "Dear Zorvan,\nthe files are late. " + "some more words here. " * 5 + "Please ask Zorvan today.", "The project Zorvan is late. " + "some more words here. " * 5 + "Please ask Zorvan today."
    for skip in (True, False):
        model = p5.Finder(finder.lexicon, ["Dear Anna Berg,\nask Otto Lind"] * 400, skip=skip).model
        last = [p5.KIND[model.marginals([p5.candidates(t, finder.lexicon, True)]).argmax(axis=1)[-1]] == p5.NAME for t in (person, thing)]
        assert last == [True, False] if skip else last[0] == last[1]


def test_names_of_any_length_and_broken_lines(finder):
    text = "Reach J. Anna Otto Anna Otto Anna Berg.\nAnna Berg\nHead of Post - Lerkdan\nSeihiv Road 6, Quiaho\nIdentity card no NR368227A"
    assert [(k, text[a:b]) for k, a, b in finder([text])[0]] == [("name", "J. Anna Otto Anna Otto Anna Berg"), ("name", "Anna Berg"), ("street_address", "Seihiv Road 6, Quiaho"), ("id_number", "NR368227A")]


def test_header_names_of_any_length():
    words = [f"Given{'abcdefghij'[i]}" for i in range(10)]
    assert p5.header_names(" ".join(words) + " Berg <berg@x.example>, list <all@x.example>") == [*((False, w) for w in words), (True, "Berg")]
    assert p5.header_names("x" * 100_000 + " y") == []


def test_redaction(spark, finder):
    df = spark.createDataFrame([(1, "Hi Anna, mail otto@x.example!"), (2, None), (3, "")], "id long, t string").withColumn("kind", F.lit(1))
    assert {r.id: r.redacted for r in p5.redact(df, "t", finder).collect()} == {1: "Hi [NAME], mail [EMAIL]!", 2: None, 3: ""}
    assert rows_of(p5.occurrences(df, ["id"], "t", finder).select("id", "kind", "start")) == {(1, "name", 3), (1, "email", 14)}


# 6


def test_splitting_round_trip(spark):
    rng = random.Random(6)
    texts = ["", "x" * 9000, "a\r\n" * 3000, ("Satz eins. Satz zwei! " * 30 + "\n\n") * 12, "".join(rng.choices("ab \n.é😀", k=20_000)), "short", "y" * 2000, "z" * 2001]
    for t in texts:
        spans = split_spans(t, 2000, 200)
        assert all(b - a <= 2000 for a, b in spans) and spans[0][0] == 0 and spans[-1][1] == len(t)
        for (a, b), (c, d) in zip(spans, spans[1:]):
            assert a < c <= b < d and b - c <= 200
            assert not (t[b - 1] == "\r" and t[b] == "\n")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "id long, t string").withColumn("start", F.lit(5))
    got = split_texts(df, "t", ["id"]).collect()
    for i, t in enumerate(texts):
        pieces = sorted((r.piece_no, r.start, r.end, r.piece) for r in got if r.id == i)
        assert all(p == t[a:b] for _, a, b, p in pieces)
    assert 99 not in {r.id for r in got}
    natural = split_spans(texts[3], 2000, 200)
    assert all(texts[3][:b].endswith(("\n\n", ". ", "! ")) for _, b in natural)


def test_long_texts_take_time_in_proportion(spark):
    import time

    for text in ("lorem ipsum dolor sit amet. " * 300_000, "." * 8_000_000, "\n---" * 2_000_000):
        start = time.perf_counter()
        split_spans(text[: len(text) // 8], 2000, 200)
        small = time.perf_counter() - start
        start = time.perf_counter()
        spans = split_spans(text, 2000, 200)
        assert time.perf_counter() - start < 24 * small + 1 and spans[-1][1] == len(text)
    big = spark.createDataFrame([(1, "some words here. " * 400_000)], "id long, text string")
    pieces = split_texts(big, "text", ["id"])
    assert pieces.agg(F.max("end")).first()[0] == 17 * 400_000 and pieces.where(F.char_length("piece") > 2000).count() == 0


# 7


def test_layout():
    body = "\n".join(
        [
            "Hi Otto,", "", "new text here", "On 6 February the office wrote: nothing.", "", "On May 6, 2024, Anna Berg", "<anna@x.example> wrote:", "> old line", ">> older", "", "inline answer", "",
            "Best regards,", "Anna", "-- ", "Anna Berg", "Desk | Firm", "T: 123 456", "", "Legal note: This message is intended for the addressee. Tell the sender and", "delete it.", "", "PS: one more thing", "",
            "---------- Forwarded message ----------", "From: A <a@x>", "Sent: today", "To: B", "Subject: s", "", "forwarded text",
        ]
    )
    assert p7.old_lines(body) == [5, 6, 7, 8, 12, 13, 14, 15, 16, 17, 19, 20, 24, 25, 26, 27, 28, 30]
    assert p7.new_text(body).split("\n\n")[-1] == "PS: one more thing"
    tree = p7.parse(body)
    assert [c.kind for n in tree if n.kind == "quote" for c in n.children] == ["new", "quote"]


def test_introduction_under_a_sentence():
    assert p7.old_lines("We are done.\nOn May 6, 2024, Anna Berg wrote:\n> old") == [1, 2]
    assert p7.old_lines("new\n\nAnna Berg\n<anna@x.example> wrote on\n5/6/2024:\n> old") == [2, 3, 4, 5]


@pytest.mark.parametrize("body", [None, "", " \n\t\n", "x" * 100_000, "\n" * 5000, "> " * 3000, ">" * 500 + " deep", "wrote:\n" * 300])
def test_layout_hard_inputs(body):
    assert isinstance(p7.old_lines(body), list)


def test_layout_query(spark):
    df = spark.createDataFrame([(1, "a\r\n> b\r\n\r\nCheers,\r\nBo"), (2, None), (2, "> x")], "rowid long, body string").withColumn("line_no", F.lit("clash"))
    assert rows_of(p7.not_new(df, "rowid", "body")) == {(1, 1), (1, 3), (1, 4), (2, 0)}
    assert {r.new_text for r in p7.with_new_text(df, "body").collect()} == {"a", None, ""}


def test_nesting_has_no_limit():
    body = "New.\n" + "\n".join(">" * d + f" level {d}" for d in range(1, 300))
    node, depth = p7.parse(body)[-1], 1
    while any(c.content for c in node.children):
        node, depth = next(c for c in node.children if c.content), depth + 1
    assert depth == 299 and p7.new_text(body) == "New."


def test_text_below_an_unmarked_mail_is_the_senders():
    quoted = "Please book the room.\n\nBest regards,\nOtto Lind"
    for intro in ("On 3 May 2024 at 10:15, Otto Lind <otto@x.example> wrote:", "-----Original Message-----\nFrom: Otto Lind <otto@x.example>\nSent: 3 May 2024\nTo: Anna\nSubject: Room\n"):
        assert p7.new_text(f"See below.\n\n{intro}\n{quoted}") == "See below."
        assert p7.new_text(f"See below.\n\n{intro}\n{quoted}\n\nBooked, it is room 4.") == "See below.\n\nBooked, it is room 4."
        assert p7.new_text(f"See below.\n\n{intro}\n{quoted}\n\nPS: for ten persons.") == "See below."


def test_layout_limits_are_parameters():
    contacts = "\n".join(f"Office {i}: +44 20 7946 00{i:02}" for i in range(10, 30))
    body = f"Text.\n\nBest regards,\nAnna Berg\n{contacts}"
    assert p7.new_text(body) != "Text." and p7.new_text(body, p7.Limits(contact_lines=40)) == "Text."


# 8


def test_encoding_equals_tiktoken(spark):
    tiktoken = pytest.importorskip("tiktoken")
    encoder = p8.Encoder(p8.VOCABULARY, remember=50)
    known = tiktoken.Encoding("own", pat_str=p8.PIECES, mergeable_ranks=encoder.ranks, special_tokens={})
    rng = random.Random(8)
    texts = ["", "a" * 5000, " " * 999, "<|endoftext|>", "日本語 مرحبا 👩‍👧", "don't I'VE 12345 x_y\r\n\t", *("".join(chr(rng.choice([*range(32, 127), *range(0xA0, 0x250), 0x4E00, 0x1F600])) for _ in range(300)) for _ in range(20))]
    assert [encoder(t) for t in texts] == [known.encode_ordinary(t) for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in p8.encode(df).collect()}
    assert got[99] == [] == got[0] and len(got) == len(texts) + 1
    assert all(known.decode(got[i]) == t for i, t in enumerate(texts))


# 9


def test_contamination_equals_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=40))) for i in range(6)] + [(50, None), (51, "too short"), (52, "word " * 40)]
    docs = []
    for n in range(80):
        text = rng.choices(words, k=30)
        source = items[rng.randrange(6)][1].split()
        at, size = rng.randrange(20), rng.choice([8, 11, 12, 13, 20])
        text[10:10] = [w.upper() if rng.random() < 0.3 else w for w in source[at : at + size]]
        docs.append((n, rng.choice([" ", ", ", "\n> "]).join(text)))
    docs += [(200, None), (201, ""), (202, "word " * 5000), (203, "Wörd " * 13)]
    runs_of = lambda t: {tuple(w[i : i + 12]) for w in [p9.plain_words(t)] for i in range(len(w) - 11)}
    expected = {(d, i) for d, t in docs for i, s in items if runs_of(t) & runs_of(s)}
    a = spark.createDataFrame([*docs, docs[0]], "doc_id long, text string").withColumn("h", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(p9.leaked(a, b, "doc_id", "item_id").select("doc_id", "item_id")) == expected and expected
    assert p9.leaked(a.limit(0), b, "doc_id", "item_id").count() == 0
    assert p9.plain_words("Café-ÉTÉ Straße") == ["cafe", "ete", "strasse"]


def test_winnowing_of_many_texts_is_that_of_each():
    rng = np.random.default_rng(12)
    texts = [rng.integers(0, 9, n).astype(np.uint64) for n in [0, 3, 8, 9, 10, 11, 12, 13, 0, 5, 300, 9, 8, 12, 0]]
    owner, found = p9.winnow_all(texts, 9, 4)
    assert [set(found[owner == i].tolist()) for i in range(len(texts))] == [set(p9.winnow(t, 9, 4).tolist()) for t in texts]
    assert len(p9.winnow_all([], 9, 4)[0]) == 0


# 10


def test_residue(spark):
    prose = [f"The team {v} the {n} before lunch, because the {m} was late." for v in ("moved", "checked", "printed", "signed") for n in ("plan", "list", "crate", "label") for m in ("courier", "vendor", "lift")]
    detector = p10.Detector(prose)
    cases = {
        "Dear {{ customer_name }}, your order was received.": ["placeholder"],
        "Hello [First Name]!": ["placeholder"],
        "To add a name to a mail merge, type {{first_name}} in the template; the tool fills it in when it sends.": [],
        "See [note 3] and <b>bold</b> and {8, 67}.": [],
        "404 Not Found\nThe requested page was not found on this server.": ["error_page"],
        "Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.": ["script_notice"],
        "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.": ["filler"],
        "blah blah blah blah blah blah": ["filler"],
        prose[0]: [],
        "": [],
        "   ": [],
    }
    assert {t: [k for k, _, _ in detector(t)] for t in cases} == cases
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)] + [(99, None), (0, next(iter(cases)))], "doc_id long, text string").withColumn("kind", F.lit(0))
    found = p10.residue(df, "doc_id", detector=detector)
    assert rows_of(found.select("doc_id", "kind")) == {(i, k) for i, ks in enumerate(cases.values()) for k in ks}
    assert {r.doc_id for r in p10.without_residue(df, found, "doc_id").collect()} == {i for i, ks in enumerate(cases.values()) if not ks} | {99}
    assert p10.residue(df.limit(0), "doc_id").count() == 0
    long = " ".join(prose * 40) + "\n404 Not Found\nThe requested page was not found on this server.\n" + " ".join(prose * 40)
    whole = detector(long)
    assert [k for k, _, _ in whole] == ["error_page"]
    p10.STRETCH, before = 1000, p10.STRETCH
    assert detector(long) == whole
    p10.STRETCH = before


def test_residue_of_long_texts_in_bounded_memory(monkeypatch):
    """The coarse pass changes no verdict, and a text of millions of characters takes little memory."""
    import resource

    prose = ["We met on Monday and went through the plan for the next weeks.", "Please send me the report when you have it, thanks a lot."] * 30
    run = p10.Detector(prose)
    texts = ["Your session was closed, sign in again.", "We met. The site is down for maintenance. We met.", prose[0], "The vendor checked the list.", "Skripte sind in Ihrem Browser blockiert."]
    found = [run(t) for t in texts]
    assert [[k for k, _, _ in f] for f in found] == [["error_page"], ["error_page"], [], [], ["script_notice"]]
    assert run.many([*texts, None, " ", "İ\n404 Not Found"]) == [*found, [], [], [("error_page", 13, 15)]]
    with monkeypatch.context() as m:
        m.setattr(p10, "STRETCH", 30)
        assert run.many(texts) == found
        m.setattr(p10, "COARSE", -1e9)
        assert [run(t) for t in texts] == found
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert [k for k, _, _ in run(" ".join(prose) * 1000 + "\n404 Not Found\n")] == ["error_page"]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000


def test_residue_is_judged_by_all_documents(spark):
    """Wording that only the documents of greatest id hash have teaches the prose model too, however the rows are split."""
    prose = [f"The team {v} the {n} before lunch, because the {m} was late." for v in ("moved", "checked", "printed", "signed") for n in ("plan", "list", "crate", "label") for m in ("courier", "vendor", "lift")]
    rare = ["The requested recipe was not found in the old book.", "The server brought the wrong soup and the request was denied."]
    last = [r.id for r in spark.range(1700).orderBy(F.xxhash64("id").desc()).limit(2).collect()]
    texts = {i: rare[last.index(i)] if i in last else prose[i % len(prose)] for i in range(1700)}
    assert [k for t in rare for k, _, _ in p10.Detector(prose)(t)] == ["error_page"] * 2
    df = spark.createDataFrame([*texts.items(), (None, "404 Not Found"), (1700, None), (1701, "Error 404: page not found")], "doc_id long, text string")
    assert rows_of(p10.residue(df, "doc_id").select("doc_id", "kind")) == {(1701, "error_page")}
    fits = [p10.fit(df, "doc_id", "text"), p10.fit(df.repartition(7), "doc_id", "text"), p10.Detector([*texts.values(), "Error 404: page not found"])]
    for fit in fits[1:]:
        assert all(np.array_equal(a, b) for a, b in zip([*fits[0].prose.p, *fits[0].corpus_only.p, fits[0].prose.seen], [*fit.prose.p, *fit.corpus_only.p, fit.prose.seen]))
    assert p10.residue(df.limit(0), "doc_id").count() == 0


def test_counts_of_parts_add_up(monkeypatch):
    """Counts don't depend on where texts are cut, and of n-grams that share a place the probability stays below 1."""
    texts = ["We met on Monday and went through the plan.", "Résumé 42", "İx", "a\0b", "", "The list, the plan and the label. " * 9]
    whole = p10.Counts(texts)
    parts = p10.Counts(texts[:2]) + p10.Counts(texts[2:])
    rows = p10.Counts.of_rows(whole.rows().sample(frac=1, random_state=1))
    monkeypatch.setattr(p10, "COUNTED", 7)
    for other in (parts, rows, p10.Counts(texts)):
        assert all(np.array_equal(a, b) for a, b in zip([*whole.keys, *whole.times, whole.seen], [*other.keys, *other.times, other.seen]))
    wide = "".join(chr(0x3000 + i) for i in range(9000))  # too many signs to be counted at once
    monkeypatch.setattr(p10, "COUNTED", 20_000)
    whole_wide = p10.Counts([wide, texts[0]])
    monkeypatch.setattr(p10, "COUNTED", 3001)
    parts = p10.Counts([wide]) + p10.Counts(texts[:1])
    assert all(np.array_equal(a, b) for a, b in zip([*whole_wide.keys, *whole_wide.times, whole_wide.seen], [*parts.keys, *parts.times, parts.seen]))
    assert [int(t.sum()) for t in parts.times] == [len(wide) + 1 + len(texts[0]) + 1] * 5
    model = p10.CharModel(whole, 4)
    assert all(p.max() <= w for p, w in zip(model.p, p10._WEIGHTS))


# shared parts


def test_residue_of_short_lines_and_long_fields():
    prose = ["We met on Monday and went through the plan for the next weeks.", "Please send me the report when you have it, thanks a lot."] * 30
    run = p10.Detector(prose)
    for field in ("{{customer.profile.billing.address.postal_code}}", "{{ name | title }}", "${customer.profile.billing.address.postal_code}"):
        assert [k for k, _, _ in run(f"Dear {field}, the plan is ready.")] == ["placeholder"]
    text = "We met on Monday and went through the plan.\n\nPlatzhaltertext\n\nPlease send me the report when you have it."
    assert [(k, n) for k, n, _ in run(text)] == [("filler", 15)]
    assert run("We met on Monday and went through the plan. Please send it. Thanks.") == []
    assert run("Ruvu,\n\nPlease send me the report when you have it, thanks a lot.") == []


def test_whole_groups():
    import pandas as pd

    frames = [pd.DataFrame({"k": k}) for k in ([], [1, 1], [1], [1, 2, 2, 3], [3, 3], [4])]
    got = list(whole_groups(iter(frames), "k"))
    assert [x for f in got for x in f["k"]] == [1, 1, 1, 1, 2, 2, 3, 3, 3, 4]
    assert all(set(a["k"]).isdisjoint(b["k"]) for a, b in zip(got, got[1:]))
    starts, ends = runs(np.array([1, 2, 2, 3, 3, 3]))
    assert list(zip(starts, ends)) == [(1, 3), (3, 6)]


def test_queries_are_registered():
    from skein.llm.queries import ORACLE, QUERIES

    assert ORACLE.keys() <= QUERIES.keys()
    assert {int(re.match(r"p(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 11))

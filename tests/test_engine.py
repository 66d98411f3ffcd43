"""Searches, lookups and changes on small collections, against SQLite where it can tell."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from skein.engine import SearchEngine
from skein.functions.prepare import mail_text, memory_text, truncate_words
from skein.functions.scores import bm25_to_score, cosine_distance, distance_to_score
from skein.operators import lookup, postings, search
from skein.operators.embedding import HashingEmbedder
from skein.operators.fusion import fuse
from skein.operators.postings import build_postings, collection_size, ranked_by_postings, sorted_by_term
from skein.operators.vector_search import nearest
from skein.plans.match import MESSAGES, ranked
from skein.plans.query import parse_match
from skein.plans.synonyms import Synonyms
from skein.sources.rows import MESSAGE_SCHEMA
from skein.sources.store import Conflict
from skein.streaming.ingest import ingest

COLUMNS = ["msgId", "subject", "from_", "to_", "cc", "bcc", "body"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    words = "project project. running runner runway meetings meeting café results-based bob@x.com alpha beta gamma delta".split()
    rows = [(i, f"id{i}", *(" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(6))) for i in range(1, 60)]
    db = sqlite3.connect(":memory:")
    for name, kind in (("plain", ""), ("stems", "porter ")):
        db.execute(f"CREATE VIRTUAL TABLE {name} USING fts5({', '.join(COLUMNS)}, tokenize=\"{kind}unicode61 remove_diacritics 2 tokenchars '-_.@'\")")
        db.executemany(f"INSERT INTO {name}(rowid, {', '.join(COLUMNS)}) VALUES ({', '.join('?' * 8)})", rows)
    return spark.createDataFrame(rows, ["rowid", *COLUMNS]), db


@pytest.mark.parametrize("stems", [False, True])
@pytest.mark.parametrize(
    "expression",
    ["project", "project*", "cafe", '"bob@x.com"', "bob", "(alpha OR beta) AND gamma", "alpha NOT beta", "subject: alpha", '"alpha beta"', "(alpha AND beta) OR gamma", "(alpha NOT beta) OR gamma", "running*", "meetings", "alpha alpha", "absent", "subject:(alpha OR beta) AND gamma"],
)
def test_match_and_bm25_equal_sqlite(corpus, expression, stems):
    df, db = corpus
    sql = f"SELECT rowid, bm25({'stems' if stems else 'plain'}, 0, 5, 3, 2, 1, 1, 1) FROM {'stems' if stems else 'plain'} WHERE {'stems' if stems else 'plain'} MATCH ?"
    expected = dict(db.execute(sql, (expression,)).fetchall())
    got = {r.rowid: r["rank"] for r in ranked(df, parse_match(expression, COLUMNS), MESSAGES, stems).collect()}
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_empty_collection(spark, corpus):
    assert ranked(corpus[0].limit(0), parse_match("alpha", COLUMNS), MESSAGES).count() == 0


def test_scores(spark):
    df = spark.createDataFrame([(0.0,), (-10.0,), (5.0,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(F.round(bm25_to_score(F.col("x")), 6)).collect()] == [0.0, 0.909091, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.5,), (float("nan"),)], "x double")
    assert [r[0] for r in df.select(distance_to_score(F.col("x"))).collect()] == [1.0, 0.5, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(cosine_distance(F.col("v"), F.array(F.lit(1.0), F.lit(0.0)))).collect()] == [0.0, None, None, None, None]


def test_fusion(spark):
    text = spark.createDataFrame([(1, -10.0), (2, -5.0)], "rowid long, rank double")
    vectors = spark.createDataFrame([(1, 0.2), (3, 0.1), (4, 0.9)], "rowid long, distance double")
    assert [(r.rowid, round(r.final_score, 5)) for r in fuse(text, vectors, 10).collect()] == [(1, 0.83273), (3, 0.63), (2, 0.25)]


def test_nearest(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 1.0])], "rowid long, embedding array<float>")
    assert [r.rowid for r in nearest(df, [1.0, 0.0], 2).collect()] == [1, 5]


def test_prepared_texts(spark):
    df = spark.createDataFrame([(" s ", "", "t", "red  green blue")], "s string, f string, t string, b string")
    assert df.select(mail_text(F.col("s"), F.col("f"), F.col("t"), F.col("b"))).first()[0] == "Subject: s\nSubject: s\nTo: t\n\nred  green blue"
    assert df.select(memory_text(F.lit("user"), F.lit("What's up?"))).first()[0] == "user: What's up?"
    assert df.select(truncate_words(F.lit("oak elm ash fir yew box"), 5)).first()[0] == "oak elm ash fir yew"
    assert df.select(truncate_words(F.col("b"), 3)).first()[0] == "red  green"


def test_header_lookup(spark):
    ids = ["north:/Archive [old]/Year 2:k77", "north:/Sent:K77", "south:/Sent:k77", "north:/Sent:k778", "a\\b:/x:h"]
    df = spark.createDataFrame([(i,) for i in ids], "msgId string")
    found = lambda a, h: {r[0] for r in lookup.by_header(df, a, h).collect()}
    assert found("north", "k77") == set(ids[:2])
    assert found("north", "k7_") == set(ids[:2])
    assert found("a\\b", "h") == {ids[4]}


def test_first_wins_and_negative_limit(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 0, "z"), ("", 0, "z")], "k string, n long, v string")
    assert [tuple(r) for r in lookup.first_wins(df, "k", "n").collect()] == [("a", 1, "y")]
    with pytest.raises(ValueError):
        lookup.check_limit(-1)


def _mail(i, **more):
    return {"msgId": f"ferry:/In:{i}", "subject": f"Harbour timetable number {i}", "from": f"crew{i}@ferry.example", "body": "Cabins remain available for the night crossing", "dateMs": 1_700_000_000_000 + i, **more}


def test_engine_workflow(spark, tmp_path):
    engine = SearchEngine.open(spark, str(tmp_path / "db"), HashingEmbedder())
    engine.handle({"id": 0, "method": "init"})
    assert engine.handle({"id": 1, "method": "indexBatch", "params": {"rows": [_mail(1), _mail(2), _mail(1, subject="late"), {"subject": "no id"}]}})["result"] == {"ok": True, "count": 2, "skippedDuplicates": 1}
    assert engine.messages.index([_mail(2), _mail(3)]) == {"ok": True, "count": 1, "skippedDuplicates": 1}
    assert engine.messages.get("ferry:/In:1")["subject"] == "Harbour timetable number 1" and engine.messages.get("none") is None
    assert sorted(r.rowid for r in engine.messages.collection.docs().collect()) == [1, 2, 3]
    hits = engine.handle({"id": 2, "method": "search", "params": {"q": "harbour timetable cabins remain available night crossing"}})["result"]
    assert {h["uniqueId"] for h in hits} == {f"ferry:/In:{i}" for i in (1, 2, 3)} and set(hits[0]) == {"rowid", "uniqueId", "author", "subject", "dateMs", "hasAttachments", "snippet", "rank"}
    assert engine.messages.search("").count() == 0
    assert engine.messages.filter_new([{"msgId": "x"}, {"msgId": "x"}, {"msgId": "ferry:/In:1"}, {}]) == {"newMsgIds": ["x", "x"], "newCount": 2, "skippedCount": 1, "totalChecked": 4}
    assert engine.messages.find_by_header("ferry", "2") == ["ferry:/In:2"]
    assert [r.dateStr for r in engine.messages.by_date_range(0, 1_700_000_000_001).collect()] == ["2023-11-14T22:13:20.001000"]
    assert engine.messages.stats()["vecDocs"] == 3
    assert engine.rebuild_start() == {"emailTotal": 3, "memoryTotal": 0}
    first = engine.rebuild_batch(size=2)
    assert (first["processed"], first["done"]) == (2, False)
    assert engine.rebuild_batch(last_rowid=first["lastRowid"], size=2)["done"] and engine.messages.stats()["vecDocs"] == 3
    assert engine.messages.remove(["ferry:/In:1", "ferry:/In:1", 5, "unknown", ""]) == {"ok": True, "count": 1}
    assert engine.messages.index([_mail(9)])["count"] == 1 and engine.messages.collection.docs().agg(F.max("rowid")).first()[0] == 4
    engine.messages.optimize()
    assert engine.messages.stats() == {**engine.messages.stats(), "docs": 3, "vecDocs": 3}
    engine.messages.clear()
    assert engine.messages.stats()["docs"] == 0 and engine.messages.search("harbour").count() == 0
    assert "error" in engine.handle({"id": 3, "method": "nope"})


def test_memory_engine(spark, tmp_path):
    engine = SearchEngine.open(spark, str(tmp_path / "db"))
    rows = [{"memId": f"chat:s:{i}", "role": "user" if i % 2 else "assistant", "content": f"about printers {i}", "sessionId": "s", "dateMs": 1_000_000 + i, "turnIndex": i} for i in range(3)]
    assert engine.memory.index(rows)["count"] == 3
    assert [r.memId for r in engine.memory.search("", limit=2).collect()] == ["chat:s:2", "chat:s:1"]
    assert engine.memory.search("printer").count() == 3
    assert [r.memId for r in engine.memory.read_around(1_000_000, 1).collect()] == ["chat:s:0", "chat:s:1"]
    with pytest.raises(ValueError):
        engine.memory.read_around(0)
    with pytest.raises(ValueError):
        engine.rebuild_start()
    with pytest.raises(ValueError):
        engine.memory.search("printer", low="soon")
    assert engine.memory.stats()["memoryVecDocs"] == 0


@pytest.mark.parametrize("stems", [False, True])
@pytest.mark.parametrize("expression", ["project", "project*", '"alpha beta"', '"alpha be"*', "subject: alpha", "(alpha OR beta) AND gamma", "alpha NOT beta", "(alpha NOT beta) OR gamma", "subject:(alpha OR beta) NOT body:gamma", "running*", "alpha alpha", "absent"])
def test_postings_equal_sqlite(corpus, expression, stems):
    df, db = corpus
    sql = f"SELECT rowid, bm25({'stems' if stems else 'plain'}, 0, 5, 3, 2, 1, 1, 1) FROM {'stems' if stems else 'plain'} WHERE {'stems' if stems else 'plain'} MATCH ?"
    expected = dict(db.execute(sql, (expression,)).fetchall())
    index = sorted_by_term(build_postings(df, MESSAGES, stems), 3)
    got = {r.rowid: r["rank"] for r in ranked_by_postings(index, collection_size(df, MESSAGES), parse_match(expression, COLUMNS), MESSAGES, stems).collect()}
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_many_queries_rank_like_single_ones(spark, corpus):
    df, _ = corpus
    synonyms = Synonyms([["alpha", "delta"]])
    texts = ["project runner", '"alpha beta"', "subject:gamma", "gamma OR cafe", "runway NOT project", "from:beta gamma", "alph*", "", "NEAR(a b)", "subject:(project OR cafe) gamma", None]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    index = search.Index(build_postings(df, MESSAGES), collection_size(df, MESSAGES))
    got = {}
    for r in search.search_many(index, queries, MESSAGES, 5, synonyms).collect():
        got.setdefault(r.query_id, []).append((r.position, r.rowid, round(r["rank"], 9)))
    for i, text in enumerate(texts):
        tree = search.tree_of(text, MESSAGES, synonyms) if text and "NEAR" not in text else None
        found = ranked(df, tree, MESSAGES).orderBy("rank", "rowid").limit(5).collect() if tree is not None else []
        assert sorted(got.get(i, [])) == [(n + 1, r.rowid, round(r["rank"], 9)) for n, r in enumerate(found)]


def test_many_queries_from_texts_and_in_slices(spark, corpus, monkeypatch):
    """Texts in place of an index, ranked a few rows at a time, with words asked for twice."""
    monkeypatch.setattr(postings, "MOST_HITS", 5)
    df, _ = corpus
    synonyms = Synonyms([["alpha", "delta"]])
    texts = ["gamma gamma", '"alpha beta" project', "(project NOT runner) OR subject:gamma", "alpha cafe"]
    queries = spark.createDataFrame([*enumerate(texts), (9, texts[0]), (10, "")], "query_id long, query string")
    valid = df.where("rowid % 3 > 0").select("msgId", "rowid")
    few = df.join(valid, "rowid", "left_semi")
    index = search.Index(build_postings(few, MESSAGES), collection_size(few, MESSAGES))
    rows = lambda found: {(r.query_id, r.position): (r.rowid, round(r["rank"], 9)) for r in found.collect()}
    got = rows(search.search_many(df, queries, MESSAGES, 5, synonyms, valid))
    assert got == rows(search.search_many(index, queries, MESSAGES, 5, synonyms))
    for i, text in [*enumerate(texts), (9, texts[0])]:
        found = ranked(few, search.tree_of(text, MESSAGES, synonyms), MESSAGES).orderBy("rank", "rowid").limit(5).collect()
        assert [got[k] for k in sorted(got) if k[0] == i] == [(r.rowid, round(r["rank"], 9)) for r in found]
    assert {k[0] for k in got} == {0, 1, 2, 3, 9}
    assert search.search_many(df, queries, MESSAGES, 0, synonyms).count() == search.search_many(df, queries.where("query_id = 10"), MESSAGES).count() == 0


def test_many_queries_shuffle_no_matches(spark):
    """200 rows that all of 100 queries match are 20,000 matches; only the best of a task may be shuffled."""
    df = spark.createDataFrame([(i, *[f"m{i}", "alpha", "", "", "", "", "beta gamma " * (i % 5 + 1)]) for i in range(200)], ["rowid", *COLUMNS])
    queries = spark.createDataFrame([(i, "alpha " + "beta " * (i // 10) + "gamma " * (i % 10)) for i in range(100)], "query_id long, query string")
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    written = lambda: sum(found.apply(i).shuffleWriteRecords() for found in [stages()] for i in range(found.size()))
    index = search.Index(build_postings(df, MESSAGES), collection_size(df, MESSAGES))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = written()
    assert search.search_many(index, queries, MESSAGES, 2).count() == 200
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert 0 < written() - before < 6_000


def test_a_batch_writes_only_its_own_rows(spark, tmp_path):
    engine = SearchEngine.open(spark, str(tmp_path / "db"), HashingEmbedder())
    store = engine.messages.collection
    engine.messages.index([_mail(i, body="alpha " * (i % 4) + "beta planning" + " filler" * i) for i in range(12)])
    first = store.manifest()
    engine.messages.index([_mail(20, body="alpha planning")])
    second = store.manifest()
    assert second["docs"][:1] == first["docs"] and second["postings"][:1] == first["postings"] and len(second["docs"]) == 2
    engine.messages.remove(["ferry:/In:1"])
    assert store.manifest()["docs"] == second["docs"] and store.manifest()["rows"] == 12
    tree = parse_match("alpha planning", MESSAGES.columns)
    index = store.index_of()
    rank = lambda df: {r.rowid: round(r["rank"], 9) for r in df.collect()}
    expected = rank(ranked(store.docs(), tree, MESSAGES, stems=True))
    assert rank(ranked_by_postings(index.postings, index.size, tree, MESSAGES, True)) == expected and len(expected) == 9
    reader = store.docs()
    engine.messages.optimize()
    assert reader.count() == 12 and len(store.manifest()["docs"]) == 1  # a reader of an older version goes on
    index = store.index_of()
    assert rank(ranked_by_postings(index.postings, index.size, tree, MESSAGES, True)) == expected
    plan = spark.read.parquet(store.folder.url(store.manifest()["postings"][0])).where(F.col("term").isin("alpha"))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,alpha)]" in plan
    kept = set(store.folder.names())
    store.optimize(keep_seconds=0)
    store.optimize(keep_seconds=0)
    assert not kept & {n for n in store.folder.names() if not n.startswith("manifest")} and store.docs().count() == 12 and engine.messages.stats()["vecDocs"] == 12


def test_a_second_writer_is_refused(spark, tmp_path):
    store = SearchEngine.open(spark, str(tmp_path / "db")).messages.collection
    old = store.manifest()
    store._publish(old)
    with pytest.raises(Conflict):
        store._publish(old)
    assert store.manifest()["number"] == old["number"] + 1


def test_a_failing_text_loses_only_its_own_vector(spark, tmp_path):
    class Picky(HashingEmbedder):
        def embed(self, texts):
            if any("poison" in t for t in texts):
                raise RuntimeError("cannot read this")
            return super().embed(texts)

    engine = SearchEngine.open(spark, str(tmp_path / "db"), Picky())
    assert engine.messages.index([_mail(1), _mail(2, body="poison"), _mail(3)])["count"] == 3
    assert engine.messages.stats()["vecDocs"] == 2
    engine.rebuild_start()
    assert engine.rebuild_batch(size=10) == {"target": "email", "lastRowid": 3, "processed": 3, "embedded": 2, "done": True}
    engine.rebuild_batch(size=10)  # again: the vectors are replaced, not doubled
    assert engine.messages.stats()["vecDocs"] == 2


def test_nothing_is_answered_before_init(spark, tmp_path):
    engine = SearchEngine.open(spark, str(tmp_path / "db"))
    assert engine.handle({"id": 1, "method": "hello"})["result"]["schemaVersion"] >= 1
    assert "error" in engine.handle({"id": 2, "method": "stats"})
    engine.handle({"id": 3, "method": "init"})
    assert engine.handle({"id": 4, "method": "stats"})["result"]["docs"] == 0


def test_streaming_ingest(spark, tmp_path):
    engine = SearchEngine.open(spark, str(tmp_path / "db"))
    source = tmp_path / "in"
    make = lambda i: (f"m{i}", "hello", "", "", "", "", "", i, False, "")
    spark.createDataFrame([make(1), make(2)], MESSAGE_SCHEMA).write.parquet(str(source))
    run = lambda: ingest(spark.readStream.schema(MESSAGE_SCHEMA).parquet(str(source)), engine.messages.collection, str(tmp_path / "checkpoint"), once=True).awaitTermination()
    run()
    spark.createDataFrame([make(2), make(3)], MESSAGE_SCHEMA).write.mode("append").parquet(str(source))
    run()
    assert sorted(r.msgId for r in engine.messages.collection.docs().collect()) == ["m1", "m2", "m3"]


def test_versions(spark):
    from skein.functions.versions import version_less_than

    pairs = [("1.2", "1.10", True), ("1.2", "1.2.0", False), ("2.0", "1.9.9", False), ("1.x.3", "1.4", True), ("1" + ".0" * 40, "1", False), ("1" + ".0" * 40 + ".1", "1" + ".0" * 40 + ".2", True)]
    df = spark.createDataFrame(pairs, "a string, b string, less boolean")
    assert [r[0] for r in df.select(version_less_than(F.col("a"), F.col("b")) == F.col("less")).collect()] == [True] * 6


def test_embedding_each_text_once(spark):
    from skein.operators.embedding import embed, embed_distinct

    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "")], "rowid long, text string")
    plain, once = ({r.rowid: r.embedding for r in f(df, "rowid", "text", HashingEmbedder(8)).collect()} for f in (embed, embed_distinct))
    assert plain == once and len(once) == 4

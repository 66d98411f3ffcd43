"""Parts that need no Spark: query language, dates, stems, synonyms, row coercion, pooling."""

import sqlite3
from math import isclose

import numpy as np
import pytest

from skein.functions.analysis import tokens_py
from skein.functions.dates import DateError, parse_date
from skein.functions.porter import stem
from skein.operators.embedding import HashingEmbedder, mean_pool
from skein.operators.snippet import best_window
from skein.plans.query import And, Not, Or, Phrase, QueryError, compile_query, parse_match, phrases
from skein.plans.synonyms import Synonyms, default_synonyms
from skein.sources.rows import MEMORY_SCHEMA, MESSAGE_SCHEMA, coerce

SYNONYMS = Synonyms([["allocation", "budget", "cost", "expense", "spending"], ["cost", "price"], ["tomorrow"]])


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("", ""),
        ("budget", "(allocation OR budget OR cost OR expense OR spending)"),
        ("quarterly numbers", "quarterly* numbers*"),
        ("quarterly budget", "quarterly AND (allocation OR budget OR cost OR expense OR spending)"),
        ("from:bob@x.com", 'from_:"bob@x.com"'),
        ("TO :bob", "to_:bob"),
        ('from:"Bob Lee" hi', 'from_:"Bob Lee" hi'),
        ("foo-bar*", '"foo-bar"'),
        ("*", ""),
        ("what's?", "whats*"),
        ("subject:*", 'subject:"."'),
        ("subject:", ""),
        ("café", "café*"),
        ('"two words" budget', '"two words" AND (allocation OR budget OR cost OR expense OR spending)'),
        ("price", "(cost OR price)"),
        ("a,b", '"a,b"'),
        ("this NOT that", "this* NOT that*"),
        ('open "quote here', 'open* "quote here"'),
    ],
)
def test_compile(query, expected):
    assert compile_query(query, SYNONYMS) == expected


def test_parse():
    columns = ["subject", "body"]
    a, b, c = (Phrase((x,)) for x in "abc")
    assert parse_match("a b OR c", columns) == Or(And(a, b), c)
    assert parse_match("(a OR b) NOT c", columns) == Not(Or(a, b), c)
    assert parse_match('subject:"Two Words" a*', columns) == And(Phrase(("two", "words"), False, "subject"), Phrase(("a",), True))
    assert parse_match("", columns) is None
    for wrong in ("http:x", "(a", "a AND", "OR"):
        with pytest.raises(QueryError):
            parse_match(wrong, columns)


def test_a_column_holds_for_a_group():
    columns = ["subject", "body"]
    tree = parse_match(compile_query("subject:(ab OR cd) ef", Synonyms([])), columns)
    assert [(p.tokens, p.column) for p in phrases(tree)] == [(("ab",), "subject"), (("cd",), "subject"), (("ef",), None)]
    assert parse_match("subject:(a (b NOT c))", columns) == parse_match("subject:a AND (subject:b NOT subject:c)", columns)
    assert compile_query("subject:(cost) plan", Synonyms([["cost", "price"]])) == "subject:( (cost OR price) ) AND plan"
    for wrong in ("nowhere:(a b)", "subject:(body:a)", "subject:(a"):
        with pytest.raises(QueryError):
            parse_match(wrong, columns)
    with pytest.raises(QueryError):
        compile_query("NEAR(a b)", Synonyms([]))


def test_synonyms():
    assert SYNONYMS.expand("COST") == ["allocation", "budget", "cost", "expense", "spending"]
    assert SYNONYMS.expand("price") == ["cost", "price"]
    assert SYNONYMS.expand("tomorrow") == [] == SYNONYMS.expand("other")
    assert default_synonyms().expand("Refund") == ["refund", "reimbursement", "repayment"]


@pytest.mark.parametrize(("value", "expected"), [(None, None), (17, 17), (1.9, 1), ("17", 17), (" ", None), (True, None), ([], None), ("2024-01-01T00:00:00Z", 1704067200000), ("2024-01-01T01:00:00.5+01:00", 1704067200500)])
def test_dates(value, expected):
    assert parse_date(value) == expected


@pytest.mark.parametrize("value", ["2024-01-01", "2024-01-01T00:00:00", "soon", "2024-13-01T00:00:00Z"])
def test_wrong_dates(value):
    with pytest.raises(DateError):
        parse_date(value)


def test_stems_equal_sqlite():
    words = """caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional
    rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate
    formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti
    homologous effective bowdlerize probate rate cease controll roll running runner runway meetings meeting project translated translation archive archived generalization oscillators""".split()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    for i, w in enumerate(words):
        db.execute("INSERT INTO t(rowid, x) VALUES (?, ?)", (i, w))
    assert [stem(w) for w in words] == [r[0] for r in db.execute("SELECT term FROM v ORDER BY doc")]


def test_tokens():
    assert tokens_py("Café Résumé: bob@x.com, results-based it's project.") == ["cafe", "resume", "bob@x.com", "results-based", "it", "s", "project."]


def test_coerce():
    assert coerce({"subject": "x"}, MESSAGE_SCHEMA) is None
    assert coerce({"msgId": 5}, MESSAGE_SCHEMA) is None
    row = coerce({"msgId": "a", "from": "f", "to_": "", "to": "t", "dateMs": 1.5, "hasAttachments": 1}, MESSAGE_SCHEMA)
    assert row == ("a", "", "f", "", "", "", "", 0, False, "")
    assert coerce({"memId": "m", "dateMs": 7, "turnIndex": True}, MEMORY_SCHEMA) == ("m", "", "", "", 7, 0)


def test_embedder_and_pooling():
    e = HashingEmbedder(16)
    v = e.embed(["hello world", "", "hello world"])
    assert isclose(float(np.linalg.norm(v[0])), 1.0, rel_tol=1e-6) and not v[1].any() and (v[0] == v[2]).all()
    pooled = mean_pool(np.array([[[1.0, 0], [0, 2], [9, 9]]]), np.array([[1, 1, 0]]))
    assert np.allclose(pooled, [[1 / 5**0.5, 2 / 5**0.5]])


def test_snippet():
    text = " ".join(f"w{i}" for i in range(100)).replace("w50", "needle")
    _, cut = best_window(text, [Phrase(("needle",))])
    assert cut.startswith("…") and cut.endswith("…") and "[needle]" in cut and len(cut.split()) == 16
    assert best_window("short text", [Phrase(("gone",))]) == (0, "short text")

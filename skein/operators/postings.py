"""Postings: the inverted form of a collection, for searches that touch few terms of a large one."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.analysis import tokens
from skein.functions.porter import stem
from skein.plans.match import K1, LEAST_IDF, B, Layout, evaluate, stem_tree
from skein.plans.query import And, Not, Or, Phrase, phrases
from skein.session import shared_folder

#: Places of one column lie below those of the next; a column has at most so many tokens.
COLUMN = 1 << 32

#: Phrases of rows that a task ranks at once, which bounds its memory.
MOST_HITS = 2_000_000


def postings_schema(rowid: T.DataType | None = None) -> T.StructType:
    return T.StructType([T.StructField("term", T.StringType()), T.StructField("rowid", rowid or T.LongType()), T.StructField("places", T.ArrayType(T.LongType())), T.StructField("length", T.LongType())])


def build_postings(df: DataFrame, layout: Layout, stems: bool = False) -> DataFrame:
    """(term, rowid, places, length): where each term of a row stands, and the tokens of the row in all columns.

    A place is the column's number times COLUMN plus the token's number. Terms
    are gathered inside each row, so that nothing is shuffled here; written
    sorted by term (see the store), a search reads only the row groups of its
    terms. With `stems` the terms are stems.
    """
    columns = [f"_t{i}" for i in range(len(layout.columns))]
    rows = df.select("rowid", *[tokens(F.col(c)).alias(n) for c, n in zip(layout.columns, columns)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, str] = {}

        def term(word: str) -> str:
            if word not in known:
                if len(known) > 500_000:
                    known.clear()
                known[word] = stem(word)
            return known[word]

        for t in batches:
            out: list[tuple] = []
            for rowid, *texts in t.itertuples(index=False, name=None):
                found: dict[str, list[int]] = {}
                for i, words in enumerate(texts):
                    for j, w in enumerate(words):
                        found.setdefault(term(w) if stems else w, []).append(i * COLUMN + j)
                length = sum(map(len, texts))
                out += [(w, rowid, places, length) for w, places in found.items()]
                if len(out) > 200_000:
                    yield pd.DataFrame(out, columns=["term", "rowid", "places", "length"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["term", "rowid", "places", "length"])

    return rows.mapInPandas(run, postings_schema(df.schema["rowid"].dataType))


def sorted_by_term(postings: DataFrame, files: int) -> DataFrame:
    """Range-partitioned by term and row, so that a frequent term lies in several files, and sorted."""
    return postings.repartitionByRange(files, "term", "rowid").sortWithinPartitions("term", "rowid")


def collection_size(df: DataFrame, layout: Layout) -> tuple[int, int]:
    """(rows, tokens in all) of a collection: what a rank needs beside the postings."""
    total = reduce(lambda a, b: a + b, [F.size(tokens(F.col(c))) for c in layout.columns])
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(total.cast("long")).alias("length")).first()
    return found["rows"], found["length"] or 0


def _of_columns(places: Column, columns: list[int] | None) -> Column:
    if columns is None:
        return places
    return F.filter(places, lambda x: F.floor(x / COLUMN).isin(*columns))


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x + by)


def _phrase_rows(postings: DataFrame, phrase: Phrase, layout: Layout) -> DataFrame:
    """(rowid, length, places): where a phrase ends in each row that has it."""
    own = [layout.columns.index(phrase.column)] if phrase.column else None
    *exact, last = phrase.tokens
    ends = F.col("term").startswith(last) if phrase.prefix else F.col("term") == last
    if not exact:
        rows = postings.where(ends).select("rowid", "length", _of_columns(F.col("places"), own).alias("places"))
        if phrase.prefix:
            rows = rows.groupBy("rowid", "length").agg(F.flatten(F.collect_list("places")).alias("places"))
        return rows.where(F.size("places") > 0)
    # Each token's places are moved to where the phrase would end; they are common to all tokens where it does.
    n = len(phrase.tokens)
    sides = [(F.col("term") == t, n - 1 - i) for i, t in enumerate(exact)] + [(ends, 0)]
    moved = [postings.where(on).select("rowid", "length", F.lit(i).alias("i"), _moved(_of_columns(F.col("places"), own), by).alias("places")) for i, (on, by) in enumerate(sides)]
    together = reduce(DataFrame.unionByName, moved).groupBy("rowid", "length").agg(*[F.flatten(F.collect_list(F.when(F.col("i") == i, F.col("places")))).alias(f"p{i}") for i in range(n)])
    return together.select("rowid", "length", reduce(F.array_intersect, [F.col(f"p{i}") for i in range(n)]).alias("places")).where(F.size("places") > 0)


def ranked_by_postings(postings: DataFrame, size: tuple[int, int], tree: object, layout: Layout, stems: bool = False) -> DataFrame:
    """(rowid, rank): the rows that match a tree with their BM25 rank, as a scan gives them; only the postings of its terms are read.

    `size` are the collection's rows and tokens. Each phrase's rows are found
    from its terms, counted (one small aggregate, which the inverse document
    frequencies need before the search is planned) and brought together by row.
    """
    tree = stem_tree(tree) if stems else tree
    every = list(dict.fromkeys(phrases(tree)))
    rows, total = size
    mean = total / rows if rows else 1.0
    weighted = reduce(lambda a, b: a + b, [F.size(_of_columns(F.col("places"), [i])) * F.lit(float(w)) for i, w in enumerate(layout.weights.values())])
    parts = [_phrase_rows(postings, p, layout).select(F.lit(i).alias("i"), "rowid", "length", weighted.alias("f")) for i, p in enumerate(every)]
    hits = reduce(DataFrame.unionByName, parts)
    counts = dict(hits.groupBy("i").count().collect())  # one row a phrase
    wide = hits.groupBy("rowid").agg(F.max("length").alias("length"), *[F.max(F.when(F.col("i") == i, F.col("f"))).alias(f"f{i}") for i in range(len(every))])
    matched = {p: F.col(f"f{i}").isNotNull() for i, p in enumerate(every)}
    whole, scored = evaluate(tree, matched, F.lit(True))
    rank = F.lit(0.0)
    for p, live in scored:
        i = every.index(p)
        n = counts.get(i, 0)
        idf = log((rows - n + 0.5) / (n + 0.5)) if rows else 0.0
        f = F.col(f"f{i}")
        part = F.lit(max(idf, 0.0) or LEAST_IDF) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.lit(mean or 1.0)))
        rank = rank - F.when(live & f.isNotNull(), part).otherwise(0.0)
    return wide.where(whole).select("rowid", rank.alias("rank"))


def _wanted(asked: list[Phrase], layout: Layout) -> pd.DataFrame:
    """(phrase, n, i, token, prefix, col): a row for each token of each phrase asked for; `col` is -1 for any column."""
    names = ["phrase", "n", "i", "token", "prefix", "col"]
    out = [(no, len(p.tokens), i, token, p.prefix and i == len(p.tokens) - 1, layout.columns.index(p.column) if p.column else -1) for no, p in enumerate(asked) for i, token in enumerate(p.tokens)]
    return pd.DataFrame(out, columns=names)


_WANTED = "phrase int, n int, i int, token string, prefix boolean, col int"


def _hits_schema(rows: DataFrame, *kept: str) -> T.StructType:
    fields = [T.StructField("length", T.LongType()), T.StructField("phrases", T.ArrayType(T.IntegerType())), T.StructField("fs", T.ArrayType(T.DoubleType()))]
    return T.StructType([rows.schema["rowid"], *[rows.schema[c] for c in kept], *fields])


def hits_of_postings(postings: DataFrame, asked: list[Phrase], layout: Layout) -> DataFrame:
    """(rowid, length, phrases, fs): the phrases of each row that has any, by their numbers in `asked`, with their weighted frequencies.

    Tokens asked for are joined with the postings before anything is counted, prefixes by their first letters.
    """
    wanted = _wanted(asked, layout)
    tokens_ = postings.sparkSession.createDataFrame(list(wanted.itertuples(index=False, name=None)), _WANTED)
    lengths = sorted({len(t) for t, prefix in zip(wanted["token"], wanted["prefix"]) if prefix})  # few: the lengths of words
    by_term = [postings.withColumnRenamed("term", "token").join(tokens_.where(~F.col("prefix")), "token")]
    by_term += [postings.withColumn("token", F.substring("term", 1, n)).drop("term").join(tokens_.where(F.col("prefix") & (F.length("token") == n)), "token") for n in lengths]
    moved = F.transform(F.filter("places", lambda x: (F.col("col") < 0) | (F.floor(x / COLUMN) == F.col("col"))), lambda x: x + (F.col("n") - 1 - F.col("i")))
    sides = reduce(DataFrame.unionByName, [d.select("phrase", "n", "i", "rowid", "length", moved.alias("places")) for d in by_term]).where(F.size("places") > 0)
    each = sides.groupBy("phrase", "rowid", "i").agg(F.max("n").alias("n"), F.max("length").alias("length"), F.flatten(F.collect_list("places")).alias("places"))
    met = each.groupBy("phrase", "rowid").agg(F.max("n").alias("n"), F.max("length").alias("length"), F.collect_list("places").alias("all")).where(F.size("all") == F.col("n"))
    places = F.aggregate(F.slice("all", 2, F.size("all")), F.col("all")[0], lambda a, b: F.array_intersect(a, b))
    weighted = reduce(lambda a, b: a + b, [F.size(_of_columns(F.col("places"), [i])) * F.lit(float(w)) for i, w in enumerate(layout.weights.values())])
    hits = met.select("phrase", "rowid", "length", places.alias("places")).where(F.size("places") > 0).select("rowid", "length", F.struct("phrase", weighted.alias("f")).alias("hit"))
    return hits.groupBy("rowid").agg(F.max("length").alias("length"), F.collect_list("hit").alias("hits")).select("rowid", "length", F.col("hits.phrase").alias("phrases"), F.col("hits.f").alias("fs"))


def hits_of_texts(df: DataFrame, asked: list[Phrase], layout: Layout) -> DataFrame:
    """(rowid, key, length, phrases, fs) of every row, as hits_of_postings has them, from one scan of the texts and without a shuffle.

    Tokens are made by the same built-in expression as everywhere; Python sees
    each different token of a batch once, and all else is done on arrays.
    """
    columns = [f"_t{i}" for i in range(len(layout.columns))]
    rows = df.select("rowid", layout.key, *[tokens(F.col(c)).alias(n) for c, n in zip(layout.columns, columns)])
    wanted, weights, kinds = _wanted(asked, layout), list(layout.weights.values()), max(1, len(asked))
    schema = _hits_schema(df, layout.key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact: dict[str, list[int]] = {}
        prefixes: dict[str, list[int]] = {}
        for use, (token, prefix) in enumerate(zip(wanted["token"], wanted["prefix"])):
            (prefixes if prefix else exact).setdefault(token, []).append(use)
        lengths = sorted({len(t) for t in prefixes})
        phrase, n, i, col = (wanted[c].to_numpy(dtype="int64") for c in ("phrase", "n", "i", "col"))
        known: dict[str, list[int]] = {}
        none: list[int] = []

        def uses(token: str) -> list[int]:
            """The places in phrases at which a token may stand."""
            if token not in known:
                if len(known) > 100_000:
                    known.clear()
                known[token] = [*exact.get(token, ()), *[u for m in lengths if m <= len(token) for u in prefixes.get(token[:m], ())]] or none
            return known[token]

        for t in (b.slice(k, 2_000) for b in batches for k in range(0, b.num_rows, 2_000)):
            length = np.zeros(t.num_rows, dtype="int64")
            found: list[tuple] = []
            for c, name in enumerate(columns):
                lists = t.column(t.schema.get_field_index(name))
                own = np.diff(lists.offsets.to_numpy())
                length += own
                words = lists.flatten().dictionary_encode()
                by_word = [uses(w) for w in words.dictionary.to_pylist()]
                counts = np.array([len(u) for u in by_word], dtype="int64")
                word = words.indices.to_numpy(zero_copy_only=False)
                at = np.flatnonzero(counts[word]) if len(word) else np.zeros(0, dtype="int64")
                if not len(at):
                    continue
                word, first = word[at], np.cumsum(own) - own
                row = np.repeat(np.arange(t.num_rows), own)[at]
                times = counts[word]  # each of the word's uses at each of its places
                start = np.repeat((np.cumsum(counts) - counts)[word], times)
                step = np.arange(len(start)) - np.repeat(np.cumsum(times) - times, times)
                use = np.array([u for us in by_word for u in us], dtype="int64")[start + step]
                row, place = np.repeat(row, times), np.repeat(at - first[row], times)
                here = (col[use] < 0) | (col[use] == c)
                use, row, place = use[here], row[here], place[here]
                found.append((row, phrase[use], place + n[use] - 1 - i[use], n[use], np.full(len(row), c)))
            empty = np.zeros(0, dtype="int64")
            row, kind, end, need, column = map(np.concatenate, zip(*found)) if found else (empty,) * 5
            # A phrase stands where all its tokens, moved to its end, meet.
            order = np.lexsort((end, column, kind, row))
            row, kind, end, need, column = (x[order] for x in (row, kind, end, need, column))
            begins = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(kind) != 0) | (np.diff(end) != 0) | (np.diff(column) != 0)]) if len(row) else empty
            begins = begins[np.diff(np.r_[begins, len(row)]) == need[begins]]
            row, kind, column = row[begins], kind[begins], column[begins]
            key, number = np.unique(row * kinds + kind, return_inverse=True)
            f = np.zeros(len(key))
            for c, w in enumerate(weights):
                f += np.bincount(number[column == c], minlength=len(key)) * float(w)
            offsets = pa.array(np.searchsorted(key, np.arange(t.num_rows + 1) * kinds), type=pa.int32())
            arrays = [t.column(0), t.column(1), pa.array(length), pa.ListArray.from_arrays(offsets, pa.array(key % kinds, type=pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(f))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(run, schema)


def rank_many(hits: DataFrame, size: tuple[int, int] | None, queries: DataFrame, trees: dict[str, object], asked: list[Phrase], layout: Layout, limit: int) -> DataFrame:
    """(query_id, rowid, rank, position): the best rows of each of queries(query_id, query), as a single search ranks them.

    `hits` are those of the phrases `asked`; without `size` they have a row for
    each row of the collection. They are written to the shared folder, as they
    are read twice: the rows of each phrase are counted for all queries, then
    each task ranks its own rows for every different query and hands on the
    best `limit`, so that what is shuffled does not grow with the matches.
    The different queries are known to the driver and to every task.
    """
    spark, schema = hits.sparkSession, hits.schema
    if limit < 1 or not trees:
        return queries.limit(0).select("query_id", F.lit(None).cast(schema["rowid"].dataType).alias("rowid"), F.lit(0.0).alias("rank"), F.lit(0).alias("position"))
    path = shared_folder(spark, f"many-{uuid.uuid4().hex}")
    hits.write.parquet(path)
    hits = spark.read.schema(schema).parquet(path)
    if size is None:
        found = hits.agg(F.count(F.lit(1)), F.sum("length")).first()
        size = found[0], found[1] or 0
    rows, total = size
    mean = (total / rows if rows else 1.0) or 1.0
    counts = dict(hits.select(F.explode("phrases").alias("phrase")).groupBy("phrase").count().collect())  # one row a phrase
    idf = np.array([max(log((rows - counts.get(p, 0) + 0.5) / (counts.get(p, 0) + 0.5)), 0.0) or LEAST_IDF for p in range(len(asked))])
    numbers = {p: i for i, p in enumerate(asked)}
    numbered = [_numbered(t, numbers) for t in trees.values()]
    no_of = {text: no for no, text in enumerate(trees)}
    found_schema = T.StructType([T.StructField("no", T.IntegerType()), schema["rowid"], T.StructField("rank", T.DoubleType())])

    def best(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches).combine_chunks()
        t = t.take(pc.sort_indices(t, sort_keys=[("rowid", "ascending")]))  # then a row's number is its place among equal ranks
        lists = t.column("phrases").combine_chunks()
        kind, f = lists.flatten().to_numpy(), t.column("fs").combine_chunks().flatten().to_numpy()
        row = np.repeat(np.arange(t.num_rows), np.diff(lists.offsets.to_numpy()))
        order = np.lexsort((row, kind))
        kind, f, row = kind[order], f[order], row[order]
        length = t.column("length").to_numpy()[row].astype("float64")
        part = idf[kind] * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))
        starts = np.searchsorted(kind, np.arange(len(asked) + 1))
        of = [(row[a:b], part[a:b]) for a, b in zip(starts, starts[1:])]
        out = []
        for no, tree in enumerate(numbered):
            own, ranks = ranks_of(tree, of)
            if len(own) > limit:
                near = ranks <= np.partition(ranks, limit - 1)[limit - 1]
                own, ranks = own[near], ranks[near]
            first = np.lexsort((own, ranks))[:limit]
            if len(first):
                out.append((np.full(len(first), no, dtype="int32"), own[first], ranks[first]))
        nos, own, ranks = map(np.concatenate, zip(*out)) if out else (np.zeros(0, "int32"), np.zeros(0, "int64"), np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(nos), t.column("rowid").combine_chunks().take(pa.array(own)), pa.array(ranks)], names=found_schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        many = 0
        for t in batches:
            held.append(t)
            many += len(t.column(t.schema.get_field_index("phrases")).flatten())
            if many > MOST_HITS:
                yield best(held)
                held, many = [], 0
        if held:
            yield best(held)

    @F.pandas_udf("int")
    def number(texts: pd.Series) -> pd.Series:
        return texts.map(no_of).astype("Int32")

    place = F.row_number().over(Window.partitionBy("no").orderBy("rank", "rowid"))
    top = hits.where(F.size("phrases") > 0).select("rowid", "length", "phrases", "fs").mapInArrow(run, found_schema).withColumn("position", place).where(F.col("position") <= limit)
    return queries.select("query_id", number("query").alias("no")).join(top, "no").select("query_id", "rowid", "rank", "position")


def _numbered(tree: object, numbers: dict[Phrase, int]) -> object:
    """The tree with numbers in place of its phrases."""
    return numbers[tree] if isinstance(tree, Phrase) else type(tree)(_numbered(tree.left, numbers), _numbered(tree.right, numbers))


def _places(rows: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sorted `own` each row would stand, and whether it does."""
    at = np.searchsorted(own, rows)
    if not len(own):
        return at, np.zeros(len(rows), dtype=bool)
    at[at == len(own)] = 0
    return at, own[at] == rows


def ranks_of(tree: object, of: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, ranks) of the rows that match a numbered tree; of[phrase] has the sorted rows of a phrase and its shares of their ranks."""

    def may(t: object) -> np.ndarray:
        """Rows among which all matches are."""
        if isinstance(t, int):
            return of[t][0]
        if isinstance(t, Not):
            return may(t.left)
        few, many = sorted((may(t.left), may(t.right)), key=len)
        return np.union1d(few, many) if isinstance(t, Or) else few[_places(few, many)[1]]

    rows = may(tree)
    if not len(rows):
        return rows, np.zeros(0)
    shares: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    matches: dict[int, np.ndarray] = {}

    def match(t: object) -> np.ndarray:
        if isinstance(t, int):
            if t not in shares:
                at, has = _places(rows, of[t][0])
                shares[t] = has, np.where(has, of[t][1][at], 0.0) if has.any() else np.zeros(len(rows))
            return shares[t][0]
        left, right = match(t.left), match(t.right)
        matches[id(t)] = left & right if isinstance(t, And) else left | right if isinstance(t, Or) else left & ~right
        return matches[id(t)]

    whole = match(tree)
    ranks = np.zeros(len(rows))

    def add(t: object, live: np.ndarray) -> None:
        """A phrase counts only where every AND and NOT above it matches; the right side of NOT never does."""
        nonlocal ranks
        if isinstance(t, int):
            ranks = ranks - np.where(live, shares[t][1], 0.0)
            return
        live = live if isinstance(t, Or) else live & matches[id(t)]
        add(t.left, live)
        if not isinstance(t, Not):
            add(t.right, live)

    add(tree, whole)
    return rows[whole], ranks[whole]

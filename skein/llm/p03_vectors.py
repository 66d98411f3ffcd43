"""The most similar vectors of every vector: multiprobe p-stable hashing, then exact distances."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import _spread
from skein.llm._cut import cut
from skein.llm._groups import block_keys, mix, runs, whole_groups
from skein.llm._spread import hot_keys, in_every_block, in_own_block

WIDTH = 2.0
#: Least probability, at any number of rows, that two vectors at the similarity bound visit a common bucket, and that they then meet inside it.
MEET, MEET_INSIDE = 0.985, 0.998
#: Comparisons that cost as much as one more visit of a bucket across the cluster, and as one inside a task.
VISIT, VISIT_INSIDE = 8000, 600
#: Rows of one bucket that one task compares; larger buckets are split into pairs of blocks.
BLOCK = 50_000
#: A vector travels to buckets as numbers of BITS bits; its cosines are then wrong by less than MARGIN (more than six deviations, whatever the vector).
BITS, MARGIN = 6, 0.03
#: Where a bucket has far more near pairs than the k best of each vector, so many times k by the packed numbers are ranked exactly.
KEPT = 4
#: Comparisons that a task holds at a time, and rows of buckets that it is given on average.
SLICE, TASK_ROWS = 2_000_000, 1_000_000
#: Tables up to this many rows are broadcast, larger ones are joined by shuffling.
MOST_BROADCAST = 100_000
_SEED = 20_231


def usable(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """Rows whose vector has `dims` finite numbers, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.coalesce((F.size(v) == dims) & finite & F.exists(v, lambda x: x != 0), F.lit(False)))


@lru_cache(maxsize=1024)
def perturbations(projections: int, probes: int) -> tuple[tuple[int, ...], ...]:
    """The most promising sets of boundary crossings, best first.

    Crossings are named by their place (from 1) when the 2K distances to the
    neighbouring cells are sorted. A set's score is its expected sum of squared
    distances; it never crosses both boundaries of one projection.
    """
    k, m = projections, 2 * projections
    z = [j * (j + 1) / (4 * (k + 1) * (k + 2)) if j <= k else 1 - (m + 1 - j) / (k + 1) + (m + 1 - j) * (m + 2 - j) / (4 * (k + 1) * (k + 2)) for j in range(1, m + 1)]
    sets = [
        (sum(z[j - 1] for j in s), s)
        for size in range(1, min(3, k) + 1)
        for s in itertools.combinations(range(1, min(m, probes + 2) + 1), size)
        if not any(m + 1 - j in s for j in s)
    ]
    return tuple(s for _, s in sorted(sets)[:probes])


@lru_cache(maxsize=1024)
def meeting(projections: int, probes: int, similarity: float, pairs: int = 4000) -> float:
    """The probability that two unit vectors of this cosine visit a common bucket of one table.

    Their projections are normal with the cosine as correlation, so `pairs` drawn pairs stand for vectors of any dimension.
    """
    rng = np.random.default_rng(_SEED)
    u, noise, b = rng.normal(size=(pairs, projections)), rng.normal(size=(pairs, projections)), rng.uniform(size=(pairs, projections))
    p, q = u / WIDTH + b, (similarity * u + math.sqrt(max(0.0, 1 - similarity**2)) * noise) / WIDTH + b
    salt = np.zeros(pairs, dtype=np.uint64)
    one, other = (list(visited(x, perturbations(projections, probes), 0, salt)) for x in (p, q))
    met = np.zeros(pairs, dtype=bool)
    for x in one:
        for y in other:
            met |= x == y
    return float(met.mean())


def visited(p: np.ndarray, sets: tuple[tuple[int, ...], ...], table: int, salt: np.ndarray) -> Iterator[np.ndarray]:
    """The bucket of each row of `p` (scaled projections) and its perturbed buckets, in order of estimated success."""
    cell = np.floor(p)
    rows, k = np.arange(len(p)), p.shape[1]

    def bucket(cells: np.ndarray) -> np.ndarray:
        h = mix(salt + np.uint64(table + 1))
        for j in range(k):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + cells[:, j].astype(np.int64).view(np.uint64))
        return h.view(np.int64)

    yield bucket(cell)
    if sets:
        order = np.argsort(np.concatenate([p - cell, 1 - (p - cell)], axis=1), axis=1)
        for s in sets:
            moved = cell.copy()
            for j in s:
                c = order[:, j - 1]
                moved[rows, c % k] += np.where(c < k, -1, 1)
            yield bucket(moved)


def tables_for(projections: int, probes: int, similarity: float, meet: float) -> float:
    """Tables after which two vectors of this cosine have met with probability `meet`; infinite where no drawn pair meets."""
    p = meeting(projections, probes, similarity)
    return math.inf if p == 0 else 1 if p >= meet else math.ceil(math.log(1 - meet) / math.log(1 - p))


#: The share of independent vectors that are in one cell of WIDTH.
SHARE = 0.4883


#: Rows of a bucket up to which all are compared.
COMPARED = 4096


@lru_cache(maxsize=16)
def layouts_inside(similarity: float) -> tuple[tuple[float, int, int, int], ...]:
    """(comparisons' worth of work for a row, projections, probes, tables) for buckets of up to 1, 2, 4, ... 2 * BLOCK rows, inside a task."""
    out = []
    for magnitude in range(_magnitude(2 * BLOCK) + 1):
        rows = 2.0**magnitude
        best = (rows / 2, 0, 0, 1)
        for k in range(4, magnitude - 3) if rows > COMPARED else ():
            for probes in range(3):
                tables = tables_for(k, probes, similarity, MEET_INSIDE)
                best = min(best, (tables * (probes + 1) * (VISIT_INSIDE + rows * (probes + 1) * SHARE**k / 2), k, probes, tables))
        out.append(best)
    return tuple(out)


def _magnitude(rows: float) -> int:
    return max(0, math.ceil(math.log2(max(rows, 1))))


def layout_for(rows: int, similarity: float) -> tuple[int, int, int]:
    """(projections, probes, tables) of least cost of those by which vectors of this cosine meet with probability MEET.

    `rows` are those of one space. More rows take more projections, or buckets grow, and with them more visits, or pairs are lost. No projection at
    all, everything in one bucket, is the choice for up to COMPARED rows and for bounds where hashing doesn't separate.
    """
    inside = layouts_inside(similarity)
    cost = lambda tables, probes, n: tables * (probes + 1) * (1 + n / BLOCK) * (1 + inside[min(_magnitude(n), len(inside) - 1)][0] / VISIT)
    best = (0.0 if rows <= COMPARED else cost(1, 0, rows) + rows / VISIT, 0, 0, 1)
    for k in range(2, math.ceil(math.log2(rows)) + 1) if rows > COMPARED else ():
        for probes in range(5):
            n = rows * (probes + 1) * SHARE**k
            if n > 1:
                tables = tables_for(k, probes, similarity, MEET)
                best = min(best, (cost(tables, probes, n), k, probes, tables))
    return best[1:]


class Hasher:
    """The p-stable tables of a layout, for unit vectors."""

    def __init__(self, dims: int, projections: int, probes: int, tables: int, seed: int = _SEED):
        rng = np.random.default_rng(seed)
        self.k, self.tables = projections, tables
        self.a = (rng.normal(size=(dims, tables * projections)) / WIDTH).astype(np.float32)
        self.b = rng.uniform(size=tables * projections).astype(np.float32)
        self.sets = perturbations(projections, probes)

    def buckets(self, x: np.ndarray, salt: np.ndarray) -> Iterator[np.ndarray]:
        """The visited buckets of all rows, one visit of all rows after the other."""
        p = x @ self.a + self.b
        for t in range(self.tables):
            yield from visited(p[:, t * self.k : (t + 1) * self.k], self.sets, t, salt)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation, after which no vector has most of its length in a few numbers."""
    return np.linalg.qr(np.random.default_rng(_SEED + 1).normal(size=(dims, dims)))[0].astype(np.float32)


def pack(x: np.ndarray) -> list[bytes]:
    """Unit vectors as BITS-bit numbers; their lengths are not kept."""
    half = (1 << (BITS - 1)) - 1
    q = (np.rint(x * (half / np.abs(x).max(axis=1, keepdims=True))) + half).astype(np.uint8)
    bits = np.unpackbits(q[:, :, None], axis=2)[:, :, 8 - BITS :]
    packed = np.packbits(bits.reshape(len(x), -1), axis=1)
    return [r.tobytes() for r in packed]


def unpack(packed: np.ndarray, dims: int) -> np.ndarray:
    half = (1 << (BITS - 1)) - 1
    raw = np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(len(packed), -1)
    bits = np.unpackbits(raw, axis=1)[:, : dims * BITS].reshape(len(packed), dims, BITS)
    padded = np.concatenate([np.zeros((len(packed), dims, 8 - BITS), dtype=np.uint8), bits], axis=2)
    x = np.packbits(padded, axis=2)[:, :, 0].astype(np.float32) - half
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pairs_of(x: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of pairs of rows with a cosine of at least `least`; where these are very many, those among the KEPT * `k` best of one of them."""
    n, many = len(x), KEPT * k
    step = max(1, SLICE // n)
    left, right, held = [], [], 0
    for at in range(0, n, step):
        i, j = np.nonzero(x[at : at + step] @ x[at:].T >= least)
        keep = j > i
        left.append(at + i[keep])
        right.append(at + j[keep])
        held += len(left[-1])
        if held > 2 * many * n:
            break
    else:
        return np.concatenate(left), np.concatenate(right)
    left, right = [], []
    for at in range(0, n, step):
        s = x[at : at + step] @ x.T
        own = np.arange(len(s))
        s[own, at + own] = -2.0
        best = np.partition(s, n - many, axis=1)[:, n - many]
        i, j = np.nonzero(s >= np.maximum(least, best)[:, None])
        left.append(at + i)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def near_pairs(x: np.ndarray, similarity: float, k: int, layouts: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of the near pairs of a bucket; many rows are hashed again, by tables of their own."""
    n, least = len(x), similarity - MARGIN
    _, projections, probes, tables = layouts[min(_magnitude(n), len(layouts) - 1)]
    if not projections:
        i, j = _pairs_of(x, least, k)
    else:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        hasher, salt = Hasher(x.shape[1], projections, probes, tables, _SEED + 2), np.zeros(n, dtype=np.uint64)
        visits = hasher.buckets(x, salt)
        for _ in range(tables):
            keys = np.concatenate([next(visits) for _ in range(probes + 1)])
            order = np.argsort(keys)
            for start, end in zip(*runs(keys[order])):
                rows = order[start:end] % n
                i, j = _pairs_of(x[rows], least, k)
                if len(i):
                    found.append((rows[i], rows[j]))
        i, j = (np.concatenate(f) for f in zip(*found))
    pair = np.unique(np.minimum(i, j) * n + np.maximum(i, j))
    i, j = pair // n, pair % n
    return i[i != j], j[i != j]


def candidate_pairs(df: DataFrame, min_similarity: float, projections: int, probes: int, tables: int, block: int, dims: int, k: int = 10) -> DataFrame:
    """Distinct (space, a, b), a < b, of df(space, id, vector): vectors that meet in a bucket and are near by their packed numbers.

    `space` is a 64-bit hash here; vectors of different spaces never meet.
    """
    kind = df.schema["id"].dataType.simpleString()
    layouts = layouts_inside(min_similarity)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(dims, projections, probes, tables)
        for t in batches:
            if len(t):
                found = np.concatenate(list(hasher.buckets(_unit(t["vector"]), t["space"].to_numpy().view(np.uint64))))
                bucket, n = np.unique(found, return_counts=True)
                yield pd.DataFrame({"bucket": bucket, "n": n})

    sizes = df.select("space", "vector").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    large = cut(sizes.where(F.col("n") > block).select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    many = large.count()
    known = dict(large.collect()) if many <= MOST_BROADCAST else None
    columns = f"bucket long, space long, id {kind}, block int, packed binary"

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for bucket, space, id_, packed, blocks in t.itertuples(index=False, name=None):
                own, keys = block_keys(bucket, id_, blocks)
                yield pd.DataFrame({"bucket": keys, "space": space, "id": id_, "block": np.int32(own), "packed": packed})

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, turn = Hasher(dims, projections, probes, tables), rotation(dims)
        hot = np.array(sorted(known or ()), dtype=np.int64)
        for t in batches:
            if not len(t):
                continue
            x, space, ids = _unit(t["vector"]), t["space"].to_numpy(), t["id"].to_numpy()
            packed = np.array(pack(x @ turn), dtype=object)
            for bucket in hasher.buckets(x, space.view(np.uint64)):
                rows, mine, key = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int32), bucket
                if len(hot) and (inside := np.isin(bucket, hot)).any():
                    pieces = [(rows[~inside], mine[~inside], bucket[~inside])]
                    for i in np.flatnonzero(inside):
                        own, keys = block_keys(bucket[i], ids[i], known[bucket[i]])
                        pieces.append((np.full(len(keys), i), np.full(len(keys), own, dtype=np.int32), keys))
                    rows, mine, key = (np.concatenate(p) for p in zip(*pieces))
                yield pd.DataFrame({"bucket": key, "space": space[rows], "id": ids[rows], "block": mine, "packed": packed[rows]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in whole_groups(batches, "bucket"):
            space, ids, mine, packed = (t[c].to_numpy() for c in ("space", "id", "block", "packed"))
            for start, end in zip(*runs(t["bucket"].to_numpy())):
                i, j = near_pairs(unpack(packed[start:end], dims), min_similarity, k, layouts)
                if not len(i):
                    continue
                i, j = start + i, start + j
                keep = ids[i] != ids[j]
                if mine[start:end].min() != mine[start:end].max():
                    keep &= mine[i] != mine[j]
                a, b = ids[i[keep]], ids[j[keep]]
                yield pd.DataFrame({"space": space[start], "a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    visits = df.mapInPandas(visit, columns)
    if known is None:
        rest = visits.join(large, "bucket", "left_anti")
        visits = rest.unionByName(visits.join(large, "bucket").select("bucket", "space", "id", "packed", "blocks").mapInPandas(split, columns))
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(default, df.count() * tables * (probes + 1) // TASK_ROWS)
    return visits.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInPandas(compare, f"space long, a {kind}, b {kind}").distinct()


def _folded(good: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors, copies, least): one row of each different vector, named by its least id; the ids of vectors that several ids have; their k + 1 least ids."""
    keyed = good.select("space", "id", F.xxhash64("vector").alias("h0"), F.xxhash64(F.lit(1), "vector").alias("h1"))
    key = ["space", "h0", "h1"]
    several = keyed.groupBy(*key).agg(F.min("id").alias("class"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("class") != F.col("last"))
    several = cut(several.drop("last"))
    joined = F.broadcast(several) if several.count() <= MOST_BROADCAST else several
    named = good.withColumns({"h0": F.xxhash64("vector"), "h1": F.xxhash64(F.lit(1), "vector")}).join(joined.drop("n"), key, "left")
    vectors = named.where(F.col("class").isNull() | (F.col("class") == F.col("id"))).select("space", "id", "vector")
    copies = cut(keyed.join(joined, key).select("space", "class", "id").distinct())
    place = F.row_number().over(Window.partitionBy("space", "class").orderBy("id"))  # each task keeps its own first k + 1 before the exchange
    least = copies.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    return vectors, copies, least


def similar_vectors(df: DataFrame, space: str, id_: str, vector: str, k: int = 10, min_similarity: float = 0.9, dims: int = 64) -> DataFrame:
    """(space, id, neighbour, similarity, rank): up to k most similar other vectors of the same space for each vector.

    Every vector is hashed by tables of p-stable projections and visits, beside
    its own bucket, the perturbed buckets that most probably hold near vectors,
    in order of estimated success. Vectors that visit a common bucket are
    compared there, in large buckets by further tables of the same kind inside
    the task; candidates of all tables are merged and ranked by exact cosine
    (doubles). Those of at least `min_similarity` are kept, ties by id.
    `layout_for` adds tables as the rows grow, so that pairs at
    `min_similarity` visit a common bucket with probability MEET at any size
    and are found inside it with MEET_INSIDE, nearer ones more often.

    What travels to the buckets is an id and a vector of BITS bits a number,
    rotated so that its error has one bound for all vectors; candidates are
    those within MARGIN of `min_similarity`. Vectors themselves are shuffled
    once, for the exact check.

    Equal vectors are folded first and take each other and the others'
    neighbours from their class, which keeps its k + 1 least ids. In a bucket
    with far more near pairs than that each vector keeps its KEPT * k best by the
    packed numbers (in a cone of 3,000 vectors at cosine 0.96: all of the ten nearest).
    Buckets beyond BLOCK rows are compared
    as pairs of blocks in many tasks, completely.

    Null, all-zero, non-finite and wrong-length vectors, null ids and null
    spaces are left out; a repeated row counts once; further columns are
    ignored; empty tables give an empty result.
    """
    named = usable(df.where(F.col(id_).isNotNull() & F.col(space).isNotNull()), vector, dims)
    good = named.select(F.xxhash64(space).alias("space"), F.col(id_).alias("id"), F.col(vector).alias("vector"), F.col(space).alias("name"))
    names = good.groupBy("space").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n"))
    rows, squares = names.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n").cast("double") ** 2), F.lit(0.0))).first()
    projections, probes, tables = layout_for(round(squares / max(rows, 1)), min_similarity)  # the rows that a vector's space has on average
    vectors, copies, least = _folded(good.drop("name"), k)
    pairs = candidate_pairs(vectors, min_similarity, projections, probes, tables, BLOCK, dims, k)
    left = pairs.join(vectors.withColumnsRenamed({"id": "a", "vector": "va"}), ["space", "a"])
    both = left.join(vectors.withColumnsRenamed({"id": "b", "vector": "vb"}), ["space", "b"])
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    cosine = dot("va", "vb") / F.sqrt(dot("va", "va") * dot("vb", "vb"))
    near = both.select("space", "a", "b", cosine.alias("similarity")).where(F.col("similarity") >= min_similarity).groupBy("space", "a", "b").agg(F.max("similarity").alias("similarity"))
    each = near.select("space", F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("class")), F.struct(F.col("b").alias("id"), F.col("a").alias("class")))).alias("x"), "similarity").select("space", "x.*", "similarity")
    # classes of a class, then their ids: each by its k + 1 least, of which one may be the vector itself
    spelt = each.join(least.withColumnRenamed("id", "copy"), ["space", "class"], "left").select("space", "id", F.coalesce("copy", "class").alias("neighbour"), "similarity")
    own = least.select("space", F.col("class").alias("id"), F.col("id").alias("neighbour"), F.lit(1.0).alias("similarity"))
    of_class = spelt.unionByName(own)
    rank = F.row_number().over(Window.partitionBy("space", "id").orderBy(F.desc("similarity"), "neighbour"))
    ordered = of_class.withColumn("rank", rank).where(F.col("rank") <= k + 1).withColumnRenamed("id", "class")
    lists = ordered.groupBy("space", "class").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "similarity"))).alias("best"))
    hot = cut(hot_keys(copies.groupBy("class").agg(F.count(F.lit(1)).alias("n")), "class"))
    members = in_own_block(copies, "class", hot, "id")
    asked = in_every_block(lists, "class", hot).join(members, ["space", "class", "_block"], "left").select("space", F.coalesce("id", "class").alias("id"), "best")
    kept = asked.select("space", "id", F.posexplode(F.slice(F.filter("best", lambda x: x["neighbour"] != F.col("id")), 1, k)).alias("place", "x"))
    result = kept.join(names.select("space", "name"), "space")
    return result.select(F.col("name").alias(space), F.col("id").alias(id_), F.col("x.neighbour").alias("neighbour"), F.col("x.similarity").alias("similarity"), (F.col("place") + 1).alias("rank"))


#: For searches without a similarity bound: tables of few projections, and the share of the rows whose cells of a table a query visits at least.
SEARCH_TABLES, SEARCH_PROJECTIONS, SEARCH_SHARE = 2, 4, 0.6


def search_vectors(df: DataFrame, queries: DataFrame, space: str, id_: str, vector: str, k: int = 10, dims: int = 64, share: float = SEARCH_SHARE, block: int = BLOCK, tables: int = SEARCH_TABLES) -> DataFrame:
    """(space, id, neighbour, similarity, rank): the `k` most similar other vectors of df for each vector of `queries`.

    `tables` tables of SEARCH_PROJECTIONS p-stable projections; their cells are
    few whatever the collection, and their sizes are counted. In each table a
    query visits cells in order of estimated success, by the distance from its
    projection to the cell, until they hold `share` of the rows. The best of
    each cell are found in floats, merged over tables and ranked by exact
    cosine in doubles. Where vectors have no structure (the ten nearest at
    cosine 0.5), a high recall needs a high share. Cells beyond `block` rows
    are split, and each block keeps its own `k` best.

    Unusable vectors, null ids and null spaces are left out; repeated rows
    count once; a query equal to a row by id is not its own neighbour.
    """
    pick = lambda x: usable(x.where(F.col(id_).isNotNull() & F.col(space).isNotNull()), vector, dims).select(F.col(space).alias("space"), F.col(id_).alias("id"), F.col(vector).alias("vector"))
    base, asked = pick(df), pick(queries)
    kind = base.schema["id"].dataType.simpleString()
    rng = np.random.default_rng(_SEED)
    a, b = rng.normal(size=(tables, dims, SEARCH_PROJECTIONS)).astype(np.float32) / WIDTH, rng.uniform(size=(tables, 1, SEARCH_PROJECTIONS))
    names = ["t", *(f"c{j}" for j in range(SEARCH_PROJECTIONS))]
    columns = ", ".join(f"{n} int" for n in names)

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            if len(t):
                x = _unit(t["vector"])
                for i in range(tables):
                    cell = np.floor(x @ a[i] + b[i]).astype(np.int32)
                    yield pd.DataFrame({"space": t["space"], "id": t["id"], "vector": t["vector"], "t": np.int32(i), **{n: cell[:, j] for j, n in enumerate(names[1:])}})

    cells = base.mapInPandas(home, f"space string, id {kind}, vector array<float>, {columns}")
    found = cells.groupBy("space", *names).agg(F.count(F.lit(1)).alias("n")).toPandas()  # some hundred cells a space: unit vectors project into a fixed range
    sized = {k: (t[names[1:]].to_numpy(), t["n"].to_numpy(), -(-t["n"].to_numpy() // block)) for k, t in found.groupby(["space", "t"])}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = {(*k, *c): n for k, (cs, _, blocks) in sized.items() for c, n in zip(map(tuple, cs.tolist()), blocks.tolist())}
        for t in home(batches):
            split = np.array([index[key] for key in zip(t["space"], *(t[n].tolist() for n in names))], dtype=np.uint64)
            own = mix(t["id"].to_numpy().astype(np.int64).view(np.uint64)) % split
            yield t.assign(block=own.astype(np.int32), query=False)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for (s, own), i in itertools.product(t.groupby("space"), range(tables)):
                if (s, i) not in sized:
                    continue
                where, n, blocks = sized[s, i]
                for at in range(0, len(own), 200):
                    part = own.iloc[at : at + 200]
                    p = _unit(part["vector"]) @ a[i] + b[i]
                    gap = np.maximum(0, np.maximum(where[None] - p[:, None], p[:, None] - where[None] - 1))
                    order = np.argsort((gap**2).sum(axis=2), axis=1)
                    before = np.cumsum(n[order], axis=1) - n[order]
                    row, place_ = np.nonzero(before < share * n.sum())
                    cell = order[row, place_]
                    times = blocks[cell]
                    row, cell = np.repeat(row, times), np.repeat(cell, times)
                    which = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    x = part.iloc[row]
                    yield pd.DataFrame({"space": x["space"], "id": x["id"], "vector": x["vector"], "t": np.int32(i), **{c: where[cell, j].astype(np.int32) for j, c in enumerate(names[1:])}, "block": which.astype(np.int32), "query": True})

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in whole_groups(batches, "key"):
            for _, g in t.groupby("key", sort=False):
                q, rows = g[g["query"]], g[~g["query"]].drop_duplicates("id")
                if not len(q) or not len(rows):
                    continue
                x, ids = _unit(rows["vector"]), rows["id"].to_numpy()
                whole = np.stack(rows["vector"].to_numpy()).astype(np.float64)
                length = np.linalg.norm(whole, axis=1)
                for at in range(0, len(q), 500):
                    part = q.iloc[at : at + 500]
                    s = _unit(part["vector"]) @ x.T
                    own = part["id"].to_numpy()[:, None] == ids[None]
                    s[own] = -2.0
                    wide = min(k + 4, s.shape[1])  # floats may swap neighbours in rank
                    top = np.argpartition(-s, wide - 1, axis=1)[:, :wide]
                    asked_ = np.stack(part["vector"].to_numpy()).astype(np.float64)
                    exact = np.einsum("qd,qwd->qw", asked_, whole[top]) / (np.linalg.norm(asked_, axis=1)[:, None] * length[top])
                    exact[np.take_along_axis(own, top, axis=1)] = -2.0
                    out = pd.DataFrame({"space": np.repeat(part["space"].to_numpy(), wide), "id": np.repeat(part["id"].to_numpy(), wide), "neighbour": ids[top].ravel(), "similarity": exact.ravel()})
                    yield out[exact.ravel() > -1.5]

    schema = f"space string, id {kind}, vector array<float>, {columns}, block int, query boolean"
    both = base.mapInPandas(place, schema).unionByName(asked.dropDuplicates(["space", "id"]).mapInPandas(visit, schema))
    keyed = both.withColumn("key", F.xxhash64("space", *names, "block"))
    near = keyed.repartition("key").sortWithinPartitions("key").mapInPandas(best, f"space string, id {kind}, neighbour {kind}, similarity double")
    merged = near.groupBy("space", "id", "neighbour").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("space", "id").orderBy(F.desc("similarity"), "neighbour"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("space").alias(space), F.col("id").alias(id_), "neighbour", "similarity", "rank")

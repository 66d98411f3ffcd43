"""Near-duplicate records with small edits: ProbMinHash signatures, banding, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm._groups import block_keys, mix, runs, whole_groups
from skein.llm import _spread
from skein.llm._spread import hot_keys, in_every_block, in_own_block
from skein.llm._cut import cut

#: Signature layout: bands of ROWS registers, at least BANDS, as many as a pair at the threshold needs to share one but for BAND_MISS.
BANDS, ROWS, BAND_MISS = 24, 4, 0.008
#: Of SKETCH registers one bit travels with each band; pairs that differ in more than MOST_DIFFERENT bits, and more than all but SKETCH_MISS of those at the threshold, are no candidates.
SKETCH, MOST_DIFFERENT, SKETCH_MISS = 64, 24, 0.002
#: Records of one band bucket that one task compares; larger buckets are split into pairs of blocks.
BLOCK = 20_000
#: Pairs of a bucket that a task holds at a time, and rows of buckets that it is given on average.
SLICE, TASK_ROWS = 1_000_000, 1_000_000
#: Records whose shingle sets a task of the verification is given on average, at most.
TASK_SETS = 50_000
#: Large buckets up to this number are broadcast, more are joined by shuffling.
MOST_BROADCAST = 100_000
#: Buckets are found to be large on one record in SAMPLE; this only spreads work and changes no result.
SAMPLE = 50
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def layout_for(threshold: float) -> tuple[int, int]:
    """(bands, differing sketch bits let pass): a pair at the threshold is lost with probability BAND_MISS + SKETCH_MISS at most."""
    bands = BANDS if threshold >= 1 else max(BANDS, math.ceil(math.log(BAND_MISS) / math.log(1 - threshold**ROWS)))
    differ, within = (1 - threshold) / 2, 0.0  # registers that disagree give different bits half the time
    for most in range(SKETCH + 1):
        within += math.comb(SKETCH, most) * differ**most * (1 - differ) ** (SKETCH - most)
        if within >= 1 - SKETCH_MISS:
            break
    return bands, max(MOST_DIFFERENT, most)


def prob_minhash(elements: np.ndarray, record: np.ndarray, records: int, registers: int, weights: np.ndarray | None = None) -> np.ndarray:
    """(records, registers) uint64 signatures; two records agree in a register with their probability Jaccard similarity.

    Each element of a record is a Poisson process of its weight as rate, drawn
    from the element alone; every arrival falls into a random register, which
    keeps the element of its first arrival. An element's process ends as soon
    as its next arrival is later than every register's first, so that an
    element costs a few arrivals. All records advance together. With equal
    weights the probability Jaccard is the Jaccard similarity of the element
    sets, and repeated elements change nothing.
    """
    first = np.full(records * registers, np.inf)
    holder = np.zeros(records * registers, dtype=np.uint64)
    e, r = elements.astype(np.uint64, copy=False), record
    rate = None if weights is None else 1.0 / weights
    time = np.zeros(len(e))
    state = mix(e + _GOLDEN)
    latest = np.full(records, np.inf)
    while len(e):
        gap = -np.log1p(-(state >> np.uint64(11)).astype(np.float64) * (1.0 / (1 << 53)))
        time = time + (gap if rate is None else gap * rate)
        alive = time < latest[r]
        if not alive.all():
            e, r, time, state = e[alive], r[alive], time[alive], state[alive]
            rate = None if rate is None else rate[alive]
            if not len(e):
                break
        draw = mix(state ^ np.uint64(0xD1B54A32D192ED03))
        place = r * registers + ((draw >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(first, place, time)
        won = first[place] == time
        holder[place[won]] = e[won]
        latest = first.reshape(records, registers).max(axis=1)
        state = mix(state + _GOLDEN)
    return holder.reshape(records, registers)


def word_hashes(text: Column) -> Column:
    """The hashes of the words (longest runs of letters and digits, lower case) of a text, in order."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


def shingle_set(words: Column, size: int) -> Column:
    """The distinct hashes of `size` consecutive words."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size))))


def _signatures(size: int, count: int):
    registers = max(SKETCH, count * ROWS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["words"].str.len().to_numpy().astype(np.int64)
            # Stretches of about a million words, so that long texts take no more memory than short ones.
            part = np.cumsum(sizes) // 1_000_000 * 1_000_000 + np.arange(len(batch)) // 1000
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(batch)]
            for at, end in zip(cuts, cuts[1:]):
                if at == end:
                    continue
                t, n = batch.iloc[at:end], sizes[at:end]
                w = np.concatenate(t["words"].to_numpy()).view(np.uint64)
                record = np.repeat(np.arange(len(t)), n)
                h = np.zeros(len(w) - size + 1, dtype=np.uint64)
                for j in range(size):
                    h = mix(h * _GOLDEN + w[j : len(w) - size + 1 + j])
                whole = record[: len(h)] == record[size - 1 :]
                signature = prob_minhash(h[whole], record[: len(h)][whole], len(t), registers)
                bands = np.zeros((len(t), count), dtype=np.uint64) + np.arange(1, count + 1, dtype=np.uint64)
                for j in range(ROWS):
                    bands = mix(bands * _GOLDEN + signature[:, j : count * ROWS : ROWS])
                bits = (mix(signature[:, :SKETCH]) & np.uint64(1)).astype(np.uint8)
                sketch = np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.int64)[:, 0]
                starts = np.concatenate([[0], np.cumsum(n)[:-1]])
                step = np.arange(len(w), dtype=np.uint64) - np.repeat(starts, n).astype(np.uint64)
                text = np.add.reduceat(mix(w + mix(step + np.uint64(1))), starts)
                other = np.add.reduceat(mix(w ^ mix(step + np.uint64(1 << 40))), starts)
                yield pd.DataFrame({"id": t["id"], "t0": text.view(np.int64), "t1": other.view(np.int64), "bands": list(bands.view(np.int64)), "sketch": sketch})

    return run


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Copies of the rows of large buckets, one for each pair of blocks they take part in."""
    for t in batches:
        for band, id_, sketch, blocks in t.itertuples(index=False):
            own, keys = block_keys(band, id_, blocks)
            yield pd.DataFrame({"band": keys, "id": id_, "block": np.int32(own), "sketch": sketch})


def _candidates(most: int):
    """The pairs of records of each band bucket whose sketches differ in at most `most` bits, a slice of a bucket at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in whole_groups(batches, "band"):
            ids, block, sketch = t["id"].to_numpy(), t["block"].to_numpy(), t["sketch"].to_numpy().view(np.uint64)

            def frame(i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
                a, b = ids[i], ids[j]
                return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).query("a != b").drop_duplicates()

            starts, ends = runs(t["band"].to_numpy())
            two = ends - starts == 2
            i = starts[two]
            near = np.bitwise_count(sketch[i] ^ sketch[i + 1]) <= most
            left, right, held = [i[near]], [i[near] + 1], int(near.sum())
            for start, end in zip(starts[~two], ends[~two]):
                step = max(1, SLICE // (end - start))
                for at in range(start, end, step):
                    x = np.arange(at, min(at + step, end))
                    i, j = np.nonzero(np.bitwise_count(sketch[x][:, None] ^ sketch[None, start:end]) <= most)
                    i, j = x[i], start + j
                    keep = i < j
                    if block[start:end].any():
                        keep &= (block[i] != block[j]) | (block[start:end].min() == block[start:end].max())
                    left.append(i[keep])
                    right.append(j[keep])
                    held += int(keep.sum())
                    if held >= SLICE:
                        yield frame(np.concatenate(left), np.concatenate(right))
                        left, right, held = [], [], 0
            if held:
                yield frame(np.concatenate(left), np.concatenate(right))

    return run


def near_duplicates(df: DataFrame, id_: str, text: Column, threshold: float = 0.6, size: int = 3, least_words: int = 20) -> tuple[DataFrame, DataFrame]:
    """(links, members) of the records of `df`.

    members(id, class): records with the same words in the same order share a
    class, named by its least id. links(a, b, similarity), a < b: the classes
    whose sets of `size` consecutive words have a Jaccard similarity of at
    least `threshold`, verified exactly on 64-bit shingle hashes.

    Null texts and texts under `least_words` words are in no class. Repeated
    ids count once. Further columns are ignored; empty tables give empty
    results. Copies are folded before banding, so that a text that fills a
    third of the table is one record; a bucket of very many different records
    is compared as pairs of blocks in many tasks, completely. Only records with
    a candidate are read again for the verification.
    """
    if threshold < 0.5:
        raise ValueError("the signature layout is made for thresholds of at least 0.5")
    bands, most = layout_for(threshold)
    kind = df.schema[id_].dataType.simpleString()
    rows = df.where(F.col(id_).isNotNull()).select(F.col(id_).alias("id"), word_hashes(text).alias("words")).where(F.size("words") >= max(least_words, size))
    signed = cut(rows.mapInPandas(_signatures(size, bands), f"id {kind}, t0 long, t1 long, bands array<long>, sketch long"))
    texts = signed.groupBy("t0", "t1").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n"))
    frequent = F.broadcast(texts.where(F.col("n") > _spread.HOT).drop("n"))  # at most rows / HOT
    keyed = signed.select("id", "t0", "t1")
    rare = keyed.join(frequent, ["t0", "t1"], "left_anti").join(texts, ["t0", "t1"]).select("id", "class")
    members = cut(rare.unionByName(keyed.join(frequent, ["t0", "t1"]).select("id", "class")).distinct())
    one_each = signed.groupBy("t0", "t1").agg(F.min("id").alias("id"), F.min_by("bands", "id").alias("bands"), F.min_by("sketch", "id").alias("sketch"))
    sampled = signed.where(F.pmod(F.xxhash64("t0", "t1"), F.lit(SAMPLE)) == 0).dropDuplicates(["t0", "t1"]).select(F.explode("bands").alias("band"))
    sizes = sampled.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK // SAMPLE // 2)
    large = cut(sizes.select("band", F.ceil(F.col("n") * SAMPLE / BLOCK).cast("int").alias("blocks")))
    many = large.count()
    banded = one_each.select(F.explode("bands").alias("band"), "id", F.lit(0).alias("block"), "sketch")
    if many:
        large = F.broadcast(large) if many <= MOST_BROADCAST else large
        whole = banded.join(large, "band", "left_anti")
        split = banded.join(large, "band").select("band", "id", "sketch", "blocks").mapInPandas(_split, banded.schema)
        banded = whole.unionByName(split)
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    records = signed.count()
    buckets = banded.repartition(max(default, bands * records // TASK_ROWS), "band").sortWithinPartitions("band")
    pairs = cut(buckets.mapInPandas(_candidates(most), f"a {kind}, b {kind}").distinct())
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = rows.join(wanted, "id", "left_semi").dropDuplicates(["id"]).select("id", shingle_set(F.col("words"), size).alias("set")).repartition(max(default, records // TASK_SETS), "id")
    both = pairs.join(sets.withColumnsRenamed({"id": "a", "set": "sa"}), "a").join(sets.withColumnsRenamed({"id": "b", "set": "sb"}), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    links = both.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("similarity")).where(F.col("similarity") >= threshold)
    return links, members


def all_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), a < b: the linked records, copies spelled out.

    That is quadratic in the copies of a text, as its columns demand; classes
    of more than HOT records are joined in blocks.
    """
    hot = cut(hot_keys(members.groupBy("class").agg(F.count(F.lit(1)).alias("n")), "class"))
    hot_a, hot_b = hot.withColumnRenamed("class", "a"), hot.withColumnRenamed("class", "b")
    m = in_own_block(members.select(F.col("class").alias("a"), F.col("id").alias("x")), "a", hot_a, "x")
    n = in_own_block(members.select(F.col("class").alias("b"), F.col("id").alias("y")), "b", hot_b, "y")
    half = in_every_block(links.select("a", "b"), "a", hot_a).join(m, ["a", "_block"]).select("b", "x")
    across = in_every_block(half, "b", hot_b).join(n, ["b", "_block"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    p, q = in_own_block(members, "class", hot, "id").alias("p"), in_every_block(members, "class", hot).alias("q")
    within = p.join(q, (F.col("p.class") == F.col("q.class")) & (F.col("p._block") == F.col("q._block")) & (F.col("p.id") < F.col("q.id"))).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))
    return across.unionByName(within)


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, group, links): each record's connected group, named by its least class, and its class's number of links.

    Classes take the least label among their neighbours' and then the label of
    that label (pointer jumping), until none changes; each round is one
    aggregation whose result is written to the shared folder.
    """
    edges = cut(links.select("a", "b").union(links.select("b", "a")))
    degree = edges.groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    label = degree.select(F.col("a").alias("class"), F.col("a").alias("group"))
    while True:
        near = edges.join(label, edges.b == label["class"]).groupBy("a").agg(F.min("group").alias("near"))
        step = label.join(near, label["class"] == near.a).select("class", F.least("group", "near").alias("group"), F.col("group").alias("old"))
        jump = step.select(F.col("class").alias("group"), F.col("group").alias("further"))
        new = cut(step.join(jump, "group").select("class", F.least("group", "further").alias("group"), "old"))
        changed = new.where(F.col("group") != F.col("old")).limit(1).count()
        label = new.select("class", "group")
        if not changed:
            break
    return members.join(label, "class", "left").join(degree.withColumnRenamed("a", "class"), "class", "left").select("id", F.coalesce("group", "class").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))

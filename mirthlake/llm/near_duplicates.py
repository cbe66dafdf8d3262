"""Near-duplicate records by SetSketch registers.

Register i of a set of words is the greatest of floor(1 - log_b(h)) over its words, h being the word's i-th
exponential hash value: a minimum on an exponential scale, truncated to one byte. Registers of a union are the
greater of each pair, and two sets agree in a register with a chance close to their likeness. ROWS registers make a
band; sets that agree in a whole band are candidates. With 144 bands of 6, a pair of likeness 0.6 is missed with a
chance of 0.1 %, one of 0.7 with 1 in 10^8. Bands are taken in
rounds; each makes the registers it needs from the words, so that sketches are never kept, and leaves its candidates.

Equal word sets are one class while candidates are sought. A candidate must also pass filters that lose nothing: the
sizes, and of two divisions of words into 64 classes the parities, which may differ in at most as many places as the
sets differ in words. What is left is verified on the words. estimate() gives the likeness by maximum likelihood from
how many registers are equal, greater and smaller, where sketches are all there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .graph import components, settled
from .text import as_word_sets, lists_of

BASE, RATE, BANDS, ROWS = 1.2, 20.0, 144, 6
REGISTERS = BANDS * ROWS
#: Rounds of bands, at most.
ROUNDS = 8


def registers(ws: np.ndarray, low: int = 0, high: int = REGISTERS) -> np.ndarray:
    """Registers low to high of sets of one word: a row a word."""
    out = np.empty((len(ws), high - low), np.uint8)
    for at in range(0, len(ws), 8192):
        with np.errstate(over="ignore"):
            x = ws[at : at + 8192].view(np.uint64)[:, None] + np.arange(low + 1, high + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        u = ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
        out[at : at + 8192] = np.clip(np.floor(1 - np.log(-np.log(u) / RATE) / np.log(BASE)), 0, 255)
    return out


def word_registers(h: int) -> np.ndarray:
    """The registers of a set of one word."""
    return registers(np.array([h & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]


def sketches(sets: list[np.ndarray], low: int = 0, high: int = REGISTERS, most: int = 1 << 16) -> np.ndarray:
    """Registers low to high of word sets, none empty: a row a set. Words are taken most at a time, however long a set is."""
    out = np.zeros((len(sets), high - low), np.uint8)
    starts = np.r_[0, np.cumsum([len(w) for w in sets])]
    values = np.concatenate(sets) if len(sets) else np.empty(0, np.int64)
    for at in range(0, len(values), most):
        known, place = np.unique(values[at : at + most], return_inverse=True)
        first, last = np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, min(at + most, len(values)), "left")
        top = np.maximum.reduceat(registers(known, low, high)[place], np.maximum(starts[first:last] - at, 0), axis=0)
        out[first:last] = np.maximum(out[first:last], top)
    return out


class Sketcher:
    """All registers of a word set."""

    def __call__(self, ws: np.ndarray) -> np.ndarray:
        return sketches([ws])[0]


def estimate(more: np.ndarray, less: np.ndarray, m: np.ndarray, n: np.ndarray, total: int = REGISTERS) -> np.ndarray:
    """Maximum-likelihood likeness of sets of m and n words; more, less: registers in which the first is greater, smaller."""
    u, v = m / (m + n), n / (m + n)
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)[:, None]

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    a, b = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    tiny = 1e-12
    score = more[:, None] * np.log(a + tiny) + less[:, None] * np.log(b + tiny) + (total - more - less)[:, None] * np.log(np.maximum(1 - a - b, 0) + tiny)
    return grid[np.arange(len(m)), score.argmax(axis=1)]


def pairs_of_keys(batches: Iterator[pa.RecordBatch], num: int, den: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(a, b), a < b, of rows (key, cid, n, bits, more) sorted by key: those of one key whose sizes and parities allow the likeness."""
    names = ["key", "cid", "n", "bits", "more"]

    def found(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, cid, n = columns[:3]
        bits, more = [x.view(np.uint64) for x in columns[3:]]
        for low in range(0, len(key), most):
            at, step = np.arange(low, min(low + most, len(key))), 0
            while len(at):
                step += 1
                at = at[at + step < len(key)]
                at = at[key[at] == key[at + step]]
                to = at + step
                m = n[at].astype(np.int64) + n[to]
                apart = m - 2 * -(-num * m // (num + den))
                good = (np.abs(n[at] - n[to]) <= apart) & (cid[at] != cid[to])
                good &= (np.bitwise_count(bits[at] ^ bits[to]) <= apart) & (np.bitwise_count(more[at] ^ more[to]) <= apart)
                if good.any():
                    x, y = cid[at[good]], cid[to[good]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append([b.column(c).to_numpy() for c in names])
        # whole keys go on; the last one may continue in the next batch
        if sum(len(h[0]) for h in held) >= 100_000 and held[-1][0][0] != held[-1][0][-1]:
            own = [np.concatenate(x) for x in zip(*held)]
            end = int(np.searchsorted(own[0], own[0][-1]))
            yield from found([x[:end] for x in own])
            held = [[x[end:] for x in own]]
    if held:
        yield from found([np.concatenate(x) for x in zip(*held)])


def similar_classes(classes: DataFrame, threshold: tuple[int, int], rounds: int | None = None) -> DataFrame:
    """(a, b), a < b: ids of classes (cid, ws) whose likeness is the threshold or more.

    Bands are taken in rounds, each with its registers only, so that no more than a part of the keys is on disk at once.
    Nothing here may be broadcast: what Spark knows of the sizes of word sets is the size of compressed files.
    """
    num, den = threshold
    if rounds is None:
        rounds = min(ROUNDS, 1 + classes.count() // 25_000)
    bounds = [BANDS * i // rounds for i in range(rounds + 1)]

    def bands(first: int, last: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            power = np.int64(256) ** np.arange(ROWS, dtype=np.int64)
            tops = np.arange(first, last, dtype=np.int64) << np.int64(8 * ROWS)
            one = np.uint64(1)
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    ws = lists_of(part.column("ws"))
                    r = sketches(ws, first * ROWS, last * ROWS).reshape(-1, last - first, ROWS).astype(np.int64)
                    starts = np.r_[0, np.cumsum([len(w) for w in ws])[:-1]]
                    words = np.concatenate(ws).view(np.uint64)
                    bits, more = [np.bitwise_xor.reduceat(one << (words >> np.uint64(s) & np.uint64(63)), starts).view(np.int64) for s in (58, 52)]
                    take = np.repeat(np.arange(len(ws)), last - first)
                    n = np.array([len(w) for w in ws], np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(((r * power).sum(axis=2) + tops).ravel()), part.column("cid").take(pa.array(take)), pa.array(n[take]), pa.array(bits[take]), pa.array(more[take])], names=["key", "cid", "n", "bits", "more"])

        return run

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pairs_of_keys(batches, num, den)

    cand = None
    for first, last in zip(bounds, bounds[1:]):
        keys = classes.select("cid", "ws").mapInArrow(bands(first, last), "key bigint, cid bigint, n int, bits bigint, more bigint")
        some = settled(keys.repartition("key").sortWithinPartitions("key").mapInArrow(pairs, "a bigint, b bigint").distinct())
        cand = some if cand is None else cand.unionAll(some)
    w = classes.select("cid", "ws")
    both = cand.distinct().join(w.toDF("a", "wa").hint("merge"), "a").join(w.toDF("b", "wb").hint("merge"), "b")
    same = F.size(F.array_intersect("wa", "wb"))
    return both.where(den * same >= num * (F.size("wa") + F.size("wb") - same)).select("a", "b")


def _sets(df: DataFrame, key: str, texts: list[str]) -> tuple[DataFrame, DataFrame]:
    joined = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.concat_ws(" ", *[F.coalesce(F.col(t), F.lit("")) for t in texts]).alias("text")).distinct()
    sets = as_word_sets(joined, "text", ["id"]).persist(StorageLevel.DISK_ONLY)
    return sets, sets.groupBy("cid").agg(F.first("ws").alias("ws")).persist(StorageLevel.DISK_ONLY)


def near_duplicate_pairs(df: DataFrame, key: str, texts: list[str], threshold: tuple[int, int] = (3, 5)) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of different keys whose joined texts have the likeness or more.

    Null texts count as empty; rows without any word are like no other, and rows with a null key are left out;
    repeated rows count once. Texts of any length are taken whole. An empty table gives no pairs.
    """
    sets, classes = _sets(df, key, texts)
    found = similar_classes(classes, threshold)
    links = found.unionAll(classes.select(F.col("cid"), F.col("cid")))
    members = sets.select("cid", "id").distinct()
    pairs = links.join(members.toDF("a", "x").hint("merge"), "a").join(members.toDF("b", "y").hint("merge"), "b").where("x <> y")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_duplicate_groups(df: DataFrame, key: str, texts: list[str], threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """(id, group_id, n_copies, n_links): one row a record. group_id is the smallest id of all records that are linked.

    n_copies: records with the same words, itself included; n_links: linked classes with other words. Records without
    any word, and those linked to none, are groups of their own.
    """
    sets, classes = _sets(df, key, texts)
    found = similar_classes(classes, threshold).persist(StorageLevel.DISK_ONLY)
    roots = components(found, "a", "b")
    links = found.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("n_links"))
    members = sets.select("cid", "id").distinct()
    per = members.groupBy("cid").agg(F.min("id").alias("first"), F.count("*").alias("n_copies"))
    per = per.join(roots.withColumnRenamed("node", "cid").hint("merge"), "cid", "left").join(links.hint("merge"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    names = per.groupBy("root").agg(F.min("first").alias("group_id"))
    per = per.join(names.hint("merge"), "root").select("cid", "group_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = members.join(per.hint("merge"), "cid").select("id", "group_id", "n_copies", "n_links")
    alone = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id")).distinct().join(members.select("id"), "id", "left_anti")
    return out.unionByName(alone.select("id", F.col("id").alias("group_id"), F.lit(1).cast("bigint").alias("n_copies"), F.lit(0).cast("bigint").alias("n_links")))

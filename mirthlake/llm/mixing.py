"""Mixing sources to target weights.

Each source's documents stand one after another in an order drawn by hash, and their tokens are cut into blocks of
BLOCK tokens; a block is known by its index alone. A mix is as large as its scarcest source allows: the most blocks
for which every source can give its share with each block used max_repeats times at most. Its slots are spread over
output shards: a tree over the shards halves them again and again, and each half draws how many of its slots each
source fills from the multinomial distribution, held to the sources' totals, so shares are met exactly and not only on
average. A draw depends on the seed and the node alone: every task draws for its own shards. Slot j of a source stands for
block perm(j mod B) of its pass j div B, perm being a pseudorandom permutation of the B block indexes (a Feistel
network, computed from the index, never stored) of its own for each pass. Slots and documents meet in a join on the
block index; there is no list of blocks on the driver, and no source's documents come together in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

BLOCK = 64
#: Blocks of an output shard.
SHARD = 4096
#: Ranges of hash order in which documents of a source are summed up, for offsets without one task per source.
RANGES = 4096


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Places of the indexes 0..size-1 under a pseudorandom permutation: a Feistel network, walked until in range."""
    if size <= 1:
        return index.copy()
    half = max(1, (int(size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x, todo = index.astype(np.uint64), np.ones(len(index), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            a, b = x[todo] >> np.uint64(half), x[todo] & mask
            for r in range(6):
                f = (b + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
                f ^= f >> np.uint64(29)
                f = f * np.uint64(0x94D049BB133111EB)
                a, b = b, a ^ ((f >> np.uint64(31)) & mask)
            x[todo] = (a << np.uint64(half)) | b
            todo = x >= np.uint64(size)
    return x.astype(np.int64)


def plan(blocks: dict[str, int], targets: list[tuple[str, float, int]]) -> dict[str, int]:
    """Slots of each source of a mix: the largest mix that the sources allow, rounded so that no cap is passed."""
    shares = [(s, w, c) for s, w, c in targets if w and w > 0]
    if not shares or any(not blocks.get(s) or c < 1 for s, _, c in shares):
        return {}
    whole = sum(w for _, w, _ in shares)
    most = min(blocks[s] * c / (w / whole) for s, w, c in shares)
    return {s: min(blocks[s] * c, floor(most * w / whole + 1e-9)) for s, w, c in shares}


def drawn(left: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Multinomial counts of size slots over sources that have left slots each, none more than it has."""
    out = np.zeros_like(left)
    while size:
        free = left - out
        out += (n := np.minimum(rng.multinomial(size, free / free.sum()), free))
        size -= int(n.sum())
    return out


def shard_runs(slots: np.ndarray, shard: int, seed: int, begin: int, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first slot, slots) of each source for the output shards begin..end-1 of shard slots, the last one of fewer."""
    total = int(slots.sum())
    todo = [(0, -(-total // shard), slots, np.zeros_like(slots))]
    while todo:
        a, b, own, first = todo.pop()
        if b <= begin or a >= end:
            continue
        if b - a == 1:
            yield a, first, own
            continue
        mid = (a + b) // 2
        half = drawn(own, (mid - a) * shard, np.random.default_rng([seed, a, b]))
        todo += [(mid, b, own - half, first + half), (a, mid, half, first)]


def shard_counts(slots: dict[str, int], shard: int, seed: int) -> np.ndarray:
    """Slots of each source in each output shard."""
    total = np.array(list(slots.values()), np.int64)
    return np.array([n for _, _, n in shard_runs(total, shard, seed, 0, -(-int(total.sum()) // shard))], np.int64).reshape(-1, len(slots))


def mix_sources(sizes: DataFrame, targets: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 7) -> DataFrame:
    """(mix_name, source, doc_id, pass, shard, start, end, n_tokens): the parts of documents that make up each mix.

    sizes: doc_id, source, n_tokens; targets: mix_name, source, target_share, max_repeats. A row is a stretch of a
    document's tokens in one pass over its source; no token of a document comes in more passes than max_repeats.
    Documents without tokens or source take no part. A mix one of whose sources has no tokens can't meet its shares
    and is empty. Shares are taken relative to their sum. Repeated doc_ids are one document.
    """
    spark = sizes.sparkSession
    mixes: dict[str, list] = {}
    for r in targets.where("mix_name is not null and source is not null").orderBy("mix_name", "source").collect():
        mixes.setdefault(r["mix_name"], []).append((r["source"], r["target_share"], r["max_repeats"] or 0))
    asked = sorted({s for rows in mixes.values() for s, _, _ in rows})
    docs = sizes.where("doc_id is not null and n_tokens > 0").where(F.col("source").isin(asked)).groupBy("doc_id").agg(F.min("source").alias("source"), F.min("n_tokens").alias("n_tokens"))
    docs = docs.withColumn("h", F.xxhash64("doc_id")).withColumn("range", F.pmod(F.shiftrightunsigned("h", 52), F.lit(RANGES)).cast("int")).persist(StorageLevel.DISK_ONLY)
    sums = docs.groupBy("source", "range").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("source", "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.join(starts, ["source", "range"]).withColumn("at", F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    placed = placed.select("source", "doc_id", "n_tokens", "at").persist(StorageLevel.DISK_ONLY)
    totals = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    # a last, shorter block would use its tokens as often as the others, so whole blocks only; a source of less than one block is one block
    blocks = {s: max(1, n // block) for s, n in totals.items()}
    plans = [(name, plan(blocks, rows)) for name, rows in mixes.items()]
    plans = [(name, list(slots), np.array(list(slots.values()), np.int64)) for name, slots in plans if slots and sum(slots.values())]
    # one row a mix and output shard
    parts = spark.range(0).select(F.lit(0).alias("mix"), F.col("id").alias("shard"))
    for m, (_, _, slots_of) in enumerate(plans):
        n = -(-int(slots_of.sum()) // shard)
        parts = parts.unionAll(spark.range(0, n, 1, max(1, min(2000, n // 16))).select(F.lit(m), "id"))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in batches:
            m, shards = b.column("mix").to_numpy(), b.column("shard").to_numpy()
            for mix in np.unique(m):
                name, sources, total = plans[mix]
                own = shards[m == mix]
                for i, first, n in shard_runs(total, shard, seed + int(mix), int(own.min()), int(own.max()) + 1):
                    for source, begin, count in zip(sources, first.tolist(), n.tolist()):
                        if not count:
                            continue
                        j = np.arange(begin, begin + count)
                        rounds, at = j // blocks[source], j % blocks[source]
                        place = np.empty(count, np.int64)
                        for e in np.unique(rounds):
                            place[rounds == e] = permuted(at[rounds == e], blocks[source], zlib.crc32(f"{seed}|{name}|{source}|{e}".encode()))
                        yield pa.RecordBatch.from_arrays([pa.array([name] * count), pa.array([source] * count), pa.array(place), pa.array(rounds.astype(np.int32)), pa.array(np.full(count, i, np.int32))], names=["mix_name", "source", "block", "pass", "shard"])

    wanted = parts.mapInArrow(slots, "mix_name string, source string, block bigint, pass int, shard int")
    last = (F.col("at") + F.col("n_tokens") - 1) / F.lit(block)
    cut = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / F.lit(block)), F.floor(last))))
    both = wanted.join(cut, ["source", "block"])
    begin, end = F.greatest(F.col("block") * block, F.col("at")) - F.col("at"), F.least((F.col("block") + 1) * block, F.col("at") + F.col("n_tokens")) - F.col("at")
    return both.select("mix_name", "source", "doc_id", "pass", "shard", begin.alias("start"), end.alias("end"), (end - begin).alias("n_tokens"))


def shares_reached(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, n_tokens, share, n_documents, most_repeats)."""
    per = mix.groupBy("mix_name", "source", "doc_id", "start", "end").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("times"))
    per = per.groupBy("mix_name", "source", "doc_id").agg(F.sum("n").alias("n"), F.max("times").alias("times"))
    per = per.groupBy("mix_name", "source").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_documents"), F.max("times").alias("most_repeats"))
    whole = per.groupBy("mix_name").agg(F.sum("n_tokens").alias("all"))
    found = per.join(whole, "mix_name").withColumn("share", F.col("n_tokens") / F.col("all")).drop("all")
    zero = F.lit(0).cast("bigint")
    return targets.join(found, ["mix_name", "source"], "left").select("mix_name", "source", "target_share", "max_repeats", F.coalesce("n_tokens", zero).alias("n_tokens"), F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("n_documents", zero).alias("n_documents"), F.coalesce("most_repeats", zero).alias("most_repeats"))

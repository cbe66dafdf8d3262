"""Filling containers of fixed capacity by sum-of-squares online packing.

A shard's documents come one after another. levels[f] is the number of open containers filled to f; a document of
size s goes into the level (a new container counts as level 0) for which the sum of squared counts of the partially
filled levels is then least, ties to the fullest. A full container leaves the array. One step looks at the capacity's
levels at most, in one vector operation.

Documents larger than the capacity are cut into whole containers and a rest, which is packed like a document; no other
document is ever split. Shards are formed by a hash of the id and hold about SHARD tokens each, so a shard never grows
with the collection. Containers that shards leave open come together in another round: their documents are packed
again in the same way, in shards of the same size, until one shard is left or a round closes less than a tenth of what
it was given: then sizes don't go together (all above half the capacity, say), and no order would fill more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

#: Tokens of a shard.
SHARD = 4_000_000


class Packer:
    """Sum-of-squares packing of items of 1..capacity."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.counts = capacity, np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.content: list[list[int]] = []

    def add(self, item: int, size: int) -> int:
        """The container's number."""
        n, c = self.counts, self.capacity
        last = c - size
        # moving a container from f to f+size changes the squares by 1-2n[f] and 1+2n[f+size]; level 0 and c count nothing
        cost = np.empty(last + 1, np.int64)
        cost[0] = 0
        cost[1:] = 1 - 2 * n[1 : last + 1]
        cost[n[: last + 1] == 0] = np.iinfo(np.int64).max // 2
        cost[0] = 0
        cost[:last] += 1 + 2 * n[size : size + last]
        best = last - int(np.argmin(cost[::-1]))
        if best:
            bin_ = self.open[best].pop()
            n[best] -= 1
        else:
            bin_ = len(self.content)
            self.content.append([])
        self.content[bin_].append(item)
        if best + size < c:
            self.open[best + size].append(bin_)
            n[best + size] += 1
        return bin_


def pack(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Indexes of the items in each container, in the order given. All sizes are 1..capacity."""
    p = Packer(capacity)
    for i, s in enumerate(sizes.tolist()):
        p.add(i, s)
    return p.content


def pack_documents(sizes: DataFrame, containers: DataFrame, shard: int = SHARD) -> DataFrame:
    """(container, capacity_tokens, container_id, doc_ids, parts, n_tokens, unused_tokens): one row a filled container.

    sizes: doc_id BIGINT, n_tokens BIGINT; containers: container STRING, capacity_tokens INT. parts holds each
    document's share in this container as first and last token. Documents without tokens (null and empty texts) need
    no room and come in no container; null ids, null or non-positive sizes and capacities likewise. Repeated doc_ids
    are one document. Empty tables give no containers. Any number of documents may be equally long.
    """
    docs = sizes.where("doc_id is not null and n_tokens > 0").groupBy("doc_id").agg(F.min("n_tokens").alias("n_tokens"))
    docs = docs.persist(StorageLevel.DISK_ONLY)
    kinds = [(r["container"], r["capacity_tokens"]) for r in containers.where("container is not null and capacity_tokens > 0").distinct().orderBy("capacity_tokens", "container").collect()]
    total = docs.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    if not kinds:
        kinds_of = F.array().cast("array<struct<container:string,capacity:int>>")
    else:
        kinds_of = F.array(*[F.struct(F.lit(k).alias("container"), F.lit(int(c)).cast("int").alias("capacity")) for k, c in kinds])
    pieces = F.ceil(F.col("n_tokens") / F.col("capacity"))
    items = docs.select("*", F.inline(kinds_of)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1))).select("container", "capacity", F.array(F.struct("doc_id", (F.col("i") * F.col("capacity")).alias("start"), F.least("n_tokens", (F.col("i") + 1) * F.col("capacity")).alias("end"))).alias("parts")).withColumn("size", F.col("parts")[0]["end"] - F.col("parts")[0]["start"])
    spec = "container string, capacity int, parts array<struct<doc_id bigint, start bigint, end bigint>>, size bigint"
    part_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))

    def fill(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        name, capacity = t.column("container")[0].as_py(), t.column("capacity")[0].as_py()
        rows = list(zip(t.column("size").to_pylist(), t.column("parts").to_pylist()))
        rows.sort(key=lambda r: ((r[1][0]["doc_id"] * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF, r[1][0]["start"]))
        made = pack(np.array([s for s, _ in rows], np.int64), capacity)
        for at in range(0, len(made), 4096):
            some = made[at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array([capacity] * len(some), pa.int32()), pa.array([[p for i in c for p in rows[i][1]] for c in some], part_type), pa.array([sum(rows[i][0] for i in c) for c in some], pa.int64())], names=["container", "capacity", "parts", "size"])

    full = F.col("size") >= F.col("capacity")
    rounds, todo, tokens = [items.where(full)], items.where(~full), total * len(kinds)  # each kind holds every document
    shards = max(1, round(total / shard))
    while True:
        # rounds after the first pack what shards left open
        done = todo.groupBy("container", F.pmod(F.xxhash64(F.col("parts")[0]["doc_id"], F.lit(len(rounds))), F.lit(shards)).alias("shard")).applyInArrow(fill, spec).persist(StorageLevel.DISK_ONLY)
        if shards == 1:
            rounds.append(done)
            break
        rounds.append(done.where(full))
        left = done.where(~full)
        rest = left.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        if rest > 0.9 * tokens:
            rounds.append(left)
            break
        todo = left.select("container", "capacity", F.explode("parts").alias("p")).select("container", "capacity", F.array("p").alias("parts"), (F.col("p.end") - F.col("p.start")).alias("size"))
        tokens, shards = rest, max(1, round(rest / max(1, len(kinds)) / shard))
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    number = F.sha2(F.concat_ws("|", "container", F.to_json("parts")), 256)
    return out.select("container", F.col("capacity").alias("capacity_tokens"), F.substring(number, 1, 24).alias("container_id"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"), "parts", F.col("size").alias("n_tokens"), (F.col("capacity") - F.col("size")).alias("unused_tokens"))

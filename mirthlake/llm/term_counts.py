"""Frequency of every distinct term, by burst tries.

Each worker routes its terms through a trie of its own whose leaves are small tables of term ends; a leaf that holds
too many bursts into one leaf for each next character. A term's entry has two counters, uses and records. When a trie
is full it is written out leaf by leaf (prefix, ends, counters) and begun anew, so memory is bounded. From the sizes
of these leaves the prefixes that hold more than 1/2048 of all entries are found; a term is routed by its shortest
prefix that isn't one of them, and where even the longest is, by a hash of the term too. Subtrees of one route from all workers are merged in one trie and give the totals.
A frequent term is one entry in each worker's trie, however often it occurs, so no route becomes hot.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

JOINT = re.compile(r"[\s_-]+")
#: Longest prefix that routes.
DEPTH = 8


def term_of(value: str | None) -> str | None:
    """Composed form, trimmed, in lower case, each run of blanks, hyphens and underscores one hyphen; None if empty."""
    if value is None:
        return None
    return JOINT.sub("-", unicodedata.normalize("NFC", value).strip().lower()) or None


class BurstTrie:
    """Terms with counters. A node is a table of ends, or after it burst a table of nodes by character ('' for a term that ends here)."""

    def __init__(self, burst: int = 256) -> None:
        self.burst, self.size, self.root = burst, 0, ["leaf", {}]

    def add(self, term: str, uses: int, records: int) -> None:
        node, at = self.root, 0
        while node[0] == "node":
            c = term[at : at + 1]
            node = node[1].setdefault(c, ["leaf", {}])
            at += len(c)
            if not c:
                break
        ends = node[1]
        entry = ends.get(term[at:])
        if entry is None:
            ends[term[at:]] = [uses, records]
            self.size += 1
            if len(ends) > self.burst:
                parts: dict = {}
                for end, x in ends.items():
                    parts.setdefault(end[:1], ["leaf", {}])[1][end[1:]] = x
                node[0], node[1] = "node", parts
        else:
            entry[0] += uses
            entry[1] += records

    def leaves(self) -> Iterator[tuple[str, dict[str, list[int]]]]:
        todo = [("", self.root)]
        while todo:
            prefix, node = todo.pop()
            if node[0] == "leaf":
                if node[1]:
                    yield prefix, node[1]
            else:
                todo += [(prefix + c, x) for c, x in node[1].items()]


LEAVES = "prefix string, ends array<string>, uses array<bigint>, records array<bigint>"


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32()][: len(names)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _written(trie: BurstTrie) -> Iterator[pa.RecordBatch]:
    rows = []
    for prefix, ends in trie.leaves():
        rows.append((prefix, list(ends), [x[0] for x in ends.values()], [x[1] for x in ends.values()]))
        if len(rows) >= 512:
            yield _batch(rows, ["prefix", "ends", "uses", "records"])
            rows = []
    if rows:
        yield _batch(rows, ["prefix", "ends", "uses", "records"])


def term_frequencies(records: DataFrame, terms: str, normalise=term_of, rare_below: int = 3, common_above: float = 0.05, full: int = 200_000) -> DataFrame:
    """(term, n_uses, n_records, mark) over the array column terms; each row of records is one record.

    mark is rare below rare_below records, else common above the share common_above of all rows (rows without terms
    included), else useful. Null arrays, null and empty elements count nothing; an element repeated in a record is
    several uses and one record. No rows give no terms. Terms may be of any length.
    """
    total = records.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = BurstTrie(), {}
        for b in batches:
            for values in b.column(0).to_pylist():
                own: dict[str, int] = {}
                for v in values or ():
                    if v not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[v] = normalise(v)
                    if (t := known[v]) is not None:
                        own[t] = own.get(t, 0) + 1
                for t, n in own.items():
                    trie.add(t, n, 1)
                if trie.size >= full:
                    yield from _written(trie)
                    trie = BurstTrie()
        yield from _written(trie)

    leaves = records.select(terms).mapInArrow(count, LEAVES).persist(StorageLevel.DISK_ONLY)
    ends = leaves.select(F.explode(F.transform("ends", lambda e: F.substring(F.concat("prefix", e), 1, DEPTH))).alias("head"))
    heads = ends.groupBy("head").count()
    entries = heads.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    limit = max(256, entries / 2048)
    heavy = heads.select(F.explode(F.transform(F.sequence(F.lit(0), F.length("head")), lambda i: F.substring("head", 1, i))).alias("prefix"), "count").groupBy("prefix").agg(F.sum("count").alias("n")).where(F.col("n") > limit)
    routes = records.sparkSession.sparkContext.broadcast({r["prefix"]: r["n"] for r in heavy.collect()})  # at most 2048 for each of DEPTH+1 lengths

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = routes.value
        for b in batches:
            rows: dict[str, tuple] = {}
            for prefix, ends, uses, recs in zip(*[b.column(i).to_pylist() for i in range(4)]):
                for e, u, n in zip(ends, uses, recs):
                    term, at = prefix + e, 0
                    while at < min(DEPTH, len(term)) and term[:at] in heavy:
                        at += 1
                    # a prefix of full depth that is still heavy: as many parts by hash as bring each to the limit
                    n_parts = -int(-heavy.get(term[:at], 0) // limit) if at == DEPTH else 0
                    part = xxhash.xxh3_64_intdigest(term) % n_parts if n_parts else 0
                    r = rows.setdefault((term[:at], part), (term[:at], [], [], [], part))
                    r[1].append(term[at:])
                    r[2].append(u)
                    r[3].append(n)
            yield _batch(list(rows.values()), ["prefix", "ends", "uses", "records", "part"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie()
        for b in batches:
            for prefix, ends, uses, recs in zip(*[b.column(i).to_pylist() for i in range(4)]):
                for e, u, n in zip(ends, uses, recs):
                    trie.add(e, u, n)
        prefix = key[0].as_py()
        for at, ends in trie.leaves():
            yield pa.RecordBatch.from_arrays([pa.array([prefix + at + e for e in ends], pa.string()), pa.array([x[0] for x in ends.values()], pa.int64()), pa.array([x[1] for x in ends.values()], pa.int64())], names=["term", "n_uses", "n_records"])

    totals = leaves.mapInArrow(route, LEAVES + ", part int").groupBy("prefix", "part").applyInArrow(merge, "term string, n_uses bigint, n_records bigint")
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > common_above * total, "common").otherwise("useful")
    return totals.withColumn("mark", mark)

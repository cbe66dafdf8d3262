"""The k most similar vectors of every vector, by a forest of hash-prefix trees.

Every tree gives a vector a long hash string of BITS bits. A bit is the side of a hyperplane chosen for the prefix
before it: in the fitted part of a tree the direction in which the sampled vectors of that prefix spread most (a power
iteration from a random start), cut at a quantile drawn near the median; below it, where the sample ends, random
directions through the mean of the last sampled vectors, so that strings go on however many vectors share a prefix.
Vectors that share a long prefix are close.

The strings of all trees are one sorted array of (tree, string, vector), range-partitioned into pieces of about PIECE
rows by Spark's own sampled bounds, which divide equal strings too: no piece grows with the collection, however
vectors crowd. The search has two passes over it.

- Descent: for every vector and tree, the number of vectors that share its first x bits, for all x (runs in the
  sorted array). From the longest prefix upwards, in all trees at once, the ascent adds up these numbers and stops at
  the longest length at which the trees together hold CANDIDATES others. Each vector has its own length.
- Candidates: in each tree the vector's run of that length, at most CANDIDATES places to either side (a run longer
  than that is cut to the vectors that share the most further bits, which stand nearest), compared in matrix products of
  half-precision codes.

The best of all trees are compared again exactly, in doubles, from the vectors as given; a pair found from one side
is a candidate of the other side too.

The trees are fitted on SAMPLE vectors at most (those with the least hash, whatever the size of the collection); every
vector is indexed. Vectors with the same components are one class (64-bit hashes of their bytes; of 10^10 different
vectors about three pairs would be taken for one), represented once, and their ids are put back in the order of ids,
so that a third of all vectors may coincide.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .graph import settled
from .text import lists_of

TREES, CANDIDATES, SAMPLE, PIECE = 20, 6000, 8192, 250_000
#: Bits of a hash string; with a tree's number before them they fill a signed long.
BITS = 56
#: Trees that are searched together, and rounds in which pairs get their vectors: what either brings to disk is removed before the next.
TOGETHER, ROUNDS = 5, 8
#: Vectors below which all trees are searched at once; of as many, pairs get their vectors in one more round.
FEWEST = 25_000
#: Sampled vectors at which the fitted part of a tree ends.
FEW = 8


class Tree:
    """Hyperplanes in arrays: children of node i are left[i], right[i]; a negative child -j-1 ends at means[j]."""

    def __init__(self, points: np.ndarray, seed: int, few: int = FEW) -> None:
        size = points.shape[1]
        self.normals, self.cuts, self.left, self.right, self.means = [], [], [], [], []
        rng = np.random.default_rng(seed)
        self.top = self._grow(points, few, rng, 0)
        self.normals = np.array(self.normals, np.float32).reshape(-1, size)
        self.means = np.array(self.means, np.float32).reshape(-1, size)
        self.further = rng.normal(size=(BITS, size)).astype(np.float32)

    def _grow(self, points: np.ndarray, few: int, rng: np.random.Generator, depth: int) -> int:
        if len(points) > few and depth < BITS:
            some = points if len(points) <= 256 else points[rng.choice(len(points), 256, replace=False)]
            some = some - some.mean(axis=0)
            u = rng.normal(size=points.shape[1]).astype(np.float32)
            for _ in range(2):
                u = some.T @ (some @ u)
                u /= np.sqrt(u @ u) + np.float32(1e-30)
            at = points @ u
            cut = float(np.quantile(at, rng.uniform(0.35, 0.65)))
            above = at > cut
            if above.any() and not above.all():
                me = len(self.cuts)
                self.normals.append(u)
                self.cuts.append(cut)
                self.left.append(0)
                self.right.append(0)
                self.left[me], self.right[me] = self._grow(points[~above], few, rng, depth + 1), self._grow(points[above], few, rng, depth + 1)
                return me
        self.means.append(points.mean(axis=0) if len(points) else np.zeros(points.shape[1]))
        return -len(self.means)

    def plain(self) -> tuple:
        """What travels to the workers: arrays only."""
        return self.top, self.normals, np.array(self.cuts), np.array(self.left, int), np.array(self.right, int), self.means, self.further


def strings(tree: tuple, vectors: np.ndarray) -> np.ndarray:
    """The hash string of each vector as a number of BITS bits, first bit highest."""
    top, normals, cuts, left, right, means, further = tree
    node, depth = np.full(len(vectors), top), np.zeros(len(vectors), np.int64)
    bits = np.zeros((len(vectors), 64), bool)
    inner = np.flatnonzero(node >= 0)
    step = 0
    while len(inner):
        at = node[inner]
        above = np.einsum("ij,ij->i", vectors[inner], normals[at]) > cuts[at]
        bits[inner, 64 - BITS + step] = above
        node[inner] = np.where(above, right[at], left[at])
        depth[inner] += 1
        step += 1
        inner = inner[node[inner] >= 0]
    beyond = vectors @ further.T > (means @ further.T)[-node - 1]
    bits[:, 64 - BITS :] |= beyond & (np.arange(BITS) >= depth[:, None])
    return np.packbits(bits, axis=1).view(">i8").ravel().astype(np.int64)


def runs(keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a sorted array of keys, begin and end of the run of places with the same tree and first bits."""
    first = np.flatnonzero(np.r_[True, np.diff(keys >> np.int64(BITS - length)) != 0])
    last = np.r_[first[1:], len(keys)]
    return np.repeat(first, last - first), np.repeat(last, last - first)


def _matrix(column: pa.Array, kind: type, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, size)


def nearest_vectors(df: DataFrame, key: str, vector: str, k: int = 10, size: int = 64, trees: int = TREES, candidates: int = CANDIDATES, sample: int = SAMPLE, piece: int = PIECE, compared: Accumulator | None = None) -> DataFrame:
    """(id, other, rank, cosine): for each id its k most similar others, greatest cosine first, equal cosines by id.

    Vectors take part that have size finite values, not all zero, in whatever length; others, null ones included, and
    null ids don't. Repeated rows of an id are one (the first by content). Cosines are rounded to 9 digits; ids with
    fewer than k others have as many as there are. compared, if given, adds up the pairs compared in all trees.
    At most 64 trees.
    """
    spark = df.sparkSession
    rows = df.where(F.col(key).isNotNull() & (F.size(vector) == size)).select(F.col(key).alias("id"), F.col(vector).alias("v")).groupBy("id").agg(F.min("v").alias("v"))
    # vectors travel as given: floats as floats, anything else as doubles
    raw = np.float32 if "float" in dict(df.dtypes)[vector] else np.float64
    kind = rows.schema["id"].dataType.simpleString()

    def valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("v").flatten().cast(pa.from_numpy_dtype(raw)).to_numpy(zero_copy_only=False).reshape(-1, size) + raw(0)
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x = [v.tobytes() for v in x[good]]
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(good)), pa.array([xxhash.xxh3_64_intdigest(v) - (1 << 63) for v in x], pa.int64()), pa.array(x, pa.binary())], names=["id", "cid", "x"])

    units = settled(rows.mapInArrow(valid, f"id {kind}, cid bigint, x binary"))
    classes = settled(units.groupBy("cid").agg(F.min_by("x", "id").alias("x"), F.count("*").alias("copies")))
    n = classes.count()
    # small arrays are cut finer, so that every core has a piece
    pieces = max(2, -(-n * trees // piece), min(spark.sparkContext.defaultParallelism, n * trees // 25_000))

    def unit(column: pa.Array) -> np.ndarray:
        x = _matrix(column, raw, size).astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)

    points = classes.select("x", F.xxhash64("cid").alias("h")).orderBy("h").limit(sample).select("x").toArrow().column("x")
    points = spark.sparkContext.broadcast(unit(points) if len(points) else np.empty((0, size), np.float32))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("id").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([pickle.dumps(Tree(points.value, t).plain())], pa.binary())], names=["t", "tree"])

    # trees are bounded by the sample, not by the collection
    fitted = sorted(spark.range(0, trees, 1, trees).mapInArrow(fit, "t bigint, tree binary").collect())
    forest = spark.sparkContext.broadcast([pickle.loads(r["tree"]) for r in fitted])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit(b.column("x"))
                keys = np.array([np.int64(t) << np.int64(BITS) | strings(tree, x) for t, tree in enumerate(forest.value)]).T
                codes = [v.tobytes() for v in x.astype(np.float16)]
                yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array(codes, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, trees, dtype=np.int32)), pa.array(keys.ravel()))], names=["cid", "code", "keys"])

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        if t is None:
            return
        keys, cid = t.column("key").to_numpy(), t.column("cid").to_numpy()
        # a byte a length: sixteen times the binary logarithm of the number of others, to 4 %
        profile = np.zeros((len(keys), BITS + 1), np.uint8)
        for length in range(BITS + 1):
            a, b = runs(keys, length)
            if (b - a).max() < 2:
                break
            profile[:, length] = np.minimum(255, np.rint(16 * np.log2(np.maximum(b - a, 1))))
        for at in range(0, len(keys), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(cid[at : at + 10_000]), pa.array([p.tobytes() for p in profile[at : at + 10_000]], pa.binary())], names=["cid", "profile"])

    def ascend(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cid, held = [], []
        for b in batches:
            cid.append(b.column("cid").to_numpy())
            held.append(np.rint(2 ** (_matrix(b.column("profile"), np.uint8, BITS + 1) / np.float32(16))) - 1)
        cid, held = np.concatenate(cid), np.concatenate(held)
        ids, at = np.unique(cid, return_inverse=True)
        total = np.zeros((len(ids), BITS + 1), np.float64)
        np.add.at(total, at, held)
        enough = total >= candidates
        length = np.where(enough.any(axis=1), BITS - np.argmax(enough[:, ::-1], axis=1), 0)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(length.astype(np.int32))], names=["cid", "length"])

    blocks = max(8, n // 4000)
    block = F.pmod("cid", F.lit(blocks)).alias("block")
    indexed = classes.select("cid", "x").mapInArrow(index, "cid bigint, code binary, keys array<bigint>").persist(StorageLevel.DISK_ONLY)
    array = indexed.select(F.explode("keys").alias("key"), "cid").repartitionByRange(pieces, "key", "cid").sortWithinPartitions("key", "cid")
    lengths = settled(array.mapInArrow(descend, "cid bigint, profile binary").groupBy(block).applyInArrow(ascend, "cid bigint, length int"))

    few = k + 2  # two to spare for what half precision may confuse

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        if t is None:
            return
        keys, cid, length = [t.column(c).to_numpy() for c in ("key", "cid", "length")]
        x = _matrix(t.column("code"), np.float16, size).astype(np.float32)
        place = np.arange(len(keys))
        low, high = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        for l in np.unique(length):
            own = length == l
            a, b = runs(keys, int(l))
            low[own], high[own] = a[own], b[own]
        low, high = np.maximum(low, place - candidates), np.minimum(high, place + candidates + 1)
        if compared is not None:
            compared.add(int((high - low - 1).sum()))
        for at in range(0, len(keys), 256):
            end = min(at + 256, len(keys))
            lo, hi = int(low[at:end].min()), int(high[at:end].max())
            sims = x[at:end] @ x[lo:hi].T
            cols = np.arange(lo, hi)
            sims[(cols < low[at:end, None]) | (cols >= high[at:end, None])] = -9
            sims[np.arange(end - at), place[at:end] - lo] = -9
            best = np.argpartition(-sims, few - 1, axis=1)[:, :few] if sims.shape[1] > few else np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
            s = np.take_along_axis(sims, best, axis=1)
            real = s > -2
            offsets = pa.array(np.r_[0, np.cumsum(real.sum(axis=1))].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(cid[at:end]), pa.ListArray.from_arrays(offsets, pa.array(cid[lo + best][real])), pa.ListArray.from_arrays(offsets, pa.array(s[real]))], names=["cid", "others", "sims"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cid, other, sim = [], [], []
        for b in batches:
            o = lists_of(b.column("others"))
            cid.append(np.repeat(np.array(b.column("cid")), [len(x) for x in o]))
            other += o
            sim += lists_of(b.column("sims"))
        cid, other, sim = np.concatenate(cid), np.concatenate(other), np.concatenate(sim)
        order = np.lexsort((other, cid))
        cid, other, sim = cid[order], other[order], sim[order]
        first = np.ones(len(cid), bool)
        first[1:] = (cid[1:] != cid[:-1]) | (other[1:] != other[:-1])
        cid, other, sim = cid[first], other[first], sim[first]
        order = np.lexsort((-sim, cid))
        cid, other = cid[order], other[order]
        start = np.maximum.accumulate(np.where(np.r_[True, cid[1:] != cid[:-1]][: len(cid)], np.arange(len(cid)), 0))
        keep = np.arange(len(cid)) - start < few
        cid, other, sim = cid[keep], other[keep], sim[order][keep]
        first = np.flatnonzero(np.r_[True, cid[1:] != cid[:-1]][: len(cid)])
        offsets = pa.array(np.r_[first, len(cid)].astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(cid[first]), pa.ListArray.from_arrays(offsets, pa.array(other)), pa.ListArray.from_arrays(offsets, pa.array(sim))], names=["cid", "others", "sims"])

    # a few trees at a time; each time the best of each vector so far are merged with those of the new trees
    spec = "cid bigint, others array<bigint>, sims array<float>"
    best = None
    together = trees if n < FEWEST else TOGETHER
    for t in range(0, trees, together):
        some = min(together, trees - t)
        own = pieces if some == trees else max(2, -(-n * some // piece), min(spark.sparkContext.defaultParallelism, some))
        keyed = indexed.select("cid", "code", F.slice("keys", t + 1, some).alias("keys")).join(lengths.hint("merge"), "cid")
        array = keyed.select(F.explode("keys").alias("key"), "cid", "length", "code").repartitionByRange(own, "key", "cid").sortWithinPartitions("key", "cid")
        found = array.mapInArrow(search, spec).where(F.size("others") > 0)
        best = settled((found if best is None else best.unionAll(found)).groupBy(block).applyInArrow(merge, spec))
    other = F.explode("others").alias("other")
    near = settled(best.select("cid", other).select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")).distinct())
    # each class brings its k+1 least ids: no more can be among anyone's k nearest
    ranked = units.select("cid", "id").withColumn("at", F.row_number().over(_window("cid", "id"))).where(F.col("at") <= k + 1)
    heads = ranked.groupBy("cid").agg(F.collect_list("id").alias("ids"))
    vectors = classes.select("cid", "x")
    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = [_matrix(b.column(c), raw, size).astype(np.float64) for c in ("x", "y")]
            x, y = [v / np.abs(v).max(axis=1, keepdims=True) if len(v) else v for v in (x, y)]
            s = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(np.round(s, 9))], names=["a", "b", "cosine"])

    links = None
    rounds = min(ROUNDS, 1 + n // FEWEST)
    for turn in range(rounds):
        some = near.where(F.pmod(F.xxhash64("a"), F.lit(rounds)) == turn)
        linked = some.join(vectors.toDF("a", "x").hint("merge"), "a").join(vectors.toDF("b", "y").hint("merge"), "b")
        some = settled(linked.select("a", "b", "x", "y").mapInArrow(cosines, "a bigint, b bigint, cosine double"))
        links = some if links is None else links.unionAll(some)
    links = links.select("cosine", F.inline(F.array(F.struct(F.col("a").alias("cid"), F.col("b").alias("other")), F.struct(F.col("b").alias("cid"), F.col("a").alias("other"))))).select("cid", "other", "cosine")
    own = classes.where("copies > 1").select("cid", F.col("cid").alias("other"), F.lit(1.0).alias("cosine"))
    spread = links.unionAll(own).join(heads.toDF("other", "ids"), "other").select("cid", "cosine", F.explode("ids").alias("other"))
    # the k+1 best of a class serve all of its members: each leaves itself out
    top = settled(spread.withColumn("at", F.row_number().over(_window("cid", F.desc("cosine"), "other"))).where(F.col("at") <= k + 1).select("cid", "other", "cosine"))
    pairs = units.select("cid", "id").join(top, "cid").where("id <> other")
    return pairs.withColumn("rank", F.row_number().over(_window("id", F.desc("cosine"), "other"))).where(F.col("rank") <= k).select("id", "other", "rank", "cosine")


def _window(by: str, *order):
    return Window.partitionBy(by).orderBy(*order)


def brute_force(vectors: np.ndarray, ids: list, k: int) -> set[tuple]:
    """(id, other) of the k nearest by exact cosines: what the operator is measured against."""
    x = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    sims = np.round(x @ x.T, 9)
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-sims[i, j], ids[j]))[:k]
        out |= {(ids[i], ids[j]) for j in order}
    return out

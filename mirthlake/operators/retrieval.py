"""Retrieval: BM25, blocked vector top-k, rank fusion, reserved slots and the whole pipeline."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions import numeric as N
from ..functions import patterns as P
from ..functions.text import lexical_tokens
from .postings import Postings


def top_k(df: DataFrame, by: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark prunes groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


#: Queries and documents of a task: the sides are copied once for each block of the other, so blocks are as large as a task holds.
BLOCK, CHUNK = 16_384, 65_536


def grid(df: DataFrame, n_queries: int, n_rows: int, block: int, chunk: int) -> tuple[int, int]:
    """Numbers of blocks of queries and of chunks of rows; small inputs are cut finer, so that every core has a task."""
    nq = max(1, -(-n_queries // block))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return nq, max(1, -(-n_rows // chunk), min(-(-cores // nq), n_rows // 256))


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    values, offsets = np.asarray(column.values), np.asarray(column.offsets)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


#: Of BM25: queries of a task, documents of a task, and documents that are indexed together.
QUERIES, DOCUMENTS, PIECE = 65_536, 1_048_576, 65_536


def bm25(queries: DataFrame, docs: DataFrame, k: int = 3, block: int = QUERIES, chunk: int = DOCUMENTS, piece: int = PIECE) -> DataFrame:
    """(query_id, id, score, rank) from queries(query_id, text) and docs(id, text).

    A query's words count once, a document's as often as they stand; scores above 0 only. Documents are indexed once, in
    pieces: for each word the documents that have it, with how often and how long they are. How many documents have a
    word is added up over the pieces. A task searches all its pieces together for one block of queries (postings.py), and
    k rows a query leave the task. Only where there are several chunks of
    documents, or queries too few for all cores, are these ranked again.
    """
    hashes = lambda c: F.transform(lexical_tokens(c), lambda w: F.xxhash64(w))
    asking = queries.select("query_id", F.array_distinct(hashes(F.col("text"))).alias("words")).persist(StorageLevel.DISK_ONLY)
    n_docs, n_queries = docs.count(), asking.count()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    n_pieces = max(1, -(-n_docs // piece), min(cores, n_docs // 8192))
    nq = max(1, -(-n_queries // block), min(cores, n_queries // 2048))
    nq = -(-nq // cores) * cores if nq > cores else nq
    nc = max(-(-n_docs // chunk), min(-(-cores // nq), n_pieces))
    own, other = queries.schema["query_id"].dataType.simpleString(), docs.schema["id"].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (batches := [b for b in batches if b.num_rows]):
            return
        t = pa.Table.from_batches(batches).combine_chunks()
        ids = t.column("id").chunk(0).dictionary_encode("encode")
        lens, words = [np.asarray(x) for x in (t.column("words").chunk(0).value_lengths(), t.column("words").chunk(0).flatten())]
        rows, no = ids.indices.to_numpy(), t.column("p")[0].as_py()
        at, long = np.repeat(rows, lens).astype(np.int64), np.repeat(lens, lens)
        for low in range(0, len(ids.dictionary), 65_536):
            high = min(low + 65_536, len(ids.dictionary))
            mine = np.flatnonzero((at >= low) & (at < high))
            mine = mine[np.lexsort((long[mine], at[mine], words[mine]))]
            w, d, n = words[mine], at[mine] - low, long[mine]
            first = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (d[1:] != d[:-1]) | (n[1:] != n[:-1])][: len(w)])
            tf, w, d, n = np.diff(np.r_[first, len(w)]), w[first], d[first], n[first]
            kinds, code = np.unique(tf << 32 | n, return_inverse=True)
            starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]][: len(w)])
            gaps = np.diff(d, prepend=0).astype(np.uint16)  # of 2^16 at most, so sums of gaps that run over come out right
            postings = zlib.compress(pickle.dumps((gaps, code.astype(np.min_scalar_type(len(kinds))), kinds >> 32, kinds & 0xFFFFFFFF)), 1)
            total = int(lens[(rows >= low) & (rows < high)].sum())
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            yield pa.RecordBatch.from_arrays([pa.array([no + low // 65_536], pa.int32()), pa.array([total]), one(pa.array(w[starts])), one(pa.array(np.diff(np.r_[starts, len(w)]))), pa.array([postings], pa.binary()), one(ids.dictionary.slice(low, high - low))], names=["no", "total", "words", "counts", "postings", "ids"])

    d = docs.select("id", hashes(F.col("text")).alias("words"), F.pmod(F.xxhash64("id"), F.lit(n_pieces)).cast("int").alias("p"))
    pieces = d.repartitionById(n_pieces, F.col("p")).mapInArrow(index, f"no int, total bigint, words array<bigint>, counts array<bigint>, postings binary, ids array<{other}>").persist(StorageLevel.DISK_ONLY)
    mean = (pieces.agg(F.sum("total")).first()[0] or 0) / max(n_docs, 1) or 1.0
    df = pieces.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy(F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("df"))
    q = asking.select("query_id", "words", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("qb")).where(F.size("words") > 0)
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = q.select("qb", F.explode("words").alias("word")).distinct().join(df, "word")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell, none = (F.col("qb") * nc + F.col("cb")).alias("cell"), F.lit(None)
    asked = q.select("query_id", "words", "qb", spread(nc).alias("cb")).select(cell, "query_id", "words", none.cast("array<bigint>").alias("counts"), none.cast("double").alias("idf"), none.cast("binary").alias("postings"), none.cast(f"array<{other}>").alias("ids"))
    known = weights.select("qb", "word", idf.alias("idf"), spread(nc).alias("cb")).select(cell, none.cast(own), F.array("word"), none, "idf", none, none)
    parts = pieces.select("words", "counts", "postings", "ids", F.pmod("no", F.lit(nc)).alias("cb"), spread(nq).alias("qb")).select(cell, none.cast(own), "words", "counts", none, "postings", "ids")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, known, parts = [], [], []
        for b in batches:
            is_part, is_known = b.column("postings").is_valid(), b.column("idf").is_valid()
            asked.append(b.select(["query_id", "words"]).filter(pc.invert(pc.or_(is_part, is_known))))
            known.append(b.select(["words", "idf"]).filter(is_known))
            parts += [b.select(["words", "counts", "postings", "ids"]).slice(i, 1) for i in np.flatnonzero(is_part).tolist()]
        if not parts or not any(x.num_rows for x in asked) or not any(x.num_rows for x in known):
            return
        asked, known = pa.Table.from_batches(asked).combine_chunks(), pa.Table.from_batches(known).combine_chunks()
        vocabulary = np.asarray(known.column("words").chunk(0).flatten())
        order = np.argsort(vocabulary)
        vocabulary, idf = vocabulary[order], known.column("idf").to_numpy()[order]
        place = lambda ws: np.minimum(np.searchsorted(vocabulary, ws), len(vocabulary) - 1)
        # a query that came in several rows has the words of all
        owns, sets = asked.column("query_id").chunk(0).dictionary_encode("encode"), _lists(asked.column("words").chunk(0))
        of, texts = owns.indices.to_numpy(), [[] for _ in range(len(owns.dictionary))]
        for i, ws in zip(of.tolist(), sets):
            ws = ws[vocabulary[place(ws)] == ws]
            texts[i] = place(ws).tolist() if not texts[i] else sorted({*texts[i], *place(ws).tolist()})
        # documents are numbered in the order of their ids, so equal scores go by number
        ids = pa.concat_arrays([p.column("ids").flatten() for p in parts])
        number = np.empty(len(ids), np.int64)
        number[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        pieces = []
        for p in parts:
            words, counts = [np.asarray(p.column(c).flatten()) for c in ("words", "counts")]
            here = place(words)
            gaps, *codes = pickle.loads(zlib.decompress(p.column("postings")[0].as_py()))
            pieces.append((np.where(vocabulary[here] == words, here, -1), counts, np.cumsum(gaps, dtype=np.uint16), *codes, len(p.column("ids")[0])))
        parts.clear()
        found = Postings(pieces, len(vocabulary), mean)
        pieces.clear()
        best_at, best = zip(*found.search(texts, idf, number, k))
        for low in range(0, len(texts), 4096):
            some = range(low, min(low + 4096, len(texts)))
            take = np.repeat(np.arange(low, some.stop), [len(best[i]) for i in some])
            rank = np.concatenate([np.arange(1, len(best[i]) + 1) for i in some])
            at, score = np.concatenate([best_at[i] for i in some]), np.concatenate([best[i] for i in some])
            yield pa.RecordBatch.from_arrays([owns.dictionary.take(pa.array(take)), ids.take(pa.array(at)), pa.array(score), pa.array(rank.astype(np.int32))], names=["query_id", "id", "score", "rank"])

    scored = asked.unionAll(known).unionAll(parts).repartitionById(nq * nc, F.col("cell")).drop("cell").mapInArrow(add, f"query_id {own}, id {other}, score double, rank int")
    return scored if nc == 1 else top_k(scored.drop("rank"), ["query_id"], k, F.desc("score"), F.col("id"))


def nearest(queries: DataFrame, corpus: DataFrame, k: int, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, id, score, rank): exact cosine top k of queries(query_id, v) in corpus(id, v), without the query's own id.

    Vectors must have the same length; null vectors take no part. Scores are rounded to 6 digits, equal scores by id.
    """
    return nearest_views(queries, corpus, {"all": None}, k, block=block, chunk=chunk).select("query_id", "id", "score", "rank")


def nearest_views(queries: DataFrame, corpus: DataFrame, views: dict[str, tuple[int, int] | None], k: int, core: Column | None = None, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, list, core, id, score, rank): exact cosine top k in each view, and again among core rows if core is given.

    A view is a range of dimensions (first, count), None the whole vector. Both sides are cut into blocks; a task holds
    one block of queries and one of the corpus, multiplies matrices for all views and passes on k rows a query and
    list, so the vectors are read and shuffled once, however many views and subsets are asked for.
    """
    qs, cs = queries.where("v is not null"), corpus.where("v is not null")
    nq, nc = grid(corpus, qs.count(), cs.count(), block, chunk)
    q = qs.select(F.col("query_id").alias("k"), F.col("v").cast("array<double>").alias("v"), F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("cb"))
    c = cs.select(F.col("id").alias("k"), F.col("v").cast("array<double>").alias("v"), F.coalesce(core if core is not None else F.lit(False), F.lit(False)).alias("core"), F.pmod(F.xxhash64("id"), F.lit(nc)).cast("int").alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))
    kind = dict(queries.dtypes)["query_id"]
    other = dict(corpus.dtypes)["id"]
    sides = [False] if core is None else [False, True]

    def multiply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": a["k"][:0], "list": np.empty(0, str), "core": np.empty(0, bool), "id": b["k"][:0], "score": np.empty(0)})
        if not len(a) or not len(b):
            return none
        whole_x, whole_y = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
        ids, owns, is_core = b["k"].to_numpy(), a["k"].to_numpy(), b["core"].to_numpy()
        out = [none]
        for name, part in views.items():
            x, y = (whole_x, whole_y) if part is None else (m[:, part[0] - 1 : part[0] - 1 + part[1]] for m in (whole_x, whole_y))
            with np.errstate(invalid="ignore", divide="ignore"):
                x, y = x / np.sqrt((x * x).sum(axis=1))[:, None], y / np.sqrt((y * y).sum(axis=1))[:, None]
            for at_query, side in ((j, side) for j in range(0, len(owns), 128) for side in sides):
                among = np.flatnonzero(is_core) if side else np.arange(len(ids))
                if not len(among):
                    continue
                s = np.floor(np.nan_to_num(x[at_query : at_query + 128] @ y[among].T, nan=-2.0) * 1e6 + 0.5) / 1e6
                for own, sims in zip(owns[at_query : at_query + 128], s):
                    row = np.where(ids[among] == own, -3.0, sims)
                    cut = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -3.0
                    at = np.nonzero((row >= cut) & (row > -2.0))[0]
                    at = at[np.lexsort((ids[among][at], -row[at]))][:k]
                    out.append(pd.DataFrame({"query_id": own, "list": name, "core": side, "id": ids[among][at], "score": row[at]}))
        return pd.concat(out, ignore_index=True)

    pairs = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(multiply, f"query_id {kind}, list string, core boolean, id {other}, score double")
    return top_k(pairs, ["query_id", "list", "core"], k, F.desc("score"), F.col("id"))


def fuse(lists: DataFrame, k: int = 30, constant: int = P.RRF_CONSTANT) -> DataFrame:
    """(query_id, id, rrf, best_rank, best_score, rank) from ranked lists (query_id, list, id, rank, score)."""
    # all rows of a query come together once, for its sums and for its ranks
    g = lists.repartition("query_id").groupBy("query_id", "id").agg(N.rounded(F.sum(1 / (F.lit(float(constant)) + F.col("rank"))), 9).alias("rrf"), F.min("rank").alias("best_rank"), F.max("score").alias("best_score"))
    return top_k(g, ["query_id"], k, F.desc("rrf"), F.col("best_rank"), F.desc("best_score"), F.col("id"))


def with_reserve(broad: DataFrame, core: DataFrame, first: int = 20, reserve: int = 10, limit: int = 30) -> DataFrame:
    """(query_id, id, rank): first broad places, then reserve core places, then the rest of broad; an id counts once."""
    b = broad.select("query_id", "id", F.when(F.col("rank") <= first, F.col("rank")).otherwise(F.col("rank") + reserve).alias("place"), F.lit(0).alias("side"))
    c = core.where(F.col("rank") <= reserve).select("query_id", "id", (F.col("rank") + first).alias("place"), F.lit(1).alias("side"))
    # a broad row beyond the first places stands after all reserved ones
    b = b.withColumn("place", F.when(F.col("place") > first, F.col("place") + F.lit(1_000)).otherwise(F.col("place")))
    merged = b.unionByName(c).groupBy("query_id", "id").agg(F.min("place").alias("place"))
    return top_k(merged, ["query_id"], limit, F.col("place")).select("query_id", "id", "rank")


def dual_view(queries: DataFrame, corpus: DataFrame, views: dict[str, tuple[int, int]], k: int) -> DataFrame:
    """(query_id, list, id, rank, score): top k per view, a view being a range of dimensions (first, count)."""
    return nearest_views(queries, corpus, views, k).select("query_id", "list", "id", "rank", "score")


def retrieve(queries: DataFrame, corpus: DataFrame, views: dict[str, tuple[int, int]], core: Column, k: int = 30, first: int = 20, reserve: int = 10) -> DataFrame:
    """Both views over all and over core rows, fused, with reserved core places; (query_id, id, rank)."""
    if not 1 <= k <= 50:
        raise ValueError("between 1 and 50 places")
    found = nearest_views(queries, corpus, views, min(50, max(k, 30)), core)
    broad, reserved = fuse(found.where("not core"), k), fuse(found.where("core"), k)
    return with_reserve(broad, reserved, first, reserve, k)


def retrieve_arm(arm: str, queries: DataFrame, corpus: DataFrame, views: dict[str, tuple[int, int]], core: Column) -> DataFrame:
    """(query_id, id, rank) of one of the arms that are compared: current, controlled (50 places, 30 of them core), expansion (no core rows)."""
    if arm == "current":
        return retrieve(queries, corpus, views, core)
    if arm == "controlled":
        return retrieve(queries, corpus, views, core, 50, 20, 30)
    if arm == "expansion":
        return fuse(dual_view(queries, corpus.where(~core), views, 30), 30).select("query_id", "id", "rank")
    raise ValueError(f"no arm {arm}")


def competitive(df: DataFrame, by: str, score: str) -> DataFrame:
    """(by, fault): groups of scores that can't be used: incomplete (null, or outside 0..1) or flat (several, all equal); fault null for good ones."""
    s = F.col(score)
    g = df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(s.isNull() | F.isnan(s) | ~s.between(0, 1)).alias("bad"), F.min(score).alias("low"), F.max(score).alias("high"))
    return g.select(by, F.when(F.col("bad") > 0, "incomplete").when((F.col("n") > 1) & (F.col("low") == F.col("high")), "flat").alias("fault"))

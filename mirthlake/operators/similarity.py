"""Joins by likeness: keys, sets, bit strings, vectors and substrings."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Characters by which aliases are looked up.
LONGEST_GRAM = 8
#: Cells in which the tokens of sets are counted.
CELLS = 1 << 16


def shared_key(df: DataFrame, keys: str, kind: str) -> DataFrame:
    """Conflicts of records that share a key: rows (pos, id, scope) with an array of keys.

    Unordered pairs with at least one target, the later row on the left, the first shared key. Keys of one row are
    found by counts that are added up before the shuffle; hot keys are then split by the join's own skew handling.
    """
    k = df.select("pos", "id", "scope", F.explode(F.array_distinct(keys)).alias("key")).where("key is not null and key <> ''")
    # keys of one row join nothing
    k = k.join(k.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key", "left_semi")
    a, b = [k.select(*[F.col(c).alias(f"{c}_{s}") for c in ("pos", "id", "scope")], "key") for s in "ab"]
    pairs = b.join(a, "key").where("pos_a < pos_b and (scope_a = 'target' or scope_b = 'target')")
    one = pairs.groupBy("id_b", "scope_b", "id_a", "scope_a").agg(F.min("key").alias("key"))
    return one.select(F.lit(kind).alias("kind"), F.col("id_b").alias("left_id"), F.col("scope_b").alias("left_scope"), F.col("id_a").alias("right_id"), F.col("scope_a").alias("right_scope"), "key", F.lit(None).cast("double").alias("metric"))


def set_join(df: DataFrame, tokens: str, threshold: float, least: int = 1) -> DataFrame:
    """(pos_a, pos_b, shared, size_a, size_b): pairs of distinct token sets with Jaccard at least threshold.

    Prefix filter: in an order by frequency, two such sets share one of their first n - ceil(t n) + 1 tokens; only
    these are joined, and sizes must agree within t. Frequencies are counted into a table of CELLS cells by hash, a fixed
    size that is sent to every task, so tokens aren't shuffled for them; any order gives the same result. Each set brings the parities of its tokens in 64 classes: they
    differ in no more places than the sets do in tokens, so most candidates fall before their tokens are fetched.
    """
    s = df.where(F.size(tokens) >= least).select("pos", F.array_distinct(tokens).alias("tokens"))
    one = F.lit(1).cast("bigint")
    bits = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", one, F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))
    t = s.select("pos", F.size("tokens").alias("n"), bits.alias("bits"), F.explode("tokens").alias("token"))
    t = t.select("pos", "n", "bits", F.xxhash64("token").alias("token"))
    cell = F.col("token").bitwiseAND(CELLS - 1).alias("cell")
    freq = t.groupBy(cell).agg(F.count("*").alias("df"))
    ranked = t.withColumn("cell", cell).join(F.broadcast(freq), "cell").withColumn("at", F.row_number().over(Window.partitionBy("pos").orderBy("df", "token")))
    head = ranked.where(F.col("at") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1)
    a, b = head.select(F.col("pos").alias("pos_a"), F.col("n").alias("size_a"), F.col("bits").alias("ba"), "token"), head.select(F.col("pos").alias("pos_b"), F.col("n").alias("size_b"), F.col("bits").alias("bb"), "token")
    both = F.col("size_a") + F.col("size_b")
    apart = both - 2 * F.ceil(both * F.lit(threshold / (1 + threshold)) - 1e-9)
    near = (F.col("size_a") >= threshold * F.col("size_b")) & (F.col("size_b") >= threshold * F.col("size_a")) & (F.bit_count(F.col("ba").bitwiseXOR(F.col("bb"))) <= apart)
    cand = a.join(b, "token").where((F.col("pos_a") < F.col("pos_b")) & near).select("pos_a", "pos_b", "size_a", "size_b").distinct()
    full = cand.join(s.toDF("pos_a", "ta"), "pos_a").join(s.toDF("pos_b", "tb"), "pos_b")
    full = full.withColumn("shared", F.size(F.array_intersect("ta", "tb")))
    return full.where(F.col("shared") >= threshold * (F.col("size_a") + F.col("size_b") - F.col("shared"))).select("pos_a", "pos_b", "shared", "size_a", "size_b")


def bit_values(df: DataFrame, bits: str, most: int = 5, width: int = 64, together: int = 2) -> DataFrame:
    """(va, vb, distance), va < vb: pairs of different 64-bit values that differ in at most most bits, each pair once.

    Of most+together bands of bits, two such values agree in together at least; every combination of that many bands is
    a key, the keys are equi-joined and the distance then counted. One more band a key makes keys rarer by its bits at
    the price of more keys: 21 of 18 bits for five differing bits in pairs of bands, 56 of 24 bits in threes. A pair is
    taken from the first combination in which it agrees, so nothing has to be made distinct, and equal values are one
    while pairs are sought.
    """
    n = most + together
    cuts = [(i * width // n, (i + 1) * width // n) for i in range(n)]
    masks = [sum(((1 << (b - a)) - 1) << a for a, b in some) for some in combinations(cuts, together)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    v = F.col("v")
    parts = F.array(*[F.struct(F.lit(i).alias("band"), v.bitwiseAND(F.lit(m).cast("bigint")).alias("part")) for i, m in enumerate(signed)])
    k = df.where(F.col(bits).isNotNull()).select(F.col(bits).alias("v")).distinct().select("v", F.explode(parts).alias("x")).select("v", "x.band", "x.part")
    a, b = k.toDF("va", "band", "part"), k.toDF("vb", "band", "part")
    x = F.col("va").bitwiseXOR(F.col("vb"))
    first = F.coalesce(*[F.when(x.bitwiseAND(F.lit(m).cast("bigint")) == 0, i) for i, m in enumerate(signed)])
    return a.join(b, ["band", "part"]).where((F.col("va") < F.col("vb")) & (F.bit_count(x) <= most)).where(first == F.col("band")).select("va", "vb", F.bit_count(x).alias("distance"))


def bit_join(df: DataFrame, bits: str, most: int = 5, width: int = 64, together: int = 2) -> DataFrame:
    """(pos_a, pos_b, distance): pairs of rows whose 64-bit values differ in at most most bits; see bit_values."""
    rows = df.where(F.col(bits).isNotNull()).select("pos", F.col(bits).alias("v"))
    a, b = rows.toDF("pa", "va"), rows.toDF("pb", "vb")
    near = bit_values(df, bits, most, width, together).join(a, "va").join(b, "vb").select("pa", "pb", "distance")
    same = a.join(b, F.col("va") == F.col("vb")).where("pa < pb").select("pa", "pb", F.lit(0).alias("distance"))
    return near.where("pa <> pb").unionAll(same).select(F.least("pa", "pb").alias("pos_a"), F.greatest("pa", "pb").alias("pos_b"), "distance")


def covered_by_alias(items: DataFrame, records: DataFrame) -> DataFrame:
    """(item_id, record_id): for each item(item_id, aliases) the first record(id, pos, text) whose text contains an alias.

    An alias may stand anywhere, within words too. Runs of characters as long as the shortest alias (LONGEST_GRAM at
    most) make it an equi-join: each alias is looked up by its first run among those of the texts, then sought whole,
    so records that share no run with any alias are never paired. Items without a hit have a null record.
    """
    a = items.select("item_id", F.explode(F.array_distinct("aliases")).alias("alias")).where("alias <> ''")
    n = a.agg(F.least(F.min(F.length("alias")), F.lit(LONGEST_GRAM))).first()[0]
    if n is None:
        return items.select("item_id", F.lit(None).cast("string").alias("record_id"))
    run = F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.substring("text", i, n))
    grams = records.where(F.length("text") >= n).select("id", "pos", "text", F.explode(F.array_distinct(run)).alias("gram"))
    hits = grams.join(a.withColumn("gram", F.substring("alias", 1, n)), "gram").where(F.contains("text", "alias"))
    first = hits.groupBy("item_id").agg(F.min_by("id", F.struct("pos", "id")).alias("record_id"))
    return items.select("item_id").join(first, "item_id", "left")

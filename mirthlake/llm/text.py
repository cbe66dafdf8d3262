"""Words of a text, word-set hashes and small Arrow helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: White space in the wide sense: what str.strip() removes, the non-breaking blank included.
BLANKS = r"[\s   -     　]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim_wide(c):
    """Column without white space at either end."""
    return F.regexp_replace(c, rf"^{BLANKS}+|{BLANKS}+$", "")


def one_record(df: DataFrame, key: str) -> DataFrame:
    """Redelivered rows are one record: the earliest arrival of each key. Rows without a key are dropped.

    Aggregated before the shuffle; equal arrival times hold equal content.
    """
    cols = [c for c in df.columns if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*cols), F.coalesce("ingested_at", F.lit("1970-01-01").cast("timestamp_ntz"))).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in cols])


def fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c)).casefold()


def words(text: str) -> set[str]:
    return set(WORD.findall(fold(text)))


def word_hashes(text: str, known: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's words. known: a cache, emptied when it grows."""
    out = []
    for w in words(text):
        h = known.get(w)
        if h is None:
            if len(known) > 200_000:
                known.clear()
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.sort(np.array(out, dtype=np.uint64)).view(np.int64)


def set_id(hashes: np.ndarray) -> int:
    """64 bits that stand for the set of words (two of ten million sets coincide with a chance of 3 in a million)."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def lists_of(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a list column without nulls as NumPy views."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def as_word_sets(df: DataFrame, text: str, keep: list[str], words_name: str = "ws", id_name: str = "cid") -> DataFrame:
    """keep columns, the set's id and its sorted word hashes. Texts that are null or have no word are left out."""
    fields = {f.name: f for f in df.schema.fields}
    df = df.where(F.col(text).isNotNull()).select(*keep, text)
    schema = ", ".join(f"`{k}` {fields[k].dataType.simpleString()}" for k in keep) + f", `{id_name}` bigint, `{words_name}` array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            sets = [word_hashes(t, known) for t in b.column(text).to_pylist()]
            mask = pa.array([len(s) > 0 for s in sets])
            sets = [s for s in sets if len(s)]
            out = [b.column(k).filter(mask) for k in keep]
            out += [pa.array([set_id(s) for s in sets], type=pa.int64()), list_array(sets, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=[*keep, id_name, words_name])

    return df.mapInArrow(run, schema)


#: DuckDB's words of a text: letters and digits without accents, in small letters.
WORDS_SQL = r"list_distinct(regexp_extract_all(lower(strip_accents({})), '[\p{{L}}\p{{N}}]+'))"

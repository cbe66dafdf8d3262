"""Token counts with a public tokenizer whose vocabulary is a file, not part of this repository."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary lies unless the caller says otherwise.
VOCABULARY = os.environ.get("MIRTHLAKE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json")
#: Characters given to the tokenizer at once; longer texts go in pieces cut before a blank, where no token crosses.
PIECE = 50_000


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """The text in pieces of about most characters, cut before single blanks between two words."""
    at = 0
    while len(text) - at > most:
        cut = at + most
        while cut < len(text) - 1 and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1].isalpha()):
            cut += 1
        if cut >= len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def with_tokens(df: DataFrame, key: str, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """keep columns, doc_id and n_tokens. Null texts have 0 tokens."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(vocabulary)
        t.encode_special_tokens = True
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts, of = [], []
                for i, x in enumerate(part.column(text).to_pylist()):
                    for p in pieces(x or ""):
                        texts.append(p)
                        of.append(i)
                counts = [0] * part.num_rows
                for i, e in zip(of, t.encode_batch(texts, add_special_tokens=False)):
                    counts[i] += len(e)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], part.column(key), pa.array(counts, pa.int64())], names=[*keep, "doc_id", "n_tokens"])

    spec = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + (", " if keep else "") + f"doc_id {kinds[key]}, n_tokens bigint"
    return df.select(*dict.fromkeys([*keep, key, text])).mapInArrow(run, spec)

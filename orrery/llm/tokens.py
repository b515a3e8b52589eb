"""Token counts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Default place of the vocabulary; every operator takes another path as a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def count_tokens(rows: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, n_tokens and ``keep`` columns for every row; a null text has null tokens, an empty one 0.

    The vocabulary file (under 1 MB) is read by the driver and broadcast, so that executors need no
    copy of it. Texts are counted whole and where they are read.
    """
    with open(vocabulary, "rb") as f:
        shipped = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(shipped.value).encode_ordinary
        for batch in batches:
            counts = [None if t is None else len(encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), *[batch.column(2 + k) for k in range(len(keep))]],
                names=[key, "n_tokens", *keep])

    selected = rows.select(key, text, *keep)
    kinds = dict(selected.dtypes)
    return selected.mapInArrow(run, f"{key} {kinds[key]}, n_tokens long" + "".join(f", {c} {kinds[c]}" for c in keep))

"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder with the vocabulary files and the file used by default.
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER_FILE = "byte_bpe_multi_50k.tiktoken"
# fixed value: the split pattern that belongs to these byte-level vocabularies
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("corvidex", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, keep: list[str], text: str, path: str | None = None) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of the whole text; NULL and empty texts have 0."""
    file = path or os.path.join(TOKENIZER_DIR, TOKENIZER_FILE)
    fields = [df.schema[k] for k in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long"

    def run(batches):
        enc = _encoding(file)
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            n = pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], n], names=[*keep, "n_tokens"])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)

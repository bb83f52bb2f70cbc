"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

#: Folder of the vocabulary files, and the rank file used for sizes.
FOLDER = os.environ.get("FRAMEWISE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict = {}


def encoding(path: str):
    """The tokenizer of a rank file, loaded once a Python worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_count(path: str | None = None):
    """A pandas UDF: tokens of a text as long; 0 for null and empty texts. Whole texts are counted."""
    file = path or os.path.join(FOLDER, VOCABULARY)

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoding(file)
        for s in texts:
            yield s.map(lambda t: len(e.encode_ordinary(t)) if t else 0).astype("int64")

    return count

"""Sizes of texts in tokens of public tokenizers. Their folder is a parameter; no vocabulary is kept in this repository."""

from __future__ import annotations

import base64
import importlib.util
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"


@lru_cache(maxsize=2)
def encoding(name: str, folder: str):
    """A tiktoken encoding from <folder>/<name>.tiktoken; loaded once per Python worker."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("tokenizer_folder", Path(folder) / "__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(Path(folder) / f"{name}.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> Column:
    """Tokens of a text; 0 for null. ``byt5``: one token per byte of UTF-8, without end mark (no Python)."""
    if tokenizer == "byt5":
        return F.coalesce(F.octet_length(text), F.lit(0))

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(tokenizer, folder)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int32")

    return count(text)

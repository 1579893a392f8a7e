"""Token ids of texts by a public tokenizer's file, and texts of ids; for prompts and replies of a training run.

The file is a parameter and must lie where every executor finds it. (A whole corpus is encoded faster by its own operator.)
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rolloom.functions.helpers import chat_text


@lru_cache(2)
def _tokenizer(path: str):
    """The tokenizer of a worker process, read once."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their writings in a text are ordinary text
    return tokenizer


def token_ids(text: Column, path: str) -> Column:
    """Ids without special tokens; null and empty texts have none."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            made = _tokenizer(path).encode_batch(["" if pd.isna(x) else x for x in s], add_special_tokens=False)
            yield pd.Series([e.ids for e in made], dtype=object)

    return encode(text)


def decoded(ids: Column, path: str) -> Column:
    """The text of ids; a null list has none."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else _tokenizer(path).decode([int(i) for i in x], skip_special_tokens=False))

    return decode(ids)


def rendered(conversation: Column, path: str) -> Column:
    """Struct of a conversation's text, open for the assistant's turn, and its ids."""
    text = chat_text(conversation)
    return F.struct(text.alias("text"), token_ids(text, path).alias("ids"))

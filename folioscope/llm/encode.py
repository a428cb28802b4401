"""Encoding of texts with a public byte-level BPE from a local rank file.

Ids of null and empty texts are the empty list; null stays null only in decode. Texts are encoded whole: long ones are cut
at boundaries where the pre-splitting pattern cuts anyway, so their pieces' ids joined are the ids of the text.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import spread

#: Folder of the vocabulary files; the package public_tokenizers beside them names the pre-splitting pattern.
TOKENIZERS = os.environ.get("FOLIOSCOPE_TOKENIZERS", "/opt/tokenizers")
#: The pre-splitting pattern of the byte-level vocabularies (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A text longer than this is cut before it is encoded; a stretch without a safe boundary is never cut.
CHUNK = 1 << 16
#: Where every split falls apart: between visible text and one blank before visible text, or between a letter and a digit.
SAFE = regex.compile(r"(?<=\S)(?= \S)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}])")


def rank_file(name: str, folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tiktoken encoding of a rank file, one per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """Pieces of a text, cut at the first safe boundary after every `size` characters."""
    start = 0
    while len(text) - start > size:
        m = SAFE.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def _whole(text: str) -> str:
    """Lone surrogates, which UTF-8 can't hold, as the replacement character."""
    return text.encode("utf-8", "replace").decode("utf-8") if re.search("[\ud800-\udfff]", text) else text


def ids_of(text: str | None, path: str) -> list[int]:
    if not text:
        return []
    enc, text = encoding(path), _whole(text)
    if len(text) <= CHUNK:
        return enc.encode_ordinary(text)
    return [i for piece in chunks(text) for i in enc.encode_ordinary(piece)]


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids ARRAY<INT>) of every row, rows of a key that repeats included: texts are not shuffled unless the input has too few partitions."""
    path = rank_file(tokenizer, folder)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([ids_of(t, path) for t in texts], index=texts.index, dtype=object)

    return spread(documents.select(key, text)).select(key, ids(text).alias("ids"))


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, n_tokens BIGINT) of every row, without keeping the ids."""
    path = rank_file(tokenizer, folder)

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(ids_of(t, path)) for t in texts], index=texts.index, dtype="int64")

    return spread(documents.select(key, text)).select(key, count(text).alias("n_tokens"))


def decode(encoded: DataFrame, key: str = "doc_id", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, raw BINARY, text) from ids: the bytes of the tokens joined, then read as UTF-8. Null ids give nulls; an id outside the vocabulary gives nulls."""
    path = rank_file(tokenizer, folder)

    @F.pandas_udf("binary")
    def raw(ids: pd.Series) -> pd.Series:
        enc = encoding(path)

        def one(row):
            try:
                return None if row is None else b"".join(enc.decode_single_token_bytes(int(i)) for i in row)
            except KeyError:
                return None

        return pd.Series([one(r) for r in ids], index=ids.index, dtype=object)

    return encoded.select(key, raw("ids").alias("raw")).withColumn("text", F.decode("raw", "UTF-8"))

"""Token ids of documents by a public byte-level vocabulary, cut into pieces."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from .common import text_or_empty

#: Tokens of a sequence, and the id that ends a document.
SEQUENCE, END = 2048, 0


def _fast(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken")) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def byte_tokens(vocabulary: str):
    """text -> list of ids, special tokens' strings being plain text, and the bytes of every id."""
    fast, ranks = _fast(vocabulary)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    return fast.encode_ordinary, tokens


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """text -> ids of ``vocabulary``.json.

    Texts go through the same vocabulary's rank file, whose ids are the same (tested) at a fifth of the
    time; texts with the special token's string go through the tokenizer itself.
    """
    import public_tokenizers
    from tokenizers import Tokenizer

    fast, _ = _fast(vocabulary)
    whole = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))

    def encode(text: str) -> np.ndarray:
        if "<|endoftext|>" in text:
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all of ``size`` but for the first, which holds the rest."""
    first = n % size or min(n, size)
    return [(0, first), *((at, size) for at in range(first, n, size))]


def pieces(docs: DataFrame, size: int = SEQUENCE, vocabulary: str = "byte_bpe_50k", payload: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's ids with the end id after them.

    Null texts count as empty: one piece of the end id. ``ids`` is little-endian unsigned 16-bit,
    compressed by zstandard.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * payload

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary)
        packed = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                ids = np.append(encode(text), np.uint32(END))
                for k, (start, length) in enumerate(cuts(len(ids), size)):
                    own = ids[start : start + length].astype("<u4")
                    if payload and len(own) and own.max() > 65_535:
                        raise ValueError(f"{vocabulary} has ids that 16 bits don't hold")
                    row = (doc if doc == doc else None, k, start, length, zlib.crc32(own.tobytes()))
                    rows.append((*row, packed(own.astype("<u2").tobytes())) if payload else row)
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + payload]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(run, schema)

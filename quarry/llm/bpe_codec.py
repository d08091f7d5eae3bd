"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are cut at safe boundaries before encoding: at a single space between two characters that aren't
white space. No alternative of the split pattern runs from a non-space into a space, and each one that may begin
with a space begins there, so the pieces' matches joined are the whole text's. A text without such a place is
encoded whole. Special tokens are not recognised. Decoding joins the tokens' raw bytes.

Defined results: a null text is the empty text (no tokens). Lone surrogates cannot occur in Spark strings.
Repeated rows are encoded one by one; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import as_text, carried, read_table, restored, sliced, trimmed

#: Characters after which a text is cut at the next safe boundary.
PIECE = 1 << 16
#: Documents whose ids are handed over at a time.
ROWS = 256
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """The library's encoder, with the bytes and the decimal digits of each id; one per worker process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    enc = tiktoken.Encoding("quarry", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    top = max(ranks.values()) + 1
    raw = [b""] * top
    for token, rank in ranks.items():
        raw[rank] = token
    return enc, raw, [b"%d" % i for i in range(top)]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    start = 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(text: str, path: str | None = None, size: int = PIECE) -> list[int]:
    enc = encoder(path or rank_file())[0]
    out: list[int] = []
    for piece in pieces(text, size):
        out += enc.encode_ordinary(piece)
    return out


def decode(ids: list[int], path: str | None = None) -> bytes:
    raw = encoder(path or rank_file())[1]
    return b"".join(map(raw.__getitem__, ids))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>): the documents' token ids, for writing out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"i": b["i"], "ids": [encode(as_text(t), path) for t in b["t"]]})

    return restored(_two(docs, id_col, text_col).mapInPandas(run, "i string, ids array<int>"), docs, id_col)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, bytes binary): raw bytes of the ids; null ids are none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"i": b["i"], "bytes": [decode(list(x) if x is not None else [], path) for x in b["t"]]})

    return restored(_two(encoded, id_col, ids_col).mapInPandas(run, "i string, bytes binary"), encoded, id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode, decode the ids again, and keep counts and digests, and on demand the ids (array<int>)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digits = encoder(path or rank_file())[2]
        for b in sliced(batches, ROWS):
            rows, kept = [], []
            for t in b["t"]:
                ids = encode(as_text(t), path)
                joined = hashlib.sha256(b",".join(map(digits.__getitem__, ids))).hexdigest()
                rows.append((len(ids), joined, hashlib.sha256(decode(ids, path)).hexdigest()))
                if with_ids:
                    kept.append(np.array(ids, dtype=np.int32))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "i", b["i"].to_numpy())
            yield out.assign(ids=kept) if with_ids else out

    fields = "i string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return restored(_two(docs, id_col, text_col).mapInPandas(trimmed(run), fields), docs, id_col)


def _two(df: DataFrame, id_col: str, col: str) -> DataFrame:
    return df.select(carried(df, id_col), df[col].alias("t"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))

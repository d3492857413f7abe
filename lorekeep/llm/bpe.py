"""Byte-level BPE: overlapping chunks are pre-tokenised on their own, stitched, then encoded piece by piece."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_texts, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Code points in a chunk, and how many of them the next one repeats.
CHUNK, OVERLAP = 32_768, 1_024
#: Rows that are held as token ids at a time.
SLICE = 128
#: Alternatives of the pattern look at most this far beyond a token's start, besides the run they match.
MARGIN = 8


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def starts_of(text: str, begin: int, end: int, pattern: str) -> list[int]:
    """Ends of the pre-tokens of text[begin:end], as positions in text, as far as the cut at end can't change them."""
    limit = end if end == len(text) else end - MARGIN
    return [m.end() for m in _compiled(pattern).finditer(text, begin, end) if m.end() <= limit]


def pieces(text: str, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The text cut where pre-tokens end for certain; encoding each piece encodes the text.

    Chunks are pre-tokenised without knowledge of each other. Two neighbours agree from the first boundary that both
    report inside their overlap, as matching runs from left to right and a boundary fixes all that follows. Without
    such a boundary (one run longer than the overlap) the two chunks become one and are read again.
    """
    if len(text) <= chunk + overlap:
        return [text]
    bounds = [(b, min(len(text), b + chunk + overlap)) for b in range(0, len(text), chunk)]
    out, at, k = [], 0, 0
    left = starts_of(text, *bounds[0], pattern)
    begin = 0
    while k + 1 < len(bounds):
        b, e = bounds[k + 1]
        right = starts_of(text, b, e, pattern)
        shared = next(iter(sorted(set(right).intersection(x for x in left if x > max(b, at)))), None)
        if shared is None:  # no place to stitch: widen the left chunk over the right one
            left = starts_of(text, begin, e, pattern)
        else:
            out.append(text[at:shared])
            at, begin, left = shared, shared, right
        k += 1
    out.append(text[at:])
    return out


def encode(text: str, enc: tiktoken.Encoding, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    ids: list[int] = []
    for piece in pieces(text, pattern, chunk, overlap):
        ids += enc.encode_ordinary(piece)
    return ids


def encode_documents(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids", verify: str | None = None) -> DataFrame:
    """docs with the token ids of each whole text; a null or empty text has none. Rows are independent: no shuffle.

    With verify, a column of that name says whether decoding the ids gives the text's bytes again. Columns of docs
    named like the new ones are replaced.
    """
    docs = docs.drop(ids_col, *([verify] if verify else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = [t or "" for t in part.column(part.schema.get_field_index(text_col)).to_pylist()]
                ids = [np.array(encode(t, enc), dtype=np.int32) for t in texts]
                ends = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                columns = [*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))]
                names = [*part.schema.names, ids_col]
                if verify:
                    columns.append(pa.array([enc.decode_bytes(i.tolist()) == t.encode("utf-8", "surrogatepass") for i, t in zip(ids, texts, strict=True)]))
                    names.append(verify)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())), *([T.StructField(verify, T.BooleanType())] if verify else [])])
    return docs.mapInArrow(run, schema)


def decode_documents(docs: DataFrame, vocabulary: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """docs with the raw bytes of each list of ids joined; a null list gives none."""
    docs = docs.drop(bytes_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                lists = part.column(part.schema.get_field_index(ids_col))
                data = pa.array([enc.decode_bytes(i.values.to_pylist()) if i.is_valid else b"" for i in lists], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, data], names=[*part.schema.names, bytes_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(bytes_col, T.BinaryType())]))


def bpe_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding, then decoding, in one pass without moving the ids."""

    def make():
        enc = encoding(vocabulary)

        def run(texts: list[str]) -> dict[str, list]:
            n, ids_hex, bytes_hex = [], [], []
            for text in texts:
                ids = encode(text, enc)
                n.append(len(ids))
                ids_hex.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                bytes_hex.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            return {"n_tokens": n, "ids_sha256": ids_hex, "decoded_sha256": bytes_hex}

        return run

    return map_texts(docs, make, "n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))

"""Stupid-backoff scores (Brants et al., 2007): counts by hash partition, joined to each document's n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import VOCABULARY, encode, encoding
from .common import cut, table, text_of

#: Factor of a step back, and the count from which a pair of tokens is known.
ALPHA, LEAST = 0.4, 2
#: Pairs of tokens and documents that one hash partition holds, about; code points of a token, at least about.
PAIRS, DOCS, CHARS = 4_000_000, 2_000_000, 2
#: Documents that are packed together.
PACK = 1_024
_UNIGRAMS = -1


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unpack(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=kind)


def _steps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A pair's hash partition."""
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


_PACKED = "bucket int, salt int, kind int, pack long, keys binary, docs binary, counts binary, ids binary"
_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KINDS, strict=True)], names=[x.split()[0] for x in _PACKED.split(", ")])


def explode_pairs(docs: DataFrame, vocabulary: str, buckets: int, salts: int, id_col: str, text_col: str) -> DataFrame:
    """Packed rows: the documents' exploded token pairs by hash partition, summed in each document, and token counts.

    kind 1: distinct pairs of a pack of documents, each with its documents and how often they hold it. kind 2, bucket
    -1: the pack itself, with its ids; how often it holds each token, each document's first token, or -1, and length.
    A pack's number is a hash of its ids: packs of the same ids add up like rows of the same id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        size, salt = enc.n_vocab, 0
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                part = batch.slice(at, PACK)
                ids = np.array([-1 if i is None else i for i in part.column(0).to_pylist()], dtype="<i8")
                named = np.array([i is not None for i in part.column(0).to_pylist()])
                tokens = [np.array(encode(t, enc), dtype=np.int64) for t in part.column(1).to_pylist()]
                n = np.array([len(t) for t in tokens], dtype="<i4")
                flat = np.concatenate(tokens) if tokens else np.empty(0, dtype=np.int64)
                doc = np.repeat(np.arange(len(tokens)), n)
                counts = np.bincount(flat, minlength=1)
                held = np.flatnonzero(counts)
                first = np.array([t[0] if len(t) else -1 for t in tokens], dtype="<i4")
                named_ids = np.concatenate((ids, named.astype("<i8")))
                pack = xxhash.xxh3_64_intdigest(named_ids.tobytes()) - 2**63
                rows = [(_UNIGRAMS, 0, 2, pack, _pack(held.astype("<u4")), _pack(first), _pack(np.concatenate((counts[held].astype("<i8"), n.astype("<i8")))), _pack(named_ids))]
                inside = doc[1:] == doc[:-1] if len(doc) else np.empty(0, dtype=bool)
                pair = (flat[:-1] * size + flat[1:])[inside]
                both, times = np.unique((pair.astype(np.uint64) << np.uint64(16)) | doc[1:][inside].astype(np.uint64), return_counts=True)
                keys, of = (both >> np.uint64(16)).astype("<u8"), (both & np.uint64(0xFFFF)).astype("<u2")
                where = bucket_of(keys, buckets)
                order = np.argsort(where, kind="stable")
                cuts = np.searchsorted(where[order], np.arange(buckets + 1))
                salt = (salt + 1) % salts
                for b in np.flatnonzero(np.diff(cuts)):
                    mine = order[cuts[b] : cuts[b + 1]]
                    rows.append((int(b), salt, 1, pack, _pack(_steps(keys[mine])), _pack(of[mine]), _pack(times[mine].astype("<u4")), None))
                yield _batch(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, _PACKED)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    firsts = np.flatnonzero(np.diff(keys, prepend=np.uint64(2**64 - 1) if len(keys) else keys))
    return keys[firsts], np.add.reduceat(counts[order], firsts) if len(firsts) else counts[:0]


def count_tables(packed: DataFrame, parts: int) -> DataFrame:
    """One packed row (kind 0) of keys and counts for each bucket. Packs are summed before they move and as they come."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for bucket, keys, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                k, c = _summed(np.cumsum(_unpack(keys, "<u8"), dtype=np.uint64), _unpack(counts, "<u4").astype("<i8"))
                rows.append((bucket, 0, 0, None, _pack(_steps(k)), None, _pack(c), None))
            yield _batch(rows)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts, held = None, [], [], 0
        fold = lambda: _summed(np.concatenate(keys), np.concatenate(counts))
        for batch in batches:
            for bucket, k, c in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), batch.column(6).to_pylist(), strict=True):
                if bucket != now and now is not None:
                    a, b = fold()
                    yield _batch([(now, 0, 0, None, _pack(_steps(a)), None, _pack(b), None)])
                    keys, counts, held = [], [], 0
                now = bucket
                keys.append(np.cumsum(_unpack(k, "<u8"), dtype=np.uint64))
                counts.append(_unpack(c, "<i8"))
                held += len(keys[-1])
                if held > PAIRS:
                    a, b = fold()
                    keys, counts, held = [a], [b], 0
        if now is not None:
            a, b = fold()
            yield _batch([(now, 0, 0, None, _pack(_steps(a)), None, _pack(b), None)])

    small = packed.where("kind = 1").select("bucket", "keys", "counts").mapInArrow(shrink, _PACKED)
    return small.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(merge, _PACKED)


def lm_score(docs: DataFrame, vocabulary: str, alpha: float = ALPHA, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, logprob (natural log, all tokens), score (logprob a token; 0 without tokens).

    Tokens are those of the public byte-level vocabulary, so single counts are bounded by its size and are broadcast.
    S(b | a) = c(ab) / c(a) if the pair ab is known (at least `least` times in the corpus), else alpha c(b) / N; a
    document's first token scores c / N. Counts cover all documents. Null texts are empty; rows of one id are one
    document, whose sums add up; rows without an id are counted, not scored; no rows give no rows.

    Pairs are packed by hash partition (bucket). Each pack is summed before it is sent, so a frequent pair is one entry
    a pack in the count tables, and an entry a document at most in the join, whose packs a salt spreads; the count table of
    a bucket is sent to each of its salts. What a pack's documents score in a bucket goes back to the pack as one row. Buckets and salts grow with the corpus, so what a task holds does not.
    """
    chars, rows = docs.agg(F.sum(F.length(text_of(text_col)).cast("long")), F.count("*")).first()
    buckets = max(128, -(-(chars or 0) // (CHARS * PAIRS)))
    salts = max(1, -(-rows // DOCS))
    packed = cut(explode_pairs(docs, vocabulary, buckets, salts, id_col, text_col))
    size = encoding(vocabulary).n_vocab

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k = _unpack(keys, "<u4")
                total[k] += _unpack(counts, "<i8")[: len(k)]
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["token", "n"])

    single = packed.where("kind = 2").select("keys", "counts").mapInArrow(tokens, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    count = np.zeros(size, dtype=np.int64)
    for row in single.collect():  # a number for each token of the vocabulary
        count[row["token"]] = row["n"]
    sent = docs.sparkSession.sparkContext.broadcast(count)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    tables = count_tables(packed, parts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(packed.columns)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c1 = sent.value
        with np.errstate(divide="ignore"):
            log1 = np.log(c1)
        log_n, back = np.log(max(1, int(c1.sum()))), np.log(alpha)
        now, known, counts = None, np.empty(0, dtype=np.uint64), np.empty(0)
        for batch in batches:
            rows = []
            for bucket, salt, kind, pack, keys, of, times, _ in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if kind == 0:
                    now, known, counts = (bucket, salt), np.cumsum(_unpack(keys, "<u8"), dtype=np.uint64), _unpack(times, "<i8")
                    keep = counts >= least
                    known, counts = known[keep], np.log(counts[keep])
                    continue
                if now != (bucket, salt):
                    raise RuntimeError(f"no counts for bucket {bucket}")
                k = np.cumsum(_unpack(keys, "<u8"), dtype=np.uint64)
                a, b = (k // np.uint64(size)).astype(np.int64), (k % np.uint64(size)).astype(np.int64)
                s = back + log1[b] - log_n
                if len(known):
                    at = np.minimum(np.searchsorted(known, k), len(known) - 1)
                    hit = known[at] == k
                    s[hit] = counts[at[hit]] - log1[a[hit]]
                docs, at = np.unique(_unpack(of, "<u2"), return_inverse=True)
                rows.append((bucket, salt, 3, pack, None, _pack(docs), _pack(np.bincount(at, s * _unpack(times, "<u4"))), None))
            yield _batch(rows)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c1 = sent.value
        log_n = np.log(max(1, int(c1.sum())))
        now, ids, named, total, length = None, None, None, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids[named]), pa.array(total[named]), pa.array(length[named])], names=["doc_id", "logprob", "n_tokens"])

        for batch in batches:
            for kind, pack, keys, docs, counts, packed_ids in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if pack != now:
                    if now is not None:
                        yield out()
                    both = _unpack(packed_ids, "<i8")
                    now, ids, named = pack, both[: len(both) // 2], both[len(both) // 2 :] > 0
                    total, length = np.zeros(len(ids)), np.zeros(len(ids), dtype=np.int64)
                if kind == 2:
                    first = _unpack(docs, "<i4")
                    total += np.where(first >= 0, np.log(np.maximum(c1[np.maximum(first, 0)], 1)) - log_n, 0.0)
                    length += _unpack(counts, "<i8")[len(_unpack(keys, "<u4")) :]
                else:
                    total[_unpack(docs, "<u2")] += _unpack(counts, "<f8")
        if now is not None:
            yield out()

    joined = tables.union(packed.where("kind = 1")).repartition(parts, "bucket", "salt").sortWithinPartitions("bucket", "salt", "kind").mapInArrow(score, _PACKED)
    whole = joined.union(packed.where("kind = 2")).select("kind", "pack", "keys", "docs", "counts", "ids")
    each = whole.repartition(parts, "pack").sortWithinPartitions("pack", "kind").mapInArrow(gather, "doc_id long, logprob double, n_tokens long")
    total = each.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.round(F.sum("logprob"), 6).alias("logprob"))
    return total.withColumn("score", F.when(F.col("n_tokens") > 0, F.round(F.col("logprob") / F.col("n_tokens"), 9)).otherwise(0.0))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))

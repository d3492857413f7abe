"""Near-duplicates by SimHash with deletion-variant signatures."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, dealt_anew, map_texts, small_side, table, text_of
from .components import components

SEED = 42
BITS = 64
#: Kinds of signatures at most.
KINDS = 32
#: Minima per document and per band, and bands that two texts must share to be compared before the exact join.
MINIMA, ROWS, MET = 64, 4, 4
#: Cells that count shingles by hash, and how many of them a row holds while they are added up.
COUNTS, CELLS = 2**20, 2**14
#: Bits of the filter that marks shingles of several groups; where they don't suffice, more shingles are shuffled.
FILTER = 2**26
#: Words of that filter that travel together.
BLOCK = 2**14
_A = np.random.default_rng(7).integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of words that are hashed together, and the numbers of that: for each byte, powers of an odd base and of its inverse.
SPAN = 2**16
_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_POWER = np.multiply.accumulate(np.full(SPAN, _BASE, dtype=np.uint64))
_INVERSE = np.multiply.accumulate(np.full(SPAN, pow(_BASE, -1, 2**64), dtype=np.uint64))
_NONE = np.zeros(1, dtype=np.uint64)
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each run of words (A-Z lower-cased, space-joined), repeats included; fewer words: of all; none: empty."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)], dtype=np.uint64)
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 without hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 16_384):
        block = hashes[at : at + 16_384].astype(">u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def make() -> Callable[[list[str]], dict[str, list]]:
        return lambda texts: {"fp": [signed(fingerprint(shingle_hashes(t, words))) for t in texts]}

    return map_texts(docs, make, "fp long", id_col, text_col)


def segments(bits: int, take: int = 1) -> list[tuple[int, int]]:
    """Segments of which any two fingerprints that differ in `bits` bits share `take`, but for one bit in all of these."""
    n = next(n for n in range(take, BITS) if n >= take + bits - 1 and 2 * (n - take + 1) > bits) if take > 1 else bits // 2 + 1
    cuts = [BITS * k // n for k in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def signatures(bits: int, classes: int) -> list[tuple[tuple[int, int], ...]]:
    """The segments of each kind of signature: one, two or three, as few as make more keys than there are classes.

    With keys of at least log2(classes) bits a key is shared by a few classes, so that pairs to verify grow with the classes.
    No more than KINDS kinds are made: each is a part of the join's condition.
    """
    for take in range(1, 4):
        parts = segments(bits, take)
        if take > 1 and math.comb(len(parts), take) > KINDS:
            break
        kinds = list(combinations(parts, take))
        if (BITS * take // len(parts)) - 1 >= math.log2(max(classes, 2)):
            break
    return kinds


def mask_of(kind: tuple[tuple[int, int], ...]) -> int:
    return sum(2**hi - 2**lo for lo, hi in kind)


def variant_keys(fp: Column, kinds: list[tuple[tuple[int, int], ...]]) -> Column:
    """A key for each wildcard: its number above, the other bits of the kind's segments, side by side, below.

    Two fingerprints that are equal in a kind's segments share its keys, two that differ there in one bit share the key of that bit.
    """
    keys, number = [], 0
    for kind in kinds:
        held, at = F.lit(0), 0
        for lo, hi in kind:
            held = held.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit(2 ** (hi - lo) - 1)), at))
            at += hi - lo
        for bit in range(at):
            keys.append(F.lit(number << 48).bitwiseOR(held.bitwiseAND(F.lit(2**at - 1 - 2**bit))))
            number += 1
    return F.array(*keys)


def fingerprint_links(fps: DataFrame, bits: int, classes: int | None = None) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) that differ in at most `bits` bits (2 to 60), each once.

    The signature join is an equality join that checks the distance as it goes, and takes a pair only at its first
    shared key (the first kind in whose segments at most one bit differs; its first wildcard if none does): only links
    leave the join, each once. Spark splits its hot keys. classes, if known, says how many rows fps has.
    """
    if not 2 <= bits <= 60:
        raise ValueError("bits is 2 to 60")
    kinds = signatures(bits, fps.count() if classes is None else classes)
    dealt = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few rows, many keys each
    keyed = dealt.select("fp", F.explode(variant_keys(F.col("fp"), kinds)).alias("key"))
    a, b = (keyed.select(F.col("fp").alias(side), F.col("key").alias(f"key_{side}")) for side in "ab")
    # the number is asked of both sides: a filter on one of them alone would make two exchanges of what is one
    differ, number = F.col("a").bitwiseXOR(F.col("b")), F.shiftrightunsigned(F.greatest("key_a", "key_b"), 48)
    near = (F.col("a") < F.col("b")) & (F.bit_count(differ) <= bits)
    first, earlier, begin = F.lit(False), F.lit(True), 0
    for kind in kinds:
        here, size = differ.bitwiseAND(F.lit(signed(mask_of(kind)))), mask_of(kind).bit_count()
        first = first | (number.between(begin, begin + size - 1) & earlier & ((here != 0) | (number == begin)))
        earlier, begin = earlier & (F.bit_count(here) > 1), begin + size
    return a.join(b.hint("merge"), (F.col("key_a") == F.col("key_b")) & near & first).select("a", "b")


def simhash_components(docs: DataFrame, words: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id for every row.

    Words are runs without ASCII white space after lower-casing A-Z; a null or empty text has fingerprint zero and
    links like any other. component_id is the smallest id reachable over links, the row's own included; a row with a
    null id takes part as text and gets its class's component. Repeated rows come back as often. Copies share a
    fingerprint, so a group of any size is one class: links are sought between classes only.
    """
    rows = cut(fingerprints(docs, words, id_col, text_col))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = fingerprint_links(classes.select("fp"), bits)
    of = components(links)
    named = classes.join(of, classes["fp"] == of["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    member = named.select("fp", "component").join(least, "component").select("fp", "component_id")
    return rows.join(member.withColumn("fp", dealt_anew(F.col("fp"))), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


# Similarity of word shingles: SimHash and MinHash bands link most pairs, prefixes of rare shingles all that these leave apart.


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the runs without ASCII white space: polynomials of their bytes, from running sums over whole spans."""
    held = np.frombuffer(data, dtype=np.uint8)
    edges = np.flatnonzero(np.diff((~_BLANK[held]).view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    out, k = np.empty(len(starts), dtype=np.uint64), 0
    while k < len(starts):
        last = max(k + 1, int(np.searchsorted(ends, starts[k] + SPAN, side="right")))
        lo, hi = int(starts[k]), int(ends[last - 1])
        if hi - lo > SPAN:  # a single long word
            out[k] = xxhash.xxh64_intdigest(data[lo:hi], SEED)
        else:
            sums = np.concatenate((_NONE, np.cumsum(_BYTE[held[lo:hi]] * _POWER[: hi - lo], dtype=np.uint64)))
            out[k:last] = (sums[ends[k:last] - lo] - sums[starts[k:last] - lo]) * _INVERSE[starts[k:last] - lo]
        k = last
    return _mixed(out ^ (ends - starts).astype(np.uint64) * _A[0])


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct shingles of a text (A-Z lower-cased; fewer words: all of them), by 64-bit hashes that its words' hashes give, in order."""
    h = word_hashes(text.encode("utf-8", "surrogatepass").lower())
    if not len(h):
        return h
    run = min(words, len(h))
    out = np.full(len(h) - run + 1, run, dtype=np.uint64)
    for k in range(run):
        out += h[k : len(h) - run + k + 1] * _A[k % MINIMA]
    out = np.sort(_mixed(out))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of MINIMA hash functions over the shingles."""
    out = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4_096):
        out = np.minimum(out, (hashes[at : at + 4_096, None] * _A).min(axis=0))
    return out


_SKETCH = "doc_id long, key binary, fp long, bands array<long>, cells int, counts binary"


def _sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each text (key: its shingle set), and, with a null key, how many texts of a task hold the shingles of each cell."""
    from pyspark.sql.pandas.types import to_arrow_schema

    form = to_arrow_schema(docs.sparkSession.createDataFrame([], _SKETCH).schema)

    def run(batches):
        total = np.zeros(COUNTS, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys, fps, bands = [], [], []
                for t in part.column(1).to_pylist():
                    hashes = shingle_set(t, words)
                    least = minima(hashes)
                    keys.append(xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes()))
                    fps.append(signed(fingerprint(hashes)))
                    bands.append([signed(xxhash.xxh64_intdigest(least[k : k + ROWS].tobytes(), k)) for k in range(0, MINIMA, ROWS)])
                    np.add.at(total, (hashes % np.uint64(COUNTS)).astype(np.int64), 1)
                none = [None] * len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([part.column(0), keys, fps, bands, none, none], form, strict=True)], schema=form)
        cells = range(0, COUNTS, CELLS)
        none = [None] * len(cells)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([none, none, none, none, cells, [_narrow(total[k : k + CELLS]) for k in cells]], form, strict=True)], schema=form)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, _SKETCH)


def _narrow(counts: np.ndarray) -> bytes:
    """The counts in as few bytes each as hold the largest, that number first."""
    size = next(n for n in (1, 2, 4, 8) if int(counts.max(initial=0)) < 256**n)
    return bytes([size]) + counts.astype(f"<u{size}").tobytes()


def _wide(held: bytes) -> np.ndarray:
    return np.frombuffer(held, f"<u{held[0]}", offset=1).astype(np.int64)


def _frequencies(sketches: DataFrame) -> np.ndarray:
    """How many texts hold the shingles of each of COUNTS cells: a table of bounded size, summed in parts."""

    def add(key, rows):
        total = np.zeros(CELLS, dtype=np.int64)
        for x in rows.column("counts").to_pylist():
            total += _wide(x)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([_narrow(total)], pa.binary())], names=["cells", "counts"])

    often = np.zeros(COUNTS, dtype=np.int64)
    for r in sketches.where("key is null").select("cells", "counts").groupBy("cells").applyInArrow(add, "cells int, counts binary").collect():
        often[r["cells"] : r["cells"] + CELLS] = _wide(r["counts"])
    return often


def _agreeing(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, xa, xb) whose sets of shingles have at least that Jaccard similarity."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= least * (len(p) + len(q) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def needed(n: int, similarity: float) -> int:
    """How many of its n shingles a text must share, at least, with any other of that Jaccard similarity."""
    return int(np.ceil(similarity * n - 1e-9))


def _prefixes(docs: DataFrame, often: np.ndarray, words: int, similarity: float, id_col: str, text_col: str, only: np.ndarray | None = None) -> DataFrame:
    """doc_id, n (distinct shingles) and rare (at, shingle): its n - needed + 1 first shingles in one fixed order, that of rising frequency.

    Two texts of that similarity share one of them whatever the order is; frequency, counted in cells by the
    shingle's hash, only keeps passages of many texts out of them. only: bits of the shingles that are wanted at all.
    """
    shared = docs.sparkSession.sparkContext.broadcast((often, only))

    def make() -> Callable[[list[str]], dict[str, list]]:
        often, only = shared.value

        def run(texts: list[str]) -> dict[str, list]:
            sizes, rare = [], []
            for t in texts:
                hashes = shingle_set(t, words)
                count = len(hashes) - needed(len(hashes), similarity) + 1
                how = often[(hashes % np.uint64(COUNTS)).astype(np.int64)]
                order = np.lexsort((hashes, how))[:count]
                at, first = np.arange(len(order)), hashes[order]
                if only is not None:
                    bit = first % np.uint64(FILTER)
                    held = (only[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
                    at, first = at[held], first[held]
                sizes.append(len(hashes))
                rare.append([{"at": i, "shingle": s} for i, s in zip(at.tolist(), first.view(np.int64).tolist(), strict=True)] if only is not None else first.view(np.int64))
            return {"n": sizes, "rare": rare}

        return run

    return map_texts(docs, make, "n int, rare array<struct<at:int,shingle:bigint>>" if only is not None else "n int, rare array<bigint>", id_col, text_col)


def _filter(shingles: DataFrame) -> np.ndarray:
    """FILTER bits, with those of the shingles set, 64 a word: words come to the driver side by side in blocks, not one row each."""

    def pack(key, rows):
        block = np.zeros(BLOCK, dtype=np.uint64)
        block[rows.column("word").to_numpy() % BLOCK] = rows.column("mask").to_numpy().view(np.uint64)
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([block.tobytes()], pa.binary())], names=["block", "bits"])

    bit = F.col("shingle").bitwiseAND(F.lit(FILTER - 1))
    masks = shingles.select(F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("mask"))
    masks = masks.groupBy("word").agg(F.bit_or("mask").alias("mask")).withColumn("block", F.expr(f"word div {BLOCK}"))
    bits = np.zeros(FILTER // 64, dtype=np.uint64)
    for r in masks.groupBy("block").applyInArrow(pack, "block long, bits binary").collect():
        bits[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["bits"], dtype=np.uint64)
    return bits


def prefix_pairs(docs: DataFrame, often: np.ndarray, groups: DataFrame, words: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs a < b of ids in different groups, with every one of that Jaccard similarity among them.

    groups (id, grp) lists the ids that are not a group of their own; a null grp leaves an id out. A first pass sums
    the prefixes' shingles map-side to the ends of the groups that hold each, and sets a bit in a filter of bounded size for
    those of several groups; a second pass emits only shingles with that bit, which few texts have. The join is
    on a shared shingle; at the first one that two texts share, no more can follow in either than remain
    there, so pairs for which that is too few do not leave it. All shingles that the prefixes of a pair share then bound how
    many the texts share, and few pairs are left to be compared in full.
    """
    named = docs.where(F.col(id_col).isNotNull())
    groups = small_side(groups, groups.count())

    def of_groups(first: DataFrame) -> DataFrame:
        return first.join(groups, first["doc_id"] == groups["id"], "left").where("id is null or grp is not null").withColumn("grp", F.coalesce("grp", "doc_id"))

    held = of_groups(_prefixes(named, often, words, similarity, id_col, text_col)).select("grp", F.explode("rare").alias("shingle"))
    mixed = held.groupBy("shingle").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi")
    only = _filter(mixed)
    rare = of_groups(_prefixes(named, often, words, similarity, id_col, text_col, only)).select("doc_id", "grp", "n", F.explode("rare").alias("r"))
    kept = cut(rare.select("r.shingle", F.col("doc_id").alias("id"), "grp", "n", (F.col("n") - F.col("r.at")).alias("remain")))
    a, b = (kept.select("shingle", *(F.col(c).alias(f"{c}_{side}") for c in ("id", "grp", "n", "remain"))) for side in "ab")
    enough = F.least("remain_a", "remain_b") * (1 + similarity) >= similarity * (F.col("n_a") + F.col("n_b")) - 1e-6
    met = a.join(b.hint("merge"), (a["shingle"] == b["shingle"]) & (F.col("id_a") < F.col("id_b")) & (F.col("grp_a") != F.col("grp_b")) & enough)
    pairs = cut(met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct())
    # of the text whose prefix ends first in the order, what isn't shared there is in the other nowhere
    need = F.ceil(similarity * F.max("n") - 1e-9)
    each = cut(kept.groupBy("id").agg(F.collect_list("shingle").alias("rare"), F.max("n").alias("n"), need.alias("need")))
    sides = pairs
    for side in "ab":
        sides = sides.join(each.select(F.col("id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("rare", "n", "need"))), side)
    both = F.size(F.array_intersect("rare_a", "rare_b")) + F.greatest("need_a", "need_b") - 1
    return sides.where(both * (1 + similarity) >= similarity * (F.col("n_a") + F.col("n_b")) - 1e-6).select("a", "b")


def similar_links(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(classes doc_id -> least id of its shingle set, links between least ids whose shingle sets have that Jaccard similarity).

    The links are enough for the groups: any two classes of that similarity are in one component of them. First come
    SimHash links and, for each MinHash band, a star from the smallest and one from the largest id that share it, so
    a bucket of any size gives two edges a member; those that MET bands give go on. What these leave in different
    components meets by its rare shingles (prefix_pairs), which misses no pair. The exact similarity of the sets decides all.
    """
    made = cut(_sketches(docs.where(F.col(id_col).isNotNull()), words, id_col, text_col))
    often, rows = _frequencies(made), made.where("key is not null")
    # a class is one shingle set, by its 128-bit hash; texts with equal sketches only are other classes
    classes = cut(rows.groupBy("key").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("fp", "bands"))))
    member = rows.select("key", "doc_id").join(classes.select("key", "id"), "key").select("doc_id", F.col("id").alias("least"))
    by_fp = cut(classes.groupBy("fp").agg(F.min("id").alias("id")))
    near = fingerprint_links(by_fp.select("fp"), bits)
    near = near.join(by_fp.select(F.col("fp").alias("a"), F.col("id").alias("ia")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("id").alias("ib")), "b")
    same = classes.join(by_fp.select("fp", F.col("id").alias("ib")), "fp").where("id <> ib").select(F.col("id").alias("ia"), "ib")
    banded = classes.select("id", F.explode("bands").alias("band"))
    ends = banded.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi")
    met = banded.join(ends.withColumn("band", dealt_anew(F.col("band"))), "band")
    star = met.where("id > lo").select(F.col("lo").alias("ia"), F.col("id").alias("ib")).union(met.where("lo < id and id < hi").select("id", "hi"))
    often_met = star.groupBy("ia", "ib").agg(F.count("*").alias("n")).where(F.col("n") >= MET).select("ia", "ib")
    likely = cut(near.select("ia", "ib").union(same).union(often_met).select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).distinct())

    def make() -> Callable[[list[str]], dict[str, list]]:
        return lambda texts: {"x": [shingle_set(t, words).astype("<u8").tobytes() for t in texts]}

    def exact(pairs: DataFrame, deal: Callable[[Column], Column]) -> DataFrame:
        ids = pairs.select(F.col("a").alias(id_col)).union(pairs.select("b")).distinct()
        n = ids.count()
        sets = map_texts(docs.join(small_side(ids, n), id_col, "left_semi"), make, "x binary", id_col, text_col).dropDuplicates(["doc_id"])
        full = pairs.join(sets.select(deal(F.col("doc_id")).alias("a"), F.col("x").alias("xa")), "a").join(sets.select(deal(F.col("doc_id")).alias("b"), F.col("x").alias("xb")), "b")
        return cut(_agreeing(full, similarity))

    links = exact(likely, dealt_anew)  # stars have hot ends
    of = components(links)
    others = member.where("doc_id <> least").select("doc_id").distinct().join(classes.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
    groups = cut(of.where("node <> component").select(F.col("node").alias("id"), F.col("component").alias("grp")).union(others.select("doc_id", F.lit(None).cast("long"))))
    # few pairs a text are left here: the sets stay where dropping repeated ids put them, and move once
    return member, links.union(exact(cut(prefix_pairs(docs, often, groups, words, similarity, id_col, text_col)), lambda c: c))


def near_dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, of each group of near-duplicates only the one with the smallest id.

    Groups are the components of links at that Jaccard similarity of word shingles. Empty and null texts are one
    group. Rows with a null id stay. Of rows that repeat an id all stay if that id does. Columns are those of docs.
    """
    member, links = similar_links(docs, words, similarity, id_col=id_col, text_col=text_col)
    of = components(links)
    lost = cut(
        member.join(of, member["least"] == of["node"], "left")
        .select("doc_id", F.coalesce("component", "least").alias("stays"))
        .where("doc_id <> stays").select(F.col("doc_id").alias(id_col)).distinct()
    )
    return docs.join(small_side(lost, lost.count()), id_col, "left_anti").select(*docs.columns)

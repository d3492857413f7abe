"""Toxicity: the nearest labelled examples by exact TF-IDF cosine, found through a block-max inverted index."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, drawn, map_texts, small_side, table, text_of

#: Labelled texts that must hold a word, of any class, before it can weigh.
LEAST_DF = 3
#: Labelled examples of the index, at most, and neighbours that vote.
EXAMPLES, K = 6_000, 15
#: Examples of a block. So many words, the most frequent in examples, have their postings as rows of each block.
BLOCK, FREQUENT = 64, 512
#: Texts that are searched at once.
AT_ONCE = 128
#: Examples that calibrate the votes, at most.
CALIBRATE = 3_000
_WORD = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def count_words(rows: DataFrame) -> DataFrame:
    """feature, pos, neg: the labelled texts of each class that hold a word. Each batch is summed before it is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            keys = list(sums[0].keys() | sums[1].keys())
            out = pa.RecordBatch.from_pydict({"feature": pa.array(keys, pa.string()), "neg": pa.array([sums[0][k] for k in keys], pa.int64()), "pos": pa.array([sums[1][k] for k in keys], pa.int64())})
            sums[0].clear(), sums[1].clear()
            return out

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[label].update(set(words_of(text)))
            if len(sums[0]) > 300_000:
                yield flush()
        yield flush()

    counted = rows.select("text", "label").mapInArrow(run, "feature string, neg long, pos long")
    return counted.groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))


@dataclass
class Model:
    """Examples as an inverted index: feature f's postings (place, weight) run from first[f] to first[f + 1]."""

    feature: dict[str, int]
    worth: np.ndarray
    first: np.ndarray
    place: np.ndarray
    weight: np.ndarray
    label: np.ndarray
    ids: np.ndarray
    prior: float
    curve: tuple[np.ndarray, np.ndarray]

    @cached_property
    def blocks(self) -> Blocks:
        """Made where it is used, not sent."""
        return blocks_of(self)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "blocks"}


@dataclass
class Blocks:
    """The index in blocks of examples. row tells a feature's row among the frequent ones, or -1; rows are their weights
    (block, row, place in it) in single precision, most the largest of each block. The postings of the others are read
    whole. Example p's own features and weights, for exact cosines, run from begin[p] to begin[p + 1]."""

    row: np.ndarray
    rows: np.ndarray
    most: np.ndarray
    begin: np.ndarray
    key: np.ndarray
    weight: np.ndarray


def blocks_of(model: Model) -> Blocks:
    sizes, n = np.diff(model.first), -(-len(model.label) // BLOCK)
    frequent = np.sort(np.argsort(-sizes, kind="stable")[:FREQUENT])
    row = np.full(len(sizes), -1)
    row[frequent] = np.arange(len(frequent))
    rows = np.zeros((n, len(frequent), BLOCK), dtype=np.float32)
    at, owner = ranges(model.first[frequent], model.first[frequent + 1]), np.repeat(np.arange(len(frequent)), sizes[frequent])
    rows[model.place[at] // BLOCK, owner, model.place[at] % BLOCK] = model.weight[at]
    order = np.argsort(model.place, kind="stable")
    begin = np.searchsorted(model.place[order], np.arange(len(model.label) + 1))
    return Blocks(row, rows, rows.max(axis=2).T.copy(), begin, np.repeat(np.arange(len(sizes)), sizes)[order], model.weight[order])


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one range after another."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def vector(feature: dict[str, int], worth: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a whole text, in order, and their unit-length weights: (1 + ln tf) by idf and telling."""
    held = {feature[w]: n for w, n in Counter(words_of(text)).items() if w in feature}
    if not held:
        return np.empty(0, dtype=np.int64), np.empty(0)
    keys, n = np.fromiter(held, np.int64, len(held)), np.fromiter(held.values(), np.int64, len(held))
    order = keys.argsort()
    keys, n = keys[order], n[order]
    w = (1 + np.log(n)) * worth[keys]
    return keys, w / math.sqrt(float(w @ w))


def index_of(feature: dict[str, int], worth: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray, int, int]], prior: float) -> Model:
    """vectors: features, weights, label, id."""
    sizes = [len(v[0]) for v in vectors]
    keys = np.concatenate([v[0] for v in vectors]) if vectors else np.empty(0, dtype=np.int64)
    weights = np.concatenate([v[1] for v in vectors]) if vectors else np.empty(0)
    places = np.repeat(np.arange(len(vectors)), sizes)
    order = np.lexsort((places, keys))
    keys, places, weights = keys[order], places[order], weights[order]
    first = np.searchsorted(keys, np.arange(len(feature) + 1))
    field = lambda k: np.array([v[k] for v in vectors], dtype=np.int64)
    line = np.array([0.0, 1.0])
    return Model(feature, worth, first, places, weights, field(2), field(3), prior, (line, line))


def nearest_many(model: Model, queries: list[tuple[np.ndarray, np.ndarray]], k: int = K, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the k examples of largest exact cosine, ties to the smaller place, and the cosines; examples that share nothing are left out.

    The postings of a query's rare words are summed first. A block's upper bound is the largest such sum in it and the
    query weights of frequent words times their block maxima. The blocks of the largest bounds are scored first; then
    all whose bound reaches the k-th best found: the rest can't hold a better one. A block is scored for all queries
    that need it at once, in single precision; examples within its error of the k-th best get their exact cosine.
    """
    none = np.empty(0, dtype=np.int64), np.empty(0)
    if not len(model.label):
        return [none] * len(queries)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), AT_ONCE):
        out += _nearest(model, queries[at : at + AT_ONCE], k, without[at : at + AT_ONCE] if without is not None else [-1] * AT_ONCE)
    return [found if len(keys) else none for (keys, _), found in zip(queries, out, strict=True)]


def nearest(model: Model, keys: np.ndarray, weights: np.ndarray, k: int = K, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """The neighbours of one query, see nearest_many."""
    return nearest_many(model, [(keys, weights)], k, [without])[0]


def _nearest(model: Model, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    b, examples = model.blocks, len(model.label)
    blocks, width = len(b.rows), b.rows.shape[1]
    slack = (width + 8) * 2.0**-22  # twice the error of a sum of so many products that is at most 1
    rare = np.zeros((len(queries), blocks * BLOCK), dtype=np.float32)
    asked = np.zeros((len(queries), width), dtype=np.float32)
    for n, (keys, weights) in enumerate(queries):
        row = b.row[keys]
        asked[n, row[row >= 0]] = weights[row >= 0]
        keys, weights = keys[row < 0], weights[row < 0]
        begin, end = model.first[keys], model.first[keys + 1]
        posts = ranges(begin, end)
        rare[n] = np.bincount(model.place[posts], np.repeat(weights, end - begin) * model.weight[posts], minlength=blocks * BLOCK)
        if without[n] >= 0:
            rare[n, without[n]] = -2.0
    bound = asked @ b.most + rare.reshape(len(queries), blocks, BLOCK).max(axis=2)
    near, last = rare.copy(), max(blocks * BLOCK - k, 0)

    def score(needed: np.ndarray) -> np.ndarray:
        """Adds what frequent words give to the blocks each query needs; the k-th best of each so far."""
        for block in np.flatnonzero(needed.any(axis=0)).tolist():
            who = np.flatnonzero(needed[:, block]) if needed[:, block].mean() < 0.5 else slice(None)
            cut = slice(block * BLOCK, (block + 1) * BLOCK)
            near[who, cut] = rare[who, cut] + asked[who] @ b.rows[block]
        return np.partition(near, last, axis=1)[:, last] - slack

    first = np.zeros(bound.shape, dtype=bool)
    np.put_along_axis(first, np.argpartition(-bound, min(2, blocks - 1), axis=1)[:, :3], True, axis=1)
    least = score(first)
    least = score((bound > 0) & (bound + slack >= least[:, None]) & ~first)
    whole, out = np.zeros(len(model.worth)), []
    for n, (keys, weights) in enumerate(queries):
        found = np.flatnonzero(near[n, :examples] > 0 if least[n] <= 0 else near[n, :examples] >= least[n])
        whole[keys] = weights
        begin, end = b.begin[found], b.begin[found + 1]
        own = ranges(begin, end)
        cosine = np.bincount(np.repeat(np.arange(len(found)), end - begin), whole[b.key[own]] * b.weight[own], minlength=len(found))
        whole[keys] = 0.0
        best = np.lexsort((found, -cosine.round(9)))[:k]
        out.append((found[best], cosine[best]))
    return out


def vote(model: Model, places: np.ndarray, cosines: np.ndarray) -> float:
    """The share of toxic neighbours, weighted by squared cosine, with the prior as one vote of a cosine of 0.1."""
    w = cosines**2
    return float(((w * model.label[places]).sum() + 0.01 * model.prior) / (w.sum() + 0.01))


def isotonic(x: np.ndarray, y: np.ndarray, prior: float, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps of the mean label by vote (pool adjacent violators), as points for interpolation."""
    order = np.argsort(x, kind="stable")
    weight = np.ones(len(x)) if weight is None else weight
    pools: list[list[float]] = []
    for a, b, w in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        pools.append([b * w, w, a, a])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, _, hi = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = hi
    xs, ys = [0.0], [0.0]
    for s, n, lo, hi in pools:
        p = (s + prior) / (n + 1)
        for a in (lo, hi):
            if a > xs[-1]:
                xs.append(a)
                ys.append(max(p, ys[-1]))
    return np.append(xs, 1.0 + 1e-9), np.append(ys, max(ys[-1], 1 - 1e-9 if not pools else ys[-1]))


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """An index over a bounded sample of the labelled rows, by words that all labelled rows weigh; None without any label.

    The sample is the examples whose ids hash lowest, half of its places for each class. Every word of the sample that
    LEAST_DF labelled texts hold, and toxic ones more often than the others, is a feature; its weight is its idf times the
    deviations by which it is more common. Examples of equal vectors and labels are one. Each example's vote without itself
    calibrates the scores, weighed by the true share of its class.
    """
    said = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    said = cut(said)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).join(small_side(said, said.count()), "doc_id").select("doc_id", "text", "label")
    rows = rows.where(where) if where is not None else rows
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos + neg:
        return None
    half = EXAMPLES // 2
    drawn_rows = [rows.where((F.col("label") == label) & drawn(F.col("doc_id"), "toxic", half, n.get(label, 0))).withColumn("h", F.xxhash64("doc_id", F.lit("example"))).orderBy("h", "doc_id").limit(half) for label in (0, 1)]
    sample = cut(drawn_rows[0].union(drawn_rows[1]).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = {w for t in batch.column(0).to_pylist() for w in words_of(t)}
            yield pa.RecordBatch.from_pydict({"feature": pa.array(sorted(held), pa.string())})

    known = sample.select("text").mapInArrow(distinct, "feature string").distinct()
    a, b = (F.col("pos") + 0.5) / (pos + 1), (F.col("neg") + 0.5) / (neg + 1)
    df = F.col("pos") + F.col("neg")
    share = (df + 1) / (pos + neg + 2)
    telling = (a - b) / F.sqrt(share * (1 - share) * (1 / (pos + 1) + 1 / (neg + 1)))
    weighed = count_words(rows).where(df >= LEAST_DF).select("feature", (telling * (F.log((pos + neg + 1) / (df + 1)) + 1)).alias("worth")).where("worth > 0")
    chosen = sorted((r["feature"], r["worth"]) for r in weighed.join(known, "feature", "left_semi").collect())
    feature, worth = {w: k for k, (w, _) in enumerate(chosen)}, np.array([x for _, x in chosen])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [vector(feature, worth, t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array([k.tolist() for k, _ in made], pa.list_(pa.int32())), pa.array([w.tolist() for _, w in made], pa.list_(pa.float64()))],
                names=["h", "doc_id", "label", "keys", "weights"],
            )

    got = sorted(sample.select("h", "doc_id", "text", "label").mapInArrow(run, "h long, doc_id long, label int, keys array<int>, weights array<double>").collect(), key=lambda r: (r["h"], r["doc_id"]))
    merged: dict[tuple, int] = {}
    for r in got:
        if r["keys"]:
            merged.setdefault((tuple(r["keys"]), tuple(r["weights"]), r["label"]), r["doc_id"])
    model = index_of(feature, worth, [(np.array(k), np.array(w), y, i) for (k, w, y), i in merged.items()], pos / (pos + neg))
    x, y = [], []
    place = {key: at for at, key in enumerate(merged)}
    tried = got[:CALIBRATE]
    asked = [(np.array(r["keys"], dtype=np.int64), np.array(r["weights"])) for r in tried]
    own = [place.get((tuple(r["keys"]), tuple(r["weights"]), r["label"]), -1) for r in tried]
    for r, found in zip(tried, nearest_many(model, asked, without=own), strict=True):  # each without itself
        x.append(vote(model, *found))
        y.append(r["label"])
    taken = Counter(y)
    model.curve = isotonic(np.array(x), np.array(y, dtype=float), model.prior, np.array([n[k] / taken[k] for k in y]) * len(y) / (pos + neg))
    return model


def score_texts(model: Model | None, texts: list[str], memo: dict[bytes, tuple]) -> list[tuple[float, list[int], list[float]]]:
    """For each text its calibrated score, the ids of the examples that voted and their cosines."""
    if model is None:
        return [(0.0, [], [])] * len(texts)
    made = [vector(model.feature, model.worth, t) for t in texts]
    names = [keys.tobytes() + weights.tobytes() for keys, weights in made]
    if len(memo) > 20_000:
        memo.clear()
    new = {name: v for name, v in zip(names, made, strict=True) if name not in memo}
    for name, (places, cosines) in zip(new, nearest_many(model, list(new.values())), strict=True):
        raw = vote(model, places, cosines) if len(places) else 0.0
        memo[name] = (float(np.interp(raw, *model.curve)), model.ids[places].tolist(), cosines.round(6).tolist())
    return [memo[name] for name in names]


def score_documents(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, evidence (ids of the voting examples), cosines for every row.

    Whole texts are read; a null or empty text, or one without any learned feature, has no neighbours and scores as
    the curve at zero. Without labels nothing was learned and every score is 0. The index is bounded by its
    parameters and broadcast; rows are independent.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list[str]], dict[str, list]]:
        memo: dict[bytes, tuple] = {}

        def run(texts: list[str]) -> dict[str, list]:
            made = score_texts(sent.value, texts, memo)
            return {"score": [m[0] for m in made], "evidence": [m[1] for m in made], "cosines": [m[2] for m in made]}

        return run

    return map_texts(docs, make, "score double, evidence array<bigint>, cosines array<double>", id_col, text_col)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return score_documents(docs, model).select(
        "doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence", "cosines"
    )

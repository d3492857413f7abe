"""Language ID: a byte convolutional network trained in numpy, applied to batches of fixed-length windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, drawn, map_texts, table, text_of

WINDOW = 192
#: Filters of each width, and the size of a byte's vector.
WIDTHS, FILTERS, DIM = (2, 3, 4), 8, 8
#: Labelled documents to fit on, at most, taken by the hash of their id; windows of each; passes over them.
SAMPLE, WINDOWS_EACH, EPOCHS = 4_000, 2, 10
#: Places of a sampled text, drawn by hash over its whole length, that windows are taken from.
PLACES = 3
_LETTER = regex.compile(r"\p{L}")
REACH = max(WIDTHS)


@dataclass
class Network:
    """emb: bytes to vectors; conv: all filters as one matrix over REACH bytes, zero beyond a filter's width."""

    classes: list[str]
    emb: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    out: np.ndarray

    def pooled(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The patches, the maximum of each filter over a window's bytes, and where it is."""
        n, size = windows.shape
        padded = np.zeros((n, size + REACH - 1), dtype=np.uint8)
        padded[:, :size] = windows
        vectors = self.emb[padded].reshape(n, -1)
        patches = np.lib.stride_tricks.sliding_window_view(vectors, REACH * DIM, axis=1)[:, ::DIM]
        patches = np.ascontiguousarray(patches).reshape(-1, REACH * DIM)
        made = (patches @ self.conv).reshape(n, size, -1)
        short = lengths < size
        if short.any():
            made[short] = np.where((np.arange(size) < lengths[short, None])[:, :, None], made[short], -1e9)
        return patches, made.max(axis=1), made

    def scores(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        _, top, _ = self.pooled(windows, lengths)
        logits = np.maximum(top + self.bias, 0) @ self.dense + self.out
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True)


def windows_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All of data in windows of WINDOW bytes, the last one padded, and the bytes each holds."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    lengths = np.full(n, WINDOW, dtype=np.int64)
    lengths[-1] = max(1, len(data) - (n - 1) * WINDOW)
    return out.reshape(n, WINDOW), lengths


def train(texts: list[str], langs: list[str], seed: int = 11) -> Network | None:
    """Softmax cross-entropy, plain Adam, numpy only; None without any labelled text."""
    classes = sorted(set(langs))
    if not classes:
        return None
    rng = np.random.default_rng(seed)
    rows, lengths, labels = [], [], []
    for text, lang in zip(texts, langs, strict=True):
        w, n = windows_of(text.encode("utf-8", "surrogatepass"))
        for i in rng.permutation(len(w))[:WINDOWS_EACH]:
            rows.append(w[i])
            lengths.append(n[i])
            labels.append(classes.index(lang))
    x, lens, y = np.array(rows), np.array(lengths), np.array(labels)
    weight = len(y) / (len(classes) * np.maximum(np.bincount(y, minlength=len(classes)), 1))
    f = FILTERS * len(WIDTHS)
    mask = np.concatenate([np.repeat((np.arange(REACH * DIM) < w * DIM)[:, None], FILTERS, axis=1) for w in WIDTHS], axis=1).astype(np.float32)
    p = {
        "emb": rng.normal(0, 0.5, (256, DIM)), "conv": rng.normal(0, 0.3, (REACH * DIM, f)) * mask, "bias": np.zeros(f),
        "dense": rng.normal(0, 0.3, (f, len(classes))), "out": np.zeros(len(classes)),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            i = order[at : at + 64]
            net = Network(classes, p["emb"], p["conv"], p["bias"], p["dense"], p["out"])
            patches, top, made = net.pooled(x[i], lens[i])
            hidden = np.maximum(top + p["bias"], 0)
            logits = hidden @ p["dense"] + p["out"]
            logits -= logits.max(axis=1, keepdims=True)
            prob = np.exp(logits)
            prob /= prob.sum(axis=1, keepdims=True)
            prob[np.arange(len(i)), y[i]] -= 1
            d = (prob * weight[y[i], None] / len(i)).astype(np.float32)
            g = {"dense": hidden.T @ d, "out": d.sum(axis=0)}
            dh = (d @ p["dense"].T) * (hidden > 0)
            g["bias"] = dh.sum(axis=0)
            where = made.argmax(axis=1)  # only the byte a maximum came from learns
            picked = patches[np.arange(len(i))[:, None] * WINDOW + where]
            g["conv"] = np.einsum("nfk,nf->kf", picked, dh) * mask
            back = np.einsum("nf,kf->nfk", dh, p["conv"]).reshape(-1, REACH, DIM)
            padded = np.pad(x[i], ((0, 0), (0, REACH - 1)))
            seen = padded[np.arange(len(i))[:, None, None], where[:, :, None] + np.arange(REACH)].reshape(-1, REACH)
            g["emb"] = np.zeros_like(p["emb"])
            np.add.at(g["emb"], seen.ravel(), back.reshape(-1, DIM))
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] = (p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return Network(classes, p["emb"], p["conv"], p["bias"], p["dense"], p["out"])


def predict(net: Network | None, texts: list[str], batch: int = 512) -> tuple[list[str], list[float]]:
    """A language and its probability for each whole text: the mean over its windows, by the bytes they hold."""
    known = [net is not None and _LETTER.search(t) is not None for t in texts]
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    owner, rows, lengths = [], [], []
    total = np.zeros((len(texts), len(net.classes) if net else 1))

    def flush() -> None:
        if rows:
            w, n, o = np.concatenate(rows), np.concatenate(lengths), np.concatenate(owner)
            for at in range(0, len(w), batch):
                p = net.scores(w[at : at + batch], n[at : at + batch])
                np.add.at(total, o[at : at + batch], p * n[at : at + batch, None])
            rows.clear(), lengths.clear(), owner.clear()

    held = 0
    for i, text in enumerate(texts):
        if not known[i]:
            continue
        w, n = windows_of(text.encode("utf-8", "surrogatepass"))
        rows.append(w)
        lengths.append(n)
        owner.append(np.full(len(w), i))
        held += len(w)
        if held >= 4 * batch:
            flush()
            held = 0
    flush()
    for i in range(len(texts)):
        if known[i]:
            share = total[i] / total[i].sum()
            langs[i], scores[i] = net.classes[int(share.argmax())], float(share.max())
    return langs, scores


def fit(docs: DataFrame, where: Column | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Train on at most `sample` labelled texts, those whose ids hash lowest; texts without a letter or label are left out."""
    rows = docs.where(F.col(lang_col).isNotNull())
    rows = rows.where(where) if where is not None else rows
    rows = rows.where(drawn(F.col(id_col), "language", sample, rows.count())).where(F.col(text_col).rlike(r"\p{L}"))
    text, size = F.col(text_col), F.length(text_col)
    place = lambda k: F.substring(text, 1 + F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), F.greatest(F.lit(1), size - WINDOW)).cast("int"), WINDOW)
    chosen = rows.select(F.xxhash64(id_col).alias("h"), id_col, F.array(*map(place, range(PLACES))).alias("t"), F.col(lang_col).cast("string").alias("l"))
    got = chosen.orderBy("h", id_col).limit(sample).select("t", "l").collect()
    return train([t for r in got for t in r["t"]], [r["l"] for r in got for _ in r["t"]])


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row; `und` and 0 for a text that is null, empty or without a letter.

    Every byte of a text is read, in windows; other columns don't matter; repeated rows are judged each. Without
    labelled text nothing was learned and every row is `und`. Ties go to the first label in alphabetical order.
    """

    def make() -> Callable[[list[str]], dict[str, list]]:
        def run(texts: list[str]) -> dict[str, list]:
            langs, scores = predict(net, texts)
            return {"lang_pred": langs, "score": scores}

        return run

    return map_texts(docs, make, "lang_pred string, score double", id_col, text_col)


def keep_identified(docs: DataFrame, net: Network | None, floor: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, whose text has a language at a score of floor or more; `und` goes.

    Where nothing was learned no language can be refuted: all texts with a letter stay.
    """
    if net is None:
        return docs.where(text_of(text_col).rlike(r"\p{L}"))

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            langs, scores = predict(net, batch.tolist())
            yield pd.DataFrame({"lang": langs, "score": scores})

    made = F.pandas_udf(run, "lang string, score double")(text_of(text_col))
    judged = docs.select(F.struct(*docs.columns).alias("row"), made.alias("found"))
    return judged.where((F.col("found.lang") != "und") & (F.col("found.score") >= floor)).select("row.*")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs, crc_mod("doc_id", 4) != 2)
    return identify(docs, net).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")

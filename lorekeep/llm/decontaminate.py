"""Benchmark decontamination: BM25 over test items with block-max WAND, then question and answer overlap."""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, dealt_anew, map_texts, small_side, table, text_of

K1, B = 1.2, 0.75
#: Words of a cell; a passage is two cells, the next one starts a cell later, so any run of CELL + 1 words is in one.
CELL = 64
#: A passage is retrieved if it scores this share of what the item itself (its weakest CELL words) scores.
SHARE = 0.6
#: Items of a block, whose largest impact of each term is kept.
BLOCK = 8
#: Verification: runs of GRAM words of the question, of the answer; shares of them that a document must hold.
GRAM, QUESTION, ANSWER = 5, 0.6, 0.6
#: Bytes of a shard of the index, and of the shards that are broadcast together, about; a word of an item takes ITEM_WORD.
SHARD_BYTES, PASS_BYTES, ITEM_WORD = 2**24, 2**26, 400
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_answer(words: list[str]) -> tuple[list[str], list[str]]:
    """An item's first three quarters ask, the rest answers; a short item is all question."""
    at = len(words) - len(words) // 4 if len(words) >= 4 * GRAM else len(words)
    return words[:at], words[at:]


def grams(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + GRAM]) for i in range(max(1, len(words) - GRAM + 1))} if words else set()


@dataclass
class Index:
    """A shard of the inverted index. A term's entries, one for each block of items that holds it, run from entry[t] to
    entry[t + 1]: the block, the largest impact in it, and where its postings (place, impact) begin.

    Items are ordered by threshold, so that the items of a block fail or pass alike. top is the largest impact of each term.
    """

    items: list[int]
    term: dict[str, int]
    entry: np.ndarray
    block: np.ndarray
    block_max: np.ndarray
    first: np.ndarray
    place: np.ndarray
    impact: np.ndarray
    top: np.ndarray
    threshold: np.ndarray
    block_least: np.ndarray
    question: list[set]
    answer: list[set]


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one range after another."""
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def weigh(words: list[str], df: Mapping[str, int], n: int, average: float, share: float) -> tuple[dict[str, float], float]:
    """An item's BM25 impacts by word, and its threshold: that share of what its weakest CELL words score."""
    norm = K1 * (1 - B + B * len(words) / average)
    impact = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + norm) for w, tf in Counter(words).items()}
    own = min(sum(impact[w] for w in set(words[at : at + CELL])) for at in range(0, max(1, len(words) - CELL + 1)))
    return impact, share * own


def build(items: list[tuple[int, list[str]]], share: float = SHARE, df: Mapping[str, int] | None = None, n: int = 0, average: float = 0.0) -> Index | None:
    """The index of some items; df, n and average are those of the whole test set, else these items are all of it.

    Items without a word are left out: nothing can hold them.
    """
    items = [(i, w) for i, w in items if w]
    if not items:
        return None
    if df is None:
        df, n, average = Counter(w for _, words in items for w in set(words)), len(items), sum(len(w) for _, w in items) / len(items)
    made = [(i, words, *weigh(words, df, n, average, share)) for i, words in items]
    made.sort(key=lambda x: (x[3], x[0]))
    term = {w: k for k, w in enumerate(sorted({w for x in made for w in x[2]}))}
    posts = sorted((term[w], at, v) for at, x in enumerate(made) for w, v in x[2].items())
    terms, place, impact = (np.array(x) for x in zip(*posts, strict=True))
    blocks = -(-len(made) // BLOCK)
    cell = terms * blocks + place // BLOCK
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    entry = np.searchsorted(cell[first] // blocks, np.arange(len(term) + 1))
    threshold = np.array([x[3] for x in made])
    parts = [question_answer(x[1]) for x in made]
    return Index(
        [x[0] for x in made], term, entry, cell[first] % blocks, np.maximum.reduceat(impact, first), np.append(first, len(cell)), place, impact,
        np.maximum.reduceat(impact, np.searchsorted(terms, np.arange(len(term)))), threshold, np.minimum.reduceat(threshold, np.arange(0, len(made), BLOCK)),
        [grams(q) for q, _ in parts], [grams(a) for _, a in parts],
    )


def retrieve(index: Index, passage: np.ndarray, terms: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(passage, item place, score) of all items whose BM25 score over a passage's distinct terms reaches their threshold.

    passage and terms are pairs sorted by passage. Block-max WAND for a batch of passages at once. A passage's terms
    are ordered by their largest impact; those before the pivot, where the running sum reaches the least threshold, can't lift an
    item over it alone, so only blocks in the lists of the pivot and of later terms are looked at. Of these only blocks
    whose maxima reach the least threshold inside are scored, in full precision.
    """
    least = float(index.block_least.min()) * (1 - 1e-9)
    if not len(passage):
        return
    order = np.lexsort((index.top[terms], passage))
    terms, upper = terms[order], index.top[terms[order]]
    firsts = np.flatnonzero(np.diff(passage, prepend=-1))
    sums = np.cumsum(upper)
    sums -= np.repeat(sums[firsts] - upper[firsts], np.diff(np.append(firsts, len(passage))))
    after = sums >= least
    blocks = len(index.block_least)

    def opened(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, end = index.entry[terms[some]], index.entry[terms[some] + 1]
        at = ranges(begin, end)
        return at, np.repeat(passage[some], end - begin) * blocks + index.block[at]

    cells = np.unique(opened(np.flatnonzero(after))[1])
    if not len(cells):
        return
    held = np.unique(cells // blocks)
    at, cell = opened(np.flatnonzero(held[np.minimum(np.searchsorted(held, passage), len(held) - 1)] == passage))
    where = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
    mine = cells[where] == cell
    at, where = at[mine], where[mine]
    stands = np.bincount(where, index.block_max[at], minlength=len(cells)) >= index.block_least[cells % blocks] * (1 - 1e-9)
    mine = stands[where]
    at, where = at[mine], where[mine]
    begin, end = index.first[at], index.first[at + 1]
    posts = ranges(begin, end)
    key, group = np.unique(np.repeat(cells[where] // blocks, end - begin) * len(index.items) + index.place[posts], return_inverse=True)
    score = np.bincount(group, index.impact[posts], minlength=len(key)) if len(key) else np.empty(0)
    for j in np.flatnonzero(score >= index.threshold[key % len(index.items)] - 1e-9):
        yield int(key[j] // len(index.items)), int(key[j] % len(index.items)), float(score[j])


def pairs_of(index: Index, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (passage, term) pairs of known words, and the text of each passage."""
    unknown, get = len(index.term), index.term.get
    keys, owner, base = [], [], 0
    for n, words in enumerate(texts):
        count = max(1, -(-len(words) // CELL) - 1)
        ids = np.fromiter((get(w, unknown) for w in words), dtype=np.int64, count=len(words))
        at = np.flatnonzero(ids != unknown)
        ids, cell = ids[at], at // CELL
        last = cell < count
        keys.append((base + cell[last]) * unknown + ids[last])
        before = cell > 0
        keys.append((base + cell[before] - 1) * unknown + ids[before])
        owner.append(np.full(count, n))
        base += count
    key = np.unique(np.concatenate(keys)) if keys else np.empty(0, dtype=np.int64)
    return key // unknown, key % unknown, np.concatenate(owner) if owner else np.empty(0, dtype=np.int64)


def leaks(index: Index, texts: list[list[str]]) -> list[list[tuple[int, float, float, float]]]:
    """For each text's words, (item id, best score, question share, answer share) of the items that it holds."""
    out: list[list[tuple[int, float, float, float]]] = [[] for _ in texts]
    passage, terms, owner = pairs_of(index, texts)
    best: dict[tuple[int, int], float] = {}
    for p, place, score in retrieve(index, passage, terms):
        at = (int(owner[p]), place)
        best[at] = max(best.get(at, 0.0), score)
    held: dict[int, set] = {}
    for (n, place), score in sorted(best.items()):
        mine = held.setdefault(n, grams(texts[n]))
        q, a = index.question[place], index.answer[place]
        qs, as_ = len(q & mine) / len(q), len(a & mine) / len(a) if a else 1.0
        if qs >= QUESTION and as_ >= ANSWER:
            out[n].append((index.items[place], score, qs, as_))
    return out


def weighed_items(benchmark: DataFrame) -> tuple[DataFrame, int, float]:
    """(item_id, text and df of each of its words, number of items, their mean length), over the whole test set.

    Rows without an id or a word are left out, repeated rows are one; equal texts under different ids are items each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))],
                names=["item_id", "text", "length", "words"],
            )

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).where("item_id is not null").distinct()
    items = cut(rows.mapInArrow(run, "item_id long, text string, length long, words array<string>").where("length > 0"))
    n, average = items.agg(F.count("*"), F.avg("length")).first()
    held = items.select("item_id", "text", F.explode("words").alias("word"))
    df = held.groupBy("word").agg(F.count("*").alias("df"))
    return held.join(df.withColumn("word", dealt_anew(F.col("word"))), "word").groupBy("item_id", "text").agg(F.map_from_entries(F.collect_list(F.struct("word", "df"))).alias("df")), n, average or 0.0


def indexes(benchmark: DataFrame, share: float = SHARE) -> Iterator[list[Index]]:
    """Shards of the index over the stated test set, as many at a time as may be broadcast; executors build them."""
    items, n, average = weighed_items(benchmark)
    if not n:
        return
    shards = max(1, math.ceil(n * average * ITEM_WORD / SHARD_BYTES))

    def shard(key, rows):
        data = rows.select(["item_id", "text", "df"]).to_pylist()
        df: dict[str, int] = {}
        for r in data:
            df |= dict(r["df"])
        index = build([(r["item_id"], words_of(r["text"])) for r in data], share, df, n, average)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "index": pa.array([pickle.dumps(index)], pa.binary())})

    made = cut(items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))).groupBy("shard").applyInArrow(shard, "shard long, index binary"))
    held, size = [], 0
    for r in made.orderBy("shard").toLocalIterator():
        if held and size + len(r["index"]) > PASS_BYTES:
            yield held
            held, size = [], 0
        held.append(pickle.loads(r["index"]))
        size += len(r["index"])
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score, question_share, answer_share: one row for each test item that a document holds.

    Every passage of every text is a query. A null or empty text, and an item without words, hold and yield nothing;
    repeated documents are judged each; an empty benchmark gives no rows; equal items under different ids are reported
    each. Statistics are those of the whole test set, so scores don't depend on how it is sharded. The shards go to the executors
    PASS_BYTES at a time, one pass over the documents each; documents are not shuffled.
    """
    out = None
    for some in indexes(benchmark, share):
        sent = docs.sparkSession.sparkContext.broadcast(some)

        def make(sent=sent) -> Callable[[list[str]], dict[str, list]]:
            def run(texts: list[str]) -> dict[str, list]:
                hits: list[list[dict]] = []
                for at in range(0, len(texts), 64):
                    words = [words_of(t) for t in texts[at : at + 64]]
                    each: list[list[dict]] = [[] for _ in words]
                    for index in sent.value:
                        for mine, found in zip(each, leaks(index, words), strict=True):
                            mine += [{"item_id": i, "score": s, "question_share": q, "answer_share": a} for i, s, q, a in found]
                    hits += each
                return {"hits": hits}

            return run

        hits = map_texts(docs, make, "hits array<struct<item_id:bigint,score:double,question_share:double,answer_share:double>>", id_col, text_col)
        found = hits.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
        out = found if out is None else out.union(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, question_share double, answer_share double")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no test item, with the columns of docs; rows with a null id can't be named and stay."""
    bad = cut(find_leaks(docs, benchmark, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias(id_col)).distinct())
    return docs.join(small_side(bad, bad.count()), id_col, "left_anti").select(*docs.columns)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a leak; documents that hold none have no row."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("score", F.round("score", 6))


SQL = r"""
WITH item AS (
  SELECT row_number() OVER () AS i, item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words
  FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark WHERE item_id IS NOT NULL)
), kept AS (SELECT * FROM item WHERE len(words) > 0
), n AS (SELECT count(*) AS items, avg(len(words)) AS average FROM kept
), tf AS (
  SELECT i, len(any_value(words)) AS length, word, count(*) AS tf FROM (SELECT i, words, unnest(words) AS word FROM kept) GROUP BY i, word
), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word
), impact AS (
  SELECT i, word, ln(1 + (items - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average)) AS impact
  FROM tf JOIN df USING (word), n
), span AS (SELECT i, words, unnest(range(0, greatest(1, len(words) - 63))) AS pos FROM kept
), own AS (
  SELECT i, pos, sum(impact) AS own
  FROM (SELECT DISTINCT i, pos, unnest(words[pos + 1 : pos + 64]) AS word FROM span) JOIN impact USING (i, word) GROUP BY i, pos
), bar AS (SELECT i, 0.6 * min(own) AS threshold FROM own GROUP BY i
), doc AS (
  SELECT row_number() OVER () AS d, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words
  FROM documents
), passage AS (
  SELECT DISTINCT d, p, unnest(words[p * 64 + 1 : p * 64 + 128]) AS word
  FROM (SELECT d, words, unnest(range(0, greatest(1, (len(words) + 63) // 64 - 1))) AS p FROM doc)
), best AS (
  SELECT d, i, max(score) AS score
  FROM (SELECT d, p, i, sum(impact) AS score FROM passage JOIN impact USING (word) GROUP BY d, p, i) JOIN bar USING (i)
  WHERE score >= threshold - 1e-9 GROUP BY d, i
), part AS (
  SELECT i, 'q' AS part, CASE WHEN len(words) >= 20 THEN words[: len(words) - len(words) // 4] ELSE words END AS words FROM kept
  UNION ALL SELECT i, 'a', words[len(words) - len(words) // 4 + 1 :] FROM kept WHERE len(words) >= 20
), run AS (
  SELECT DISTINCT i, part, array_to_string(words[pos + 1 : pos + 5], ' ') AS run
  FROM (SELECT i, part, words, unnest(range(0, greatest(1, len(words) - 4))) AS pos FROM part)
), own_run AS (
  SELECT DISTINCT d, array_to_string(words[pos + 1 : pos + 5], ' ') AS run
  FROM (SELECT d, words, unnest(range(0, greatest(1, len(words) - 4))) AS pos FROM doc WHERE d IN (SELECT d FROM best) AND len(words) > 0)
), held AS (
  SELECT d, i, part, count(own_run.run) / count(*) AS held
  FROM best JOIN run USING (i) LEFT JOIN own_run USING (d, run) GROUP BY d, i, part
), shares AS (
  SELECT d, i, max(held) FILTER (part = 'q') AS question_share, coalesce(max(held) FILTER (part = 'a'), 1.0) AS answer_share FROM held GROUP BY d, i
)
SELECT doc_id, item_id, round(score, 6) AS score, question_share, answer_share
FROM shares JOIN best USING (d, i) JOIN doc USING (d) JOIN kept USING (i)
WHERE question_share >= 0.6 AND answer_share >= 0.6
"""

"""Queries over text and ranking, each with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import bigrams, centred_excerpt, dice, hit_excerpt, split_extension, tokens, tsv_field, wiki_key
from ..functions.vocabulary import STOP_WORDS
from ..operators import lexical as L
from ..operators import retrieval as R
from . import derived as D

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _terms(table: str, key: str) -> str:
    return f"SELECT {key} AS id, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+'), lambda x: x NOT IN ({_STOPS}))) AS term FROM {table}"


BM25 = f"""
t AS ({_terms("documents", "doc_id")}), post AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL), len AS (SELECT id, count(*) AS len FROM t GROUP BY id),
stats AS (SELECT (SELECT count(*) FROM documents) AS n, greatest((SELECT count(*) FROM t) / (SELECT count(*) FROM documents), 1.0) AS mean),
q AS (SELECT DISTINCT id AS query, term FROM ({_terms("benchmark", "item_id")})), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
s AS (SELECT q.query, post.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score
      FROM q JOIN post USING (term) JOIN df USING (term) JOIN len ON len.id = post.id CROSS JOIN stats GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank, max(score) OVER (PARTITION BY query) AS best FROM s)
"""


def _queries(spark, d):
    return D.table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(tokens(F.col("text"))).alias("term"))


def _scored(spark, d):
    docs = D.table(spark, d, "documents").select("doc_id", "text")
    return L.search(D.spread(docs), "doc_id", F.col("text"), _queries(spark, d)).withColumn("score", F.round("score", 9))


@query(f"SELECT term, count(*) AS df, sum(tf) AS n FROM (SELECT id, term, count(*) AS tf FROM ({_terms('documents', 'doc_id')}) GROUP BY ALL) GROUP BY term")
def tokens_tf(spark, d):
    """Terms with how many documents hold them and how often."""
    docs = D.spread(D.table(spark, d, "documents").select("doc_id", "text"))
    return L.postings(docs, "doc_id", F.col("text")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


@query(f"WITH {BM25} SELECT query, id, rank, round(round(score, 9), 6) AS score, round(round(score, 9) / round(best, 9), 6) AS norm FROM k WHERE rank <= 20")
def bm25_topk(spark, d):
    """The best documents for every benchmark item's words, normalised by the best score."""
    return L.top(_scored(spark, d), 20).select("query", "id", "rank", F.round("score", 6).alias("score"), F.round("norm", 6).alias("norm"))


@query(f"""WITH {BM25}, m AS (SELECT query, id, rank, row_number() OVER (PARTITION BY query, id % 7 ORDER BY rank) - 1 AS local_rank, id % 7 AS source FROM k WHERE rank <= 20),
src AS (SELECT query, source, row_number() OVER (PARTITION BY query ORDER BY min(rank), source) AS source_rank FROM m GROUP BY query, source),
f AS (SELECT query, id, 1 / (60.0 + source_rank) + 1 / (61.0 + local_rank) AS score FROM m JOIN src USING (query, source))
SELECT query, id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, id) AS n FROM f) WHERE n <= 10""")
def rrf_fusion(spark, d):
    """Reciprocal ranks of sources and of passages inside them, fused."""
    top = L.top(_scored(spark, d), 20).withColumn("source", F.col("id") % 7)
    local = top.withColumn("local_rank", F.row_number().over(Window.partitionBy("query", "source").orderBy("rank")) - 1)
    src = top.groupBy("query", "source").agg(F.min("rank").alias("first")).withColumn("source_rank", F.row_number().over(Window.partitionBy("query").orderBy("first", "source")))
    fused = L.fuse(local.join(src, ["query", "source"])).withColumn("score", F.round("score", 12))
    return L.top(fused, 10).select("query", "id", F.round("score", 9).alias("score"))


_ASK = ("red", "bolt", "copper", "Widget", "absent")
_TERMS = ", ".join(f"('{t}')" for t in _ASK)
WEIGHTS = f"q(term) AS (VALUES {_TERMS}), w AS (SELECT term, ln(((SELECT count(*) FROM part) + 1) / ((SELECT count(*) FROM part WHERE contains(lower(p_name), lower(term))) + 1)) + 1 AS weight FROM q)"


@query(f"WITH {WEIGHTS} SELECT term, round(weight, 9) AS weight FROM w")
def term_weights(spark, d):
    """Self-information of a request's words over the nodes' identity texts."""
    nodes = D.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("identity"))
    return L.term_weights(nodes, spark.createDataFrame([(t,) for t in _ASK], "term string")).select("term", F.round("weight", 9).alias("weight"))


@query(f"""WITH {WEIGHTS} SELECT p_partkey AS id, round(sum(weight) / (SELECT sum(weight) FROM w), 9) AS score, 'term_coverage:' || count(*) || '/{len(_ASK)}' AS why
FROM part JOIN w ON contains(lower(p_name), lower(term)) GROUP BY p_partkey ORDER BY round(sum(weight) / (SELECT sum(weight) FROM w), 9) DESC, id LIMIT 10""")
def term_fallback(spark, d):
    """The ten nodes that cover most of a request when none covers all."""
    nodes = D.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("identity"))
    return L.term_coverage(nodes, spark.createDataFrame([(t,) for t in _ASK], "term string")).select("id", F.round("score", 9).alias("score"), "why")


@query("""WITH p AS (SELECT DISTINCT p_name || ' ' || p_type || ' ' || p_brand AS t FROM part), x AS (SELECT t, regexp_replace(t, '\\s', '', 'g') AS bare, split_part(t, ' ', 1) AS block FROM p),
g AS (SELECT t, block, list_distinct(list_transform(range(1, length(bare)), lambda i: substr(bare, i, 2))) AS g FROM x)
SELECT a.t AS a, b.t AS b, round(2.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)), 9) AS dice FROM g a JOIN g b USING (block) WHERE a.t < b.t AND 2.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) >= 0.85""")
def near_duplicates(spark, d):
    """Short texts whose character pairs overlap almost entirely, compared within their first word."""
    t = D.table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("t")).distinct()
    g = t.select("t", F.substring_index("t", " ", 1).alias("block"), bigrams(F.col("t")).alias("g"))
    a, b = g.select(F.col("t").alias("a"), "block", F.col("g").alias("ga")), g.select(F.col("t").alias("b"), F.col("block").alias("block_b"), F.col("g").alias("gb"))
    pairs = a.join(b, (a["block"] == b["block_b"]) & (F.col("a") < F.col("b")))
    return pairs.select("a", "b", F.round(dice(F.col("ga"), F.col("gb")), 9).alias("dice")).where("dice >= 0.85")


@query("""WITH i AS (SELECT p_partkey AS place, p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'Report' ELSE 'Deck' END AS kind, p_name || p_partkey // 6 AS stem, CASE p_partkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' ELSE '' END AS end FROM part),
g AS (SELECT kind, stem, list(place ORDER BY place) AS ids, list_distinct(list(substr("end", 2))) AS e, string_agg(DISTINCT substr("end", 2), ',') AS x, list(substr("end", 2) ORDER BY place) AS exts FROM i WHERE "end" <> '' GROUP BY ALL)
SELECT id, stem AS label, 0 AS n_also, 1::bigint AS n FROM i WHERE "end" = ''
UNION ALL SELECT ids[1], CASE WHEN len(ids) = 1 THEN stem || '.' || exts[1] WHEN len(e) = 1 THEN stem || '.' || exts[1] || ' ×' || len(ids)
  ELSE stem || '.{' || exts[1] || ',' || list_filter(exts, lambda z: z <> exts[1])[1] || '}' END, (len(ids) - 1)::int, len(ids) FROM g""")
def fold_documents(spark, d):
    """Files of one document become one entry."""
    key = F.col("p_partkey")
    end = F.when(key % 3 == 0, ".pdf").when(key % 3 == 1, ".docx").otherwise("")
    items = D.table(spark, d, "part").select(key.alias("place"), key.alias("id"), F.when(key % 2 == 0, "Report").otherwise("Deck").alias("kind"), F.concat("p_name", F.expr("p_partkey div 6"), end).alias("label"))
    return R.fold_documents(items).select("id", "label", F.size("also").alias("n_also"), "n")


@query(r"SELECT page_id, CASE WHEN regexp_extract(f, '(?s)^(.+)\.([A-Za-z0-9]{1,5})$', 1) = '' THEN f ELSE regexp_extract(f, '(?s)^(.+)\.([A-Za-z0-9]{1,5})$', 1) END AS stem, lower(regexp_extract(f, '(?s)^(.+)\.([A-Za-z0-9]{1,5})$', 2)) AS ext FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS f FROM pages)")
def split_extensions(spark, d):
    """Stem and ending of each page's address."""
    p = D.table(spark, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("f"))
    stem, ext = split_extension(F.col("f"))
    return p.select("page_id", stem.alias("stem"), ext.alias("ext"))


@query("SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN source ELSE source || ' ' || substr(text, 1, 200) END AS excerpt FROM documents")
def excerpt_hit(spark, d):
    """Label and the first characters of the body."""
    return D.table(spark, d, "documents").select("doc_id", hit_excerpt(F.col("source"), F.col("text")).alias("excerpt"))


@query("""WITH m AS (SELECT doc_id, text, list_min(list_filter([instr(lower(text), 'that'), instr(lower(text), 'sur '), instr(lower(text), 'nicht')], lambda x: x > 0)) AS place FROM documents)
SELECT doc_id, substr(text, greatest(1, coalesce(place, 1) - 120), 600) AS excerpt FROM m""")
def excerpt_centered(spark, d):
    """Text around the earliest match of a request's words."""
    return D.table(spark, d, "documents").select("doc_id", centred_excerpt(F.col("text"), ["That", "sur ", "nicht"]).alias("excerpt"))


@query(f"""WITH {BM25}, r AS (SELECT query, id, score FROM k WHERE rank <= 20 AND id % 11 <> 0), p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS n, max(score) OVER (PARTITION BY query) AS most FROM r)
SELECT query, id, round(round(score, 9), 6) AS score FROM p WHERE n <= 3 OR round(score, 9) >= 0.5 * round(most, 9)""")
def prune_candidates(spark, d):
    """What hasn't been shown yet and is not far below the best."""
    top = L.top(_scored(spark, d), 20).select("query", "id", "score")
    return R.prune_candidates(top, top.where("id % 11 = 0").select("query", "id")).select("query", "id", F.round("score", 6).alias("score"))


@query("""WITH o AS (SELECT 'customer:' || o_custkey AS project, 'order:' || o_orderkey AS id, o_orderpriority || ' ' || o_orderstatus AS text FROM orders), w(term, weight) AS (VALUES ('high', 2.5), ('urgent', 3.25), ('o', 0.125)),
s AS (SELECT project, id, text, coalesce(sum(weight), 0.0) AS score FROM o LEFT JOIN w ON contains(lower(text), term) GROUP BY ALL),
k AS (SELECT *, count(*) OVER (PARTITION BY project) AS total, row_number() OVER (PARTITION BY project ORDER BY score DESC, id) AS n FROM s)
SELECT project, id, text AS label, score, total, n FROM k WHERE n <= 12""")
def constraints_ranked(spark, d):
    """Each project's constraints by the weight of the request's words in them, best first, with the total."""
    o = D.table(spark, d, "orders").select(F.concat(F.lit("customer:"), "o_custkey").alias("project"), F.concat(F.lit("order:"), "o_orderkey").alias("id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"))
    return R.rank_constraints(o, spark.createDataFrame([("high", 2.5), ("urgent", 3.25), ("o", 0.125)], "term string, weight double"))


@query("""WITH e AS (SELECT DISTINCT 'order:' || o_orderkey AS a, 'customer:' || o_custkey AS b FROM orders), s AS (SELECT 'order:' || o_orderkey AS id FROM orders WHERE o_orderkey % 50 = 0)
SELECT a AS seed, b AS id FROM e WHERE a IN (SELECT id FROM s)""")
def typed_neighbors(spark, d):
    """Projects of stated tasks, one typed step away."""
    from ..operators import graph as G

    edges = G.replay_edges(D.place_events(spark, d))
    o = D.table(spark, d, "orders")
    kinds = o.select(F.concat(F.lit("order:"), "o_orderkey").alias("id"), F.lit("Task").alias("kind")).union(D.table(spark, d, "customer").select(F.concat(F.lit("customer:"), "c_custkey"), F.lit("Project")))
    return R.typed_neighbours(edges, kinds, o.where("o_orderkey % 50 = 0").select(F.concat(F.lit("order:"), "o_orderkey").alias("id")), "BELONGS_TO", "Project")


@query("""WITH m AS (SELECT 'customer:' || o_custkey AS project, 'order:' || o_orderkey AS member, o_orderkey % 50 = 0 AS seed FROM orders), k AS (SELECT project, member FROM m WHERE NOT seed AND project IN (SELECT project FROM m WHERE seed)),
r AS (SELECT project, member AS id, 'Order#' || substr(member, 7) AS label, count(*) OVER (PARTITION BY project) AS total, row_number() OVER (PARTITION BY project ORDER BY 'Order#' || substr(member, 7), member) AS n FROM k)
SELECT project, id, label, total FROM r WHERE n <= 12""")
def project_siblings(spark, d):
    """Other members of the projects of stated tasks."""
    o = D.table(spark, d, "orders").select(F.concat(F.lit("customer:"), "o_custkey").alias("project"), F.concat(F.lit("order:"), "o_orderkey").alias("member"), F.concat(F.lit("Order#"), "o_orderkey").alias("label"), "o_orderkey")
    return R.siblings(o.select("project", "member"), o.select(F.col("member").alias("id"), "label"), o.where("o_orderkey % 50 = 0").select(F.col("member").alias("id")))


@query("SELECT doc_id, substr(regexp_replace(text, '[\\t\\r\\n]', ' ', 'g'), 1, 200) AS field FROM documents")
def tsv_fields(spark, d):
    """Texts as one field of a line."""
    return D.table(spark, d, "documents").select("doc_id", tsv_field(F.col("text")).alias("field"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN 'sub/' || p_name ELSE p_name || '.txt' END AS key FROM part")
def wiki_keys(spark, d):
    """References with brackets, aliases, anchors and endings, as the page they mean."""
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    ref = F.when(k == 0, F.concat(F.lit("[[02-wiki/"), name, F.lit(".md|shown]]"))).when(k == 1, F.concat(F.lit(" [["), name, F.lit("#part]] "))).when(k == 2, F.concat(F.lit("02-wiki/sub/"), name, F.lit(".md"))).otherwise(F.concat(name, F.lit(".txt")))
    return D.table(spark, d, "part").select("p_partkey", wiki_key(ref).alias("key"))

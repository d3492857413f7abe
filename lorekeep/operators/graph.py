"""Replay of a journal into a typed graph, and what walks it."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bare_key, edge_kind, is_canonical_stamp, is_location, node_kind, once, project_key
from ..functions.vocabulary import EDGE_KINDS, NODE_KINDS, TRIPLES, URI_EDGES, URI_NODES
from .lineage import settle, small_side

_EDGE_FIELDS = "`from` string, `to` string, type string, weight double, valid_from string, valid_until string, observed_utc string, provenance string"


@dataclass(frozen=True)
class Graph:
    """nodes (id, attrs, observed_utc) and edges (seq, from, edge, to, weight, valid_from, valid_until, retracted, observed_utc, provenance)."""

    nodes: DataFrame
    edges: DataFrame

    def columns(self, *names: str) -> DataFrame:
        """Nodes with named string fields as columns, null where absent."""
        return self.nodes.select("id", "observed_utc", *(F.try_element_at("attrs", F.lit(n)).alias(n) for n in names))


def replay_nodes(journal: DataFrame) -> DataFrame:
    """Each field's last value by seq; a JSON null is a value; observed_utc is the latest one seen, of payload and event.

    Fields are maximised map-side, so an id with any number of upserts moves a row a field and task.
    """
    up = journal.where("op = 'node.upsert'").select("seq", "observed_utc", once(F.from_json("payload", "map<string,string>")).alias("m"))
    up = up.withColumn("id", F.try_element_at("m", F.lit("id"))).where("id is not null")
    seen = F.greatest("observed_utc", F.try_element_at("m", F.lit("observed_utc")))
    fields = up.select("seq", "id", seen.alias("seen"), F.explode("m").alias("key", "value")).where("key <> 'observed_utc'")
    last = fields.groupBy("id", "key").agg(F.max_by(F.struct("value"), "seq").alias("v"), F.max("seen").alias("seen"))
    attrs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", F.col("v.value").alias("value")))))
    return last.groupBy("id").agg(attrs.alias("attrs"), F.max("seen").alias("observed_utc"))


def replay_edges(journal: DataFrame) -> DataFrame:
    """Every assertion as a row of its own; a retraction flags the earlier ones of its (from, edge, to)."""
    said = journal.where("op in ('edge.assert', 'edge.retract')").select("seq", "op", F.col("observed_utc").alias("event_utc"), once(F.from_json("payload", _EDGE_FIELDS)).alias("p"))
    said = said.select("seq", "op", "event_utc", "p.*").where("`from` is not null and `to` is not null and type is not null").withColumn("edge", edge_kind(F.col("type")))
    retracts = said.where("op = 'edge.retract'").groupBy("from", "edge", "to").agg(F.max("seq").alias("retract_seq"))
    rows = said.where("op = 'edge.assert'").select(
        "seq", "from", "edge", "to", F.col("weight").cast("float").alias("weight"), F.coalesce("valid_from", "event_utc", F.lit("")).alias("valid_from"),
        "valid_until", F.coalesce("observed_utc", "event_utc", F.lit("")).alias("observed_utc"), "provenance",
    )
    fine = lambda c: (F.col(c) == "") | is_canonical_stamp(F.col(c))
    rows = rows.where(fine("valid_from") & fine("observed_utc") & (F.col("valid_until").isNull() | is_canonical_stamp(F.col("valid_until"))))
    joined = rows.join(retracts, ["from", "edge", "to"], "left")
    return joined.select(
        "seq", "from", "edge", "to", "weight", "valid_from", "valid_until", F.coalesce(F.col("retract_seq") > F.col("seq"), F.lit(False)).alias("retracted"), "observed_utc", "provenance"
    )


def valid_at(edges: DataFrame, as_of: str | Column) -> DataFrame:
    """Edges whose validity holds then, both ends included."""
    at = F.lit(as_of) if isinstance(as_of, str) else as_of
    return edges.where((F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (at <= F.col("valid_until"))))


def materialize(journal: DataFrame, as_of: str | None = None, include_expired: bool = False) -> Graph:
    """The graph of a journal. as_of cuts edges by validity only; nodes and retractions don't depend on it."""
    edges = replay_edges(journal)
    if not include_expired:
        edges = valid_at(edges, as_of if as_of is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return Graph(replay_nodes(journal), edges)


def triple_error(from_kind: Column, edge: Column, to_kind: Column, uri: Column, provenance: Column) -> Column:
    """Why an edge is illegal, null if it is legal; to_kind is null where the far end is the location uri."""
    custom_to = to_kind.isNotNull() & ~to_kind.isin(*NODE_KINDS)
    custom = ~from_kind.isin(*NODE_KINDS) | ~edge.isin(*EDGE_KINDS) | custom_to
    named = F.coalesce(F.trim(provenance) != "", F.lit(False))
    legal = F.concat_ws(" ", from_kind, edge, to_kind).isin(*[" ".join(t) for t in TRIPLES])
    at_uri = to_kind.isNull()
    return (
        F.when(custom & ~named, "missing_provenance")
        .when(at_uri & ~edge.isin(*URI_EDGES), "illegal_pair")
        .when(at_uri & ~is_location(uri), "bad_uri")
        .when(custom, F.lit(None))
        .when(at_uri & ~from_kind.isin(*URI_NODES), "illegal_pair")
        .when(~at_uri & ~legal, "illegal_pair")
    )


def walkable(graph: Graph) -> DataFrame:
    """(from, to) of live, legal edges whose ends both exist, each once. An edge without provenance takes its source node's."""
    kinds = graph.columns("type", "provenance").select("id", node_kind(F.col("type")).alias("kind"), "provenance")
    a = kinds.select(F.col("id").alias("from"), F.col("kind").alias("from_kind"), F.col("provenance").alias("node_provenance"))
    b = kinds.select(F.col("id").alias("to"), F.col("kind").alias("to_kind"))
    live = graph.edges.where("not retracted").select("from", "edge", "to", "provenance").distinct()
    error = triple_error(F.col("from_kind"), F.col("edge"), F.col("to_kind"), F.lit(None).cast("string"), F.coalesce("provenance", "node_provenance"))
    return live.join(a, "from").join(b, "to").where(error.isNull()).select("from", "to").distinct()


def walk(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(id, depth): the fewest steps from any seed along live, legal edges, up to depth.

    nodes has id, type and provenance. Each level first meets the edges that leave it, and only these are judged, so that
    the edges of a question are joined with nodes, not those of the whole graph. Nodes, live edges and levels are settled.
    """
    kinds = settle(nodes.select("id", node_kind(F.col("type")).alias("kind"), "provenance"))
    live = settle(edges.where("not retracted").select("from", "edge", "to", "provenance"))
    reached = frontier = settle(seeds.select("id", F.lit(0).alias("depth")).distinct())
    a = kinds.select(F.col("id").alias("from"), F.col("kind").alias("from_kind"), F.col("provenance").alias("node_provenance"))
    b = kinds.select(F.col("id").alias("to"), F.col("kind").alias("to_kind"))
    error = triple_error(F.col("from_kind"), F.col("edge"), F.col("to_kind"), F.lit(None).cast("string"), F.coalesce("provenance", "node_provenance"))
    for level in range(1, depth + 1):
        here = frontier.select(F.col("id").alias("from")).join(a, "from")
        ahead = live.join(small_side(here, frontier.count()), "from").distinct()
        step = ahead.join(b, "to").where(error.isNull()).select(F.col("to").alias("id")).distinct()
        frontier = settle(step.join(reached, "id", "left_anti").select("id", F.lit(level).alias("depth")))
        reached = reached.union(frontier)
    return reached


def bfs(seeds: DataFrame, links: DataFrame, depth: int = 3) -> DataFrame:
    """(id, depth): the fewest steps from any seed along links (from, to), up to depth.

    Links, seeds and each level are settled, as all later levels read them again; levels are few by definition.
    """
    links = settle(links) if depth > 1 else links
    reached = frontier = settle(seeds.select("id", F.lit(0).alias("depth")).distinct())
    for level in range(1, depth + 1):
        step = frontier.join(links, frontier["id"] == links["from"]).select(F.col("to").alias("id")).distinct()
        frontier = settle(step.join(reached, "id", "left_anti").select("id", F.lit(level).alias("depth")))
        reached = reached.union(frontier)
    return reached


def closure(roots: DataFrame, links: DataFrame, most: int | None = None) -> DataFrame:
    """(root, id, depth): everything that roots (id) reach along links, themselves at depth 0; stops when nothing is new.

    most bounds the steps where the caller asks for it; without it they end when the frontier is empty, after at most
    as many steps as there are nodes. Levels are settled into one every 16 steps, so that long chains keep short plans.
    """
    links = settle(links)
    reached = frontier = settle(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct())
    for level in count(1) if most is None else range(1, most + 1):
        step = frontier.join(links, frontier["id"] == links["from"]).select("root", F.col("to").alias("id")).distinct()
        frontier = settle(step.join(reached, ["root", "id"], "left_anti").select("root", "id", F.lit(level).alias("depth")))
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
        if level % 16 == 0:
            reached = settle(reached)
    return reached


def reachable(links: DataFrame) -> DataFrame:
    """(from, to) of every node and all others that it reaches along links, each pair once.

    Each round joins the pairs to themselves, so that paths double in length and rounds grow with the logarithm of the longest.
    """
    now = settle(links.select("from", "to").where("`from` <> `to`").distinct())
    n = now.count()
    while n:
        a, b = now.select("from", F.col("to").alias("mid")), now.select(F.col("from").alias("mid"), "to")
        now = settle(now.union(a.join(b, "mid").select("from", "to")).where("`from` <> `to`").distinct())
        was, n = n, now.count()
        if n == was:
            break
    return now


def origins(links: DataFrame) -> DataFrame:
    """(from, to) of every node with links and the ends that it reaches: nodes without links of their own, each pair once.

    Nodes that reach a common node share an end, and only they do. A cycle has no end; its least node is one.
    Each round replaces a pair that goes on by the pairs of its end, so that steps double. Where nodes have one link,
    as in a plain history, there is a row a node, not one for each of its ancestors as in reachable().
    """
    links = settle(links.select("from", "to").where("`from` <> `to`").distinct())
    further = links.select(F.col("from").alias("to"), F.lit(True).alias("on")).distinct()
    nodes, steps = further.count(), 1
    now = settle(links.join(further, "to", "left").select("from", "to", F.coalesce("on", F.lit(False)).alias("on"), F.col("to").alias("least")))
    while steps < nodes and not now.where("on").isEmpty():
        a = now.where("on").select("from", F.col("to").alias("mid"), F.col("least").alias("before"))
        b = now.select(F.col("from").alias("mid"), "to", "on", "least")
        step = a.join(b, "mid").select("from", "to", "on", F.least("before", "least").alias("least"))
        now = settle(now.where("not on").union(step).groupBy("from", "to", "on").agg(F.min("least").alias("least")))
        steps *= 2
    going = now.where("on")  # steps as many as nodes and no end: all of these came through a cycle
    least = going.groupBy(F.col("from").alias("to")).agg(F.min("least").alias("least"))
    return now.where("not on").select("from", "to").union(going.select("from", "to").join(least, "to").select("from", F.col("least").alias("to"))).distinct()


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from, edge, to, missing): live edges with an end that no node has; locations are no nodes."""
    ids = nodes.select("id")
    live = edges.where("not retracted").select("from", "edge", "to").distinct()
    no_from = live.join(ids.withColumnRenamed("id", "from"), "from", "left_anti").select("from", "edge", "to", F.lit("from").alias("missing"))
    far = live.where(~is_location(F.col("to")))
    return no_from.union(far.join(ids.withColumnRenamed("id", "to"), "to", "left_anti").select("from", "edge", "to", F.lit("to").alias("missing")))


def resolve_projects(projects: DataFrame, inputs: DataFrame) -> DataFrame:
    """(input, rank, candidates): for each stated reference the projects of the best rank it matches; one candidate resolves it.

    projects has id, label, path. Rank 0 is the id, 1 the id without namespace or the path, 2 the label, 3 the id's
    last part. Each rank is an equality join on the key it compares.
    """
    key = lambda c: project_key(F.coalesce(F.col(c), F.lit("")))
    p = projects.select("id", key("id").alias("id_key"), key("label").alias("label_key"), key("path").alias("path_key")).withColumn("bare_id", bare_key(F.col("id_key")))
    q = inputs.select("input", project_key(F.col("input")).alias("query")).withColumn("bare", bare_key(F.col("query")))
    ways = [
        (0, "query", p.select("id", F.col("id_key").alias("k"))), (1, "bare", p.select("id", F.col("bare_id").alias("k"))),
        (1, "bare", p.where("path_key <> ''").select("id", F.col("path_key").alias("k"))), (2, "query", p.where("label_key <> ''").select("id", F.col("label_key").alias("k"))),
        (3, "bare", p.select("id", F.substring_index("bare_id", "/", -1).alias("k"))),
    ]
    found = None
    for rank, column, side in ways:
        hit = q.join(side, q[column] == side["k"]).select("input", F.lit(rank).alias("rank"), "id")
        found = hit if found is None else found.union(hit)
    best = found.groupBy("input").agg(F.min("rank").alias("rank"))
    return found.join(best, ["input", "rank"]).groupBy("input", "rank").agg(F.array_sort(F.collect_set("id")).alias("candidates"))

"""The context of a request: which nodes it names, what belongs to them, and how sure that is."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cues
from ..functions import vocabulary as V
from ..functions.text import anchor_text, identity_text, searchable_text
from . import graph as G
from . import lexical as L
from . import retrieval as R
from .lineage import settle

#: Projects that one answer may touch, and decisions that a rendered one shows.
PROJECTS, SHOWN = 1_000, 20
FIELDS = ("label", "name", "aliases", "alias", "path", "document_id", "revision_id")


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def entity_anchor(anchor: Column, entities: list[str]) -> Column:
    """All of a request's names in a node's own names; a path is nobody's name."""
    low = F.lower(anchor)
    return F.lit(bool(entities)) & ~low.contains("workspace:") & ~low.contains("/") & _all(low.contains(e) for e in entities)


def all_terms(text: Column, terms: list[str]) -> Column:
    return F.lit(bool(terms)) & _all(F.lower(text).contains(t) for t in terms)


def coverage(attrs: Column, terms: list[str], entities: list[str]) -> Column:
    """How well a node's identity covers the terms: label and name count whole, other fields four fifths; an anchor adds a fifth."""
    if not terms:
        return F.lit(0.0)
    field = {k: F.lower(F.coalesce(F.try_element_at(attrs, F.lit(k)), F.lit(""))) for k in FIELDS}
    strong = lambda t: _any(field[k].contains(t) for k in ("label", "name"))
    weak = lambda t: _any(field[k].contains(t) for k in FIELDS[2:])
    each = [F.when(strong(t), 1.0).when(weak(t), 0.8).otherwise(0.0) for t in terms]
    weighted = reduce(lambda a, b: a + b, each)
    matched = reduce(lambda a, b: a + b, [F.when(e > 0, 1.0).otherwise(0.0) for e in each])
    anchored = F.when(_any(F.lower(anchor_text(attrs)).contains(e) for e in entities), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), 0.5 + 0.5 * weighted / len(terms) + anchored) * F.sqrt(matched / len(terms))


def literal_candidates(nodes: DataFrame, q: str) -> DataFrame:
    """(id, score, why) of nodes (id, attrs) that a request names: 1 for an exact name, else by coverage."""
    terms = cues.request_terms(q)
    ids, entities = cues.identity_terms(terms), cues.entity_terms(terms)
    partial = cues.edits_asset(q)
    low_q = q.strip().lower()
    if not low_q:
        return nodes.select("id", F.lit(0.0).alias("score"), F.lit("").alias("why")).limit(0)
    label, name = F.lower(F.coalesce(F.try_element_at("attrs", F.lit("label")), F.lit(""))), F.lower(F.col("id"))
    pathlike = label.contains("workspace:") | label.contains("/")
    exact_id = name == low_q
    whole = F.lit(len(low_q) >= 2) & (label.contains(low_q) | (~pathlike & name.contains(low_q)))
    together = F.lit(len(entities) <= 1 or partial) | _all(label.contains(e) | name.contains(e) for e in entities)
    spoken = [t for t in terms if not entities or t in entities]
    said = ~pathlike & together & _any(label.contains(t) | name.contains(t) for t in spoken)
    equal = ~pathlike & together & _any((label == t) | (name == t) for t in spoken)
    identity = entity_anchor(anchor_text(F.col("attrs")), entities) if entities else _any(F.lower(identity_text(F.col("attrs"))).contains(t) for t in ids)
    admitted = F.lit(partial or len(ids) <= 1) | all_terms(searchable_text(F.col("attrs")), ids)
    hit = exact_id | ((whole | said | identity) & admitted)
    score = F.when(exact_id | whole | equal, 1.0).otherwise(coverage(F.col("attrs"), ids, entities))
    return nodes.where(hit).select("id", score.alias("score"), F.lit("literal_match").alias("why")).where("score > 0")


def text_candidates(nodes: DataFrame, q: str, k: int = 100) -> DataFrame:
    """(id, score, why) of the k best nodes by BM25 that also name the request's entities or hold all its terms."""
    terms = cues.request_terms(q)
    ids, entities = cues.identity_terms(terms), cues.entity_terms(terms)
    found = R.text_seeds(nodes.select("id", searchable_text(F.col("attrs")).alias("text")), " ".join(terms), k)
    whole = all_terms(searchable_text(F.col("attrs")), ids)
    admitted = (entity_anchor(anchor_text(F.col("attrs")), entities) | whole) if entities else whole
    return found.join(nodes.where(admitted), "id").select("id", "score", F.lit("fts_identity_match").alias("why"))


@dataclass(frozen=True)
class Context:
    """What a request is about: its resolution, ranked candidates (id, label, score, why, also), projects, decisions, constraints and what is missing."""

    resolution: str
    candidates: DataFrame
    projects: list[str]
    decisions: DataFrame
    neighbours: DataFrame
    operation: str | None
    constraint_cues: list[str]
    missing: list[str]
    total: int
    next_offset: int | None


def context(journal: DataFrame, q: str, as_of: str | None = None, limit: int = 10, offset: int = 0, include_expired: bool = False) -> Context:
    """Candidates by name and by text, folded; their projects and decisions; and whether that settles the request.

    missing: nothing matched. partial: only single terms did. ambiguous: more than one project. An edit of an asset is
    ready only with one approved, editable, located candidate. Otherwise retrieved.
    """
    g = G.materialize(journal, as_of, include_expired)
    nodes = settle(g.nodes)
    live = g.edges.where("not retracted")
    found = literal_candidates(nodes, q)
    found = found.union(text_candidates(nodes, q)) if cues.request_terms(q) else found
    ranked = settle(found.groupBy("id").agg(F.max("score").alias("score"), F.max_by("why", F.struct("score", "why")).alias("why")))
    ids = cues.identity_terms(cues.request_terms(q))
    unmatched: list[str] = []
    partial = False
    if ranked.isEmpty() and len(ids) >= 2:
        terms = nodes.sparkSession.createDataFrame([(t,) for t in ids], "term string")
        hay = nodes.select("id", identity_text(F.col("attrs")).alias("identity"))
        ranked = settle(L.term_coverage(hay, terms))
        partial = not ranked.isEmpty()
        if partial:
            held = hay.agg(*(F.max(F.lower("identity").contains(t)).alias(f"t{n}") for n, t in enumerate(ids))).first()
            unmatched = [t for n, t in enumerate(ids) if not held[n]]
    field = lambda k: F.coalesce(F.try_element_at("attrs", F.lit(k)), F.lit(""))
    mine = settle(ranked.join(nodes, "id").select("id", "score", "why", field("label").alias("label"), field("type").alias("kind"), field("status").alias("status"), field("path").alias("path"), field("location_verified").alias("located")))
    place = F.struct((-F.col("score")).alias("s"), "id")
    folded = R.fold_documents(mine.select(place.alias("place"), "id", "kind", F.when(F.col("label") == "", F.col("id")).otherwise(F.col("label")).alias("label")))
    candidates = folded.join(mine.select("id", "score", "why"), "id").select("id", "label", "score", "why", "also")
    kinds = nodes.select("id", F.lower(field("type")).alias("kind"))
    direct = mine.where(F.lower("kind") == "project").select("id")
    tied = live.where("edge = 'BELONGS_TO'").join(mine.select(F.col("id").alias("from")), "from", "left_semi").join(kinds.where("kind = 'project'").select(F.col("id").alias("to")), "to", "left_semi").select(F.col("to").alias("id"))
    projects = sorted(r["id"] for r in direct.union(tied).distinct().limit(PROJECTS + 1).collect())  # names of a bounded answer
    if len(projects) > PROJECTS:
        raise ValueError(f"the request touches more than {PROJECTS} projects; say more")
    supports = live.where(F.col("edge").isin("SUPPORTS", "INFORMS")).select("from", "to")
    ends = supports.union(supports.select("to", "from")).distinct().join(mine.select(F.col("id").alias("from")), "from", "left_semi").select(F.col("to").alias("id")).distinct()
    decisions = ends.join(kinds.where("kind = 'decision'").select("id"), "id").join(nodes.select("id", field("label").alias("label"), field("status").alias("status")), "id")
    members = live.where("edge = 'BELONGS_TO'").select(F.col("to").alias("project"), F.col("from").alias("member")).distinct()
    neighbours = R.siblings(members, nodes.select("id", field("label").alias("label")), mine.select("id"))
    total = candidates.count()
    editable = _any(F.lower(F.when(F.col("label") != "", F.col("label")).otherwise(F.col("path"))).endswith(e) for e in V.EDITABLE)
    approved = mine.where((F.lower("status") == "approved") & editable & F.lower("located").isin("true", "verified")).count()
    missing: list[str] = []
    if not total:
        resolution = "missing"
        missing.append("nothing in the knowledge base matches")
    elif partial:
        resolution = "partial"
        missing.append("only single terms match" + (f"; none for: {', '.join(unmatched)}" if unmatched else ""))
    elif cues.edits_asset(q):
        resolution = "ambiguous" if approved > 1 or (approved and len(projects) > 1) else "ready" if approved else "missing"
        if not approved:
            missing.append("no approved editable baseline")
    else:
        resolution = "ambiguous" if len(projects) > 1 else "retrieved"
    shown = candidates.orderBy(F.desc("score"), "id").offset(offset).limit(limit)
    following = offset + min(limit, max(0, total - offset))
    return Context(resolution, shown, projects, decisions, neighbours, cues.operation(q), cues.constraint_cues(q), missing, total, following if following < total else None)


def render(c: Context) -> str:
    """A context as text: what it is about, what belongs to it and what is missing."""
    lines = [f"resolution: {c.resolution}"]
    for r in c.candidates.collect():  # one page
        lines.append(f"- {r['label']} ({r['id']}) {r['score']:.2f} {r['why']}" + (f", also {', '.join(r['also'])}" if r["also"] else ""))
    lines += [f"project: {p}" for p in c.projects]
    decisions = c.decisions.orderBy("id").limit(SHOWN + 1).collect()
    lines += [f"decision: {r['label']} [{r['status'] or 'unknown'}]" for r in decisions[:SHOWN]]
    if len(decisions) > SHOWN:
        lines.append(f"decisions: the first {SHOWN} of {c.decisions.count()} are shown")
    lines += [f"missing: {m}" for m in c.missing]
    return "\n".join(lines + ([f"more from {c.next_offset}"] if c.next_offset is not None else []))

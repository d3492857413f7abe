"""Drafts by others about cited sources: contexts to give them, and what of a draft holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import evidence as E
from . import graph as G


def id_context(sources: DataFrame, most: int = 64, most_bytes: int = 128 * 1024) -> DataFrame:
    """(evidence_id, id, text, sha256): admitted sources (id, text) of one request in order of id, numbered E1, E2, ..., all of them.

    No source, more than most, or more than most_bytes of text is an error: the caller selects, nothing is left out.
    """
    n, size = sources.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if not 1 <= n <= most:
        raise ValueError(f"a context needs 1 to {most} sources, not {n}")
    if size > most_bytes:
        raise ValueError(f"the sources have {size} bytes of {most_bytes}; select fewer explicitly")
    numbered = sources.withColumn("n", F.row_number().over(Window.orderBy("id")))  # the sources of one request
    return numbered.select(F.concat(F.lit("E"), "n").alias("evidence_id"), "id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def context_hash(context: DataFrame) -> str:
    """What a draft is bound to: one hash of all numbered sources."""
    parts = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "evidence_id", "id", "sha256"))), "\n")
    return context.agg(F.sha2(parts.cast("binary"), 256)).first()[0]


def bind(draft: DataFrame, context: DataFrame, draft_hash: str) -> DataFrame:
    """(claim, evidence_id, id, sha256) of a draft (claim, evidence_ids) that was made for this context; a changed context is an error."""
    if draft_hash != context_hash(context):
        raise ValueError("the draft was made for another context")
    cited = draft.select("claim", F.explode("evidence_ids").alias("evidence_id")).distinct()
    j = cited.join(context.select("evidence_id", "id", "sha256"), "evidence_id", "left")
    unknown = [r["evidence_id"] for r in j.where("id is null").select("evidence_id").distinct().orderBy("evidence_id").limit(10).collect()]
    if unknown:
        raise ValueError(f"the draft cites what it wasn't given: {', '.join(unknown)}")
    return j


def claim_findings(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """(claim, findings): claims (claim, quotes array of struct(source_id, quote)) and what is wrong with their quotes; none: all stand exactly once."""
    quotes = claims.select("claim", F.posexplode_outer("quotes").alias("n", "q")).select("claim", F.concat_ws("#", "claim", "n").alias("quote_id"), "q.source_id", "q.quote")
    found = E.citations(quotes.where("source_id is not null").select("quote_id", "source_id", "quote"), sources).select("quote_id", "problem")
    j = quotes.join(found, "quote_id", "left").withColumn("p", F.when(F.col("source_id").isNull(), "nothing cited").otherwise(F.col("problem")))
    return j.groupBy("claim").agg(F.array_sort(F.collect_set("p")).alias("findings"))


def assertions(proposed: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, problem) of assertions (id, source_id, begin, end, text, role, basis, supersedes): the first that is wrong, null without any.

    The span has to hold the text byte for byte; what is said to be a person's has to be in a person's words
    (basis said_by_user needs the role user); supersedes has to name another assertion and must not run in a circle.
    """
    s = sources.select("source_id", F.col("text").cast("binary").alias("data"), F.col("role").alias("source_role"))
    span = F.substring(F.col("data"), F.col("begin") + 1, F.col("end") - F.col("begin"))
    links = proposed.where("supersedes is not null").select(F.col("id").alias("from"), F.col("supersedes").alias("to"))
    circle = G.closure(links.select(F.col("from").alias("id")).distinct(), links).where("depth > 0").join(links.select(F.col("from").alias("id"), F.col("to").alias("back")), "id").where("back = root").select(F.col("root").alias("id")).distinct().withColumn("circle", F.lit(True))
    own = links.where("`from` = `to`").select(F.col("from").alias("id")).distinct().withColumn("own", F.lit(True))
    known = proposed.select(F.col("id").alias("supersedes")).distinct().withColumn("known", F.lit(True))
    j = proposed.join(s, "source_id", "left").join(circle, "id", "left").join(own, "id", "left").join(known, "supersedes", "left")
    problem = (
        F.when(F.col("data").isNull(), "source_unknown").when((F.col("begin") < 0) | (F.col("end") <= F.col("begin")) | (F.col("end") > F.octet_length("data")), "span_outside")
        .when(span != F.col("text").cast("binary"), "span_differs").when(F.col("role") != F.col("source_role"), "role_differs")
        .when((F.col("basis") == "said_by_user") & (F.col("source_role") != "user"), "basis_unfounded")
        .when(F.col("supersedes").isNotNull() & F.col("known").isNull(), "supersedes_unknown").when(F.col("circle") | F.col("own"), "supersedes_circle")
    )
    return j.select("id", problem.alias("problem"))


def review(premises: DataFrame, spans: DataFrame) -> DataFrame:
    """(case, readiness): reviewed spans (premise, stance: supports or refutes) weighed for each case's premises (case, premise)."""
    votes = spans.groupBy("premise").agg(F.count_if(F.col("stance") == "supports").alias("supports"), F.count_if(F.col("stance") == "refutes").alias("refutes"))
    j = premises.join(votes, "premise", "left").na.fill(0, ["supports", "refutes"])
    return E.readiness(j.select("case", "premise", "supports", "refutes", ((F.col("supports") == 0) & (F.col("refutes") == 0)).alias("missing")))


def expand(items: DataFrame, wanted: DataFrame, request_hash: str, now_hash: str) -> DataFrame:
    """Omitted items (id, content) of a request that is still the same, as they are; each with its hash."""
    if request_hash != now_hash:
        raise ValueError("the request has changed since its packet was made")
    return items.join(wanted.select("id").distinct(), "id", "left_semi").select("id", "content", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))


def assign_ids(pages: DataFrame, live: DataFrame) -> DataFrame:
    """(name, id) of wiki pages (name, node_id): the id that the page says, else that of the live node of its path (id, path), else one made of the path. Two pages of one id are an error."""
    made = F.concat(F.lit("wiki:"), F.substring(F.sha2(F.col("name").cast("binary"), 256), 1, 16))
    out = pages.join(live.groupBy(F.col("path").alias("name")).agg(F.min("id").alias("known")), "name", "left").select("name", F.coalesce("node_id", "known", made).alias("id"))
    twice = out.groupBy("id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("name")).alias("names")).where("n > 1").orderBy("id").first()
    if twice is not None:
        raise ValueError(f"{twice['id']} is claimed by {', '.join(twice['names'])}")
    return out


def latest_snapshot(index: DataFrame, store: DataFrame) -> DataFrame:
    """(task, sha256, content, problem): each task's last entry of an index (task, seq, sha256) from a store (sha256, content), checked against its hash."""
    last = index.groupBy("task").agg(F.max_by("sha256", "seq").alias("sha256"))
    j = last.join(store, "sha256", "left")
    return j.select("task", "sha256", "content", F.when(F.col("content").isNull(), "absent").when(F.sha2(F.col("content").cast("binary"), 256) != F.col("sha256"), "changed").alias("problem"))


def discover(files: DataFrame, terms: list[str], most: int = 8) -> DataFrame:
    """The files (path) whose names hold most of the terms, ties by path."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    score = sum((F.when(name.contains(t.lower()), 1).otherwise(0) for t in dict.fromkeys(terms)), F.lit(0))
    return files.select("path", score.alias("terms")).where("terms > 0").orderBy(F.desc("terms"), "path").limit(most)


def with_registry(projects: DataFrame, registry: DataFrame) -> DataFrame:
    """Projects (id, label, path) with what they lack from a registry (id, label, path)."""
    r = registry.select("id", F.col("label").alias("r_label"), F.col("path").alias("r_path"))
    said = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"r_{c}"))
    return projects.join(r, "id", "left").select("id", said("label").alias("label"), said("path").alias("path"))

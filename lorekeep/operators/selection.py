"""Choices that depend on each choice before: small, ordered problems, one per group, solved in Python."""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json
from ..functions.vocabulary import STEPS


def estimated_tokens(text: str) -> int:
    """A stand-in for a tokenizer: four bytes a token. Pass a real counter where one is at hand."""
    return -(-len(text.encode()) // 4)


def requires_closure(requires: Mapping[int, Iterable[int]], seeds: Iterable[int]) -> frozenset[int]:
    """Seeds and all that they require."""
    out, todo = set(seeds), list(seeds)
    while todo:
        new = set(requires.get(todo.pop(), ())) - out
        out |= new
        todo += new
    return frozenset(out)


def greedy_context(nodes: Mapping[int, tuple[int, float]], requires: Mapping[int, Iterable[int]], budget: int, seeds: Iterable[int]) -> tuple[frozenset[int], int]:
    """Seeds with their requirements, then again and again the closure of the best relevance for its extra cost that fits.

    nodes: id -> (cost, relevance). Ties go to the smallest id. Raises ValueError if the seeds alone don't fit.
    """
    cost = lambda ids: sum(nodes[i][0] for i in ids)
    chosen = requires_closure(requires, seeds)
    spent = cost(chosen)
    if spent > budget:
        raise ValueError(f"required context costs {spent}, exceeding budget {budget}")
    closures = {i: requires_closure(requires, [i]) for i in sorted(nodes)}
    while True:
        options = []
        for i, whole in closures.items():
            extra = whole - chosen
            price, gain = cost(extra), math.fsum(nodes[k][1] for k in sorted(extra))
            if extra and price <= budget - spent and gain > 0:
                options.append((-gain / price, i, price, extra))
        if not options:
            return chosen, spent
        _, _, price, extra = min(options, key=lambda o: o[:2])
        chosen, spent = chosen | extra, spent + price


def cheapest_facts(alternatives: list[list[frozenset[int]]], cost: Callable[[frozenset[int]], int], budget: int, most_states: int = 100_000, monotone: bool = True) -> tuple[frozenset[int], int] | None:
    """One alternative for every fact at the least cost of their union; None if none fits the budget.

    Uniform-cost search over partial choices; among equal costs the earliest alternatives win. Without monotone the
    cost of a part says nothing about the whole, so only whole choices are priced. Raises RuntimeError past most_states:
    whether a choice exists is then unknown.
    """
    todo: list[tuple[int, tuple[int, ...], frozenset[int]]] = [(0, (), frozenset())]
    seen: set[tuple[int, frozenset[int]]] = set()
    best: tuple[int, tuple[int, ...], frozenset[int]] | None = None
    while todo:
        spent, path, held = heapq.heappop(todo)
        if best is not None and (spent, path) >= best[:2] and monotone:
            break
        if (len(path), held) in seen:
            continue
        seen.add((len(path), held))
        if len(seen) > most_states:
            raise RuntimeError(f"evidence search exceeded {most_states} states; feasibility is unknown")
        if len(path) == len(alternatives):
            price = cost(held) if alternatives else 0
            if price <= budget and (best is None or (price, path) < best[:2]):
                best = (price, path, held)
            continue
        for n, option in enumerate(alternatives[len(path)]):
            union = held | option
            price = cost(union) if monotone else 0
            if price <= budget:
                heapq.heappush(todo, (price, (*path, n), union))
    return None if best is None else (best[2], best[0])


def pack(items: list[dict], budget: int, prefix: object = None, task: object = None, count: Callable[[str], int] = estimated_tokens) -> list[bool]:
    """Which items (content, required, priority) fit a packet: all required ones, then by falling priority, then in order.

    An item that doesn't fit is skipped and the next is tried. Raises ValueError if the required ones don't fit.
    """

    def size(chosen: set[int]) -> int:
        return count(canonical_json({"prefix": prefix, "task": task, "items": [items[i]["content"] for i in sorted(chosen)]}))

    chosen = {i for i, x in enumerate(items) if x["required"]}
    if size(chosen) > budget:
        raise ValueError(f"required items take {size(chosen)} tokens, exceeding budget {budget}")
    for i in sorted(set(range(len(items))) - chosen, key=lambda i: (-(items[i].get("priority") or 0), i)):
        if size(chosen | {i}) <= budget:
            chosen.add(i)
    return [i in chosen for i in range(len(items))]


def pack_requests(items: DataFrame, budget: int, count: Callable[[str], int] = estimated_tokens) -> DataFrame:
    """(request, place, selected) for items (request, place, content, required, priority); a request's items are one group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("place")
        try:
            kept = pack([{"content": c, "required": bool(r), "priority": None if pd.isna(p) else int(p)} for c, r, p in zip(g["content"], g["required"], g["priority"], strict=True)], budget, count=count)
        except ValueError:
            kept = [False] * len(g)
        return pd.DataFrame({"request": g["request"], "place": g["place"], "selected": kept})

    return items.select("request", "place", "content", "required", "priority").groupBy("request").applyInPandas(run, "request long, place long, selected boolean")


def fit_characters(cards: list[tuple[str, float, int]], budget: int) -> list[str]:
    """Ids of cards (id, value, size) by value density until the budget is full; what doesn't fit is skipped."""
    out = []
    for name, _, size in sorted(cards, key=lambda c: (-c[1] / max(1, c[2]), c[0])):
        if size <= budget:
            out.append(name)
            budget -= size
    return out


def drop_near(texts: list[str], alike: Callable[[str, str], bool]) -> list[str]:
    """Texts in order without those that are alike to a kept one."""
    out: list[str] = []
    for t in texts:
        if not any(alike(t, k) for k in out):
            out.append(t)
    return out


def best_first(links: Iterable[tuple[str, str, str]], seeds: Mapping[str, float], depth: int = 3, most: int = 200, frontier: int = 4_096) -> list[tuple[str, float, tuple[tuple[str, str, str, str], ...]]]:
    """(node, score, path) in the order of best score from the seeds along links (from, edge, to).

    A step multiplies by its weight, a membership step also by 1 / sqrt(steps that leave the node). Nodes are visited
    once, at their best score, ties by id; depth, visited nodes and the waiting line are bounded.
    """
    forward = {e: f for e, f, _ in STEPS if f}
    backward = {e: b for e, _, b in STEPS if b}
    steps: dict[str, list[tuple[float, str, tuple[str, str, str, str]]]] = {}
    for a, e, b in links:
        if e in forward:
            steps.setdefault(a, []).append((forward[e], b, (a, e, b, "forward")))
        if e in backward:
            steps.setdefault(b, []).append((backward[e], a, (a, e, b, "reverse")))
    waiting = [(-s, n, ()) for n, s in seeds.items()]
    heapq.heapify(waiting)
    out, visited = [], set()
    while waiting and len(out) < most:
        score, node, path = heapq.heappop(waiting)
        if node in visited:
            continue
        visited.add(node)
        out.append((node, -score, path))
        mine = sorted(steps.get(node, ()), key=lambda s: (-s[0], s[1]))
        if len(path) >= depth:
            continue
        for weight, target, hop in mine:
            if target not in visited and len(waiting) < frontier:
                share = math.sqrt(len(mine)) if hop[1] == "BELONGS_TO" else 1.0
                heapq.heappush(waiting, (score * weight / share, target, (*path, hop)))
    return out


def trace(edges: DataFrame, seeds: DataFrame, depth: int = 3, most: int = 200, most_links: int = 200_000) -> DataFrame:
    """(rank, node, score, path): best-first from seeds (id, score), on the links within depth steps of them.

    The neighbourhood is found by joins; only it goes to the driver, and only if its links are few enough.
    """
    from . import graph as G

    live = edges.where("not retracted").select("from", "edge", "to").distinct().where(F.col("edge").isin(*[e for e, _, _ in STEPS]))
    both = live.select("from", "to").union(live.select(F.col("to").alias("from"), F.col("from").alias("to"))).distinct()
    near = G.bfs(seeds.select("id"), both, depth).select("id")
    mine = live.join(near.withColumnRenamed("id", "from"), "from", "left_semi").join(near.withColumnRenamed("id", "to"), "to", "left_semi").select("from", "edge", "to")
    rows = mine.limit(most_links + 1).collect()
    if len(rows) > most_links:
        raise ValueError(f"more than {most_links} links within {depth} steps; take fewer seeds or steps")
    found = best_first([tuple(r) for r in rows], {r["id"]: r["score"] for r in seeds.collect()}, depth, most)
    out = [(n, node, float(score), json.dumps(path)) for n, (node, score, path) in enumerate(found)]
    return edges.sparkSession.createDataFrame(out, "rank int, node string, score double, path string")

"""Sessions that a source names explicitly: hints where to look, no proof of where it came from."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: References of a source, items of a list and nesting that are read; beyond them the result says truncated. Fixed values.
MOST, DEPTH = 32, 4
ID_KEYS = ("session_id", "conversation_id", "origin_session_id")
PROVIDER_KEYS = ("source", "tool", "provider")
NESTED_KEYS = ("source", "sources", "provenance", "conversation", "conversations", "origin")
LINE = re.compile(r"(?i)^\s*(?:native session:|native session：|session_id:|session_id：|conversation_id:)[\s`'\"]*([A-Za-z0-9_-]*)")
FORM = "struct<found:array<struct<source:string,session:string,pointer:string>>,truncated:boolean>"


def _descriptors(value, pointer: str, left: int, providers: tuple[str, ...]) -> Iterator[tuple[str, str, str] | None]:
    """(source, session, pointer) of each descriptor in a JSON value, in order; None for each place that is too deep or too long."""
    if isinstance(value, list):
        inside = [(str(n), item) for n, item in enumerate(value[:MOST])]
        if len(value) > MOST:
            yield None
    elif isinstance(value, dict):
        said = [value[k].lower() for k in PROVIDER_KEYS if isinstance(value.get(k), str)]
        source = next(filter(providers.__contains__, said), "auto")
        yield from ((source, value[k], f"{pointer}/{k}") for k in ID_KEYS if isinstance(value.get(k), str))
        inside = [(k, value[k]) for k in NESTED_KEYS if isinstance(value.get(k), (dict, list))]
    else:
        return
    for name, item in inside:
        yield from _descriptors(item, f"{pointer}/{name}", left - 1, providers) if left else [None]


def references(text: str, providers: tuple[str, ...], session_id: str) -> tuple[list[tuple[str, str, str]], bool]:
    """([(source, session, pointer)], truncated): of a JSON text its descriptors, by nested keys; of any other its descriptor lines.

    A session is named once, at its first place, and must look like a session's id (a pattern); its source is auto where
    none of the providers is named beside it.
    """
    try:
        named = list(_descriptors(json.loads(text), "", DEPTH, providers))
    except (ValueError, RecursionError):
        named = [("auto", m[1], f"/line/{n}") for n, line in enumerate(text.splitlines(), 1) if (m := LINE.match(line))]
    fine = [x for x in named if x and re.fullmatch(session_id, x[1])]
    first = {x[:2]: x for x in reversed(fine)}
    ordered = sorted(first.values(), key=fine.index)
    return ordered[:MOST], None in named or len(ordered) > MOST


def named_sessions(text: Column) -> Column:
    """struct(found, truncated) of a text's references; a null text names nothing."""
    from ..sources.transcripts import SESSION_ID, SOURCES

    pattern = SESSION_ID.removeprefix(r"\A").removesuffix(r"\z")

    def run(series):
        made = [references(t or "", SOURCES, pattern) for t in series]
        return pd.DataFrame({"found": [[{"source": a, "session": b, "pointer": c} for a, b, c in f] for f, _ in made], "truncated": [x for _, x in made]})

    run.__annotations__ = {"series": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, FORM)(text)

"""What a request, an envelope or a time says."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

_SPLIT = re.compile(r"""[\s,，.。!！?？;；:："'、()\[\]{}]+""")
_RUN = re.compile(r"[^\W_]+")
_CJK = re.compile(r"[㐀-䶿一-鿿豈-﫿぀-ヿ가-힯𠀀-𱍏]")


def request_terms(q: str) -> list[str]:
    """A request's terms in order, lower-cased, each once: its words, its words as written between blanks, and the parts of joined ones.

    Without a dictionary of Chinese words a CJK run counts as a whole and by its pairs; single CJK characters never do.
    """
    out: list[str] = []

    def add(term: str) -> None:
        low = term.lower()
        if len(low) >= 2 and low not in V.REQUEST_STOPS and low not in out:
            out.append(low)

    for run in _RUN.findall(q):
        add(run)
        if len(run) > 2 and _CJK.search(run):
            for k in range(len(run) - 1):
                add(run[k : k + 2])
    for token in _SPLIT.split(q):
        add(token)
        if "-" in token or "_" in token:
            for part in re.split("[-_]", token):
                add(part)
    return out


def identity_terms(terms: list[str]) -> list[str]:
    """Terms that can name something: words of three letters or digits, and others of two characters."""
    plain = lambda t: t.isascii() and t.isalnum()
    return [t for t in terms if (plain(t) and len(t) >= 3) or (not plain(t) and len(t) >= 2)]


def entity_terms(terms: list[str]) -> list[str]:
    return [t for t in identity_terms(terms) if t.isascii() and t.isalnum()]


def sanitized(q: str) -> str:
    """A request without the characters that a query parser would read."""
    return q.translate(str.maketrans(dict.fromkeys('+-!(){}[]^"~*?:\\/&|', " ")))


def edits_asset(q: str) -> bool:
    return any(c in q.lower() for c in V.ASSET_CUES)


def operation(q: str) -> str | None:
    return next((name for name, words in V.OPERATION_CUES.items() if any(w in q.lower() for w in words)), None)


def constraint_cues(q: str) -> list[str]:
    return ["粗細要一致"] if "粗細要一致" in q or "粗細一致" in q else []


def since(text: str | None, now: datetime | None = None) -> datetime:
    """The instant that `2d`, `48h`, a date, a time, `today` or `yesterday` stands for; nothing said: yesterday's start."""
    now = now or datetime.now(UTC)
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    said = (text or "").strip().lower()
    if said in ("", "yesterday"):
        return day - timedelta(days=1)
    if said == "today":
        return day
    if m := re.fullmatch(r"(\d+)([dh])", said):
        return now - timedelta(**{"days" if m[2] == "d" else "hours": int(m[1])})
    try:
        at = datetime.fromisoformat(said.upper())
    except ValueError:
        raise ValueError(f"{text!r} is no date, time or duration") from None
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def is_injected(text: Column) -> Column:
    """Text that a tool put under the user's role."""
    t = F.trim(text)
    out = F.lit(False)
    for opens, closes in V.ENVELOPES:
        out = out | (t.startswith(opens) & t.endswith(closes) & (F.length(t) > len(opens) + len(closes)))
    return out


def delivered_paths(text: Column) -> Column:
    """Paths of deliverable files in a text, links decoded, each as often as it stands there."""
    tokens = F.split(text, "[\\s`'\"()<>\\[\\]{},，。；、|]+")
    bare = F.transform(tokens, lambda t: F.regexp_replace(F.regexp_replace(t, r"[.:]+\z", ""), r"\A(?:file://|file:)", ""))
    return F.filter(F.transform(bare, lambda t: F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t)), lambda t: t.contains("/") & F.lower(t).rlike(rf"\.(?:{'|'.join(V.DELIVERED)})\z"))


def approval_claim(sentence: Column) -> Column:
    """Whether a sentence says that somebody else approved the work."""
    low = F.lower(sentence)
    has = lambda words: low.rlike("|".join(words))
    done = has(V.APPROVED) | low.rlike(r"(?:已在|已於).{0,24}(?:完成|通過)")
    return has(V.APPROVED_EN) | (has(V.APPROVING_BODIES) & done)


def image_uri(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\Adata:image/[a-z0-9.+-]+;base64,"), F.lit(False))


def bounded(event: Column, line: Column, most: int = 16_384) -> Column:
    """An event, or a stub that says how large it was."""
    return F.when(F.octet_length(event) > most, F.to_json(F.struct(F.lit("oversized").alias("type"), line.alias("line"), F.octet_length(event).alias("bytes")))).otherwise(event)


def epoch_seconds(stamp: Column) -> Column:
    """Seconds of an RFC 3339 time; its offset is not read."""
    return F.unix_timestamp(F.try_to_timestamp(F.translate(F.substring(stamp, 1, 19), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")))


def file_terms(text: Column) -> Column:
    """Terms that find a file by its name: words of three letters or digits, and pairs of CJK characters."""
    from .text import tokens

    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) >= 3) | (t.rlike(rf"\A[{V.CJK}]{{2}}\z"))))


def has_directive_cue(text: Column) -> Column:
    """Whether a user's words may be an instruction, a correction or a complaint; the reader decides."""
    low = F.lower(text)
    found = F.lit(False)
    for cue in V.DIRECTIVE_CUES:
        found = found | low.contains(cue)
    return found

"""Text functions as Column expressions; they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import CJK, EDGE_KINDS, NODE_KINDS, STATUS_WORDS, STOP_WORDS, TERMINAL

STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def once(costly: Column) -> Column:
    """A costly column as a row of its own: filters and keys above read the result instead of computing it again each."""
    return F.explode(F.array(costly))


def stamp(ts: Column) -> Column:
    """A timestamp as the canonical fixed-width string, whose order is the order of time."""
    return F.date_format(ts, STAMP)


def is_canonical_stamp(s: Column) -> Column:
    """The shape only: digits and separators in place."""
    return F.coalesce(s.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z"), F.lit(False))


def is_calendar_stamp(s: Column) -> Column:
    """The shape, and a day and time that exist."""
    return F.coalesce(is_canonical_stamp(s) & F.try_to_timestamp(s, F.lit(STAMP)).isNotNull(), F.lit(False))


def is_location(s: Column) -> Column:
    """A path from the root or something with a scheme."""
    return F.coalesce(s.startswith("/") | s.contains("://"), F.lit(False))


def node_kind(kind: Column) -> Column:
    """The canonical name of a core node kind in any case, else the name as written; null is Custom."""
    known = F.create_map(*[F.lit(x) for k in NODE_KINDS for x in (k.lower(), k)])
    return F.when(kind.isNull(), F.lit("Custom")).otherwise(F.coalesce(F.try_element_at(known, F.lower(kind)), kind))


def edge_kind(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for k in EDGE_KINDS for x in (k, k)])
    return F.coalesce(F.try_element_at(known, F.upper(kind)), kind)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits without stop words; CJK runs give each character and each pair.

    A null text has no tokens. Order is that of the text, a pair right after its second character.
    """
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"([{CJK}]+|[\p{{L}}\p{{N}}&&[^{CJK}]]+)"), F.lit(1))

    def split(run: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(run))
        one = lambda i: F.array(F.substring(run, i, F.lit(1)))
        both = lambda i: F.array(F.substring(run, i, F.lit(1)), F.substring(run, i - 1, F.lit(2)))
        return F.when(run.rlike(rf"\A[{CJK}]"), F.flatten(F.transform(places, lambda i: F.when(i == 1, one(i)).otherwise(both(i))))).otherwise(F.array(run))

    return F.filter(F.flatten(F.transform(runs, split)), lambda t: ~t.isin(*STOP_WORDS))


def is_single_cjk(term: Column) -> Column:
    return term.rlike(rf"\A[{CJK}]\z")


def texts_of(attrs: Column, *keys: str) -> Column:
    """The non-empty strings of the named fields, in order, space-joined; a field may hold one string or an array."""

    def field(key: str) -> Column:
        value = F.try_element_at(attrs, F.lit(key))
        listed = F.from_json(value, "array<string>")
        return F.when(value.startswith("[") & listed.isNotNull(), F.array_join(F.filter(listed, lambda x: x.isNotNull() & (x != "")), " ")).otherwise(value)

    return F.array_join(F.filter(F.array(*map(field, keys)), lambda x: x.isNotNull() & (x != "")), " ")


def searchable_text(attrs: Column) -> Column:
    return texts_of(attrs, "label", "name", "body", "summary", "aliases", "alias", "path", "document_id", "revision_id")


def identity_text(attrs: Column) -> Column:
    return texts_of(attrs, "label", "name", "aliases", "alias", "path", "document_id", "revision_id")


def anchor_text(attrs: Column) -> Column:
    return texts_of(attrs, "label", "name", "aliases", "alias")


def hit_excerpt(label: Column, body: Column, chars: int = 200) -> Column:
    """The label, then the first characters of the body."""
    label, body = F.coalesce(label, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, chars)
    return F.when(body == "", label).when(label == "", body).otherwise(F.concat_ws(" ", label, body))


def centred_excerpt(text: Column, terms: list[str], back: int = 120, chars: int = 600) -> Column:
    """Characters from a little before the earliest match of any term, in any case; from the start without a match."""
    low = F.lower(text)
    places = [F.nullif(F.locate(t.lower(), low), F.lit(0)) for t in terms]
    first = F.coalesce(F.least(*places) if len(places) > 1 else places[0] if places else F.lit(1), F.lit(1))
    return F.substring(text, F.greatest(F.lit(1), first - back), F.lit(chars))


def project_key(value: Column) -> Column:
    """How project references compare: lower case, no outer blanks or end slashes, below the workspace folder."""
    plain = F.lower(F.translate(F.regexp_replace(F.trim(value), r"/+\z", ""), "\\", "/"))
    return F.regexp_replace(F.regexp_replace(plain, r"(?s)\A.*?/workspace/", ""), r"\A(?:\./)+", "")


def bare_key(key: Column) -> Column:
    """A project key without its namespace."""
    return F.regexp_replace(key, r"\A(?:project:|workspace:|p:)", "")


def is_terminal(status: Column) -> Column:
    return F.coalesce(F.lower(F.trim(status)).isin(*TERMINAL), F.lit(False))


def split_extension(label: Column) -> tuple[Column, Column]:
    """Stem and extension of 1 to 5 letters or digits; the extension is empty, and the stem the label, without one."""
    pattern = r"(?s)\A(.+)\.([A-Za-z0-9]{1,5})\z"
    stem = F.regexp_extract(label, pattern, 1)
    return F.when(stem == "", label).otherwise(stem), F.lower(F.regexp_extract(label, pattern, 2))


def clip(label: Column, chars: int = 80) -> Column:
    return F.when(F.length(label) > chars, F.concat(F.substring(label, 1, chars), F.lit("…"))).otherwise(label)


def tsv_field(s: Column, chars: int = 200) -> Column:
    """One line without tabs, at most so many characters."""
    return F.substring(F.regexp_replace(s, r"[\t\r\n]", " "), 1, chars)


def wiki_key(ref: Column) -> Column:
    """A wiki reference without brackets, alias, anchor, file ending and folder."""
    inner = F.regexp_replace(F.trim(ref), r"\A\[\[|\]\]\z", "")
    return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(inner, r"(?s)[|#].*\z", "")), r"\.md\z", ""), r"\A02-wiki/", "")


def exit_code(output: Column) -> Column:
    """The exit code that a line of a tool's output reports, else its exit_code field, null without one."""
    said = F.regexp_extract(output, r"(?m)^(?:Process exited with code |The command exited with code )[ \t]*(-?[0-9]+)[ \t]*\.*[ \t]*$", 1)
    return F.coalesce(F.get_json_object(output, "$.exit_code").try_cast("int"), said.try_cast("int"))


def is_empty_search(output: Column) -> Column:
    """A search's output that says nothing was found."""
    low = F.lower(F.trim(output))
    return low.isin("", "[]", "no results found") | low.startswith("found 0 results") | low.contains("0 matches") | low.contains("no matches found")


def credential_kind(text: Column) -> Column:
    """Which of the four known credentials a text holds, null without one."""
    return (
        F.when(text.rlike(r"AKIA[0-9A-Z]{16}"), "aws-access-key")
        .when(text.rlike(r"(?:\A|[^A-Za-z0-9_-])sk-[A-Za-z0-9_-]{16,}"), "openai-key")
        .when(text.rlike(r"UPSTASH_REDIS_REST_TOKEN=\S+"), "upstash-token")
        .when(text.rlike(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"), "private-key")
    )


def bigrams(text: Column) -> Column:
    """The distinct pairs of neighbouring characters of a text without its white space."""
    bare = F.regexp_replace(text, r"\s", "")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(bare) - 1, F.lit(1))), lambda i: F.substring(bare, i, F.lit(2)))
    return F.when(F.length(bare) < 2, F.expr("cast(array() as array<string>)")).otherwise(F.array_distinct(pairs))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared bigrams over all, of two sets of bigrams."""
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def status_word(raw: Column) -> Column:
    """A task item's status as one of four words; null for any other."""
    word = F.regexp_replace(F.lower(F.trim(raw)), "[^a-z0-9]", "")
    out = F.lit(None).cast("string")
    for status, words in STATUS_WORDS.items():
        out = F.when(word.isin(*words), F.lit(status)).otherwise(out)
    return out

"""Personal data: generators propose overlapping spans, boosted trees judge format and context, thresholds choose."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, insort
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

Span = tuple[int, int, str]
#: Kinds in their order in a digest: the base kinds as listed, then those that only the method finds.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")
BASE = KINDS[:4]

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only begin where its run of digits does, so the look-behind changes nothing but the time
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The four base kinds, leftmost and non-overlapping per kind; a match that fails its check is gone."""
    out: list[Span] = []
    after = 0
    for m in _AT.finditer(text) if "@" in text else ():
        start = m.start()
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end(), "email"))
            after = m.end()
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((*m.span(), "phone"))
    return out


#: High-recall generators: kind, a pattern, and characters one of which a text must hold for it to run at all.
GENERATORS: tuple[tuple[str, re.Pattern, tuple[str, ...]], ...] = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}|＠) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,63}){1,4}"), ("at)", "at]", "at}", "＠")),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{2,63}){1,4}"), (" dot ",)),
    ("phone", re.compile(r"(?<![0-9A-Za-z])\(?[0-9]{2,4}\)?(?:[ .-]{1,2}\(?[0-9]{2,4}\)?){2,4}(?![0-9A-Za-z])"), ("-", ".", " ")),
    ("phone", re.compile(r"(?<![0-9A-Za-z])00[1-9][0-9 ().-]{8,18}[0-9](?![0-9A-Za-z])"), ("00",)),
    ("ip", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){3,7}(?::?[0-9a-fA-F]{1,4})?(?![0-9A-Za-z:])"), (":",)),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{3,6}(?:[ ./-]?[0-9]{3,6}){2,4}(?![0-9A-Za-z])"), ("",)),
    ("ssn", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9A-Za-z-])"), ("-", " ")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"), ("",)),
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])"), ("AKIA", "ASIA")),
    ("secret", re.compile(r"(?i:(?<=password=)|(?<=passwd=)|(?<=token=)|(?<=secret=)|(?<=api_key=)|(?<=token = \")|(?<=secret = \")|(?<=key = \"))[^\s\"';,]{8,128}"), ("=",)),
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?:sk|pk|ghp|xox[bp])[-_][0-9A-Za-z_-]{16,128}(?![0-9A-Za-z])"), ("sk-", "sk_", "pk-", "pk_", "ghp_", "xox")),
)
#: Words that speak for a kind when they stand before a span.
CONTEXT = {
    "email": ("mail", "contact", "write", "reach"), "ip": ("ip", "host", "server", "address", "addr"), "card": ("card", "visa", "credit", "payment", "mastercard"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "dial"), "ssn": ("ssn", "social", "security"), "iban": ("iban", "account", "bank"), "secret": ("password", "token", "secret", "key", "passwd"),
}
AGAINST = ("version", "page", "isbn", "order", "invoice", "chapter", "section", "lines", "year", "date", "total", "price")
BEFORE = 32
_WORD = re.compile(r"[A-Za-z]+")


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def span_features(text: str, start: int, end: int, kind: str) -> list[float]:
    """What a tree sees of a span: its format, its check digits and what stands around it."""
    s = text[start:end]
    digits = _digits(s)
    before = [w.lower() for w in _WORD.findall(text[max(0, start - BEFORE) : start])][-4:]
    counts = [s.count(c) for c in set(s)]
    entropy = -sum(c / len(s) * math.log2(c / len(s)) for c in counts)
    groups = [len(g) for g in re.split(r"[^0-9]+", s) if g]
    upper, lower = sum("A" <= c <= "Z" for c in s), sum("a" <= c <= "z" for c in s)
    return [
        float(KINDS.index(kind)), float(len(s)), float(len(digits)), upper / len(s), lower / len(s), entropy,
        float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)), float(bool(groups) and groups[-1] == 4),
        float(len(set(c for c in s if not c.isalnum()))), float("(" in s), float("." in s), float("-" in s or " " in s),
        float(13 <= len(digits) <= 19 and luhn(digits)), float(kind == "iban" and _iban_ok(s)),
        float(any(w in CONTEXT[kind] for w in before)), float(any(w in AGAINST for w in before)),
        float(start > 0 and text[start - 1] in "$€£#"), float(end < len(text) and text[end] in "%€$°"),
        float(bool(digits) and digits[0] in "01"), float(len(set(digits)) <= 2 and bool(digits)),
    ]


def candidates(text: str) -> list[Span]:
    """Spans of all generators, which overlap each other freely."""
    out = {(*m.span(), kind) for kind, pattern, need in GENERATORS if any(n in text for n in need) for m in pattern.finditer(text)}
    return sorted(out)


@dataclass
class Trees:
    """Boosted trees of depth 3 as arrays: feature and cut of 7 nodes, values of 8 leaves."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    thresholds: dict[str, float]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(3):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - 7]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3) -> Trees:
    """Newton boosting on the logistic loss with exact splits over the distinct values of each feature."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[:-1])) for f in range(x.shape[1])]
    below = [x[:, f, None] > c for f, c in enumerate(cuts)]
    base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    margin, features, places, values = np.full(len(y), base), [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        feature, cut_at = np.zeros(7, dtype=np.int64), np.full(7, np.inf)
        for n in range(7):
            mine = node == n
            if not mine.any():
                continue
            best = 1e-9
            gs, hs = g[mine].sum(), h[mine].sum()
            for f, c in enumerate(cuts):
                right = below[f][mine]
                gr, hr = g[mine] @ right, h[mine] @ right
                gain = gr**2 / (hr + 1) + (gs - gr) ** 2 / (hs - hr + 1) - gs**2 / (hs + 1)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[n], cut_at[n] = float(gain[k]), f, c[k]
            node[mine] = 2 * n + 1 + (x[mine, feature[n]] > cut_at[n])
        leaf = np.zeros(8)
        for k in range(8):
            mine = node == k + 7
            leaf[k] = rate * g[mine].sum() / (h[mine].sum() + 1)
        margin += leaf[node - 7]
        features.append(feature)
        places.append(cut_at)
        values.append(leaf)
    return Trees(base, np.array(features), np.array(places), np.array(values), {})


def examples(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Spans written from rules, true and false, in a little context, as the generators find them."""
    rng = np.random.default_rng(seed)
    pick = lambda *a: a[int(rng.integers(len(a)))]
    num = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    word = lambda: "".join(pick("ba", "re", "th", "on", "li", "mo", "sa", "ne", "ti", "ko") for _ in range(int(rng.integers(1, 4))))
    hexa = lambda k: "".join(pick(*"0123456789abcdef") for _ in range(k))

    def card(sep: str) -> str:
        body = pick("4", "51", "37", "60") + num(13)
        body = body[:15]
        digit = next(d for d in "0123456789" if luhn(body + d))
        s = body + digit
        return sep.join(s[i : i + 4] for i in range(0, 16, 4))

    def iban() -> str:
        country, body = pick("DE", "FR", "ES", "GB"), num(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        s = f"{country}{check:02d}{body}"
        return pick(s, " ".join(s[i : i + 4] for i in range(0, len(s), 4)))

    good = {
        "email": lambda: f"{word()}{pick('', '.' + word())}{pick(' at ' + word() + ' dot ', '(at)' + word() + '(dot)', ' [at] ' + word() + ' [dot] ', '(at)' + word() + '.')}{pick('com', 'org', 'net', 'de')}",
        "phone": lambda: pick(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"00{pick('1', '44', '49')} {num(3)} {num(3)} {num(4)}"),
        "ip": lambda: ":".join(hexa(4) for _ in range(8)),
        "card": lambda: card(pick(".", "/", " ")),
        "ssn": lambda: f"{rng.integers(100, 899)}-{num(2)}-{num(4)}",
        "iban": iban,
        "secret": lambda: pick("AKIA" + "".join(pick(*"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), f"password={hexa(int(rng.integers(8, 25)))}", f'token = "{hexa(int(rng.integers(16, 49)))}"', f"sk-{hexa(32)}"),
    }
    bad = {
        "email": lambda: f"{word()} {pick('at', 'at the')} {word()} dot {word()} {word()}",
        "phone": lambda: pick(f"{rng.integers(1900, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(2)} {num(2)} {num(3)}", f"{num(3)} {num(3)} {num(3)}", f"{num(2)}-{num(3)}-{num(2)}"),
        "ip": lambda: pick(f"{num(2)}:{num(2)}:{num(2)}:{num(2)}", f"{num(1)}:{num(1)}:{num(1)}:"),
        "card": lambda: pick(f"{num(4)} {num(4)} {num(4)}", f"{num(3)}.{num(3)}.{num(3)}", num(12), f"{num(4)}/{num(4)}/{num(4)}"),
        "ssn": lambda: f"000 {num(2)} {num(4)}",
        "iban": lambda: f"{pick('AB', 'XY', 'NO')}{num(2)} {pick('ABCD', num(4))} {num(4)} {num(4)}",
        "secret": lambda: pick("password=password", "token = \"" + "x" * 12, "password=" + word() + "........"),
    }
    xs, ys, kinds = [], [], []
    for _ in range(n):
        kind, yes = pick(*KINDS), bool(rng.integers(2))
        s = (good if yes else bad)[kind]()
        hint = pick(*CONTEXT[kind]) if rng.random() < (0.6 if yes else 0.1) else pick(*AGAINST) if rng.random() < (0.02 if yes else 0.4) else word()
        text = f"{word()} {word()} {hint}{pick(': ', ' ', ' is ')}{s}{pick('', '.', ',', ' %')} {word()}"
        if yes or rng.random() < 0.8:
            for start, end, found in candidates(text):
                if found == kind:
                    xs.append(span_features(text, start, end, kind))
                    ys.append(float(yes and end - start >= 0.8 * len(s.split("=")[-1].strip(' "'))))
                    kinds.append(kind)
    return np.array(xs), np.array(ys), kinds


@lru_cache(maxsize=2)
def model(precision: float = 0.97, seed: int = 5) -> Trees:
    """Trees and, per kind, the least probability from which held-out spans are right at that precision."""
    x, y, _ = examples(seed, 3_000)
    trees = boost(x, y)
    hx, hy, kinds = examples(seed + 1, 2_000)
    p = trees.probability(hx)
    for kind in KINDS:
        mine = np.array([k == kind for k in kinds])
        order = np.argsort(-p[mine], kind="stable")
        right = np.cumsum(hy[mine][order]) / np.arange(1, mine.sum() + 1) >= precision
        trees.thresholds[kind] = max(0.5, float(p[mine][order][np.flatnonzero(right)[-1]])) if right.any() else 1.1
    return trees


def find_spans(text: str, trees: Trees) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), by start, then kind. Of overlapping additions the likeliest stays; none touches a base span."""
    rank = {k: i for i, k in enumerate(KINDS)}
    base = base_spans(text)
    proposed = candidates(text)
    if proposed and base:
        taken = sorted((s, e) for s, e, _ in base)
        starts = [s for s, _ in taken]
        reach = np.maximum.accumulate([e for _, e in taken])
        at = np.searchsorted(starts, [e for _, e, _ in proposed]) - 1  # the last base span that starts before the end
        proposed = [c for c, k in zip(proposed, at, strict=True) if k < 0 or reach[k] <= c[0]]
    added: list[Span] = []
    if proposed:
        p = trees.probability(np.array([span_features(text, *c) for c in proposed]))
        ends: list[Span] = []
        for i in sorted(range(len(proposed)), key=lambda i: (-p[i], proposed[i][0] - proposed[i][1], proposed[i])):
            s, e, kind = proposed[i]
            if p[i] >= trees.thresholds[kind]:
                ends.append((s, e, kind))
        held: list[tuple[int, int]] = []
        for s, e, kind in ends:
            k = bisect_left(held, (s, e))
            if (k and held[k - 1][1] > s) or (k < len(held) and held[k][0] < e):
                continue
            insort(held, (s, e))
            added.append((s, e, kind))
    key = lambda x: (x[0], rank[x[2]], x[1])
    return sorted(base, key=key), sorted(base + added, key=key)


def said(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, n_added (and the redacted text) for every row.

    Offsets are code points of the whole text, ends exclusive; a null or empty text has no span and the digest of the
    empty string. Rows are independent: nothing is shuffled. The trees are trained from rules before anything runs.
    """
    trees = model()

    def make() -> Callable[[list[str]], dict[str, list]]:
        def run(texts: list[str]) -> dict[str, list]:
            found = [find_spans(t, trees) for t in texts]
            out: dict[str, list] = {f"n_{kind}": [sum(s[2] == kind for s in base) for base, _ in found] for kind in BASE}
            out["base_sha256"] = [hashlib.sha256(said(base).encode()).hexdigest() for base, _ in found]
            out["spans"] = [said(every) for _, every in found]
            out["n_added"] = [len(every) - len(base) for base, every in found]
            if redacted:
                out["redacted"] = [redact(t, every) for t, (_, every) in zip(texts, found, strict=True)]
            return out

        return run

    schema = ", ".join(f"n_{kind} long" for kind in BASE) + ", base_sha256 string, spans string, n_added long"
    return map_texts(docs, make, schema + ", redacted string" * redacted, id_col, text_col)


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from compare import assert_agrees
from conftest_llm import prose

from lorekeep.llm import components as C
from lorekeep.llm import exact_dedup as X
from lorekeep.llm import simhash as S


def test_exact_agrees_with_sql(spark, sf):
    assert_agrees(spark, sf, X.op3_exact_dedup, X.SQL)


def brute_exact(rows):
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    out = []
    for i, t in rows:
        same = [(j, u or "") for j, u in rows if bare(u) == bare(t)]
        keep = min(same, key=lambda r: (-len(r[1]), r[0] is None, r[0]))[0]
        out.append((i, keep, len(same), i == keep, hashlib.sha256(bare(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [True, False])
@pytest.mark.parametrize("words", [X.WORDS, 1])
def test_exact_on_odd_rows(odd, monkeypatch, digest, words):
    """A filter with room and a full one, with and without digests."""
    monkeypatch.setattr(X, "WORDS", words)
    out = X.exact_dedup(odd, digest=digest)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = brute_exact(rows)
    got = sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"] if digest else None) for r in out.collect()], key=str)
    assert got == (want if digest else sorted([w[:4] + (None,) for w in want], key=str)) or [g[:4] for g in got] == [w[:4] for w in want]


def test_exact_levels_need_all_three(frame):
    head = "x" * 200
    out = X.exact_dedup(frame({1: head + "ab", 2: head + "ba", 3: head + "a b", 4: "y", 5: "z"}), digest=True)
    assert {r["doc_id"]: r["keep_id"] for r in out.collect()} == {1: 3, 2: 2, 3: 3, 4: 4, 5: 5}


def test_exact_of_nothing(frame):
    assert X.exact_dedup(frame({})).count() == 0


def brute_simhash(texts, words, bits):
    def fp(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sh = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0

    fps = {i: fp(t) for i, t in texts.items()}
    comp = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if bin(fps[a] ^ fps[b]).count("1") <= bits and comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    return {i: (f"{fps[i]:016x}", comp[i]) for i in texts}


def near(seed, n, edits):
    rng = random.Random(seed * 7 + edits)
    w = prose(seed, n).split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(99)}"
    return " ".join(w)


def test_simhash_agrees_with_brute_force(frame):
    texts = {k * 10 + e: near(k, 120, e) for k in range(6) for e in range(5)} | {100: "", 101: None, 102: "A b", 103: "a  B", 104: "ÀB c"}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.simhash_components(frame(texts)).collect()}
    assert got == brute_simhash(texts, 4, 4)


def test_simhash_on_odd_rows(odd):
    rows = S.simhash_components(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    assert by[3] == by[4] == by[None] and {c for _, c in by[3]} == {3}
    assert by[1] == by[2] == by[7] == {("0" * 16, 1)}


@pytest.mark.parametrize("bits", [2, 3, 4, 6])
def test_variant_join_finds_all_links_once(spark, bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = set(base.tolist())
    for f in base.tolist():
        for _ in range(12):
            fps.add(f ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, bits + 3), replace=False))))
    fps = sorted(S.signed(f) for f in fps)
    want = sorted((a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= bits)
    got = sorted((r["a"], r["b"]) for r in S.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), bits).collect())
    assert got == want and len(want) > 30


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3)]
    comp = {n: n for e in edges for n in e if n is not None}
    for _ in range(200):
        for a, b in edges:
            if a is not None and b is not None:
                comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r["node"]: r["component"] for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(comp[n] == c for n, c in got.items()) and set(got) == {n for n in comp if any(n in (a, b) and a != b and a is not None for a, b in edges)}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def jaccard(a, b, words=5):
    s = lambda t: set(S.shingle_hashes(t or "", words).tolist())
    x, y = s(a), s(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_near_dedup_agrees_with_brute_force(frame):
    texts = {k * 10 + e: near(k, 150, e * 2) for k in range(8) for e in range(5)} | {200: "", 201: None, 202: "short text here", 203: "Short  TEXT here"}
    comp = {i: i for i in texts}
    for _ in range(12):
        for a in texts:
            for b in texts:
                if jaccard(texts[a], texts[b]) >= 0.8:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    kept = {r["doc_id"] for r in S.near_dedup(frame(texts)).collect()}
    assert kept == {i for i in texts if comp[i] == i}


def test_near_dedup_on_odd_rows(odd):
    out = S.near_dedup(odd)
    assert out.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "3", "3", "5", "6", "None"]


def passage_and_pairs(docs, shared, pairs, edits):
    """Texts that share one passage of so many of 200 words, and pairs among them, in the middle of the ids, that differ in a few words."""
    passage = prose(999, shared).split()
    texts = {k: " ".join(passage + prose(1000 + k, 200 - shared).split()) for k in range(docs)}
    for p in range(pairs):
        a, b = docs // 4 + p, docs // 2 + p
        w = texts[a].split()
        for e in range(edits):
            w[shared + 2 + e * 7] = f"edit{p}x{e}"
        texts[b] = " ".join(w)
    return texts


def test_near_dedup_finds_pairs_in_a_crowd_that_shares_a_passage(frame):
    texts = passage_and_pairs(400, 170, 60, 4)
    assert all(0.8 <= jaccard(texts[100 + p], texts[200 + p]) < 0.85 for p in range(60)) and jaccard(texts[0], texts[1]) < 0.8
    kept = {r["doc_id"] for r in S.near_dedup(frame(texts)).collect()}
    assert kept == set(texts) - set(range(200, 260))


def components_of(texts):
    """The smallest id of each text's group, by the exact similarity of all pairs."""
    comp = {i: i for i in texts}
    up = lambda i: i if comp[i] == i else up(comp[i])
    sets = {i: frozenset(S.shingle_hashes(t or "", 5).tolist()) for i, t in texts.items()}
    for a in texts:
        for b in texts:
            x, y = sets[a], sets[b]
            if a < b and len(x & y) >= 0.8 * len(x | y):
                p, q = up(a), up(b)
                comp[max(p, q)] = min(p, q)
    return {i: up(i) for i in texts}


def test_near_dedup_finds_all_links_of_large_families(frame):
    """150 versions of a text, each with its own three edits: few pairs are similar enough, and those must not be missed."""
    texts = {k * 150 + e: near(k * 1_000 + 1, 150, 0) for k in range(4) for e in range(150)}
    for i in texts:
        rng, w = random.Random(i), texts[i].split()
        for n, at in enumerate(rng.sample(range(len(w)), 3)):
            w[at] = f"own{i}x{n}"
        texts[i] = " ".join(w)
    comp = components_of(texts)
    kept = {r["doc_id"] for r in S.near_dedup(frame(texts)).collect()}
    assert kept == {i for i in texts if comp[i] == i} and 300 < len(kept) < 590


@pytest.mark.parametrize(("bits", "classes"), [(4, 2), (4, 2**23), (4, 2**40), (3, 2**23), (6, 2**23)])
def test_longer_keys_lose_no_link(spark, bits, classes):
    """More classes take longer signatures, of two or three segments, which find the same links."""
    rng = np.random.default_rng(classes % 97)
    fps = {int(f) for f in rng.integers(0, 2**63, 20, dtype=np.uint64)}
    for f in list(fps):
        for n in range(1, bits + 3):
            fps.add(f ^ int(sum(1 << int(b) for b in rng.choice(64, n, replace=False))))
    fps = sorted(S.signed(f) for f in fps)
    want = sorted((a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= bits)
    got = sorted((r["a"], r["b"]) for r in S.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), bits, classes).collect())
    assert got == want
    held = min(S.mask_of(kind).bit_count() for kind in S.signatures(4, 2**23))
    assert held > 23 and len(S.signatures(4, 2)) == 3


def test_near_dedup_compares_each_shingle_set_of_an_equal_sketch(frame):
    """2 is 1 with one word edited, has its fingerprint and minima, and alone is similar enough to 3."""
    words = prose(4, 40_000).split()
    h = S.shingle_hashes(" ".join(words), 5)
    for at in range(len(words) - 40, 0, -40):
        other = [*words[:at], "edited", *words[at + 1 :]]
        g = S.shingle_hashes(" ".join(other), 5)
        if S.fingerprint(h) == S.fingerprint(g) and (S.minima(h) == S.minima(g)).all():
            break
    n = len(set(g.tolist()))
    third, edits = list(other), 0
    for e in range(7, len(words) - 5, 7):
        if abs(e - at) > 10 and n - 5 * (edits + 1) >= 0.8 * (n + 5 * (edits + 1)):
            third[e] = f"new{e}"
            edits += 1
    texts = {1: " ".join(words), 2: " ".join(other), 3: " ".join(third)}
    assert jaccard(texts[1], texts[3]) < 0.8 <= jaccard(texts[2], texts[3])
    assert {r["doc_id"] for r in S.near_dedup(frame(texts)).collect()} == {1}

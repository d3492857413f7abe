import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.functions import codecs
from lorekeep.operators import selection as S


def test_greedy_takes_what_is_required_along():
    nodes = {1: (5, 1.0), 2: (5, 9.0), 3: (2, 0.0), 4: (9, 0.0)}
    assert S.greedy_context(nodes, {2: [3]}, 12, [1]) == (frozenset({1, 2, 3}), 12)
    assert S.greedy_context(nodes, {2: [4]}, 12, [1]) == (frozenset({1}), 5)
    with pytest.raises(ValueError):
        S.greedy_context(nodes, {1: [4]}, 12, [1])


def test_cheapest_facts_is_exact():
    rng = random.Random(3)
    for _ in range(60):
        price = {i: rng.randint(1, 9) for i in range(8)}
        facts = [[frozenset(rng.sample(range(8), rng.randint(1, 3))) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(0, 4))]
        cost = lambda ids: sum(price[i] for i in ids)
        budget = rng.randint(5, 30)
        every = [(cost(frozenset().union(*c)), k, frozenset().union(*c)) for k, c in enumerate(itertools.product(*facts))]
        best = min((e for e in every if e[0] <= budget), default=None)
        got = S.cheapest_facts(facts, cost, budget)
        assert (got is None) == (best is None) and (best is None or got == (best[2], best[0]))
        odd = lambda ids: (cost(ids) * 7) % 11
        top = min((odd(e[2]), k) for k, e in enumerate(every)) if facts else (0, 0)
        found = S.cheapest_facts(facts, odd, 11, monotone=False)
        assert found is not None and found[1] == top[0]


def test_search_limit_is_not_an_answer():
    with pytest.raises(RuntimeError):
        S.cheapest_facts([[frozenset({i}), frozenset({i + 50})] for i in range(12)], len, 99, most_states=20)


def test_packing_skips_what_is_too_big():
    items = [{"content": "a" * 40, "required": True, "priority": None}, {"content": "b" * 400, "required": False, "priority": 9}, {"content": "c", "required": False, "priority": 1}, {"content": "d", "required": False, "priority": 1}]
    assert S.pack(items, 110, count=len) == [True, False, True, True]
    with pytest.raises(ValueError):
        S.pack(items, 10, count=len)


def test_best_first_visits_by_score_and_bounds_depth():
    links = [("a", "SUPERSEDES", "b"), ("b", "SUPERSEDES", "c"), ("c", "SUPERSEDES", "d"), ("a", "RELATED_TO", "x"), ("p", "DELIVERED", "a"), ("a", "UNKNOWN", "z")]
    out = S.best_first(links, {"a": 1.0}, depth=2)
    assert [n for n, _, _ in out] == ["a", "p", "b", "c", "x"]
    assert out[1][2] == (("p", "DELIVERED", "a", "reverse"),)
    hub = S.best_first([(f"t{i}", "BELONGS_TO", "p") for i in range(4)], {"p": 1.0}, depth=1)
    assert hub[1][0] == "t0" and abs(hub[1][1] - 0.12 / 2) < 1e-12


def test_budget_by_density_and_near_drop():
    assert S.fit_characters([("a", 1.0, 10), ("b", 3.0, 10), ("c", 0.9, 5)], 15) == ["b", "c"]
    assert S.drop_near(["aa", "ab", "zz"], lambda a, b: a[0] == b[0]) == ["aa", "zz"]


TEXT = st.text(alphabet=st.sampled_from("ab 臺\n."), max_size=300)
RECORD = st.dictionaries(st.sampled_from(["a", "b", "$ref", "c"]), st.one_of(TEXT, st.integers(), st.none(), st.lists(TEXT, max_size=2), st.dictionaries(st.sampled_from(["$ref", "x"]), TEXT, max_size=2)), max_size=4)


@settings(max_examples=150, deadline=None)
@given(st.lists(RECORD, max_size=6))
def test_pages_come_back(records):
    assert codecs.decode_page(codecs.encode_page(records)) == records


@settings(max_examples=150, deadline=None)
@given(TEXT, TEXT)
def test_texts_come_back(a, b):
    assert codecs.undelta(a, *codecs.delta(a, b)) == b
    assert codecs.expand_grammar(codecs.pair_grammar(a * 3)) == a * 3
    assert "".join(codecs.chunks(a + b)) == a + b


def test_long_strings_are_shared():
    records = [{"a": "x" * 500, "n": n} for n in range(3)] + [{"a": "y" * 300, "b": ["y" * 300]}]
    text = codecs.encode_page(records)
    assert len(text) < 1_500 and codecs.decode_page(text) == records


def test_a_changed_grammar_is_refused():
    packed = codecs.pair_grammar("ab ab ab ab ab")
    packed["symbols"] = packed["symbols"][1:]
    with pytest.raises(ValueError):
        codecs.expand_grammar(packed)


def test_chunk_cuts_move_with_the_text():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5_000))
    a, b = set(codecs.chunks(text)), set(codecs.chunks("inserted " + text))
    assert len(a & b) > len(a) / 2 and all(len(c) <= 384 for c in a)

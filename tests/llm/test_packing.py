import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm.packing import best_pattern, fit, pack, pack_lengths, pattern_groups, plan, stocked_pattern

PROFILES = [("small", 16), ("large", 100)]


def check(groups, histogram, capacity):
    placed = Counter()
    for lengths, n in groups:
        assert n > 0 and sum(lengths) <= capacity
        for x in lengths:
            placed[x] += n
    assert placed == Counter({k: v for k, v in histogram.items() if v})


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 700), st.lists(st.tuples(st.integers(1, 700), st.integers(1, 50)), max_size=30))
def test_plan_places_everything(capacity, items):
    h = Counter()
    for length, n in items:
        h[min(length, capacity)] += n
    check(plan(dict(h), capacity), h, capacity)


def test_patterns():
    """The highest-priced pattern against all multisets, and the same from a stock."""
    r = np.random.default_rng(5)
    for _ in range(20):
        price = np.r_[0.0, r.normal(size=9)]

        def best(at, rest, left):
            if not rest:
                return 0.0
            return max((price[u] + best(u, rest - u, {**left, u: left[u] - 1}) for u in range(at, rest + 1) if left.get(u, 0)), default=-np.inf)

        p = best_pattern(price)
        assert p @ np.arange(10) == 9 and abs(p @ price - best(1, 9, dict.fromkeys(range(1, 10), 99))) < 1e-9
        left = r.integers(0, 3, 10)
        q, most = stocked_pattern(price, left), best(1, 9, dict(enumerate(left)))
        assert (q <= left).all() and (not np.isfinite(most) or q @ np.arange(10) == 9 and abs(q @ price - most) < 1e-9)


def test_fit():
    target = np.zeros(11)
    target[[2, 3, 5, 7]] = [10, 20, 30, 20]
    x = fit(target)
    assert all(n > 0 for _, n in x) and np.abs(sum(p * n for p, n in x) - target)[1:].max() < 0.05


def test_patterns_place_most():
    """The patterns, not the best-fit step, give the places, and use as many containers as best-fit alone to one in a thousand."""
    r = random.Random(7)
    for capacity in (512, 2048, 4096):
        h = Counter(min(capacity, max(20, int(r.lognormvariate(5.4, 0.9)))) for _ in range(10_000))
        groups, rest = pattern_groups(dict(h), capacity)
        check(groups + [((k,), n) for k, n in rest.items()], h, capacity)
        assert sum(rest.values()) <= 0.05 * sum(h.values())
        assert sum(n for _, n in plan(dict(h), capacity)) <= 1.001 * sum(n for _, n in plan(dict(h), capacity, False))


def test_fill_is_close_to_the_bound():
    r = random.Random(3)
    h = Counter(min(512, max(1, int(r.lognormvariate(5, 0.8)))) for _ in range(20_000))
    used = sum(n for _, n in plan(dict(h), 512))
    assert used <= 1.01 * -(-sum(k * v for k, v in h.items()) // 512)


def test_rows(spark):
    r = random.Random(1)
    sizes = {i: r.choice([0, 1, 5, 7, 16, 17, 40, 333]) for i in range(300)}
    counts = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint")
    rows = pack_lengths(counts, PROFILES).collect()
    for profile, capacity in PROFILES:
        mine = [x for x in rows if x.profile == profile]
        fill, doc = defaultdict(int), defaultdict(list)
        for x in mine:
            doc[x.doc_id].append(x)
            if x.n_tokens:
                fill[x.container] += x.n_tokens
            else:
                assert x.container is None
        assert max(fill.values()) <= capacity and sorted(fill) == list(range(len(fill)))
        for i, n in sizes.items():
            p = sorted(doc[i], key=lambda x: x.piece)
            assert sum(x.n_tokens for x in p) == n and len(p) == max(1, -(-n // capacity))
            assert [x.first_token for x in p] == [k * capacity for k in range(len(p))] and all(x.n_tokens == capacity for x in p[:-1])


def test_one_length_for_all_and_empty(spark):
    counts = spark.range(2000).selectExpr("id AS doc_id", "5L AS n_tokens")
    rows = pack_lengths(counts, PROFILES[:1]).groupBy("container").sum("n_tokens").collect()
    assert len(rows) == 667 and max(r[1] for r in rows) == 15
    none = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert pack_lengths(none, PROFILES).count() == 0 and pack_lengths(counts, []).count() == 0


def test_texts(spark):
    docs = spark.createDataFrame([(1, "a b c", 1), (1, "a b c", 1), (2, None, 1), (3, "", 1), (4, "word " * 300, 1)], "doc_id bigint, text string, piece int")
    profiles = spark.createDataFrame([("p", "byte_bpe_50k", 128), ("none", "byte_bpe_50k", 0)], "profile string, tokenizer string, capacity int")
    rows = pack(docs, profiles).collect()
    assert Counter(r.doc_id for r in rows) == {1: 1, 2: 1, 3: 1, 4: 3} and {r.container for r in rows if r.doc_id in (2, 3)} == {None}

import random
from collections import Counter
from fractions import Fraction

import numpy as np

from folioscope.llm import neardup
from folioscope.llm.neardup import duplicate_classes, duplicate_pairs, words_of

S = "id string, quote string, why string, sid int, tokens string"
COLS = ["quote", "why"]


def similarity(a, b):
    x, y = Counter(a), Counter(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def corpus(n=260, seed=2):
    r = random.Random(seed)
    phrases = [" ".join(f"w{r.randrange(60)}" for _ in range(4)) for _ in range(25)]
    texts = []
    while len(texts) < n:
        words = " ".join(r.choice(phrases) for _ in range(r.randint(2, 9))).split()
        texts.append(words)
        for _ in range(r.choice([0, 0, 1, 2])):
            w = list(words)
            for _ in range(r.randint(0, 4)):
                k = r.randrange(len(w) + 1)
                w[k : k + r.randint(0, 1)] = [f"e{r.randrange(200)}"] * r.randint(0, 1)
            r.shuffle(w)
            texts.append(w)
    return [(f"F{i:04d}", " ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :]), 0, "x") for i, w in enumerate(texts[:n])]


def brute(rows, least):
    sets = {r[0]: words_of(r[1], r[2]) for r in rows}
    ids = [k for k in sorted(sets) if sets[k]]
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 1000 * similarity(sets[a], sets[b]) >= 1000 * least - 1e-9}


def test_same_as_brute_force(spark):
    rows = corpus()
    for least in (0.7, 0.8, 0.95):
        got = [(r.a, r.b) for r in duplicate_pairs(spark.createDataFrame(rows, S), "id", COLS, least).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, least)


def test_blocks_of_long_lists_meet(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = corpus(200, 4)
    assert {(r.a, r.b) for r in duplicate_pairs(spark.createDataFrame(rows, S), "id", COLS).collect()} == brute(rows, 0.7)


def test_edges(spark):
    rows = [("A", None, None, 0, ""), ("B", "", "...", 0, ""), ("C", "One two", None, 0, ""), ("D", None, "two ONE", 0, ""), ("D", None, "two ONE", 0, ""), ("E", "one one two", "", 0, ""), (None, "one two", "", 0, ""), ("G", "long " * 30_000, "x", 0, ""), ("H", "x", "long " * 30_000, 0, "")]
    got = {(r.a, r.b) for r in duplicate_pairs(spark.createDataFrame(rows, S), "id", COLS, 0.7).collect()}
    assert got == {("C", "D"), ("G", "H")}
    assert duplicate_pairs(spark.createDataFrame([], S), "id", COLS).count() == 0


def test_classes(spark):
    rows = corpus(150, 9) + [("Z1", "alone here now", "", 0, "")]
    got = {r.id: (r.class_id, r.links) for r in duplicate_classes(spark.createDataFrame(rows, S), "id", COLS).collect()}
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(rows, 0.7):
        parent[root(a)] = root(b)
    classes = {}
    for k in got:
        classes.setdefault(root(k), set()).add(got[k][0])
    assert all(len(v) == 1 for v in classes.values()) and len({v for s in classes.values() for v in s}) == len(classes) and got["Z1"][1] == 0


def test_answers_of_followers(spark):
    """Records that share one field and differ a little in the other get their answers from the least of them."""
    r = random.Random(11)
    rows = []
    for g in range(25):
        why = [f"w{r.randrange(90)}" for _ in range(r.randint(8, 14))]
        quote = [f"q{r.randrange(40)}" for _ in range(r.randint(3, 7))]
        for k in range(r.randint(1, 6)):
            q, w = list(quote), list(why)
            for _ in range(r.randint(0, 3)):
                q[r.randrange(len(q))] = f"e{r.randrange(50)}"
            if r.random() < 0.3:
                w[r.randrange(len(w))] = f"e{r.randrange(50)}"
            rows.append((f"F{len(rows):03d}", " ".join(q + ["x"] * r.randint(0, 2)), " ".join(w), 0, ""))
    df = spark.createDataFrame(rows, S)
    members = neardup._sets(df, "id", COLS).groupBy("sid").agg({"core": "min", "tokens": "first"}).toDF("sid", "core", "tokens")
    assert neardup.followers(members).count() > 10
    for least in (0.6, 0.7, 0.85):
        got = [(x.a, x.b) for x in duplicate_pairs(df, "id", COLS, least).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, least)


def meeting(sets, t, near, two):
    """The sets (sorted by size) as one group, or as two halves, as the entries of a task."""
    counts = Counter(w for s in sets for w in s)
    n = np.array([len(s) for s in sets])
    side = (np.arange(len(sets)) >= len(sets) // 2).astype(np.int8) if two else np.zeros(len(sets), np.int8)
    words, length, limit, bits = [], [], [], np.zeros((len(sets), 256), np.uint8)
    for k, s in enumerate(sets):
        for w in s:
            bits[k, w * 7919 % 256] ^= 1
        others = n[side != side[k]] if two else n
        _, need = neardup._partners(n[k : k + 1], int(others.min()), int(others.max()), t, near)
        alone = sum(counts[w] == 1 for w in s)
        limit.append(int(n[k] - need[0] - alone))
        words += sorted(s, key=lambda w: (counts[w], w))[alone:]
        length.append(len(s) - alone)
    rows = {"n": n, "side": side, "lim": np.array(limit), "len": np.array(length), "words": np.array(words, np.int32), "bits": np.packbits(bits, axis=1).view(np.uint64)}
    return neardup.Meeting(rows, t, near, two)


def test_long_lists_are_split(monkeypatch):
    """Sets made of few phrases: lists of one word hold many sets, so the pairs that are tested must be few beside those of the lists."""
    r = random.Random(5)
    phrases = [r.sample(range(400), 3) for _ in range(60)]
    sets = []
    while len(sets) < 900:
        s = {w for p in r.sample(phrases, r.randint(6, 12)) for w in p} | {1000 + r.randrange(300) for _ in range(2)}
        sets += [s] + [(s - set(r.sample(sorted(s), 2))) | {2000 + r.randrange(99)} for _ in range(r.choice([0, 0, 0, 1]))]
    sets = sorted(sets, key=len)
    tested = [0]

    def counted(self, doc, start, right, end):
        tested[0] += int(((right - start) * (end - right)).sum() if self.two else ((end - start) * (end - start - 1) // 2).sum())
        return together(self, doc, start, right, end)

    def tiled(self, a, b):
        tested[0] += len(a) * len(b) if self.two else len(a) * (len(a) - 1) // 2
        return tiles(self, a, b)

    together, tiles = neardup.Meeting.together, neardup.Meeting.tiles
    monkeypatch.setattr(neardup.Meeting, "together", counted)
    monkeypatch.setattr(neardup.Meeting, "tiles", tiled)
    for t, near, two in ((Fraction(7, 10), 0, False), (Fraction(7, 10), 0, True), (Fraction(8, 10), 2, False), (Fraction(3, 10), 0, False)):
        want = set()
        for j in range(len(sets)):
            for i in range(len(sets) // 2 if two and j >= len(sets) // 2 else 0 if two else j):
                a, b, both = len(sets[i]), len(sets[j]), len(sets[i] & sets[j])
                if (not two or j >= len(sets) // 2) and both >= neardup._least(a, b, t) - near and (b - near) * t <= a + near:
                    want.add((i, j))
        seen = []
        for many in (10**9, 200):
            for k, v in (("MANY", many), ("FEW", 10**8 if many > 10**8 else 50), ("TILE", 8), ("CHUNK", 1 << 10)):
                monkeypatch.setattr(neardup, k, v)
            tested[0] = 0
            got = set(zip(*meeting(sets, t, near, two).pairs().tolist()))
            assert want and want <= got
            seen.append(tested[0])
        if t == Fraction(7, 10):
            assert seen[1] < 0.7 * seen[0]


def test_groups_of_sizes(monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 10)
    sizes = {1: 3, 2: 4, 5: 95, 6: 2, 9: 1, 1 << 16: 7}
    low, high, first, parts = neardup._groups(sizes)
    held = Counter()
    for n, c in sizes.items():
        for k in range(c):
            g = first[n] + k % parts[n]
            assert low[g] <= n <= high[g]
            held[g] += 1
    assert max(held.values()) <= 20 and len(held) == len(low) and parts[5] == 10

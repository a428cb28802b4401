"""Filling containers of fixed capacity: pattern packing by non-negative least squares.

The lengths' histogram (at most one bin per token of capacity, whatever the data) is planned on the driver: length patterns that
fill a container are sought among all on a grid, as the prices of the lengths not yet covered ask for them, repeat counts fitted
to the histogram by non-negative least squares and rounded, and what is left goes best-fit-decreasing into the rest of the
patterns' containers and into new ones.
Spark then gives every document its place: documents of one length are numbered, and the numbers are cut into the slots that
the plan has for the length.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folioscope.llm.encode import TOKENIZERS, token_counts
from folioscope.session import written

#: Patterns are sought in this many units of capacity.
GRID = 256
#: A container that patterns leave emptier than this many units is closed by best-fit instead.
SLACK = 2
#: Lengths looked at on either side for two that fill a container exactly.
NEARBY = 64
#: The emptiest containers are dissolved until best-fit has this share of all documents to pack.
REST = 0.045
#: Rows of one length are numbered in parts of about so many.
PART_ROWS = 50_000
#: A table of places of at most so many rows is broadcast, a longer one joined by shuffle.
FEW_PLACES = 200_000
Group = tuple[tuple[int, ...], int]


def best_pattern(price: np.ndarray) -> np.ndarray:
    """Counts of each length in units, 0 to len(price) - 1, of the multiset that fills a container exactly at the highest price."""
    units = len(price) - 1
    value, choice = np.full(units + 1, -np.inf), np.zeros(units + 1, np.int64)
    value[0] = 0.0
    for s in range(1, units + 1):
        total = price[1 : s + 1] + value[s - 1 :: -1][:s]
        choice[s] = int(total.argmax()) + 1
        value[s] = total[choice[s] - 1]
    out, at = np.zeros(units + 1, np.int64), units
    while at > 0 and np.isfinite(value[at]):
        out[choice[at]] += 1
        at -= choice[at]
    return out


def stocked_pattern(price: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The same from what is left, filling a container up to SLACK units; all zero if nothing does."""
    units = len(price) - 1
    value = np.full(units + 1, -np.inf)
    value[0] = 0.0
    blocks, taken = [], []
    for u in range(1, units + 1):
        n, k = min(int(left[u]), units // u), 1
        while n > 0:  # counts in blocks of 1, 2, 4, ...
            k = min(k, n)
            new = value.copy()
            new[k * u :] = np.maximum(value[k * u :], value[: units + 1 - k * u] + k * price[u])
            blocks.append((u, k))
            taken.append(new > value)
            value, n, k = new, n - k, 2 * k
    out, at = np.zeros(units + 1, np.int64), units
    while at >= units - SLACK and not np.isfinite(value[at]):
        at -= 1
    if at < units - SLACK or at <= 0:
        return out
    for (u, k), used in zip(reversed(blocks), reversed(taken)):
        if used[at]:
            out[u] += k
            at -= k * u
    return out


def fit(target: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """Patterns with repeat counts x >= 0 that minimise |weight (A x - target)|, A the counts of each length in each pattern.

    Lawson and Hanson's active sets over all patterns: the one with the steepest gradient is the highest-priced one at prices
    weight^2 (target - A x), which best_pattern gives without listing them. Short lengths weigh less: what is left of them is
    easily placed.
    """
    units = len(target) - 1
    w2 = (0.3 + np.minimum(1.0, np.arange(units + 1) / (units / 4))) ** 2
    have = target > 0
    columns: list[np.ndarray] = []
    gram, rhs, x = np.zeros((0, 0)), np.zeros(0), np.zeros(0)
    for _ in range(3 * units):
        residual = target - (np.array(columns).T @ x if columns else 0.0)
        price = np.where(have, w2 * residual, -np.inf)
        price[0] = 0.0
        new = best_pattern(price).astype(float)
        if not new.any() or new[1:] @ np.where(have, w2 * residual, 0.0)[1:] <= 0.02 or any((new == c).all() for c in columns):
            break
        a = np.array([*columns, new])
        cross = (a * w2) @ new
        gram = np.block([[gram, cross[:-1, None]], [cross[None, :-1], cross[-1:, None]]])
        rhs, x = np.r_[rhs, (w2 * target) @ new], np.r_[x, 0.0]
        columns.append(new)
        while True:
            z = np.linalg.solve(gram + np.eye(len(x)) * 1e-9 * max(1.0, gram.max()), rhs)
            if (z > 0).all():
                x = z
                break
            low = z <= 0
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-12))
            x = x + step * (z - x)
            keep = ~(low & (x <= 1e-9))
            if keep.all():
                keep[np.flatnonzero(low)[np.argmin(x[low])]] = False
            columns, gram, rhs, x = [c for c, k in zip(columns, keep) if k], gram[np.ix_(keep, keep)], rhs[keep], x[keep]
            if not len(x):
                break
    return [(c.astype(np.int64), float(v)) for c, v in zip(columns, x)]


class Stock:
    """Documents by length, in classes of one unit each."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.count, self.lengths, self.capacity = dict(histogram), sorted(histogram), capacity
        self.width = max(1.0, capacity / GRID)
        self.units = round(capacity / self.width)
        self.left = np.zeros(self.units + 1, np.int64)
        self.top: dict[int, int] = {}
        for length in self.lengths:
            self.left[self.unit(length)] += histogram[length]
            self.top[self.unit(length)] = length

    def unit(self, length: int) -> int:
        return min(self.units, max(1, int(length / self.width + 0.5)))

    def take(self, most: int, n: int) -> tuple[int, int] | None:
        """Up to n documents of the longest length that is at most `most`."""
        at = bisect.bisect_right(self.lengths, most) - 1
        if at < 0:
            return None
        length = self.lengths[at]
        k = min(n, self.count[length])
        self.count[length] -= k
        self.left[self.unit(length)] -= k
        if not self.count[length]:
            del self.count[length]
            self.lengths.pop(at)
        return length, k

    def put(self, length: int, n: int) -> None:
        if length not in self.count:
            bisect.insort(self.lengths, length)
        self.count[length] = self.count.get(length, 0) + n
        self.left[self.unit(length)] += n

    def pair(self, room: int, near: int, n: int) -> tuple[int, int, int] | None:
        """(a, b, up to n): two lengths in stock that fill room exactly, a near a length."""
        at = bisect.bisect_left(self.lengths, near)
        for k in sorted(range(max(0, at - NEARBY), min(len(self.lengths), at + NEARBY)), key=lambda k: abs(self.lengths[k] - near)):
            a, b = self.lengths[k], room - self.lengths[k]
            have = self.count.get(b, 0)
            m = self.count[a] // 2 if a == b else min(self.count[a], have)
            if have and m:
                return a, b, min(n, m)
        return None

    def fill(self, pattern: np.ndarray, repeat: int) -> list[Group]:
        """`repeat` containers by a pattern; the last two documents of each are two that fill it exactly, else the last is the longest that fits, so that units cost no room."""
        units = [u for u in np.flatnonzero(pattern) for _ in range(pattern[u])]
        free = sorted(units, key=lambda u: (u >= 3, self.left[u]))[-2:]
        for u in free:
            units.remove(u)
        runs: list[list[tuple[int, int]]] = []
        for u in units:
            run, n = [], repeat
            while n:
                length, k = self.take(self.top[u], n)
                run.append((length, k))
                n -= k
            runs.append(run)
        out: list[Group] = []
        done = 0
        while done < repeat:
            n = min([repeat - done, *(r[0][1] for r in runs)])
            lengths = sorted((r[0][0] for r in runs), reverse=True)
            while sum(lengths) > self.capacity:  # rounded lengths may run over
                self.put(lengths.pop(), n)
            rest, room = n, self.capacity - sum(lengths)
            while rest:
                got = self.pair(room, round(free[0] * self.width), rest) if len(free) == 2 and room else None
                if got:
                    self.take(got[0], got[2])
                    self.take(got[1], got[2])
                    out.append((tuple(sorted((*lengths, got[0], got[1]), reverse=True)), got[2]))
                    rest -= got[2]
                    continue
                ends, k, left = [], rest, room
                for u in free:  # the first at about its planned length, the second as long as fits
                    one = self.take(left if u is free[-1] else min(left, self.top[u]), k)
                    if one:
                        if one[1] < k and ends:
                            self.put(ends[0], k - one[1])
                        ends.append(one[0])
                        k, left = one[1], left - one[0]
                if lengths or ends:
                    out.append((tuple(sorted((*lengths, *ends), reverse=True)), k))
                rest = rest - k if ends else 0
            for r in runs:
                r[0] = (r[0][0], r[0][1] - n)
                if not r[0][1]:
                    r.pop(0)
            done += n
        return out


def pattern_groups(histogram: dict[int, int], capacity: int) -> tuple[list[Group], dict[int, int]]:
    """Containers by fitted patterns, and the histogram of what is left.

    Repeat counts are rounded down and filled; patterns for the part that rounding leaves are sought one by one in the stock. The emptiest containers go back.
    """
    stock = Stock(histogram, capacity)
    groups: list[Group] = []
    for pattern, x in sorted(fit(stock.left.astype(float)), key=lambda p: -p[1]):
        used = np.flatnonzero(pattern)
        repeat = min([int(x), *(int(stock.left[u] // pattern[u]) for u in used)])
        if repeat > 0:
            groups += stock.fill(pattern, repeat)
    price = (np.arange(stock.units + 1) / stock.units) ** 1.5  # long documents first
    while True:
        pattern = stocked_pattern(price, stock.left)
        used = np.flatnonzero(pattern)
        if not len(used):
            break
        groups += stock.fill(pattern, max(1, int(min(stock.left[u] // pattern[u] for u in used)) // 2))
    again = max(0.0, REST * sum(histogram.values()) - sum(stock.count.values()))
    kept: list[Group] = []
    for lengths, n in sorted(groups, key=lambda g: sum(g[0])):  # the emptiest first
        k = min(n, int(again // len(lengths))) if sum(lengths) < capacity else 0
        again -= k * len(lengths)
        for length in lengths if k else ():
            stock.put(length, k)
        if n > k:
            kept.append((lengths, n - k))
    return kept, {k: n for k, n in stock.count.items() if n}


def plan(histogram: dict[int, int], capacity: int, fitted: bool = True) -> list[Group]:
    """Containers as (lengths, how many such containers) for a histogram of lengths from 1 to capacity."""
    groups, rest = pattern_groups(histogram, capacity) if fitted else ([], dict(histogram))
    open_: dict[int, list[Group]] = {}
    done: list[Group] = []
    for lengths, n in groups:
        space = capacity - sum(lengths)
        (open_.setdefault(space, []) if space else done).append((lengths, n))
    spaces = sorted(open_)

    def put(lengths: tuple[int, ...], n: int) -> None:
        space = capacity - sum(lengths)
        if not space:
            done.append((lengths, n))
            return
        if space not in open_:
            bisect.insort(spaces, space)
            open_[space] = []
        open_[space].append((lengths, n))

    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):
                each = capacity // length  # no room left: new containers, as full of this length as they get
                if n >= each:
                    put((length,) * each, n // each)
                    n %= each
                else:
                    put((length,) * n, 1)
                    n = 0
                continue
            space = spaces[at]
            lengths, have = open_[space].pop()
            if not open_[space]:
                del open_[space]
                spaces.pop(at)
            each = min(space // length, n)
            k = min(have, n // each)
            put(lengths + (length,) * each, k)
            n -= k * each
            if have > k:
                put(lengths, have - k)
    return done + [g for s in sorted(open_) for g in open_[s]]


def _places(profile: str, groups: Iterable[Group]) -> tuple[list[tuple], list[tuple]]:
    """((profile, length, block, first number, numbers, first container, containers) of every length in every group, (profile, length, rows, width)).

    The numbers of a length fall into blocks of `width`, as many as it has places, so that a document meets about two places.
    """
    by: dict[int, list[tuple[int, int, int, int]]] = {}
    start, taken = 0, {}
    for lengths, n in groups:
        for length in dict.fromkeys(lengths):
            slots = lengths.count(length) * n
            first = taken.get(length, 0)
            by.setdefault(length, []).append((first, slots, start, n))
            taken[length] = first + slots
        start += n
    out, widths = [], []
    for length, places in by.items():
        width = -(-taken[length] // len(places))
        widths.append((profile, length, taken[length], width))
        for first, slots, at, n in places:
            out.extend((profile, length, block, first, slots, at, n) for block in range(first // width, (first + slots - 1) // width + 1))
    return out, widths


def pieces(counts: DataFrame, profiles: list[tuple[str, int]]) -> DataFrame:
    """(profile, doc_id, piece, first_token, n_tokens): whole documents, and those longer than a container in full pieces and a rest."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(c).alias("capacity")) for p, c in profiles]))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / F.col("capacity")) - 1).cast("int")), lambda k: F.struct((k + 1).alias("piece"), (k * F.col("capacity")).cast("bigint").alias("first_token"), F.least(F.col("capacity").cast("bigint"), F.col("n") - k * F.col("capacity")).alias("n_tokens")))
    return counts.select("doc_id", F.col("n_tokens").alias("n"), each.alias("p")).select("doc_id", "n", "p.*").select("profile", "doc_id", F.explode(cut).alias("c")).select("profile", "doc_id", "c.piece", "c.first_token", "c.n_tokens")


def pack_lengths(counts: DataFrame, profiles: list[tuple[str, int]]) -> DataFrame:
    """(profile, container, doc_id, piece, first_token, n_tokens) from (doc_id, n_tokens).

    Containers are numbered from 0 in each profile. A document without tokens takes no room: its container is null. Documents
    of equal length are numbered by doc_id, in parts, so that one length may hold any share of the rows.
    """
    spark = counts.sparkSession
    profiles = [(p, int(c)) for p, c in profiles if c and c > 0]
    if not profiles:
        return spark.createDataFrame([], "profile string, container bigint, doc_id bigint, piece int, first_token bigint, n_tokens bigint")
    items = pieces(counts, profiles)
    full = items.where("n_tokens > 0")
    table: dict[str, dict[int, int]] = {p: {} for p, _ in profiles}
    for r in full.groupBy("profile", "n_tokens").count().collect():  # at most `capacity` rows a profile
        table[r["profile"]][r["n_tokens"]] = r["count"]
    places, widths = [], []
    for p, c in profiles:
        some, wide = _places(p, plan(table[p], c))
        places, widths = places + some, widths + wide
    slots = spark.createDataFrame(places, "profile string, n_tokens bigint, block bigint, first bigint, slots bigint, start bigint, containers bigint")
    slots = F.broadcast(slots) if len(places) <= FEW_PLACES else slots
    wide = F.broadcast(spark.createDataFrame(widths, "profile string, n_tokens bigint, rows bigint, width bigint"))  # at most `capacity` rows a profile
    parts = (F.floor(F.col("rows") / PART_ROWS) + 1).cast("bigint")
    part = full.join(wide, ["profile", "n_tokens"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), parts))
    sizes = part.groupBy("profile", "n_tokens", "part").count()
    before = W.partitionBy("profile", "n_tokens").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("profile", "n_tokens", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy("profile", "n_tokens", "part").orderBy("doc_id", "piece")
    numbered = part.withColumn("k", F.row_number().over(inside)).join(sizes, ["profile", "n_tokens", "part"]).withColumn("number", F.col("before") + F.col("k") - 1)
    numbered = numbered.withColumn("block", F.floor(F.col("number") / F.col("width")))
    placed = numbered.join(slots, ["profile", "n_tokens", "block"]).where((F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("slots")))
    placed = placed.select("profile", (F.col("start") + F.pmod(F.col("number") - F.col("first"), F.col("containers"))).alias("container"), "doc_id", "piece", "first_token", "n_tokens")
    return placed.unionByName(items.where("n_tokens <= 0").select("profile", F.lit(None).cast("bigint").alias("container"), "doc_id", "piece", "first_token", F.lit(0).cast("bigint").alias("n_tokens")))


def pack(documents: DataFrame, profiles: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """pack_lengths for documents (doc_id, text) and a small table of profiles (profile, tokenizer, capacity); repeated doc_ids count once."""
    by: dict[str, list[tuple[str, int]]] = {}
    for r in profiles.select("profile", "tokenizer", "capacity").distinct().collect():
        by.setdefault(r["tokenizer"], []).append((r["profile"], r["capacity"]))
    out = None
    for tokenizer, rows in sorted(by.items()):
        counts = written(token_counts(documents, tokenizer=tokenizer, folder=folder).dropDuplicates(["doc_id"]), "tokens")
        packed = pack_lengths(counts, sorted(rows))
        out = packed if out is None else out.unionByName(packed)
    return out

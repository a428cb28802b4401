"""Near-duplicate records: exact set-similarity join of word multisets with set-relation skipping.

A record's set holds each word with its number of occurrence, so set similarity is multiset similarity. Sets are ordered from
rare to frequent words; the first words that two similar sets share stand within a prefix of both that follows from their sizes.
Sets are grouped by size, and each two groups whose sizes allow the similarity meet in one task. There, sets are listed by
each word of their prefix; a long list is split by the next shared word, and again by the one after, as the words of one phrase and
the frequent words make single words tell little apart. Short lists are compared by parities of 64 bits, tile by tile, what is left by 256,
and only the few that pass are verified on their words. Equal sets have one representative in each task.

A set that shares its longest field with another one (the leader) and differs from it in up to NEAR words either way is a follower.
Where many sets are followers, they are not looked up: the leader is, with an overlap lower by NEAR, and the follower's answers
are derived from the leader's, adding and subtracting what the few differing words have in common with each answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import written

#: Word counts are kept in so many cells, whatever the data: enough to order words and to bound the length of index lists.
CELLS = 1 << 17
#: Groups of sets of like size hold about so many; smaller tables have about GROUPS of them, but none of fewer than LEAST sets.
BLOCK, GROUPS, LEAST = 1 << 18, 8, 1 << 12
#: Words that a follower may have beyond its leader, and the leader beyond it; followers are derived where this share of all sets are some.
NEAR, SHARE = 2, 0.1
#: Entries or pairs held at once; probing sets of one tile; pairs up to which lists are tested together, and from which they are split.
CHUNK, TILE, FEW, MANY = 1 << 18, 128, 1 << 12, 1 << 22
#: Shared words that make a list at most.
DEPTH = 5
#: Sets that are looked at for words that go together (this decides the order of words, never a result).
SAMPLE = 4000
WORD = re.compile(r"[^\W_]+")
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32))


def words_of(*texts: str | None) -> list[str]:
    return WORD.findall(" ".join(t for t in texts if t).lower())


class Hashes(dict):
    """Signed 64-bit hashes of words, or of (word, number of occurrence)."""

    def __missing__(self, word: str | tuple[str, int]) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        text = word if isinstance(word, str) else f"{word[0]}\x00{word[1]}"
        h = self[word] = xxhash.xxh64_intdigest(text) - 2**63
        return h


HASHES, REPEATS = Hashes(), Hashes()


def _sets(records: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, sid, core, n, tokens): the set of every record that has a word; sid is the set's own hash, core one of its longest field's words, n its size."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields = [[WORD.findall(t.lower()) if t else [] for t in b.column(k + 1).to_pylist()] for k in range(len(columns))]
            sizes = np.array([[len(w) for w in f] for f in fields], np.int64).reshape(len(fields), b.num_rows)
            words = list(chain.from_iterable(chain.from_iterable(zip(*fields))))
            n = sizes.sum(0)
            own = np.repeat(np.arange(len(n)), n)
            plain = np.fromiter(map(HASHES.__getitem__, words), np.int64, len(words))
            order = np.lexsort((plain, own))
            tokens = plain[order]
            first = np.r_[True, (tokens[1:] != tokens[:-1]) | (own[1:] != own[:-1])] if len(tokens) else np.zeros(0, bool)
            nth = np.arange(len(tokens)) - np.maximum.accumulate(np.where(first, np.arange(len(tokens)), 0))
            again = np.flatnonzero(nth)
            tokens[again] = [REPEATS[words[w], k] for w, k in zip(order[again].tolist(), (nth[again] + 1).tolist())]
            tokens = tokens[np.lexsort((tokens, own))]
            longest = np.repeat((np.arange(len(fields)) == sizes.argmax(0)[:, None]).ravel(), sizes.T.ravel())
            sums = np.r_[np.uint64(0), np.cumsum(_mixed(plain) * longest.astype(np.uint64), dtype=np.uint64)]
            ends = np.r_[0, np.cumsum(n)]
            core = (sums[ends[1:]] - sums[ends[:-1]]).view(np.int64)
            raw = tokens.tobytes()
            keep = np.flatnonzero(n)
            sid = np.array([xxhash.xxh64_intdigest(raw[8 * x : 8 * z]) - 2**63 for x, z in zip(ends[keep].tolist(), ends[keep + 1].tolist())], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[ends[keep], ends[-1]].astype(np.int32)), pa.array(tokens))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array(sid), pa.array(core[keep]), pa.array(n[keep].astype(np.int32)), lists], [key, "sid", "core", "n", "tokens"])

    return records.where(F.col(key).isNotNull()).select(key, *columns).mapInArrow(read, f"{key} {dict(records.dtypes)[key]}, sid bigint, core bigint, n int, tokens array<bigint>")


def _mixed(x: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
    """Well mixed 64 bits of x and salt."""
    with np.errstate(over="ignore"):
        x = (x.view(np.uint64) + np.asarray(salt).astype(np.uint64)) * MIX[0]
        x ^= x >> MIX[2]
        x *= MIX[1]
    return x ^ (x >> MIX[2])


def _least(a, b, t: Fraction):
    """Least overlap of sets of sizes a and b that makes their similarity t."""
    n, d = t.numerator, t.numerator + t.denominator
    return -((-(a + b) * n) // d)


def _groups(sizes: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(least size, largest size) of every group and (first group, number of groups) of every size, from counts by size; a size of too many sets is split."""
    target = min(BLOCK, max(LEAST, -(-sum(sizes.values()) // GROUPS)))
    low, high, held = [], [], 2 * target
    first, parts = np.zeros(max(sizes, default=0) + 1, np.int64), np.ones(max(sizes, default=0) + 1, np.int64)
    for n in sorted(sizes):
        if sizes[n] > 2 * target:
            first[n], parts[n], held = len(low), -(-sizes[n] // target), 2 * target
            low, high = low + [n] * int(parts[n]), high + [n] * int(parts[n])
            continue
        if held + sizes[n] > 1.25 * target:
            low, high, held = [*low, n], [*high, n], 0
        first[n], high[-1], held = len(low) - 1, n, held + sizes[n]
    return np.array(low, np.int64), np.array(high, np.int64), first, parts


def _partners(n: np.ndarray, low: int, high: int, t: Fraction, near: int) -> tuple[np.ndarray, np.ndarray]:
    """For sets of sizes n and others of sizes low to high: is there a size that allows the similarity, and the least overlap for any of these."""
    least = np.maximum(low, -(-n * t.numerator // t.denominator) - near)
    return least <= np.minimum(high, (n + near) * t.denominator // t.numerator), np.maximum(1, _least(n, least, t) - near)


class Meeting:
    """The sets of one or two groups and the pairs among them, or across, that pass size, prefix and parity tests."""

    def __init__(self, rows: dict, t: Fraction, near: int, two: bool):
        self.t, self.near, self.two = t, near, two
        self.n, self.side, self.limit = rows["n"].astype(np.int64), rows["side"], rows["lim"].astype(np.int64)
        self.bits, self.words, self.ends = rows["bits"], rows["words"], np.r_[0, np.cumsum(rows["len"])].astype(np.int64)
        self.fold = np.bitwise_xor.reduce(self.bits, axis=1)
        self.half = [self.bits[:, 0] ^ self.bits[:, 1], self.bits[:, 2] ^ self.bits[:, 3]]
        sums = np.arange(2 * int(self.n.max()) + 1)
        self.room = np.maximum.accumulate(sums - 2 * _least(sums, 0, t)) + 2 * near  # words that two sets of this size in all may differ in
        low = [int(self.n[self.side == k].min()) for k in ((0, 1) if two else (0, 0))]
        self.depth = min(DEPTH, max(1, int(_least(low[0], low[1], t)) - near))
        self.codes: list[np.ndarray] = []

    def pairs(self) -> np.ndarray:
        m = np.maximum(0, np.minimum(self.limit + 1, np.diff(self.ends)))
        parts = max(1, -(-int(m.sum()) // (4 * CHUNK)))
        for part in range(parts):
            doc = np.repeat(np.arange(len(m)), m)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(m) - m, m)
            word = self.words[self.ends[doc] + at]
            if parts > 1:
                here = np.flatnonzero(word % parts == part)
                doc, at, word = doc[here], at[here], word[here]
            self.lists(doc.astype(np.int32), at.astype(np.int32), _mixed(word.astype(np.int64)), 1)
        codes = np.unique(np.concatenate(self.codes)) if self.codes else np.zeros(0, np.int64)
        return np.stack(np.divmod(codes, len(self.n)))

    def lists(self, doc: np.ndarray, at: np.ndarray, key: np.ndarray, level: int) -> None:
        """Test the pairs of every list of equal key, or split it by its sets' next words."""
        key = (key & ~np.uint64(1)) | self.side[doc].astype(np.uint64)
        order = np.argsort(key)
        key, doc, at = key[order], doc[order], at[order]
        whole = key >> np.uint64(1)
        start = np.flatnonzero(np.r_[True, whole[1:] != whole[:-1]])
        end = np.r_[start[1:], len(key)]
        ones = np.r_[0, np.cumsum(key & np.uint64(1))].astype(np.int64)
        right = end - (ones[end] - ones[start])  # the other group's first
        work = (right - start) * (end - right) if self.two else (end - start) * (end - start - 1) // 2
        few = (work > 0) & (work <= FEW)
        self.together(doc, start[few], right[few], end[few])
        many = work > (MANY if level < self.depth else np.iinfo(np.int64).max)
        for k in np.flatnonzero((work > FEW) & ~many):
            self.tiles(doc[start[k] : right[k]], doc[right[k] : end[k]] if self.two else None)
        if not many.any():
            return
        long = np.flatnonzero(many)
        count = np.zeros(len(key) + 1, np.int64)
        count[1:] = np.maximum(np.minimum(self.limit[doc] + level, np.diff(self.ends)[doc] - 1) - at, 0)
        count = np.cumsum(count)
        ahead = np.cumsum(count[end[long]] - count[start[long]])
        x = 0
        while x < len(long):
            z = max(x + 1, int(np.searchsorted(ahead, (ahead[x - 1] if x else 0) + 2 * CHUNK, "right")))
            e = np.concatenate([np.arange(start[k], end[k]) for k in long[x:z]])
            m = count[e + 1] - count[e]
            own = np.repeat(e, m)
            after = at[own] + 1 + (np.arange(len(own)) - np.repeat(np.cumsum(m) - m, m)).astype(np.int32)
            if len(own):
                self.lists(doc[own], after, _mixed(whole[own], self.words[self.ends[doc[own]] + after].astype(np.int64)), level + 1)
            x = z

    def together(self, doc: np.ndarray, start: np.ndarray, right: np.ndarray, end: np.ndarray) -> None:
        """Pairs of short lists, all in one."""
        i = np.concatenate([np.zeros(0, np.int64), np.repeat(start, right - start) + _counted(right - start)])
        stop = np.repeat(end, right - start)
        first = np.repeat(right, right - start) if self.two else i + 1
        m = stop - first
        ends = np.cumsum(m)
        x = 0
        while x < len(i):
            z = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + CHUNK, "right")))
            a = doc[np.repeat(i[x:z], m[x:z])]
            b = doc[np.repeat(first[x:z], m[x:z]) + _counted(m[x:z])]
            keep = np.flatnonzero(np.bitwise_count(self.fold[a] ^ self.fold[b]) <= self.room[self.n[a] + self.n[b]])
            self.passed(a[keep], b[keep])
            x = z

    def tiles(self, a: np.ndarray, b: np.ndarray | None) -> None:
        """Pairs of a long list, or of its two groups' parts, tile by tile within sizes that allow the similarity."""
        a = a[np.argsort(self.n[a])]
        b = a if b is None else b[np.argsort(self.n[b])]
        na, nb = self.n[a], self.n[b]
        for x in range(0, len(a), TILE):
            z = min(x + TILE, len(a))
            least = -(-na[x] * self.t.numerator // self.t.denominator) - self.near
            lo = int(np.searchsorted(nb, least, "left")) if self.two else x
            hi = int(np.searchsorted(nb, (na[z - 1] + self.near) * self.t.denominator // self.t.numerator, "right"))
            if lo >= hi:
                continue
            room = self.room[na[z - 1] + nb[lo:hi]]
            if int(room[-1]) <= 18:
                diff = np.bitwise_count(self.fold[a[x:z], None] ^ self.fold[b[lo:hi]])
            else:
                diff = np.bitwise_count(self.half[0][a[x:z], None] ^ self.half[0][b[lo:hi]])
                diff += np.bitwise_count(self.half[1][a[x:z], None] ^ self.half[1][b[lo:hi]])
            hit = np.flatnonzero(diff <= np.minimum(255, room).astype(np.uint8))
            i = hit // (hi - lo)
            j = hit - i * (hi - lo) + lo
            i += x
            if not self.two:
                i, j = i[i < j], j[i < j]
            self.passed(a[i], b[j])

    def passed(self, i: np.ndarray, j: np.ndarray) -> None:
        """Keep those pairs that pass all parities."""
        i, j = i.astype(np.int64), j.astype(np.int64)
        diff = np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(1, dtype=np.int64)
        keep = diff <= self.room[self.n[i] + self.n[j]]
        if keep.any():
            self.codes.append(np.unique(np.minimum(i, j)[keep] * len(self.n) + np.maximum(i, j)[keep]))


def _counted(m: np.ndarray) -> np.ndarray:
    """0 to m - 1 for every m, one after the other."""
    return np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)


def _asked(rows: dict, i: np.ndarray, j: np.ndarray, t: Fraction) -> np.ndarray:
    """Which sets i are to ask for the sets j: the smaller asks, and a leader for its followers also somewhat smaller ones."""
    a, b, near = rows["n"][i].astype(np.int64), rows["n"][j].astype(np.int64), rows["near"][i].astype(np.int64)
    ok = (a < b) | (a == b) & (rows["sid"][i] < rows["sid"][j]) | (near > 0) & (a - near <= b)
    return rows["probes"][i] & ok & (b * t.numerator <= (a + near) * t.denominator)


def followers(sets: DataFrame) -> DataFrame:
    """(sid, leader, plus, minus): sets that differ from the least set of their core in up to NEAR words either way, and these words."""
    leaders = sets.groupBy("core").agg(F.min("sid").alias("leader"), F.count("*").alias("n")).where("n > 1").select("core", "leader")
    f = sets.join(leaders, "core").where("sid <> leader").select("sid", "leader", "tokens")
    f = f.join(sets.select(F.col("sid").alias("leader"), F.col("tokens").alias("theirs")), "leader")
    f = f.select("sid", "leader", F.array_except("tokens", "theirs").alias("plus"), F.array_except("theirs", "tokens").alias("minus"))
    return f.where((F.size("plus") <= NEAR) & (F.size("minus") <= NEAR))


def _together(cells: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
    """Cells of frequent words that mostly come with a rarer frequent word: second words of phrases."""
    if not cells:
        return np.zeros(0, np.int64)
    flat, own = np.concatenate(cells), np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    often, seen = np.unique(flat, return_counts=True)
    often = often[(seen * 250 > len(cells)) & (counts[often] > 1)]
    often = often[np.argsort(counts[often], kind="stable")][:2048]
    column = np.full(CELLS, -1)
    column[often] = np.arange(len(often))
    has = np.zeros((len(cells), len(often)), np.float32)
    ok = column[flat] >= 0
    has[own[ok], column[flat[ok]]] = 1
    both = has.T @ has
    alone = np.maximum(both.diagonal(), 1)
    with_rarer = both > 0.5 * np.minimum(alone[:, None], alone[None])
    kept = np.zeros(len(often), bool)
    for k in range(len(often)):
        kept[k] = not (with_rarer[k] & kept).any()
    return often[~kept]


def _order(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(counts, ranks) of cells of words: rare words come first, words that go with a rarer one last."""
    mask = CELLS - 1
    counts = np.zeros(CELLS, np.int64)
    found = sets.select(F.explode("tokens").alias("token")).groupBy(F.col("token").bitwiseAND(mask).alias("cell")).count().toArrow()  # at most CELLS rows
    counts[found["cell"].to_numpy()] = found["count"].to_numpy()
    sample = sets.select("tokens").limit(SAMPLE).toArrow()["tokens"].to_pylist()
    last = np.zeros(CELLS, bool)
    last[_together([np.unique(np.array(x, np.int64) & mask) for x in sample], counts)] = True
    ranks = np.empty(CELLS, np.int64)
    ranks[np.lexsort((counts, last))] = np.arange(CELLS)
    return counts, ranks


def _labels(spark, blocks: int) -> np.ndarray:
    """One number a block such that a shuffle by it into so many partitions puts each into its own."""
    if not blocks:
        return np.zeros(0, np.int64)
    rows = spark.range(blocks * 32).select("id", F.pmod(F.hash("id"), F.lit(blocks)).alias("part")).groupBy("part").agg(F.min("id").alias("id")).collect()
    taken = {r["part"]: r["id"] for r in rows}
    return np.array([taken.get(k, blocks * 32 + k) for k in range(blocks)], np.int64)


def _candidates(sets: DataFrame, t: Fraction, near: int) -> DataFrame:
    """(probe, listed): pairs of sets (sid, n, tokens, near, follows) that may be similar, within the near of the probing one."""
    spark = sets.sparkSession
    largest = 1 << 16
    sizes = {r["n"]: r["count"] for r in sets.groupBy(F.least("n", F.lit(largest)).alias("n")).count().collect()}  # at most that many rows
    low, high, first, parts = _groups(sizes)
    high = np.where(high == largest, 2**31, high)
    counts, ranks = _order(sets)
    met = [(g, h) for g in range(len(low)) for h in range(g, len(low)) if (high[g] + near) * t.denominator >= low[h] * t.numerator]
    label = np.full((len(low), len(low)), -1, np.int64)
    for (g, h), k in zip(met, _labels(spark, len(met))):
        label[g, h] = label[h, g] = k
    shared = spark.sparkContext.broadcast((counts, ranks))
    columns = {"block": pa.int64(), "side": pa.int8(), "probes": pa.bool_(), "lim": pa.int32(), "n": pa.int32(), "near": pa.int8(), "sid": pa.int64(), "bits": pa.binary(), "words": pa.binary()}

    def packed(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * flat.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, ranks = shared.value
        for whole in batches:
            for b in (whole.slice(x, 8192) for x in range(0, whole.num_rows, 8192)):
                sid, n, lists = b["sid"].to_numpy(), b["n"].to_numpy().astype(np.int64), b["tokens"]
                tokens, own = lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
                starts = np.cumsum(n) - n
                bits = (np.bincount(own << 8 | tokens >> 20 & 255, minlength=len(n) << 8) & 1).astype(np.uint8)
                bits = np.packbits(bits.reshape(len(n), 256), axis=1)
                cell = tokens & (CELLS - 1)
                order = np.argsort(own << 49 | ranks[cell] << 32 | tokens >> 32 & 0xFFFFFFFF)
                word = (tokens[order] >> 32).astype(np.int32)
                alone = np.add.reduceat(counts[cell[order]] == 1, starts, dtype=np.int64)  # they come first and no other set has them
                size = np.minimum(n, largest)
                mine = first[size] + sid % parts[size]
                for u in range(len(low)):
                    ok, need = _partners(n, int(low[u]), int(high[u]), t, near)
                    lim = n - need - alone
                    block = label[mine, u]
                    at = np.flatnonzero(ok & (lim >= 0) & (block >= 0))
                    if not len(at):
                        continue
                    length = np.minimum(lim[at] + DEPTH, n[at] - alone[at])
                    flat = word[np.repeat(starts[at] + alone[at], length) + _counted(length)]
                    out = {
                        "block": block[at],
                        "side": np.where(mine[at] > u, 1, 0).astype(np.int8),
                        "probes": ~b["follows"].to_numpy(zero_copy_only=False)[at],
                        "lim": lim[at].astype(np.int32),
                        "n": n[at].astype(np.int32),
                        "near": b["near"].to_numpy()[at].astype(np.int8),
                        "sid": sid[at],
                    }
                    arrays = [pa.array(out[c], columns[c]) for c in out]
                    arrays += [packed(bits[at].ravel(), np.arange(len(at) + 1) * 32), packed(flat, np.r_[0, np.cumsum(length)])]
                    yield pa.RecordBatch.from_arrays(arrays, list(columns))

    index = sets.mapInArrow(entries, "block bigint, side tinyint, probes boolean, lim int, n int, near tinyint, sid bigint, bits binary, words binary")
    index = index.repartition(max(1, len(met)), "block")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in (*columns, "len")}
        for b in batches:
            for c in columns:
                if c == "bits":
                    held[c].append(np.frombuffer(b"".join(b[c].to_pylist()), np.uint64).reshape(-1, 4))
                elif c == "words":
                    texts = b[c].to_pylist()
                    held[c].append(np.frombuffer(b"".join(texts), np.int32))
                    held["len"].append(np.fromiter(map(len, texts), np.int64, len(texts)) // 4)
                else:
                    held[c].append(b[c].to_numpy(zero_copy_only=False))
        if not held["block"]:
            return
        rows = {c: np.concatenate(held.pop(c)) for c in list(held)}
        words, ends = rows.pop("words"), np.r_[0, np.cumsum(rows["len"])]
        for block in np.unique(rows["block"]):
            here = np.flatnonzero(rows["block"] == block)
            here = here[np.unique(rows["sid"][here], return_index=True)[1]]
            r = {c: v[here] for c, v in rows.items()}
            r["words"] = words[np.repeat(ends[here], r["len"]) + _counted(r["len"])]
            two = int(block) not in alike
            if two and len(np.unique(r["side"])) < 2:
                continue
            i, j = Meeting(r, t, near, two).pairs()
            for a, z in ((i, j), (j, i)):
                ok = _asked(r, a, z, t)
                a, z = r["sid"][a[ok]], r["sid"][z[ok]]
                for x in range(0, len(a), 8192):
                    yield pa.RecordBatch.from_arrays([pa.array(a[x : x + 8192]), pa.array(z[x : x + 8192])], ["probe", "listed"])

    alike = set(label.diagonal().tolist())
    return index.mapInArrow(meet, "probe bigint, listed bigint")


def similar_sets(sets: DataFrame, least: float) -> DataFrame:
    """(sid_a, sid_b, similarity) of all pairs of different sets (sid, core, n, tokens) with at least this similarity, sid_a before sid_b; a sid may come many times."""
    t = Fraction(str(least)).limit_denominator(1000)
    cores = sets.select("sid", "core").distinct().groupBy("core").count().agg(F.sum("count").alias("all"), F.sum(F.col("count") - 1).alias("more")).first()
    follow = None
    if cores["more"] and cores["more"] >= SHARE * cores["all"]:
        sets = written(sets.groupBy("sid").agg(F.first("tokens").alias("tokens"), F.min("core").alias("core"), F.first("n").alias("n")), "representatives")
        follow = written(followers(sets), "followers")
        if follow.count() < SHARE * cores["all"]:
            follow = None
    if follow is None:
        roles = sets.select("sid", "n", "tokens", F.lit(0).alias("near"), F.lit(False).alias("follows"))
    else:
        led = follow.select(F.col("leader").alias("sid")).distinct().withColumn("near", F.lit(NEAR))
        roles = sets.join(led, "sid", "left").join(follow.select("sid", F.lit(True).alias("follows")), "sid", "left")
        roles = roles.select("sid", "n", "tokens", F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("follows", F.lit(False)).alias("follows"))
    found = written(_candidates(roles, t, NEAR if follow is not None else 0), "candidates")
    wanted = found.select(F.explode(F.array("probe", "listed")).alias("sid")).distinct()
    sets = written(sets.select("sid", "tokens").join(wanted.hint("merge"), "sid", "leftsemi").groupBy("sid").agg(F.first("tokens").alias("tokens")), "compared")
    a, b = sets.select(F.col("sid").alias("probe"), F.col("tokens").alias("ta")), sets.select(F.col("sid").alias("listed"), F.col("tokens").alias("tb"))
    answers = found.join(a, "probe").join(b, "listed").select("probe", "listed", "tb", F.size("ta").alias("na"), F.size("tb").alias("nb"), F.size(F.array_intersect("ta", "tb")).alias("both"))
    pairs = answers.select(F.col("probe").alias("sid"), "listed", "na", "nb", "both")
    if follow is not None:
        derived = answers.join(follow.withColumnRenamed("leader", "probe"), "probe").where("sid <> listed")
        gain, loss = F.size(F.array_intersect("plus", "tb")), F.size(F.array_intersect("minus", "tb"))
        derived = derived.select("sid", "listed", (F.col("na") + F.size("plus") - F.size("minus")).alias("na"), "nb", (F.col("both") + gain - loss).alias("both"))
        pairs = pairs.unionByName(derived)
    union = F.col("na") + F.col("nb") - F.col("both")
    pairs = pairs.withColumn("union", union).where(F.col("both") * t.denominator >= F.col("union") * t.numerator)
    return pairs.groupBy(F.least("sid", "listed").alias("sid_a"), F.greatest("sid", "listed").alias("sid_b")).agg(F.first(F.col("both") / F.col("union")).alias("similarity"))


def near_duplicates(records: DataFrame, key: str, columns: list[str], least: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """((key, sid), (sid_a, sid_b, similarity)): every record's set, and the links between different sets.

    Records of one sid have equal words. Nulls count as empty texts, records without a word have no set and so no row, keys that
    repeat count once and null keys not at all; other columns are ignored.
    """
    spark = records.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    once = records.where(F.col(key).isNotNull()).select(key, *columns).repartition(parts, key).dropDuplicates([key])
    sets = written(_sets(once, key, columns), "sets")
    return sets.select(key, "sid"), similar_sets(sets, least)


def duplicate_pairs(records: DataFrame, key: str, columns: list[str], least: float = 0.7) -> DataFrame:
    """(a, b): every pair of keys whose similarity reaches `least`, the smaller first; answers of equal sets come from their representative."""
    members, links = near_duplicates(records, key, columns, least)
    a, b = members.select(F.col(key).alias("x"), F.col("sid").alias("sid_a")), members.select(F.col(key).alias("y"), F.col("sid").alias("sid_b"))
    across = links.join(a, "sid_a").join(b, "sid_b").select("x", "y")
    # equal sets: a class of many copies is split over parts of its right side
    many = members.groupBy("sid").agg((F.floor(F.count("*") / 512) + 1).alias("parts"), F.count("*").alias("n")).where("n > 1").select(F.col("sid").alias("sid_a"), "parts")
    left = a.join(many, "sid_a").select("sid_a", "x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    right = b.withColumnRenamed("sid_b", "sid_a").join(many, "sid_a").select("sid_a", "y", F.pmod(F.xxhash64("y"), "parts").alias("part"))
    same = left.join(right, ["sid_a", "part"]).where("x < y").select("x", "y")
    return across.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def duplicate_classes(records: DataFrame, key: str, columns: list[str], least: float = 0.7) -> DataFrame:
    """(key, class_id, links): the connected class of every record with words (its least sid) and the number of other sets its set is linked with."""
    members, links = near_duplicates(records, key, columns, least)
    links = written(links, "links")
    both = links.select("sid_a", "sid_b").unionByName(links.select(F.col("sid_b").alias("sid_a"), F.col("sid_a").alias("sid_b")))
    degree = both.groupBy(F.col("sid_a").alias("sid")).agg(F.count("*").alias("links"))
    label = written(degree.select("sid", F.col("sid").alias("label")), "labels")
    while True:  # the least label spreads along links and is then followed to its own label
        least_near = both.join(label.withColumnRenamed("sid", "sid_b"), "sid_b").groupBy(F.col("sid_a").alias("sid")).agg(F.min("label").alias("near"))
        step = label.join(least_near, "sid").select("sid", "label", F.least("label", "near").alias("new"))
        step = written(step, "steps")
        jump = step.select(F.col("sid").alias("new"), F.col("new").alias("far"))
        step = written(step.join(jump, "new", "left").select("sid", "label", F.least("new", F.coalesce("far", "new")).alias("new")), "steps")
        label = step.select("sid", F.col("new").alias("label"))
        if step.where("new <> label").isEmpty():
            break
    return members.join(label, "sid", "left").join(degree, "sid", "left").select(key, F.coalesce("label", "sid").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))

"""Best similar title inside one tile of titles and works: bounds that lose no pair first, sequence matching for the few pairs that are left."""

from __future__ import annotations

import difflib
from functools import lru_cache

import numpy as np

#: Bits of a title that stand for counts of characters and of pairs of characters; buckets that pairs are hashed to; counts told apart.
BITS = {1: 255, 2: 512}
BUCKETS = {1: 256, 2: 1024}
LEVELS = {1: 16, 2: 2}
#: Titles of one length and works compared in a step, pairs kept before they are looked at, pairs whose subsequences are computed together,
#: characters after which those that cannot be long enough are left out and the window moves.
ROWS, COLUMNS, KEPT, BATCH, CHECK = 16, 4096, 400_000, 32_768, 8
#: Slack for sums of floating point numbers.
EPS = 1e-6
#: From this length of the second text on the sequence matcher leaves out frequent characters (difflib's constant).
AUTOJUNK = 200


@lru_cache(4096)
def columns(height: int, width: int) -> int:
    """The first column of a bit matrix of so many rows and columns."""
    return ((1 << height * width) - 1) // ((1 << width) - 1)


def matched(a: str, b: str) -> int:
    """Characters that difflib's sequence matcher matches in a and b, b shorter than AUTOJUNK.

    Equal characters are bits of one number, row by row. Runs on a diagonal come from shifts of it, twice as long each time; its lowest
    bit is the run that starts first in a, then in b.
    """
    size = len(b) // 8 + 1
    width = 8 * size
    at: dict[str, int] = {}
    for j, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << j
    row = dict.fromkeys(a, bytes(size)) | {c: x.to_bytes(size, "little") for c, x in at.items()}
    first = columns(len(a), width)
    total, left = 0, [int.from_bytes(b"".join(map(row.__getitem__, a)), "little")]
    while left:
        if not (m := left.pop()):
            continue
        runs, k, now = [m], 1, m
        while longer := now & (now >> k * (width + 1)):
            now, k = longer, 2 * k
            runs.append(now)
        length = k
        for r in reversed(runs[:-1]):
            k //= 2
            if longer := now & (r >> length * (width + 1)):
                now, length = longer, length + k
        i, j = divmod((now & -now).bit_length() - 1, width)
        total += length
        if i and j:
            left.append(m & ((1 << i * width) - 1) & ((first << j) - first))
        if m := m >> (i + length) * width:
            left.append(m ^ (m & ((first << j + length) - first)))
    return total


def similarity(a: str, b: str) -> float:
    """difflib's ratio of a and b."""
    if a == b:
        return 1.0
    if len(b) >= AUTOJUNK:
        return difflib.SequenceMatcher(None, a, b).ratio()
    return 2.0 * matched(a, b) / (len(a) + len(b))


class Texts:
    """Texts ordered by length: their characters as numbers below 256, one number for all others of a remainder, and counts of sequences."""

    def __init__(self, texts: list[str]):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.order = np.argsort(lengths, kind="stable")
        self.texts = [texts[i] for i in self.order]
        self.length = lengths[self.order]
        self.code = np.frombuffer("".join(self.texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.length)])

    def counts(self, n: int) -> np.ndarray:
        """How often each bucket of character sequences of length n occurs in each text, at most LEVELS times."""
        out = np.empty((len(self.texts), BUCKETS[n]), np.uint8)
        for lo in range(0, len(self.texts), 1024):
            hi = min(lo + 1024, len(self.texts))
            code, row = self.code[self.at[lo] : self.at[hi]], np.repeat(np.arange(hi - lo), self.length[lo:hi])
            if n == 1:
                key = folded(code)
            else:
                inside = row[1:] == row[:-1]
                row, key = row[1:][inside], ((code[:-1] * 1_000_003 + code[1:]) * 2_654_435_761 % 4_294_967_291 % BUCKETS[n])[inside]
            c = np.bincount(row * BUCKETS[n] + key, minlength=(hi - lo) * BUCKETS[n])
            out[lo:hi] = np.minimum(c, LEVELS[n]).reshape(hi - lo, BUCKETS[n])
        return out

    def padded(self, number: np.ndarray) -> np.ndarray:
        """Characters by position and text, mapped by number; 0 after the end."""
        out = np.zeros((int(self.length.max()), len(self.texts)), np.int64)
        row = np.repeat(np.arange(len(self.texts)), self.length)
        out[np.arange(len(self.code)) - self.at[row], row] = number[folded(self.code)]
        return out


def folded(code: np.ndarray) -> np.ndarray:
    return np.where(code < 128, code, 128 + code % 128)


def bits(a: Texts, b: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits "this bucket occurs more than so often" of both, those that tell most: no more of them differ than sequences of length n do."""
    ca, cb = a.counts(n), b.counts(n)
    share = np.stack([(ca > k).sum(0) / len(ca) + (cb > k).sum(0) / len(cb) for k in range(LEVELS[n])]) / 2
    best = np.argsort(-(share * (1 - share)).ravel(), kind="stable")[: BITS[n]]
    level, bucket = (best // BUCKETS[n]).astype(np.uint8), best % BUCKETS[n]
    pack = lambda c: np.ascontiguousarray(np.packbits(np.pad(c.take(bucket, axis=1) > level, ((0, 0), (0, -len(best) % 64))), axis=1)).view(np.uint64)
    return pack(ca), pack(cb)


def sums(counts: np.ndarray) -> np.ndarray:
    """Sums over the 8 bytes of each row."""
    x, mask = np.ascontiguousarray(counts).view(np.uint64)[:, 0], np.uint64(0x00FF00FF00FF00FF)
    return ((x & mask) + ((x >> np.uint64(8)) & mask)) * np.uint64(0x0001000100010001) >> np.uint64(48)


class Tile:
    """Titles and works with their years (None: unknown) and keys, of which `best` finds the work of highest score of each title."""

    def __init__(self, titles: list[str], years: list, works: list[str], work_years: list, keys: list, least: float, less: float):
        self.a, self.b, self.least, self.less = Texts(titles), Texts(works), least, less
        self.keys = [keys[i] for i in self.b.order]
        known = lambda y, order: np.array([np.nan if y[i] is None else y[i] for i in order], np.float64)
        self.ya, self.yb = known(years, self.a.order), known(work_years, self.b.order)
        self.found: list[tuple | None] = [None] * len(titles)
        self.score = np.full(len(titles), least)
        used = np.unique(np.concatenate([folded(self.a.code), folded(self.b.code)]))
        number = np.zeros(256, np.int64)
        number[used] = np.arange(1, len(used) + 1)
        self.letters, self.pa, self.pb = len(used) + 1, self.a.padded(number), self.b.padded(number)

    def best(self) -> list[tuple[int, object, float]]:
        """(number of the title, key of its work, score), titles that no work is near enough to have none."""
        held, n = [], 0
        for t, w, d in self.near():
            held.append((t, w, d))
            n += len(t)
            if n >= KEPT:
                self.look(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if held:
            self.look(*map(np.concatenate, zip(*held)))
        return [(int(self.a.order[t]), f[2], f[0]) for t, f in enumerate(self.found) if f]

    def near(self):
        """Titles, works and least numbers of unmatched characters of the pairs that lengths and bits allow, all pairs of a title in a row."""
        a1, b1 = bits(self.a, self.b, 1)
        a2, b2 = bits(self.a, self.b, 2)
        columns_a, words = np.ascontiguousarray(a1.T), np.ascontiguousarray(b1.T)
        lengths, starts = np.unique(self.a.length, return_index=True)
        least = max(self.least, EPS)
        for la, start, end in zip(lengths, starts, [*starts[1:], len(self.a.texts)]):
            lo, hi = np.searchsorted(self.b.length, [(la * least - EPS) / (2 - least), (la * (2 - least) + EPS) / least + 1])
            most = (1 - self.least) * (la + self.b.length[lo:hi]) + EPS
            limit = np.minimum(most, 255).astype(np.uint8)
            for top in range(start, end, ROWS):
                rows = a1[top : min(top + ROWS, end)]
                for x in range(0, hi - lo, COLUMNS):
                    cut = slice(lo + x, min(lo + x + COLUMNS, hi))
                    differ = np.bitwise_count(rows[:, :1] ^ words[0][cut])
                    differ += np.bitwise_count(rows[:, 1:2] ^ words[1][cut])
                    hit = np.flatnonzero(differ <= limit[x : x + differ.shape[1]])
                    t, w = np.divmod(hit, differ.shape[1])
                    d1, w = differ.ravel()[hit], w + x
                    for k in (2, 3):
                        d1 += np.bitwise_count(columns_a[k].take(t + top) ^ words[k].take(w + lo))
                    keep = np.flatnonzero(d1 <= limit[w])
                    if not len(keep):
                        continue
                    t, w, d1 = t[keep], w[keep], d1[keep].astype(np.int64)
                    d2 = sums(np.bitwise_count(a2.take(t + top, 0) ^ b2.take(w + lo, 0))).astype(np.int64)
                    keep = d2 <= 3 * most[w]
                    yield top + t[keep], lo + w[keep], np.maximum(d1, -(-d2 // 3))[keep]

    def look(self, t: np.ndarray, w: np.ndarray, unmatched: np.ndarray) -> None:
        """Score the pairs, likeliest first: a title's likeliest work, then what can still reach its score."""
        both = self.a.length[t] + self.b.length[w]
        less = np.where((self.ya[t] != self.yb[w]) & ~np.isnan(self.ya[t]) & ~np.isnan(self.yb[w]), self.less, 0.0)
        bound = 1 - unmatched / both - less
        order = np.lexsort((-bound, t))
        t, w, both, less, bound = (x[order] for x in (t, w, both, less, bound))
        first = np.concatenate([[True], t[1:] != t[:-1]])
        for now in (first, ~first):
            now = np.flatnonzero(now & (bound >= self.score[t] - EPS))
            need = (self.score[t[now]] + less[now] - EPS) * both[now] / 2
            bound[now] = 2 * self.common(t[now], w[now], need) / both[now] - less[now]
            now = now[bound[now] >= self.score[t[now]] - EPS]
            for i in now[np.lexsort((-bound[now], t[now]))]:
                self.try_pair(t[i], w[i], less[i], bound[i])

    def try_pair(self, t: int, w: int, less: float, bound: float) -> None:
        key, found = self.keys[w], self.found[t]
        rank = (key is not None, key)
        if bound < self.score[t] - EPS or (found and bound <= found[0] + EPS / 1000 and rank <= found[1]):
            return
        score = similarity(self.a.texts[t], self.b.texts[w]) - less
        if score >= self.least and (not found or (score, rank) > found[:2]):
            self.found[t], self.score[t] = (score, rank, key), score

    def common(self, t: np.ndarray, w: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Lengths of common subsequences, bit-parallel over many pairs: no fewer characters than a sequence matcher matches, 0 if fewer than needed.

        With as many as needed no more than `before` characters of a title and `after` of a work are unmatched, so no character moves
        farther: a window of a title's characters, which follows the place in the work, holds all that can match.
        """
        out = np.zeros(len(t), np.int64)
        la, lb = self.a.length[t], self.b.length[w]
        before, after = (np.maximum(np.floor(x - need + EPS), -1).astype(np.int64) for x in (la, lb))
        possible = (before >= 0) & (after >= 0)
        order = np.flatnonzero(possible)
        narrow = before[order] + after[order] < 64 - CHECK
        for at, one in ((order[narrow], self.window), (order[~narrow], self.whole)):  # titles are ordered by length
            at = at[np.argsort(t[at], kind="stable")]
            for lo in range(0, len(at), BATCH):
                x = at[lo : lo + BATCH]
                here, length = one(t[x], w[x], need[x], before[x], after[x])
                out[x[here]] = length
        return out

    def masks(self, titles: np.ndarray, shift: int) -> np.ndarray:
        """Where each character is in each title, that many places up: words of 64 places by title and character."""
        longest = int(self.a.length[titles].max())
        out = np.zeros((-(-(longest + shift) // 64) + 1, len(titles) * self.letters), np.uint64)
        start = np.arange(len(titles)) * self.letters
        for i in range(longest):
            out[(i + shift) // 64, start + self.pa[i, titles]] |= np.uint64(1 << (i + shift) % 64)
        out[:, start] = 0  # number 0 is no character
        return out

    def window(self, t, w, need, before, after) -> tuple[np.ndarray, np.ndarray]:
        titles, own = np.unique(t, return_inverse=True)
        base = int(after.max())  # place 0 of the window is so far before the place in the work
        if base + int(before.max()) >= 64 - CHECK:
            return self.whole(t, w, need, before, after)
        masks, one = self.masks(titles, base), np.uint64(1)
        here, rows, end = np.arange(len(t)), own * self.letters, self.b.length[w]
        band = ((one << (before + after + 1).astype(np.uint64)) - one) << (base - after).astype(np.uint64)
        left, done = np.full(len(t), (1 << 64) - 1, np.uint64), np.zeros(len(t), np.int64)
        for i in range(0, int(end.max()), CHECK):
            k, x = divmod(i, 64)
            if k >= len(masks):
                break
            table = masks[k] >> np.uint64(x)
            if x and k + 1 < len(masks):
                table |= masks[k + 1] << np.uint64(64 - x)
            u, s, at, now = np.empty_like(left), np.empty_like(left), np.empty_like(rows), band.copy()
            for j in range(i, min(i + CHECK, len(self.pb))):
                np.take(self.pb[j], w, out=at, mode="clip")
                np.add(rows, at, out=at)
                np.take(table, at, out=u, mode="clip")
                np.bitwise_and(u, now, out=u)
                np.bitwise_and(u, left, out=u)
                np.add(left, u, out=s)
                np.bitwise_xor(left, u, out=u)
                np.bitwise_or(s, u, out=left)
                np.left_shift(now, one, out=now)
            # the places that the window leaves are counted, those it reaches are open
            done += CHECK - np.bitwise_count(left & np.uint64((1 << CHECK) - 1)).astype(np.int64)
            left = left >> np.uint64(CHECK) | np.uint64(((1 << CHECK) - 1) << 64 - CHECK)
            open_ = np.flatnonzero(done + (64 - np.bitwise_count(left).astype(np.int64)) + np.maximum(end - i - CHECK, 0) >= need)
            if len(open_) < 0.8 * len(here):
                here, rows, end, w, need, left, done, band = (x[open_] for x in (here, rows, end, w, need, left, done, band))
                if not len(here) or i + CHECK >= end.max():
                    break
        return here, done + (64 - np.bitwise_count(left).astype(np.int64))

    def whole(self, t, w, need, before, after) -> tuple[np.ndarray, np.ndarray]:
        titles, own = np.unique(t, return_inverse=True)
        masks, rows = self.masks(titles, 0), own * self.letters
        left = np.full((len(masks), len(t)), (1 << 64) - 1, np.uint64)
        for i in range(int(self.b.length[w].max())):
            at, carry = rows + self.pb[i, w], np.uint64(0)
            for x, mask in zip(left, masks):
                u = x & mask[at]
                s = x + u
                total = s + carry
                carry = ((s < x) | (total < s)).astype(np.uint64)
                x[:] = total | (x ^ u)
        # bits beyond a title's end stay set
        return np.arange(len(t)), 64 * len(masks) - np.bitwise_count(left).sum(0, dtype=np.int64)

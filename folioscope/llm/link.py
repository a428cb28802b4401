"""Matching records to works without a common key: regularised Gaussian mixtures over similarity vectors, fitted without labels.

Candidates share five of the six rarest title tokens, or three of the five rarest and an author; where either side names nobody,
four of the six rarest. A pair's vector is (title, authors, year) similarity; a component whose
field is null on either side takes no part in its density. Expectation-maximisation fits one Gaussian to matched and one to
unmatched pairs, variances shrunk towards the common variance. Transitivity is enforced in the expectation step, on both sides:
different works never are the same work, so a record's posteriors compete and sum to one at most; and records a and b of one work
w are the same, so p(a, w) p(b, w) <= p(a, b), where b is one record that stands for all of the work (not all pairs).
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.names import near, parse, plain
from folioscope.session import spread, written

STOP = {"a", "an", "and", "at", "for", "from", "in", "of", "on", "the", "to", "with", "by", "its", "de", "la", "le", "des", "der", "die", "das", "und", "et"}
ROMAN = {"i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"}
#: Counts of title tokens are kept in so many cells, whatever the data; tokens that share a cell only share their rank.
CELLS = 1 << 17
#: Blocking: token subsets (of so many rarest, so many) alone, beside an author, and where one side has no authors.
ALONE, WITH_AUTHOR, NO_AUTHOR = (6, 5), (5, 3), (6, 4)
DIMS = ("title", "authors", "year")
PEER = ("peer_title", "peer_authors", "peer_year")
#: Prior weight of the common variance in each Gaussian's variance, and the least variance.
SHRINK, FLOOR = 0.03, 0.001
#: Rounds end when no parameter moves by more; a fit that needs more rounds than that is an error.
STILL, MOST_ROUNDS = 1e-3, 200
#: Pairs of less confidence have no part in transitivity over a work's records.
UNSURE = 0.05
#: Tokens, numbers and people are joined by blanks and by |.
SIDE = "tokens string, main int, numbers string, people string, year int"


def title_of(raw: str | None) -> str:
    """The title in a reference text: quoted, behind the year, or behind the authors' final stop."""
    if not raw:
        return ""
    for pattern in (r"“([^”]{8,})”", r"\"([^\"]{8,}?),?\"", r"\(\d{4}[a-z]?\)\.?\s*(.+?)(?:\.\s|$)", r"(?:\.\.|et al\.|[^\W\d_]{3,}\.|\b[A-Z]\.)\s+([^\W\d_][^.]{14,}?)(?:\[[A-Z]\]|\.\s|$)"):
        m = re.search(pattern, raw)
        if m:
            return m.group(1)
    return raw


def year_of(raw: str | None) -> int | None:
    found = re.findall(r"(?<!\d)(1[89]\d{2}|20\d{2})(?!\d)", raw or "")
    return int(found[0]) if found else None


@lru_cache(maxsize=65536)
def title_tokens(title: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(content words and pairs of Han characters, part and figure numbers) of a title."""
    words, numbers = [], []
    for w in re.findall(r"[一-鿿]+|[^\W_一-鿿]+", plain(title)):
        if "一" <= w[0] <= "鿿":
            w = w.replace("的", "") or w
            words.extend(w[i : i + 2] for i in range(max(1, len(w) - 1)))
        elif w.isdigit() or w in ROMAN:
            numbers.append(w)
        elif w not in STOP:
            words.append(w)
    return tuple(words), tuple(numbers)


@lru_cache(maxsize=1 << 17)
def token_hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token) >> 2


@lru_cache(maxsize=1 << 16)
def cut(text: str, by: str = " ") -> tuple[str, ...]:
    return tuple(text.split(by)) if text else ()


@lru_cache(maxsize=1 << 16)
def person(name: str) -> str:
    """Family name of an author, both words if their order is unsure, empty for no name."""
    kind, family, given, _, _, unsure = parse(name)
    return "" if kind == "none" else " ".join(sorted((family, given))) if unsure else family.replace(" ", "_")


def _like(w: str, v: str) -> bool:
    """One edit apart, or one begins with the other; words of three letters or more that share no end can't be."""
    return (w[0] == v[0] and (v.startswith(w) or w.startswith(v))) or ((w[0] == v[0] or w[-1] == v[-1]) and near(w, v) == 1)


def title_similarity(a, b, na, nb) -> float:
    """1 for equal titles; another part number costs most, a word replaced by another a third, a word left out less, a typo or abbreviation least."""
    left, right, near_ = [], [], 0
    if a != b:
        right = list(b)
        for w in a:
            if w in right:
                right.remove(w)
            else:
                left.append(w)
        for w in list(left):
            for v in right:
                if len(w) >= 3 and len(v) >= 3 and _like(w, v):
                    left.remove(w)
                    right.remove(v)
                    near_ += 1
                    break
    swapped, dropped = min(len(left), len(right)), abs(len(left) - len(right))
    if na != nb and sorted(na) != sorted(nb):
        swapped, dropped = swapped + 2 * bool(na and nb), dropped + (not (na and nb))
    return max(0.0, 1 - (swapped + 0.25 * dropped + 0.1 * near_) / 3)


def people_match(a, b) -> float | None:
    """Share of the shorter list of people that the other holds, None if either is empty; a person of unsure word order stands as both words."""
    if not len(a) or not len(b):
        return None
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    words = [w for q in long_ for w in cut(q)]
    known, hits = set(words), 0
    for p in short:
        own = cut(p)
        hits += any(x in known for x in own) or any(len(x) > 3 and len(y) > 3 and (x[0] == y[0] or x[-1] == y[-1]) and near(x, y) == 1 for x in own for y in words)
    return hits / len(short)


def vectors(ta: pd.Series, na: pd.Series, pa: pd.Series, ya: pd.Series, tb: pd.Series, nb: pd.Series, pb: pd.Series, yb: pd.Series) -> pd.DataFrame:
    """The similarity vectors of pairs of described rows, column by column."""
    years = zip(ya.tolist(), yb.tolist())
    rows = [(title_similarity(cut(a), cut(b), cut(c), cut(d)), people_match(cut(e, "|"), cut(f, "|")), year_similarity(g, h)) for a, c, e, b, d, f, (g, h) in zip(ta, na, pa, tb, nb, pb, years)]
    return pd.DataFrame(rows, columns=list(DIMS), dtype="float64")


def year_similarity(a, b) -> float | None:
    if a is None or b is None or a != a or b != b:
        return None
    return max(0.0, 1 - abs(int(a) - int(b)) / 3)


def described(records: DataFrame, key: str, raw: str | None = None) -> DataFrame:
    """(key, tokens, main, numbers, people, year), main the number of tokens before a subtitle; a blank title and a missing year are read from raw if there is one, missing authors are not."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, title, authors, year, text in b.itertuples(index=False, name=None):
                title = title if isinstance(title, str) and title.strip() else title_of(text)
                tokens, numbers = title_tokens(title)
                main = len(title_tokens(re.split(r":\s|[—–]\s", title, maxsplit=1)[0])[0])
                people = "|".join(filter(None, (person(name) for name in (authors if authors is not None else []) if name)))
                year = int(year) if year is not None and year == year else year_of(text)
                out.append((k, " ".join(tokens), main, " ".join(numbers), people, year))
            yield pd.DataFrame(out, columns=[key, "tokens", "main", "numbers", "people", "year"]).astype({"year": "Int32"})

    kind = dict(records.dtypes)[key]
    source = records.where(F.col(key).isNotNull()).select(key, "title", "authors", "year", F.col(raw) if raw else F.lit(None).cast("string").alias("raw"))
    return spread(source).mapInPandas(read, f"{key} {kind}, {SIDE}")


def candidates(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(left_key, right_key, title, authors, year): pairs that share a blocking key and half of the shorter title, and their similarity vectors."""
    counts = token_counts(right)
    shared = left.sparkSession.sparkContext.broadcast(counts)

    def subsets(rare: list[int], of: tuple[int, int]) -> list[tuple[int, ...]]:
        rare = rare[: of[0]]
        sizes = {min(of[1], len(rare)), max(1, min(of[1], len(rare) - 1))} if rare else ()  # a short title may lack one token more
        return [tuple(sorted(c)) for k in sizes for c in itertools.combinations(rare, k)]

    def keys(listed: bool):
        """Blocking keys of a side: works are listed for records without authors under *, records ask for works without under ?."""

        @F.pandas_udf("array<bigint>")
        def of(tokens: pd.Series, main: pd.Series, people: pd.Series) -> pd.Series:
            out = []
            for ts, m, ps in zip(tokens, main, people):
                ts = cut(ts)
                heads = {token_hash(w[:4]) for p in cut(ps, "|") for w in cut(p)}
                marks = [1] * (listed or not heads) + [2] * (not listed or not heads)
                found = set()
                for part in (ts, ts[:m]) if listed and 3 <= m < len(ts) else (ts,):  # a record may leave a work's subtitle out
                    known = {h: n for h in map(token_hash, set(part)) if (n := int(shared.value[h % CELLS]))}
                    rare = sorted(known, key=lambda h: (known[h], h))
                    found.update(hash((0, *c)) for c in subsets(rare, ALONE))
                    found.update(hash((h, *c)) for c in subsets(rare, WITH_AUTHOR) for h in heads)
                    found.update(hash((k, *c)) for c in subsets(rare, NO_AUTHOR) for k in marks)
                out.append(np.fromiter(found, np.int64, len(found)))
            return pd.Series(out, index=tokens.index, dtype=object)

        return of

    lk = left.select(left_key, F.explode(keys(False)("tokens", "main", "people")).alias("key"))
    rk = right.select(right_key, F.explode(keys(True)("tokens", "main", "people")).alias("key"))
    # Spark reckons exploded keys at the size of what they come from and would broadcast them: joins of what grows with data are merge joins
    pairs = written(lk.join(rk.hint("merge"), "key").select(left_key, right_key).distinct(), "blocked")
    pairs = pairs.join(left.hint("merge"), left_key).join(right.select(right_key, *[F.col(c).alias(c + "_b") for c in ("tokens", "numbers", "people", "year")]).hint("merge"), right_key)
    words = lambda c: F.array_distinct(F.split(c, " "))
    common = F.size(F.array_intersect(words("tokens"), words("tokens_b")))
    pairs = pairs.where(common >= 0.5 * F.least(F.size(words("tokens")), F.size(words("tokens_b"))))
    vector = F.pandas_udf(vectors, "title double, authors double, year double")
    return pairs.select(left_key, right_key, vector("tokens", "numbers", "people", "year", "tokens_b", "numbers_b", "people_b", "year_b").alias("v")).select(left_key, right_key, "v.*")


def token_counts(works: DataFrame) -> np.ndarray:
    """How many title tokens of works fall into each cell."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(CELLS, np.int64)
        for b in batches:
            hashes = np.fromiter((token_hash(t) for text in b["tokens"] for t in cut(text)), np.int64)
            acc += np.bincount(hashes % CELLS, minlength=CELLS)
        at = np.flatnonzero(acc)
        yield pd.DataFrame({"c": at.astype(np.int32), "n": acc[at]})

    counts = np.zeros(CELLS, dtype=np.int64)
    rows = works.select("tokens").mapInPandas(count, "c int, n bigint").groupBy("c").agg(F.sum("n").alias("n")).toPandas()  # at most CELLS rows
    counts[rows["c"].to_numpy()] = rows["n"].to_numpy()
    return counts


def _densities(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    d = -0.5 * (np.log(2 * math.pi * var) + (x - mean) ** 2 / var)
    return np.where(np.isnan(x), 0.0, d).sum(1)


def _competing(group: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Posteriors of matches that exclude each other within a group: odds over one plus the group's odds."""
    _, at = np.unique(group, return_inverse=True)
    return odds / (1 + np.bincount(at, weights=odds)[at])


def whole(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by key, cut so that no key's rows are in two of them."""
    rest: pd.DataFrame | None = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        if not len(b):
            continue
        k = b[key].to_numpy()
        cut = len(b) - int((k[::-1] != k[-1]).argmax()) if (k != k[-1]).any() else 0
        if cut:
            yield b.iloc[:cut]
        rest = b.iloc[cut:]
    if rest is not None and len(rest):
        yield rest


def start(pairs: DataFrame) -> tuple[dict, np.ndarray]:
    """The first parameters of the mixture and the common variances, from pairs with the columns of DIMS."""
    total = pairs.select(*[f(F.col(d)).alias(f"{d}_{n}") for d in DIMS for n, f in (("mean", F.avg), ("var", F.var_pop))]).first()
    common = np.array([max(total[f"{d}_var"] or FLOOR, FLOOR) for d in DIMS])
    return {"weight": 0.1, "mean": np.array([[0.3, 0.2, 0.3], [0.95, 0.9, 0.9]]), "var": np.stack([common, np.full(3, 0.02)])}, common


def fit(grouped: DataFrame, left_key: str, model: dict, common: np.ndarray) -> dict:
    """Parameters of the mixture from pairs grouped by left_key, with the columns of DIMS and PEER.

    Every round is one pass over all pairs; a partition gives back its sums. Rounds end when no parameter moves by more than STILL.
    """
    for _ in range(MOST_ROUNDS):
        now = model

        def sums(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            acc = np.zeros((3, 3, 3))
            n = np.zeros(4)
            for b in whole(batches, left_key):
                x = b[list(DIMS)].to_numpy(dtype="float64")
                p = posteriors(b[left_key].to_numpy(), x, now, b)
                parts = [(0, x, 1 - p), (1, x, p)]
                if "peer_p" in b:
                    asked = b["peer_p"].notna().to_numpy()
                    own = 1 / (1 + np.exp(-log_odds(x[asked], now)))
                    n[3] += asked.sum()
                    parts.append((2, b.loc[asked, list(PEER)].to_numpy(dtype="float64"), own))
                for k, y, w in parts:
                    n[k] += w.sum()
                    ok = ~np.isnan(y)
                    v, w2 = np.where(ok, y, 0.0), np.where(ok, w[:, None], 0.0)
                    acc[k] += np.stack([w2.sum(0), (w2 * v).sum(0), (w2 * v * v).sum(0)])
            yield pd.DataFrame([(*acc.ravel(), *n)], columns=[f"s{i}" for i in range(31)])

        schema = ", ".join(f"s{i} double" for i in range(31))
        out = np.array(grouped.mapInPandas(sums, schema).agg(*[F.sum(f"s{i}") for i in range(31)]).first(), dtype="float64")
        if not np.isfinite(out).all() or out[27:29].sum() == 0:
            return model
        s = out[:27].reshape(3, 3, 3)
        mean = s[:, 1] / np.maximum(s[:, 0], 1e-9)
        var = s[:, 2] / np.maximum(s[:, 0], 1e-9) - mean**2
        var = np.maximum((1 - SHRINK) * var + SHRINK * np.minimum(common, 0.05), FLOOR)
        model = {"weight": float(np.clip(out[28] / out[27:29].sum(), 1e-4, 0.9)), "mean": mean[:2], "var": var[:2]}
        if out[30]:  # records of one work: their own likeness, against that of unmatched pairs
            model["peers"] = {"weight": float(np.clip(out[29] / out[30], 0.01, 0.99)), "mean": np.stack([mean[0], mean[2]]), "var": np.stack([var[0], var[2]])}
        moved = max(abs(model["weight"] - now["weight"]), np.abs(mean[:2] - now["mean"]).max(), np.abs(var[:2] - now["var"]).max())
        if moved <= STILL and ("peers" in model) == ("peers" in now):
            return model
    raise RuntimeError("the mixture did not settle")


def log_odds(x: np.ndarray, model: dict) -> np.ndarray:
    """Of a match; likelihood ratios must rise with similarity: beyond a mean the matched density stays at its peak, short of it the unmatched one."""
    up = np.where(np.isnan(x), x, np.minimum(x, model["mean"][1])), np.where(np.isnan(x), x, np.maximum(x, model["mean"][0]))
    d = _densities(up[0], model["mean"][1], model["var"][1]) - _densities(up[1], model["mean"][0], model["var"][0])
    return np.clip(d + math.log(model["weight"] / (1 - model["weight"])), -60, 60)


def posteriors(group: np.ndarray, x: np.ndarray, model: dict, rows: pd.DataFrame | None = None) -> np.ndarray:
    """Match posteriors of pairs that compete within a group and, where rows hold a peer's vector and its confidence, agree with the work's surest record."""
    own = log_odds(x, model)
    if rows is not None and "peer_p" in rows and "peers" in model:
        sure = rows["peer_p"].to_numpy(dtype="float64")
        peers = log_odds(rows[list(PEER)].to_numpy(dtype="float64"), model["peers"])
        weaker = ~np.isnan(sure) & (peers < -own)  # where p(a, w) p(b, w) > p(a, b), the less certain of p(a, w) and p(a, b) gives way
        p = np.minimum(1 / (1 + np.exp(-own)), np.where(weaker, 1 / (1 + np.exp(-peers)) / np.maximum(sure, 1e-9), 1.0))
        own = np.clip(np.log(np.maximum(p, 1e-26)) - np.log(np.maximum(1 - p, 1e-26)), -60, 60)
    odds = np.exp(own)
    return _competing(group, odds)


def scored(grouped: DataFrame, left_key: str, right_key: str, model: dict, kinds: dict) -> DataFrame:
    """(left_key, right_key, confidence) of grouped pairs."""

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole(batches, left_key):
            p = posteriors(b[left_key].to_numpy(), b[list(DIMS)].to_numpy(dtype="float64"), model, b)
            yield pd.DataFrame({left_key: b[left_key], right_key: b[right_key], "confidence": p})

    return grouped.mapInPandas(decide, f"{left_key} {kinds[left_key]}, {right_key} {kinds[right_key]}, confidence double")


def with_peers(pairs: DataFrame, sure: DataFrame, left: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """pairs with peer_p and PEER: the confidence of the work's surest record and the vector between the pair's record and it; null for that record itself and for pairs that are no match anyway.

    One record for each work stands for all, the surest of most equal year and first author: p(a, w) p(b, w) <= p(a, b) is asked of n records, not of n^2 pairs.
    """
    told = sure.join(left.select(left_key, F.coalesce(F.col("year").cast("string"), F.lit("")).alias("y"), F.substring_index("people", "|", 1).alias("p")).hint("merge"), left_key)
    group = told.groupBy(right_key, "y", "p").agg(F.sum("confidence").alias("votes"), F.max(F.struct("confidence", left_key)).alias("top"))
    best = group.groupBy(right_key).agg(F.max(F.struct("votes", "top")).alias("b")).select(right_key, F.col(f"b.top.{left_key}").alias("peer"), F.col("b.top.confidence").alias("peer_p"))
    side = ["tokens", "numbers", "people", "year"]
    asked = sure.select(left_key, right_key).join(best.hint("merge"), right_key).where(F.col("peer") != F.col(left_key))
    asked = asked.join(left.select(left_key, *side).hint("merge"), left_key).join(left.select(F.col(left_key).alias("peer"), *[F.col(c).alias(c + "_b") for c in side]).hint("merge"), "peer")
    vector = F.pandas_udf(vectors, "title double, authors double, year double")
    asked = asked.select(left_key, right_key, "peer_p", vector(*side, *[c + "_b" for c in side]).alias("v"))
    asked = asked.select(left_key, right_key, "peer_p", *[F.col(f"v.{d}").alias(p) for d, p in zip(DIMS, PEER)])
    return pairs.join(asked.hint("merge"), [left_key, right_key], "left")


def link(records: DataFrame, works: DataFrame, least: float = 0.5, both_sides: bool = True) -> DataFrame:
    """(rec_id, identifier, confidence): the works that records (rec_id, title, authors, year, raw) describe, at least `least` sure.

    Keys that repeat count once, rows without key not at all. A record without title and raw text, or whose title shares too little with any work, has no row;
    empty tables give no rows. Other columns are ignored. Without both_sides only a record's works exclude each other.
    """
    key, other = "rec_id", "identifier"
    left = written(described(records.dropDuplicates([key]), key, "raw"), "records")
    right = written(described(works.dropDuplicates([other]), other), "works")
    pairs = written(candidates(left, right, key, other), "pairs")
    if pairs.isEmpty():
        return pairs.select(key, other, F.lit(0.0).alias("confidence"))
    kinds = dict(pairs.dtypes)
    # grouped once for all rounds; what is lost with an executor comes again from the written pairs
    grouped = pairs.repartition(key).sortWithinPartitions(key).persist(StorageLevel.DISK_ONLY)
    model, common = start(pairs)
    model = fit(grouped, key, model, common)
    out = written(scored(grouped, key, other, model, kinds).where(F.col("confidence") >= (UNSURE if both_sides else least)), "scored")
    grouped.unpersist()
    if both_sides:
        pairs = written(with_peers(pairs, out, left, key, other), "peers")
        grouped = pairs.repartition(key).sortWithinPartitions(key).persist(StorageLevel.DISK_ONLY)
        model = fit(grouped, key, model, common)
        out = written(scored(grouped, key, other, model, kinds).where(F.col("confidence") >= least), "links")
        grouped.unpersist()
    return out

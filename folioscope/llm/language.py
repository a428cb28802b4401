"""Languages of documents and of the segments of mixed ones, by language-bitmask n-gram filters.

Every character n-gram's languages are bits of one mask, kept in bit-sliced Bloom filters: each slot of one array holds a bit
per language, an n-gram sets its languages' bits in a few slots, and the AND of these slots gives back all its languages at
once. A sentence's languages are counted by bit, less the hits expected from false positives; the best sequence of languages
over the sentences of a document, with a price for each change, gives its segments. The sentences of many documents are read
as one array of grams.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import spread

#: The filters are fitted to about so many labelled documents of each language (fewer where there are fewer), chosen by a hash
#: of their text, among texts of TRAIN_CHARS characters or fewer; every document is then labelled with them.
TRAIN_DOCS, TRAIN_CHARS = 300, 50_000
#: A mask holds so many languages at most.
MOST_LANGUAGES = 64
#: Documents are read together up to about so many characters.
TOGETHER = 1 << 15
#: Slots of the filters and hash functions a gram.
SLOTS, HASHES = 1 << 21, 3
ORDERS = (3, 5)
#: An n-gram belongs to a language in which it is in two sampled documents or more, and in at least this share of the documents
#: of the language that has it most often (in proportion).
LEAST_DOCS, LEAST_SHARE = 2, 0.3
#: Grams of advantage that a change of language must bring.
CHANGE = 12.0
#: A sentence of fewer letters (a reference's number and author, say) weighs less, as the square of its share in so many or in the
#: document's longest sentence if that is shorter; a Han character counts for four.
FULL_LETTERS = 24
#: Other names of languages that labels use: ISO 639-2 codes (fixed values).
ISO3 = {"eng": "en", "zho": "zh", "chi": "zh", "cmn": "zh", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "ita": "it", "nld": "nl", "dut": "nl", "rus": "ru", "jpn": "ja", "kor": "ko", "pol": "pl", "swe": "sv", "ara": "ar"}
SENTENCE = re.compile(r"(?<=[.!?。！？；])(?=\s|[^\x00-\x7F])|(?<=[.!?])[\"”’)]+(?=\s)|\n+")
#: Quoted, bracketed or dashed-off phrases say little about the language of their sentence; none runs over a line's end.
QUOTED = re.compile(r"[“\"«‹「『][^“”\"«»‹›「」『』\n]{1,200}[”\"»›」』]")
DASHED = re.compile(r"[–—](?<=[^\S\n][–—]) [^–—\n]{1,200} [–—](?=[^\w\n])")
ACCENT, OTHER, LETTER = re.compile(r"[\u0300-\u036f]+"), re.compile(r"(?:[^\w\n]+|[\d_]+)+"), re.compile(r"[^\W\d_]")


def label_code(label: Column, codes: dict[str, str]) -> Column:
    """The language code a label means, null if it means none of them: codes, names, ISO 639-2 codes, with regions, in any case."""
    plain = F.lower(F.trim(label))
    head = F.regexp_extract(plain, r"^([a-z]{2,3})(?:[-_][a-z0-9]+)*$", 1)
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(table, plain), F.try_element_at(table, head))


def known_labels(languages: list[tuple[str, str]]) -> dict[str, str]:
    out = {code.lower(): code for code, _ in languages} | {name.lower(): code for code, name in languages}
    return out | {iso: code for iso, code in ISO3.items() if code in {c for c, _ in languages}}


def plain(text: str) -> str:
    """The text without quoted and dashed-off phrases."""
    text = QUOTED.sub(" ", text)
    return DASHED.sub(" ", text) if "–" in text or "—" in text else text


def letters(text: str) -> list[str]:
    """Every line in lower case, without accents, every run of other characters than letters one blank, and one at both ends."""
    t = text.lower()
    t = t if t.isascii() else ACCENT.sub("", unicodedata.normalize("NFKD", t))
    return [f" {line.strip()} " for line in OTHER.sub(" ", t).split("\n")]


def grams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every n-gram inside a prepared line, number of its line)."""
    c = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    line = np.repeat(np.arange(len(lines), dtype=np.int32), [len(x) for x in lines])
    hashes, lines_of = [], []
    han = (c >= 0x4E00) & (c <= 0x9FFF)
    sizes = {*ORDERS, 1, 2} if han.any() else set(ORDERS)
    h = np.zeros(len(c), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):  # the hash of n characters goes on from that of n - 1
            h = h[: len(c) - n + 1]
            if not len(h):
                break
            h += c[n - 1 :]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if n in sizes:
                keep = line[: len(h)] == line[n - 1 :]
                if n < 3:
                    keep &= han[: len(h)] & han[n - 1 :]
                hashes.append(h[keep] + np.uint64(n))
                lines_of.append(line[: len(h)][keep])
    return (np.concatenate(hashes), np.concatenate(lines_of)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


def slot(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th slot of grams."""
    with np.errstate(over="ignore"):
        x = (h ^ np.uint64(0xD6E8FEB86659FD93 * (k + 1) & (2**64 - 1))) * np.uint64(0xFF51AFD7ED558CCD)
        return ((x ^ (x >> np.uint64(33))) & np.uint64(SLOTS - 1)).astype(np.int64)


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(text) if s and LETTER.search(s)]


def fit_filters(documents: DataFrame, languages: list[str], labels: dict[str, str], docs: int = TRAIN_DOCS) -> np.ndarray:
    """The filters' array (a mask a slot) from labelled documents (text, lang)."""
    labelled = documents.select("text", label_code(F.col("lang"), labels).alias("code")).where(f"code is not null and length(text) between 40 and {TRAIN_CHARS}")
    sizes = {r["code"]: r["n"] for r in labelled.groupBy("code").agg(F.count_distinct(F.xxhash64("text")).alias("n")).collect()}  # one row a language
    share = F.create_map(*[x for c in sizes for x in (F.lit(c), F.lit(min(1.0, docs / sizes[c])))]) if sizes else None
    if share is None:
        return np.zeros(SLOTS, dtype=mask_type(len(languages)))
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(draw < F.element_at(share, F.col("code"))).distinct()  # a copied text is one document

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for code, group in b.groupby("code"):
                each = [np.unique(grams(letters(plain(t.replace("\n", " "))))[0]) for t in group["text"]]
                h, n = np.unique(np.concatenate(each), return_counts=True)
                yield pd.DataFrame({"h": h.view(np.int64), "code": code, "n": n.astype(np.int64)})
                yield pd.DataFrame({"h": np.zeros(1, np.int64), "code": f"#{code}", "n": np.array([len(each)], np.int64)})

    seen = sample.mapInPandas(count, "h bigint, code string, n bigint").groupBy("h", "code").agg(F.sum("n").alias("n"))
    seen = seen.groupBy("h").agg(F.collect_list(F.struct("code", "n")).alias("langs"))
    kind = mask_type(len(languages))
    table = np.zeros(SLOTS, dtype=kind)
    rows = seen.where(F.exists("langs", lambda x: x.n >= LEAST_DOCS)).toPandas()  # bounded by the sample, not by the corpus
    totals = {r["code"][1:]: r["n"] for langs in rows.loc[rows["h"] == 0, "langs"] for r in langs if r["code"].startswith("#")}
    bit = {c: 1 << i for i, c in enumerate(languages)}
    h, masks = [], []
    for key, langs in zip(rows["h"], rows["langs"]):
        rates = {r["code"]: r["n"] / totals[r["code"]] for r in langs if r["n"] >= LEAST_DOCS and r["code"] in bit and totals.get(r["code"])}
        if rates:
            top = max(rates.values())
            h.append(key)
            masks.append(sum(bit[c] for c, v in rates.items() if v >= LEAST_SHARE * top))
    if h:
        keys, m = np.array(h, dtype=np.int64).view(np.uint64), np.array(masks, dtype=kind)
        for k in range(HASHES):
            np.bitwise_or.at(table, slot(keys, k), m)
    return table


def mask_type(n: int) -> type:
    """The smallest type that holds a bit for each of n languages."""
    return np.uint16 if n <= 16 else np.uint32 if n <= 32 else np.uint64


def false_positives(table: np.ndarray, n: int) -> np.ndarray:
    """Chance that a gram of no language passes for each language."""
    return np.array([((table >> table.dtype.type(i)) & table.dtype.type(1)).mean() ** HASHES for i in range(n)])


def scores(parts: list[str], table: np.ndarray, wrong: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hits of each sentence (row) in each language (column), corrected for false positives, letters of each sentence)."""
    text = "\n".join(parts)
    prepared = letters(plain(text))
    prepared = [a if len(a) > 4 else letters(p)[0] for a, p in zip(prepared, parts)]
    h, who = grams(prepared)
    total = np.bincount(who, minlength=len(parts))
    for k in range(HASHES):
        some = table[slot(h, k)]
        mask = some if k == 0 else mask & some
        known = mask != 0
        h, who, mask = h[known], who[known], mask[known]
    hits = _by_language(mask, who, len(parts), len(wrong))
    size = np.array([len(p) - p.count(" ") if p.isascii() else sum(4 if "一" <= c <= "鿿" else c != " " for c in p) for p in prepared])
    return np.maximum(0.0, (hits - total[:, None] * wrong) / (1 - wrong)), size


def _by_language(mask: np.ndarray, who: np.ndarray, n: int, languages: int) -> np.ndarray:
    """How many grams of each sentence have each language's bit."""
    one = mask.dtype.type(1)
    return np.stack([np.bincount(who[((mask >> mask.dtype.type(i)) & one).astype(bool)], minlength=n) for i in range(languages)], 1)


def best_path(score: np.ndarray, change: float = CHANGE) -> np.ndarray:
    """The language of every sentence: most hits in all, less the price of each change."""
    n, m = score.shape
    top = int(score.sum(0).argmax())
    if score.max(1).sum() - score[:, top].sum() <= change:  # no change can bring its price
        return np.full(n, top)
    total, back = score[0].copy(), np.zeros((n, m), dtype=np.int64)
    for i in range(1, n):
        top = int(total.argmax())
        jump = total[top] - change
        stay = total >= jump
        back[i] = np.where(stay, np.arange(m), top)
        total = np.where(stay, total, jump) + score[i]
    path = np.zeros(n, dtype=np.int64)
    path[-1] = int(total.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i][path[i]]
    return path


def segments(texts: list[str], table: np.ndarray, wrong: np.ndarray) -> list[list[tuple[int, float, int]]]:
    """(language, confidence, characters) of the stretches of one language in each text; none without words or without any hit."""
    split = [sentences(t) for t in texts]
    out: list[list[tuple[int, float, int]]] = [[] for _ in texts]
    parts = [p for s in split for p in s]
    if not parts:
        return out
    all_scores, sizes = scores(parts, table, wrong)
    at = 0
    for k, own in enumerate(split):
        score, size = all_scores[at : at + len(own)], sizes[at : at + len(own)]
        at += len(own)
        if not score.any():
            continue
        score = score * np.minimum(1.0, size / max(1, min(FULL_LETTERS, size.max())))[:, None] ** 2
        path = best_path(score)
        cuts = np.flatnonzero(path[1:] != path[:-1]) + 1
        for a, z in zip([0, *cuts], [*cuts, len(own)]):
            sums = score[a:z].sum(0)
            top = sums[path[a]]
            rest = np.delete(sums, path[a]).max(initial=0.0)
            out[k].append((int(path[a]), float(top / (top + rest)) if top + rest else 0.0, sum(map(len, own[a:z]))))
    return out


def identify(documents: DataFrame, languages: DataFrame, docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, seg_no, lang, confidence, n_chars, label): one row a segment in reading order, seg_no 0 for a document of one language.

    label is the code that the given label means, or null. Documents that are null, empty or without words, or hold nothing any
    language knows, have no row. doc_ids that repeat count once; other columns are ignored.
    """
    spark = documents.sparkSession
    names = sorted((r["lang_code"], r["lang_name"]) for r in languages.select("lang_code", "lang_name").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"a mask holds {MOST_LANGUAGES} languages at most")
    codes, labels = [c for c, _ in names], known_labels(names)
    table = fit_filters(documents, codes, labels, docs)
    shared, wrong = spark.sparkContext.broadcast(table), false_positives(table, len(codes))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ends = b["text"].str.len().cumsum()
            for _, part in b.groupby(ends // TOGETHER, sort=False):
                out = []
                for doc, label, found in zip(part["doc_id"], part["label"], segments(part["text"].tolist(), shared.value, wrong)):
                    out.extend((doc, 0 if len(found) == 1 else i, codes[k], conf, n, label) for i, (k, conf, n) in enumerate(found, 1))
                yield pd.DataFrame(out, columns=["doc_id", "seg_no", "lang", "confidence", "n_chars", "label"])

    source = documents.where("length(text) > 0 and doc_id is not null").select("doc_id", "text", label_code(F.col("lang"), labels).alias("label"))
    return spread(source).mapInPandas(read, "doc_id bigint, seg_no int, lang string, confidence double, n_chars bigint, label string").dropDuplicates(["doc_id", "seg_no"])


def relabelled(documents: DataFrame, languages: DataFrame) -> DataFrame:
    """(doc_id, seg_no, lang) of documents whose label is missing, meaningless or wrong, and of all segments of mixed ones."""
    return identify(documents, languages).where("seg_no > 0 or label is null or label <> lang").select("doc_id", "seg_no", "lang")

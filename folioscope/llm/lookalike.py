"""One form for texts that look alike: vocabulary tries walked by a weighted edit automaton.

Characters fall into classes of equal look (full-width and other compatibility forms, ligatures, look-alike letters of other
scripts, kinds of blank and hyphen, base letter plus accent); characters that can't be seen are ignorable. The automaton
replaces a character by one of its class and skips an ignorable at no cost, any other edit costs one. The vocabulary holds the
consistent spellings (one script, nothing ignorable, nothing in compatibility form) of the whole corpus; an odd word takes the
most frequent spelling that it reaches at no cost, else every character is replaced by table. Texts are compared by their
canonical words; a quote that begins or ends inside a word is walked into the text's word from its other end.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.link import whole
from folioscope.session import written

#: Look-alike letters of other scripts (fixed values): Latin letters and the Cyrillic and Greek ones that look the same.
LOOKALIKES = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜϺ", "N": "Ν",
    "O": "ОΟ", "P": "РΡ", "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оο", "p": "рρ", "q": "ԛ", "s": "ѕ", "v": "ѵν", "w": "ԝ", "x": "х", "y": "уү",
    "-": "‐‑﹣", "'": "ʼ", "μ": "µ",
}
TAGS = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>")
#: What a text must hold to be worth a look; anything else is in its one form already. Kept broad on purpose.
ODD = r"[^\x00-\x7FÀ-ÿĀ-ıĴ-ľŁ-ňŊ-ž一-鿿]"
#: Words, with marks and what can't be seen inside them, and what stands between.
WORD, PIECE = r"([\p{L}\p{M}\p{N}\p{Cf}]+)", r"([\p{L}\p{M}\p{N}\p{Cf}]+|[^\p{L}\p{M}\p{N}\p{Cf}]+)"


def _ignorable(ch: str) -> bool:
    o = ord(ch)
    return unicodedata.category(ch) == "Cf" or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF


@lru_cache(maxsize=1)
def fold_table() -> dict[int, str]:
    """Code point to the sign of its class; ignorables to nothing."""
    table: dict[int, str] = {}
    for o in [*range(0x80, 0x3400), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]:
        if 0xD800 <= o <= 0xDFFF:
            continue
        ch = chr(o)
        if _ignorable(ch):
            table[o] = ""
        elif unicodedata.category(ch) == "Zs":
            table[o] = " "
        elif unicodedata.decomposition(ch).startswith(TAGS):
            table[o] = unicodedata.normalize("NFKC", ch)
    for sign, others in LOOKALIKES.items():
        for ch in others:
            table[ord(ch)] = sign
    for o, sign in list(table.items()):
        table[o] = "".join(table.get(ord(c), c) for c in sign)
    return table


def fold(text: str) -> str:
    """The text with every character replaced by the sign of its class; a letter and its accent are one character."""
    if text.isascii():
        return text
    out = unicodedata.normalize("NFC", text).translate(fold_table())
    return unicodedata.normalize("NFC", out)


@lru_cache(maxsize=1)
def classes() -> dict[str, tuple[str, ...]]:
    """Sign to the characters of its class, itself first."""
    out: dict[str, list[str]] = {}
    for o, sign in fold_table().items():
        if len(sign) == 1:
            out.setdefault(sign, [sign]).append(chr(o))
    return {k: tuple(v) for k, v in out.items()}


def _script(ch: str) -> str:
    o = ord(ch)
    if o < 0x250:
        return "Latin"
    if 0x370 <= o < 0x400:
        return "Greek"
    if 0x400 <= o < 0x530:
        return "Cyrillic"
    return "Han" if o >= 0x2E80 else "other"


def consistent(token: str) -> bool:
    """Whether a token may be a canonical spelling."""
    if token.isascii():
        return True
    if unicodedata.normalize("NFC", token) != token:
        return False
    table, scripts, sure, han = fold_table(), set(), False, any("一" <= c <= "鿿" for c in token)
    for ch in token:
        sign = table.get(ord(ch))
        if ch.isalpha():
            scripts.add(_script(ch))
            sure = sure or sign is None
        if sign is not None and (not ch.isalpha() and not (han and unicodedata.category(ch)[0] == "P") or ch.isalpha() and ord(ch) >= 0x2000 and not "぀" <= ch <= "ヿ"):
            return False
    return sure and len(scripts - {"Han"}) <= 1


class Trie:
    """Spellings as a trie: a sorted list, a node being the range that shares a prefix."""

    def __init__(self, words: list[tuple[str, int]]):
        self.words = sorted(words)
        self.keys = [w for w, _ in self.words]

    def step(self, node: tuple[int, int, int], text: str) -> tuple[int, int, int] | None:
        lo, hi, depth = node
        prefix = self.keys[lo][:depth] + text
        lo2 = bisect_left(self.keys, prefix, lo, hi)
        hi2 = bisect_left(self.keys, prefix + "\U0010ffff", lo2, hi)
        return (lo2, hi2, depth + len(text)) if lo2 < hi2 else None

    def edges(self, node: tuple[int, int, int]) -> list[tuple[int, int, int]]:
        lo, hi, depth = node
        out, at = [], lo
        while at < hi:
            key = self.keys[at]
            if len(key) <= depth:
                at += 1
                continue
            nxt = self.step(node, key[depth])
            out.append(nxt)
            at = nxt[1]
        return out

    def walk(self, token: str, budget: int = 0, backwards: bool = False) -> dict[tuple[int, int, int], int]:
        """Nodes at which the automaton may stand after reading the token, with the least cost; backwards for tries of reversed words."""
        table, members = fold_table(), classes()
        token = unicodedata.normalize("NFC", token)
        token = token[::-1] if backwards else token
        states: dict[tuple[int, int, int], int] = {(0, len(self.keys), 0): 0} if self.keys else {}
        for ch in token:
            sign = table.get(ord(ch), ch)
            sign = sign[::-1] if backwards else sign
            new: dict[tuple[int, int, int], int] = {}

            def add(node, cost, new=new):
                if node and cost <= budget and cost < new.get(node, budget + 1):
                    new[node] = cost

            for node, cost in states.items():
                if not sign:
                    add(node, cost)
                    continue
                for option in members.get(sign, (sign,)) if len(sign) == 1 else (sign, ch):
                    add(self.step(node, option), cost)
                if cost < budget:
                    add(node, cost + 1)
                    for nxt in self.edges(node):
                        add(nxt, cost + 1)
            states = new
            if budget:
                for node, cost in list(states.items()):
                    if cost < budget:
                        for nxt in self.edges(node):
                            add(nxt, cost + 1)
        return states

    def reach(self, token: str, budget: int = 0) -> list[tuple[int, str, int]]:
        """(cost, spelling, count) of all spellings within the budget of the token."""
        found = [(cost, *self.words[lo]) for (lo, hi, depth), cost in self.walk(token, budget).items() if lo < hi and len(self.keys[lo]) == depth]
        return sorted(found, key=lambda x: (x[0], -x[2], x[1]))


def canonical(token: str, trie: Trie) -> str:
    """The most frequent spelling at no cost, else the token by table."""
    found = trie.reach(token)
    return found[0][1] if found else fold(token)


def begins(word: str, token: str) -> bool:
    """Whether the automaton, reading token, comes to a place inside or at the end of the word at no cost."""
    return word.startswith(token) or bool(word and Trie([(word, 1)]).walk(token))


def ends(word: str, token: str) -> bool:
    """The same from the word's end."""
    return word.endswith(token) or bool(word and Trie([(word[::-1], 1)]).walk(token, backwards=True))


def holds(text: str, quote: str) -> bool:
    """Whether a canonical text holds a canonical quote: equal words inside, the quote's first and last word walked into the text's."""
    if not quote:
        return False
    if quote in text:
        return True
    t, q = text.split(" "), quote.split(" ")
    if len(q) == 1:
        return any(begins(w[k:], quote) for w in t for k in range(len(w)))
    inner, last = q[1:-1], len(q) - 1
    return any(t[k + 1 : k + last] == inner and ends(t[k], q[0]) and begins(t[k + last], q[-1]) for k in range(len(t) - last))


def spellings(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, spelling, known) for every odd piece of texts (column text); spellings come from the words of all of vocabulary (column text), known tells whether one was reached.

    A word meets only the part of the vocabulary (a shard) that is as long after folding and begins alike in eight characters, since
    only that can be reached at no cost. Shards are sorted streams: a task holds the trie of one shard at a time.
    """

    @F.pandas_udf("struct<shard: string, good: boolean>")
    def described(tokens: pd.Series) -> pd.DataFrame:
        folded = [fold(t) for t in tokens]
        return pd.DataFrame({"shard": [f"{len(f)}:{f[:8]}" for f in folded], "good": [consistent(t) for t in tokens]})

    odd = texts.where(F.col("text").rlike(ODD)).select(F.explode(F.regexp_extract_all("text", F.lit(PIECE), 1)).alias("token")).where(F.col("token").rlike(ODD)).distinct()
    odd = written(odd.select("token", described("token").alias("d")).select("token", F.col("d.shard").alias("shard")), "odd-tokens")
    words = vocabulary.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), 1)).alias("token")).groupBy("token").count()
    ascii_word = F.octet_length("token") == F.length("token")
    easy = words.where(ascii_word).withColumn("shard", F.concat_ws(":", F.length("token"), F.substring("token", 1, 8)))
    hard = words.where(~ascii_word).select("token", "count", described("token").alias("d")).where("d.good").select("token", "count", F.col("d.shard").alias("shard"))
    words = easy.unionByName(hard).join(odd.select("shard").distinct(), "shard", "left_semi")
    both = words.select("shard", F.lit(0).alias("role"), "token", "count").unionByName(odd.select("shard", F.lit(1).alias("role"), "token", F.lit(0).cast("bigint").alias("count")))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole(batches, "shard"):
            out = []
            for _, shard in b.groupby("shard", sort=False):
                listed = shard["role"] == 0
                trie = Trie(list(zip(shard.loc[listed, "token"], shard.loc[listed, "count"])))
                for token in shard.loc[~listed, "token"]:
                    found = trie.reach(token)
                    out.append((token, found[0][1] if found else fold(token), bool(found)))
            yield pd.DataFrame(out, columns=["token", "spelling", "known"])

    return both.repartition("shard").sortWithinPartitions("shard").mapInPandas(match, "token string, spelling string, known boolean")


def respelt(rows: DataFrame, keys: list[str], columns: list[str], vocabulary: DataFrame) -> DataFrame:
    """rows with `canonical_<column>` beside each text column: odd pieces in their spelling, all else as it stands. keys name a row."""
    pieces = lambda c: F.regexp_extract_all(c, F.lit(PIECE), 1)
    spelt = written(spellings(rows.select(F.explode(F.array(*columns)).alias("text")), vocabulary), "spellings")
    odd = F.filter(F.array_distinct(F.concat(*[F.coalesce(pieces(c), F.array().cast("array<string>")) for c in columns])), lambda x: x.rlike(ODD))
    maps = rows.select(*keys, F.explode(odd).alias("token")).join(spelt, "token").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("token", "spelling"))).alias("_m"))
    joined = rows.join(maps, keys, "left")
    text = lambda c: F.when(F.col("_m").isNull(), F.col(c)).otherwise(F.array_join(F.transform(pieces(c), lambda x: F.coalesce(F.try_element_at("_m", x), x)), ""))
    return joined.select(*rows.columns, *[text(c).alias(f"canonical_{c}") for c in columns])


def canonical_texts(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, text, canonical, form) of texts (id, text).

    canonical has odd words in their canonical spelling; form is canonical with every character as the sign of its class, equal
    for texts that look alike. Null stays null; ids should be unique; other columns are ignored.
    """
    t = respelt(texts.select("id", "text"), ["id"], ["text"], vocabulary).withColumnRenamed("canonical_text", "canonical")

    @F.pandas_udf("string")
    def folded(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else fold(v))

    return t.withColumn("form", F.when(F.col("canonical").rlike(ODD), folded("canonical")).otherwise(F.col("canonical")))


def hidden_quotes(findings: DataFrame, blocks: DataFrame) -> DataFrame:
    """(finding_id, block_id): the quote is no substring of its own block as stored, but its canonical words are those of a stretch of the block's.

    Null and empty quotes, null texts, unknown blocks and quotes of which nothing is left make no row; repeated rows count once.
    """
    f = findings.where(F.length("verbatim_quote") > 0).select(F.col("id").alias("finding_id"), "doc_id", F.col("verbatim_quote").alias("quote"), F.explode("block_ids").alias("block_id")).distinct()
    b = blocks.select("doc_id", "block_id", "text").where("text is not null").dropDuplicates(["doc_id", "block_id"])
    pairs = f.join(b, ["doc_id", "block_id"]).where(~F.contains("text", "quote") & (F.col("text").rlike(ODD) | F.col("quote").rlike(ODD)))
    pairs = written(pairs.dropDuplicates(["finding_id", "block_id"]), "pairs")
    said = blocks.select("text").unionByName(findings.select(F.col("verbatim_quote").alias("text")))
    c = respelt(pairs, ["finding_id", "block_id"], ["quote", "text"], said)
    inner = F.regexp_extract("canonical_quote", "(?s)( .* )", 1)
    c = c.where(F.contains("canonical_text", inner))

    @F.pandas_udf("boolean")
    def inside(texts: pd.Series, quotes: pd.Series) -> pd.Series:
        return pd.Series([holds(t, q) for t, q in zip(texts, quotes)], dtype="bool")

    return c.where(inside("canonical_text", "canonical_quote")).select("finding_id", "block_id")

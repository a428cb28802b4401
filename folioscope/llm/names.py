"""Variant spellings of people's and groups' names: merge-and-rematch resolution.

Every spelling starts as a profile (family names, given names, initials). Profiles that share a blocking key (family name with
up to one letter left out, and first initial) are compared; each one that finds a single best compatible richer profile is
merged into it. A merged profile holds the spellings and initials of all its members, so it enters blocking again under more
keys; this goes on until a round merges nothing. Only profiles that the last round changed are keyed, joined and compared anew,
each against all; the others keep their candidates.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType
from pyspark.sql.window import Window as W

from folioscope.session import discard, written

#: Short forms of given names (fixed values).
NICKNAMES = {
    "alexander": "alex al sasha sandy xander", "andrew": "andy drew", "anthony": "tony", "barbara": "barb barbie babs", "benjamin": "ben benny", "charles": "charlie chuck", "christopher": "chris kit topher",
    "daniel": "dan danny", "david": "dave davey", "deborah": "deb debbie debby", "dorothy": "dot dottie", "edward": "ed eddie ned ted ward", "elizabeth": "liz beth betty eliza lizzie betsy libby", "frederick": "fred freddy freddie rick",
    "gregory": "greg", "henry": "hank harry", "jacqueline": "jackie", "james": "jim jimmy jamie", "jennifer": "jen jenny", "john": "jack johnny", "jonathan": "jon jonny nathan", "joseph": "joe joey", "joshua": "josh",
    "katherine": "kate kathy katie kit kay kat", "kenneth": "ken kenny", "lawrence": "larry laurie", "margaret": "maggie peggy meg peg greta marge", "matthew": "matt matty", "michael": "mike mick micky", "nicholas": "nick nicky",
    "patricia": "pat patty trish tricia patsy", "peter": "pete", "philip": "phil", "raymond": "ray", "rebecca": "becky becca", "richard": "rick dick rich ricky richie", "robert": "bob rob bobby robbie bert", "ronald": "ron ronnie",
    "samuel": "sam sammy", "stephen": "steve stevie", "susan": "sue susie suzy", "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim", "abigail": "abby abbie gail", "victoria": "vicky vicki tori", "william": "will bill billy liam willy",
}
ROOTS: dict[str, set[str]] = {}
for _full, _short in NICKNAMES.items():
    for _s in _short.split():
        ROOTS.setdefault(_s, set()).add(_full)
PARTICLES = {"van", "von", "der", "den", "de", "di", "da", "du", "la", "le", "del", "della", "dos", "el", "al", "bin", "ter", "ten", "zu", "af"}
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "sir", "phd", "md", "jr", "sr"}
NO_NAME = {"", "et al", "et alii", "and others", "others", "anonymous", "anon", "unknown", "n a", "na", "none", "null", "various", "various authors", "等"}
GROUP_WORDS = {
    "inst": "institute", "institut": "institute", "netw": "network", "net": "network", "consort": "consortium", "cons": "consortium", "collab": "collaboration", "coll": "collaboration", "grp": "group", "ctr": "centre", "center": "centre",
    "assoc": "association", "soc": "society", "comm": "committee", "univ": "university", "dept": "department",
}
GROUP_NOUNS = {"institute", "network", "consortium", "collaboration", "group", "wg", "centre", "association", "society", "committee", "university", "department", "team", "alliance", "initiative", "council", "agency", "project", "investigators", "foundation"}
PARSED = "kind string, family string, given string, middle string, particle string, unsure boolean"


def plain(text: str) -> str:
    """Lower case, no accents, compatibility forms resolved, nothing invisible."""
    t = unicodedata.normalize("NFKD", text)
    return "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").lower()


def _group(text: str) -> str | None:
    """A group's name in the order name, field, type, or None if it is none."""
    t = re.sub(r"\(.*?\)|,?\s*(?:on|for and on|in) behalf of.*$", " ", plain(text))
    words = [GROUP_WORDS.get(w, w) for w in re.findall(r"\w+", t)]
    words = [x for w in words for x in (["working", "group"] if w == "wg" else [w])]
    if words[:1] == ["the"]:
        words = words[1:]
    if not GROUP_NOUNS & set(words) or len(words) < 2:
        return None
    for link in ("for", "on", "of"):
        if link in words[1:-1]:
            at = words.index(link)
            head, tail = words[:at], words[at + 1 :]
            return " ".join(tail[::-1] + head) if len(tail) <= 2 else " ".join(tail + head)
    return " ".join(words)


def parse(name: str | None) -> tuple[str, str, str, str, str, bool]:
    """(kind, family, given, middle, particle, unsure) of a spelling; given is a name, an initial or nothing; unsure: two words in either order."""
    none = ("none", "", "", "", "", False)
    if not name or plain(name).strip(" .,;:-&") in NO_NAME or plain(name).strip().startswith("et al"):
        return none
    if any("一" <= c <= "鿿" for c in name):
        return ("cjk", re.sub(r"[\s·,，.]+", "", unicodedata.normalize("NFKC", name)), "", "", "", False)
    group = _group(name)
    if group:
        return ("group", group, "", "", "", False)
    text = unicodedata.normalize("NFKC", name)
    head, comma, tail = text.partition(",")

    def words(part: str) -> list[str]:
        out = []
        for w in re.findall(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*\.?", part):
            p = plain(w).rstrip(".")
            if not p or p in TITLES and not (out and w.isupper() and len(p) == 2):
                continue
            if p in PARTICLES and not (len(p) == 2 and w.rstrip(".").isupper() and not part.isupper()):
                out.append(("p", p))
            elif len(p) == 1:
                out.append(("i", p))
            elif w.rstrip(".").isupper() and len(p) <= 3 and not part.replace(".", "").replace(",", "").strip().isupper():
                out.extend(("i", c) for c in p)
            else:
                out.append(("w", p))
        return out

    if comma:
        left, right = words(head), words(tail)
        fam = [v for k, v in left if k == "w"]
        rest = [(k, v) for k, v in right if k != "p"]
        particle = " ".join(v for k, v in left + right if k == "p")
        if not fam:
            return none
        given = rest[0][1] if rest else ""
        return ("person", " ".join(fam), given, rest[1][1][0] if len(rest) > 1 else "", particle, False)
    seq = words(text)
    particle = " ".join(v for k, v in seq if k == "p")
    core = [(k, v) for k, v in seq if k != "p"]
    full = [v for k, v in core if k == "w"]
    if not full:
        return none
    if len(core) == 1:
        return ("person", full[0], "", "", particle, False)
    if core[0][0] == "i" or seq[0][0] == "w" and particle and core[-1][0] == "w":  # J. K. Family, Given van Family
        middle = core[1][1][0] if len(core) > 2 else ""
        return ("person", core[-1][1], core[0][1], middle, particle, False)
    if core[-1][0] == "i" and len(full) >= 1 and core[0][0] == "w" and all(k == "i" for k, _ in core[1:]):  # Family JK
        return ("person", core[0][1], core[1][1], core[2][1] if len(core) > 2 else "", particle, False)
    if seq[0][0] == "p":  # van Family Given
        return ("person", core[0][1], core[1][1], core[2][1][0] if len(core) > 2 else "", particle, False)
    middle = core[1][1][0] if len(core) > 2 else ""
    return ("person", core[-1][1], core[0][1], middle, particle, len(core) == 2)


@lru_cache(maxsize=1 << 16)
def near(a: str, b: str) -> int:
    """0 equal, 1 one edit (insertion, deletion, replacement or swap of neighbours), 2 more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return 2
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]:
        return 1
    return 1 if a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :] else 2


@lru_cache(maxsize=1 << 14)
def roots(given: str) -> set[str]:
    return ROOTS.get(given, set()) | {given}


@lru_cache(maxsize=1 << 14)
def initials(given: str) -> set[str]:
    """First letters a given name may be cut to, those of its short forms included (D. for Dick for Richard)."""
    return {given[:1]} | {x[0] for r in roots(given) for x in (r, *NICKNAMES.get(r, "").split())}


def _givens(a: str, b: str) -> int | None:
    """Edits between two given names: 0 same or short form, 1 a typo or initial against name counts as 0 with less weight; None incompatible."""
    if not a or not b:
        return None
    if len(a) == 1 or len(b) == 1:
        return 0 if initials(a) & initials(b) else None
    if roots(a) & roots(b):
        return 0
    if len(a) >= 3 and len(b) >= 3 and near(a, b) == 1:
        return 1
    return 1 if any(len(x) >= 4 and len(y) >= 4 and near(x, y) == 1 for x in roots(a) for y in roots(b)) else None


def compare(kind: str, fams_a, givens_a, mids_a, fams_b, givens_b, mids_b) -> int:
    """How well two profiles fit, 0 not at all; higher is better."""
    fam = min((near(x, y) for x in fams_a for y in fams_b), default=2)
    if fam == 1 and min(len(x) for x in (*fams_a, *fams_b)) < 4:
        return 0
    if fam == 2:
        return 0
    if kind != "person":
        return 100 - 50 * fam if kind == "group" or not fam else 0
    full_a, full_b = [g for g in givens_a if len(g) > 1], [g for g in givens_b if len(g) > 1]
    pairs = [(x, y) for x in (full_a or givens_a) for y in (full_b or givens_b)]
    fits = [g for g in (_givens(x, y) for x, y in pairs) if g is not None]
    if not fits or full_a and full_b and len(fits) < len(pairs) and min(fits) > 0:
        return 0
    given = min(fits)
    if fam + given > 1:
        return 0
    if mids_a and mids_b and not set(mids_a) & set(mids_b):
        return 0
    both = bool(full_a and full_b)
    direct = bool({x[0] for g in givens_a for x in roots(g)} & {x[0] for g in givens_b for x in roots(g)})
    return 1 + 40 * (1 - fam) + 20 * both * (1 - given) + 10 * bool(set(mids_a) & set(mids_b)) + 5 * (not mids_a and not mids_b) + 18 * direct


def _keys(kind: str, fams, givens) -> list[str]:
    heads = {i for g in givens for i in initials(g)} if kind == "person" else {kind}
    out = set()
    for f in fams:
        cut = {f} | ({f[:i] + f[i + 1 :] for i in range(len(f))} if kind != "cjk" and len(f) >= 4 else set())
        out |= {f"{h}|{c}" for h in heads for c in cut}
    return sorted(out)


def parsed_names(names: DataFrame) -> DataFrame:
    """(name, parsed fields) of distinct names; two words in unsure order are read as the corpus more often uses them as given and family names."""

    @F.pandas_udf(PARSED.join(("struct<", ">")).replace(" string", ":string").replace(" boolean", ":boolean"))
    def read(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(x) for x in s], columns=["kind", "family", "given", "middle", "particle", "unsure"])

    p = names.select("name", read("name").alias("p")).select("name", "p.*").where("kind <> 'none'")
    person = p.where("kind = 'person' and length(given) > 0").withColumn("weight", F.when(F.col("unsure"), 0.2).otherwise(1.0))
    given = person.where("length(given) > 1").groupBy(F.col("given").alias("word")).agg(F.sum("weight").alias("as_given"))
    family = person.groupBy(F.col("family").alias("word")).agg(F.sum("weight").alias("as_family"))
    use = written(given.join(family, "word", "full"), "words").fillna(0.0, ["as_given", "as_family"])
    p = p.join(use.select(F.col("word").alias("given"), F.col("as_given").alias("gg"), F.col("as_family").alias("gf")), "given", "left")
    p = p.join(use.select(F.col("word").alias("family"), F.col("as_given").alias("fg"), F.col("as_family").alias("ff")), "family", "left")
    swap = F.col("unsure") & (F.coalesce("fg", F.lit(0.0)) + F.coalesce("gf", F.lit(0.0)) > F.coalesce("gg", F.lit(0.0)) + F.coalesce("ff", F.lit(0.0)) - 0.399)  # less its own two uses
    return p.select("name", "kind", F.when(swap, F.col("given")).otherwise(F.col("family")).alias("family"), F.when(swap, F.col("family")).otherwise(F.col("given")).alias("given"), "middle")


def _listed(text: str) -> list[str]:
    return text.split("|") if text else []


@F.pandas_udf(ArrayType(StringType()))
def keys_of(kind: pd.Series, fams: pd.Series, givens: pd.Series) -> pd.Series:
    return pd.Series([_keys(k, _listed(f), _listed(g)) for k, f, g in zip(kind, fams, givens)], dtype=object)


@F.pandas_udf(IntegerType())
def fit_of(kind: pd.Series, fa: pd.Series, ga: pd.Series, ma: pd.Series, fb: pd.Series, gb: pd.Series, mb: pd.Series) -> pd.Series:
    return pd.Series([compare(k, *map(_listed, t)) for k, *t in zip(kind, fa, ga, ma, fb, gb, mb)], dtype="int32")


def _profiles(label: DataFrame, members: DataFrame) -> DataFrame:
    """(pid, kind, fams, givens, mids, rank): the union of all spellings of a profile; richer profiles rank higher."""
    told = lambda c: F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))), "|")
    p = label.join(members.drop("pid"), "name").groupBy("pid").agg(F.first("kind").alias("kind"), told("family").alias("fams"), told("given").alias("givens"), told("middle").alias("mids"), F.sum("n").alias("n"))
    full = F.exists(F.split("givens", "[|]"), lambda g: F.length(g) > 1).cast("int")
    return p.select("pid", "kind", "fams", "givens", "mids", F.struct(full.alias("full"), (F.col("mids") != "").cast("int").alias("mid"), "n", "pid").alias("rank"))


def _keyed(profiles: DataFrame) -> DataFrame:
    return profiles.select("pid", "rank", F.explode(keys_of("kind", "fams", "givens")).alias("key"))


def _scored(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(pid, to, rank_b, score) of pairs (pid, to) that fit."""
    right = profiles.select(F.col("pid").alias("to"), F.col("kind").alias("kind_b"), F.col("fams").alias("fb"), F.col("givens").alias("gb"), F.col("mids").alias("mb"), F.col("rank").alias("rank_b"))
    p = pairs.join(profiles, "pid").join(right, "to").where("kind = kind_b")
    return p.select("pid", "to", "rank_b", fit_of("kind", "fams", "givens", "mids", "fb", "gb", "mb").alias("score")).where("score > 0")


def resolve_names(records: DataFrame) -> DataFrame:
    """(name, entity) for every spelling in authors (columns authors, title) that names someone.

    Null arrays, null, blank and wordless elements, and stand-ins such as "et al." are no names. Spellings that differ only in
    case, accents, blanks or word order share a profile from the start. A spelling that fits several profiles equally well goes to
    the one it shares more works with (equal titles), or to none. Rounds end when nothing merges; each one leaves fewer profiles.
    """
    listed = records.select(F.explode("authors").alias("name"), F.lower(F.regexp_replace("title", r"[^\p{L}\p{N}]+", "")).alias("work")).where("name is not null")
    uses = written(listed.groupBy("name").agg(F.count("*").alias("n")), "names")
    parsed = parsed_names(uses.select("name"))
    first = parsed.withColumn("pid", F.sha1(F.concat_ws("|", "kind", "family", "given", "middle")))
    members = written(first.select("name", "pid", "kind", "family", "given", "middle").join(uses, "name"), "members")
    works = written(listed.where("work <> ''").distinct(), "works")
    label = members.select("name", "pid")

    profiles = written(_profiles(label, members), "profiles")
    keyed = written(_keyed(profiles), "keys")
    other = keyed.select("key", F.col("pid").alias("to"), F.col("rank").alias("rank_b"))
    pairs = keyed.join(other, "key").where(F.col("rank") < F.col("rank_b")).select("pid", "to").distinct()
    scored = written(_scored(pairs, profiles), "candidates")
    while True:
        best = scored.withColumn("top", F.max("score").over(W.partitionBy("pid"))).where("score = top").withColumn("ties", F.count("*").over(W.partitionBy("pid")))
        best = written(best, "best")
        tied = best.where("ties > 1").select("pid", "to")
        own = label.join(works, "name").select("pid", "work").distinct()
        common = tied.join(own, "pid").join(own.withColumnRenamed("pid", "to"), ["to", "work"]).groupBy("pid", "to").agg(F.count("*").alias("common"))
        order = W.partitionBy("pid").orderBy(F.desc("common"), "to")
        ranked = tied.join(common, ["pid", "to"], "left").fillna(0, ["common"]).withColumn("k", F.row_number().over(order)).withColumn("second", F.lead("common", 1, -1).over(order))
        chosen = ranked.where("k = 1 and common > second and common > 0").select("pid", "to")
        parent = written(best.where("ties = 1").select("pid", "to").unionByName(chosen), "parents")
        discard(best)
        if parent.isEmpty():
            break
        while True:  # every profile to the root of its tree: ranks rise along parents, so there is no cycle
            up = parent.select(F.col("pid").alias("to"), F.col("to").alias("next"))
            jumped = written(parent.join(up, "to", "left").select("pid", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "parents")
            parent = jumped.select("pid", "to")
            if jumped.where("moved").isEmpty():
                break
        label = written(label.join(parent, "pid", "left").select("name", F.coalesce("to", "pid").alias("pid")), "labels")
        # what merged is gone, what it merged into is compared anew with everything
        grown = parent.select(F.col("to").alias("pid")).distinct()
        touched = written(grown.unionByName(parent.select("pid")), "touched")
        news = written(_profiles(label.join(grown, "pid", "left_semi"), members), "profiles")
        all_profiles = written(profiles.join(touched, "pid", "left_anti").unionByName(news), "profiles")
        new_keys = written(_keyed(news), "keys")
        all_keys = written(keyed.join(touched, "pid", "left_anti").unionByName(new_keys), "keys")
        other = all_keys.select("key", F.col("pid").alias("to"), F.col("rank").alias("rank_b"))
        met = new_keys.join(other, "key").where("pid <> to")
        rising = F.col("rank") < F.col("rank_b")
        pairs = met.select(F.when(rising, F.col("pid")).otherwise(F.col("to")).alias("pid"), F.when(rising, F.col("to")).otherwise(F.col("pid")).alias("to")).distinct()
        kept = scored.join(touched, "pid", "left_anti").join(touched.withColumnRenamed("pid", "to"), "to", "left_anti").select("pid", "to", "rank_b", "score")
        all_scored = written(kept.unionByName(_scored(pairs, all_profiles)), "candidates")
        discard(profiles, keyed, scored, news, new_keys, touched)
        profiles, keyed, scored = all_profiles, all_keys, all_scored
    return label.withColumnRenamed("pid", "entity")


def same_names(records: DataFrame) -> DataFrame:
    """(name_a, name_b): every pair of different spellings of one entity, the smaller by code point first."""
    r = resolve_names(records)
    return r.join(r.withColumnRenamed("name", "name_b"), "entity").where(F.col("name") < F.col("name_b")).select(F.col("name").alias("name_a"), "name_b")

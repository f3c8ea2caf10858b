"""Variant spellings of names typed by people (problem 1).

Distinct spellings are parsed to a form: a family name, a given name or its initial, and a middle initial; of an institute the
place and its topic words, of other organisations (ORGANISATIONS, COMPANY_FORMS) their distinguishing words and kinds. Forms are blocked by phonetic codes of their sorted parts (the family name's code and
those with one digit left out, each with the code of the given name), compared with Jaro-Winkler and a nickname table, and accepted pairs are clustered by
connected components. Slips in given names need evidence of the whole table (SHARED_FAMILIES). Forms that have but an initial are then
attached where exactly one cluster fits, so that they bridge no two persons; those that fit no full form are compared with each other.
Keys that many forms share are split (see meet).

Nulls, blanks and placeholders name nobody. Repeated rows count once, since spellings are made distinct first. Texts of any
length are parsed whole. A name of a single word is linked to equal forms only. An empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, meet, parallelism, table
from .components import connected_components

#: Placeholders that name nobody.
PLACEHOLDERS = {"", "unknown", "n a", "na", "anonymous", "anon", "none", "null", "nil", "various", "various authors", "et al", "tba", "tbd", "misc", "staff", "author", "authors", "no author", "no authors", "not given", "none given", "author unknown", "unknown author", "unnamed", "editor", "editors", "editorial", "not available", "see publisher page"}
#: Nicknames of given names.
NICKNAMES = {
    "abigail": "abby abbie gail", "alexander": "alex sandy sasha lex alec", "anthony": "tony ant", "benjamin": "ben benny benji", "charles": "charlie chuck chas", "christopher": "chris kit", "daniel": "dan danny",
    "dolores": "lola lolita", "dorothea": "dora thea dot dottie", "edward": "ed eddie ned ted teddy", "eleanor": "ellie nell nellie", "elizabeth": "eliza liz beth betty lizzie libby bess", "francisco": "paco pancho kiko", "frederick": "fred fritz freddie freddy",
    "gabriela": "gabi gaby", "genevieve": "gen genny viv", "ignacio": "nacho", "james": "jim jimmy jamie", "johannes": "hans", "john": "jack johnny jon", "josephine": "jo josie jojo", "katherine": "kate kathy katie kat kay", "leonard": "leo len lenny",
    "margaret": "maggie peggy meg marge daisy", "matthias": "matt mats", "michael": "mike mick mickey", "nathaniel": "nate nat nathan", "octavia": "tavi", "oleksandra": "olesya sasha lesya", "patricia": "pat trish patty tricia", "quentin": "quin quint",
    "rafael": "rafa rafi", "rebecca": "becky becca", "richard": "rick dick rich ricky", "robert": "bob bobby rob robbie bert", "samuel": "sam sammy", "susanna": "sue susie sanna", "theodore": "theo ted teddy", "thomas": "tom tommy", "ulrich": "uli", "victoria": "vicky vic tori",
    "wilhelmina": "willa mina minnie billie", "william": "bill will billy willy liam", "yevgeny": "zhenya", "zachary": "zach zack zak",
}
#: Least Jaro-Winkler similarity of family and given names, and edits beyond which neither matches.
FAMILY_SIMILARITY, GIVEN_SIMILARITY, EDITS = 0.84, 0.8, 2
#: Two given names that are alike count as one name typed in two ways if the rarer one's families have the other one too in at least this share: a slip goes
#: with the family of the person meant, while two names of their own meet in a family by chance only. A share, so it doesn't turn with the table's size.
SHARED_FAMILIES = 0.5
#: Words that mark an organisation, each with its short forms; forms of companies, which don't tell organisations apart.
ORGANISATIONS = {
    "university": "univ", "college": "coll", "laboratory": "lab labs laboratories", "centre": "center ctr", "academy": "acad", "society": "soc", "association": "assoc", "department": "dept", "faculty": "fac",
    "school": "sch", "ministry": "min", "agency": "", "foundation": "found fdn", "hospital": "hosp", "council": "", "committee": "comm", "consortium": "", "library": "libr", "museum": "mus", "observatory": "", "bureau": "", "corporation": "corp", "company": "co", "group": "grp",
}
COMPANY_FORMS = {"gmbh", "inc", "ltd", "llc", "plc", "limited", "incorporated"}  # those of two letters look like initials

_FORMAL: dict[str, set[str]] = {}
for _full, _nicks in NICKNAMES.items():
    for _nick in _nicks.split():
        _FORMAL.setdefault(_nick, set()).add(_full)
_TITLES = re.compile(r"^\s*((dr|prof|professor|mr|mrs|ms)\b\.?\s*)+(?=\w{3}|\w\b|\w\.)|\b(phd|ph\. ?d|msc|et al|professor)\b\.?")
_MARKS = {short: full for full, shorts in ORGANISATIONS.items() for short in (full, *shorts.split())}
#: Short marks that are also names or initials of persons count only with a full stop or beside another mark.
_DOUBTFUL = {"min", "co", "comm", "found", "lab", "mus", "sch", "fac", "soc", "group", "grp", "acad", "coll"}
_CODES = {c: k for k, group in enumerate(["bp", "fvw", "ckqgx", "dt", "lr", "mn", "szj"]) for c in group}


def formal_names(given: str) -> set[str]:
    return {given} | _FORMAL.get(given, set())


def phonetic(word: str) -> str:
    """One digit for each group of like consonants; vowels, h and repetitions fall out."""
    out, last = [], None
    for c in word:
        code = _CODES.get(c)
        if code is not None and code != last:
            out.append(str(code))
        last = last if c == "h" else code
    return "".join(out)


def plain(text: str) -> str:
    """Lower-case ASCII letters where there are any, other scripts as they are; odd spaces and signs as blanks."""
    text = unicodedata.normalize("NFKD", text.replace("ß", "ss"))
    text = "".join(c for c in text if not unicodedata.combining(c)).lower()
    return re.sub(r"(?<=\w)[-’'](?=\w)", "", text)


def parse(text: str) -> tuple[str, str, str, str, str] | None:
    """(kind, order, first, second, middle). kind: p or o. order: k when first is the family name for sure, else u. None: a placeholder."""
    bare = _TITLES.sub(" ", plain(text))
    if " ".join(re.findall(r"[^\W\d_]+", bare)) in PLACEHOLDERS:
        return None
    if re.search(r"\binst(itute)?\b", bare):
        return _parse_organisation(bare)
    organisation = _parse_marked(bare)
    if organisation:
        return organisation
    head, comma, tail = bare.partition(",")
    order = "k" if comma and re.search(r"\w", tail) and re.search(r"\w", head) else "u"
    words = lambda s: re.findall(r"[^\W\d_]+", s)
    if order == "k":
        family, rest = words(head), words(tail)
        rest = [c for w in rest for c in (w if len(w) <= 2 and w not in _FORMAL else [w])]
        return "p", "k", " ".join(family), rest[0] if rest else "", rest[1][0] if len(rest) > 1 else ""
    all_words = words(bare)
    long = [w for w in all_words if len(w) > 2 or w in _FORMAL]
    if not long:
        return "p", "k", " ".join(all_words), "", ""
    if len(long) == 1:
        initials = [c for w in all_words if w is not long[0] for c in w]
        if len(all_words) > 1 and all_words[0] is long[0] and len(all_words[1]) == 1 and len(all_words) == 2 and long[0] in _FORMAL:
            return "p", "k", all_words[1], long[0], ""
        return "p", "k", long[0], initials[0] if initials else "", initials[1] if len(initials) > 1 else ""
    middle = [w[0] for w in all_words[1:-1] if len(w) <= 2 and w not in _FORMAL]
    return "p", "u", long[-1], " ".join(long[:-1]), middle[0] if middle else ""


def _parse_organisation(bare: str) -> tuple[str, str, str, str, str]:
    bare = re.sub(r"\b(the|and)\b", " ", bare)
    before, link, after = re.match(r"(.*?)\binst(?:itute)?\b\.?(?: *(for|of)\b)?(.*)", bare, re.S).groups()
    before, after = re.findall(r"[^\W\d_]+", before), re.findall(r"[^\W\d_]+", after)
    if link:
        place, topic = (before, after) if before else (after[-1:], after[:-1])
    else:
        place, topic = (after, before) if after else (before[-1:], before[:-1])
    return "o", "k", " ".join(place), " ".join(topic), ""


def _parse_marked(bare: str) -> tuple[str, str, str, str, str] | None:
    """An organisation that says what it is ("University of Oslo", "Oslo Univ.", "Acme Research GmbH"): its distinguishing words in order of the alphabet, and its kinds. None: no mark of one."""
    found = re.findall(r"[^\W\d_]+", bare)
    marked = {w for w in found if w in _MARKS and (w not in _DOUBTFUL or f"{w}." in bare)}
    company = len(found) > 1 and found[-1] in COMPANY_FORMS
    if len(found) < 2 or not (marked or company):
        return None
    kinds = sorted({_MARKS[w] for w in marked})
    rest = sorted(w for w in found if w not in marked and w not in COMPANY_FORMS and w not in {"the", "and", "of", "for", "at", "in", "on"})
    return ("o", "k", " ".join(rest), " ".join(kinds), "") if rest else None


def _padded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, words), np.int64, len(words))
    width = max(1, int(size.max()) if len(words) else 1)
    return np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width), size


def jaro_winkler(left: list[str], right: list[str]) -> np.ndarray:
    """Jaro-Winkler similarity of each pair, all pairs at once; two empty words have 1."""
    if not left:
        return np.zeros(0)
    a, la = _padded(left)
    b, lb = _padded(right)
    window = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    rows, used = np.arange(len(a)), np.zeros(b.shape, bool)
    taken = np.zeros(a.shape, bool)
    at = np.arange(b.shape[1])
    for i in range(a.shape[1]):
        near = (at[None] >= (i - window)[:, None]) & (at[None] <= (i + window)[:, None]) & (at[None] < lb[:, None]) & ~used & (b == a[:, i : i + 1]) & (i < la)[:, None]
        first = near.argmax(1)
        hit = near[rows, first]
        used[rows[hit], first[hit]] = True
        taken[:, i] = hit
    m = taken.sum(1)
    # the matched letters of either side, in order
    turned = np.zeros(len(a))
    ca, cb = np.cumsum(taken, 1), np.cumsum(used, 1)
    for k in range(1, int(m.max(initial=0)) + 1):
        has = m >= k
        ia, ib = (ca >= k).argmax(1), (cb >= k).argmax(1)
        turned += has & (a[rows, ia] != b[rows, ib])
    safe = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - turned / 2) / safe) / 3, 0.0)
    jaro = np.where((la == 0) & (lb == 0), 1.0, jaro)
    prefix, going = np.zeros(len(a)), np.ones(len(a), bool)
    for i in range(min(4, a.shape[1], b.shape[1])):
        going &= (a[:, i] == b[:, i]) & (i < la) & (i < lb)
        prefix += going
    return jaro + prefix * 0.1 * (1 - jaro)


def _parse_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = [(a, *p) for a, p in zip(pdf["authors"], map(parse, pdf["authors"]), strict=True) if p]
        yield pd.DataFrame(got, columns=["authors", "kind", "ord", "first", "second", "middle"])


def _near_codes(word: str) -> set[str]:
    """The phonetic code and those with one digit left out: codes one edit apart, or with two neighbours swapped, share one."""
    code = phonetic(word)
    return {code, *(code[:k] + code[k + 1 :] for k in range(len(code)))} if len(code) > 2 else {code, word[:4]}


def _keys(family: str, given: str, kind: str) -> list[str]:
    """Blocks of a form: near codes of the family name, each with the code of the given name (full forms) or with the initial (forms that have no more, kind i, and full forms to meet them); the exact code with the initial for slips in the given name."""
    near = _near_codes(family)
    if kind == "o":
        topic = "".join(w[0] for w in given.split())
        return [f"o{c}|{topic}" for c in near]
    if len(given) <= 1:
        return [f"i{c}|{given}" for c in near] if given else []
    names = formal_names(given)
    initials = {n[0] for n in names}
    return [*{f"p{c}|{phonetic(n)}{n[0]}" for n in names for c in near}, *{f"i{c}|{i}" for i in initials for c in near}, *{f"g{phonetic(family)}|{i}" for i in initials}]


def _key_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keys = [_keys(f, g, k) for f, g, k in zip(pdf["family"], pdf["given"], pdf["kind"], strict=True)]
        yield pdf.assign(key=keys).explode("key").dropna(subset=["key"])


def _accept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidate pairs that pass: a, b, how many of the two have but an initial, and the edits of the family name; of a slip in the given name also the family and both given names, for the evidence of the whole table."""
    for pdf in batches:
        fa, fb, ga, gb = (pdf[c].tolist() for c in ("family_a", "family_b", "given_a", "given_b"))
        similar = np.ones(len(pdf))
        apart = [k for k in range(len(pdf)) if fa[k] != fb[k]]
        similar[apart] = jaro_winkler([fa[k] for k in apart], [fb[k] for k in apart])
        same_family = np.array([x == y for x, y in zip(fa, fb, strict=True)], bool)
        near_family = (similar >= FAMILY_SIMILARITY) & (pdf["edits"].to_numpy() <= EDITS)
        organisation = (pdf["kind"] == "o").to_numpy()
        only_initial = pdf["initial"].to_numpy() > 0
        same_given = np.array([_same_given(x, y, o, i) for x, y, o, i in zip(ga, gb, organisation, only_initial, strict=True)], bool)
        given_similar = np.zeros(len(pdf))
        unlike = [k for k in range(len(pdf)) if same_family[k] and not same_given[k] and not only_initial[k]]
        given_similar[unlike] = jaro_winkler([ga[k] for k in unlike], [gb[k] for k in unlike])
        near_given = (given_similar >= GIVEN_SIMILARITY) & (pdf["given_edits"].to_numpy() <= EDITS)
        middles = np.array([not x or not y or x == y for x, y in zip(pdf["middle_a"], pdf["middle_b"], strict=True)], bool)
        sure, slip = middles & near_family & same_given, middles & same_family & near_given & ~same_given
        yes = sure | slip
        family = np.where(slip, pdf["family_a"], None)
        one, two = np.where(slip, np.minimum(pdf["given_a"], pdf["given_b"]), None), np.where(slip, np.maximum(pdf["given_a"], pdf["given_b"]), None)
        yield pd.DataFrame({"a": pdf["a"][yes], "b": pdf["b"][yes], "initial": pdf["initial"][yes], "edits": pdf["edits"][yes], "family": family[yes], "one": one[yes], "two": two[yes]})


def _same_given(x: str, y: str, organisation: bool, initial: bool) -> bool:
    if organisation:
        p, q = x.split(), y.split()
        return len(p) == len(q) and all(s == t or (min(len(s), len(t)) >= 3 and (s.startswith(t) or t.startswith(s))) or _one_slip(s, t) for s, t in zip(p, q, strict=True))
    if initial and len(y) <= 1:
        return x == y
    if initial:
        return any(n[:1] == x for n in formal_names(y))
    return bool(formal_names(x) & formal_names(y))


def _one_slip(s: str, t: str) -> bool:
    """Long words that differ by one letter put in, left out or replaced, or by two neighbours swapped."""
    if min(len(s), len(t)) < 4 or abs(len(s) - len(t)) > 1:
        return False
    k = next((k for k in range(min(len(s), len(t))) if s[k] != t[k]), min(len(s), len(t)))
    return s[k + 1 :] == t[k + 1 :] or s[k:] == t[k + 1 :] or s[k + 1 :] == t[k:] or (s[k : k + 2] == t[k : k + 2][::-1] and s[k + 2 :] == t[k + 2 :])


def link_names(results: DataFrame, column: str = "authors") -> DataFrame:
    """One row per distinct spelling that names somebody: authors and entity (equal for all spellings of one person or organisation)."""
    spark = results.sparkSession
    space = Workspace(spark, "names")
    spellings = results.select(F.col(column).alias("authors")).where(F.col("authors").isNotNull()).distinct()
    parsed = space.write(spellings.repartition(parallelism(spark)).mapInPandas(_parse_all, "authors string, kind string, ord string, first string, second string, middle string"))
    # which of two words is the given name shows from the spellings whose order is known
    sure = parsed.where("kind = 'p' and ord = 'k' and first != '' and length(second) > 1")
    roles = sure.select(F.explode(F.array(F.struct(F.col("first").alias("word"), F.lit(-1).alias("role")), F.struct(F.col("second").alias("word"), F.lit(1).alias("role")))).alias("x")).groupBy("x.word").agg(F.sum("x.role").alias("role"))
    one, two = roles.select(F.col("word").alias("first"), F.col("role").alias("role_1")), roles.select(F.col("word").alias("second"), F.col("role").alias("role_2"))
    unsure = parsed.where("ord = 'u'").join(one, "first", "left").join(two, "second", "left")
    turned = (F.coalesce("role_1", F.lit(0)) > 0) & (F.coalesce("role_2", F.lit(0)) <= 0)
    named = parsed.where("ord = 'k'").select("authors", "kind", F.col("first").alias("family"), F.col("second").alias("given"), "middle").unionByName(
        unsure.select("authors", "kind", F.when(turned, F.col("second")).otherwise(F.col("first")).alias("family"), F.when(turned, F.col("first")).otherwise(F.col("second")).alias("given"), "middle")
    )
    named = space.write(named.withColumn("form", F.xxhash64("kind", "family", "given", "middle")))
    forms = named.select("form", "kind", "family", "given", "middle").distinct()
    families = forms.where("length(given) > 1").groupBy("given").agg(F.count_distinct("family").alias("families"))
    keyed = space.write(forms.mapInPandas(_key_all, "form long, kind string, family string, given string, middle string, key string"))
    side = lambda x: keyed.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("form", "kind", "family", "given", "middle")))
    initial_a, initial_b = F.length("given_a") <= 1, F.length("given_b") <= 1
    in_order = F.col("form_a") < F.col("form_b")
    # forms with but an initial meet full ones and each other under keys of their own
    pairs = meet(space, side("a"), side("b"), "key", "form_a").where((initial_a & ~initial_b) | (in_order & (initial_a == initial_b) & (initial_a | ~F.col("key").startswith("i"))))
    pairs = pairs.where(F.levenshtein("family_a", "family_b", EDITS) >= 0).drop("key").distinct()
    pairs = pairs.select(
        F.col("form_a").alias("a"), F.col("form_b").alias("b"), F.col("kind_a").alias("kind"), "family_a", "family_b", "given_a", "given_b", "middle_a", "middle_b",
        (initial_a.cast("int") + initial_b.cast("int")).alias("initial"), F.levenshtein("family_a", "family_b").alias("edits"), F.levenshtein("given_a", "given_b").alias("given_edits"),
    )
    accepted = space.write(pairs.mapInPandas(_accept, "a long, b long, initial int, edits int, family string, one string, two string"))
    # slips in given names need the evidence of the families that have both
    slips = accepted.where("one is not null")
    shared = slips.groupBy("one", "two").agg(F.count_distinct("family").alias("shared"))
    of = lambda x: families.select(F.col("given").alias(x), F.col("families").alias(f"of_{x}"))
    likely = shared.join(of("one"), "one").join(of("two"), "two").where(F.col("shared") >= SHARED_FAMILIES * F.least("of_one", "of_two")).select("one", "two")
    sure = accepted.where("one is null and initial = 0").select("a", "b").unionByName(slips.join(likely, ["one", "two"], "left_semi").select("a", "b"))
    clusters = connected_components(sure, "a", "b", workspace=space).select(F.col("node").alias("form"), F.col("component").alias("entity"))
    # an initial goes to the one cluster that fits best
    fits = accepted.where("initial = 1").join(clusters.withColumnRenamed("form", "b"), "b", "left").select("a", "edits", F.coalesce("entity", "b").alias("entity"))
    best = fits.groupBy("a", "edits").agg(F.min("entity").alias("low"), F.max("entity").alias("high")).groupBy("a").agg(F.min_by(F.struct("low", "high"), "edits").alias("x"))
    attached = best.where("x.low = x.high").select(F.col("a").alias("form"), F.col("x.low").alias("entity"))
    # initials that fit no full form at all are compared with each other
    alone = accepted.where("initial = 2").select("a", "b")
    for end in ("a", "b"):
        alone = alone.join(best.select(F.col("a").alias(end)), end, "left_anti")
    initials = connected_components(alone, "a", "b", workspace=space).select(F.col("node").alias("form"), F.col("component").alias("entity"))
    entities = clusters.unionByName(attached).unionByName(initials)
    return named.join(entities, "form", "left").select("authors", F.coalesce("entity", "form").alias("entity"))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct spelling: authors and entity, the class of all spellings of one person or organisation."""
    return link_names(table(spark, sf_dir, "results"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = Workspace(spark, "name-pairs").write(link_names(table(spark, sf_dir, "results")))
    one, two = linked.select("entity", F.col("authors").alias("authors_1")), linked.select("entity", F.col("authors").alias("authors_2"))
    return one.join(two, "entity").where("authors_1 < authors_2").select("authors_1", "authors_2")

"""Column expressions: trimming, blocking keys, edit similarity, vectors, spelling variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of all kinds.
_SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def blocking_key(columns: list[Column]) -> Column:
    """Values joined by |, missing ones as empty text (concat_ws alone would leave them out)."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def comparable(c: Column, missing: str = "nan") -> Column:
    """The trimmed text that edit similarity compares; a missing value is the text nan, or blank with missing='zero'."""
    return strip(F.coalesce(c.cast("string"), F.lit("nan" if missing == "nan" else "")))


def similarity_of(a: Column, b: Column) -> Column:
    """Edit similarity of comparable texts."""
    return similarity_of_lowered(F.lower(a), F.length(a), F.lower(b), F.length(b))


def similarity_of_lowered(a: Column, length_a: Column, b: Column, length_b: Column) -> Column:
    """similarity_of texts already lowered, with their lengths before that."""
    similar = F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / F.nullif(F.greatest(length_a, length_b), F.lit(0)))
    return F.when((length_a == 0) | (length_b == 0), F.lit(0.0)).otherwise(similar).cast("double")


def edit_similarity(left: Column, right: Column, missing: str = "nan") -> Column:
    """1 - edits / longer length after trimming, case apart; 0 if either is blank. Lengths are those before lower-casing, so the result is kept at 0 or above."""
    return similarity_of(comparable(left, missing), comparable(right, missing))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v at unit length; a zero vector stays zero, null stays null."""
    # the norm is bound once; inside the inner function alone it would be computed for every number
    scaled = F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)).cast("float")))
    return F.when(v.isNotNull(), scaled[0])


def hashed_ngrams(text: Column, n: int = 3, buckets: int = 256) -> Column:
    """Buckets of the letter n-grams of the lower-cased text (null as empty); shorter text is one gram, empty text has none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - (n - 1), F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))
    bucket = lambda g: F.pmod(F.conv(F.substring(F.md5(g), 1, 6), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    return F.when(F.length(low) == 0, F.array().cast("array<int>")).otherwise(F.transform(grams, bucket))


def name_variants(full: Column, middle: Column) -> Column:
    """Eight ways to write a name of given and family name; middle: an initial."""
    given, family = F.split_part(full, F.lit(" "), F.lit(1)), F.regexp_extract(full, r"(\S+)\s*$", 1)
    g, f = F.substring(given, 1, 1), F.substring(family, 1, 1)
    j = F.concat
    return F.array(
        j(given, F.lit(" "), family), j(g, F.lit(". "), family), j(given, F.lit(" "), f, F.lit(".")), j(g, F.lit(". "), f, F.lit(".")),
        j(family, F.lit(", "), given), j(family, F.lit(", "), g, F.lit(".")), j(given, F.lit(" "), middle, F.lit(". "), family), j(g, F.lit(". "), middle, F.lit(". "), family),
    )


#: Phrases and their short forms, prefixes and suffixes of title variants.
TITLE_SHORT = {
    "Natural Language Processing": "NLP", "Computer Vision": "CV", "Machine Learning": "ML", "Deep Learning": "DL",
    "Artificial Intelligence": "AI", "Neural Networks": "NN", "Reinforcement Learning": "RL", "Information Retrieval": "IR",
}
TITLE_PREFIXES, TITLE_SUFFIXES = ("On ", "Towards "), (": A Survey", " Revisited")


def title_variants(title: Column, short: dict[str, str] | None = None) -> Column:
    """The title, with each phrase shortened that it holds, with its leading article dropped (or A put in), with suffixes and prefixes; in that order."""
    shortened = [F.when(F.contains(title, F.lit(a)), F.replace(title, F.lit(a), F.lit(b))) for a, b in (short or TITLE_SHORT).items()]
    article = F.when(title.rlike("^(A|An|The) "), F.regexp_replace(title, "^(A|An|The) ", "")).otherwise(F.concat(F.lit("A "), title))
    around = [F.concat(title, F.lit(s)) for s in TITLE_SUFFIXES] + [F.concat(F.lit(p), title) for p in TITLE_PREFIXES]
    return F.filter(F.array(title, *shortened, article, *around), lambda x: x.isNotNull())

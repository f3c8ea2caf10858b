"""Best representative of each duplicate group, field by field (problem 2).

Latent two-sided quality: each value that a source claims in a group is true or not; a source claims true values with its
sensitivity and passes over false ones with its specificity. Expectation-maximisation learns both for every source: the feeds of the
list (any others share one entry) and, for years, the venue text, which often carries one. What a value itself shows (signs of damage,
words that no other group has, words missing at its end; a year out of range or hardly ever seen) are further observers, whose shares
among true and among false values are learned in the same passes; nothing is set by hand but the first guess, which is the same for
all signs. Values whose posterior is above one half are retained (a field may have several, see retained_values); the surviving value
is the most probable one.

Layout: one row for each group, field and value, with the claims on it and all claims of its group by source (at most one entry a
source). An iteration is one pass over that table, for both fields, and shuffles two sums for each source and sign.

The same feed and id again is a re-delivery: only the latest loaded row claims. Nulls and blanks claim nothing. Ties go to the
value with more claims, then to the longer one, then to the smaller one. A group without any usable value takes the best of its other
values, or none (null row id). Rows without cluster_id are no case, nor are groups of one row. Repeated rows don't change the result
but through their counts. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table

ITERATIONS = 12
#: Sensitivity and specificity to begin with, and as many claims (or values) as the first guess counts for.
FIRST, SEEN = (0.7, 0.9), 10
#: First guess of how many true values show no sign, for any sign; of false values half do.
SOUND = 0.98
#: Titles that say that there is none.
NO_TITLES = ["untitled", "untitled document", "n/a", "na", "[no title]", "no title", "none", "null", "unknown", "-", "tba"]



FIELDS = ("title", "year")
#: Levels of each sign of a field. A title: nine signs of damage, words that no other group has beyond those of values of the same length, words missing
#: from the longest sound value. A year: in range, two figures, out of range; how rare it is.
LEVELS = {"title": (*[2] * 9, 3, 3), "year": (3, 3)}
#: Sources of years beside the feeds.
_OTHER, _VENUE, _SHORT = 0, 1, 2


def title_signs(t: Column) -> list[Column]:
    """Whether a title shows each sign of damage."""
    return [
        t.rlike("�|Ã|Â|â€"),
        t.rlike(r"&\w+;|&#\d+;|</?\w+>|\w&\w"),
        (t == F.upper(t)) & (F.length(t) > 8) | (t == F.lower(t)),
        t.rlike(r"(\.\.\.|…)\s*$"),
        t.rlike(r"(?i)\[(pdf|html|epub|online|preprint)\]|\.pdf\s*$|\| *(download|pdf|full text)|-- *(accepted|submitted|author)"),
        t.rlike(r"^\s|\s$|\s\s|[ _]|\w- \w"),
        t.rlike(r"\w\.( |$)"),
        t.rlike(r"(?i)\b(\w+) \1\b"),
        t.rlike(r"^(of|for|with|under|in|and|or|meet)\b") | t.rlike(r"\b(a|an|the|of|for|with|under|in|and|on|to|by)\s*$"),
    ]


def _sign_ids(field: str, levels: list[Column]) -> Column:
    """One number for each sign and its level, from 0 on over all fields."""
    first = sum(sum(LEVELS[f]) for f in FIELDS[: FIELDS.index(field)])
    starts = [first + sum(LEVELS[field][:k]) for k in range(len(levels))]
    return F.array(*[F.lit(s) + x.cast("int") for s, x in zip(starts, levels, strict=True)])


@dataclass
class Quality:
    """Of each source (of a field) its sensitivity and specificity; of each level of a sign its share among true and among false values; of each field the share of true values."""

    sensitivity: list[float]
    specificity: list[float]
    in_true: list[float]
    in_false: list[float]
    true_share: list[float]


def _first_levels() -> tuple[list[float], list[float]]:
    in_true, in_false = [], []
    for f in FIELDS:
        for n in LEVELS[f]:
            in_true += [SOUND, *[(1 - SOUND) / (n - 1)] * (n - 1)]
            in_false += [0.5, *[0.5 / (n - 1)] * (n - 1)]
    return in_true, in_false


def first_guess(sources: int) -> Quality:
    return Quality([FIRST[0]] * sources * len(FIELDS), [FIRST[1]] * sources * len(FIELDS), *_first_levels(), [0.5] * len(FIELDS))


def with_odds(values: DataFrame, q: Quality) -> DataFrame:
    """values with the log odds that each is true, and that probability p."""
    look_up = lambda numbers: F.array(*[F.lit(float(x)) for x in numbers])
    claim = look_up(math.log(a / (1 - b)) for a, b in zip(q.sensitivity, q.specificity, strict=True))
    passed = look_up(math.log((1 - a) / b) for a, b in zip(q.sensitivity, q.specificity, strict=True))
    shown = look_up(math.log(a / b) for a, b in zip(q.in_true, q.in_false, strict=True))
    add = lambda array, of: F.aggregate(array, F.lit(0.0), lambda total, x: total + of(x))
    # what each source would add by passing; a value's own claims replace their share
    prior = F.get(look_up(math.log(x / (1 - x)) for x in q.true_share), F.when(F.col("field") == FIELDS[0], 0).otherwise(1))
    odds = prior + add("of", lambda x: x["n"] * F.get(passed, x["source"])) + add("claims", lambda x: x["n"] * (F.get(claim, x["source"]) - F.get(passed, x["source"]))) + add("signs", lambda x: F.get(shown, x))
    bounded = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("odds")))
    return values.withColumn("odds", odds).withColumn("p", 1 / (1 + F.exp(-bounded)))


def learn_quality(values: DataFrame, sources: int, iterations: int = ITERATIONS) -> Quality:
    """By expectation-maximisation. values: group_id, field, value, claims and of (arrays of source and n), signs (array of level ids); sources are numbered over both fields."""
    q = first_guess(sources)
    first_true, first_false = _first_levels()
    # before any evidence, as many values as there are groups are taken to be true
    for r in values.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("group_id").alias("groups")).collect():
        q.true_share[FIELDS.index(r.field)] = (r.groups + SEEN / 2) / (r.n + SEEN)
    for _ in range(iterations):
        p = F.col("p")
        parts = [
            F.transform("claims", lambda x: F.struct(F.lit("c").alias("kind"), x["source"].alias("id"), (x["n"] * p).alias("t"), (x["n"] * (1 - p)).alias("f"))),
            F.transform("of", lambda x: F.struct(F.lit("o").alias("kind"), x["source"].alias("id"), (x["n"] * p).alias("t"), (x["n"] * (1 - p)).alias("f"))),
            F.transform("signs", lambda x: F.struct(F.lit("s").alias("kind"), x.alias("id"), p.alias("t"), (1 - p).alias("f"))),
        ]
        sums = with_odds(values, q).select(F.explode(F.concat(*parts)).alias("x")).groupBy("x.kind", "x.id").agg(F.sum("x.t").alias("t"), F.sum("x.f").alias("f"))
        got = {(r.kind, r.id): (r.t, r.f) for r in sums.collect()}  # two sums for each listed source and each level
        for s in range(sources * len(FIELDS)):
            hit, false_hit = got.get(("c", s), (0.0, 0.0))
            true_n, false_n = got.get(("o", s), (0.0, 0.0))
            q.sensitivity[s] = min(max((hit + SEEN * FIRST[0]) / (true_n + SEEN), 0.02), 0.98)
            q.specificity[s] = min(max((false_n - false_hit + SEEN * FIRST[1]) / (false_n + SEEN), 0.02), 0.98)
        at = 0
        for n in (n for f in FIELDS for n in LEVELS[f]):
            ids = range(at, at + n)
            total = [sum(got.get(("s", k), (0.0, 0.0))[w] for k in ids) for w in (0, 1)]
            for k in ids:
                t, f = got.get(("s", k), (0.0, 0.0))
                q.in_true[k] = max((t + SEEN * first_true[k]) / (total[0] + SEEN), 1e-4)
                q.in_false[k] = max((f + SEEN * first_false[k]) / (total[1] + SEEN), 1e-4)
            at += n
    return q


def _words(c: str) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}�]+"), lambda w: F.length(w) > 2)


def _title_levels(rows: DataFrame, all_titles: DataFrame, space: Workspace) -> DataFrame:
    """group_id, value and signs of each title of a group."""
    counts = all_titles.select(F.explode(F.array_distinct(_words("title"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("everywhere"))
    here = rows.select("group_id", F.explode(F.array_distinct(_words("title"))).alias("word")).groupBy("group_id", "word").agg(F.count(F.lit(1)).alias("here"))
    own = space.write(here.join(counts, "word").where(F.col("everywhere") <= F.col("here")).select("group_id", "word"))
    values = rows.select("group_id", F.col("title").alias("value")).distinct()
    values = space.write(values.withColumn("size", F.size(_words("value"))).withColumn("marks", F.array(*[F.coalesce(x, F.lit(False)).cast("int") for x in title_signs(F.col("value"))])))
    novel = values.select("group_id", "value", F.explode(F.array_distinct(_words("value"))).alias("word")).join(own, ["group_id", "word"]).groupBy("group_id", "value").agg(F.count(F.lit(1)).alias("novel"))
    values = space.write(values.join(novel, ["group_id", "value"], "left").withColumn("novel", F.coalesce("novel", F.lit(0))))
    least = values.groupBy("group_id", "size").agg(F.min("novel").alias("least"))
    values = values.join(least, ["group_id", "size"]).withColumn("beyond", F.least(F.lit(2), F.col("novel") - F.col("least")))
    sound = (F.aggregate("marks", F.lit(0), lambda a, x: a + x) == 0) & (F.col("beyond") == 0)
    longest = values.where(sound).groupBy("group_id").agg(F.max("size").alias("longest"))
    short = F.least(F.lit(2), F.greatest(F.lit(0), F.coalesce(F.col("longest") - F.col("size"), F.lit(0))))
    levels = [F.get("marks", F.lit(k)) for k in range(9)] + [F.col("beyond"), short]
    return values.join(longest, "group_id", "left").select("group_id", "value", _sign_ids("title", levels).alias("signs"))


def _year_levels(values: DataFrame, all_years: DataFrame) -> DataFrame:
    """group_id, value and signs of each year of a group."""
    usual = all_years.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    most = usual.where("year between 1900 and 2100").agg(F.max("n").alias("most"))
    share = usual.crossJoin(most).select("year", (F.col("n") / F.col("most")).alias("share"))  # one row each
    year = F.col("year")
    rare = F.when(F.col("share") >= 0.1, 0).when(F.col("share") >= 0.01, 1).otherwise(2)
    kind = F.when(year.between(1900, 2100), 0).when(year.between(3, 99), 1).otherwise(2)
    return values.join(share, "year", "left").select("group_id", year.cast("string").alias("value"), _sign_ids("year", [kind, rare]).alias("signs"))


def claimed_values(results: DataFrame, feeds: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The rows of all groups of several rows, the groups, the table that learn_quality reads, and the number of sources of a field."""
    columns = [F.col("cluster_id").alias("group_id"), *map(F.col, ("row_id", "feed", "id", "title", "venue", "year", "loaded_at"))]
    rows = space.write(results.where("cluster_id is not null and row_id is not null").select(*columns))
    groups = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("group_id")
    rows = rows.join(groups, "group_id", "left_semi")
    # the list of feeds is the stated, short scheme of sources
    names = [r.feed for r in feeds.select("feed").where("feed is not null").distinct().orderBy("feed").collect()]
    sources = 3 + len(names)
    number = F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), F.lit(3 + k))])[F.col("feed")] if names else F.lit(None).cast("int")
    rows = rows.withColumn("source", F.coalesce(number, F.lit(_OTHER)))
    known = F.col("feed").isNotNull() & F.col("id").isNotNull()
    stated = ("source", "title", "venue", "year")
    latest = rows.where(known).groupBy("group_id", "feed", "id").agg(F.max_by(F.struct(*stated), F.struct(F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp")), "row_id")).alias("x")).select("group_id", *(F.col(f"x.{c}").alias(c) for c in stated))
    claiming = space.write(rows.where(~known).select("group_id", *stated).unionByName(latest))

    usable = F.col("title").isNotNull() & (F.length(F.trim("title")) > 0) & ~F.lower(F.trim("title")).isin(NO_TITLES)
    said = claiming.where(usable).select("group_id", F.lit("title").alias("field"), F.col("title").alias("value"), "source")
    in_venue = F.regexp_extract("venue", r"(?:^|\D)((?:19|20)\d\d)(?:\D|$)", 1)
    two = F.regexp_extract("venue", r"['’](\d\d)\s*$", 1).try_cast("int")
    full = lambda y: F.when(y < 50, y + 2000).otherwise(y + 1900)
    text_year = F.coalesce(F.when(F.length(in_venue) == 4, in_venue.cast("int")), F.when(two.isNotNull(), full(two)))
    years = [
        claiming.where("year is not null").select("group_id", "year", "source"),
        rows.select("group_id", text_year.alias("year"), F.lit(_VENUE).alias("source")).where("year is not null"),
        # two figures stand for a year that another row may give in full
        claiming.where("year between 3 and 99").select("group_id", full(F.col("year")).alias("year"), F.lit(_SHORT).alias("source")),
    ]
    own_years = space.write(rows.where("year is not null").select("group_id", "year").distinct())
    dated = years[0].unionByName(years[1]).unionByName(years[2]).join(own_years, ["group_id", "year"], "left_semi")
    claims = said.unionByName(dated.select("group_id", F.lit("year").alias("field"), F.col("year").cast("string").alias("value"), (F.col("source") + sources).alias("source")))
    counted = space.write(claims.groupBy("group_id", "field", "value", "source").agg(F.count(F.lit(1)).cast("double").alias("n")))
    pack = lambda c: F.sort_array(F.collect_list(F.struct("source", "n"))).alias(c)  # noqa: E731  (one entry a source)
    of = counted.groupBy("group_id", "field", "source").agg(F.sum("n").alias("n")).groupBy("group_id", "field").agg(pack("of"))
    mine = counted.groupBy("group_id", "field", "value").agg(pack("claims"))
    titles = rows.where(usable)
    signs = _title_levels(titles, results.where(usable).select("title"), space).withColumn("field", F.lit("title"))
    signs = signs.unionByName(_year_levels(own_years, results.where("year is not null").select("year")).withColumn("field", F.lit("year")))
    # values that only superseded rows have are candidates without a claim
    none = F.array().cast("array<struct<source:int,n:double>>")
    values = signs.join(mine, ["group_id", "field", "value"], "left").join(of, ["group_id", "field"], "left")
    values = space.write(values.select("group_id", "field", "value", "signs", F.coalesce("claims", none).alias("claims"), F.coalesce("of", none).alias("of")))
    return rows, groups, values, sources


def judged(values: DataFrame, quality: Quality) -> DataFrame:
    """The surviving value of each group and field: the most probable one; ties go to more claims, the longer, the smaller value."""
    claims = F.aggregate("claims", F.lit(0.0), lambda a, x: a + x["n"])
    order = F.struct((-F.round("odds", 6)).alias("o"), (-claims).alias("c"), (-F.length("value")).alias("l"), "value")
    return with_odds(values, quality).groupBy("group_id", "field").agg(F.min_by("value", order).alias("value"))


def surviving_fields(results: DataFrame, feeds: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """cluster_id, title_row_id and year_row_id: the smallest row of the group whose title (or year) is the surviving one."""
    space = Workspace(results.sparkSession, "survivors")
    rows, groups, values, sources = claimed_values(results, feeds, space)
    best = space.write(judged(values, learn_quality(values, sources, iterations)))
    own = rows.select("group_id", F.explode(F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("value")), F.struct(F.lit("year").alias("field"), F.col("year").cast("string").alias("value")))).alias("x"), "row_id")
    met = own.select("group_id", "x.field", "x.value", "row_id").join(best, ["group_id", "field", "value"])
    found = met.groupBy("group_id").agg(*[F.min(F.when(F.col("field") == f, F.col("row_id"))).alias(f"{f}_row_id") for f in FIELDS])
    return groups.join(found, "group_id", "left").select(F.col("group_id").alias("cluster_id"), *(f"{f}_row_id" for f in FIELDS))


def retained_values(results: DataFrame, feeds: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """cluster_id, field, value, p and survives: every value of a field that is judged true (p above one half), and the surviving one."""
    space = Workspace(results.sparkSession, "survivors")
    _, _, values, sources = claimed_values(results, feeds, space)
    quality = learn_quality(values, sources, iterations)
    best = space.write(judged(values, quality)).withColumn("survives", F.lit(True))
    each = with_odds(values, quality).select("group_id", "field", "value", F.round("p", 6).alias("p")).join(best, ["group_id", "field", "value"], "left")
    return each.where("p > 0.5 or survives").select(F.col("group_id").alias("cluster_id"), "field", "value", "p", F.coalesce("survives", F.lit(False)).alias("survives"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surviving_fields(table(spark, sf_dir, "results"), table(spark, sf_dir, "feeds"))


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retained_values(table(spark, sf_dir, "results"), table(spark, sf_dir, "feeds"))

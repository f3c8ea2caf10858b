"""Near-duplicate records with small edits (problem 6): MinHash banding over letter n-grams of titles.

Rows become representatives (distinct title, authors, venue and year). A title is repaired and its 3-gram set gets MinHash
signatures; band and row counts are chosen for the target recall at the least similarity. Bands are shuffled together with the author's code
(the phonetic code of the family name, and the usual one of the entity that the name operator gives), so works with like titles by
different authors don't meet, and with a hot author only titles that share a band do. Titles that are cut off or abbreviated have two
further keys: their first letters, and the initials of their first content words.
Records without a usable author meet all others in stricter bands, and in the same bands and by the same two keys with the year or the
venue in place of the author's code. Pairs are verified on their full n-gram sets and word by word:
part numbers, editions and a content word that differs make another publication, and so do other authors or another venue of the
list. Re-deliveries (same feed and id) belong together whatever their content. Accepted pairs are clustered, and the rows of a
cluster come out paired where neither part number nor venue speaks against it.

Records whose title is null, blank or a placeholder match by re-delivery, or go to the one titled publication of the same author
with the same venue and year, else the same venue, else (venue unknown) the same year, if exactly one there is. Null authors, venues and years speak neither for nor against a pair;
general titles of up to three words need the same venue and year. Rows with a cluster_id are no cases. Repeated rows are paired
like any others. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, meet, parallelism, table
from .components import connected_components
from .names import link_names, parse, phonetic
from .titles import FILLER, compare_words, edits, gram_text, grams, split_title
from .venues import map_venues

#: Least similarity of n-gram sets that the bands are made for, rows in a band, and the share of such pairs that must meet.
LEAST_SIMILARITY, BAND_ROWS, TARGET_RECALL = 0.6, 4, 0.95
#: The same for records without a usable author, which meet every title.
STRICT_SIMILARITY, STRICT_ROWS = 0.85, 8
#: n-grams of a title cut off that stand for the whole one without further support.
LONG_BEGINNING = 24


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """The least number of bands with which a pair of this similarity meets with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))


def _min_hashes(flat: np.ndarray, starts: np.ndarray, hashes: int) -> np.ndarray:
    """The least value of each hash over each run of flat (64-bit codes of n-grams; repeated ones change nothing)."""
    rng = np.random.default_rng(7)
    a = rng.integers(1, 1 << 63, hashes, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, hashes, dtype=np.uint64)
    out, x, flat = np.empty((len(starts), hashes), np.uint64), np.empty(len(flat), np.uint64), _mixed(flat)
    with np.errstate(over="ignore"):
        for k in range(hashes):
            np.multiply(flat, a[k], out=x)
            x += b[k]
            out[:, k] = np.minimum.reduceat(x, starts)
    return out


def signatures(sets: list[set[str]], hashes: int) -> np.ndarray:
    """MinHash signatures, one row per set; sets are not empty."""
    sizes = [len(s) for s in sets]
    flat = np.fromiter((zlib.crc32(g.encode()) for s in sets for g in s), np.uint64, sum(sizes))
    return _min_hashes(flat, np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64), hashes)


def title_signatures(titles: list[list[str]], hashes: int) -> np.ndarray:
    """MinHash signatures of the 3-grams of titles (lists of words, not empty), as titles.grams has them."""
    texts = [gram_text(words).ljust(3, "\0") for words in titles]
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    codes = letters[:-2] | letters[1:-1] << np.uint64(21) | letters[2:] << np.uint64(42)
    inside = np.ones(len(codes), bool)
    inside[(ends[:-1, None] - np.array([1, 2])).ravel()] = False
    counts = sizes - 2
    return _min_hashes(codes[inside], np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64), hashes)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _bands(signs: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    out = np.empty((len(signs), bands), np.uint64)
    for k in range(bands):
        key = np.full(len(signs), k + 1, np.uint64)
        for r in range(k * rows, (k + 1) * rows):
            key = _mixed(key ^ signs[:, r])
        out[:, k] = key
    return out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _outlines(words: list[str]) -> list[str]:
    """Keys for titles whose n-grams an abbreviation or a cut changes much: the first letters, and the initials of the first content words."""
    plain_words = [w.rstrip(".") for w in words]
    content = [w for w in plain_words if w not in FILLER]
    return ["f" + "".join(plain_words)[:8], "i" + "".join(w[0] for w in content[:4])]


def _keyed(bands: int, strict_bands: int):
    """Each representative once for each of its keys. side: 0 meets 0; 1 (no author) meets 1 and 2; 2 meets 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pdf = batch.to_pandas()
            parts = [w.split() for w in pdf["words"]]
            usable = np.array([k for k, found in enumerate(parts) if found], np.int64)
            if not len(usable):
                continue
            signs = title_signatures([parts[k] for k in usable], max(bands * BAND_ROWS, strict_bands * STRICT_ROWS))
            strict = _bands(signs, STRICT_ROWS, strict_bands)
            outlines = np.array([[_hash(o) for o in _outlines(parts[k])] for k in usable], np.uint64)
            close = np.concatenate([_bands(signs, BAND_ROWS, bands), outlines], axis=1)
            reps = pdf["rep"].to_numpy()[usable]
            code, main = pdf["code"].to_numpy()[usable], pdf["main"].to_numpy()[usable]
            out = [(np.array([c is None for c in code], bool), strict, 1), (np.array([c is not None for c in code], bool), strict, 2)]
            owner = np.array([_hash(c) if c else 0 for c in code], np.uint64)
            other = np.array([_hash(m) if m else 0 for m in main], np.uint64)
            out.append((owner != 0, _mixed(close ^ owner[:, None]), 0))
            out.append(((owner != 0) & (other != 0) & (other != owner), _mixed(close ^ other[:, None]), 0))
            for chosen, keys, side in out:
                n, width = int(chosen.sum()), keys.shape[1]
                for at in range(0, n, 2000):
                    rows = np.flatnonzero(chosen)[at : at + 2000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(reps[rows], width)), pa.array(np.full(len(rows) * width, side, np.int32)), pa.array(keys[rows].ravel().view(np.int64))], ["rep", "side", "key"])

    return run


def _seconded(bands: int):
    """Each representative once for each band and outline with its year, and with its venue: one of the two must be equal where no author speaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, venues, ids, years = (batch.column(c).to_pylist() for c in ("words", "venue", "venue_id", "year"))
            parts = [w.split() for w in texts]
            found = []
            for k in (k for k, words in enumerate(parts) if words):
                year = _valid_year(years[k])
                venue = f"v{ids[k]}" if ids[k] is not None and ids[k] > 0 else f"t{venues[k]}" if isinstance(venues[k], str) and len(venues[k]) > 3 else None
                found += [(k, s) for s in (None if year is None else f"y{year}", venue) if s]
            for at in range(0, len(found), 2000):
                some = found[at : at + 2000]
                usable = sorted({k for k, _ in some})
                place = {k: n for n, k in enumerate(usable)}
                close = _bands(title_signatures([parts[k] for k in usable], bands * BAND_ROWS), BAND_ROWS, bands)
                close = np.concatenate([close, np.array([[_hash(o) for o in _outlines(parts[k])] for k in usable], np.uint64)], axis=1)
                keys = _mixed(close[[place[k] for k, _ in some]] ^ np.array([_hash(s) for _, s in some], np.uint64)[:, None])
                reps = batch.column("rep").take(pa.array(np.repeat([k for k, _ in some], keys.shape[1])))
                yield pa.RecordBatch.from_arrays([reps, pa.array(keys.ravel().view(np.int64))], ["rep", "key"])

    return run


def _valid_year(year) -> int | None:
    if year is None:
        return None
    if 3 <= year < 100:
        year += 2000 if year < 50 else 1900
    return year if 1900 <= year <= 2100 else None


def _full_year(c: str) -> Column:
    """As _valid_year."""
    year = F.col(c)
    return F.when(year.between(3, 49), year + 2000).when(year.between(50, 99), year + 1900).when(year.between(1900, 2100), year)


class _Known:
    """Parts of titles and names met in a task, kept up to a number."""

    def __init__(self, most: int = 50_000):
        self.most, self.titles, self.names, self.pairs = most, {}, {}, {}

    def title(self, text):
        """Words and n-grams of a title's words in one text."""
        if text not in self.titles:
            if len(self.titles) >= self.most:
                self.titles.clear()
            found = text.split()
            self.titles[text] = found, grams(found)
        return self.titles[text]

    def compared(self, one, two):
        """compare_words of the words of two titles, which records often have in common with others."""
        if (one, two) not in self.pairs:
            if len(self.pairs) >= self.most:
                self.pairs.clear()
            self.pairs[one, two] = compare_words(self.title(one)[0], self.title(two)[0])
        return self.pairs[one, two]

    def name(self, text):
        if text not in self.names:
            if len(self.names) >= self.most:
                self.names.clear()
            self.names[text] = parse(text) if isinstance(text, str) else None
        return self.names[text]


def _authors_agree(one, two, entity_a, entity_b) -> bool | None:
    """None: one of them names nobody."""
    if not one or not two:
        return None
    if entity_a == entity_b and entity_a is not None:
        return True
    if one[0] != two[0]:
        return False
    ways = lambda p: [(p[2], p[3])] + ([(p[3], p[2])] if p[1] == "u" else [])
    for family, given in ways(one):
        for other, second in ways(two):
            if family[:1] and (not given or not second or given[0] == second[0]) and edits(family, other, 2) <= 2 and (min(len(given), len(second)) <= 1 or edits(given, second, 2) <= 2):
                return True
    return False


def same_publication(text_a, mark_a, text_b, mark_b, authors, year_a, year_b, same_venue: bool, known: _Known) -> bool:
    """Words of the titles in one text each, and their marks. authors: gives whether they agree, if it is asked. The venues don't differ."""
    words_a, grams_a = known.title(text_a)
    words_b, grams_b = known.title(text_b)
    if not words_a or not words_b:
        return False
    if words_a == words_b and mark_a == mark_b:
        contained, verdict, missing = 1.0, "same", 0
    else:
        contained = len(grams_a & grams_b) / min(len(grams_a), len(grams_b))
        if contained < 0.6:
            return False
        verdict, missing = known.compared(text_a, text_b)
    if verdict == "other":
        return False
    if mark_a != mark_b and not (verdict == "cut" and (len(words_a) < len(words_b)) == (len(mark_a) < len(mark_b)) and not (mark_a and mark_b)):
        return False
    agree = authors()
    if agree is False:
        return False
    year_a, year_b = _valid_year(year_a), _valid_year(year_b)
    same_year = year_a is not None and year_a == year_b
    if max(len(words_a), len(words_b)) <= 3:
        return verdict == "same" and same_year and same_venue and agree is True
    support = same_year + same_venue + (agree is True)
    if verdict == "same":
        return support >= 1
    if verdict == "less":
        return missing <= 2 and contained >= 0.75 and support >= 2
    if contained < 0.75:
        return False
    # a long beginning by the same author, where no year speaks against it, needs no further support
    long_beginning = agree is True and min(len(grams_a), len(grams_b)) >= LONG_BEGINNING and (same_year or year_a is None or year_b is None)
    return long_beginning or (support >= 2 and min(len(grams_a), len(grams_b)) >= 8)


_CONTENT = ("title", "authors", "venue", "year")
_SIDES = ("words", "mark", "authors", "year", "entity")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Known()
    for batch in batches:
        (wa, ma, aa, ya, ea), (wb, mb, ab, yb, eb) = ([batch.column(f"{c}_{x}").to_pylist() for c in _SIDES] for x in "ab")
        venue = batch.column("same_venue").to_pylist()
        agree = lambda k: lambda: _authors_agree(known.name(aa[k]), known.name(ab[k]), ea[k], eb[k])  # noqa: B023, E731
        yes = pa.array([same_publication(wa[k], ma[k], wb[k], mb[k], agree(k), ya[k], yb[k], venue[k], known) for k in range(batch.num_rows)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(yes), batch.column("b").filter(yes)], ["a", "b"])


def _coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The phonetic code of each spelling's family name."""
    for pdf in batches:
        yield pdf.assign(code=[(p[0] + phonetic(p[2])) if p else None for p in map(parse, pdf["authors"])])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what split_title finds, the words in one text; every later step reads it."""
    for batch in batches:
        parts = [split_title(t) for t in batch.column("title").to_pylist()]
        added = [pa.array([" ".join(p[0]) for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string()), pa.array([p[2] for p in parts], pa.bool_())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "words", "mark", "cut"])


def group_publications(results: DataFrame, venue_list: DataFrame) -> DataFrame:
    """row_id, publication (its smallest row_id), mark and venue_id of each ungrouped row that belongs with another one."""
    spark = results.sparkSession
    space = Workspace(spark, "records")
    rows = results.where("cluster_id is null and row_id is not null").select("row_id", "feed", "id", "title", "authors", "venue", "year")
    reps = rows.groupBy(*_CONTENT).agg(F.min("row_id").alias("rep"))
    names, mapped = space.write(link_names(results).mapInPandas(_coded, "authors string, entity long, code string")), space.write(map_venues(results, venue_list))
    # an author's spellings meet under the code that most of them have
    names = names.join(names.groupBy("entity").agg(F.mode("code", True).alias("main")), "entity")
    listed = results.select("row_id", "venue").join(venue_list.select(F.explode(F.array("venue_name", "short_name")).alias("venue"), "venue_id").groupBy("venue").agg(F.min("venue_id").alias("venue_id")), "venue").select("row_id", "venue_id")
    reps = reps.join(names, "authors", "left").join(mapped.unionByName(listed).withColumnRenamed("row_id", "rep"), "rep", "left")
    reps = reps.select("rep", "title", "authors", "venue", "year", "entity", "venue_id", "code", "main").repartition(parallelism(spark))
    reps = space.write(reps.mapInArrow(_split, ", ".join(f"{c} {kind}" for c, kind in reps.dtypes) + ", words string, mark string, cut boolean"))
    bands, strict = bands_for(LEAST_SIMILARITY, BAND_ROWS, TARGET_RECALL), bands_for(STRICT_SIMILARITY, STRICT_ROWS, TARGET_RECALL)
    keyed = space.write(reps.select("rep", "words", "code", "main").mapInArrow(_keyed(bands, strict), "rep long, side int, key long"))
    by_author, lone_strict, others = (keyed.where(c).select("key", "rep") for c in ("side = 0", "side = 1", "side > 0"))
    one, two = (lambda df: df.withColumnRenamed("rep", "a")), (lambda df: df.withColumnRenamed("rep", "b"))
    ordered = lambda df: df.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    one_way = meet(space, one(by_author), two(by_author), "key", "a").where("a < b").select("a", "b")
    # records without an author are few: their keys are written, those of all records only pass by
    seconded = lambda df: df.select("rep", "words", "venue", "venue_id", "year").mapInArrow(_seconded(bands), "rep long, key long")
    lone = space.write(seconded(reps.where("code is null")))
    pairs = one_way.unionByName(ordered(meet(space, one(others), two(lone_strict), "key", "a"))).unionByName(ordered(meet(space, one(seconded(reps)), two(lone), "key", "a"))).distinct()
    side = lambda s: reps.select(F.col("rep").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in (*_SIDES, "venue", "venue_id")))
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    # what needs no look at the words is decided here: two listed venues that differ, and pairs that neither year nor venue nor authors can support
    listed_a, listed_b = F.coalesce(F.col("venue_id_a") > 0, F.lit(False)), F.coalesce(F.col("venue_id_b") > 0, F.lit(False))
    same_venue = (listed_a & listed_b) | F.coalesce((F.length("venue_a") > 3) & (F.col("venue_a") == F.col("venue_b")), F.lit(False))
    supported = same_venue | F.coalesce(_full_year("year_a") == _full_year("year_b"), F.lit(False)) | (F.col("authors_a").isNotNull() & F.col("authors_b").isNotNull())
    full = full.where(~(listed_a & listed_b & (F.col("venue_id_a") != F.col("venue_id_b"))) & supported)
    full = full.select("a", "b", *(f"{c}_{x}" for x in "ab" for c in _SIDES), same_venue.alias("same_venue"))
    accepted = full.repartition(parallelism(spark)).mapInArrow(_verify, "a long, b long")
    of = reps.select(F.col("rep"), *(F.col(c).alias(f"{c}_rep") for c in _CONTENT))
    same = [rows[c].eqNullSafe(of[f"{c}_rep"]) for c in _CONTENT]
    rows = space.write(rows.join(of, same[0] & same[1] & same[2] & same[3]).select("row_id", "rep", "feed", "id"))
    delivered = rows.where("feed is not null and id is not null").select("feed", "id", "rep").distinct()
    delivered = delivered.join(delivered.groupBy("feed", "id").agg(F.min("rep").alias("a")), ["feed", "id"]).where("a != rep").select("a", F.col("rep").alias("b"))
    edges = space.write(accepted.unionByName(delivered).distinct())
    clusters = connected_components(edges, "a", "b", workspace=space).select(F.col("node").alias("rep"), F.col("component").alias("publication"))
    titled = F.col("words") != ""
    about = reps.select("rep", "entity", F.when(F.col("venue_id") > 0, F.col("venue_id")).alias("venue_id"), _full_year("year").alias("year"), F.when(titled & ~F.col("cut"), F.col("mark")).alias("mark"), titled.alias("titled")).join(clusters, "rep", "left")
    about = space.write(about.withColumn("publication", F.coalesce("publication", "rep")))
    about = about.join(_untitled(about), "publication", "left").withColumn("publication", F.coalesce("titled_one", "publication"))
    return rows.join(about, "rep").select("row_id", "feed", "id", "publication", "mark", "venue_id")


def _untitled(about: DataFrame) -> DataFrame:
    """publication and titled_one: records without a title go to the one titled publication of the same author and venue or year, where there is but one."""
    titled = about.where("titled").select("publication").distinct()
    lost = about.where("entity is not null").join(titled, "publication", "left_anti").groupBy("publication").agg(F.first("entity").alias("entity"), F.min("venue_id").alias("venue_id"), F.min("year").alias("year"))
    known = about.where("titled and entity is not null").select(F.col("publication").alias("one"), "entity", "venue_id", "year").distinct()
    found = lost
    for k, keys in enumerate((["entity", "venue_id", "year"], ["entity", "venue_id"], ["entity", "year"])):
        only = known.dropna(subset=keys).groupBy(*keys).agg(F.min("one").alias(f"one_{k}"), F.max("one").alias("last")).where(f"one_{k} = last").drop("last")
        found = found.join(only, keys, "left")
    return found.select("publication", F.coalesce("one_0", "one_1", F.when(F.col("venue_id").isNull(), F.col("one_2"))).alias("titled_one")).where("titled_one is not null")


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ungrouped record that belongs with another one: row_id and publication, its class."""
    return group_publications(table(spark, sf_dir, "results"), table(spark, sf_dir, "venue_list")).select("row_id", "publication")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = Workspace(spark, "record-pairs").write(group_publications(table(spark, sf_dir, "results"), table(spark, sf_dir, "venue_list")))
    side = lambda k: grouped.select("publication", *(F.col(c).alias(f"{c}_{k}") for c in ("row_id", "feed", "id", "mark", "venue_id")))
    pairs = side(1).join(side(2), "publication").where("row_id_1 < row_id_2")
    again = (F.col("feed_1") == F.col("feed_2")) & (F.col("id_1") == F.col("id_2"))
    marks = F.col("mark_1").isNull() | F.col("mark_2").isNull() | (F.col("mark_1") == F.col("mark_2"))
    venues = F.coalesce("venue_id_1", F.lit(-1)).isin(-1) | F.coalesce("venue_id_2", F.lit(-1)).isin(-1) | (F.col("venue_id_1") == F.col("venue_id_2"))
    return pairs.where(F.coalesce(again, F.lit(False)) | (marks & venues)).select("row_id_1", "row_id_2")

import datetime
import random

import numpy as np
import pytest
from kinsift.llm import names, records, vectors, venues
from kinsift.llm.components import connected_components, group_records
from kinsift.llm.survivors import FIELDS, LEVELS, learn_quality, retained_values, surviving_fields
from kinsift.llm.vectors import DIMENSIONS, K, nearest_vectors
from pyspark.sql import functions as F

RESULT = "id int, title string, authors string, venue string, year int, row_id long, cluster_id long, feed string, loaded_at timestamp"
NOW = datetime.datetime(2024, 1, 1)


def results(spark, rows):
    """(row_id, title, authors, venue, year, cluster_id, feed, id)"""
    full = [(i, t, a, v, y, r, c, f, NOW + datetime.timedelta(days=r)) for r, t, a, v, y, c, f, i in rows]
    return spark.createDataFrame(full, RESULT).selectExpr("*", "1 AS rep", "2 AS entity", "'x' AS form", "3 AS group_id", "4 AS value")


VENUES = [(1, "Review of Ambient Registers", "RAR", "Review"), (2, "Workshop on Elastic Methods", "WEM", "Workshop"), (3, "Review of Modular Registers", "RMR", "Review")]


@pytest.fixture(scope="module")
def listed(spark):
    return spark.createDataFrame(VENUES, "venue_id int, venue_name string, short_name string, kind string").selectExpr("*", "1 AS form", "2 AS row_id")


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("bound", [1_000_000, 40])
def test_components_against_brute_force(spark, bound):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 520)] + [(600, k) for k in range(601, 700)] + [(5, 5), (None, 3), (9, None), (2, 1), (1, 2)]
    df = spark.createDataFrame(edges, "src_id long, dst_id long").selectExpr("*", "1 AS node", "2 AS root")
    assert {r.node: r.component for r in connected_components(df, edges_per_partition=bound).collect()} == brute(edges)
    assert connected_components(df.limit(0)).count() == 0


def test_no_partition_gets_more_edges_than_the_bound(spark, monkeypatch, tmp_path):
    """Every level writes down the edges of each partition; the last one may be a single task only within the bound."""
    from kinsift.llm import components

    forest, bound, folder = components._forest, 1000, str(tmp_path)

    def watched(level, batch_edges):
        inner = forest(level, batch_edges)

        def run(batches):
            import os

            from pyspark import TaskContext

            held = list(batches)
            part = TaskContext.get().partitionId()
            with open(os.path.join(folder, f"{level}-{part}"), "w") as f:
                f.write(str(sum(b.num_rows for b in held)))
            yield from inner(iter(held))

        return run

    monkeypatch.setattr(components, "_forest", watched)
    rng = random.Random(3)
    edges = [(rng.randrange(20_000), rng.randrange(20_000)) for _ in range(15_000)] + [(k, k + 1) for k in range(30_000, 36_000)] + [(40_000, k) for k in range(40_001, 46_000)]
    df = spark.createDataFrame(edges, "src_id long, dst_id long")
    got = {r.node: r.component for r in connected_components(df, edges_per_partition=bound).collect()}
    assert got == brute(edges)
    sizes = {}
    for f in tmp_path.iterdir():
        level, _ = f.name.split("-")
        sizes.setdefault(int(level), []).append(int(f.read_text()))
    assert len(sizes) > 3 and len(sizes[0]) > 20 and len(sizes[max(sizes)]) == 1
    assert max(n for level in sizes.values() for n in level) <= bound


def test_ids_that_are_no_record_link_nothing(spark):
    pairs = spark.createDataFrame([(1, 99), (99, 2), (3, 4), (4, 3), (4, 4), (None, 1)], "src_id long, dst_id long")
    rows = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 4, None)], "row_id long")
    assert sorted(map(tuple, group_records(pairs, rows).collect())) == [(3, 3), (4, 3)]


def test_jaro_winkler():
    got = names.jaro_winkler(["martha", "dixon", "", "a", "abc"], ["marhta", "dicksonx", "", "", "abc"])
    assert got == pytest.approx([0.9611, 0.8133, 1.0, 0.0, 1.0], abs=1e-4)


@pytest.mark.parametrize(
    ("text", "parsed"),
    [("Dr. Ada B. Hill", ("p", "u", "hill", "ada", "b")), ("HILL, Ada", ("p", "k", "hill", "ada", "")), ("A.B. Hill", ("p", "k", "hill", "a", "b")), ("Hill AB", ("p", "k", "hill", "a", "b")), ("Hill, A. B., PhD", ("p", "k", "hill", "a", "b")), ("Híll MR", ("p", "k", "hill", "m", "r")),
     ("The Oslo Institute of Rural Health", ("o", "k", "oslo", "rural health", "")), ("Rura. Health Inst., Oslo", ("o", "k", "oslo", "rura health", "")), ("N/A", None), (" ", None)],
)
def test_names_are_parsed(text, parsed):
    assert names.parse(text) == parsed


def test_spellings_are_linked(spark):
    same = ["Robert Klarpilova", "Klarpilova, Robert", "KLARPILOVA, Robert", "Bob Klarpilova", "R. Klarpilova", "Dr. Robert T. Klarpilova", "Robert Klarpiolva", "Klarpilova Robert", "Robert Klarpilóva et al.", "Klarpilova RT"]
    apart = ["Walid Klarpilova", "Robert Sturmund", "Institute for Rural Health, Oslo", "Institute for Rural Health, Bergen", "Institute for Legal Studies, Oslo"]
    ambiguous = ["Greta Zonmund", "Gina Zonmund", "G. Zonmund"]
    org = ["The Oslo Institute of Rural Health", "Rura. Health Inst., Oslo", "Institute for Rural Health (Oslo)"]
    rows = [(k, "t", a, "v", 2000, None, "f", k) for k, a in enumerate([*same, *apart, *ambiguous, *org, *same, None, "", "N/A", "unknown", "x" * 50_000, "Klarpilova, Walid"])]
    entity = {r.authors: r.entity for r in names.link_names(results(spark, rows)).collect()}
    assert len({entity[a] for a in same}) == 1
    assert {entity[a] for a in org} == {entity["Institute for Rural Health, Oslo"]}
    assert len({entity[a] for a in [same[0], *apart]}) == 6 and len({entity[a] for a in ambiguous}) == 3
    assert not {"", "N/A", "unknown", None} & set(entity)
    assert names.link_names(results(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("others", [0, 6, 600])
def test_slips_in_given_names_stay_linked_however_many_families_have_them(spark, others):
    same = ["Michael Klarpilova", "Klarpilova, Michael", "Klarpilova, Micheal"]
    letters = "bcdfghjklm"
    families = ["".join(letters[int(d)] + "a" for d in f"{k:03d}") + "vek" for k in range(others)]
    rest = [f"{f}, {g}" for f in families for g in ("Michael", "Micheal")]
    # names of their own that are alike meet in one family by chance
    apart = ["Klarpilova, Darya", "Klarpilova, Dario", *(f"{f}, {g}" for k, f in enumerate(families) for g in (["Darya"] if k % 2 else ["Dario"]))]
    rows = [(k, "t", a, "v", 2000, None, "f", k) for k, a in enumerate([*same, *rest, *apart])]
    entity = {r.authors: r.entity for r in names.link_names(results(spark, rows)).collect()}
    assert len({entity[a] for a in same}) == 1
    if others:
        assert entity["Klarpilova, Darya"] != entity["Klarpilova, Dario"]


def test_initials_that_fit_no_full_form_are_compared(spark):
    same, apart = ["J. Klarpilova", "Klarpiolva, J.", "Klarpilova, J. M."], ["W. Klarpilova", "J. Sturmund"]
    rows = [(k, "t", a, "v", 2000, None, "f", k) for k, a in enumerate([*same, *apart])]
    entity = {r.authors: r.entity for r in names.link_names(results(spark, rows)).collect()}
    assert len({entity[a] for a in same}) == 1 and len({entity[a] for a in [same[0], *apart]}) == 3


def test_organisations_of_other_kinds(spark):
    groups = [["University of Oslo", "Oslo University", "Univ. of Oslo", "The University of Oslo"], ["Acme Research GmbH", "ACME Research", "Acme Reserach GmbH"][::2], ["Oslo Institute of Rural Health"], ["University of Bergen"], ["Bergen College"], ["Anna Min", "A. Min"], ["Blashasarek AG", "Anthony G. Blashasarek"]]
    rows = [(k, "t", a, "v", 2000, None, "f", k) for k, a in enumerate(a for g in groups for a in g)]
    entity = {r.authors: r.entity for r in names.link_names(results(spark, rows)).collect()}
    for g in groups:
        assert len({entity[a] for a in g}) == 1, g
    assert len({entity[g[0]] for g in groups}) == len(groups)


def test_split_keys_lose_no_pair(spark):
    from kinsift.llm.common import Workspace, meet

    rng = random.Random(8)
    rows = [(k, "hot" if rng.random() < 0.4 else f"k{rng.randrange(30)}") for k in range(400)]
    a, b = spark.createDataFrame(rows, "a long, key string"), spark.createDataFrame(rows, "b long, key string")
    plain = sorted(map(tuple, a.join(b, "key").select("a", "b").collect()))
    assert sorted(map(tuple, meet(Workspace(spark, "meet"), a, b, "key", "a", key_rows=7).select("a", "b").collect())) == plain


def test_venues_are_mapped(spark, listed):
    cases = {
        "review of ambient registers": 1, "The Review of Ambient Registers, vol. 3": 1, "Ambient Registers (Review)": 1, "Ambient Registers, Review of": 1, "Rev. Ambient Reg.": 1, "RAR: Review of Ambient Registers": 1, "rar2003": 1, "Proc. RAR": 1, "RAR'20": 1,
        "Reivew of Ambient Registers": 1, "Wkshp Elastic Meth., 2019": 2, "Int. Wkshp on Elastic Methods": 2, "Workshop_on_Elastic_Methods": 2, "Journal of Ambient Registers": -1, "Review of Elastic Registers": -1, "submitted": -1, "XYZ": -1, "N/A": -1, "a" * 20_000: -1,
    }
    rows = [(k, "t", "a", v, 2000, None, "f", k) for k, v in enumerate([*cases, *cases, None, "", "  ", "RAR", "Review of Ambient Registers"])]
    typed = results(spark, rows)
    got = sorted(map(tuple, venues.map_venues(typed, listed).collect()))
    assert got == [(k, v) for k, v in enumerate([*cases.values()] * 2)]
    assert venues.map_venues(typed.limit(0), listed).count() == 0
    assert {r.venue_id for r in venues.map_venues(typed, listed.limit(0)).collect()} == {-1}


def test_abbreviations_come_from_the_list_itself(spark):
    entries = [(7, "Bulletin of Zoological Glaciers", "BZG", "Bulletin"), (8, "Bulletin of Zoological Gardens", "BZGA", "Bulletin"), (9, "Symposium on Maritime Ceramics", "SMC", "Symposium")]
    venue_list = spark.createDataFrame(entries, "venue_id int, venue_name string, short_name string, kind string")
    cases = {"Bull. Zool. Glac.": 7, "Bull Zoological Gard": 8, "Symp. Marit. Ceram., 2011": 9, "Bull. Zool. Gl.": -1, "Bulle. Zolo. Gla.": 7, "Bull. Zool. G.": -1, "Bull. Zool. Xyl.": -1, "Marit. Ceram.": -1, "Cer.": -1}
    rows = [(k, "t", "a", v, 2000, None, "f", k) for k, v in enumerate(cases)]
    got = {r.row_id: r.venue_id for r in venues.map_venues(results(spark, rows), venue_list).collect()}
    assert {v: got[k] for k, v in enumerate(cases)} == cases


def test_near_duplicates(spark, listed):
    t = "Temporal Matching of Tax Records under Adversarial Input"
    rows = [
        (1, t, "Wanda Drulkerokek", "RAR", 2020, None, "f", 1), (2, t.upper() + " [pdf]", "Drulkerokek, W.", "Review of Ambient Registers", 2020, None, "g", 2), (3, "Temporal Matchign of Tax Recor...", "Wanda Drulkerokek", "RAR", None, None, "h", 3),
        (4, t + ", Part 2", "Wanda Drulkerokek", "RAR", 2020, None, "f", 4), (5, t.replace("Tax", "Court"), "Wanda Drulkerokek", "RAR", 2020, None, "f", 5), (6, t, "Hugo Sturmund", "WEM", 2020, None, "f", 6), (7, t, None, "RAR", 2020, None, "f", 7),
        (8, None, "X Y", None, None, None, "f", 1), (9, t, "Wanda Drulkerokek", "RAR", 2020, 77, "f", 9), (10, "", None, None, None, None, None, None), (11, "Preface", "Wanda Drulkerokek", "RAR", 2020, None, "f", 11), (12, "Preface", "Wanda Drulkerokek", "RAR", 2019, None, "f", 12),
        (13, "w " * 30_000, "Z Q", "RAR", 2020, None, "f", 13), (14, t, "Wanda Drulkerokek", "RAR", 2020, None, "f", 14),
    ]
    typed = results(spark, rows)
    one = records.group_publications(typed, listed)
    groups = {}
    for r in one.collect():
        groups.setdefault(r.publication, set()).add(r.row_id)
    assert {1, 2, 3, 7, 8, 14} in groups.values()
    for alone in (4, 5, 6, 11, 12, 13):
        assert {alone} in groups.values()
    assert records.group_publications(typed.limit(0), listed).count() == 0
    assert records.bands_for(0.8, 4, 0.95) == 6
    sets = [{str(x) for x in range(100)}, {str(x) for x in range(20, 120)}]
    s = records.signatures(sets, 400)
    assert abs((s[0] == s[1]).mean() - 80 / 120) < 0.08


def test_survivors(spark):
    good, damaged = "Robust Caching of River Gauges", "Rob�st Caching of River Gauges"
    rows = [
        (1, good.upper(), "a", "WEM", 2999, 5, "f", 1), (2, damaged, "a", "WEM 2019", 2019, 5, "g", 2), (3, good, "a", None, None, 5, "h", 3), (4, good + " [pdf]", "a", "WEM", 2018, 5, "i", 4), (5, good, "a", "WEM", 2018, 5, "k", 5), (12, good, "a", "wem2019", None, 5, "l", 12),
        (6, "Untitled", "a", None, None, 6, "f", 6), (7, None, "a", None, None, 6, "f", 7), (8, good, "a", None, 2000, 7, "f", 8), (9, good, "a", None, 2000, None, "f", 9), (10, "x" * 40_000, "a", None, 7, 8, None, None), (11, "x" * 40_000, "a", None, 7, 8, None, None),
    ]
    feeds = spark.createDataFrame([(f,) for f in "fghikl"], "feed string")
    got = {r.cluster_id: (r.title_row_id, r.year_row_id) for r in surviving_fields(results(spark, rows), feeds).collect()}
    assert got == {5: (3, 2), 6: (None, None), 8: (10, 10)}
    assert surviving_fields(results(spark, rows).limit(0), feeds).count() == 0
    # without any listed feed all of them share one entry
    assert {r.cluster_id: r.title_row_id for r in surviving_fields(results(spark, rows), feeds.limit(0)).collect()}[5] == 3
    kept = {(r.cluster_id, r.field, r.value): r.survives for r in retained_values(results(spark, rows), feeds).collect()}
    assert kept[5, "title", good] and kept[5, "year", "2019"] and (5, "title", damaged) not in kept and (5, "year", "2999") not in kept


def test_several_true_values_of_a_field_are_retained(spark):
    title, other = "Robust Caching of River Gauges", "Caching River Gauges Robustly"
    rows = [(k, t, "a", None, 2010, 1, f"f{k % 6}", k) for k, t in enumerate([title, other] * 6)]
    # many plain groups besides, so that sources are known
    rows += [(100 + 3 * g + k, f"Plain title number {chr(97 + g % 26)} of words", "a", None, 2000 + g % 20, 100 + g, f"f{k}", 1000 + 3 * g + k) for g in range(30) for k in range(3)]
    feeds = spark.createDataFrame([(f"f{k}",) for k in range(6)], "feed string")
    kept = {r.value: r.survives for r in retained_values(results(spark, rows), feeds).where("cluster_id = 1 and field = 'title'").collect()}
    assert set(kept) == {title, other} and sorted(kept.values()) == [False, True]


def test_better_sources_and_signs_are_recognised(spark):
    rng = random.Random(5)
    quality = (0.95, 0.8, 0.3, 0.2)
    rows = [(g, "true" if rng.random() < right else f"wrong{rng.randrange(3)}", s) for g in range(150) for s, right in enumerate(quality)]
    claims = spark.createDataFrame(rows, "group_id long, value string, source int").groupBy("group_id", "value", "source").agg(F.count("*").cast("double").alias("n"))
    pack = lambda c: F.collect_list(F.struct("source", "n")).alias(c)
    of = claims.groupBy("group_id", "source").agg(F.sum("n").alias("n")).groupBy("group_id").agg(pack("of"))
    # the first sign shows on false values mostly, the second one on any
    first = F.when(F.col("value") != "true", (F.pmod(F.xxhash64("group_id", "value"), F.lit(10)) < 7).cast("int")).otherwise((F.pmod(F.xxhash64("group_id"), F.lit(20)) == 0).cast("int"))
    second = F.pmod(F.xxhash64(F.lit(1), "group_id", "value"), F.lit(2)).cast("int")
    rest = [F.lit(sum(LEVELS["title"][:k])) for k in range(2, len(LEVELS["title"]))]
    values = claims.groupBy("group_id", "value").agg(pack("claims")).join(of, "group_id").withColumn("field", F.lit(FIELDS[0])).withColumn("signs", F.array(first, F.lit(2) + second, *rest))
    q = learn_quality(values, len(quality))
    sensitivity = q.sensitivity[: len(quality)]
    assert sensitivity[0] > sensitivity[1] > max(sensitivity[2:])
    assert q.in_false[1] > 3 * q.in_true[1] and abs(q.in_false[3] - q.in_true[3]) < 0.15


def test_nearest_vectors_against_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, DIMENSIONS))
    x = (centres[rng.integers(0, 12, 900)] + 0.4 * rng.standard_normal((900, DIMENSIONS))).astype(np.float32)
    x[50:120] = x[50]  # equal vectors
    x[200:205] = 2 * x[200]
    rows = [(int(k), [float(v) for v in r]) for k, r in enumerate(x)]
    bad = [(2000, None), (2001, [0.0] * DIMENSIONS), (2002, [1.0] * 3), (2003, [float("nan")] * DIMENSIONS), (2004, [float("inf")] * DIMENSIONS), (None, [1.0] * DIMENSIONS), rows[7]]
    df = spark.createDataFrame(rows + bad, "row_id long, normFeatures array<float>").selectExpr("*", "1 AS rep", "2 AS v", "3 AS part")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.rint(u @ u.T * 1e9)
    np.fill_diagonal(s, -1e18)
    truth = {(i, int(j)) for i in range(900) for j in np.lexsort((np.arange(900), -s[i]))[:K]}
    for size, block in ((10_000, 4096), (64, 4096), (64, 20)):
        got = {(r.row_id, r.neighbour) for r in nearest_vectors(df, part_size=size, point_block=block, query_block=50).collect()}
        assert len(got) == 900 * K
        assert len(got & truth) / len(truth) >= (1.0 if size == 10_000 else 0.9)
    assert nearest_vectors(df.limit(0)).count() == 0 and nearest_vectors(df.limit(1)).count() == 0
    assert sorted((r.row_id, r.neighbour) for r in nearest_vectors(df.limit(2)).collect()) == [(0, 1), (1, 0)]


def test_a_vector_is_sent_once_to_parts_that_are_searched_together(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((6, DIMENSIONS))
    x = (centres[np.arange(1200) % 6] + 0.5 * rng.standard_normal((1200, DIMENSIONS))).astype(np.float32)
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "row_id long, normFeatures array<float>")

    search, log = vectors._search, str(tmp_path / "log")

    def counted(group):
        with open(log, "a") as f:
            f.write(f"{group.num_rows}\n")
        return search(group)

    monkeypatch.setattr(vectors, "_search", counted)
    pairs = lambda: {(r.row_id, r.neighbour, r.cosine) for r in nearest_vectors(df, part_size=20).collect()}
    got = pairs()
    # each vector searches three parts at least, so parts by themselves get four copies
    assert sum(map(int, (tmp_path / "log").read_text().split())) < 3 * len(x)
    monkeypatch.setattr(vectors, "group_parts", lambda sample, router, width: np.arange(router[1].shape[1]))
    assert got == pairs()

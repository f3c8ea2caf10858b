"""The scoring queries over stored texts, against brute force in code points."""

import statistics

import pytest

from kinsift.plans import catalog

ROWS = [
    (1, 2, 0.1, "Étude des données", "Etude des donnees", "Revue française", "Revue française", 2001, 2001),
    (1, 3, 0.2, "深度学习综述", "深度学习综述", "计算机学报", "计算机学报", 2010, 2010),
    (2, 3, 0.3, "Обзор графов", "Обзор графа", "Вестник", "Vestnik", 1999, 1998),
    (None, 4, 0.1, "Zürich naïve façade", "Zurich naive facade", "Über", "Über", 2005, 2005),
    (5, None, None, "plain title", "plain titles", None, "VLDB", None, 2003),
    (6, 7, 0.4, "", "   ", None, None, None, None),
]
KEYS = ["title", "venue", "year"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(a, b, missing):
    a, b = (str(missing if x is None else x).strip() for x in (a, b))
    return max(0.0, 1 - edits(a.lower(), b.lower()) / max(len(a), len(b))) if a and b else 0.0


def scores(missing):
    return [(r[0], r[1], *(brute(r[3 + 2 * k], r[4 + 2 * k], missing) for k in range(3))) for r in ROWS]


def rounded(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def ask(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pairs"))
    spark.createDataFrame(ROWS, "src_id long, dst_id long, distance double, title_l string, title_r string, venue_l string, venue_r string, year_l int, year_r int").write.parquet(f"{d}/candidate_pairs.parquet")
    return lambda query: [tuple(r) for r in catalog.queries()[query](spark, d).collect()]


@pytest.mark.parametrize(("query", "missing"), [("lev_similarity", "nan"), ("lev_missing_zero", "")])
def test_similarities(ask, query, missing):
    assert rounded(ask(query)) == rounded(scores(missing))


def test_what_follows_from_them(ask):
    all_scores = scores("nan")
    passes = lambda r: [r[2 + k] >= catalog.THRESHOLDS[a] for k, a in enumerate(KEYS)]
    assert rounded(ask("attribute_thresholds")) == rounded([r[:2] for r in all_scores if all(passes(r))])
    assert rounded(ask("overall_similarity")) == rounded([(*r[:2], sum(r[2 + k] * catalog.WEIGHTS[a] for k, a in enumerate(KEYS))) for r in all_scores])
    passed = {a: sum(passes(r)[k] for r in all_scores) for k, a in enumerate(KEYS)} | {"overall": sum(all(passes(r)) for r in all_scores)}
    assert {r[0]: r[1:3] for r in ask("pass_rates")} == {a: (n, len(ROWS)) for a, n in passed.items()}
    columns = {a: [r[2 + k] for r in all_scores] for k, a in enumerate(KEYS)}
    assert rounded(ask("similarity_stats")) == rounded([(a, statistics.mean(c), statistics.stdev(c), min(c), max(c), statistics.median(c), len(c)) for a, c in columns.items()])

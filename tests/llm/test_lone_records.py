import datetime

import pytest
from kinsift.llm import records

RESULT = "id int, title string, authors string, venue string, year int, row_id long, cluster_id long, feed string, loaded_at timestamp"
FULL = "Caching Football Statistics without Central Servers in Crowded Stadiums"


@pytest.mark.parametrize("other_author", [None, "Ada Hill"])
def test_a_cut_title_without_author_meets_its_full_form(spark, other_author):
    rows = [
        (1, "Caching Football Statistics wit…", None, "Review of Ambient Registers", 2010),
        (2, FULL, other_author, "Review of Ambient Registers", 2010),
        (3, "Grading Copper Alloys under Moving Loads", None, "Review of Ambient Registers", 2010),
        (4, FULL, None, "Workshop on Elastic Methods", 2003),
    ]
    df = spark.createDataFrame([(r, t, a, v, y, r, None, "f", datetime.datetime(2024, 1, 1)) for r, t, a, v, y in rows], RESULT)
    listed = spark.createDataFrame([(1, "Review of Ambient Registers", "RAR", "Review"), (2, "Workshop on Elastic Methods", "WEM", "Workshop")], "venue_id int, venue_name string, short_name string, kind string")
    found = {r.row_id: r.publication for r in records.group_publications(df, listed).collect()}
    assert found[1] == found[2] == 1
    assert found.get(3, 3) == 3 and found.get(4, 4) == 4


def test_a_title_is_split_once(spark, monkeypatch, tmp_path):
    def counted(title, split=records.split_title, log=str(tmp_path / "log")):
        with open(log, "a") as f:
            f.write("1\n")
        return split(title)

    monkeypatch.setattr(records, "split_title", counted)
    rows = [(r, FULL + mark, "Ada Hill", None, 2010, r, None, "f", datetime.datetime(2024, 1, 1)) for r, mark in enumerate(["", ".", " [pdf]", ", Part 2", ", Part 2 [pdf]"])]
    listed = spark.createDataFrame([], "venue_id int, venue_name string, short_name string, kind string")
    found = {r.row_id: (r.publication, r.mark) for r in records.group_publications(spark.createDataFrame(rows, RESULT), listed).collect()}
    assert found == {0: (0, ""), 1: (0, ""), 2: (0, ""), 3: (3, "part2"), 4: (3, "part2")}
    assert len((tmp_path / "log").read_text().split()) == len(rows)

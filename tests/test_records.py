from types import SimpleNamespace

import pytest

from kinsift.functions.columns import blocking_key, edit_similarity, hashed_ngrams, name_variants, title_variants, unit
from kinsift.operators import blocking
from kinsift.operators.embedding import batch_embedder, hashed_embedder, model_embedder, named_embedder, with_features
from kinsift.operators.workspace import dense_index, shared_dir
from kinsift.sources import records
from pyspark.sql import functions as F


def one(df):
    return df.first()[0]


def test_features_leave_out_names_that_end_in_id(spark):
    df = spark.createDataFrame([(1, "a", 2, "x", 3)], "id int, title string, paid int, grid string, year int")
    assert records.detect_features(df) == ["title", "year"]


def test_row_ids_are_dense_and_replace_old_ones(spark):
    df = spark.createDataFrame([(k * 7 % 50, "x", 99) for k in range(50)], "k int, t string, row_id int")
    rows = records.assign_row_id(df, "k").orderBy("k").collect()
    assert [r.row_id for r in rows] == list(range(50))
    assert records.assign_row_id(df.limit(0), "k").count() == 0


def test_dense_index_with_ties_and_start(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int")
    assert sorted(r.n for r in dense_index(df, "k", name="n", start=5).collect()) == [5, 6, 7, 8]


def test_csv_round_trip_and_missing_values(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"'), (2, "NA"), (3, None)], "id int, t string")
    records.save_records(df, str(tmp_path / "t"), single_file=True)
    file = next((tmp_path / "t").glob("*.csv"))
    back = {r.id: r.t for r in records.load_records(spark, str(file)).collect()}
    assert back == {1: 'a,"b"', 2: None, 3: None}
    with pytest.raises(FileNotFoundError):
        records.load_records(spark, str(tmp_path / "no.csv"))
    with pytest.raises(ValueError):
        records.save_records(None, "x")


def test_what_was_saved_is_read_back(spark, tmp_path):
    df = spark.createDataFrame([(k, f'a "{k}"', None if k == 3 else "x") for k in range(20)], "id int, t string, u string")
    for name in ("rows", "rows.parquet", "plain"):
        records.save_records(df.repartition(3), str(tmp_path / name))
        assert sorted(map(tuple, records.load_records(spark, str(tmp_path / name)).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    df.write.parquet(str(tmp_path / "unnamed"))
    assert records.load_records(spark, str(tmp_path / "unnamed")).count() == 20


def test_row_ids_by_position_replace_old_ones(spark, tmp_path):
    lines = [f"{k * 7 % 50},{k},99" for k in range(50)]
    (tmp_path / "in.csv").write_text("k,place,row_id\n" + "\n".join(lines) + "\n")
    rows = records.assign_row_id(records.load_records(spark, str(tmp_path / "in.csv"))).collect()
    assert len(rows) == 50 and all(r.row_id == r.place for r in rows)
    made = spark.range(30).coalesce(1).selectExpr("id AS n", "5 AS row_id")
    assert all(r.row_id == r.n for r in records.assign_row_id(made).collect())


def test_a_model_is_loaded_once_a_task(spark, tmp_path):
    seen = str(tmp_path / "loads")

    def load():
        with open(seen, "a") as f:
            f.write("x")
        return lambda texts: [[len(t), 1] for t in texts]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        texts = spark.createDataFrame([("abc",), ("",), (None,), ("a",), ("b",)], "blockingKey string").coalesce(1)
        rows = with_features(texts, model_embedder(load)).select("features").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.features[0] for r in rows] == [3.0, 0.0, 0.0, 1.0, 1.0] and (tmp_path / "loads").read_text() == "x"
    assert with_features(texts, named_embedder("hashed:16")).first().features == with_features(texts, hashed_embedder(16)).first().features
    with pytest.raises(ValueError):
        named_embedder("nothing")


def test_shared_folder_is_required_on_a_cluster():
    def session(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: None, set=lambda k, v: None), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: None), _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))))

    assert shared_dir(session("local[4]")).startswith("file://")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))


def test_samples(spark):
    assert records.minimal_sample(spark).count() == 20
    made = records.synthetic_records(spark, 40, 10)
    assert made.count() == 40 and len(made.columns) == 24
    assert made.select("id").distinct().count() == 40
    assert sorted(map(str, made.collect())) == sorted(map(str, records.synthetic_records(spark, 40, 10).collect()))


def test_blocking_key_keeps_places_of_missing_values(spark):
    df = spark.createDataFrame([("a", None, 3)], "x string, y string, z int")
    assert one(df.select(blocking_key([F.col("x"), F.col("y"), F.col("z")]))) == "a||3"
    dotted = spark.createDataFrame([(1, "Oslo", "x")], "`id` int, `ns.City` string, other string")
    keyed = blocking.with_blocking_key(dotted, ["ns.City", "other"], 1)
    assert keyed.columns == ["ns#City", "other", "id", "blockingKey"] and keyed.first().blockingKey == "Oslo"
    with pytest.raises(ValueError):
        blocking.select_features(dotted, ["nothing"])
    with pytest.raises(KeyError):
        blocking.blocking_key_only(dotted.drop("id"), ["other"])


def test_attributes(spark):
    df = spark.createDataFrame([(1, "a", 2, "k")], "id int, title string, row_id int, blockingKey string")
    assert blocking.resolve_attributes(df, ["year", "title"]) == ["title"]
    assert blocking.resolve_attributes(df, ["year"]) == ["title"]
    assert blocking.match_attributes(["Title", "authors"], ["title", "author", "doi"]) == (["Title", "authors"], ["doi"])
    assert blocking.match_namespaced(["a_crm.city", "b"], ["_crm.City", "_crm.Zip"]) == (["a_crm.city"], ["_crm.Zip"])
    assert blocking.drop_blocking_columns(df).columns == ["id", "title", "row_id"]


@pytest.mark.parametrize(
    ("left", "right", "missing", "expected"),
    [("nips", "neurips", "nan", 1 - 3 / 7), (None, None, "nan", 1.0), (None, None, "zero", 0.0), (None, "nan", "nan", 1.0), ("", "a", "nan", 0.0), ("\t ", "a", "nan", 0.0), (" A ", "a", "nan", 1.0), ("é", "e", "nan", 0.0), ("İ", "x", "nan", 0.0)],
)
def test_edit_similarity(spark, left, right, missing, expected):
    df = spark.createDataFrame([(left, right)], "l string, r string")
    assert one(df.select(edit_similarity(F.col("l"), F.col("r"), missing))) == pytest.approx(expected)


def test_unit_vectors_and_embedders(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(unit(F.col("v"))).collect()] == [pytest.approx([0.6, 0.8]), [0.0, 0.0], None]
    texts = spark.createDataFrame([("Entity matching",), ("ab",), ("",), (None,)], "blockingKey string")
    rows = with_features(texts, hashed_embedder(16)).withColumn("hits", hashed_ngrams(F.col("blockingKey"), 3, 16)).collect()
    for r in rows:
        assert r.features == [float(r.hits.count(k)) for k in range(16)]
    assert with_features(texts, batch_embedder(lambda x: [[len(t), 1] for t in x])).first().features == [15.0, 1.0]


def test_variants(spark):
    df = spark.createDataFrame([("Ada Hill", "A Machine Learning Guide")], "n string, t string")
    assert one(df.select(name_variants(F.col("n"), F.lit("Q")))) == ["Ada Hill", "A. Hill", "Ada H.", "A. H.", "Hill, Ada", "Hill, A.", "Ada Q. Hill", "A. Q. Hill"]
    forms = one(df.select(title_variants(F.col("t"))))
    assert forms[:3] == ["A Machine Learning Guide", "A ML Guide", "Machine Learning Guide"] and forms[-1] == "Towards A Machine Learning Guide"

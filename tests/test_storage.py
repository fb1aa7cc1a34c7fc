from helixframe.operators.components import connected_components
from helixframe.storage import materialize, shared_dir


def test_shared_folder_is_the_sessions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: f"file://{tmp_path}/" if key == "spark.checkpoint.dir" else default)
    assert shared_dir(spark) == f"file://{tmp_path}"
    df = materialize(spark.range(5), "five")
    assert df.count() == 5 and len(list((tmp_path / "helixframe").iterdir())) == 1


def test_a_folder_of_its_own_only_where_none_is_set(spark):
    assert shared_dir(spark).startswith(("file:/", "/"))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    got = connected_components(edges).collect()
    assert {r["root"] for r in got} == {0} and len(got) == 200
    assert connected_components(edges.limit(0)).count() == 0

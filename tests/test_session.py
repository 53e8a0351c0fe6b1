import pathlib
import shutil
import subprocess
import sys

from lexweave import session

ROOT = pathlib.Path(session.__file__).parent.parent


def test_materialize_cuts_lineage_and_release_removes(spark):
    df = spark.range(10).selectExpr("id", "cast(null as string) AS s")
    got = session.materialize(df)
    assert got.schema.names == ["id", "s"] and got.count() == 10 and "Range" not in got._jdf.queryExecution().optimizedPlan().toString()
    files = got.inputFiles()
    assert files and all(f.startswith("file:") for f in files)
    session.release(spark)
    assert not any(pathlib.Path(f.removeprefix("file://")).exists() for f in files)


def test_small_inputs_are_dealt_out(spark):
    n = spark.sparkContext.defaultParallelism
    assert session.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == n
    assert session.spread(spark.range(10).repartition(n + 3)).rdd.getNumPartitions() >= n


def test_query_sets_are_whole(spark):
    df = spark.range(95).withColumnRenamed("id", "k")
    sets = list(session.in_sets(df, "k", 10))
    assert sorted(r["k"] for s in sets for r in s) == list(range(95)) and len(sets) <= 10
    assert all([r["k"] for r in s] == sorted(r["k"] for r in s) for s in sets)
    assert list(session.in_sets(df.limit(0), "k", 10)) == []


def test_the_rest_stands_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "lexweave", tmp_path / "lexweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'p1_found' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "", "PYTHONPATH": str(tmp_path)}, check=True)


def test_no_machine_local_folder_on_a_cluster():
    import pytest

    from lexweave import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        Context.master = master
        with pytest.raises(RuntimeError):
            session.shared_dir(Session())

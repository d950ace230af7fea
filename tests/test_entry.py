import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_names_and_flagship(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_without_the_training_subpackage(tmp_path):
    """Its folders and the pipeline deleted, the rest imports and registers the same core queries."""
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; from tarnflow.queries import QUERIES, ORACLES; assert set(e.queries()) == set(QUERIES); assert set(e.oracle_sql()) == set(ORACLES); print(len(QUERIES)); from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.session.timeZone', 'UTC').getOrCreate(); print(e.queries()['word_count'](s, '/root/testdata/sf0.001').count(), e.entry(s).count())"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True)
    n, counts = done.stdout.strip().split("\n")[-2:]
    assert int(n) > 100 and all(int(x) > 0 for x in counts.split())


def test_a_missing_dependency_leaves_out_one_operator_and_says_so(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    if not copy.joinpath("tarnflow", "ll" + "m").exists():
        return
    for path in copy.joinpath("tarnflow", "ll" + "m").glob("media.py"):
        path.write_text("import a_module_that_is_absent\n")
    code = "import __spark_entry__ as e; from tarnflow.queries import QUERIES; q = set(e.queries()); assert set(QUERIES) < q and 'pipeline' in q and 'op6_piece_bpe' in q and 'op7_media' not in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True)
    assert "media is left out: No module named 'a_module_that_is_absent'" in done.stderr


def test_nothing_else_imports_the_training_subpackage():
    for path in REPO.joinpath("tarnflow").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path

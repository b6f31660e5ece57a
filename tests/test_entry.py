"""The driver contract and independence from the corpus subpackage."""

import ast
import shutil
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_every_twin_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["campaign", "site", "position", "depth", "richness", "shannon", "hill1", "pielou"] and df.count() > 0


def test_queries_of_several_threads_share_one_archive(spark):
    spark.sparkContext._varve_shipped = False
    queries = __spark_entry__.queries()
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda _: queries["src_2_3_projected_scan"](spark, "/root/testdata/sf0.001").count(), range(4)))
    assert len(set(got)) == 1 and got[0] > 0


def test_rest_works_without_the_corpus_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "varve"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "varve" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_outside_imports_the_corpus_subpackage():
    for path in (ROOT / "varve").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path

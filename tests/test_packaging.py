"""The package reaches Python workers, and the optional part may be absent."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

_SESSION = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = (
    SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "4").getOrCreate()
)
"""


def _run(code, folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run(
        [sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=600
    )


def test_python_functions_run_from_any_folder(data, tmp_path):
    names = (
        "clv_score clv_eval clv_histogram clv_bgnbd_predict clv_pnbd_predict clv_pnbd_loglik "
        "clv_freq_fit_pnbd"
    ).split()
    code = _SESSION.format(root=ROOT) + (
        f"assert e.entry(spark).count() > 0\n"
        f"for name in {names!r}:\n"
        f"    assert not e.queries()[name](spark, {data!r}).isEmpty(), name\n"
        "print('done')"
    )
    found = _run(code, tmp_path)
    assert found.stdout.strip().endswith("done"), found.stderr[-2000:]


def test_entry_works_without_the_corpus_part(data, tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(
        os.path.join(ROOT, "tillscope"),
        copy / "tillscope",
        ignore=shutil.ignore_patterns("llm", "__pycache__"),
    )
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), copy)
    code = _SESSION.format(root=str(copy)) + (
        "assert 'rfm_table' in e.queries() and 'pipeline' not in e.queries()\n"
        "assert not any(name.startswith('op') for name in e.queries())\n"
        f"assert not e.queries()['rfm_table'](spark, {data!r}).isEmpty()\n"
        "print('done')"
    )
    found = _run(code, tmp_path)
    assert found.stdout.strip().endswith("done"), found.stderr[-2000:]


def test_entry_works_without_what_the_corpus_part_needs(tmp_path):
    code = "import sys\nsys.modules['tokenizers'] = None\nsys.modules['xxhash'] = None\n"
    code += _SESSION.format(root=ROOT).split("from pyspark.sql")[0] + (
        "assert 'rfm_table' in e.queries() and 'pipeline' not in e.queries()\n"
        "assert not any(name.startswith('op') for name in e.queries())\n"
        "print('done')"
    )
    found = _run(code, tmp_path)
    assert found.stdout.strip().endswith("done"), found.stderr[-2000:]

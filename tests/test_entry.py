"""The driver's contract, with and without the training-data part."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    sys.path.insert(0, ROOT)
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["chan", "pol", "t_inner", "ant_i", "ant_j", "re", "im", "bl"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_training_data_part(tmp_path):
    shutil.copytree(f"{ROOT}/fringework", tmp_path / "fringework", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'xengine_tri' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


@pytest.mark.parametrize("missing", ["zstandard", "public_tokenizers"])
def test_array_queries_stay_if_an_import_of_the_text_part_fails(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'), len(e.queries()) > 100)"
    got = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert got.stdout.split("\n")[0] == "[] True", got.stderr

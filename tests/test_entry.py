import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 40; import re; print(any(re.match(r'op[0-9]+_|pipeline', k) for k in q))"


def run(folder):
    return subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(folder), "PYTHONDONTWRITEBYTECODE": "1"})


def test_without_the_corpus_operators(tmp_path):
    shutil.copytree(f"{ROOT}/tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    got = run(tmp_path)
    assert got.returncode == 0 and got.stdout.strip() == "False", got.stderr


def test_entry(spark):
    import __spark_entry__

    assert run(ROOT).returncode == 0
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 3 and set(rows[0].asDict()) == {"tolerance_seconds", "visual_alignment_fraction", "text_alignment_fraction"}

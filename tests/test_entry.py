"""The entry points, with and without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_corpus_subpackage(tmp_path):
    shutil.copytree(ROOT / "docloom", tmp_path / "docloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') and n[2:3].isdigit() for n in q) and 'pipeline' not in q; print(len(q))"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_it():
    for p in (ROOT / "docloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "docloom.llm" not in p.read_text(), p


def test_without_a_library_of_the_corpus_subpackage():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and 'pipeline' not in q and 'op2_setsketch' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(ROOT)})

"""The core must not need the llm subpackage."""

import pathlib
import re
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).parent.parent


def test_only_the_entry_names_llm():
    for f in (ROOT / "versoflow").rglob("*.py"):
        if "llm" in f.relative_to(ROOT).parts:
            continue
        assert not re.search(r"versoflow\.llm|from \.+llm", f.read_text()), f


def test_core_imports_without_the_folder(tmp_path):
    shutil.copytree(ROOT / "versoflow", tmp_path / "versoflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert e.llm is None and 'p2_found' in q and 'p1_found' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})

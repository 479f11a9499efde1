"""The library stands without its optional part, and holds no Python UDF of its own."""

import ast
import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
LIBRARY = [p for p in (ROOT / "tidemark").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]


def test_nothing_imports_the_optional_part():
    for path in LIBRARY:
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or n == "corpus_pipeline" for n in names), path


def test_entry_imports_without_the_optional_part():
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['tidemark.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(x.startswith('op') for x in q if x[2:3].isdigit()); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_operators_stay_in_the_jvm():
    for path in LIBRARY:
        assert not re.search(r"pandas_udf|applyIn|mapIn(Pandas|Arrow)|\.rdd\b|\.collect\(|toPandas|localCheckpoint|crossJoin", path.read_text()), path


def test_plans_push_down_and_prune(spark):
    from tidemark.plans import registry

    plan = lambda name: registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    found = plan("anti_join")
    assert "LeftAnti" in found and "l_extendedprice" not in found.split("Physical Plan")[-1]
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderstatus,F\)", plan("repeat_pairs"))
    assert "CartesianProduct" not in plan("pricing_frame") and "Window" not in plan("latest_observation").split("Physical Plan")[-1]

"""Nothing outside the training-data subpackage needs it."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nobody_imports_it():
    for p in (ROOT / "panelforge").rglob("*.py"):
        if "llm" in p.parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("panelforge.llm") or n == "corpus_pipeline" for n in names), p


def test_entry_lists_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "metric_rank_ic_summary" in e.queries()

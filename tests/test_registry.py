import ast
import os

import __spark_entry__ as entry
from lectern.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_nothing_outside_imports_the_llm_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "lectern")):
        if os.sep + "llm" in folder:
            continue
        for name in files:
            if name.endswith(".py"):
                tree = ast.parse(open(os.path.join(folder, name), encoding="utf-8").read())
                for node in ast.walk(tree):
                    names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                    assert not any("llm" in n for n in names), name

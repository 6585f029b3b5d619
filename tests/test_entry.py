import ast
import os
import re

import __spark_entry__ as entry

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row.num_edges > 0 and row.num_nodes > 0


def test_registry():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 50


def test_nothing_else_imports_the_corpus_package():
    for folder, _, files in os.walk(os.path.join(HERE, "tidegraph")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(folder, f)).read()
                ast.parse(text)
                assert not re.search(r"tidegraph\.llm|corpus_pipeline", text), f

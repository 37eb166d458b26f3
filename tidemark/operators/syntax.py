"""Facts of Python sources by their syntax trees: imports, decorators, classes, functions."""

from __future__ import annotations

import ast
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.schemas import flat


def _dotted(node) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Call):
        return _dotted(node.func)
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""


def facts(source: str) -> set[tuple[str, str]] | None:
    """(kind, value) pairs of one source, null where it doesn't parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out: set[tuple[str, str]] = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out |= {("import", a.name) for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
            out |= {("import", node.module)} | {("import", f"{node.module}.{a.name}") for a in node.names}
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.add(("function", "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"))
            if node.returns or any(a.annotation for a in node.args.args):
                out.add(("function", "type hints"))
        elif isinstance(node, ast.ClassDef):
            out.add(("class", "class definition"))
            out |= {("class", f"extends:{name}") for b in node.bases if (name := _dotted(b))}
        elif isinstance(node, (ast.Yield, ast.YieldFrom)):
            out.add(("function", "generator"))
        for d in getattr(node, "decorator_list", ()):
            if name := _dotted(d):
                out.add(("decorator", name))
    return out


def python_facts(src: DataFrame) -> DataFrame:
    """file_id, kind and value of each fact of a Python source, each once per file; sources that don't parse have the fact (error, syntax).

    src: file_id and content. Null and empty sources have no facts.
    """
    df = src.select("file_id", "content")

    def run(batches):
        for batch in batches:
            row, kinds, values = [], [], []
            for i, source in enumerate(batch.column("content").to_pylist()):
                for kind, value in sorted({("error", "syntax")} if (f := facts(source or "")) is None else f):
                    row.append(i)
                    kinds.append(kind)
                    values.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("file_id").take(pa.array(row, pa.int64())), pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["file_id", "kind", "value"])

    return df.mapInArrow(run, T.StructType([df.schema["file_id"], *flat("kind string, value string")]))


def counted(found: DataFrame) -> DataFrame:
    """kind, value and number of files."""
    return found.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("files"))

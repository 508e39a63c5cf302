"""Symbols, imports and calls of Python files, by each file's syntax tree."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.operators.ranges import innermost

_SYMBOLS = "array<struct<name:string,kind:string,start:int,stop:int,exported:boolean>>"
_IMPORTS = "array<struct<module:string,name:string,alias:string,line:int,level:int>>"
_CALLS = "array<struct<name:string,line:int>>"
PARSED = f"path string, language string, parse_error boolean, symbols {_SYMBOLS}, imports {_IMPORTS}, calls {_CALLS}"


def parse(text: str) -> tuple[list, list, list] | None:
    """(symbols, imports, calls) of a Python text, None if it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    symbols: list[dict] = []

    def visit(body: list, prefix: str, inside: bool) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                kind = "class" if isinstance(node, ast.ClassDef) else "method" if inside else "function"
                symbols.append({"name": prefix + node.name, "kind": kind, "start": start, "stop": node.end_lineno, "exported": not node.name.startswith("_")})
                visit(node.body, f"{prefix}{node.name}.", isinstance(node, ast.ClassDef))
            elif not prefix and isinstance(node, ast.Assign):
                symbols.extend({"name": t.id, "kind": "constant", "start": node.lineno, "stop": node.end_lineno, "exported": not t.id.startswith("_")} for t in node.targets if isinstance(t, ast.Name) and t.id.isupper())

    visit(tree.body, "", False)
    imports, calls = [], []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports += [{"module": a.name, "name": None, "alias": a.asname or a.name.split(".")[0], "line": node.lineno, "level": 0} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports += [{"module": node.module or "", "name": a.name, "alias": a.asname or a.name, "line": node.lineno, "level": node.level} for a in node.names]
        elif isinstance(node, ast.Call):
            try:
                calls.append({"name": ast.unparse(node.func) if isinstance(node.func, (ast.Name, ast.Attribute)) else None, "line": node.lineno})
            except RecursionError:
                continue
    order = lambda x: (x["line"], x.get("module") or "", x["name"] or "")
    return symbols, sorted(imports, key=order), sorted((c for c in calls if c["name"]), key=order)


def parsed(files: DataFrame) -> DataFrame:
    """A row for each of files(path, text) with what its syntax tree holds; files of other languages have only their name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"]):
                language = "python" if path.endswith(".py") else path.rpartition(".")[2] if "." in path.rpartition("/")[2] else None
                got = parse(text) if language == "python" and text is not None else ([], [], [])
                rows.append((path, language, got is None, *(got or ([], [], []))))
            yield pd.DataFrame(rows, columns=["path", "language", "parse_error", "symbols", "imports", "calls"])

    return files.select("path", "text").mapInPandas(run, PARSED)


def bindings(parsed_files: DataFrame) -> DataFrame:
    """(path, line, local, imported, target): what each imported name of a file stands for, where it resolves to a file of the repository.

    A module's candidates are its file, its package and, for `from x import y`, y as a module of x; relative ones go up
    from the file. Of several the first that exists counts; each is found by a join on the path. imported is null where the
    name stands for a module as a whole; `import a.b` binds the name a.b.
    """
    up = F.expr("slice(split(path, '/'), 1, greatest(size(split(path, '/')) - i.level, 0))")
    base = F.when(F.col("i.level") > 0, F.array_join(up, "/")).otherwise(F.lit(""))
    inner = F.replace(F.col("i.module"), F.lit("."), F.lit("/"))
    stem = F.regexp_replace(F.concat_ws("/", base, inner), "^/+|/+$", "")
    bare = F.col("i.name").isNull() & (F.col("i.alias") == F.substring_index("i.module", ".", 1))
    local = F.when(bare, F.col("i.module")).otherwise(F.col("i.alias"))
    e = parsed_files.select("path", F.explode("imports").alias("i")).select("path", F.col("i.line").alias("line"), stem.alias("stem"), F.col("i.name").alias("name"), local.alias("local"))
    deep = F.concat_ws("/", "stem", "name")
    own = F.col("name").isNotNull()
    options = F.array(F.when(own, F.concat(deep, F.lit(".py"))), F.when(own, F.concat(deep, F.lit("/__init__.py"))), F.concat("stem", F.lit(".py")), F.concat("stem", F.lit("/__init__.py")))
    tried = e.select("path", "line", "name", "stem", "local", F.posexplode(options).alias("rank", "target")).where("target is not null")
    known = parsed_files.select(F.col("path").alias("target"))
    found = tried.join(known, "target").groupBy("path", "line", "stem", "name", "local").agg(F.min(F.struct("rank", "target")).alias("m")).where("m.target <> path")
    return found.select("path", "line", "local", F.when(F.col("m.rank") >= 2, F.col("name")).alias("imported"), "m.target")


def import_edges(parsed_files: DataFrame) -> DataFrame:
    """(src, dst, line): imports that resolve to a file of the repository, first line of each pair."""
    return bindings(parsed_files).groupBy(F.col("path").alias("src"), F.col("target").alias("dst")).agg(F.min("line").alias("line"))


def call_edges(parsed_files: DataFrame) -> DataFrame:
    """(src, caller, dst, callee, line): calls that resolve to a symbol of the repository; caller is null at a file's top level.

    A dotted name is looked up by the longest of its beginnings that is bound by an import, the rest in the file that it stands
    for; self.name in the innermost class around the call; else the whole name among the file's own symbols. All by equality joins, the innermost by the bucketed range join.
    """
    symbols = parsed_files.select("path", F.explode("symbols").alias("s")).select("path", "s.name", "s.kind", F.col("s.start").alias("r_start"), F.col("s.stop").alias("r_stop"))
    calls = parsed_files.select("path", F.explode("calls").alias("c")).select("path", F.col("c.line").alias("line"), F.col("c.name").alias("call")).distinct()
    at = calls.select("path", "line", F.col("line").alias("start"), F.col("line").alias("stop")).distinct()
    by = ["path", "line"]
    inside = innermost(at, symbols.select("path", "r_start", "r_stop", "name"), ["path"], by).select(*by, F.col("name").alias("caller"))
    owner = innermost(at, symbols.where("kind = 'class'").select("path", "r_start", "r_stop", "name"), ["path"], by).select(*by, F.col("name").alias("class"))
    parts = F.split("call", r"\.")
    cut = calls.withColumn("n", F.explode(F.sequence(F.lit(1), F.size(parts))))
    cut = cut.select("path", "line", "call", "n", F.array_join(F.slice(parts, F.lit(1), F.col("n")), ".").alias("local"), F.array_join(F.slice(parts, F.col("n") + 1, F.size(parts)), ".").alias("rest"))
    bound = cut.join(bindings(parsed_files).select("path", "local", "imported", "target"), ["path", "local"])
    callee = F.concat_ws(".", "imported", F.when(F.col("rest") != "", F.col("rest")))
    one = bound.select("path", "line", "call", (-F.col("n")).alias("rank"), F.col("target").alias("dst"), callee.alias("callee"))
    mine = calls.where(F.col("call").startswith("self.")).join(owner, by)
    two = mine.select("path", "line", "call", F.lit(1).alias("rank"), F.col("path").alias("dst"), F.concat_ws(".", "class", F.substring("call", 6, 1 << 20)).alias("callee"))
    three = calls.select("path", "line", "call", F.lit(2).alias("rank"), F.col("path").alias("dst"), F.col("call").alias("callee"))
    known = symbols.select(F.col("path").alias("dst"), F.col("name").alias("callee")).distinct()
    best = one.union(two).union(three).join(known, ["dst", "callee"]).groupBy("path", "line", "call").agg(F.min(F.struct("rank", "dst", "callee")).alias("m"))
    return best.join(inside, by, "left").select(F.col("path").alias("src"), "caller", "m.dst", "m.callee", "line")

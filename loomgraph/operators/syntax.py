"""Symbols, references, import bindings and metrics of Python files, by the language's own parser.

A file gives one row with its parts as arrays, so files stay where they are and nothing shuffles; ``symbols``,
``references`` and ``bindings`` give the parts as tables.

Defined cases: a null or empty text is a parsed file without parts; a text that doesn't parse (or nests deeper than
the parser goes) has status ``failed`` and no parts; of symbols with one qualified name and subtype in a file, the
first counts, and only its calls do.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Calls that say nothing about a program's structure.
NOISE = """print len str int float bool list dict set tuple range enumerate zip map filter sorted reversed type isinstance
issubclass hasattr getattr setattr delattr repr id hash abs sum min max round open input iter next super vars dir globals
locals""".split()

SYMBOL = "struct<qualified_name:string,name:string,subtype:string,visibility:string,line_start:bigint,line_end:bigint,signature:string,doc:string,bases:array<string>,cyclomatic_complexity:bigint,max_nesting_depth:bigint,parameter_count:bigint,function_length:bigint,cognitive_complexity:bigint>"
REFERENCE = "struct<source:string,type:string,target_key:string,line:bigint>"
BINDING = "struct<identifier:string,specifier:string,relative:boolean,imported_name:string,line:bigint>"
METRICS = ("cyclomatic_complexity", "max_nesting_depth", "parameter_count", "function_length", "cognitive_complexity")
#: The table of facts: one row for each file.
FACTS = f"path string, content_hash string, parse_status string, line_count bigint, symbols array<{SYMBOL}>, refs array<{REFERENCE}>, bindings array<{BINDING}>"

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_SCOPES = (*_FUNCTIONS, ast.ClassDef, ast.Lambda)
_LOOPS = (ast.For, ast.AsyncFor, ast.While)
_NESTS = (ast.If, *_LOOPS, ast.Try, ast.TryStar, ast.ExceptHandler, ast.Match)
_DECIDES = (ast.If, *_LOOPS, ast.ExceptHandler, ast.match_case, ast.IfExp)
_WEIGHS = (ast.If, *_LOOPS, ast.ExceptHandler, ast.Match, ast.IfExp)


def _continues(node: ast.AST, child: ast.AST) -> bool:
    """Whether a condition is the ``elif`` of another: it stands alone behind it, at the same column."""
    return isinstance(node, ast.If) and isinstance(child, ast.If) and node.orelse == [child] and child.col_offset == node.col_offset


def metrics(function: ast.AST) -> dict[str, int]:
    """Complexity, nesting, parameters and length of one function; functions and classes inside are their own."""
    cyclomatic, deepest, cognitive = 1, 0, 0
    stack = [(None, statement, 0, 0) for statement in function.body if not isinstance(statement, _SCOPES)]
    while stack:
        parent, node, depth, weight = stack.pop()
        same = _continues(parent, node)
        cyclomatic += isinstance(node, _DECIDES)
        if isinstance(node, ast.BoolOp):
            cyclomatic += len(node.values) - 1
            cognitive += len(node.values) - 1
        if isinstance(node, _WEIGHS):
            cognitive += 1 if same else 1 + weight
            weight += not same
        if getattr(node, "orelse", None) and isinstance(node, (ast.If, *_LOOPS)) and not any(_continues(node, c) for c in node.orelse):
            cognitive += 1
        depth += isinstance(node, _NESTS) and not same
        deepest = max(deepest, depth)
        stack += [(node, child, depth, weight) for child in ast.iter_child_nodes(node) if not isinstance(child, _SCOPES)]
    args = function.args
    count = len(args.posonlyargs) + len(args.args) + len(args.kwonlyargs) + (args.vararg is not None) + (args.kwarg is not None)
    return dict(zip(METRICS, (cyclomatic, deepest, count, function.end_lineno - function.lineno + 1, cognitive), strict=True))


def _visibility(name: str, subtype: str) -> str:
    if not name.startswith("_"):
        return "export"
    return "private" if subtype == "CLASS" or name.startswith("__") and not name.endswith("__") else "internal"


def _calls(function: ast.AST) -> Iterator[tuple[str, int]]:
    """Names that a function calls, in order; not those of functions and classes inside it."""
    found, stack = [], list(function.body)
    while stack:
        node = stack.pop()
        if isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
            continue
        if isinstance(node, ast.Call) and isinstance(node.func, (ast.Name, ast.Attribute)):
            key = ast.unparse(node.func)
            if key not in NOISE:
                found.append((node.lineno, node.col_offset, node.end_lineno, node.end_col_offset, key))
        stack += ast.iter_child_nodes(node)
    return ((key, line) for line, *_, key in sorted(found))


def module_key(specifier: str, path: str) -> str:
    """The path that an import names: dots in front go up from the file's directory, the others become slashes."""
    dots = len(specifier) - len(specifier.lstrip("."))
    rest = [p for p in specifier[dots:].split(".") if p]
    if not dots:
        return "/".join(rest)
    home = path.split("/")[:-1]
    return "/".join(home[: max(0, len(home) - dots + 1)] + rest)


def extract(path: str, text: str) -> dict:
    """The parts of one file; raises what the parser raises."""
    tree = ast.parse(text)
    symbols, refs, bindings, seen = [], [], [], set()

    def define(node: ast.AST, home: str | None) -> None:
        subtype = "CLASS" if isinstance(node, ast.ClassDef) else "METHOD" if home else "FUNCTION"
        qualified = f"{home}.{node.name}" if home else node.name
        if (qualified, subtype) in seen:
            return
        seen.add((qualified, subtype))
        symbol = dict(qualified_name=qualified, name=node.name, subtype=subtype, visibility=_visibility(node.name, subtype), line_start=node.lineno, line_end=node.end_lineno, doc=ast.get_docstring(node))
        symbols.append(symbol)
        if subtype == "CLASS":
            symbol["bases"] = [ast.unparse(b) for b in node.bases]
            for part in node.body:
                if isinstance(part, _FUNCTIONS):
                    define(part, node.name)
            return
        returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
        symbol["signature"] = f"def {node.name}({ast.unparse(node.args)}){returns}"
        symbol |= metrics(node)
        refs.extend(dict(source=qualified, type="CALLS", target_key=key, line=line) for key, line in _calls(node))

    def bind(identifier: str, specifier: str, name: str | None, line: int) -> None:
        bindings.append(dict(identifier=identifier, specifier=specifier, relative=specifier.startswith("."), imported_name=name, line=line))
        refs.append(dict(source=None, type="IMPORTS", target_key=module_key(specifier, path), line=line))

    for node in tree.body:
        if isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
            define(node, None)
        elif isinstance(node, ast.Import):
            for a in node.names:
                bind(a.asname or a.name, a.name, None, node.lineno)
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                bind(a.asname or a.name, "." * node.level + (node.module or ""), a.name, node.lineno)
    return dict(symbols=symbols, refs=refs, bindings=bindings)


def facts(files: DataFrame) -> DataFrame:
    """One row of FACTS for each Python file. ``files``: path, content_hash, language, text."""
    wanted = files.filter("language = 'python'").select("path", "content_hash", "text")
    empty = wanted.sparkSession.createDataFrame([], FACTS)
    kinds = pa.schema([(f.name, _arrow(f.dataType)) for f in empty.schema])

    def run(batches):
        for batch in batches:
            out = []
            for path, digest, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(path=path, content_hash=digest, parse_status="parsed", line_count=(text or "").count("\n") + 1, symbols=[], refs=[], bindings=[])
                try:
                    row |= extract(path, text or "")
                except (SyntaxError, ValueError, RecursionError, MemoryError):  # a source is whatever its author wrote
                    row["parse_status"] = "failed"
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return wanted.mapInArrow(run, FACTS)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def symbols(table: DataFrame) -> DataFrame:
    return table.select("path", F.explode("symbols").alias("s")).select("path", "s.*")


def references(table: DataFrame) -> DataFrame:
    """path, ord, source, type, target_key, line: what a file's symbols (or, source null, the file itself) refer to."""
    return table.select("path", F.posexplode("refs").alias("ord", "r")).select("path", "ord", "r.*")


def bindings(table: DataFrame) -> DataFrame:
    return table.select("path", F.explode("bindings").alias("b")).select("path", "b.*")


def measurements(table: DataFrame) -> DataFrame:
    """path, qualified_name, kind, value of every function."""
    kinds = F.map_from_arrays(F.array(*(F.lit(m) for m in METRICS)), F.array(*METRICS))
    return symbols(table).filter("subtype <> 'CLASS'").select("path", "qualified_name", F.explode(kinds).alias("kind", "value"))

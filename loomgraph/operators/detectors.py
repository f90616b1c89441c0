"""Text detectors: environment and file-system accesses in source files, behind a table of patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """A regular expression for one language; group 1 is the variable or path, group 2 a default or destination."""

    language: str
    family: str
    name: str
    regex: str
    confidence: float
    kind: str
    group: str | None = None


# How languages read the environment and change files.
PATTERNS = (
    Pattern("typescript", "env", "process_env_dot", r"process\.env\.([A-Z_][A-Z0-9_]*)(?:\s*(?:\|\||\?\?)\s*[\"']([^\"']*)[\"'])?", 0.95, "unknown"),
    Pattern("typescript", "env", "process_env_bracket", r"process\.env\[[\"']([A-Z_][A-Z0-9_]*)[\"']\](?:\s*(?:\|\||\?\?)\s*[\"']([^\"']*)[\"'])?", 0.95, "unknown"),
    Pattern("python", "env", "os_environ_bracket", r"os\.environ\[[\"']([A-Z_][A-Z0-9_]*)[\"']\]", 0.95, "required"),
    Pattern("python", "env", "os_environ_get", r"os\.environ\.get\([\"']([A-Z_][A-Z0-9_]*)[\"'](?:\s*,\s*[\"']([^\"']*)[\"'])?\)", 0.95, "optional"),
    Pattern("python", "env", "os_getenv", r"os\.getenv\([\"']([A-Z_][A-Z0-9_]*)[\"'](?:\s*,\s*[\"']([^\"']*)[\"'])?\)", 0.95, "optional"),
    Pattern("rust", "env", "std_env_var", r"(?:std::)?env::var(?:_os)?\(\"([A-Z_][A-Z0-9_]*)\"\)", 0.95, "unknown"),
    Pattern("java", "env", "system_getenv", r"System\.getenv\(\"([A-Z_][A-Z0-9_]*)\"\)", 0.95, "unknown"),
    Pattern("c", "env", "getenv", r"\bgetenv\(\"([A-Z_][A-Z0-9_]*)\"\)", 0.95, "unknown"),
    Pattern("typescript", "fs", "fs_write_file", r"\bfs(?:\.promises)?\.writeFile(?:Sync)?\(\s*(?:[\"'`]([^\"'`]+)[\"'`])?", 0.90, "write_file", "write"),
    Pattern("typescript", "fs", "fs_unlink", r"\bfs(?:\.promises)?\.(?:unlink|rm)(?:Sync)?\(\s*(?:[\"'`]([^\"'`]+)[\"'`])?", 0.90, "delete_path"),
    Pattern("typescript", "fs", "fs_mkdir", r"\bfs(?:\.promises)?\.mkdir(?:Sync)?\(\s*(?:[\"'`]([^\"'`]+)[\"'`])?", 0.90, "create_dir"),
    Pattern("typescript", "fs", "fs_rename", r"\bfs(?:\.promises)?\.rename(?:Sync)?\(\s*(?:[\"'`]([^\"'`]+)[\"'`]\s*,\s*[\"'`]([^\"'`]+)[\"'`])?", 0.90, "rename_path"),
    Pattern("python", "fs", "open_write", r"\bopen\(\s*(?:[\"']([^\"']+)[\"'])?[^)]*,\s*[\"'][wax]b?\+?[\"']", 0.85, "write_file", "write"),
    Pattern("python", "fs", "os_remove", r"\bos\.(?:remove|unlink)\(\s*(?:[\"']([^\"']+)[\"'])?", 0.90, "delete_path"),
    Pattern("python", "fs", "os_makedirs", r"\bos\.(?:makedirs|mkdir)\(\s*(?:[\"']([^\"']+)[\"'])?", 0.90, "create_dir"),
    Pattern("rust", "fs", "std_fs_write", r"\b(?:std::)?fs::write\(\s*(?:\"([^\"]+)\")?", 0.90, "write_file"),
    Pattern("rust", "fs", "std_fs_remove", r"\b(?:std::)?fs::remove_(?:file|dir|dir_all)\(\s*(?:\"([^\"]+)\")?", 0.90, "delete_path"),
    Pattern("java", "fs", "files_write", r"\bFiles\.write(?:String)?\(\s*(?:Paths?\.(?:get|of)\(\"([^\"]+)\"\))?", 0.85, "write_file"),
    Pattern("c", "fs", "fopen_write", r"\bfopen\(\s*(?:\"([^\"]+)\")?[^)]*,\s*\"[wa]", 0.85, "write_file"),
)

_C_TOKENS = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_PY_TOKENS = re.compile(r"#[^\n]*|[rbfuRBFU]{0,2}(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z))|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)


def mask_comments(text: str, language: str) -> str:
    """Comments become spaces of the same length, so places and lines stay; strings are left alone.

    In Python a string in triple quotes that begins a line is documentation, and goes too.
    """
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    if language == "python":

        def swap(m):
            token = m.group()
            doc = token.lstrip("rbfuRBFU")[:3] in ('"""', "'''") and not text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip()
            return blank(token) if token.startswith("#") or doc else token

        return _PY_TOKENS.sub(swap, text)
    return _C_TOKENS.sub(lambda m: blank(m.group()) if m.group().startswith(("//", "/*")) else m.group(), text)


_LANGUAGE = {"javascript": "typescript", "cpp": "c"}


def detect(path: str, language: str, text: str, patterns: tuple[Pattern, ...] = PATTERNS) -> list[tuple]:
    """(path, family, line, name, value, detail, kind, confidence, dynamic) in order of lines and patterns.

    A variable counts once for each file. File-system patterns of one group that start at the same place count once.
    """
    wanted = [p for p in patterns if p.language == _LANGUAGE.get(language, language)]
    compiled = [(p, re.compile(p.regex)) for p in wanted]
    out, seen = [], set()
    for number, line in enumerate(mask_comments(text or "", language).split("\n"), 1):
        starts: set[tuple] = set()
        for p, regex in compiled:
            for m in regex.finditer(line):
                value, detail = m.group(1), m.group(2) if m.re.groups > 1 else None
                if p.family == "env":
                    if value in seen:
                        continue
                    seen.add(value)
                    kind = "optional" if detail is not None and p.kind == "unknown" else p.kind
                else:
                    if p.group and (p.group, m.start()) in starts:
                        continue
                    starts.add((p.group, m.start()))
                    kind = p.kind
                out.append((path, p.family, number, p.name, value, detail, kind, p.confidence, p.family == "fs" and value is None))
    return out


def detect_all(files: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS) -> DataFrame:
    """What ``detect`` finds in each file (path, language, text); files stay where they are, no shuffle."""
    import pandas as pd

    columns = ["path", "family", "line", "pattern", "value", "detail", "kind", "confidence", "dynamic"]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([r for x in pdf.itertuples(index=False) for r in detect(x.path, x.language, x.text, patterns)], columns=columns)

    return files.filter("language is not null").select("path", "language", "text").mapInPandas(run, "path string, family string, line long, pattern string, value string, detail string, kind string, confidence double, dynamic boolean")


# Commands


def shell_commands(scripts: DataFrame) -> DataFrame:
    """source, ord, command: the commands of shell lines (source, script).

    Chains are cut, environment assignments and wrappers that only run another command are taken off, and what follows
    a pipe or redirection is dropped.
    """
    parts = F.split("script", r"\s*(?:&&|\|\||;|\n)\s*")
    rows = scripts.select("source", F.posexplode(parts).alias("ord", "command"))
    command = F.regexp_replace("command", r"\s*[|<>].*$", "")
    command = F.regexp_replace(command, r"^\s*(?:[A-Za-z_][A-Za-z0-9_]*=\S*\s+)+", "")
    command = F.regexp_replace(command, r"^(?:npx|yarn exec|pnpm exec|cross-env(?:\s+[A-Za-z_][A-Za-z0-9_]*=\S*)*|sudo|exec|env)\s+", "")
    return rows.withColumn("command", F.trim(command)).filter("command <> '' and command not like '#%'")


def annotations_by_target(annotations: DataFrame) -> DataFrame:
    """Collisions of target and kind keep the first by line and file; in order of kind."""
    from pyspark.sql import Window

    order = Window.partitionBy("target", "kind").orderBy("line", "file")
    rank = F.array_position(F.array(*(F.lit(k) for k in ("module_readme", "file_header_comment", "jsdoc_block", "docstring", "package_description"))), F.col("kind"))
    return annotations.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n").withColumn("rank", F.when(rank == 0, 6).otherwise(rank).cast("long"))


def surfaces(rows: DataFrame, kind: str | None = None, runtime: str | None = None, module: str | None = None) -> DataFrame:
    """Surfaces by filters, each optional, in order of root, kind and name, nameless ones last."""
    for column, wanted in (("kind", kind), ("runtime", runtime), ("module", module)):
        rows = rows.filter(F.col(column) == wanted) if wanted is not None else rows
    return rows.orderBy("root", "kind", F.asc_nulls_last("name"), "uid")


def resolve_surface(requests: DataFrame, rows: DataFrame, shortest: int = 4) -> DataFrame:
    """query, status, uid: by uid, then prefix of it, then key, then name; more than one match at a step is ambiguous."""
    whole = rows.select("uid", "key", "name")
    q = F.col("query")
    hits = requests.select("query").distinct().join(F.broadcast(whole), (q == F.col("uid")) | ((F.length(q) >= shortest) & F.col("uid").startswith(q)) | (q == F.col("key")) | (q == F.col("name")), "left")
    step = F.when(q == F.col("uid"), 1).when(F.col("uid").startswith(q) & (F.length(q) >= shortest), 2).when(q == F.col("key"), 3).when(q == F.col("name"), 4)
    per = hits.groupBy("query", step.alias("step")).agg(F.count("uid").alias("n"), F.min("uid").alias("uid"))
    best = per.groupBy("query").agg(F.min_by(F.struct("n", "uid"), F.coalesce("step", F.lit(9))).alias("b"))
    return best.select("query", F.when(F.col("b.n") == 0, "not_found").when(F.col("b.n") == 1, "found").otherwise("ambiguous").alias("status"), F.when(F.col("b.n") == 1, F.col("b.uid")).alias("uid"))

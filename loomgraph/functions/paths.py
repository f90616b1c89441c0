"""Path, key and text expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and their languages.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "java": "java", "py": "python", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "hxx": "cpp"}
# Path segments of code that isn't the repository's own.
VENDORED = ("vendor", "vendors", "third_party", "third-party", "external", "deps", "node_modules")


def dirname(path: Column) -> Column:
    """What stands before the last slash; empty if there is none."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def ancestors(path: Column) -> Column:
    """Every directory above a path, shortest first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def under(path: Column, prefix: Column) -> Column:
    """Whether a path is a prefix's own or lies below it, at a slash."""
    return (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def resolve_relative(path: Column) -> Column:
    """Drop empty and ``.`` segments and let ``..`` take back the one before; above the root it is dropped."""
    step = lambda acc, x: F.when((x == "") | (x == "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def strip_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.(ts|tsx|js|jsx|py)$", "")


def is_test_path(path: Column) -> Column:
    inside = [path.contains(x) for x in ("__tests__", ".test.", ".spec.", "/test/", "/tests/")]
    first = [path.startswith(x) for x in ("test/", "tests/", "__tests__/")]
    out = F.lit(False)
    for x in (*inside, *first):
        out = out | x
    return out


def is_vendored(path: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*(F.lit(x) for x in VENDORED)))


def glob_regex(glob: str) -> str:
    """A glob as a regular expression over whole paths: ``*`` stays inside a segment, ``**`` doesn't."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def alias_matches(specifier: Column, aliases: Column) -> Column:
    """Whether an alias pattern of an array covers a specifier: ``p*`` by prefix (a bare ``*`` doesn't count), else equal."""
    return F.exists(aliases, lambda a: F.when(a == "*", F.lit(False)).when(a.endswith("*"), specifier.startswith(F.regexp_replace(a, r"\*$", ""))).otherwise(specifier == a))


def module_of_key(key: Column) -> Column:
    """The path in ``repo:path:MODULE``; empty if the key is another's."""
    return F.regexp_extract(key, r"^[^:]*:(.*):MODULE$", 1)


def module_key(repo: Column, path: Column) -> Column:
    """The key of a module: the repository's uid, its path (``.`` for the root), and what it is."""
    return F.concat_ws(":", repo, F.when(path == "", ".").otherwise(path), F.lit("MODULE"))


def http_path(path: Column) -> Column:
    """Placeholders ``{x}`` and ``:x`` become ``{_}``; the empty path is ``/``."""
    one = lambda s: F.when(s.startswith("{") & s.endswith("}"), "{_}").when(s.startswith(":") & (F.length(s) > 1), "{_}").otherwise(s)
    return F.when(path == "", "/").otherwise(F.array_join(F.transform(F.split(path, "/"), one), "/"))


def http_key(method: Column, path: Column) -> Column:
    return F.concat(F.upper(F.coalesce(method, F.lit("*"))), F.lit(" "), http_path(path))


def cli_key(address: Column) -> Column:
    return F.trim(F.lower(address))


def http_confidence(base: Column, path: Column) -> Column:
    """0.8 of the consumer's confidence up to one segment, less a tenth of the placeholders' share beyond."""
    parts = F.filter(F.split(http_path(path), "/"), lambda s: s != "")
    wild = F.size(F.filter(parts, lambda s: s == "{_}"))
    factor = F.when(F.size(parts) <= 1, 0.8).when(wild == 0, 1.0).otherwise(1 - 0.1 * wild / F.greatest(F.size(parts), F.lit(1)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * factor))


def doc_kind(path: Column) -> Column:
    """The kind of a documentation file by name, first rule first."""
    low, name = F.lower(path), F.lower(basename(path))
    return (
        F.when(name == "map.md", "map")
        .when(name.isin("readme.md", "readme"), "readme")
        .when(name.isin("architecture.md", "contributing.md", "changelog.md") | low.contains("docs/") | low.contains("design/"), "architecture")
        .when(name.startswith("docker-compose") | name.startswith("compose.") | name.startswith(".env") | name.endswith(".yaml") | name.endswith(".yml"), "config")
        .when(name.endswith(".md"), "architecture")
        .otherwise("config")
    )

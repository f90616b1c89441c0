"""Source trees, manifests and reports as tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ancestors, basename, dirname, is_test_path, language

# Directories that are never scanned.
EXCLUDED = ("node_modules", ".git", "dist", "build", "out", ".next", ".nuxt", "coverage", ".turbo", ".cache", "venv", ".venv", "__pycache__", "cdk.out")


def content_hash(content):
    """The first 16 hex characters of SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def scan(spark: SparkSession, root: str, max_bytes: int = 1 << 20) -> DataFrame:
    """path, language, is_test, size, content_hash, text of the source files below a folder; larger ones without text.

    Spark's readers pass over files of no bytes, so those have no row.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", f"^.*{root.rstrip('/').removeprefix('file://')}/", "")
    rows = raw.select(path.alias("path"), F.col("length").alias("size"), "content")
    rows = rows.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*(F.lit(x) for x in EXCLUDED)))).withColumn("language", language(F.col("path")))
    text = F.when(F.col("size") <= max_bytes, F.decode("content", "UTF-8"))
    return rows.filter("language is not null").select("path", "language", is_test_path(F.col("path")).alias("is_test"), "size", content_hash(F.col("content")).alias("content_hash"), text.alias("text"))


def doc_files(spark: SparkSession, root: str) -> DataFrame:
    """path, text of documentation and configuration files below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", f"^.*{root.rstrip('/').removeprefix('file://')}/", "")
    name = F.lower(basename(F.col("path")))
    wanted = name.rlike(r"\.(md|ya?ml)$") | name.isin("readme") | name.startswith(".env") | name.startswith("docker-compose") | name.startswith("compose.")
    return raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("text")).filter(wanted & ~F.arrays_overlap(F.split("path", "/"), F.array(*(F.lit(x) for x in EXCLUDED))))


#: What git compares for each scope of change; ``since`` takes a commit.
DIFF_SCOPES = {"working": ["HEAD"], "staged": ["--cached"], "since": []}


def changed_files(spark: SparkSession, root: str, scope: str = "working", since: str | None = None) -> DataFrame:
    """path, change of what differs in a work tree: against the last commit, staged, or since a commit.

    Git runs on the driver, where the tree is; what it prints is one line for each changed file.
    """
    import subprocess

    if scope not in DIFF_SCOPES or (scope == "since") != bool(since):
        raise ValueError("scope is working or staged, or since with a commit")
    if since and since.startswith("-"):
        raise ValueError("a commit can't begin with a dash")
    told = subprocess.run(["git", "-C", root, "diff", "--name-status", *DIFF_SCOPES[scope], *([since] if since else []), "--"], check=True, capture_output=True, text=True).stdout
    from ..operators.reports import changed_paths

    return changed_paths(spark.createDataFrame([(x,) for x in told.splitlines()], "value string"))


def numstat(lines: DataFrame) -> DataFrame:
    """commit, file, added, deleted from ``git log --numstat`` output: id (line number), value.

    A boundary line starts a commit; its number is the commit's. Binary files count no lines.
    """
    from pyspark.sql import Window

    upto = Window.partitionBy("log").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines if "log" in lines.columns else lines.withColumn("log", F.lit(""))
    value = F.trim("value")
    rows = rows.withColumn("commit", F.sum((value == "COMMIT_BOUNDARY").cast("long")).over(upto))
    parts = F.split(value, "\t", 3)
    count = lambda k: F.coalesce(parts[k].try_cast("long"), F.lit(0))
    path = F.regexp_replace(F.regexp_replace(parts[2], r"\\", "/"), r"^(\./|/)+", "")
    return rows.filter(F.size(parts) == 3).select("log", "commit", path.alias("file"), count(0).alias("added"), count(1).alias("deleted")).filter("file <> ''")


def istanbul(reports: DataFrame, root: str) -> DataFrame:
    """path, line_coverage, function_coverage, branch_coverage from reports (column value: a whole JSON report).

    A ratio of nothing is null; files outside the root are left out.
    """
    entry = "struct<s:map<string,bigint>,f:map<string,bigint>,b:map<string,array<bigint>>>"
    rows = reports.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("file", "e")).filter("e.s is not null or e.f is not null")
    inside = F.lit(root.rstrip("/") + "/")
    rows = rows.filter(F.col("file").startswith(inside)).withColumn("path", F.expr(f"substring(file, {len(root.rstrip('/')) + 2})"))

    def share(values):
        values = F.coalesce(values, F.array().cast("array<bigint>"))
        return F.when(F.size(values) > 0, F.size(F.filter(values, lambda v: v > 0)) / F.size(values))

    return rows.select("path", share(F.map_values("e.s")).alias("line_coverage"), share(F.map_values("e.f")).alias("function_coverage"), share(F.flatten(F.map_values("e.b"))).alias("branch_coverage"))


#: Readers of coverage reports by what their text shows.
COVERAGE_READERS = {"istanbul": (lambda text: text.lstrip().startswith("{") and '"s"' in text, istanbul)}


def coverage_reader(sample: str):
    """The first reader that accepts a report."""
    for name, (accepts, reader) in COVERAGE_READERS.items():
        if accepts(sample):
            return name, reader
    raise ValueError("no reader accepts this coverage report")


# Manifests


def _package_json(text: str) -> tuple[list[str], list[str]]:
    found = json.loads(text)
    deps = [k for part in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies") for k in (found.get(part) or {})]
    return sorted(set(deps)), []


def _cargo_toml(text: str) -> tuple[list[str], list[str]]:
    import tomllib

    found = tomllib.loads(text)
    deps = [k for part in ("dependencies", "dev-dependencies", "build-dependencies") for k in found.get(part, {})]
    return sorted({d.replace("-", "_") for d in deps}), []


def _pyproject(text: str) -> tuple[list[str], list[str]]:
    import re
    import tomllib

    listed = tomllib.loads(text).get("project", {}).get("dependencies", [])
    return sorted({re.split(r"[^A-Za-z0-9_.-]", d.strip(), maxsplit=1)[0] for d in listed} - {""}), []


def _requirements(text: str) -> tuple[list[str], list[str]]:
    import re

    lines = [x.split("#")[0].strip() for x in text.splitlines()]
    return sorted({re.split(r"[^A-Za-z0-9_.-]", x, maxsplit=1)[0] for x in lines if x and not x.startswith("-")} - {""}), []


def _tsconfig(text: str) -> tuple[list[str], list[str]]:
    import re

    bare = re.sub(r",(\s*[}\]])", r"\1", re.sub(r"(^|\s)//[^\n]*|/\*.*?\*/", r"\1", text, flags=re.S))
    return [], list((json.loads(bare).get("compilerOptions") or {}).get("paths") or {})


def _gradle(text: str) -> tuple[list[str], list[str]]:
    import re

    found = re.findall(r"""(?:implementation|api|compileOnly|runtimeOnly|testImplementation)\s*\(?\s*["']([^"':]+):([^"':]+)""", text)
    return sorted({group for group, _ in found}), []


MANIFESTS = {"package.json": _package_json, "Cargo.toml": _cargo_toml, "pyproject.toml": _pyproject, "requirements.txt": _requirements, "tsconfig.json": _tsconfig, "build.gradle": _gradle}


def manifests(files: DataFrame) -> DataFrame:
    """path, directory, name, dependencies, aliases, error of manifest files (path, text); a malformed one has its error."""
    import pandas as pd

    wanted = files.filter(basename(F.col("path")).isin(*MANIFESTS)).select("path", "text")

    def parse(batches):
        for pdf in batches:
            out = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    deps, aliases = MANIFESTS[name](text or "")
                    out.append((path, name, deps, aliases, None))
                except Exception as e:  # noqa: BLE001  a manifest is whatever its author wrote
                    out.append((path, name, [], [], type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "name", "dependencies", "aliases", "error"])

    rows = wanted.mapInPandas(parse, "path string, name string, dependencies array<string>, aliases array<string>, error string")
    return rows.withColumn("directory", dirname(F.col("path")))


def nearest(files: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """path of each file with the nearest manifest of a name in its directory or above: manifest, dependencies, aliases."""
    places = files.select("path", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("path")))).alias("directory"))
    hits = places.join(found.filter((F.col("name") == name) & F.col("error").isNull()).select("directory", F.col("path").alias("manifest"), "dependencies", "aliases"), "directory")
    best = hits.groupBy("path").agg(F.max_by(F.struct("manifest", "dependencies", "aliases"), F.length("directory")).alias("m"))
    return files.select("path").join(best, "path", "left").select("path", "m.manifest", "m.dependencies", "m.aliases")

"""Modules, surfaces and commands that manifests and build files declare.

Each parser takes one file's path and text and returns rows; ``discovered`` runs them over a table of files in place.
A file that can't be parsed gives no rows.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename

#: What a row says: sort (module, surface, command, pattern, note), root, name, kind, detail, source, confidence.
COLUMNS = ("sort", "root", "name", "kind", "detail", "source", "confidence")
Row = tuple[str, str, str | None, str | None, str | None, str, float | None]

# Frameworks whose presence among dependencies shows what a package runs as.
FRAMEWORKS = {"next": "web_app", "react-scripts": "web_app", "vite": "web_app", "@angular/core": "web_app", "express": "backend_service", "fastify": "backend_service", "@nestjs/core": "backend_service", "koa": "backend_service", "hono": "backend_service"}


def _folder(path: str) -> str:
    return posixpath.dirname(path) or "."


def _at(folder: str, path: str) -> str:
    return posixpath.normpath(posixpath.join(folder, path)) if folder != "." else posixpath.normpath(path)


def package_json(path: str, text: str) -> list[Row]:
    found, folder = json.loads(text), _folder(path)
    name = found.get("name") if isinstance(found.get("name"), str) else None
    out: list[Row] = []
    spaces = found.get("workspaces")
    patterns = spaces if isinstance(spaces, list) else spaces.get("packages", []) if isinstance(spaces, dict) else []
    out += [("pattern", folder, name, "workspace", p, "package_json_workspaces", None) for p in patterns if isinstance(p, str)]
    if not spaces and name:
        out.append(("module", folder, name, "declared", None, "package_json_workspaces", 0.95))
    bins = found.get("bin")
    bins = {name or "cli": bins} if isinstance(bins, str) else bins if isinstance(bins, dict) else {}
    surfaces: list[Row] = [("surface", folder, n, "cli", _at(folder, p), "package_json_bin", 0.95) for n, p in bins.items()]
    if any(isinstance(found.get(k), str) for k in ("main", "module")) or "exports" in found:
        main = found.get("main")
        surfaces.append(("surface", folder, name, "library", _at(folder, main) if isinstance(main, str) else None, "package_json_main", 0.85))
    deps = {k for part in ("dependencies", "devDependencies") for k in found.get(part) or {}}
    used = next((f for f in FRAMEWORKS if f in deps), None)
    if used:
        surfaces.append(("surface", folder, name, FRAMEWORKS[used], used, "framework_dependency", 0.8))
    scripts = found.get("scripts") if isinstance(found.get("scripts"), dict) else {}
    if not surfaces and any(k in scripts for k in ("start", "serve", "dev")):
        surfaces.append(("surface", folder, name, "backend_service", None, "package_json_scripts", 0.6))
    return out + surfaces + [("command", folder, k, "script", v, "package_json_scripts", 0.9) for k, v in scripts.items() if isinstance(v, str)]


def pnpm_workspace(path: str, text: str) -> list[Row]:
    out: list[Row] = []
    inside = False
    for line in map(str.strip, text.split("\n")):
        if re.fullmatch(r"packages\s*:", line):
            inside = True
        elif inside and (m := re.fullmatch(r"-\s+['\"]?([^'\"]+)['\"]?", line)):
            out.append(("pattern", _folder(path), None, "workspace", m[1], "pnpm_workspace", None))
        elif inside and line and not line.startswith(("-", "#")):
            break
    return out


def cargo_toml(path: str, text: str) -> list[Row]:
    import tomllib

    found, folder = tomllib.loads(text), _folder(path)
    out: list[Row] = [("pattern", folder, None, "workspace", m, "cargo_workspace", None) for m in found.get("workspace", {}).get("members", [])]
    name = found.get("package", {}).get("name")
    if name:
        out.append(("module", folder, name, "declared", None, "cargo_crate", 0.95))
    out += [("surface", folder, b.get("name", name), "cli", _at(folder, b.get("path", "src/main.rs")), "cargo_bin", 0.95) for b in found.get("bin", [])]
    if "lib" in found:
        out.append(("surface", folder, found["lib"].get("name", name), "library", _at(folder, found["lib"].get("path", "src/lib.rs")), "cargo_lib", 0.9))
    return out


def pyproject_toml(path: str, text: str) -> list[Row]:
    import tomllib

    project, folder = tomllib.loads(text).get("project", {}), _folder(path)
    out: list[Row] = [("module", folder, project["name"], "declared", None, "pyproject", 0.95)] if "name" in project else []
    return out + [("surface", folder, n, "cli", target, "pyproject_scripts", 0.95) for n, target in project.get("scripts", {}).items()]


def gradle_settings(path: str, text: str) -> list[Row]:
    included = [p for group in re.findall(r"include\s*\(?([^\n)]*)", text) for p in re.findall(r"[\"']([^\"']+)[\"']", group)]
    return [("module", _at(_folder(path), p.lstrip(":").replace(":", "/")), p.split(":")[-1], "declared", None, "gradle_settings", 0.95) for p in included]


def _joined_lines(text: str) -> list[tuple[int, str]]:
    """Lines with continuations joined, each with the number of its first."""
    out, held, start = [], "", 0
    for number, line in enumerate(text.split("\n"), 1):
        start = start if held else number
        held = f"{held} {line.strip()}".rstrip() if held else line.rstrip()
        if held.endswith("\\"):
            held = held[:-1].rstrip()
            continue
        out.append((start, held))
        held = ""
    return [*out, (start, held)] if held else out


def kbuild(path: str, text: str) -> list[Row]:
    """Subdirectories of unconditional ``obj-y`` and ``obj-m``; what is skipped is noted with its reason."""
    folder, out, seen, depth = _folder(path), [], set(), 0
    note = lambda kind, number, line: ("note", folder, str(number), kind, line[:60], "kbuild", None)
    for number, raw in _joined_lines(text):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        if re.match(r"if(n?eq|n?def)|endif|else", line):
            depth += 1 if line.startswith("if") else -1 if line.startswith("endif") and depth else 0
            out.append(note("skipped_conditional", number, line))
            continue
        m = re.match(r"obj-[ym]\s*(?:\+?=|:=)\s*(.+)$", line)
        if not m:
            if re.match(r"obj-\$\([^)]+\)\s*(?:\+?=|:=)\s*.+$", line):
                out.append(note("skipped_config_gated", number, line))
            continue
        if depth:
            out.append(note("skipped_inside_conditional", number, line))
            continue
        for target in m[1].split():
            if "$" in target:
                out.append(note("skipped_variable", number, target))
            elif target.endswith("/") and (root := _at(folder, target)) not in seen:
                seen.add(root)
                out.append(("module", root, target[:-1], "inferred", line[:5], "kbuild", 0.9))
    return out


def dockerfile(path: str, text: str) -> list[Row]:
    """What the last stage runs, and the ports it exposes."""
    base = run = None
    ports: list[str] = []
    for _, line in _joined_lines(text):
        word, _, rest = line.strip().partition(" ")
        if word.upper() == "FROM":
            base, run, ports = rest.split()[0] if rest.split() else None, None, []
        elif word.upper() in ("CMD", "ENTRYPOINT"):
            run = " ".join(json.loads(rest)) if rest.strip().startswith("[") else rest.strip()
        elif word.upper() == "EXPOSE":
            ports += rest.split()
    if base is None:
        return []
    out: list[Row] = [("surface", _folder(path), base, "backend_service" if ports else "cli", run, "dockerfile", 0.75 if run else 0.6)]
    return out + ([("command", _folder(path), "run", "container", run, "dockerfile", 0.8)] if run else [])


def compose(path: str, text: str) -> list[Row]:
    """Services, each with its image or build folder, and its command."""
    out: list[Row] = []
    services: dict[str, dict[str, str]] = {}
    top, service, depth = None, None, None
    for line in text.split("\n"):
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        indent, item = len(bare) - len(bare.lstrip()), bare.strip()
        if indent == 0:
            top, service, depth = item.rstrip(":"), None, None
        elif top == "services":
            depth = indent if depth is None else depth
            key, _, value = item.partition(":")
            if indent == depth:
                service = key.strip("'\"")
                services[service] = {}
            elif service and value.strip():
                services[service].setdefault(key.strip(), value.strip().strip("'\""))
    for name, found in services.items():
        build = found.get("build") or found.get("context")
        out.append(("surface", _at(_folder(path), build) if build else _folder(path), name, "backend_service", found.get("image"), "docker_compose", 0.85))
        if "command" in found:
            out.append(("command", _folder(path), name, "container", found["command"], "docker_compose", 0.8))
    return out


def makefile(path: str, text: str) -> list[Row]:
    """The commands of each target; variables stay as they are written."""
    out: list[Row] = []
    target = None
    for _, line in _joined_lines(text):
        if m := re.match(r"([A-Za-z0-9_./-]+)\s*:(?!=)", line):
            target = m[1]
        elif line.startswith("\t") and target and not target.startswith("."):
            command = line.strip().lstrip("@-+").strip()
            if command and not command.startswith("#"):
                out.append(("command", _folder(path), target, "make_target", command, "makefile", 0.85))
    return out


PARSERS: dict[str, Callable[[str, str], list[Row]]] = {
    "package.json": package_json, "pnpm-workspace.yaml": pnpm_workspace, "Cargo.toml": cargo_toml, "pyproject.toml": pyproject_toml, "settings.gradle": gradle_settings, "settings.gradle.kts": gradle_settings,
    "Kbuild": kbuild, "Dockerfile": dockerfile, "docker-compose.yml": compose, "docker-compose.yaml": compose, "compose.yml": compose, "compose.yaml": compose,
}


def parse(path: str, text: str | None) -> list[Row]:
    name = path.rsplit("/", 1)[-1]
    parsers = [makefile, kbuild] if name == "Makefile" else [PARSERS[name]] if name in PARSERS else []
    out: list[Row] = []
    for parser in parsers:
        try:
            out += parser(path, text or "")
        except (ValueError, TypeError, AttributeError):  # a manifest is whatever its author wrote
            continue
    return out


def discovered(files: DataFrame) -> DataFrame:
    """path and the columns of COLUMNS for every manifest among files (path, text)."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(p, *r) for p, t in zip(pdf["path"], pdf["text"], strict=True) for r in parse(p, t)], columns=["path", *COLUMNS])

    wanted = files.filter(basename(F.col("path")).isin(*PARSERS, "Makefile")).select("path", "text")
    return wanted.mapInPandas(run, "path string, sort string, root string, name string, kind string, detail string, source string, confidence double")


def merged_surfaces(surfaces: DataFrame) -> DataFrame:
    """Of surfaces with equal root, kind and name the one of most confidence, with all sources that saw it.

    Of equal confidence the first source counts; within it the one first in ``ord``, if there is such a column, then the
    least detail.
    """
    order = ["ord"] if "ord" in surfaces.columns else []
    key = F.struct((-F.col("confidence")).alias("c"), "source", *order, "detail")
    return surfaces.filter("sort = 'surface'").groupBy("root", "kind", "name").agg(F.min_by("detail", key).alias("entrypoint"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("source")).alias("sources"))

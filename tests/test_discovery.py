"""Manifests, build files and state bindings on literal texts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from helpers import rows
from loomgraph.operators import discovery, state


def found(path, text, *sorts):
    return [r[1:5] for r in discovery.parse(path, text) if r[0] in (sorts or ("module", "surface", "command", "pattern"))]


def test_package_json():
    text = json.dumps({"name": "app", "bin": {"run": "./cli.js"}, "main": "i.js", "dependencies": {"express": "1"}, "scripts": {"build": "tsc"}})
    assert found("p/package.json", text) == [("p", "app", "declared", None), ("p", "run", "cli", "p/cli.js"), ("p", "app", "library", "p/i.js"), ("p", "app", "backend_service", "express"), ("p", "build", "script", "tsc")]
    assert found("package.json", json.dumps({"name": "r", "workspaces": {"packages": ["a/*"]}})) == [(".", "r", "workspace", "a/*")]
    assert found("package.json", "{") == found("package.json", "[]") == []


def test_other_manifests():
    assert found("pnpm-workspace.yaml", "packages:\n  - 'a/*'\n  # c\n  - b\nother: 1\n - c") == [(".", None, "workspace", "a/*"), (".", None, "workspace", "b")]
    assert found("c/Cargo.toml", '[package]\nname="x"\n[[bin]]\nname="y"\npath="src/y.rs"\n[workspace]\nmembers=["m"]') == [("c", None, "workspace", "m"), ("c", "x", "declared", None), ("c", "y", "cli", "c/src/y.rs")]
    assert found("pyproject.toml", '[project]\nname="x"\n[project.scripts]\ny="x:main"') == [(".", "x", "declared", None), (".", "y", "cli", "x:main")]
    assert found("settings.gradle", "include ':a:b', ':c'") == [("a/b", "b", "declared", None), ("c", "c", "declared", None)]


def test_kbuild():
    text = "obj-y += a/ b.o \\\n  c/\nobj-$(CONFIG_X) += d/\nifdef Y\nobj-m += e/\nendif\nobj-m := f/ $(g)/ a/\n"
    assert found("drv/Makefile", text, "module") == [("drv/a", "a", "inferred", "obj-y"), ("drv/c", "c", "inferred", "obj-y"), ("drv/f", "f", "inferred", "obj-m")]
    assert [r[2] for r in found("Kbuild", text, "note")] == ["skipped_config_gated", "skipped_conditional", "skipped_inside_conditional", "skipped_conditional", "skipped_variable"]


def test_containers_and_make():
    assert found("d/Dockerfile", 'FROM a AS b\nCMD x\nFROM node:20\nEXPOSE 80\nENTRYPOINT ["node", "s.js"]') == [("d", "node:20", "backend_service", "node s.js"), ("d", "run", "container", "node s.js")]
    assert found("compose.yaml", "version: '3'\nservices:\n  web:\n    build: ./web\n    command: run it\n  db:\n    image: pg # x\nvolumes:\n  v:\n") == [("web", "web", "backend_service", None), (".", "web", "container", "run it"), (".", "db", "backend_service", "pg")]
    assert found("Makefile", "all: x\n\t@echo hi\n\t# no\nV := 1\n.PHONY: all\n\techo no\nx:\n\tgo a \\\n\t  b\n", "command") == [(".", "all", "make_target", "echo hi"), (".", "x", "make_target", "go a b")]


def test_tables(spark):
    df = spark.createDataFrame([("p/package.json", json.dumps({"name": "n", "main": "a.js", "module": "b.js"})), ("x.txt", "no"), ("q/package.json", "{")], "path string, text string")
    got = discovery.discovered(df)
    assert rows(got.select("path", "sort", "kind")) == [("p/package.json", "module", "declared"), ("p/package.json", "surface", "library")]
    twice = got.union(got.withColumn("source", F.lit("other")).withColumn("confidence", F.lit(0.9)))
    assert rows(discovery.merged_surfaces(twice).select("confidence", "sources")) == [(0.9, ["other", "package_json_main"])]


def test_equal_surfaces_in_order(spark):
    """Of equal confidence and source the first in order counts, not the least text; without an order the least text."""
    df = spark.createDataFrame([("r", "cli", None, "surface", "a", f"e{k}", 0.6, k) for k in (2040, 60, 300)], "root string, kind string, name string, sort string, source string, detail string, confidence double, ord long")
    assert discovery.merged_surfaces(df).first()["entrypoint"] == "e60"
    assert discovery.merged_surfaces(df.drop("ord")).first()["entrypoint"] == "e2040"


def test_state_bindings(spark):
    calls = spark.createDataFrame([("e1", "s1", "f1", "typescript", "fs", "readFile", "a.txt", True), ("e2", "s2", "f1", "typescript", "fs", "writeFile", "a.txt", False), ("e3", "s1", "f2", "typescript", "fs", "readFile", "b", True), ("e4", "s1", "f1", "typescript", "fs", "stat", "c", True), ("e5", "s1", "f1", "typescript", "fs", "readFile", "", True)], "edge_uid string, source_uid string, file_uid string, language string, module string, symbol string, logical_name string, literal boolean")
    imports = spark.createDataFrame([("f1", "fs"), ("f1", "fs"), ("f2", "path")], "file_uid string, module string")
    nodes, edges = state.emitted(state.matched(calls, imports, state.bindings(spark)), "r")
    assert rows(nodes) == [("r:fs:a.txt:FS_PATH", "FS_PATH", "a.txt")]
    assert rows(edges) == [("s1", "r:fs:a.txt:FS_PATH", "READS", "static"), ("s2", "r:fs:a.txt:FS_PATH", "WRITES", "inferred")]
    both = spark.createDataFrame([("s", "cache", "redis", "k", "read_write", True)], "source_uid string, resource_kind string, driver string, logical_name string, direction string, literal boolean")
    nodes, edges = state.emitted(both, "r")
    assert rows(nodes.select("key")) == [("r:cache:redis:k:STATE",)] and edges.count() == 2

"""Sources, the store and detectors on files and literal rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from helpers import rows
from loomgraph.operators import detectors, quality
from loomgraph.sources import files, schema
from loomgraph.sources.store import FactStore, envelope, newest


@pytest.fixture
def tree(tmp_path):
    for path, text in {
        "src/a.ts": "const x = process.env.PORT || '80'\n// process.env.HIDDEN\nfs.writeFile('out.txt')\nfs.unlink(p)", "src/b.py": '"""\nos.environ["DOC"]\n"""\nos.getenv("HOME")\nos.environ["HOME"]\n',
        "node_modules/x.js": "x", "notes.txt": "no", "README.md": "# hi", "package.json": json.dumps({"dependencies": {"b": "1", "a": "2"}}), "src/package.json": json.dumps({"devDependencies": {"c": "1"}}), "src/sub/c.ts": "x", "src/empty.ts": "", "bad/package.json": "{", "tsconfig.json": '{"compilerOptions": {"paths": {"@app/*": ["x"],}}} // end',
    }.items():
        (tmp_path / "tree" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / path).write_text(text)
    return str(tmp_path / "tree")


def test_scan(spark, tree):
    got = files.scan(spark, tree)
    assert [r[0] for r in rows(got.select("path"))] == ["src/a.ts", "src/b.py", "src/sub/c.ts"]
    assert got.filter("path = 'src/sub/c.ts'").first()["content_hash"] == "2d711642b726b044"
    assert [r[0] for r in rows(files.doc_files(spark, tree).select("path"))] == ["README.md"]


def test_manifests_and_nearest(spark, tree):
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(tree)
    texts = raw.select(F.regexp_replace("path", f"^.*{tree}/", "").alias("path"), F.decode("content", "UTF-8").alias("text"))
    found = files.manifests(texts)
    got = {r["path"]: (r["dependencies"], r["aliases"], r["error"] is not None) for r in found.collect()}
    assert got == {"package.json": (["a", "b"], [], False), "src/package.json": (["c"], [], False), "bad/package.json": ([], [], True), "tsconfig.json": ([], ["@app/*"], False)}
    near = {r["path"]: r["manifest"] for r in files.nearest(files.scan(spark, tree), found, "package.json").collect()}
    assert near == {"src/a.ts": "src/package.json", "src/b.py": "src/package.json", "src/sub/c.ts": "src/package.json"}


def test_other_manifests():
    assert files.MANIFESTS["Cargo.toml"]("[dependencies]\nserde-json = '1'\n")[0] == ["serde_json"]
    assert files.MANIFESTS["pyproject.toml"]('[project]\ndependencies = ["numpy>=2", "x[y]"]\n')[0] == ["numpy", "x"]
    assert files.MANIFESTS["requirements.txt"]("# c\n-r other\nflask==1  # web\n")[0] == ["flask"]
    assert files.MANIFESTS["build.gradle"]("implementation 'org.a:b:1'\napi(\"org.c:d:2\")")[0] == ["org.a", "org.c"]


def test_numstat(spark):
    text = "COMMIT_BOUNDARY\n1\t2\t./a.ts\n-\t-\tb.png\n\nCOMMIT_BOUNDARY\n3\t0\ta.ts\nnoise\n"
    df = spark.createDataFrame(list(enumerate(text.split("\n"))), "id long, value string")
    got = files.numstat(df)
    assert rows(got.select("commit", "file", "added", "deleted")) == [(1, "a.ts", 1, 2), (1, "b.png", 0, 0), (2, "a.ts", 3, 0)]
    assert rows(quality.churn(got.withColumnRenamed("file", "file_uid"))) == [("a.ts", 2, 6), ("b.png", 1, 0)]


def test_coverage_report(spark):
    report = {"/r/a.ts": {"s": {"0": 1, "1": 0}, "f": {}, "b": {"0": [1, 0, 0]}}, "/other/b.ts": {"s": {"0": 1}}, "/r/c.ts": {"x": 1}}
    name, reader = files.coverage_reader(json.dumps(report))
    got = reader(spark.createDataFrame([(json.dumps(report),)], "value string"), "/r")
    assert name == "istanbul" and rows(got) == [("a.ts", 0.5, None, 1 / 3)]
    with pytest.raises(ValueError, match="no reader"):
        files.coverage_reader("<xml/>")


def test_detectors(spark, tree):
    got = detectors.detect_all(files.scan(spark, tree))
    assert rows(got.filter("family = 'env'").select("path", "line", "value", "detail", "kind")) == [("src/a.ts", 1, "PORT", "80", "optional"), ("src/b.py", 4, "HOME", None, "optional")]
    assert rows(got.filter("family = 'fs'").select("line", "value", "kind", "dynamic")) == [(3, "out.txt", "write_file", False), (4, None, "delete_path", True)]


def test_masking_keeps_places():
    text = 'a = "// no" /* yes\nyes */ b // yes\n'
    masked = detectors.mask_comments(text, "typescript")
    assert len(masked) == len(text) and masked.count("\n") == 2 and '"// no"' in masked and "yes" not in masked
    assert detectors.mask_comments("x = '#no' # yes\n", "python") == "x = '#no'      \n"


def test_commands(spark):
    df = spark.createDataFrame([("s", "A=1 B=2 npx build docs && run tests | tee log; # note\ndeploy > out")], "source string, script string")
    assert [r[0] for r in detectors.shell_commands(df).orderBy("ord").select("command").collect()] == ["build docs", "run tests", "deploy"]


def test_surfaces(spark):
    df = spark.createDataFrame([("abcd1", "k1", "web"), ("abcd2", "k2", "web"), ("zz", "k3", "cli")], "uid string, key string, name string")
    asked = spark.createDataFrame([("abcd1",), ("abcd",), ("k3",), ("web",), ("cli",), ("no",)], "query string")
    got = {r["query"]: (r["status"], r["uid"]) for r in detectors.resolve_surface(asked, df).collect()}
    assert got == {"abcd1": ("found", "abcd1"), "abcd": ("ambiguous", None), "k3": ("found", "zz"), "web": ("ambiguous", None), "cli": ("found", "zz"), "no": ("not_found", None)}


def test_annotations(spark):
    df = spark.createDataFrame([("t", "docstring", 9, "f"), ("t", "docstring", 3, "f"), ("t", "module_readme", 1, "g")], "target string, kind string, line long, file string")
    assert rows(detectors.annotations_by_target(df).select("kind", "line", "rank")) == [("docstring", 3, 4), ("module_readme", 1, 1)]


def test_store(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "store"))
    assert store.read("nodes").count() == 0 and store.latest("r") is None
    edges = spark.createDataFrame([("e1", "s1", "r", "a", "b", "CALLS"), ("e2", "s1", "r", "b", "c", "IMPORTS")], "edge_uid string, snapshot_uid string, repo_uid string, source_node_uid string, target_node_uid string, type string")
    for _ in range(2):  # repeating a write changes nothing
        store.replace("edges", edges)
    store.replace("edges", edges.withColumn("snapshot_uid", F.lit("s2")).limit(1))
    assert store.read("edges", "s1").count() == 2 and store.read("edges").count() == 3
    for uid, at in (("s1", "2024"), ("s2", "2025")):
        store.publish({"snapshot_uid": uid, "repo_uid": "r", "created_at": at, "kind": "full"})
    store.fail({"snapshot_uid": "s3", "repo_uid": "r", "created_at": "2026", "kind": "full"})
    assert store.latest("r") == "s2" and store.read("snapshots", "s1").first()["edges_total"] == 2
    store.upsert("edges", edges.limit(1).withColumn("type", F.lit("READS")), ["edge_uid", "snapshot_uid"], ("snapshot_uid",))
    assert rows(store.read("edges", "s1").select("edge_uid", "type")) == [("e1", "READS"), ("e2", "IMPORTS")]
    with pytest.raises(ValueError, match="NOPE"):
        store.replace("edges", edges.withColumn("type", F.lit("NOPE")))


def test_small_parts(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k int, v string, at int")
    assert rows(newest(df, ["k"], "at").select("v")) == [("b",)]
    assert json.loads(envelope(df, "callers", "r", "s").first()[0])["result"]["v"] == "a"
    assert rows(schema.duplicates(df, ["k"])) == [(1, 2)]

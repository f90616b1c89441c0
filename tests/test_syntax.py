"""Extraction from source text, with the odd cases that the catalogue's made-up files don't hold."""

from __future__ import annotations

import ast
import random
import subprocess

import pytest

from helpers import rows
from loomgraph.operators import declarations, docs, indexing, interfaces, policy, resolve, syntax
from loomgraph.sources import files


def measured(source):
    return tuple(syntax.metrics(ast.parse(source).body[0]).values())


@pytest.mark.parametrize(
    ("source", "cyclomatic", "depth", "cognitive"),
    [
        ("def f(): pass", 1, 0, 0),
        ("def f():\n if a: pass", 2, 1, 1),
        ("def f():\n if a: pass\n elif b: pass\n else: pass", 3, 1, 3),
        ("def f():\n if a:\n  if b: pass", 3, 2, 3),
        ("def f():\n if a: pass\n else:\n  if b: pass", 3, 2, 4),
        ("def f():\n try: pass\n except A: pass\n except B: pass", 3, 2, 2),
        ("def f(): return a and b or c", 3, 0, 2),
        ("def f(): return a if b else c", 2, 0, 1),
        ("def f():\n for x in y:\n  while x: pass", 3, 2, 3),
        ("def f():\n match a:\n  case 1: pass\n  case 2: pass", 3, 1, 1),
        ("def f():\n def g():\n  if a: pass", 1, 0, 0),
        ("def f():\n x = lambda: a and b", 1, 0, 0),
    ],
)
def test_metrics(source, cyclomatic, depth, cognitive):
    got = measured(source)
    assert (got[0], got[1], got[4]) == (cyclomatic, depth, cognitive)


def test_parameters_and_length():
    assert measured("def f(a, /, b, *c, d=1, **e):\n  return a")[2:4] == (5, 2)


def test_import_paths():
    keys = [syntax.module_key(s, "src/app/x.py") for s in ("os", "a.b", ".", ".y", "..y.z", "...w", "....far")]
    assert keys == ["os", "a/b", "src/app", "src/app/y", "src/y/z", "w", "far"]


def test_symbols_of_odd_files():
    got = syntax.extract("a.py", "class _A(B, c.D):\n  def __x(self): pass\n  def __y__(self): pass\n  @p\n  async def _z(self): pass\n  class I: pass\ndef g():\n  def h(): k()\n  (lambda: m.n(q()))()\n  print(1)\ndef g(): again()\nfrom . import u as v, w\nimport r.s, t as tt\n")
    assert [(s["qualified_name"], s["subtype"], s["visibility"]) for s in got["symbols"]] == [("_A", "CLASS", "private"), ("_A.__x", "METHOD", "private"), ("_A.__y__", "METHOD", "internal"), ("_A._z", "METHOD", "internal"), ("g", "FUNCTION", "export")]
    assert got["symbols"][0]["bases"] == ["B", "c.D"]
    assert [(r["source"], r["target_key"]) for r in got["refs"]] == [("g", "m.n"), ("g", "q"), (None, ""), (None, ""), (None, "r/s"), (None, "t")]
    assert [(b["identifier"], b["specifier"], b["imported_name"]) for b in got["bindings"]] == [("v", ".", "u"), ("w", ".", "w"), ("r.s", "r.s", None), ("tt", "t", None)]


FILES = "path string, content_hash string, language string, text string"


def source(spark, **texts):
    made = [(p.replace("__", "/") + ".py", str(hash(t)), "python", t) for p, t in texts.items()]
    return spark.createDataFrame(made, FILES)


def test_files_without_parts(spark):
    df = spark.createDataFrame([("a.py", "1", "python", None), ("b.py", "2", "python", ""), ("c.py", "3", "python", "def ("), ("d.ts", "4", "typescript", "x"), ("e.py", "5", "python", "x = " + "(" * 3000 + ")" * 3000), ("f.py", "6", "python", "a\x00b")], FILES)
    got = {r["path"]: (r["parse_status"], len(r["symbols"])) for r in syntax.facts(df).collect()}
    assert got == {"a.py": ("parsed", 0), "b.py": ("parsed", 0), "c.py": ("failed", 0), "e.py": ("failed", 0), "f.py": ("failed", 0)}


def test_refresh_equals_new_index(spark):
    old = source(spark, a__x="from b import y\ndef fx(): y.go()\n", b__y="def go(): fx()\n", c__z="import b.y\ndef fz(): go()\n", d__q="def lone(): pass\n")
    new = source(spark, a__x="from b import y\ndef fx(): y.go()\n", b__y="def gone(): fx()\n", e__n="from a.x import fx\ndef fn(): fx()\ndef go(): pass\n", c__z="import b.y\ndef fz(): go()\n")
    again, fresh = indexing.refresh(syntax.facts(old), new), indexing.index(new)
    for table in ("nodes", "edges", "unresolved"):
        assert rows(getattr(again, table)) == rows(getattr(fresh, table)), table
    assert ("c/z.py#fz#FUNCTION", "e/n.py#go#FUNCTION", "CALLS") in rows(again.edges)


@pytest.mark.parametrize("seed", [1])
def test_linking_what_changed_equals_a_new_index(spark, seed):
    """Random edits: files change, come and go, names become ambiguous or single, imports find or lose their file."""
    rnd = random.Random(seed)
    names, places = ["f", "g", "h", "k"], ["a/x", "a/y", "b/y", "b/__init__", "c/d/z", "top", "c/w"]

    def text():
        lines = [f"from {rnd.choice(['a.x', 'a.y', 'b', 'b.y', 'c.d.z', 'top', 'os'])} import {rnd.choice(names)}" for _ in range(rnd.randint(0, 3))]
        for name in rnd.sample(names, rnd.randint(0, 3)):
            lines += [f"def {name}():", f"    {rnd.choice(names)}()", f"    o.{rnd.choice(names)}()"]
        return "\n".join(lines) or "pass"

    texts = {p: text() for p in places[: 5 + seed]}
    table = lambda: spark.createDataFrame([(f"{p}.py", str(hash(t)), "python", t) for p, t in texts.items()], FILES)
    index = indexing.index(table())
    for _ in range(1 + seed):
        for p in rnd.sample(places, 3):
            if p in texts and rnd.random() < 0.4:
                del texts[p]
            else:
                texts[p] = text()
        again, fresh = indexing.refresh_links(index, table()), indexing.index(table())
        for name in ("nodes", "edges", "unresolved", "links"):
            one, two = getattr(again, name), getattr(fresh, name)
            assert rows(one.select(sorted(one.columns))) == rows(two.select(sorted(two.columns))), name
        index = fresh
    same = indexing.refresh_links(index, table())
    assert rows(same.edges) == rows(index.edges) and rows(same.nodes) == rows(index.nodes)


def test_index_of_nothing(spark):
    made = indexing.index(spark.createDataFrame([], FILES))
    assert not rows(made.nodes) and not rows(made.edges) and not rows(made.unresolved)


def test_interfaces_of_odd_texts(spark):
    js = spark.createDataFrame(
        [("a.ts", None), ("b.ts", "app.get('/x')"), ("c.ts", "require(\"express\")\napp.GET(\n'/late')\napp.get('/')\napp.get(dynamic)\nserver.all(`${process.env.HOST}/h/${a}/:b`)\nmyapp.get('/no')"), ("d.ts", "const P = '/one'\nconst P = '/two'\naxios.get(P)\nfetch(`${P}/x`)\nfetch('http://far/x')\naxios.delete(`${o.p}/q`)")],
        "path string, text string",
    )
    assert rows(interfaces.routes(js)) == [("c.ts", 6, "ALL", "/h/{param}/{b}")]
    assert rows(interfaces.requests(js)) == [("d.ts", 3, "axios", "GET", "/one", "template", 0.85), ("d.ts", 4, "fetch", "GET", "/one/x", "template", 0.75)]
    java = spark.createDataFrame([("A.java", "class A {\n@GetMapping(path = {\"a\", \"b\"})\nvoid a() {}\n@RequestMapping\nvoid b() {}}"), ("B.java", None), ("C.java", "@RequestMapping(\n  value = \"/r/\")\n@Deprecated public final class C { @DeleteMapping(\"/z\") void z() {} }")], "path string, text string")
    assert rows(interfaces.annotated_routes(java)) == [("A.java", 2, "GET", "/a"), ("A.java", 4, "ANY", "/"), ("C.java", 3, "DELETE", "/r/z")]


def test_nested_commands():
    text = "const a = program.command('a');\nconst b = a.command('b <x>').description('B');\nb\n  .command('c')\n  .action(f);\nconst loop = loop.command('l');\nloop.command('m').action(g);"
    assert [c[:2] for c in interfaces.find_commands(text)] == [(2, "a b"), (4, "a b c"), (7, "l m")]


C = """
#define X(a) { a
struct s { int a; };
int table[] = { 1, 2 };
static err_code to_err(long *http) {
    switch (*http) { case 200: { return OK; } case 404: log(1); return MISSING; case 5: break; }
    return OTHER;
}
plain_t not_status(int a) { switch (a) { case 1: return 2; } return 0; }
int waits(void) {
    do { r = try_it(); usleep(5000); } while (r != 0);
    while (1) { sleep(1); }
    for (;;) { poll(f, 1, 50); if (done(f)) { return 1; } }
    for (int n = 3; n >= 0; n--) nanosleep(&t, 0);
}
int fates(struct s *p) {
    int a = one(two(), p->three(1));
    p->x = (four() != 0) ? 1 : 2;
    if ((a = five()) < 0 || six() == 1) return seven() + 1;
    for (i = eight(); nine(i); ten()) ;
    eleven() ? twelve() : 0;
    switch (thirteen()) { case 1: fourteen(); }
    while (!fifteen()) { }
    if (a) b = sixteen(); else p->c[1] = k ? seventeen() : eighteen();
    again: nineteen();
    return sizeof(a);
}
int open_ended(int a) { one(
"""


def test_policy_facts():
    code = policy.plain(C)
    made = list(policy.functions(code))
    assert [f.name for f in made] == ["to_err", "not_status", "waits", "fates", "open_ended"]
    assert [m for f in made if (m := policy.status_mapping(code, f))] == [("to_err", 5, 8, "long", "err_code", [(["200"], "OK"), (["404"], "MISSING")], "OTHER")]
    assert [(m[4], m[5], m[6], m[7], m[8]) for f in made for m in policy.markers(code, f)] == [("do_while", "usleep", 5, None, None), ("for", "poll", 50, None, "done(f)"), ("for", "nanosleep", None, 4, None)]
    got = {callee: (fate, detail) for f in made if f.name == "fates" for _, callee, _, fate, detail, _ in policy.return_fates(code, f)}
    assert got == {
        "one": ("STORED", "a"), "two": ("TRANSFORMED", "one"), "three": ("TRANSFORMED", "one"), "four": ("CHECKED", "comparison"), "five": ("STORED", "a"), "six": ("CHECKED", "comparison"), "seven": ("PROPAGATED", None), "eight": ("STORED", "i"),
        "nine": ("CHECKED", "for"), "ten": ("IGNORED", None), "eleven": ("CHECKED", "ternary"), "twelve": ("IGNORED", None), "thirteen": ("CHECKED", "switch"), "fourteen": ("IGNORED", None), "fifteen": ("CHECKED", "while"),
        "sixteen": ("STORED", "b"), "seventeen": ("STORED", "p->c[1]"), "eighteen": ("STORED", "p->c[1]"), "nineteen": ("IGNORED", None),
    }


def test_policy_of_null(spark):
    df = spark.createDataFrame([("a.c", "c", None), ("b.py", "python", "x")], "path string, language string, text string")
    assert not rows(policy.status_mappings(df)) and not rows(policy.behavioral_markers(df)) and not rows(policy.fates(df))


def test_environments_of_files(spark):
    df = spark.createDataFrame([(".env", "", False), ("a/.env.test", None, True), (".envrc", "", False), ("compose.yml", "services:\n\tweb:\n\t\timage: x", False), ("docker-compose.local.yml", "services: {}\nx:\n  y:\n", False), ("stage/compose.yml", None, False)], "path string, text string, generated boolean")
    got = [(r[0], r[1], r[2], round(r[3], 3)) for r in rows(docs.environment_facts(df))]
    assert got == [(".env", ".", "default", 0.9), (".envrc", ".", "unknown", 0.9), ("a/.env.test", "a", "test", 0.72), ("compose.yml", "web", "default", 0.9)]


def test_declare_and_repeat(spark):
    asked = spark.createDataFrame([("r", "m", "n", None), ("r", "m", "n", None), ("r", "", "n", "x"), ("r", None, None, None)], "repo_uid string, module string, forbids string, reason string")
    made = declarations.declare(asked, "boundary").collect()
    assert [(r["target_stable_key"], r["value_json"], r["error"]) for r in made] == [("r:m:MODULE", '{"forbids":"n","module":"m"}', None)] * 2 + [(None, None, "missing: module"), (None, None, "missing: module, forbids")]
    assert made[0]["declaration_uid"] == made[1]["declaration_uid"] and made[2]["declaration_uid"] is None
    for kind in declarations.VERBS:
        assert declarations.declare(asked, kind).count() == 4


def test_one_file_classified_both_ways(spark):
    edges = spark.createDataFrame([("e1", "f", "calls_obj_method_needs_type_info", "app.use.x"), ("e2", "f", "calls_function_ambiguous_or_missing", "own"), ("e3", "f", "instantiates_class_not_found", "Lib"), ("e4", "f", "imports_file_not_found", "lib/x"), ("e5", "f", "implements_interface_not_found", "Shape"), ("e6", "f", "calls_function_ambiguous_or_missing", "zzz")], "edge_uid string, file_uid string, category string, target_key string")
    bindings = spark.createDataFrame([("f", "app", "express", False), ("f", "Lib", "lib", False)], "file_uid string, identifier string, specifier string, relative boolean")
    symbols = spark.createDataFrame([("f", "own", "FUNCTION"), ("f", "Shape", "INTERFACE"), ("g", "zzz", "FUNCTION")], "file_uid string, name string, subtype string")
    packages = spark.createDataFrame([("f", ["lib"], [])], "file_uid string, dependencies array<string>, aliases array<string>")
    runtime = spark.createDataFrame([([], [])], "runtime_modules array<string>, runtime_globals array<string>")
    by_file = resolve.classify_by_file(edges, bindings, symbols, packages, runtime)
    one = spark.createDataFrame([(["own"], [], ["Shape"], ["lib"], [], [], [], [("app", "express", False), ("Lib", "lib", False)])], "value_symbols array<string>, class_symbols array<string>, interface_symbols array<string>, dependencies array<string>, aliases array<string>, runtime_modules array<string>, runtime_globals array<string>, bindings array<struct<identifier:string,specifier:string,relative:boolean>>")
    assert rows(by_file.select(*edges.columns, "classification", "basis")) == rows(resolve.classify(edges, one).select(*edges.columns, "classification", "basis"))
    assert [r["basis"] for r in by_file.orderBy("edge_uid").collect()] == ["express_middleware_registration", "callee_matches_same_file_symbol", "callee_matches_external_import", "specifier_matches_package_dependency", "callee_matches_same_file_symbol", "no_supporting_signal"]


def test_changed_files_of_a_work_tree(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    for name in ("a.txt", "b.txt", "c.txt"):
        (tmp_path / name).write_text(name * 20)
    git("add", "."), git("commit", "-qm", "one")
    (tmp_path / "a.txt").write_text("new")
    git("rm", "-q", "b.txt")
    root = str(tmp_path)
    assert rows(files.changed_files(spark, root)) == [("a.txt", "modified"), ("b.txt", "deleted")]
    assert rows(files.changed_files(spark, root, "staged")) == [("b.txt", "deleted")]
    assert rows(files.changed_files(spark, root, "since", "HEAD")) == [("a.txt", "modified"), ("b.txt", "deleted")]
    with pytest.raises(ValueError):
        files.changed_files(spark, root, "since")


def test_an_index_broadcasts_no_table_of_files_or_symbols(spark):
    """Spark's estimates are of keys, not of what is parsed out of them; sorted merges keep the driver out of it."""
    files_ = source(spark, a__x="from b import y\ndef fx(): y.go()\n", b__y="def go(): fx()\n")
    made = indexing.index(files_)
    for df in (made.edges, made.unresolved, indexing.refresh(made.facts, files_).edges):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert made.facts.inputFiles()  # written once: files aren't parsed again for every table

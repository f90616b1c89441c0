"""Patterns against brute force, canonical JSON against a plain recursion."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import canonical, globs


def by_hand(path, pattern):
    out = ""
    for part in re.split(r"(\*\*|\*)", pattern):
        out += {"**": ".*", "*": "[^/]*"}.get(part, re.escape(part))
    return re.fullmatch(out, path, re.S) is not None


def test_patterns_against_brute_force(spark):
    rnd = random.Random(4)
    words = ["src", "lib", "a", "b.ts", "c.test.ts", "x.rs", "(odd)", "d+e", ".env"]
    paths = {"/".join(rnd.choice(words) for _ in range(rnd.randint(1, 5))) for _ in range(150)} | {"", "src/", "line\nbreak.ts"}
    parts = [*words, "*", "**", "*.ts", "x*", "*.test.*", "**.rs", "?"]
    patterns = {"/".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(400)} | {"", "*", "**", "**/*.ts", "src/**", "src/*/b.ts", "**/a/**", "[x"}
    got = globs.matches(spark.createDataFrame([(p,) for p in [*paths, *paths, None]], "path string"), spark.createDataFrame([(p,) for p in [*patterns, None, "*"]], "pattern string"))
    assert sorted(map(tuple, got.collect())) == sorted((p, g) for p in paths for g in patterns if by_hand(p, g))


def test_ten_thousand_patterns_meet_by_equality(spark):
    patterns = spark.range(10_000).selectExpr("concat('pkg', id, '/src/**/*.ts') as pattern")
    paths = spark.range(20_000).selectExpr("concat('pkg', id % 12000, '/src/a/f', id, case when id % 2 = 0 then '.ts' else '.js' end) as path")
    found = globs.matches(paths, patterns)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == sum(1 for i in range(20_000) if i % 2 == 0 and i % 12_000 < 10_000)


def test_includes_and_excludes(spark):
    frame = lambda rows, name: spark.createDataFrame([(r,) for r in rows], f"{name} string")
    paths = frame(["src/a.ts", "src/x/b.ts", "lib/c.ts", "lib/gen.ts"], "path")
    got = {r.path: (r.included, r.excluded) for r in globs.routed(paths, frame(["src/**"], "pattern"), frame(["gen.ts", "src/*.ts"], "pattern")).collect()}
    assert got == {"src/a.ts": (True, True), "src/x/b.ts": (True, False), "lib/c.ts": (False, False), "lib/gen.ts": (False, True)}
    assert all(r.included and not r.excluded for r in globs.routed(paths, frame([], "pattern"), frame([], "pattern")).collect())


def plain(v):
    if isinstance(v, dict):
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + plain(v[k]) for k in sorted(v, key=lambda k: k.encode("utf-16-be"))) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False)
    return "null" if v is None else {True: "true", False: "false"}[v]


def test_canonical_json(spark):
    rnd = random.Random(6)

    def value(depth):
        kind = rnd.randint(0, 6 if depth else 3)
        if kind < 2:
            return rnd.choice(["", 'quote " \\ / \n\t\x01\x1f', "é漢\U0001f600", "plain", "\x7f "])
        if kind < 4:
            return rnd.choice([None, True, False])
        if kind < 5:
            return [value(depth - 1) for _ in range(rnd.randint(0, 12))]
        return {rnd.choice(["b", "a", "B", "é", "￮", "\U0001f600", "k\n", "10", "9"]): value(depth - 1) for _ in range(rnd.randint(0, 5))}

    values = [value(5) for _ in range(60)]
    rows = [(i, json.dumps(v, ensure_ascii=i % 2 == 0, indent=i % 3 or None)) for i, v in enumerate(values)]
    got = {r.id: r.canonical for r in canonical.canonical_json(spark.createDataFrame(rows, "id long, body string"), "body").collect()}
    assert got == {i: plain(v) for i, v in enumerate(values)}


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("1.0", "1"), ("-0", "0"), ("1e2", "100"), ("0.1", "0.1"), ("-12.50", "-12.5"), ("0.0001", "0.0001"), ("0.000001", "0.000001"), ("1e-7", "1e-7"), ("1.5e-9", "1.5e-9"), ("1e20", "100000000000000000000"), ("1e21", "1e+21"), ("12345678901234567890", "12345678901234567000"), ("1.25e300", "1.25e+300"), ("123456789.125", "123456789.125"),
     ("{}", "{}"), ("[ ]", "[]"), ("[1, [2, {}]]", "[1,[2,{}]]"), ("nonsense", None), ('{"a":1,"a":2}', None), (None, None)],
)
def test_canonical_forms(spark, given, wanted):
    assert canonical.canonical_json(spark.createDataFrame([(given,)], "body string"), "body").first().canonical == wanted


def test_canonical_json_needs_only_the_row(spark):
    """Nothing is shuffled or stored, however deep: a level of nesting was a job, a stored table and a join."""
    deep, long = "[" * 200 + "]" * 200, '"' + 'x\\n"' .replace('"', '\\"') * 50_000 + '"'
    odd = '{"b": ["Infinity", 1e400, -1e400, "#"], "#": "\\\\u001F \\u001F\\u001f", "a": "1.0 -2e3"}'
    got = canonical.canonical_json(spark.createDataFrame([(0, deep), (1, long), (2, odd), (3, None)], "id long, body string"), "body")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r.canonical for r in got.orderBy("id").collect()] == [deep, long, '{"#":"\\\\u001F \\u001f\\u001f","a":"1.0 -2e3","b":["Infinity",Infinity,-Infinity,"#"]}', None]


def test_a_pattern_is_found_by_its_longest_literal(spark):
    """A file's name below a wildcard tells more than the few directories before it, which all such patterns share."""
    df = spark.createDataFrame([("r/*/name.rs",), ("r/**/*5.ts",), ("long/way/*/x.ts",), ("r/*/*",)], "pattern string")
    assert [x[0] for x in df.select(globs._anchor(F.col("pattern"))).collect()] == ["sname.rs", "dr", "dlong/way", "dr"]

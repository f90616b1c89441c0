from __future__ import annotations

import os
import random
from collections import Counter

import pytest

from llm_cases import KIND

corpus_pipeline = pytest.importorskip("corpus_pipeline")


WORDS = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work government number night point home water room mother area money story fact month lot right study book eye job word business issue side kind head house service friend father power hour game line end member law car city community name president team minute idea body information back parent face others level office door health person art war history party result change morning reason research girl guy moment air teacher force education".split()


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture
def folder(spark, tmp_path):
    rnd = random.Random(9)
    good = [prose(rnd, 150) for _ in range(40)]
    edited = good[0].split()
    edited[70] = "edited"
    texts = [*good, good[1], good[2].replace(" ", "  "), " ".join(edited), "short", None, "same words again " * 60]
    data = [(i, t, "en", f"s{i % 3}", None, *"cccccc") for i, t in enumerate(texts)]
    spark.createDataFrame(data, KIND).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), data


def test_stages(spark, folder):
    path, data = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept, order = [], []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        kept.append({r["doc_id"] for r in docs.collect()})
        order.append(docs.columns)
    assert [c == order[0] for c in order] == [True] * 4 + [False]
    assert kept[0] == set(range(43))
    assert kept[1] == set(range(40)) | {42}
    assert kept[2] == set(range(40))
    assert kept[3] <= kept[2] and kept[4] == kept[3]


def test_run(spark, folder):
    from loomgraph.llm import bpe, mixing

    path, data = folder
    got = corpus_pipeline.run(spark, path).collect()
    clean = spark.createDataFrame(data[:40], KIND)
    want = {r["doc_id"]: r["copies"] for r in mixing.plan(clean).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in got) == want
    text = {r[0]: r[1] for r in data}
    codec = bpe.codec()
    assert all(codec.decode(__import__("numpy").array(r["ids"])) == text[r["doc_id"]] for r in got)


def test_run_on_nothing(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_missing_and_repeated_identifiers(spark, tmp_path):
    """Rows without an identifier, rows that share one, whole rows twice: of each text one row stays, none goes for its identifier."""
    rnd = random.Random(19)
    good = [prose(rnd, 150) for _ in range(12)]
    given = [(None, good[0]), (None, good[1]), (None, good[1]), (5, good[2]), (5, good[3]), (5, good[3]), (6, good[4]), (None, good[4]), (7, good[5] + " more"), (5, good[5]), (None, None), (8, None), *((20 + i, t) for i, t in enumerate(good[6:]))]
    docs = spark.createDataFrame([(i, t, "en", None, None, *"cccccc") for i, t in given], KIND)
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in docs.collect())
    assert kept == sorted((i is None, i or 0, t) for i, t in [(None, good[0]), (None, good[1]), (5, good[2]), (5, good[3]), (6, good[4]), (5, good[5]), *((20 + i, t) for i, t in enumerate(good[6:]))])


def test_operators_on_the_given_tables(spark):
    """The registered queries of small tables, as far as SQL states them."""
    import duckdb

    from loomgraph.llm.queries import ORACLE_SQL, QUERIES

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("needs the test tables")
    con = duckdb.connect()
    for name in ("documents", "conversations", "pages"):
        con.sql(f"create view {name} as select * from '{data}/{name}.parquet'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, data)
        columns = sorted(df.columns)
        found = con.sql(sql)
        at = [found.columns.index(c) for c in columns]
        assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in found.fetchall()), name


def test_a_worker_holds_one_operators_memory():
    from loomgraph.llm import common

    made = []
    make = lambda *a: made.append(a) or a
    other = lambda: made.append("other")
    uses = common.trimmed(lambda batches: (common.held(make, 1) for _ in batches))
    idle = common.trimmed(lambda batches: (b for b in batches))
    list(uses([0, 0])), list(uses([0]))
    assert made == [(1,)] and common._HELD
    list(idle([0]))
    assert not common._HELD
    list(uses([0]))
    common.held(other)
    assert made == [(1,), (1,), "other"] and len(common._HELD) == 1
    common._HELD.clear()

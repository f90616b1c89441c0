"""Queries that go through the versioned store, and those over many patterns and nested JSON.

Each writes what it derives from the given tables to a store of its own under the shared folder, changes it, and returns
what the store then says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import canonical, globs
from ..operators.graph import shared_folder
from ..sources.projection import Graph
from ..sources.versioned import VersionedStore
from .catalogue import query

FACTS = """facts as (select target_uid || ':' || kind as uid, 's' || substr(target_uid, 2)::bigint % 3 as snapshot, kind, value_json as value, substr(target_uid, 2)::bigint as k from measurements)"""


def _facts(g: Graph) -> DataFrame:
    key = F.substring("target_uid", 2, 20).cast("long")
    return g.measurements().select(F.concat_ws(":", "target_uid", "kind").alias("measurement_uid"), F.concat(F.lit("s"), (key % 3).cast("string")).alias("snapshot_uid"), F.lit("r").alias("repo_uid"), F.col("target_uid").alias("target_stable_key"), "kind", "value_json", key.alias("k"))


def _store(g: Graph) -> VersionedStore:
    return VersionedStore(g.spark, f"{shared_folder(g.spark)}/store-{uuid.uuid4().hex}")


def _written(g: Graph) -> VersionedStore:
    store = _store(g)
    t = store.begin()
    t.append("measurements", _facts(g))
    t.commit()
    return store


def _said(store: VersionedStore) -> DataFrame:
    return store.read("measurements").select(F.col("measurement_uid").alias("uid"), F.col("snapshot_uid").alias("snapshot"), "kind", F.col("value_json").alias("value"))


@query(f"+ {FACTS} select uid, snapshot, kind, value from facts where not (k % 4 = 1 and kind <> 'parameter_count')")
def measurements_after_uid_deletion(g):
    """Rows are deleted by a list of identifiers, merged on read."""
    store = _written(g)
    t = store.begin()
    t.delete("measurements", _facts(g).filter("k % 4 = 1 and kind <> 'parameter_count'").select("measurement_uid"))
    t.commit()
    return _said(store)


@query(f"+ {FACTS} select uid, snapshot, kind, value from facts where snapshot <> 's2'")
def measurements_after_snapshot_deletion(g):
    store = _written(g)
    t = store.begin()
    t.delete_where("measurements", snapshot_uid="s2")
    t.commit()
    return _said(store)


ONE = '{"value":1}'


@query(f"+ {FACTS} select uid, snapshot, kind, value from facts where not (snapshot = 's1' and kind = 'parameter_count') union all select uid || '!', snapshot, kind, '{ONE}' from facts where snapshot = 's1' and kind = 'parameter_count' and k % 2 = 0")
def measurements_after_kind_replacement(g):
    """One kind of one snapshot is replaced, then the table is compacted."""
    store, old = _written(g), _facts(g).filter("snapshot_uid = 's1' and kind = 'parameter_count' and k % 2 = 0")
    t = store.begin()
    t.replace("measurements", old.withColumn("measurement_uid", F.concat("measurement_uid", F.lit("!"))).withColumn("value_json", F.lit(ONE)), snapshot_uid="s1", kind="parameter_count")
    t.commit()
    store.compact("measurements")
    return _said(store)


@query(
    """with b as (select user_id, event_id % 3 as batch, max({'ts': ts, 'event_id': event_id}).event_id as event_id from events where user_id is not null group by 1, 2)
  select user_id, max({'batch': batch, 'event_id': event_id}).event_id as event_id from b group by 1""",
    plain=True,
)
def merged_event_batches(g):
    """Each user's newest event of the last batch that has one; batch 1 comes again after batch 2 and changes nothing."""
    store = _store(g)
    for number in (0, 1, 2, 1):
        rows = g.table("events").filter((F.col("event_id") % 3 == number) & F.col("user_id").isNotNull()).groupBy("user_id").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("e"))
        t = store.begin()
        t.upsert("measurements", rows.select(F.col("user_id").cast("string").alias("measurement_uid"), F.lit("s").alias("snapshot_uid"), F.col("e").cast("string").alias("value_json")), ["measurement_uid"])
        t.commit(("events", number))
    return store.read("measurements").select(F.col("measurement_uid").cast("long").alias("user_id"), F.col("value_json").cast("long").alias("event_id"))


@query("select 's' || substr(uid, 2)::bigint % 2 as snapshot, 'ready' as status, count(*) as nodes_total from symbols group by 1 union all select 's9', 'ready', 0")
def published_snapshots(g):
    """Snapshots with their facts, each in one commit; one has none, one is published twice."""
    store, nodes = _store(g), g.symbols().select(F.col("uid").alias("node_uid"), F.concat(F.lit("s"), (F.substring("uid", 2, 20).cast("long") % 2).cast("string")).alias("snapshot_uid"), "name")
    for uid in ("s0", "s1", "s9", "s1"):
        store.publish_snapshot({"snapshot_uid": uid, "repo_uid": "r", "created_at": "2025-01-01T00:00:00Z"}, {"nodes": nodes.filter(F.col("snapshot_uid") == uid)})
    return store.read("snapshots").select(F.col("snapshot_uid").alias("snapshot"), "status", "nodes_total")


# A pattern for each supplier and nation: literal paths, directories, segments, ends and bare wildcards.
PATTERNS = """globs as (select case s_suppkey % 6 when 0 then 'ASIA/**/*' || (s_suppkey % 10) || '.ts' when 1 then '**/*' || (s_suppkey % 100) || '.rs' when 2 then '*/' || n_name || '/Supplier*' when 3 then r_name || '/*/' || s_name || '.rs' when 4 then r_name || '/' || n_name || '/' || s_name || '.rs' else '**/' || n_name || '/**0.ts' end as pattern
  from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey union select '*' from nation)"""


def _patterns(g: Graph) -> DataFrame:
    rows = g.table("supplier").join(g.table("nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(g.table("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    one = F.expr("""case s_suppkey % 6 when 0 then 'ASIA/**/*' || (s_suppkey % 10) || '.ts' when 1 then '**/*' || (s_suppkey % 100) || '.rs' when 2 then '*/' || n_name || '/Supplier*' when 3 then r_name || '/*/' || s_name || '.rs'
      when 4 then r_name || '/' || n_name || '/' || s_name || '.rs' else '**/' || n_name || '/**0.ts' end""")
    return rows.select(one.alias("pattern")).union(g.table("nation").select(F.lit("*").alias("pattern"))).distinct()


REGEX = r"""regexp_full_match(path, replace(replace(replace(regexp_replace(pattern, '([.\\+^$|()\[\]{{}}?])', '\\\1', 'g'), '**', chr(1)), '*', '[^/]*'), chr(1), '.*'), 's')""".replace("{{", "{").replace("}}", "}")


@query(f"+ {PATTERNS} select path, pattern from files, globs where {REGEX}")
def paths_by_patterns(g):
    return globs.matches(g.files(), _patterns(g))


@query(f"""+ {PATTERNS}, hit as (select distinct path, pattern from files, globs where {REGEX} or pattern = split_part(path, '/', -1))
  select path, count(*) filter (starts_with(pattern, '*')) > 0 as included, count(*) filter (starts_with(pattern, 'ASIA')) > 0 as excluded from files left join hit using (path) group by 1""")
def routed_paths(g):
    """Included by the patterns that begin with a wildcard, excluded by those of one region."""
    patterns = _patterns(g)
    return globs.routed(g.files(), patterns.filter("pattern like '*%'"), patterns.filter("pattern like 'ASIA%'"))


# Orders as nested JSON with keys out of order, and the same in canonical form; ~ stands for a backslash, which the two engines read differently.
NESTED = """replace('{ "z" : {"b": [1.0, ' || (o_custkey % 7) || '.50, {"y": "' || o_orderstatus || '~n~"", "x": null}], "a": true},  "k' || (o_custkey % 3) || '": [], "A": 1' || o_orderkey || 'e2, "m": {"t": {"v": [[' || o_custkey || '],{}]}} }', '~', {slash})"""
CANONICAL = """replace('{"A":1' || o_orderkey || '00,"k' || (o_custkey % 3) || '":[],"m":{"t":{"v":[[' || o_custkey || '],{}]}},"z":{"a":true,"b":[1,' || case when o_custkey % 7 = 0 then '0.5' else (o_custkey % 7) || '.5' end || ',{"x":null,"y":"' || o_orderstatus || '~n~""}]}}', '~', chr(92))"""


@query("with t as (select o_orderkey, " + CANONICAL + " as canonical from orders) select o_orderkey, canonical, substr(sha256(canonical), 1, 16) as identity from t", plain=True)
def canonical_documents(g):
    """Canonical form of nested JSON, and the identity hashed from it."""
    docs = g.table("orders").select("o_orderkey", F.expr(NESTED.replace("{slash}", "char(92)")).alias("body"))
    return canonical.canonical_json(docs, "body").select("o_orderkey", "canonical", F.substring(F.sha2("canonical", 256), 1, 16).alias("identity"))

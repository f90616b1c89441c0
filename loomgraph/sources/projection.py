"""Relational tables seen as a code graph.

A fixed, deterministic projection: nations are modules, suppliers and customers are files, parts are symbols; line
items give imports, calls, accesses, churn and unresolved references. ``until`` restricts line items to those shipped
before a day, which makes an earlier snapshot of the same graph. The same definitions stand in ``PROJECTION_SQL``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EARLIER = "1998-07-01"


def _uid(letter: str, key: str):
    return F.concat(F.lit(letter), F.col(key).cast("string"))


class Graph:
    """Lazy fact tables of one snapshot."""

    def __init__(self, spark: SparkSession, sf_dir: str, until: str | None = None):
        self.spark, self.dir, self.until = spark, sf_dir, until

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def lineitem(self) -> DataFrame:
        rows = self.table("lineitem")
        return rows.filter(F.col("l_shipdate") < F.lit(self.until).cast("timestamp_ntz")) if self.until else rows

    def regions(self) -> DataFrame:
        return self.table("region").select(_uid("R", "r_regionkey").alias("uid"), F.col("r_name").alias("path"))

    def modules(self) -> DataFrame:
        """uid, path of the modules that own files. One row for each nation: small whatever the scale."""
        both = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return both.select(_uid("M", "n_nationkey").alias("uid"), F.concat_ws("/", "r_name", "n_name").alias("path"), _uid("R", "r_regionkey").alias("parent_uid"))

    def files(self) -> DataFrame:
        modules = self.modules().select(F.col("uid").alias("module_uid"), F.col("path").alias("_module"))
        suppliers = self.table("supplier").select(_uid("S", "s_suppkey").alias("uid"), F.concat("s_name", F.lit(".rs")).alias("_name"), F.lit("rust").alias("language"), (F.col("s_acctbal") < 0).alias("is_test"), _uid("M", "s_nationkey").alias("module_uid"))
        customers = self.table("customer").select(_uid("C", "c_custkey").alias("uid"), F.concat("c_name", F.lit(".ts")).alias("_name"), F.lit("typescript").alias("language"), (F.col("c_acctbal") < 0).alias("is_test"), _uid("M", "c_nationkey").alias("module_uid"))
        return suppliers.unionByName(customers).join(modules, "module_uid").select("uid", F.concat_ws("/", "_module", "_name").alias("path"), "language", "is_test", "module_uid")

    def symbols(self) -> DataFrame:
        homes = self.lineitem().groupBy("l_partkey").agg(F.min("l_suppkey").alias("_s")).select("l_partkey", _uid("S", "_s").alias("file_uid"))
        subtype = F.element_at(F.array(*(F.lit(x) for x in ("CLASS", "INTERFACE", "TYPE_ALIAS", "ENUM", "FUNCTION"))), F.col("p_size") % 5 + 1)
        start = F.col("p_partkey") % 1000
        return self.table("part").join(homes, F.col("p_partkey") == F.col("l_partkey"), "left").select(
            _uid("P", "p_partkey").alias("uid"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), subtype.alias("subtype"),
            F.when(F.col("p_size") > 25, "export").otherwise("private").alias("visibility"), start.alias("line_start"), (start + F.col("p_size")).alias("line_end"), "file_uid",
        )

    def file_imports(self) -> DataFrame:
        """src, dst: distinct imports of file by file."""
        rows = self.lineitem().filter("l_returnflag = 'R' and l_quantity >= 48").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return rows.select(_uid("C", "o_custkey").alias("src"), _uid("S", "l_suppkey").alias("dst")).distinct()

    def module_imports(self) -> DataFrame:
        """src, dst: distinct imports across modules."""
        home = self.files().select("uid", "module_uid")
        a, b = home.toDF("src", "_a"), home.toDF("dst", "_b")
        return self.file_imports().join(a, "src").join(b, "dst").filter("_a <> _b").select(F.col("_a").alias("src"), F.col("_b").alias("dst")).distinct()

    def calls(self) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
        rows = self.lineitem().filter("l_quantity >= 40").select(F.lag("l_partkey").over(order).alias("_a"), F.col("l_partkey").alias("_b"))
        return rows.filter("_a is not null and _a <> _b").select(_uid("P", "_a").alias("src"), _uid("P", "_b").alias("dst")).distinct()

    def accesses(self) -> DataFrame:
        """src, resource, type (READS, WRITES): symbols that touch a resource."""
        rows = self.lineitem().filter("l_quantity = 50").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return rows.select(_uid("P", "l_partkey").alias("src"), F.col("o_orderpriority").alias("resource"), F.when(F.col("l_linestatus") == "O", "READS").otherwise("WRITES").alias("type")).distinct()

    def measurements(self) -> DataFrame:
        """target_uid, kind, value_json: three kinds for each symbol."""
        part = self.table("part")
        kinds = F.map_from_arrays(F.array(F.lit("cyclomatic_complexity"), F.lit("parameter_count"), F.lit("max_nesting_depth")), F.array(F.col("p_size").cast("long"), F.col("p_partkey") % 7, (F.col("p_size") % 6).cast("long")))
        return part.select(_uid("P", "p_partkey").alias("target_uid"), F.explode(kinds).alias("kind", "_n")).select("target_uid", "kind", F.concat(F.lit('{"value":'), F.col("_n").cast("string"), F.lit("}")).alias("value_json"))

    def coverage(self) -> DataFrame:
        """path, line_coverage of files whose key isn't divisible by ten."""
        key = F.substring("uid", 2, 20).cast("long")
        return self.files().filter(key % 10 != 0).select("path", ((key % 101) / 100).alias("line_coverage"))

    def commits(self) -> DataFrame:
        """commit, file_uid, added, deleted: a row for each file that a commit touches, as often as it does."""
        return self.lineitem().select(F.col("l_orderkey").alias("commit"), _uid("S", "l_suppkey").alias("file_uid"), F.col("l_quantity").cast("long").alias("added"), F.col("l_linenumber").cast("long").alias("deleted"))

    def unresolved(self) -> DataFrame:
        """edge_uid, source_uid, category, target_key: unresolved references, one for each line of under 3 items."""
        names = ("calls_function_ambiguous_or_missing", "calls_obj_method_needs_type_info", "calls_this_method_needs_class_context", "calls_this_wildcard_method_needs_type_info", "imports_file_not_found", "instantiates_class_not_found", "other")
        rows = self.lineitem().filter("l_quantity < 3")
        n = F.col("l_linenumber")
        category = F.element_at(F.array(*(F.lit(x) for x in names)), n)
        base = F.concat(F.lit("fn"), (F.col("l_partkey") % 50).cast("string"))
        key = F.when(n == 2, F.concat(F.element_at(F.array(*(F.lit(x) for x in ("app", "lodash", "console", "helper", "local"))), (F.col("l_partkey") % 5 + 1).cast("int")), F.lit(".get"))).when(n == 3, F.concat(F.lit("this."), base)).when(n == 4, F.concat(F.lit("this."), base, F.lit(".*"))).when(n == 5, F.element_at(F.array(*(F.lit(x) for x in ("./local/x", "lodash/fp", "fs", "@app/core", "serde_json::value", "unknown-pkg"))), (F.col("l_partkey") % 6 + 1).cast("int"))).when(n == 6, F.concat(F.lit("Cls"), (F.col("l_partkey") % 20).cast("string"))).otherwise(base)
        return rows.select(F.concat_ws("-", F.lit("U"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("edge_uid"), _uid("P", "l_partkey").alias("source_uid"), category.alias("category"), key.alias("target_key"))


class Staged(Graph):
    """The same tables, each written once under the shared folder when it is first asked for.

    For queries whose parts read the same facts many times: every part scans what is there, with its own columns and
    filters, in place of projecting it anew; plans stay small, and Spark knows the tables' sizes.
    """

    def __init__(self, g: Graph):
        super().__init__(g.spark, g.dir, g.until)
        self._paths: dict[str, DataFrame] = {}

    def _written(self, name: str) -> DataFrame:
        from ..operators.graph import shared_folder

        if name not in self._paths:
            df, path = getattr(Graph, name)(self), f"{shared_folder(self.spark)}/facts-{uuid.uuid4().hex}"
            df.write.parquet(path)
            self._paths[name] = self.spark.read.schema(df.schema).parquet(path)
        return self._paths[name]


for _name in ("modules", "files", "symbols", "file_imports", "module_imports", "calls", "measurements", "commits"):
    setattr(Staged, _name, lambda self, name=_name: self._written(name))


# The same projection for DuckDB, as common table expressions; {where} restricts line items.
PROJECTION_SQL = r"""
li as (select * from lineitem {where}),
regions as (select 'R' || r_regionkey as uid, r_name as path from region),
modules as (select 'M' || n_nationkey as uid, r_name || '/' || n_name as path, 'R' || r_regionkey as parent_uid from nation join region on n_regionkey = r_regionkey),
files as (select f.uid, m.path || '/' || f.name as path, f.language, f.is_test, f.module_uid
          from (select 'S' || s_suppkey as uid, s_name || '.rs' as name, 'rust' as language, s_acctbal < 0 as is_test, 'M' || s_nationkey as module_uid from supplier
                union all select 'C' || c_custkey, c_name || '.ts', 'typescript', c_acctbal < 0, 'M' || c_nationkey from customer) f
          join modules m on m.uid = f.module_uid),
symbols as (select 'P' || p_partkey as uid, p_name as name, p_brand || '.' || p_name as qualified_name,
                   ['CLASS', 'INTERFACE', 'TYPE_ALIAS', 'ENUM', 'FUNCTION'][p_size % 5 + 1] as subtype,
                   case when p_size > 25 then 'export' else 'private' end as visibility, p_partkey % 1000 as line_start, p_partkey % 1000 + p_size as line_end, h.file_uid
            from part left join (select l_partkey, 'S' || min(l_suppkey) as file_uid from li group by l_partkey) h on p_partkey = h.l_partkey),
file_imports as (select distinct 'C' || o_custkey as src, 'S' || l_suppkey as dst from li join orders on l_orderkey = o_orderkey where l_returnflag = 'R' and l_quantity >= 48),
module_imports as (select distinct a.module_uid as src, b.module_uid as dst from file_imports i join files a on a.uid = i.src join files b on b.uid = i.dst where a.module_uid <> b.module_uid),
calls as (select distinct 'P' || a as src, 'P' || b as dst from (select lag(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as a, l_partkey as b from li where l_quantity >= 40) where a is not null and a <> b),
accesses as (select distinct 'P' || l_partkey as src, o_orderpriority as resource, case when l_linestatus = 'O' then 'READS' else 'WRITES' end as type from li join orders on l_orderkey = o_orderkey where l_quantity = 50),
measurements as (select 'P' || p_partkey as target_uid, k.kind, '{{"value":' || k.n || '}}' as value_json
                 from part, lateral (values ('cyclomatic_complexity', p_size::bigint), ('parameter_count', p_partkey % 7), ('max_nesting_depth', (p_size % 6)::bigint)) k(kind, n)),
coverage as (select path, (substr(uid, 2)::bigint % 101) / 100.0::double as line_coverage from files where substr(uid, 2)::bigint % 10 <> 0),
commits as (select l_orderkey as "commit", 'S' || l_suppkey as file_uid, l_quantity::bigint as added, l_linenumber::bigint as deleted from li),
unresolved as (select 'U-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as edge_uid, 'P' || l_partkey as source_uid,
                 ['calls_function_ambiguous_or_missing', 'calls_obj_method_needs_type_info', 'calls_this_method_needs_class_context', 'calls_this_wildcard_method_needs_type_info', 'imports_file_not_found', 'instantiates_class_not_found', 'other'][l_linenumber] as category,
                 case l_linenumber when 2 then ['app', 'lodash', 'console', 'helper', 'local'][(l_partkey % 5 + 1)::int] || '.get' when 3 then 'this.fn' || l_partkey % 50 when 4 then 'this.fn' || l_partkey % 50 || '.*'
                   when 5 then ['./local/x', 'lodash/fp', 'fs', '@app/core', 'serde_json::value', 'unknown-pkg'][(l_partkey % 6 + 1)::int] when 6 then 'Cls' || l_partkey % 20 else 'fn' || l_partkey % 50 end as target_key
               from li where l_quantity < 3)
"""


def projected(sql: str, until: str | None = None) -> str:
    """A query (without ``with``) over the projection's tables."""
    where = f"where l_shipdate < timestamp '{until} 00:00:00'" if until else ""
    return f"with {PROJECTION_SQL.format(where=where)}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}"

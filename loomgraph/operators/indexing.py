"""A whole index of source files, and its refresh after a change.

Extraction looks at each file alone; linking needs all of them. ``refresh`` extracts what changed, copies the facts of
all other files, and links again. ``refresh_links`` links again only what the change can touch: references of changed files,
imports of keys that a file gained or lost, and calls of names whose candidates changed or whose file now imports others.
Edges, nodes and unresolved references of untouched sources are copied. Both give what a new index would.

Defined cases: a null text counts as empty; files that don't parse are files without symbols; an import that two files
answer goes to the exact path before the one without extension; an empty table gives empty tables; a change of nothing
gives the parent's tables.

Files, references and symbols are of any number and come out of few bytes, which Spark's estimate of sizes can't know:
facts are written before they are linked, so that files are parsed once, and joins of such tables ask for sorted merges,
so that none is collected for a broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import dirname
from . import incremental, resolve, syntax
from .graph import written


@dataclass(frozen=True)
class Index:
    """The tables of one snapshot. ``facts`` is what a later refresh starts from."""

    facts: DataFrame
    nodes: DataFrame  # uid, kind, subtype, name, path
    edges: DataFrame  # src, dst, type
    unresolved: DataFrame  # edge_uid, source_uid, path, type, target_key, category
    links: DataFrame  # edge_uid, source_uid, path, type, target_key, target_uid (null: unresolved)


def _uid(*parts) -> F.Column:
    return F.concat_ws("#", *parts)


LINK = ("edge_uid", "source_uid", "path", "type", "target_key", "target_uid")


def _module(path) -> F.Column:
    return F.when(dirname(path) == "", ".").otherwise(dirname(path))


def _owner(c: str) -> F.Column:
    return F.concat(F.col(c), F.lit(":MODULE"))


def _symbols(facts: DataFrame) -> DataFrame:
    return syntax.symbols(facts).select(_uid("path", "qualified_name", "subtype").alias("uid"), "name", "subtype", "path", "qualified_name")


def _asked(facts: DataFrame) -> DataFrame:
    """The references of files, as links without targets."""
    refs = syntax.references(facts).withColumn("edge_uid", _uid("path", F.col("ord").cast("string")))
    # Method and function of one qualified name can't both be the source: the source's subtype follows from its dot.
    source = _uid("path", "source", F.when(F.col("source").contains("."), "METHOD").otherwise("FUNCTION"))
    return refs.filter("type in ('IMPORTS', 'CALLS')").select("edge_uid", F.when(F.col("type") == "IMPORTS", F.col("path")).otherwise(source).alias("source_uid"), "path", "type", "target_key")


def _linked_imports(asked: DataFrame, keys: DataFrame) -> DataFrame:
    return asked.join(keys.select(F.col("key").alias("target_key"), F.col("uid").alias("target_uid")).hint("merge"), "target_key", "left").select(*LINK)


def _linked_calls(asked: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """``imports``: linked imports of all files that have a call here."""
    reached = imports.filter("target_uid is not null").select("path", "target_uid").distinct()
    seen = asked.select("edge_uid", "path").join(reached.hint("merge"), "path").select("edge_uid", F.col("target_uid").alias("file_uid"))
    called = resolve.resolve_calls(asked, symbols.withColumn("file_uid", F.col("path")), seen).select("edge_uid", "target_uid")
    return asked.join(called.hint("merge"), "edge_uid").select(*LINK)


def _nodes(paths: DataFrame, symbols: DataFrame) -> DataFrame:
    files = paths.select(F.col("path").alias("uid"), F.lit("FILE").alias("kind"), F.lit(None).cast("string").alias("subtype"), F.substring_index("path", "/", -1).alias("name"), "path")
    return files.unionByName(symbols.select("uid", F.lit("SYMBOL").alias("kind"), "subtype", "name", "path"))


def _module_nodes(homes: DataFrame) -> DataFrame:
    return homes.select("module").distinct().select(_owner("module").alias("uid"), F.lit("MODULE").alias("kind"), F.lit(None).cast("string").alias("subtype"), F.col("module").alias("name"), F.col("module").alias("path"))


def _plain_edges(links: DataFrame) -> DataFrame:
    return links.filter("target_uid is not null").select(F.col("source_uid").alias("src"), F.col("target_uid").alias("dst"), "type").distinct()


def _module_edges(homes: DataFrame, imports: DataFrame) -> DataFrame:
    """What modules own, and which others their files import; ``homes``: path, module of the sources."""
    reached = imports.filter("target_uid is not null").select("path", F.col("target_uid").alias("_file")).distinct()
    across = reached.join(homes.hint("merge"), "path").withColumn("_to", _module(F.col("_file"))).filter("module <> _to").select(_owner("module").alias("src"), _owner("_to").alias("dst"), F.lit("IMPORTS").alias("type")).distinct()
    return across.unionByName(homes.select(_owner("module").alias("src"), F.col("path").alias("dst"), F.lit("OWNS").alias("type")))


def _unresolved(links: DataFrame) -> DataFrame:
    return links.filter("target_uid is null").withColumn("category", resolve.categorise(F.col("type"), F.col("target_key"))).drop("target_uid")


def link(facts: DataFrame) -> Index:
    """Nodes for files, symbols and directories, resolved edges between them, and what stays unresolved."""
    files, symbols, asked = facts.select(F.col("path").alias("uid"), "path"), _symbols(facts), _asked(facts)
    homes = files.select("path", _module(F.col("path")).alias("module"))
    imports = _linked_imports(asked.filter("type = 'IMPORTS'"), resolve.file_keys(files))
    links = imports.unionByName(_linked_calls(asked.filter("type = 'CALLS'"), symbols, imports))
    return Index(facts, _nodes(files, symbols).unionByName(_module_nodes(homes)), _plain_edges(links).unionByName(_module_edges(homes, imports)), _unresolved(links), links)


def index(files: DataFrame) -> Index:
    """``files``: path, content_hash, language, text."""
    return link(written(syntax.facts(files)))


def refresh(parent: DataFrame, files: DataFrame) -> Index:
    """An index of ``files`` that extracts only what the parent's facts don't already say."""
    old = parent.select(F.col("path").alias("file_uid"), "path", "content_hash")
    plan = incremental.invalidation(old, files.select(F.col("path").alias("file_uid"), "path", "content_hash"))
    again = files.join(plan.filter("action = 'extract'").select("path"), "path", "left_semi")
    kept = parent.join(plan.filter("action = 'copy'").select("path"), "path", "left_semi")
    return link(written(kept.unionByName(syntax.facts(again))))


def _kept(df: DataFrame) -> DataFrame:
    return written(df).hint("merge")


def stored(made: Index) -> Index:
    """The same tables written once, as a refresh finds its parent's. Links are made once; edges and the unresolved come from them."""
    facts, links = written(made.facts), written(made.links)
    homes = facts.select("path", _module(F.col("path")).alias("module"))
    edges = _plain_edges(links).unionByName(_module_edges(homes, links.filter("type = 'IMPORTS'")))
    return Index(facts, written(made.nodes), written(edges), written(_unresolved(links)), links)


def refresh_links(parent: Index, files: DataFrame) -> Index:
    """An index of ``files`` that extracts and links only what a change since the parent can touch.

    Tables of the change are written first, so that Spark knows them to be small if they are. Of the references of
    untouched files only those that the change names are joined with symbols or files.
    """
    old = parent.facts.select(F.col("path").alias("file_uid"), "path", "content_hash")
    plan = _kept(incremental.invalidation(old, files.select(F.col("path").alias("file_uid"), "path", "content_hash")))
    changed = plan.filter("action <> 'copy'").select("path")
    before = parent.facts.join(changed, "path", "left_semi")
    after = _kept(syntax.facts(files.join(plan.filter("action = 'extract'").select("path"), "path", "left_semi")))
    facts = parent.facts.join(changed, "path", "left_anti").unionByName(after)
    places = facts.select(F.col("path").alias("uid"), "path")

    # Imports: those of changed files, and those of keys that files came to answer or no longer do.
    here, gone = after.select("path"), before.select("path")
    moved = here.join(gone, "path", "left_anti").union(gone.join(here, "path", "left_anti"))
    keys = _kept(resolve.file_keys(moved.select(F.col("path").alias("uid"), "path")).select("key"))
    kept = parent.links.join(changed, "path", "left_anti")
    stale_imports = _kept(kept.filter("type = 'IMPORTS'").join(keys.withColumnRenamed("key", "target_key"), "target_key", "left_semi").select(*LINK))
    asked = _kept(_asked(after))
    ask_imports = asked.filter("type = 'IMPORTS'").unionByName(stale_imports.drop("target_uid"))
    wanted = ask_imports.select(F.col("target_key").alias("key")).distinct()
    imports = _kept(_linked_imports(ask_imports, resolve.file_keys(places, wanted)))

    # Calls: those of changed files, of names whose candidates changed, and of files that import others than before.
    had, has = (_symbols(t).select("uid", "name", "subtype", "path") for t in (before, after))
    names = _kept(had.exceptAll(has).union(has.exceptAll(had)).select("name").distinct())
    turned = imports.join(stale_imports.select("edge_uid", F.col("target_uid").alias("_old")), "edge_uid").filter("not (target_uid <=> _old)").select("path").distinct()
    calls = kept.filter("type = 'CALLS'")
    forms = calls.select("edge_uid", F.explode(F.array_distinct(F.array("target_key", F.substring_index("target_key", ".", -1)))).alias("name"))
    named = forms.join(names, "name", "left_semi").select("edge_uid").union(calls.join(turned, "path", "left_semi").select("edge_uid")).distinct()
    stale_calls = _kept(calls.join(named, "edge_uid", "left_semi").select(*LINK))
    ask_calls = asked.filter("type = 'CALLS'").unionByName(stale_calls.drop("target_uid"))
    spelled = ask_calls.select(F.explode(F.array("target_key", F.substring_index("target_key", ".", -1))).alias("name")).distinct()
    stale = stale_imports.unionByName(stale_calls)
    untouched = kept.join(stale.select("edge_uid"), "edge_uid", "left_anti").select(*LINK)
    around = untouched.filter("type = 'IMPORTS'").unionByName(imports).join(ask_calls.select("path").distinct(), "path", "left_semi")
    fresh = _kept(imports.unionByName(_linked_calls(ask_calls, _symbols(facts).join(spelled, "name", "left_semi"), around)))
    links = untouched.unionByName(fresh)

    # Edges by source, modules by what changed below them: all of a touched one's are made again, others are copied.
    ended = parent.links.join(changed, "path", "left_semi").select(*LINK).unionByName(stale)
    sources = _kept(ended.unionByName(fresh).select(F.col("source_uid").alias("src")).distinct())
    modules = _kept(ended.unionByName(fresh).filter("type = 'IMPORTS'").select("path").union(changed).select(_module(F.col("path")).alias("module")).distinct())
    owners = modules.select(_owner("module").alias("src"))
    homes = places.select("path", _module(F.col("path")).alias("module")).join(modules, "module", "left_semi").select("path", "module")
    within = links.filter("type = 'IMPORTS'").join(homes.select("path"), "path", "left_semi")
    edges = parent.edges.join(sources.union(owners), "src", "left_anti").unionByName(_plain_edges(links.join(sources.withColumnRenamed("src", "source_uid"), "source_uid", "left_semi"))).unionByName(_module_edges(homes, within))
    nodes = (
        parent.nodes.filter("kind <> 'MODULE'").join(changed, "path", "left_anti").unionByName(parent.nodes.filter("kind = 'MODULE'").join(modules.withColumnRenamed("module", "path"), "path", "left_anti"))
        .unionByName(_nodes(here, _symbols(after))).unionByName(_module_nodes(homes))
    )
    unresolved = parent.unresolved.join(changed, "path", "left_anti").join(stale.select("edge_uid"), "edge_uid", "left_anti").unionByName(_unresolved(fresh))
    in_order = lambda df, like: df.select(*like.columns)
    return Index(facts, in_order(nodes, parent.nodes), in_order(edges, parent.edges), in_order(unresolved, parent.unresolved), links)

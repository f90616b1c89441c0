"""Resolution of raw references to targets, and classification of what stays unresolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import alias_matches, dirname, resolve_relative, strip_extension

_IDENTIFIER, _RUST_NAME = r"^[A-Za-z_$][A-Za-z0-9_$]*$", r"^[a-z][a-z0-9_]*$"
_THIS = ("calls_this_method_needs_class_context", "calls_this_wildcard_method_needs_type_info")
_CALL, _OBJECT, _NEW, _IMPLEMENTS, _IMPORT = "calls_function_ambiguous_or_missing", "calls_obj_method_needs_type_info", "instantiates_class_not_found", "implements_interface_not_found", "imports_file_not_found"
# Names of one web framework's imports, receivers and methods.
FRAMEWORK_IMPORTS, FRAMEWORK_RECEIVERS = ("express", "@types/express"), ("app", "router", "server")
FRAMEWORK_MIDDLEWARE, FRAMEWORK_ROUTES = ("use",), ("get", "post", "put", "delete", "patch", "options", "head", "all", "route", "listen")
# Specifiers that mark a file as a serverless handler's.
HANDLER_IMPORTS = ("aws-lambda", "@types/aws-lambda", "@middy/core", "middy", "serverless-http", "@vendia/serverless-express", "aws-serverless-express", "lambda-api")


def file_keys(files: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Every specifier that reaches a file: its path, that without extension, and its directory for index files.

    One file for each key: an exact path wins, then the first in order of path. Of the ``wanted`` keys only, if given.
    """
    path = F.col("path")
    bare = strip_extension(path)
    index = F.regexp_extract(path, r"^(.*)/(?:index\.tsx?|__init__\.py)$", 1)
    keys = F.array_compact(F.array(F.struct(path.alias("key"), F.lit(0).alias("rank")), F.when(bare != path, F.struct(bare.alias("key"), F.lit(1).alias("rank"))), F.when(index != "", F.struct(index.alias("key"), F.lit(1).alias("rank")))))
    found = files.select("uid", "path", F.explode(keys).alias("k"))
    found = found if wanted is None else found.join(wanted.select(F.col("key").alias("_key")), F.col("k.key") == F.col("_key"), "left_semi")
    return found.groupBy("k.key").agg(F.min_by("uid", F.struct("k.rank", "path")).alias("uid"))


def resolve_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    """edge_uid, source_path, specifier -> target_uid: relative specifiers resolve against the source's directory."""
    spec = F.col("specifier")
    target = F.when(spec.startswith("."), resolve_relative(F.concat(dirname(F.col("source_path")), F.lit("/"), spec))).otherwise(spec)
    return edges.withColumn("key", target).join(file_keys(files).withColumnRenamed("uid", "target_uid"), "key", "left").select("edge_uid", "source_path", "specifier", "key", "target_uid", F.col("target_uid").isNotNull().alias("resolved"))


#: What an edge of a type may point at; all else may be the target of any other type.
_FITS = {"INSTANTIATES": ("class", "subtype = 'CLASS'"), "IMPLEMENTS": ("interface", "subtype = 'INTERFACE'"), "CALLS": ("callable", "subtype not in ('TYPE_ALIAS', 'INTERFACE')")}


def _needs(edge_type: Column) -> Column:
    out = F.lit("any")
    for kind, (name, _) in _FITS.items():
        out = F.when(edge_type == kind, name).otherwise(out)
    return out


def _candidates(symbols: DataFrame, *keys: str) -> DataFrame:
    """One row for each key: how many symbols fit each need, and the least of them. A name that everyone uses meets an
    edge as one row, not as all its symbols."""
    tests = {name: test for name, test in _FITS.values()} | {"any": "true"}
    fits = [x for name, test in tests.items() for x in (F.lit(name), F.struct(F.count(F.when(F.expr(test), 1)).alias("n"), F.min(F.when(F.expr(test), F.col("uid"))).alias("uid")))]
    return symbols.groupBy(*(F.col(k).alias("_" + k) for k in keys)).agg(F.create_map(*fits).alias("_fits"))


def resolve_calls(edges: DataFrame, symbols: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """edge_uid, type, target_key -> target_uid, stage, candidates.

    A dotted key is looked up by its last segment; then the whole key by name; then by name among the files that the
    source imports (``bindings``: edge_uid, file_uid). A stage counts only if it leaves one fitting candidate.
    """
    last, key = F.substring_index("target_key", ".", -1), F.col("target_key")
    asked = edges.select("edge_uid", "type", "target_key", F.explode(F.array_compact(F.array(F.when(key.contains("."), F.struct(F.lit(1).alias("stage"), last.alias("_name"))), F.struct(F.lit(2).alias("stage"), key.alias("_name"))))).alias("a")).select("edge_uid", "type", "target_key", "a.*")
    found = asked.join(_candidates(symbols, "name").hint("merge"), "_name")
    if bindings is not None:
        at = asked.filter("stage = 2").join(bindings.select("edge_uid", F.col("file_uid").alias("_file")).distinct().hint("merge"), "edge_uid").withColumn("stage", F.lit(3))
        found = found.unionByName(at.join(_candidates(symbols, "name", "file_uid").withColumnRenamed("_file_uid", "_file").hint("merge"), ["_name", "_file"]).drop("_file"))
    fits = F.col("_fits")[_needs(F.col("type"))]
    staged = found.groupBy("edge_uid", "stage").agg(F.sum(fits["n"]).alias("n"), F.min(fits["uid"]).alias("target_uid")).filter("n > 0")
    best = staged.groupBy("edge_uid").agg(F.min_by("target_uid", F.when(F.col("n") == 1, F.col("stage"))).alias("target_uid"), F.min(F.when(F.col("n") == 1, F.col("stage"))).alias("stage"), F.max("n").alias("candidates"))
    return edges.select("edge_uid", "type", "target_key").join(best.hint("merge"), "edge_uid", "left").select("edge_uid", "type", "target_key", F.when(F.col("stage").isNotNull(), F.col("target_uid")).alias("target_uid"), F.col("stage").cast("long").alias("stage"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def resolve_includes(edges: DataFrame, files: DataFrame, roots: tuple = ("", "include", "src")) -> DataFrame:
    """edge_uid, source_path, include, quoted -> target, status: the same directory decides for quoted ones, then roots."""
    known = files.select(F.col("path").alias("candidate"), F.lit(True).alias("_known"))
    own = F.when(F.col("quoted"), F.struct(F.lit(0).alias("rank"), resolve_relative(F.concat(dirname(F.col("source_path")), F.lit("/"), F.col("include"))).alias("candidate")))
    others = [F.struct(F.lit(1).alias("rank"), resolve_relative(F.concat(F.lit(r + "/"), F.col("include"))).alias("candidate")) for r in roots]
    tried = edges.select("edge_uid", F.explode(F.array_distinct(F.array_compact(F.array(own, *others)))).alias("c")).select("edge_uid", "c.*").join(known, "candidate")
    best = tried.withColumn("_r", F.min("rank").over(Window.partitionBy("edge_uid"))).filter("rank = _r").groupBy("edge_uid").agg(F.countDistinct("candidate").alias("n"), F.min("candidate").alias("candidate"))
    status = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return edges.join(best, "edge_uid", "left").select("edge_uid", "include", F.when(F.col("n") == 1, F.col("candidate")).alias("target"), status.alias("status"))


def categorise(edge_type: Column, key: Column) -> Column:
    """The category of an unresolved edge."""
    dots = F.length(key) - F.length(F.replace(key, F.lit("."), F.lit("")))
    call = F.when(key.startswith("this.") & (dots > 1), _THIS[1]).when(key.startswith("this."), _THIS[0]).when(key.contains("."), _OBJECT).otherwise(_CALL)
    return F.when(edge_type == "IMPORTS", _IMPORT).when(edge_type == "INSTANTIATES", _NEW).when(edge_type == "IMPLEMENTS", _IMPLEMENTS).when(edge_type == "CALLS", call).otherwise("other")


def _depends(deps: Column, specifier: Column) -> Column:
    """Whether a package of an array is the specifier's: the same, or its first segment (two if scoped)."""
    root = F.when(specifier.startswith("@"), F.substring_index(specifier, "/", 2)).otherwise(F.substring_index(specifier, "/", 1))
    return F.array_contains(deps, specifier) | F.array_contains(deps, root)


def _identifier() -> Column:
    """The name whose origin tells where an unresolved edge leads: the callee, or the receiver of a method call."""
    key, category = F.col("target_key"), F.col("category")
    first = F.substring_index(key, ".", 1)
    return F.when(category.isin(_NEW, _IMPLEMENTS, _CALL) & key.rlike(_IDENTIFIER), key).when((category == _OBJECT) & key.contains(".") & first.rlike(_IDENTIFIER), first)


def classify(edges: DataFrame, signals: DataFrame) -> DataFrame:
    """edge_uid, category, target_key with one row of signals -> classification, basis; the first rule that fits.

    ``signals``: value_symbols, class_symbols, interface_symbols, dependencies, aliases, runtime_modules,
    runtime_globals (arrays) and bindings (array of identifier, specifier, relative). One file's or a repository's
    signals: a single row, so the join is a broadcast of one row. ``classify_by_file`` takes those of many files.
    """
    category = F.col("category")
    rows = edges.crossJoin(F.broadcast(signals)).withColumn("_id", _identifier())
    rows = rows.withColumn("_b", F.try_element_at(F.filter("bindings", lambda b: b["identifier"] == F.col("_id")), F.lit(1)))
    own = F.when(category.isin(_CALL, _OBJECT), F.array_contains("value_symbols", F.col("_id"))).when(category == _NEW, F.array_contains("class_symbols", F.col("_id"))).when(category == _IMPLEMENTS, F.array_contains("interface_symbols", F.col("_id"))).otherwise(False)
    rows = rows.withColumn("_own", own).withColumn("_framework", F.exists("bindings", lambda b: b["specifier"].isin(*FRAMEWORK_IMPORTS)))
    return _judged(rows, edges.columns)


def classify_by_file(edges: DataFrame, bindings: DataFrame, symbols: DataFrame, packages: DataFrame, runtime: DataFrame) -> DataFrame:
    """The same, each edge by the signals of its own file (``file_uid``); all joins are on equality with unique keys.

    ``bindings``: file_uid, identifier, specifier, relative (of several for one name, the least specifier counts);
    ``symbols``: file_uid, name, subtype; ``packages``: file_uid, dependencies, aliases of the nearest manifests;
    ``runtime``: one row of runtime_modules, runtime_globals, which a language fixes. A file without a row has no signal.
    """
    bound = bindings.groupBy("file_uid", F.col("identifier").alias("_id")).agg(F.min(F.struct("specifier", "relative")).alias("_b"))
    typed = F.col("subtype").isin("INTERFACE", "TYPE_ALIAS")
    named = symbols.groupBy("file_uid", F.col("name").alias("_id")).agg(F.bool_or(~typed).alias("_value"), F.bool_or(F.col("subtype") == "CLASS").alias("_class"), F.bool_or(F.col("subtype") == "INTERFACE").alias("_interface"))
    framework = bindings.filter(F.col("specifier").isin(*FRAMEWORK_IMPORTS)).select("file_uid").distinct().withColumn("_framework", F.lit(True))
    rows = edges.withColumn("_id", _identifier()).join(bound, ["file_uid", "_id"], "left").join(named, ["file_uid", "_id"], "left").join(packages.select("file_uid", "dependencies", "aliases"), "file_uid", "left").join(framework, "file_uid", "left").crossJoin(F.broadcast(runtime))
    category, none = F.col("category"), F.array().cast("array<string>")
    own = F.when(category.isin(_CALL, _OBJECT), F.col("_value")).when(category == _NEW, F.col("_class")).when(category == _IMPLEMENTS, F.col("_interface"))
    rows = rows.withColumn("_own", F.coalesce(own, F.lit(False))).withColumn("_framework", F.coalesce("_framework", F.lit(False))).withColumn("dependencies", F.coalesce("dependencies", none)).withColumn("aliases", F.coalesce("aliases", none))
    return _judged(rows, edges.columns)


def _judged(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The first rule that fits; rows carry ``_id``, ``_b`` (its binding), ``_own`` (a symbol of the file) and ``_framework``."""
    key, category = F.col("target_key"), F.col("category")
    first = F.substring_index(key, ".", 1)
    spec, relative = F.col("_b.specifier"), F.col("_b.relative")
    role = F.when(category == _OBJECT, "receiver").otherwise("callee")
    basis = lambda tail: F.concat(role, F.lit("_matches_" + tail))
    out = lambda kind, why: F.struct(F.lit(kind).alias("classification"), (F.lit(why) if isinstance(why, str) else why).alias("basis"))
    unknown = out("unknown", "no_supporting_signal")
    base = F.substring_index(key, "::", 1)
    hyphen = F.replace(base, F.lit("_"), F.lit("-"))
    imported = (
        F.when(key.startswith(".") | key.startswith("crate::") | key.startswith("super::") | key.startswith("self::"), out("internal_candidate", "relative_import_target_unresolved"))
        .when(_depends(F.col("dependencies"), base) | _depends(F.col("dependencies"), hyphen), out("external_library_candidate", "specifier_matches_package_dependency"))
        .when(key.contains(".") & ~key.contains("::") & ~key.contains("/") & F.exists("dependencies", lambda d: d.contains(".") & key.startswith(d)), out("external_library_candidate", "specifier_matches_package_dependency"))
        .when(F.array_contains("runtime_modules", key) | F.array_contains("runtime_modules", base), out("external_library_candidate", "specifier_matches_runtime_module"))
        .when(alias_matches(key, F.col("aliases")), out("internal_candidate", "specifier_matches_project_alias"))
        .when(key.contains(":FILE"), out("internal_candidate", "relative_import_target_unresolved"))
        .when(key.contains("::") & base.rlike(_RUST_NAME), out("internal_candidate", "rust_crate_internal_module_heuristic"))
        .otherwise(unknown)
    )
    method = F.substring_index(F.substring_index(key, ".", 2), ".", -1)
    framework = (category == _OBJECT) & F.col("_framework") & first.isin(*FRAMEWORK_RECEIVERS)
    verdict = (
        F.when(framework & method.isin(*FRAMEWORK_MIDDLEWARE), out("framework_boundary_candidate", "express_middleware_registration"))
        .when(framework & method.isin(*FRAMEWORK_ROUTES), out("framework_boundary_candidate", "express_route_registration"))
        .when(category.isin(*_THIS), out("internal_candidate", "this_receiver_implies_internal"))
        .when(category == _IMPORT, imported)
        .when((category == "other") | F.col("_id").isNull(), unknown)
        .when(F.col("_own"), out("internal_candidate", basis("same_file_symbol")))
        .when(~relative & F.array_contains("runtime_modules", spec), out("external_library_candidate", "specifier_matches_runtime_module"))
        .when(~relative & _depends(F.col("dependencies"), spec), out("external_library_candidate", basis("external_import")))
        .when(relative, out("internal_candidate", basis("internal_import")))
        .when(spec.isNotNull() & alias_matches(spec, F.col("aliases")), out("internal_candidate", "specifier_matches_project_alias"))
        .when(F.array_contains("runtime_globals", F.col("_id")), out("external_library_candidate", basis("runtime_global")))
        .otherwise(unknown)
    )
    return rows.select(*columns, verdict.alias("_v")).select(*columns, "_v.*")


def blast_radius(category: Column, basis: Column, visibility: Column) -> Column:
    """Struct of receiver_origin, scope and blast_radius."""
    call = category.startswith("calls_")
    origin = (
        F.when(~call, "not_applicable").when(basis == "this_receiver_implies_internal", "this_bound").when(basis.endswith("_external_import"), "import_bound_external")
        .when(basis.endswith("_internal_import") | (basis == "specifier_matches_project_alias"), "import_bound_internal").when(basis.endswith("_same_file_symbol"), "same_file_declared")
        .when(basis.endswith("_runtime_global"), "runtime_global").when(basis == "specifier_matches_runtime_module", "runtime_module").otherwise("local_like")
    )
    scope = F.when(~call, "unknown_scope").when(visibility.isin("export", "public"), "exported_public").when(visibility.isNull() | visibility.isin("private", "protected", "internal"), "internal_private").otherwise("unknown_scope")
    level = F.when(~call, "not_applicable").when(origin.isin("local_like", "this_bound"), F.when(scope == "exported_public", "medium").otherwise("low")).when(origin == "import_bound_internal", "medium").otherwise("low")
    return F.struct(origin.alias("receiver_origin"), scope.alias("scope"), level.alias("blast_radius"))


def handler_entrypoints(bindings: DataFrame, symbols: DataFrame) -> DataFrame:
    """Exported functions named handler in files that import a serverless runtime: entry points with confidence 0.9."""
    spec = F.col("specifier")
    files = bindings.filter(spec.isin(*HANDLER_IMPORTS) | spec.startswith("@aws-lambda-powertools/")).select("file_uid").distinct()
    return symbols.filter("name = 'handler' and visibility = 'export'").filter(F.col("subtype").isin("FUNCTION", "VARIABLE", "CONSTANT")).join(files, "file_uid", "left_semi").select("uid", F.lit("framework_entrypoint").alias("kind"), F.lit(0.9).alias("confidence"))


def container_managed(symbols: DataFrame, stereotypes: tuple = ("Component", "Service", "Repository", "Controller", "RestController", "Configuration")) -> DataFrame:
    """Classes with a stereotype annotation and methods that make beans, from ``annotations`` (array of names)."""
    simple = F.transform("annotations", lambda a: F.substring_index(a, ".", -1))
    hit = F.when(F.col("subtype") == "CLASS", F.try_element_at(F.filter(simple, lambda a: a.isin(*stereotypes)), F.lit(1))).when((F.col("subtype") == "METHOD") & F.array_contains(simple, "Bean"), "Bean")
    return symbols.withColumn("annotation", hit).filter("annotation is not null").select("uid", "annotation", F.lit("spring_container_managed").alias("kind"), F.lit(0.95).alias("confidence"))


def resolve_accesses(edges: DataFrame, nodes: DataFrame, kinds: tuple = ("TABLE", "STATE", "FS_PATH", "DB_RESOURCE", "BLOB", "CONFIG_KEY")) -> DataFrame:
    """READS and WRITES to their resource (target_uid, null if there is none): by stable key, else by a name that one
    resource alone has. Both joins have one row for each key."""
    found = nodes.filter(F.col("kind").isin(*kinds))
    by_key = found.groupBy(F.col("stable_key").alias("target_key")).agg(F.min("uid").alias("_k"))
    by_name = found.groupBy(F.col("name").alias("target_key")).agg(F.min("uid").alias("_n"), F.count("*").alias("_c")).filter("_c = 1").drop("_c")
    return edges.join(by_key, "target_key", "left").join(by_name, "target_key", "left").withColumn("target_uid", F.coalesce("_k", "_n")).drop("_k", "_n")


def promote_edges(candidates: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls whose receiver type is known and names one class with one such method become inferred CALLS edges.

    ``candidates``: edge_uid, source_uid, receiver_type, method; ``symbols``: uid, name, subtype, parent_uid.
    Returns edge_uid, source_uid, target_uid, skip (null if promoted).
    """
    classes = symbols.filter("subtype = 'CLASS'").groupBy(F.col("name").alias("receiver_type")).agg(F.count("*").alias("_nc"), F.min("uid").alias("_class"))
    methods = symbols.filter("subtype = 'METHOD'").groupBy(F.col("parent_uid").alias("_class"), F.col("name").alias("method")).agg(F.count("*").alias("_nm"), F.min("uid").alias("target_uid"))
    rows = candidates.join(classes, "receiver_type", "left").join(methods, ["_class", "method"], "left")
    skip = F.when(F.col("receiver_type").isNull(), "no_receiver_type").when(F.col("method").isNull(), "no_method").when(F.col("_nc").isNull(), "class_not_found").when(F.col("_nc") > 1, "class_ambiguous").when(F.col("_nm").isNull(), "method_not_found").when(F.col("_nm") > 1, "method_ambiguous")
    return rows.select("edge_uid", "source_uid", F.when(skip.isNull(), F.col("target_uid")).alias("target_uid"), skip.alias("skip"))

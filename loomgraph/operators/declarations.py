"""Human declarations: insertion by identity, supersession, deactivation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import _cut


def identity(kind, target, detail):
    """The uid of a declaration: equal content has equal uid."""
    return F.substring(F.sha2(F.concat_ws("|", kind, target, F.coalesce(detail, F.lit(""))), 256), 1, 32)


def insert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Append declarations whose uid isn't stored yet; a batch's own repeats go in once."""
    fresh = new.dropDuplicates(["declaration_uid"]).join(stored.select("declaration_uid"), "declaration_uid", "left_anti")
    return stored.unionByName(fresh)


def supersede(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New rows name what they supersede in ``supersedes_uid``; only an active one can be, and it goes out of force."""
    active = stored.filter("is_active").select(F.col("declaration_uid").alias("supersedes_uid"))
    valid = new.join(active, "supersedes_uid", "left_semi").select(*stored.columns)
    old = valid.select(F.col("supersedes_uid").alias("declaration_uid"), F.lit(True).alias("_old"))
    kept = stored.join(old, "declaration_uid", "left").withColumn("is_active", F.col("is_active") & F.col("_old").isNull()).select(*stored.columns)
    return kept.unionByName(valid)


def deactivate(stored: DataFrame, uids: DataFrame) -> DataFrame:
    gone = uids.select("declaration_uid").distinct().withColumn("_gone", F.lit(True))
    return stored.join(gone, "declaration_uid", "left").withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).select(*stored.columns)


def chains(stored: DataFrame) -> DataFrame:
    """declaration_uid, root_uid, depth: how far each declaration is from the first of its chain.

    Uids are unique. Pointers double, so rounds grow with the logarithm of the longest chain. A declaration whose chain
    begins at one that isn't stored, or runs in a ring, has no first one and no row.
    """
    old = F.col("supersedes_uid")
    state = _cut(stored.select("declaration_uid", F.coalesce(old, "declaration_uid").alias("root_uid"), old.isNotNull().cast("long").alias("depth"), old.isNull().alias("_first")))
    left = state.filter("not _first").count()
    while left:
        ahead = state.select(F.col("declaration_uid").alias("root_uid"), F.col("root_uid").alias("_root"), F.col("depth").alias("_depth"), F.col("_first").alias("_ends"))
        moved = state.filter("not _first").join(ahead, "root_uid").select("declaration_uid", F.col("_root").alias("root_uid"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_ends").alias("_first"))
        state = _cut(state.filter("_first").unionByName(moved))
        before, left = left, state.filter("not _first").count()
        if left == before:  # each round ends some chain, if any is left; these are rings
            break
    return state.filter("_first").drop("_first")


def inherit_obligations(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Obligations of a new version that mean the same as an earlier one keep its id; others get one from their content."""
    same = ["obligation", "method", "target", "threshold", "operator"]
    key = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in same)), 256)
    old = prior.withColumn("_k", key).groupBy("_k").agg(F.min("obligation_id").alias("_id"))
    return new.withColumn("_k", key).join(old, "_k", "left").withColumn("obligation_id", F.coalesce("_id", F.substring("_k", 1, 16))).drop("_k", "_id")


# What a declaration of each kind must say, and what it may say.
VERBS = {
    "boundary": (("module", "forbids"), ("reason",)),
    "requirement": (("req_id", "version", "obligation_id", "method", "obligation"), ("target", "threshold", "operator")),
    "waiver": (("req_id", "requirement_version", "obligation_id", "reason"), ("expires_at", "created_by", "rationale_category", "policy_basis")),
    "quality_policy": (("policy_id", "measurement_kind", "policy_kind", "threshold"), ("version", "scope", "severity")),
    "entrypoint": (("target", "entrypoint_kind"), ("reason",)),
    "invariant": (("target", "text"), ()),
    "module": (("path", "purpose"), ("maturity", "owner")),
}
WHOLE, NUMBERS = ("version", "requirement_version"), ("threshold",)


def declare(requests: DataFrame, kind: str) -> DataFrame:
    """Requests (repo_uid and the kind's fields, as text) -> declaration_uid, kind, target_stable_key, value_json, error.

    A request that lacks a field, or whose number isn't one, has an error and no declaration. Fields in JSON are in order
    of name, so equal requests have equal uids; repeated requests give repeated rows, which ``insert`` takes once.
    """
    needed, others = VERBS[kind]
    said = {c: F.col(c) if c in requests.columns else F.lit(None).cast("string") for c in (*needed, *others)}
    lacks = F.concat_ws(", ", *(F.when(F.coalesce(F.trim(said[c]), F.lit("")) == "", F.lit(c)) for c in needed))
    typed = {c: v.try_cast("long") if c in WHOLE else v.try_cast("double") if c in NUMBERS else v for c, v in said.items()}
    wrong = F.concat_ws(", ", *(F.when(said[c].isNotNull() & typed[c].isNull(), F.lit(c)) for c in said if c in WHOLE + NUMBERS))
    error = F.when(lacks != "", F.concat(F.lit("missing: "), lacks)).when(wrong != "", F.concat(F.lit("not a number: "), wrong))
    repo = F.col("repo_uid")
    target = {
        "boundary": F.concat_ws(":", repo, said.get("module", repo), F.lit("MODULE")), "module": F.concat_ws(":", repo, said.get("path", repo), F.lit("MODULE")),
        "requirement": F.concat_ws(":", repo, F.lit("requirement"), said.get("req_id", repo), typed.get("version", repo).cast("string")),
        "waiver": F.concat_ws(":", repo, F.lit("waiver"), F.concat_ws("#", said.get("req_id", repo), said.get("obligation_id", repo))), "quality_policy": F.concat_ws(":", repo, F.lit("REPO")),
    }.get(kind, said.get("target", repo))
    value = F.to_json(F.struct(*(typed[c].alias(c) for c in sorted(typed))))
    good = error.isNull()
    rows = requests.select("repo_uid", F.lit(kind).alias("kind"), F.when(good, target).alias("target_stable_key"), F.when(good, value).alias("value_json"), error.alias("error"))
    return rows.withColumn("declaration_uid", F.when(F.col("error").isNull(), identity(F.col("kind"), F.col("target_stable_key"), F.col("value_json"))))

"""Human declarations that the projection can't give, as literal rows for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# (columns as DDL, rows)
TABLES: dict[str, tuple[str, list[tuple]]] = {
    "rules": (
        "source string, target string, reason string",
        [
            ("ASIA/NATION_2", "EUROPE/NATION_3", "layering"), ("ASIA/NATION_7", "EUROPE/NATION_8", "layering"), ("AMERICA/NATION_1", "ASIA/NATION_2", "layering"), ("AFRICA/NATION_0", "AMERICA/NATION_6", "ownership"),
            ("EUROPE/NATION_13", "MIDDLE EAST/NATION_14", "ownership"), ("AFRICA/NATION_5", "AFRICA/NATION_5", "itself"), ("GONE/ONE", "ASIA/NATION_2", "stale"), ("ASIA/NATION_2", "GONE/TWO", "stale"), ("GONE/ONE", "GONE/TWO", "stale"),
            ("AFRICA/NATION_10", "EUROPE/NATION_18", "layering"), ("AFRICA/NATION_15", "ASIA/NATION_12", "layering"), ("MIDDLE EAST/NATION_4", "AFRICA/NATION_20", "layering"),
        ],
    ),
    "entrypoints": ("target_uid string", [("P1",), ("P2",), ("P3",), ("P5",), ("P8",)]),
    "inferences": ("target_uid string, kind string", [("P10", "spring_container_managed"), ("P11", "pytest_test"), ("P12", "hotspot_score"), ("P13", "framework_entrypoint")]),
    "obligations": (
        "req_id string, version int, obligation_id string, method string, target string, threshold double, operator string",
        [
            ("REQ-1", 1, "o1", "coverage_threshold", "ASIA", 0.4, None), ("REQ-1", 1, "o2", "coverage_threshold", "ASIA", 0.9, ">="), ("REQ-1", 1, "o3", "complexity_threshold", "EUROPE", 60.0, None),
            ("REQ-2", 1, "o1", "complexity_threshold", "EUROPE", 10.0, "<="), ("REQ-2", 1, "o2", "hotspot_threshold", None, 1000000000.0, None), ("REQ-2", 1, "o3", "hotspot_threshold", "AFRICA", 1.0, "<"),
            ("REQ-3", 2, "o1", "module_violations", None, None, None), ("REQ-3", 2, "o2", "arch_violations", "AFRICA", None, None), ("REQ-3", 2, "o3", "arch_violations", "NOWHERE", None, None),
            ("REQ-4", 1, "o1", "manual_review", None, None, None), ("REQ-4", 1, "o2", "coverage_threshold", None, 0.5, None), ("REQ-4", 1, "o3", "coverage_threshold", "NOWHERE", 0.5, None),
        ],
    ),
    "waivers": (
        "waiver_id string, req_id string, version int, obligation_id string, is_active boolean, expires_at string, created_at string",
        [
            ("w1", "REQ-1", 1, "o2", True, None, "2024-01-01T00:00:00Z"), ("w2", "REQ-1", 1, "o2", True, "2030-01-01T00:00:00Z", "2024-06-01T00:00:00Z"), ("w3", "REQ-2", 1, "o1", True, "2020-01-01T00:00:00Z", "2019-01-01T00:00:00Z"),
            ("w4", "REQ-1", 1, "o3", True, None, "2024-01-01T00:00:00Z"), ("w5", "REQ-2", 1, "o3", False, None, "2024-01-01T00:00:00Z"),
        ],
    ),
    "evidence": ("module_uid string, source string, confidence double", [("M0", "package_json", 0.9), ("M0", "cargo", 0.95), ("M1", "cargo", 0.8), ("M1", "gradle", 0.8), ("M2", "directory", 0.6)]),
    "roots": ("root string, module_uid string, kind string", [(".", "root", "inferred"), ("ASIA", "asia", "declared"), ("ASIA", "asia2", "operational"), ("EUROPE", "europe", "operational"), ("EUROPE/NATION_3", "third", "inferred"), ("AFRICA/NATION_0", "first", "declared"), ("NOWHERE", "none", "declared")]),
    "bindings": ("identifier string, specifier string, relative boolean", [("lodash", "lodash", False), ("helper", "./helper", True), ("app", "express", False), ("local", "@app/local", False)]),
}

POLICIES = [
    {"policy_id": "p-max", "policy_kind": "absolute_max", "measurement_kind": "cyclomatic_complexity", "threshold": 45, "scope": [], "severity": "fail"},
    {"policy_id": "p-min", "policy_kind": "absolute_min", "measurement_kind": "parameter_count", "threshold": 0, "scope": [("symbol_kind", "CLASS")], "severity": "advisory"},
    {"policy_id": "p-new", "policy_kind": "no_new", "measurement_kind": "cyclomatic_complexity", "threshold": 30, "scope": [("module", "ASIA")], "severity": "fail"},
    {"policy_id": "p-worse", "policy_kind": "no_worsened", "measurement_kind": "max_nesting_depth", "threshold": 2, "scope": [], "severity": "fail"},
    {"policy_id": "p-file", "policy_kind": "absolute_max", "measurement_kind": "max_nesting_depth", "threshold": 4, "scope": [("file", "EUROPE/**/*.rs"), ("symbol_kind", "FUNCTION")], "severity": "fail"},
    {"policy_id": "p-none", "policy_kind": "absolute_max", "measurement_kind": "cyclomatic_complexity", "threshold": 5, "scope": [("module", "NOWHERE")], "severity": "fail"},
]


def table(spark: SparkSession, name: str) -> DataFrame:
    ddl, rows = TABLES[name]
    return spark.createDataFrame(rows, ddl)


def _sql(x) -> str:
    return "null" if x is None else ("true" if x else "false") if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def values(name: str) -> str:
    """The table as a SQL common table expression of its name."""
    ddl, rows = TABLES[name]
    kinds = {"string": "varchar", "int": "integer", "double": "double", "boolean": "boolean"}
    columns = [c.split() for c in ddl.split(", ")]
    casts = ", ".join(f"{c}::{kinds[k]} as {c}" for c, k in columns)
    return f"{name} as (select {casts} from (values {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) t({', '.join(c for c, _ in columns)}))"

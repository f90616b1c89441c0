"""Interfaces that source text declares or uses: routes, commands and requests, read from literals.

All but the commands are expressions over a file's lines, so they need neither Python nor a shuffle.

Defined cases: a null text has no facts; of constants with one name in a file the first counts; an address that isn't a
literal, a template or a constant of the same file is left out, and so is the bare root.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Who registers routes, and by which methods.
ROUTERS, ROUTE_METHODS = ("app", "router", "server"), ("get", "post", "put", "delete", "patch", "options", "head", "all")
REQUEST_METHODS = ("get", "post", "put", "delete", "patch")
# What a request is worth by its client and by how its address is written: literal, constant, template.
REQUEST_CONFIDENCE = {"axios": (0.95, 0.85, 0.8), "fetch": (0.9, 0.75, 0.7)}
# The annotations of a Java web framework and the method that each stands for.
MAPPINGS = {"RequestMapping": "ANY", "GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
# Interpolations that stand for a server's base address.
_BASE = r"(?i)\$\{[^}]*(?:API_URL|BASE_URL|SERVER_URL|BACKEND_URL|API_BASE|import\.meta\.env\.\w+|process\.env\.\w+)[^}]*\}"
_QUOTED, _NAME = r"[`\"'][^`\"']*[`\"']?", r"[A-Za-z_$][\w$]*"


def _lines(files: DataFrame) -> DataFrame:
    """path, line, text, after (the next line) and the file's constants (array of name, value)."""
    constant = rf"(?m)^\s*(?:export\s+)?(?:const|let|var)\s+({_NAME})(?:\s*:\s*string)?\s*=\s*[`\"']([^`\"'\n$]*)[`\"']"
    known = F.arrays_zip(F.regexp_extract_all("text", F.lit(constant), F.lit(1)).alias("name"), F.regexp_extract_all("text", F.lit(constant), F.lit(2)).alias("value"))
    split = F.split("text", "\n")
    rows = F.transform(split, lambda x, i: F.struct((i + 1).cast("long").alias("line"), x.alias("text"), F.get(split, i + 1).alias("after")))
    return files.select("path", known.alias("constants"), F.explode(rows).alias("l")).select("path", "constants", "l.*")


def _address(argument: Column, constants: Column) -> tuple[Column, Column]:
    """The path that an argument names (null if none), and whether a constant had a part in it."""
    by_name = F.try_element_at(F.filter(constants, lambda c: c["name"] == argument), F.lit(1))["value"]
    bare = argument.rlike(rf"^{_NAME}$")
    inner = F.when(bare, by_name).otherwise(F.regexp_extract(argument, r"^[`\"']([^`\"'\s,)]*)", 1))
    # Base addresses go first, so a constant that holds one isn't looked up.
    put_in = F.aggregate(constants, F.regexp_replace(inner, _BASE, ""), lambda out, c: F.replace(out, F.concat(F.lit("${"), c["name"], F.lit("}")), c["value"]))
    used = bare | (put_in != F.regexp_replace(inner, _BASE, ""))
    path = F.regexp_replace(put_in, r"\$\{[^}]+\}", "{param}")
    return F.when(path.startswith("/") & (path != "/"), path), used


def routes(files: DataFrame) -> DataFrame:
    """path, line, method, address of routes that files importing one JavaScript framework register."""
    call = rf"\b(\w+)\.((?i:{'|'.join(ROUTE_METHODS)}))\s*\(\s*({_QUOTED}|{_NAME})"
    imports = files.filter(F.col("text").rlike("[\"']express[\"']"))
    rows = _lines(imports).withColumn("_a", F.regexp_extract("text", call, 3)).filter(F.col("_a") != "")
    address, _ = _address(F.col("_a"), F.col("constants"))
    method = F.upper(F.regexp_extract("text", call, 2))
    rows = rows.filter(F.regexp_extract("text", call, 1).isin(*ROUTERS)).withColumn("address", F.regexp_replace(address, rf":({_NAME})", "{$1}"))
    return rows.filter("address is not null").select("path", "line", method.alias("method"), "address")


def requests(files: DataFrame) -> DataFrame:
    """path, line, client, method, address, basis, confidence of requests that JavaScript files make, one to a line."""
    axios = rf"\baxios\.((?i:{'|'.join(REQUEST_METHODS)}))\s*\(\s*({_QUOTED}|{_NAME})"
    fetch = rf"\bfetch\s*\(\s*({_QUOTED}|{_NAME})"
    option = r"(?i)method\s*:\s*[\"'](\w+)[\"']"
    rows = _lines(files).withColumn("client", F.when(F.col("text").rlike(axios), "axios").when(F.col("text").rlike(fetch), "fetch")).filter("client is not null")
    is_axios = F.col("client") == "axios"
    rows = rows.withColumn("_a", F.when(is_axios, F.regexp_extract("text", axios, 2)).otherwise(F.regexp_extract("text", fetch, 1)))
    address, used = _address(F.col("_a"), F.col("constants"))
    own, following = F.regexp_extract("text", option, 1), F.regexp_extract(F.coalesce("after", F.lit("")), option, 1)
    method = F.when(is_axios, F.regexp_extract("text", axios, 1)).when(own != "", own).when(following != "", following).otherwise("get")
    template = F.col("_a").contains("${") | F.col("_a").rlike(rf"^{_NAME}$")
    level = F.when(~template, 0).when(used, 1).otherwise(2)
    worth = F.lit(None).cast("double")
    for client, values in REQUEST_CONFIDENCE.items():
        worth = F.when(F.col("client") == client, F.element_at(F.array(*(F.lit(v) for v in values)), level + 1)).otherwise(worth)
    out = rows.select("path", "line", "client", F.upper(method).alias("method"), address.alias("address"), F.when(template, "template").otherwise("literal").alias("basis"), worth.alias("confidence"))
    return out.filter("address is not null")


def annotated_routes(files: DataFrame) -> DataFrame:
    """path, line, method, address of Java routes: a method's mapping behind that of the class around it.

    A text is cut before each mapping, so a piece starts with one and may span lines.
    """
    head = rf"^@({'|'.join(MAPPINGS)})\b\s*(?:\(((?:[^()\"]|\"[^\"]*\")*)\))?"
    after = r"(?s)^(?:\s|@\w+(?:\([^)]*\))?|public|protected|private|abstract|final|static)*(?:class|interface)\b"
    pieces = F.split("text", rf"(?=@(?:{'|'.join(MAPPINGS)})\b)")
    newlines = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    code = F.coalesce(F.col("text"), F.lit(""))
    files = files.filter(code.rlike(head.removeprefix("^"))).withColumn("_p", pieces)
    made = F.transform(
        "_p",
        lambda p, i: F.struct(
            F.regexp_extract(p, head, 1).alias("kind"), F.regexp_extract(p, head, 2).alias("args"),
            F.regexp_replace(p, head, "").rlike(after).alias("on_class"), (newlines(F.array_join(F.slice(F.col("_p"), 1, i), "")) + 1).cast("long").alias("line"),
        ),
    )
    made = F.filter(made, lambda m: m["kind"] != "")
    literal = lambda args: F.coalesce(F.nullif(F.regexp_extract(args, r"\b(?:value|path)\s*=\s*\{?\s*\"([^\"]*)\"", 1), F.lit("")), F.regexp_extract(args, r"^\s*\{?\s*\"([^\"]*)\"", 1))
    rows = files.select("path", made.alias("_m")).select("path", "_m", F.explode("_m").alias("m")).filter("not m.on_class")
    around = F.element_at(F.filter("_m", lambda c: c["on_class"] & (c["line"] < F.col("m.line"))), -1)
    around = F.when(F.exists("_m", lambda c: c["on_class"] & (c["line"] < F.col("m.line"))), literal(around["args"])).otherwise("")
    own = literal(F.col("m.args"))
    slash = lambda s: F.when((s == "") | s.startswith("/"), s).otherwise(F.concat(F.lit("/"), s))
    address = F.concat(F.regexp_replace(slash(around), "/$", ""), slash(own))
    named = F.regexp_extract("m.args", r"RequestMethod\.([A-Z]+)", 1)
    default = F.element_at(F.create_map(*(F.lit(x) for kv in MAPPINGS.items() for x in kv)), F.col("m.kind"))
    method = F.when((F.col("m.kind") == "RequestMapping") & (named != ""), named).otherwise(default)
    return rows.select("path", F.col("m.line").alias("line"), method.alias("method"), F.when(address == "", "/").otherwise(address).alias("address"))


_COMMAND = re.compile(r"(?:\b(?:const|let|var)\s+(\w+)\s*=\s*)?\b(\w+)\s*\.\s*command\s*\(\s*[\"'`]([^\"'`]+)[\"'`]\s*\)")


def find_commands(text: str) -> list[tuple[int, str, str, str | None]]:
    """(line, address, raw, description) of registered commands; a command of a command's variable goes below it."""
    found = list(_COMMAND.finditer(text))
    held: dict[str, tuple[str, str]] = {}  # variable -> its command's first word, and the variable that is called for it
    out = []
    for m, nxt in zip(found, [*found[1:], None], strict=True):
        variable, receiver, raw = m.groups()
        rest = text[m.end() : nxt.start() if nxt else len(text)].split(";")[0]
        described = re.search(r"\.description\s*\(\s*[\"'`]([^\"'`]*)[\"'`]", rest)
        words, at, passed = [raw.split()[0]], receiver, set()
        while at in held and at not in passed:
            passed.add(at)
            name, at = held[at]
            words.insert(0, name)
        if variable:
            held[variable] = (raw.split()[0], receiver)
        if described or re.search(r"\.action\s*\(", rest):
            line = text.count("\n", 0, m.start(3)) + 1
            out.append((line, " ".join(words), raw, described[1] if described else None))
    return out


def commands(files: DataFrame) -> DataFrame:
    """path, line, address, raw, description of the commands that files importing one library register."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(p, *c) for p, t in zip(pdf["path"], pdf["text"], strict=True) for c in find_commands(t)], columns=["path", "line", "address", "raw", "description"])

    wanted = files.filter(F.col("text").rlike("[\"']commander[\"']")).select("path", "text")
    return wanted.mapInPandas(run, "path string, line long, address string, raw string, description string")

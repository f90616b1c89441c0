"""Facts from documentation, and which documents matter for a focus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, dirname

# What a fact is worth by how it was found, and the factor for generated documents.
CONFIDENCE, GENERATED_FACTOR = {"explicit_marker": 0.95, "frontmatter": 0.90, "config_parse": 0.90, "keyword_pattern": 0.70}, 0.8
# Sentences that state a fact; groups of subject (0: the document's own) and object.
PATTERNS = (
    (r"(?i)\b(\S+)\s+(?:replaces|is\s+a\s+replacement\s+for)\s+(\S+)", "replacement_for", 1, 2),
    (r"(?i)\breplacement\s+for\s+(\S+)", "replacement_for", 0, 1),
    (r"(?i)\b(?:this\s+)?(?:module\s+)?supersedes\s+(\S+)", "replacement_for", 0, 1),
    (r"(?i)\bdeprecated\s+in\s+favor\s+of\s+(\S+)", "deprecated_by", 0, 1),
    (r"(?i)\buse\s+(\S+)\s+instead\b", "deprecated_by", 0, 1),
    (r"(?i)\balternative\s+to\s+(\S+)", "alternative_to", 0, 1),
    (r"(?i)\b(\S+)\s+and\s+(\S+)\s+are\s+alternatives\b", "alternative_to", 1, 2),
    (r"(?i)\bmigrate\s+from\s+(\S+)\s+to\s+(\S+)", "migration_path", 1, 2),
    (r"(?i)\bmigration\s+from\s+(\S+)\s+to\s+(\S+)", "migration_path", 1, 2),
)
# Words that are never a module's name.
STOP_WORDS = """this that it the a an is are was were be been being have has had do does did will would could should may
might must can need want like use make get set field fields value values data content entire name names id ids key keys
type types json string number boolean array object file files path paths url urls option options config configuration
setting settings method methods function functions property properties parameter parameters argument arguments variable
variables input inputs output outputs result results item items element elements entry entries old new previous current
default custom all any some none other each every""".split()
_EDGES = r"[!\"#$%&'()*+,.;<=>?\[\\\]^`{|}~]"


def confidence(method: Column, generated: Column) -> Column:
    base = F.element_at(F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv)), method)
    return F.when(generated, base * GENERATED_FACTOR).otherwise(base)


def lines(docs: DataFrame, wanted: str | None = None) -> DataFrame:
    """line and text, beside what else ``docs`` (path, text) holds, of lines outside fenced blocks that aren't table rows.

    Only lines that match the expression ``wanted``, if given; others are dropped before anything is asked of them. An
    opening fence without an end fences all that follows. No shuffle: a line carries where its document's fences are.
    """
    fence = lambda x: F.trim(x).startswith("```") | F.trim(x).startswith("~~~")
    fences = F.array_compact(F.transform(F.split("text", "\n"), lambda x, i: F.when(fence(x), i)))
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(*others, fences.alias("_fences"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    rows = rows if wanted is None else rows.filter(F.col("text").rlike(wanted))
    before = F.size(F.filter("_fences", lambda i: i < F.col("line")))
    return rows.filter(~fence(F.col("text")) & ~F.trim("text").startswith("|") & (before % 2 == 0)).select(*others, (F.col("line") + 1).cast("long").alias("line"), "text")


def clean_reference(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, f"^{_EDGES}+", ""), f"{_EDGES}+$", "")


def module_like(x: Column) -> Column:
    """Whether a word may be a module's name."""
    return (x == ".") | x.rlike(r"[/@_-]|::") | (x.rlike("[A-Z]") & x.rlike("[a-z]")) | x.rlike(r"^[A-Z][A-Z0-9]{1,5}$")


def keyword_facts(docs: DataFrame) -> DataFrame:
    """path, line, fact_kind, subject, object of every match of every pattern. ``docs``: path, text, subject, generated."""
    # Every pattern ends in a word, so a line that holds none of these can't match; most lines go here.
    hinted = lines(docs, r"(?i)replace|supersede|deprecated|instead|alternative|migrat")

    def matches(regex: str, kind: str, subject: int, target: int) -> Column:
        targets = F.regexp_extract_all("text", F.lit(regex), F.lit(target))
        if not subject:
            return F.transform(targets, lambda o: F.struct(F.lit(kind).alias("fact_kind"), F.lit(None).cast("string").alias("s"), o.alias("o")))
        pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(regex), F.lit(subject)).alias("s"), targets.alias("o"))
        return F.transform(pairs, lambda p: F.struct(F.lit(kind).alias("fact_kind"), p["s"].alias("s"), p["o"].alias("o")))

    each = [matches(*p) for p in PATTERNS]
    rows = hinted.select("path", "line", "subject", "generated", F.explode(F.concat(*each)).alias("f"))
    s, o = F.coalesce(clean_reference(F.col("f.s")), F.col("subject")), clean_reference(F.col("f.o"))
    rows = rows.select("path", "line", "f.fact_kind", s.alias("subject"), o.alias("object"), confidence(F.lit("keyword_pattern"), F.col("generated")).alias("confidence"))
    good = (F.col("subject") != F.col("object")) & ~F.lower("subject").isin(*STOP_WORDS) & ~F.lower("object").isin(*STOP_WORDS) & ((F.length("subject") >= 2) | (F.col("subject") == "."))
    return rows.filter(good & module_like(F.col("subject")) & module_like(F.col("object")))


def marker_facts(docs: DataFrame, prefix: str = "rg") -> DataFrame:
    """path, line, directive, argument of comments like ``<!-- prefix:directive argument -->``, several to a line."""
    regex = rf"<!--\s*{prefix}:(\S+)\s+(.+?)\s*-->"
    rows = docs.select("path", F.posexplode(F.split("text", "\n")).alias("line", "text")).filter(F.col("text").contains(f"{prefix}:"))
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(regex), F.lit(1)).alias("directive"), F.regexp_extract_all("text", F.lit(regex), F.lit(2)).alias("argument"))
    return rows.select("path", (F.col("line") + 1).cast("long").alias("line"), F.explode(found).alias("m")).select("path", "line", "m.directive", "m.argument").filter(F.trim("argument") != "")


def relevance(docs: DataFrame, focus: DataFrame) -> DataFrame:
    """focus, path, priority of the documents that matter for each focus directory. ``docs``: path, kind, generated.

    A document in a focus's directory, below it or above it matters; so does any at the root. Each of these is an
    equality join on directories.
    """
    from ..functions.paths import ancestors

    base = F.when(F.col("kind") == "architecture", 30).when(F.col("kind") == "readme", 20).when(F.col("kind") == "map", 10).when(F.col("kind") == "config", 5).otherwise(0)
    rows = docs.withColumn("_dir", dirname(F.col("path"))).withColumn("_own", base - F.when(F.col("generated"), 5).otherwise(0))
    below = rows.select("path", "_own", F.explode(ancestors(F.col("_dir"))).alias("focus")).filter("focus <> ''").withColumn("_tier", F.lit(250))
    same = rows.select("path", "_own", F.col("_dir").alias("focus"), F.lit(300).alias("_tier"))
    first = same.unionByName(below).join(focus.select("focus"), "focus")
    ups = focus.select("focus", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("focus")))).alias("_dir"))
    above = ups.filter("_dir <> focus").join(rows.select("path", "_own", "_dir"), "_dir").select("focus", "path", "_own", F.lit(200).alias("_tier"))
    return first.unionByName(above.select("focus", "path", "_own", "_tier")).groupBy("focus", "path").agg(F.max(F.col("_tier") + F.col("_own")).cast("long").alias("priority"))


def generated(path: Column, text: Column) -> Column:
    """Whether a document is generated, by its name or its front matter."""
    front = F.regexp_extract(text, r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    return (F.lower(basename(path)) == "map.md") | F.lower(front).rlike(r"generated_by|generated: true|kind: synthesized_summary|auto_generated|machine_generated")


def front_matter_facts(docs: DataFrame) -> DataFrame:
    """path, fact_kind, subject, object, confidence that documents state in their front matter. ``docs``: path, text, generated.

    A document speaks for its directory. A replacement that is named beats the bare flag; of repeated keys the first counts.
    """
    block = F.regexp_extract("text", r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    entry = lambda key: F.nullif(F.regexp_replace(F.trim(F.regexp_extract(block, rf"(?m)^{key}\s*:[ \t]*([^\r\n#]+)", 1)), "^[\"']|[\"']$", ""), F.lit(""))
    flagged = F.lower(entry("deprecated")) == "true"
    subject = F.when(dirname(F.col("path")) == "", ".").otherwise(dirname(F.col("path")))
    by = entry("deprecated_by")
    stated = F.array_compact(F.array(
        *(F.when(entry(key).isNotNull(), F.struct(F.lit(kind).alias("fact_kind"), entry(key).alias("object"))) for key, kind in (("replaces", "replacement_for"), ("alternative_to", "alternative_to"))),
        F.when(by.isNotNull() | flagged, F.struct(F.lit("deprecated_by").alias("fact_kind"), by.alias("object"))),
    ))
    return docs.select("path", subject.alias("subject"), "generated", F.explode(stated).alias("f")).select("path", "f.fact_kind", "subject", "f.object", confidence(F.lit("frontmatter"), F.col("generated")).alias("confidence"))


# Environments by what a path holds, first that fits, and by the ending of a settings file.
PATH_ENVIRONMENTS = (("prod", "production"), ("staging", "staging"), ("stage", "staging"), ("dev", "development"), ("test", "test"), ("local", "local"))
FILE_ENVIRONMENTS = {"prod": "production", "stage": "staging", "dev": "development", "testing": "test"}


def environment_facts(docs: DataFrame) -> DataFrame:
    """path, subject, environment, confidence: services of compose files and the scope of settings files.

    ``docs``: path, text, generated. A service is a key at the first depth below ``services``.
    """
    name, low = F.lower(basename(F.col("path"))), F.lower("path")
    of_path = F.lit("default")
    for part, environment in reversed(PATH_ENVIRONMENTS):
        of_path = F.when(low.contains(part), environment).otherwise(of_path)
    # From the line of the section to the next line that begins with a word.
    section = F.regexp_extract("text", r"(?m)^services:[ \t]*(?:#.*)?\r?\n((?:(?:[ \t#].*)?(?:\r?\n|$))*)", 1)
    depth = F.regexp_extract(section, r"(?m)^([ \t]+)[^\s#]", 1)
    keys = F.transform(F.filter(F.split(section, r"\r?\n"), lambda x: (x.substr(F.lit(1), F.length(depth)) == depth) & x.substr(F.length(depth) + 1, F.lit(1)).rlike(r"[^\s#-]")), lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, r"^\s*([^:]+):", 1)), "^[\"']|[\"']$", ""))
    composed = docs.filter((name.startswith("docker-compose") | name.startswith("compose.")) & (depth != "")).select("path", F.explode(F.array_distinct(keys)).alias("subject"), of_path.alias("environment"), "generated").filter("subject <> ''")
    ending = F.regexp_extract(name, r"^\.env\.(.+)$", 1)
    known = F.create_map(*(F.lit(x) for kv in FILE_ENVIRONMENTS.items() for x in kv))
    of_file = F.when(name == ".env", "default").when(ending != "", F.coalesce(F.try_element_at(known, ending), ending)).otherwise("unknown")
    scope = F.when(dirname(F.col("path")) == "", ".").otherwise(dirname(F.col("path")))
    settings = docs.filter(name.startswith(".env")).select("path", scope.alias("subject"), of_file.alias("environment"), "generated")
    return composed.unionByName(settings).select("path", "subject", "environment", confidence(F.lit("config_parse"), F.col("generated")).alias("confidence"))

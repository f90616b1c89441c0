"""Canonical JSON of nested values: keys in order at every level, no spaces, numbers and escapes in one form.

A document becomes a VARIANT, which keeps the keys of its objects in order, and is written out again; numbers and escapes
of that text then take their form token by token. A row needs nothing but itself, so nothing is shuffled or stored, and
no level of nesting costs more than its characters.

Keys are ordered by UTF-16 units, numbers are doubles in their shortest form (1.0 is 1, 1e21 is 1e+21, 0.000001 is plain),
strings escape quotes, backslashes and control characters only. Defined cases: a text that isn't JSON, or has a key twice
in one object, gives null, as does null; nulls within stay; empty containers are [] and {}; a number beyond all doubles
is Infinity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands between the quotes of a string. Possessive, so a long string needs no stack.
_WITHIN = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
# Numbers of so few digits that they are in their shortest form as they stand.
_SHORT = r"^-?(0|[1-9][0-9]{0,9})([.][0-9]{0,4}[1-9])?$"
_TOKENS = rf'(?s)"{_WITHIN}"|-?[0-9][0-9.E-]*|[^"0-9-]+'


def number(x: Column) -> Column:
    """A double as JSON in its shortest form."""
    size, shown = F.abs(x), x.cast("string")
    plain = F.when(size >= 1e15, shown.cast("decimal(38,10)").cast("string")).otherwise(shown.cast("decimal(38,22)").cast("string"))
    plain = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    powers = F.regexp_replace(F.regexp_replace(shown, r"\.0E", "E"), r"E(\d)", "E+$1")
    return F.when(x == 0, F.lit("0")).when((size >= 1e21) | (size < 1e-6), F.replace(powers, F.lit("E"), F.lit("e"))).otherwise(plain)


def _string(token: Column) -> Column:
    """A marked string without its mark, digits of its escapes in lower case."""
    text = F.concat(F.lit('"'), F.substr(token, F.lit(3)))
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\\u....|\\.|[^\\]+"), F.lit(0))
    return F.when(F.contains(text, F.lit("\\u")), F.array_join(F.transform(parts, lambda p: F.when(p.startswith("\\u"), F.lower(p)).otherwise(p)), "")).otherwise(text)


def canonical_json(df: DataFrame, json_col: str, name: str = "canonical") -> DataFrame:
    """The rows with a column of canonical JSON."""
    # A mark before each string tells it from an infinite number, which a variant writes in quotes; the order of keys stays.
    marked = F.regexp_replace(F.col(f"`{json_col}`"), rf'(?s)"({_WITHIN})"', '"#$1"')
    tokens = F.regexp_extract_all(F.to_json(F.try_parse_json(marked)), F.lit(_TOKENS), F.lit(0))

    def form(t: Column) -> Column:
        return F.when(t.startswith('"#'), _string(t)).when(t.startswith('"'), F.replace(t, F.lit('"'), F.lit(""))).when(~t.rlike("^-?[0-9]") | t.rlike(_SHORT), t).otherwise(number(t.cast("double")))

    return df.withColumn(name, F.array_join(F.transform(tokens, form), ""))

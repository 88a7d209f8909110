"""JSON texts with sorted keys, as Python writes them, and their digests; in the plan, from typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control characters whose escapes differ in case: Spark writes the hexadecimal digits as capitals.
_CAPITALS = [f"{a}{b}" for a, letters in (("0", "BEF"), ("1", "ABCDEF")) for b in letters]


def quoted(text: Column) -> Column:
    """A JSON string, non-ASCII characters as they are."""
    whole = F.to_json(F.struct(text.alias("x")))
    plain = F.substr(whole, F.lit(6), F.length(whole) - 6)
    fixed = plain
    for x in _CAPITALS:
        fixed = F.regexp_replace(fixed, rf"(?<!\\)((?:\\\\)*)\\u00{x}", rf"$1\\u00{x.lower()}")
    return F.when(text.isNotNull(), F.when(plain.rlike(r"\\u00[01][A-F]"), fixed).otherwise(plain))


def json_text(c: Column, kind: T.DataType, item: str = ", ", colon: str = ": ") -> Column:
    """Strings, whole numbers, booleans, arrays and structs; null is ``null``. Keys are sorted."""
    if isinstance(kind, T.StringType):
        out = quoted(c)
    elif isinstance(kind, T.ArrayType):
        parts = F.transform(c, lambda x: json_text(x, kind.elementType, item, colon))
        out = F.concat(F.lit("["), F.array_join(parts, item), F.lit("]"))
    elif isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = F.array(*(F.concat(quoted(F.lit(f.name)), F.lit(colon), json_text(c[f.name], f.dataType, item, colon)) for f in fields))
        out = F.concat(F.lit("{"), F.array_join(parts, item), F.lit("}"))
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        out = c.cast("string")
    else:
        raise TypeError(f"no canonical JSON for {kind.simpleString()}")
    return F.coalesce(out, F.lit("null"))


def json_digest(c: Column, kind: T.DataType) -> Column:
    """SHA-256 of the JSON text without blanks."""
    return F.sha2(json_text(c, kind, ",", ":"), 256)

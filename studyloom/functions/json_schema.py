"""JSON schemas of model answers, built from the Spark types that read them."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fields whose text must be one of a few values.
CHOICES = {"decision": ["INCLUDED", "EXCLUDED"], "space": ["MNI", "TAL", None]}
#: Fields that are read as text, whatever the model writes, but asked for as true or false.
FLAGS = ("include", "fulltext_incomplete")


def of(kind: T.DataType, name: str = "") -> dict:
    """The schema of a type; objects list all their fields as required and no others."""
    if isinstance(kind, T.StructType):
        fields = {f.name: of(f.dataType, f.name) for f in kind.fields}
        return {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": of(kind.elementType)}
    if name in CHOICES:
        return {"type": ["string", "null"] if None in CHOICES[name] else "string", "enum": CHOICES[name]}
    if name in FLAGS or isinstance(kind, T.BooleanType):
        return {"type": "boolean"}
    return {"type": "number" if isinstance(kind, T.NumericType) else ["string", "null"]}


def of_ddl(ddl: str) -> dict:
    return of(T._parse_datatype_string(ddl))

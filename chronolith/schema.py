"""Schemas of the relations."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType()}


def struct(**fields: str | T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, _KINDS[v] if isinstance(v, str) else v) for k, v in fields.items()])


CHANGE = struct(path="string", old_path="string", add="int", **{"del": "int"}, binary="boolean", rename="boolean")
COMMIT = struct(seq="long", hash="string", author="string", email="string", date="string", merge="boolean", subject="string", files=T.ArrayType(CHANGE))
DEBT = struct(line="int", marker="string", text="string", weight="int")
SHAPE = struct(
    rel="string", language="string", skip="string", total="int", code="int", comment="int", blank="int", comments="int", decisions="int", depth="int",
    funcs="int", suppressed="int", complexity="int", bytes="long", debt=T.ArrayType(DEBT), imports=T.ArrayType(T.StringType()), error="string",
)
FILE = struct(rel="string", size="long", mtime_ns="long", language="string", test="boolean", vendor="boolean", generated="boolean", skip="string")
MANIFEST = struct(file="string", kind="string", name="string", is_dev="boolean")

"""Keys of any type as text that is never NULL, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, DataType, StructType)

_SET = "="          # in front of the text of a key that isn't NULL


def key_text(key: Column, kind: DataType) -> Column:
    """A text for each key value: equal keys have equal texts, the NULL key's is empty."""
    if isinstance(kind, BinaryType):
        text = F.hex(key)
    elif isinstance(kind, (ArrayType, StructType)):
        text = F.when(key.isNotNull(), F.to_json(F.struct(key.alias("k"))))
    else:
        text = key.cast("string")
    return F.coalesce(F.concat(F.lit(_SET), text), F.lit(""))


def key_value(text: Column, kind: DataType) -> Column:
    """The key value of a text of ``key_text``."""
    body = F.when(text != "", F.substring(text, 2, 2147483647))
    if isinstance(kind, BinaryType):
        return F.unhex(body)
    if isinstance(kind, (ArrayType, StructType)):
        return F.from_json(body, StructType().add("k", kind))["k"]
    return body.cast(kind)

"""Leak audit of tables of any schema: every text in every row, with its path."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, CharType, DataType, MapType, StringType, StructType, VarcharType

from auditlake.functions.pii import DETECTORS, Detector, detect, previews

_TEXTS = "array<struct<path:string,text:string>>"
_STRINGS = (StringType, CharType, VarcharType)


def _json_texts(docs: pd.Series) -> pd.Series:
    """(path, text) of the keys, strings and numbers of JSON objects and arrays; null where a text is none."""

    def walk(value, path):
        if isinstance(value, dict):
            for key, inner in value.items():
                yield {"path": f"{path}.keys", "text": key}
                yield from walk(inner, f"{path}.{key}")
        elif isinstance(value, list):
            for i, inner in enumerate(value):
                yield from walk(inner, f"{path}[{i}]")
        elif isinstance(value, str) or (isinstance(value, (int, float)) and not isinstance(value, bool)):
            yield {"path": path, "text": str(value)}

    def texts(doc):
        if doc is None or doc.lstrip()[:1] not in ("{", "["):
            return None
        try:
            return list(walk(json.loads(doc), "$"))
        except (ValueError, RecursionError):
            return None

    return docs.map(texts)


def _under(path: Column, texts: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(F.concat(path, F.lit(":"), t["path"]).alias("path"), t["text"].alias("text")))


def _texts_of(value: Column, kind: DataType, path: Column) -> Column:
    """All texts of a value with their paths, as an array. Texts that hold JSON are taken apart later."""
    none = F.array().cast(_TEXTS)
    if isinstance(kind, _STRINGS):
        return F.when(value.isNotNull(), F.array(F.struct(path.alias("path"), value.cast("string").alias("text")))).otherwise(none)
    if isinstance(kind, StructType):
        parts = [_texts_of(value[f.name], f.dataType, F.concat(path, F.lit("." + f.name))) for f in kind if _holds_text(f.dataType)]
        return F.concat(*parts) if parts else none
    if isinstance(kind, ArrayType) and _holds_text(kind):
        place = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        return F.coalesce(F.flatten(F.transform(value, lambda x, i: _texts_of(x, kind.elementType, place(i)))), none)
    if isinstance(kind, MapType) and _holds_text(kind):
        entry = StructType().add("key", kind.keyType).add("value", kind.valueType)
        keys = F.transform(F.map_keys(value), lambda k: F.struct(k.alias("key")))
        inside = F.transform(
            F.map_entries(value),
            lambda e: _texts_of(e["value"], kind.valueType, F.concat(path, F.lit("["), e["key"].cast("string"), F.lit("]"))),
        )
        named = F.transform(keys, lambda k: _texts_of(k["key"], entry["key"].dataType, F.concat(path, F.lit(".keys"))))
        return F.concat(F.coalesce(F.flatten(named), none), F.coalesce(F.flatten(inside), none))
    return none


def _holds_text(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_holds_text(f.dataType) for f in kind)
    if isinstance(kind, ArrayType):
        return _holds_text(kind.elementType)
    if isinstance(kind, MapType):
        return _holds_text(kind.keyType) or _holds_text(kind.valueType)
    return isinstance(kind, _STRINGS)


def texts_of_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, path, text) of every text in the columns other than the keys, at any depth of structs, arrays and maps.

    Texts that hold a JSON object or array are given as a whole and, after a colon, by the path of each key and
    value within. Columns without text are not read.
    """
    keys = list(keys)
    columns = [f for f in rows.schema if f.name not in keys and _holds_text(f.dataType)]
    none = F.array().cast(_TEXTS)
    every = F.concat(none, *[_texts_of(rows[f.name], f.dataType, F.lit(f.name)) for f in columns])
    flat = rows.select(*keys, F.explode(every).alias("t")).select(*keys, "t.path", "t.text")
    inner = F.pandas_udf(_json_texts, _TEXTS)("text")
    parts = F.concat(F.array(F.struct("path", "text")), F.coalesce(_under(F.col("path"), F.col("inner")), none))
    return flat.withColumn("inner", inner).select(*keys, F.explode(parts).alias("t")).select(*keys, "t.path", "t.text")


def leak_paths(rows: DataFrame, keys: Sequence[str], detectors: Iterable[Detector] = DETECTORS) -> DataFrame:
    """(keys, path, type, preview) of every finding in any text of a table; a finding within JSON is given by its path there.

    The whole of a text that holds JSON is searched as well, and a finding there is given only where none of its parts
    has it, for instance one that spans two parts.
    """
    keys = list(keys)
    found = texts_of_rows(rows, keys).withColumn("found", detect(F.col("text"), detectors=tuple(detectors))).filter(F.size("found") > 0)
    each = found.select(*keys, "path", F.explode(F.arrays_zip("found", previews(F.col("found")).alias("preview"))).alias("f"))
    each = each.select(*keys, F.split_part("path", F.lit(":"), F.lit(1)).alias("outer"), "path", F.col("f.found.type").alias("type"), F.col("f.found.value").alias("value"), F.col("f.preview").alias("preview"))
    deeper = F.struct((F.col("path") != F.col("outer")).alias("inside"), "path", "preview")
    best = each.groupBy(*keys, "outer", "type", "value").agg(F.array_sort(F.collect_set(deeper)).alias("places"))
    inside = F.filter("places", lambda p: p["inside"])
    shown = F.when(F.size(inside) > 0, inside).otherwise(F.col("places"))
    return best.select(*keys, "type", F.explode(shown).alias("p")).select(*keys, "p.path", "type", "p.preview")


# The walk over JSON travels with the queries, to executors that do not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

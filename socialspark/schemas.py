"""Declared schemas, so that no reader has to infer one by scanning the data."""

from __future__ import annotations

from pyspark.sql import types as T

_STR, _LONG = T.StringType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_REF = _struct(uri=_STR, cid=_STR)

RAW_AUTHOR = _struct(
    did=_STR,
    handle=_STR,
    display_name=_STR,
    displayName=_STR,
    created_at=_STR,
    createdAt=_STR,
    avatar=_STR,
    pronouns=_STR,
    verification=_STR,
    associated=_struct(activity_subscription=_struct(allow_subscriptions=_STR)),
)

RAW_RECORD = _struct(
    text=_STR,
    created_at=_STR,
    createdAt=_STR,
    langs=T.ArrayType(_STR),
    reply=_struct(parent=_REF, root=_REF),
)

# One landed search hit. `keyword`, `kw_pos`, `page` and `pos` say which search
# found it and where; they give "first seen" a meaning that does not depend on
# the order in which files are read.
RAW_POST = T.StructType(
    [
        T.StructField("keyword", _STR),
        T.StructField("kw_pos", T.IntegerType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("uri", _STR),
        T.StructField("cid", _STR),
        T.StructField("indexed_at", _STR),
        T.StructField("indexedAt", _STR),
        T.StructField("author", RAW_AUTHOR),
        T.StructField("record", RAW_RECORD),
        *[
            T.StructField(name, _LONG)
            for stem in ("reply", "repost", "like", "quote", "bookmark")
            for name in (f"{stem}_count", f"{stem}Count")
        ],
    ]
)

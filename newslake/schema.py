"""Typed schemas of the news model (sources, docs, topics, models, votes,
predictions) and ``conform`` to bring any DataFrame to one of them.

Unknown extra fields are not inferred: a reader keeps them in an ``extra``
JSON string (``conform(..., keep_extra=True)``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

TOPIC = T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])
CONTENT = T.StructType([T.StructField("base", T.StringType()), T.StructField("language", T.StringType())])
VOTE = T.StructType([T.StructField("name", T.StringType()), T.StructField("score", T.IntegerType()),
                     T.StructField("id", T.StringType())])
STRINGS = T.ArrayType(T.StringType())

SOURCES = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("link", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("summary", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("limit", T.IntegerType()), T.StructField("step", T.IntegerType()),
    T.StructField("depth", T.IntegerType()), T.StructField("freq", T.IntegerType()),
    T.StructField("predict", T.BooleanType()), T.StructField("enable_content", T.BooleanType()),
    T.StructField("active", T.BooleanType()), T.StructField("creator", T.StringType()),
    T.StructField("tags", STRINGS), T.StructField("topics", T.ArrayType(TOPIC)),
])

DOCS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("origin", T.StringType()),
    T.StructField("link", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("summary", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("html", T.StringType()), T.StructField("author", T.StringType()),
    T.StructField("updated", T.TimestampNTZType()), T.StructField("published", T.TimestampNTZType()),
    T.StructField("source", T.StringType()), T.StructField("source_type", T.StringType()),
    T.StructField("format", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("tags", STRINGS), T.StructField("related_links", STRINGS),
    T.StructField("occurences", T.IntegerType()), T.StructField("content_type", T.StringType()),
    T.StructField("content", T.ArrayType(CONTENT)), T.StructField("topics", T.ArrayType(TOPIC)),
    T.StructField("votes", T.MapType(T.StringType(), VOTE)),
    T.StructField("rules", T.MapType(T.StringType(), STRINGS)),
])

TOPICS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("tags", STRINGS), T.StructField("link", T.StringType()),
    T.StructField("summary", T.StringType()), T.StructField("active", T.BooleanType()),
    T.StructField("freq", T.IntegerType()), T.StructField("updated", T.TimestampNTZType()),
])

MODELS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("related_topics", STRINGS), T.StructField("limit", T.IntegerType()),
    T.StructField("lang", T.StringType()), T.StructField("summary", T.StringType()),
    T.StructField("link", T.StringType()), T.StructField("active", T.BooleanType()),
    T.StructField("freq", T.IntegerType()), T.StructField("updated", T.TimestampNTZType()),
])

VOTES = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("voter", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("score", T.IntegerType()),
    T.StructField("ts", T.TimestampNTZType()),
])

PREDICTIONS = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("label", T.DoubleType()),
    T.StructField("prediction", T.DoubleType()), T.StructField("probability", T.ArrayType(T.DoubleType())),
])

# The mapping's null_value defaults (and form/chat defaults).
DEFAULTS = {
    "sources": {"active": False, "enable_content": True, "predict": True},
    "docs": {"occurences": 1},
    "models": {"limit": 3000, "lang": "en"},
}


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None,
            keep_extra: bool = False) -> DataFrame:
    """Select ``schema``'s fields in order: present columns are cast, missing
    ones are null (or their default); with ``keep_extra`` the other columns
    are kept as one JSON string ``extra``."""
    defaults = defaults or {}
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            c = F.col(f.name).cast(f.dataType)
        else:
            c = F.lit(None).cast(f.dataType)
        if f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        cols.append(c.alias(f.name))
    if keep_extra:
        extra = [c for c in df.columns if c not in schema.fieldNames()]
        cols.append((F.to_json(F.struct(*extra)) if extra else F.lit(None).cast("string")).alias("extra"))
    return df.select(*cols)

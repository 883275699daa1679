"""Table shapes."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()
_LIST = T.ArrayType(_S)


def _struct(**fields: T.DataType) -> T.StructType:
    """Field names take a closing underscore where Python reserves the word."""
    return T.StructType([T.StructField(n.rstrip("_"), t) for n, t in fields.items()])


COMPONENT = _struct(
    name=_S, type=_S, description=_S, visibility=_S, dependencies=_LIST, notable_features=_LIST
)
RELATION = _struct(from_=_S, to=_S, type=_S)
INSIGHT = _struct(type=_S, description=_S, impact=_S, components=_LIST)

COMPONENTS = T.ArrayType(COMPONENT)
RELATIONS = T.ArrayType(RELATION)
STRINGS = _LIST
VECTOR = T.ArrayType(T.DoubleType())

FILES = _struct(path=_S, language=_S, type=_S, content=_S)

# The model's answer, first schema.
ANALYSIS = _struct(purpose=_S, components=COMPONENTS, relationships=RELATIONS, insights=_LIST)

# The model's answer, second schema; metric values stay JSON text.
ENHANCED = _struct(
    architectural_patterns=_LIST,
    code_quality_metrics=T.MapType(_S, _S),
    insights=T.ArrayType(INSIGHT),
    cross_references=T.MapType(_S, _LIST),
)

DOCUMENT = _struct(
    id=_S, path=_S, type=_S, content=_S, purpose=_S, components=COMPONENTS, relations=RELATIONS,
    insights=_LIST, embedding=VECTOR, references=_LIST,
    created_at=T.TimestampType(), updated_at=T.TimestampType(),
)
REFERENCE = _struct(source_id=_S, target_id=_S, type=_S, created_at=T.TimestampType())

# Document types.
DOCUMENT_TYPES = ("architecture", "module", "function", "class", "api")

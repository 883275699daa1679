"""Prompts for a model, its JSON answers, and documents made from them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceloom.functions.paths import as_col, document_id, file_ext
from sourceloom.operators.edges import adjacency_map
from sourceloom.schemas import ANALYSIS, COMPONENTS, ENHANCED, RELATIONS, STRINGS, VECTOR

# The prompt texts. The model's answer has to fit schemas.ANALYSIS.
SYSTEM_PROMPT = """You are an expert code analyzer. Analyze the provided code and return ONLY a JSON object with the following structure:
{
    "purpose": "Brief description of the code's purpose",
    "components": [
        {
            "name": "Component name",
            "type": "Type of component",
            "description": "Component description",
            "visibility": "public/private/etc",
            "dependencies": ["List of dependencies"],
            "notable_features": ["List of notable features"]
        }
    ],
    "relationships": [
        {
            "from": "Source component",
            "to": "Target component",
            "type": "Relationship type"
        }
    ],
    "insights": ["List of important observations"]
}
Do not include any text before or after the JSON. Do not use markdown formatting."""
_ANALYSE = (
    "Analyze this {} and provide your analysis as a JSON object "
    "matching the specified structure:\n\n%s"
)
PROMPTS = {
    "go_source": _ANALYSE.format("Go code"),
    "csharp_source": _ANALYSE.format("C# code"),
    "csharp_project": _ANALYSE.format("C# project file"),
    "csharp_solution": _ANALYSE.format("C# solution file"),
}
ENHANCED_SYSTEM_PROMPT = """You are an expert software architect analyzing %s code.
Provide a comprehensive analysis of the code, focusing on architectural insights, code quality, and system interactions.
Respond with a structured JSON output that captures the nuanced understanding of an experienced architect.

Include the following in your analysis:
- Architectural patterns and design principles
- Code complexity and maintainability metrics
- Potential improvements or refactoring opportunities
- System and component interactions"""
ENHANCED_PROMPT = """Analyze this %s code comprehensively:

%s

Please provide a detailed JSON analysis covering:
- Architectural patterns discovered
- Code quality metrics
- Architectural insights and potential improvements
- Cross-component references"""
DOCUMENTATION_PROMPT = "Please analyze this %s code and provide comprehensive documentation:\n\n%s"


def _fill(template: str, *values: Column) -> Column:
    """Values set into the ``%s`` places of a template."""
    texts = template.split("%s")
    pieces = [F.lit(texts[0])]
    for value, text in zip(values, texts[1:], strict=True):
        pieces += [value, F.lit(text)]
    return F.concat(*pieces)


def with_analysis_prompt(files: DataFrame) -> DataFrame:
    """Add ``system_prompt`` and ``prompt``: template of language and type, else of the language."""
    known = F.create_map(*[F.lit(x) for pair in PROMPTS.items() for x in pair])
    template = F.coalesce(
        F.try_element_at(known, F.concat_ws("_", "language", "type")),
        F.try_element_at(known, F.concat("language", F.lit("_source"))),
    )
    return files.withColumn("system_prompt", F.lit(SYSTEM_PROMPT)).withColumn(
        "prompt", F.replace(template, F.lit("%s"), "content")
    )


def with_enhanced_prompt(files: DataFrame) -> DataFrame:
    language = F.col("language")
    return files.withColumn("system_prompt", _fill(ENHANCED_SYSTEM_PROMPT, language)).withColumn(
        "prompt", _fill(ENHANCED_PROMPT, language, F.col("content"))
    )


def with_documentation_prompt(files: DataFrame) -> DataFrame:
    """Prompt from the extension (without its dot) and the content."""
    ext = F.regexp_replace(file_ext("path"), r"^\.", "")
    return files.withColumn("prompt", _fill(DOCUMENTATION_PROMPT, ext, F.col("content")))


# A name with a capital letter: JSON escapes quotes inside texts, so few of them match.
_CAPITALS = r'[A-Z][A-Za-z_]*"\s*:'
_PARSER = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _text(value: Column) -> Column:
    """A VARIANT as text: JSON for objects and lists; numbers with a point keep it."""
    point = F.schema_of_variant(value).rlike(r"^DECIMAL\((1[0-8]|[0-9]),|^DECIMAL\([0-9]+,[1-9]")
    number = F.try_variant_get(value, "$", "double").cast("string")
    return F.when(point, number).otherwise(F.try_variant_get(value, "$", "string"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _pair(value: Column, wrong: Column) -> Column:
    return F.struct(value.alias("value"), F.coalesce(wrong, F.lit(False)).alias("wrong"))


def _typed(value: Column, kind: T.DataType) -> Column:
    """A VARIANT as ``kind``, and whether it is of another one. Struct fields are found in
    any letter case, level by level along the schema; keys of maps stay as they stand."""
    given = value.isNotNull() & ~F.is_variant_null(value)
    if isinstance(kind, T.StructType):
        return _let(F.try_variant_get(value, "$", "map<string,variant>"), lambda names: _let(
            _fields(names, F.map_keys(names), kind),
            lambda read: _pair(F.when(names.isNotNull(), read["value"]), given & (names.isNull() | read["wrong"])),
        ))
    if isinstance(kind, T.ArrayType):
        listed = F.try_variant_get(value, "$", "array<variant>")
        return _let(F.transform(listed, lambda x: _typed(x, kind.elementType)), lambda read: _pair(
            F.transform(read, lambda x: x["value"]), given & (read.isNull() | F.exists(read, lambda x: x["wrong"]))
        ))
    if isinstance(kind, T.MapType):
        held = F.try_variant_get(value, "$", "map<string,variant>")
        return _let(F.transform_values(held, lambda _, x: _typed(x, kind.valueType)), lambda read: _pair(
            F.transform_values(read, lambda _, x: x["value"]), given & (read.isNull() | F.exists(F.map_values(read), lambda x: x["wrong"]))
        ))
    return _pair(_text(value), F.lit(False))


def _fields(names: Column, keys: Column, schema: T.StructType) -> Column:
    """Struct from a map of names to VARIANT, and whether a field is of another kind. Of
    several spellings of a name the last of ``keys`` counts."""

    def spelled(name: str) -> Column:
        return F.try_element_at(F.filter(keys, lambda k: F.lower(k) == name), F.lit(-1))

    read = F.struct(*[_typed(F.try_element_at(names, spelled(f.name)), f.dataType).alias(f.name) for f in schema.fields])
    return _let(read, lambda r: _pair(
        F.struct(*[r[f.name]["value"].alias(f.name) for f in schema.fields]),
        reduce(Column.__or__, [r[f.name]["wrong"] for f in schema.fields]),
    ))


def _by_path(text: Column, wrapped: Column, schema: T.StructType) -> Column:
    """The answer read as VARIANT, as a struct like that of the plain parse."""
    outer = F.try_parse_json(wrapped)
    parsed = F.struct(
        F.try_variant_get(outer, "$.answer", "map<string,variant>").alias("names"), F.json_object_keys(text).alias("keys")
    )
    good = lambda d, read: d["names"].isNotNull() & ~read["wrong"]
    return _let(parsed, lambda d: _let(_fields(d["names"], d["keys"], schema), lambda read: F.struct(
        F.when(good(d, read), read["value"]).alias("answer"), F.when(~good(d, read), text).alias("_corrupt")
    )))


def _parse(responses: DataFrame, schema: T.StructType) -> DataFrame:
    """Add ``ok`` and ``parsed``.

    The answer is read as the only field of an outer object, and has to be the only element
    of a list as well. So text after the JSON, further keys, a list in place of an object, a
    code fence or a cut-off answer break one of them and the row is rejected whole, also
    where single fields could be read. Answers that have names with capital letters are read
    as VARIANT and matched by path.
    """
    text = F.coalesce("response", F.lit(""))
    wrapped = F.concat(F.lit('{"answer":'), text, F.lit("}"))
    outer = T.StructType().add("answer", schema).add("_corrupt", T.StringType())
    plain = F.from_json(wrapped, outer, {**_PARSER, "columnNameOfCorruptRecord": "_corrupt"})
    read = F.when(text.rlike(_CAPITALS), _by_path(text, wrapped, schema)).otherwise(plain)
    alone = F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.lit(False))
    # One-row explode: filters on the result stay above it, so each answer is parsed once.
    once = responses.select("*", F.explode(F.array(F.struct(read.alias("read"), alone.alias("alone")))).alias("__read"))
    return once.select(
        *responses.columns, (F.isnull("__read.read._corrupt") & F.col("__read.alone")).alias("ok"),
        F.col("__read.read.answer").alias("parsed"),
    )


def _empty(kind: T.DataType) -> Column:
    blank = {"array": F.array, "map": F.create_map}.get(kind.typeName())
    return blank().cast(kind) if blank else F.lit("")


def _filled(value: Column, kind: T.DataType) -> Column:
    """Missing texts and lists become empty, at every depth."""
    if isinstance(kind, T.StructType):
        return F.struct(*[_filled(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        value = F.transform(value, lambda x: _filled(x, kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.ArrayType):
        value = F.transform_values(value, lambda _, x: _filled(x, kind.valueType))
    return F.coalesce(value, _empty(kind))


def _split(responses: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    read = _parse(responses, schema)
    good = read.where("ok").select("path", _filled(F.col("parsed"), schema).alias("analysis"))
    return good, read.where("not ok").select("path", "response")


def parse_analysis(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed rows ``path, analysis`` and rejected rows ``path, response``.

    Fields left out or null become empty, at every depth; names of fields match in any
    letter case, keys of maps stay as they are.
    """
    return _split(responses, ANALYSIS)


def parse_enhanced(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``parse_analysis`` for the second schema."""
    return _split(responses, ENHANCED)


def to_enhanced(analysis: Column | str) -> Column:
    """First schema to second: insights become general ones of medium impact."""
    a = as_col(analysis)
    insights = F.transform(
        a["insights"],
        lambda text: F.struct(
            F.lit("general").alias("type"), text.alias("description"),
            F.lit("medium").alias("impact"), _empty(STRINGS).alias("components"),
        ),
    )
    converted = F.struct(
        _empty(STRINGS).alias("architectural_patterns"),
        _empty(ENHANCED["code_quality_metrics"].dataType).alias("code_quality_metrics"),
        insights.alias("insights"),
        adjacency_map(a["relationships"]).alias("cross_references"),
    )
    return F.when(a.isNotNull(), converted)


def analysis_documents(analyses: DataFrame, at: Column | str) -> DataFrame:
    """Documents from parsed answers: the purpose is also the content."""
    a = F.col("analysis")
    return analyses.select(
        document_id("path").alias("id"), "path", F.lit("module").alias("type"),
        a["purpose"].alias("content"), a["purpose"].alias("purpose"),
        a["components"].alias("components"), a["relationships"].alias("relations"),
        a["insights"].alias("insights"),
        _empty(VECTOR).alias("embedding"),
        _empty(STRINGS).alias("references"),
        F.lit(at).cast("timestamp").alias("created_at"), F.lit(at).cast("timestamp").alias("updated_at"),
    )


def response_documents(responses: DataFrame, at: Column | str) -> DataFrame:
    """Documents whose content is the raw answer."""
    return responses.select(
        document_id("path").alias("id"), "path", F.lit("module").alias("type"),
        F.col("response").alias("content"), F.lit("").alias("purpose"),
        _empty(COMPONENTS).alias("components"),
        _empty(RELATIONS).alias("relations"),
        _empty(STRINGS).alias("insights"),
        _empty(VECTOR).alias("embedding"),
        _empty(STRINGS).alias("references"),
        F.lit(at).cast("timestamp").alias("created_at"), F.lit(at).cast("timestamp").alias("updated_at"),
    )

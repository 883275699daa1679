"""Reference edges between documents.

Input documents have ``id, path, components, relations``. Every producer returns
``source_id, target_id, type, ord``; ``ord`` orders the edges of one producer and one
document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.labels import edge_key, relation_type
from sourceloom.functions.paths import dir_name, join_path
from sourceloom.operators.skew import DEFAULT, PART_BYTES, SkewPolicy, text_parts


def known_paths(paths: DataFrame) -> DataFrame:
    """All given paths and all their ancestor directories, distinct.

    Relative paths have the ancestor ``.``, absolute ones ``/``.
    """
    path = F.col("path")
    names = F.split(F.regexp_replace(path, "^/", ""), "/")
    root = F.when(F.startswith(path, F.lit("/")), "/").otherwise("")
    above = F.transform(
        F.sequence(F.lit(1), F.size(names)),
        lambda i: F.concat(root, F.array_join(F.slice(names, F.lit(1), i), "/")),
    )
    top = F.array(F.when(root == "/", "/").otherwise("."))
    return paths.select(F.explode(F.concat(top, above)).alias("path")).distinct()


def _resolve(
    names: DataFrame, known: DataFrame, candidates: Column
) -> DataFrame:
    """First existing candidate path per row of ``names`` (columns ``dir, name``).

    Each (dir, name) is resolved once, however many documents ask for it.
    """
    asked = names.select("dir", "name").distinct()
    tried = asked.select("dir", "name", F.posexplode(candidates).alias("pos", "path"))
    found = tried.join(known, ["path"], "left_semi")
    resolved = found.groupBy("dir", "name").agg(F.min_by("path", "pos").alias("found"))
    return names.join(resolved, ["dir", "name"], "left")


def import_edges(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Edges to the package path of each dotted dependency; unresolved ones are dropped.

    Distinct packages of a document, first occurrence first, come from array functions
    inside its row.
    """
    listed = F.flatten(
        F.transform("components", lambda c: F.coalesce(c["dependencies"], F.array().cast("array<string>")))
    )
    dotted = F.filter(listed, lambda d: F.contains(d, F.lit(".")))
    packages = F.array_distinct(F.transform(dotted, lambda d: F.substring_index(d, ".", 1)))
    wanted = docs.select(
        F.col("id").alias("source_id"), dir_name("path").alias("dir"),
        F.posexplode(packages).alias("ord", "name"),
    )
    places = F.array(join_path("dir", F.lit(".."), "name"), join_path("dir", "name"))
    return _resolve(wanted, known, places).where(F.isnotnull("found")).select(
        "source_id", F.col("found").alias("target_id"), F.lit("imports").alias("type"), "ord"
    )


def relation_edges(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Edges of stated relationships; the target is a known path if there is one."""
    stated = docs.select(
        F.col("id").alias("source_id"), dir_name("path").alias("dir"),
        F.posexplode("relations").alias("ord", "rel"),
    ).where((F.col("rel.from") != "") & (F.col("rel.to") != "")).select(
        "source_id", "dir", "ord", F.col("rel.to").alias("name"),
        relation_type(F.coalesce("rel.type", F.lit(""))).alias("type"),
    )
    places = F.array(join_path("dir", "name"))
    return _resolve(stated, known, places).select(
        "source_id", F.coalesce("found", "name").alias("target_id"), "type", "ord"
    )


def interface_sides(docs: DataFrame) -> DataFrame:
    """Per document what interface matching needs: directory, roles, method names.

    Interfaces are looked for in documents of type ``module`` where a type is given.
    """
    module = F.col("type") == "module" if "type" in docs.columns else F.lit(True)
    comps = F.coalesce("components", F.array().cast(docs.schema["components"].dataType))
    methods = F.transform(
        F.filter(comps, lambda c: F.lower(c["type"]) == "method"),
        lambda c: F.coalesce(F.lower(c["name"]), F.lit("")),
    )
    return docs.select(
        "id", dir_name("path").alias("dir"),
        F.exists(comps, lambda c: F.lower(c["type"]) == "struct").alias("has_struct"),
        (module & F.exists(comps, lambda c: F.lower(c["type"]) == "interface")).alias("has_interface"),
        F.array_sort(F.array_distinct(methods)).alias("methods"),
    )


def implements_pairs(sides: DataFrame) -> DataFrame:
    """Pairs in one directory where the first side has every method of the second.

    Relational division over *distinct* method sets: copies of a document are matched
    once and fanned out at the end, where the work equals the output. A set is only
    compared with sets holding its rarest method. Interfaces without methods match every
    struct of their directory and skip the comparison.
    """
    has = {c: F.coalesce(c, F.lit(False)) for c in ("has_struct", "has_interface")}
    keyed = sides.where(has["has_struct"] | has["has_interface"]).select(
        "id", "dir", "methods", F.sha2(F.to_json(F.struct("methods")), 256).alias("set_id"),
        (has["has_struct"].cast("int") + has["has_interface"].cast("int") * 2).alias("roles"),
    )
    sets = keyed.groupBy("dir", "set_id").agg(
        F.bit_or("roles").alias("roles"), F.first("methods").alias("methods")
    )
    have = sets.where(F.col("roles").bitwiseAND(1) != 0).select(
        "dir", F.col("set_id").alias("have_id"), F.col("methods").alias("have")
    )
    need = sets.where(F.col("roles").bitwiseAND(2) != 0).select(
        "dir", F.col("set_id").alias("need_id"), F.col("methods").alias("need")
    )

    postings = have.select("dir", F.explode("have").alias("method"), "have_id")
    spread = postings.groupBy("dir", "method").agg(F.count(F.lit(1)).alias("n"))
    asked = need.select("dir", "need_id", "need", F.explode("need").alias("method"))
    rarest = asked.join(spread, ["dir", "method"], "left").groupBy(
        "dir", "need_id"
    ).agg(
        F.min_by("method", F.struct("n", "method")).alias("method"),
        F.first("need").alias("need"), F.bool_and(F.isnotnull("n")).alias("possible"),
    ).where("possible").drop("possible")
    candidates = postings.join(rarest, ["dir", "method"], "inner")
    compared = candidates.join(have, ["dir", "have_id"], "inner").where(
        F.size(F.array_except("need", "have")) == 0
    ).select("dir", "have_id", "need_id")
    without = need.where(F.size("need") == 0).select("dir", "need_id")
    vacuous = have.join(without, ["dir"], "inner").select("dir", "have_id", "need_id")

    matched = compared.unionByName(vacuous)
    structs = keyed.where(F.col("roles").bitwiseAND(1) != 0)
    interfaces = keyed.where(F.col("roles").bitwiseAND(2) != 0)
    sources = structs.select("dir", F.col("set_id").alias("have_id"), F.col("id").alias("source_id"))
    targets = interfaces.select("dir", F.col("set_id").alias("need_id"), F.col("id").alias("target_id"))
    fanned = sources.join(matched, ["dir", "have_id"], "inner")
    return fanned.join(targets, ["dir", "need_id"], "inner").select(
        "source_id", "target_id"
    )


def implements_edges(docs: DataFrame) -> DataFrame:
    return implements_pairs(interface_sides(docs)).select(
        "source_id", "target_id", F.lit("implements").alias("type"), F.lit(0).alias("ord")
    )


def merge_edges(*producers: DataFrame) -> DataFrame:
    """Union of producers, one row per edge key; the earliest producer wins."""
    tagged = [p.withColumn("producer", F.lit(i)) for i, p in enumerate(producers)]
    union = tagged[0]
    for more in tagged[1:]:
        union = union.unionByName(more)
    fields = F.struct("source_id", "target_id", "type", "producer")
    return union.withColumn("ref_key", edge_key("source_id", "target_id", "type")).groupBy(
        "ref_key"
    ).agg(
        F.min_by(fields, F.struct("producer", "ord", "source_id", "target_id", "type")).alias("edge")
    ).select("edge.source_id", "edge.target_id", "edge.type", "ref_key", "edge.producer")


def document_edges(docs: DataFrame, known: DataFrame) -> DataFrame:
    """All edges of all documents: imports, relationships, then interface matches."""
    return merge_edges(
        import_edges(docs, known),
        relation_edges(docs, known),
        implements_edges(docs),
    )


def normalised_edges(raw: DataFrame) -> DataFrame:
    """Raw edges ``source_id, target_id, raw_type`` as distinct keyed edges."""
    return raw.select("source_id", "target_id", relation_type("raw_type").alias("type")).distinct(
    ).withColumn("ref_key", edge_key("source_id", "target_id", "type"))


def resolve_targets(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Add the id of the document at the target path, null if there is none."""
    at_path = docs.select(F.col("path").alias("target_id"), F.col("id").alias("target_doc_id"))
    return edges.join(at_path, ["target_id"], "left")


def adjacency(
    relations: DataFrame, part_bytes: int = PART_BYTES, policy: SkewPolicy = DEFAULT
) -> DataFrame:
    """``from, seq, to`` rows as ordered target lists per ``from``, in bounded parts."""
    return text_parts(
        relations, ["from"], ["seq"], line="to", out="targets", sep=",", sized=relations.select("from"),
        part_bytes=part_bytes, policy=policy,
    )


def adjacency_map(relations: Column | str) -> Column:
    """Map from -> [to, ...] of the relations inside one document, in order of first use.

    Relations are sorted once; each map entry is a slice of them, so the work is that of a
    sort. A missing ``from`` or ``to`` counts as empty.
    """
    rels = F.col(relations) if isinstance(relations, str) else relations
    text = lambda c: F.coalesce(c, F.lit(""))
    keyed = F.array_sort(F.transform(
        rels, lambda r, i: F.struct(text(r["from"]).alias("from"), i.alias("at"), text(r["to"]).alias("to"))
    ))

    def entries(ordered: Column) -> Column:
        n = F.size(ordered)
        heads = F.filter(
            F.transform(ordered, lambda r, i: F.when((i == 0) | (F.get(ordered, i - 1)["from"] != r["from"]), i)),
            lambda i: i.isNotNull(),
        )
        # Bound once, like the sorted relations, so that no element computes it anew.
        return F.flatten(F.transform(F.array(heads), lambda h: F.transform(h, lambda i, k: F.struct(
            ordered[i]["at"].alias("at"), ordered[i]["from"].alias("from"),
            F.transform(F.slice(ordered, i + 1, F.coalesce(F.get(h, k + 1), n) - i), lambda r: r["to"]).alias("to"),
        ))))

    found = F.flatten(F.transform(F.array(keyed), entries))
    return F.map_from_entries(F.transform(F.array_sort(found), lambda e: F.struct(e["from"], e["to"])))

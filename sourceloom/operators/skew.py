"""Ranks and text assembly that hold when one key has most of the rows.

A group is *hot* if it has more rows than ``limit = max(max_rows, total / (4 * P))`` with P
tasks (the shuffle partitions, or one per ``TASK_ROWS`` if that is more), or more bytes than
the like limit of bytes where lines are weighed. At most ``8 * P`` groups can be hot, whatever the data, so a table with one row per hot group
has a proven size bound and may be broadcast. Nothing is dropped or capped: hot groups are
cut into ranges. Group sizes cost one narrow, pre-aggregated pass, unless the row counts in
the Parquet footers of the input prove that there are no more rows than one group may have.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourceloom.session import shared_folder

MAX_GROUP_ROWS = 1_000_000
# Rows and bytes that a task ranks and assembles: with more, there are more tasks than shuffle
# partitions, so that a task's memory does not grow with the input.
TASK_ROWS = 500_000
TASK_BYTES = 128 * 1024 * 1024
MAX_GROUP_BYTES = 256 * 1024 * 1024
PART_BYTES = 1024 * 1024
_SAMPLES_PER_RANGE = 20
_HASH_SPACE = 1 << 30


@dataclass(frozen=True)
class SkewPolicy:
    max_rows: int = MAX_GROUP_ROWS
    max_bytes: int = MAX_GROUP_BYTES


DEFAULT = SkewPolicy()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in ``spark.checkpoint.dir``."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


# Plan nodes that return no more rows than they read.
_NARROWING = frozenset(
    "Project Filter Aggregate Distinct Deduplicate Sort Window Repartition RepartitionByExpression RebalancePartitions SubqueryAlias LocalLimit GlobalLimit".split()
)
# Footers are read on the driver for so many files at most.
MAX_FOOTERS = 64


def row_bound(df: DataFrame) -> int | None:
    """A number of rows that ``df`` has at most, by its plan and Parquet footers, without a
    Spark job; None if they do not tell."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    footers = [MAX_FOOTERS]

    def listed(seq) -> list:
        return [seq.apply(i) for i in range(seq.size())]

    def in_files(paths: list[str]) -> int | None:
        footers[0] -= len(paths)
        if footers[0] < 0:
            return None
        rows = 0
        for path in paths:
            where = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path)), conf)
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(where)
            try:
                rows += reader.getRecordCount()
            finally:
                reader.close()
        return rows

    def most(node) -> int | None:
        kind = node.getClass().getSimpleName()
        if kind == "LogicalRelation":
            relation = node.relation()
            if relation.getClass().getSimpleName() != "HadoopFsRelation" or "Parquet" not in relation.fileFormat().getClass().getSimpleName():
                return None
            return in_files(list(relation.location().inputFiles()))
        if kind == "LocalRelation":
            return node.data().size()
        if kind == "OneRowRelation":
            return 1
        if kind == "Range":
            return int(str(node.numElements()))
        below = [most(child) for child in listed(node.children())]
        if None in below:
            return below[0] if kind == "Join" and below[0] is not None and node.joinType().sql() in ("LEFT SEMI", "LEFT ANTI") else None
        if kind in _NARROWING:
            return max(below[0], 1)
        if kind == "Union":
            return sum(below)
        if kind == "Join" and node.joinType().sql() in ("LEFT SEMI", "LEFT ANTI"):
            return below[0]
        if kind == "Generate":
            made = listed(node.generator().children())
            if len(made) == 1 and made[0].getClass().getSimpleName() == "CreateArray":
                return below[0] * max(made[0].children().size(), 1)
        return None

    return most(df._jdf.queryExecution().optimizedPlan())


def _sizes(rows: DataFrame, keys: list[str]) -> DataFrame:
    weight = F.sum("__w") if "__w" in rows.columns else F.lit(0)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), weight.alias("__bytes"))


def _ranges(limits: tuple[int, int]) -> Column:
    """Into how many ranges a group is cut."""
    return F.ceil(F.greatest(F.col("__n") / limits[0], F.col("__bytes") / limits[1]))


def _hot_limits(sized: DataFrame, keys: list[str], policy: SkewPolicy, bound: DataFrame | None = None) -> tuple[tuple[int, int] | None, int]:
    """Rows and bytes a group may have, or None if no group has more; and the tasks that the
    rows need, or 0 if the shuffle partitions will do. If ``bound`` is proven to have no more
    rows than a group may have, nothing is counted."""
    most = None if bound is None else row_bound(bound)
    if most is not None and most <= policy.max_rows:
        return None, 0
    sizes = _sizes(sized, keys)
    top = sizes.agg(
        F.sum("__n").alias("rows"), F.max("__n").alias("most_rows"), F.sum("__bytes").alias("bytes"), F.max("__bytes").alias("most_bytes")
    ).first()
    if top.rows is None:
        return None, 0
    partitions = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(-(-top.rows // TASK_ROWS), -(-int(top.bytes or 0) // TASK_BYTES))
    share = 4 * max(partitions, tasks)
    limits = max(policy.max_rows, -(-top.rows // share)), max(policy.max_bytes, -(-int(top.bytes or 0) // share))
    hot = top.most_rows > limits[0] or (top.most_bytes or 0) > limits[1]
    return limits if hot else None, tasks if tasks > partitions else 0


def _dealt(rows: DataFrame, tasks: int, keys: list[str]) -> DataFrame:
    """Rows dealt to so many tasks; with 0 as Spark deals them."""
    return rows.repartition(tasks, *keys) if tasks else rows


def with_rank(
    df: DataFrame,
    group: list[str],
    order: list[str],
    out: str = "rank",
    weight: Column | None = None,
    section: str | None = None,
    sized: DataFrame | None = None,
    policy: SkewPolicy = DEFAULT,
    bound: DataFrame | None = None,
) -> DataFrame:
    """1-based row number (bigint) per group in ascending order.

    With ``weight`` the sum of the weights before a row is added as ``<out>_before``. With
    ``section``, the first order column, ``<out>_opens`` marks the first row of a section.
    ``order`` must be unique within a group. ``sized`` may give rows with the group
    columns that are cheaper to count than ``df`` and, group by group, at least as many;
    ``bound`` rows of which there are, in all, at least as many as any one group has.

    A hot group is cut into ranges of the order key. Each range is ranked in its own task
    and shifted by what lies before it. The cuts come from a hash sample, which only
    decides where ranges meet: every row is ranked.
    """
    return _ranked(df, group, order, out, weight, section, sized, policy, bound)[0]


def _ranked(
    df: DataFrame, group: list[str], order: list[str], out: str, weight: Column | None, section: str | None,
    sized: DataFrame | None, policy: SkewPolicy, bound: DataFrame | None = None,
) -> tuple[DataFrame, int]:
    """As ``with_rank``; and the tasks that the rows need, if they do not lie by group in as many."""
    keys = group or ["__all"]
    rows = df if group else df.withColumn("__all", F.lit(0))
    counted_rows = rows if sized is None else sized if group else sized.withColumn("__all", F.lit(0))
    rows = rows.withColumn("__w", F.lit(0) if weight is None else weight)
    rows = rows.withColumn("__sec", F.lit(0) if section is None else F.col(section))

    def finish(ranked: DataFrame, shift: Column, shift_w: Column, last: Column) -> DataFrame:
        added = [(F.col("__rank") + shift).alias(out)]
        if weight is not None:
            added.append((F.col("__before") + shift_w).alias(f"{out}_before"))
        if section is not None:
            previous = F.coalesce(F.col("__prev"), last)
            added.append((~previous.eqNullSafe(F.col("__sec"))).alias(f"{out}_opens"))
        return ranked.select(*df.columns, *added)

    if bound is None and (sized is not None or weight is None):  # else bytes have to be summed
        bound = counted_rows
    limits, tasks = _hot_limits(counted_rows if sized is not None else rows, keys, policy, bound)
    if limits is None:
        none = F.lit(0).cast("bigint")
        return finish(_rank_within(_dealt(rows, tasks, keys), keys, order), none, none, F.lit(None)), 0

    rows = cut_lineage(rows)
    groups = _sizes(rows, keys).withColumn("__cuts", _ranges(limits)).where("__cuts > 1").drop("__bytes")
    key_of = F.struct(*[F.col(c) for c in order])
    share = _SAMPLES_PER_RANGE * F.col("__cuts") / F.col("__n")
    sample = rows.select(*keys, key_of.alias("__key")).join(F.broadcast(groups), keys).where(
        F.pmod(F.xxhash64("__key"), F.lit(_HASH_SPACE)) / _HASH_SPACE < share
    )
    bounds = sample.groupBy(*keys).agg(
        F.sort_array(F.collect_set("__key")).alias("__s"), F.first("__cuts").alias("__cuts")
    ).select(
        *keys,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(1).cast("bigint"), F.col("__cuts")),
                lambda i: F.get("__s", F.floor(i * F.size("__s") / (F.col("__cuts") + 1)).cast("int")),
            )
        ).alias("__bounds"),
    )
    placed = rows.join(F.broadcast(bounds), keys, "left").withColumn(
        "__range", _range_of(F.col("__bounds"), key_of)
    )
    counted = placed.where(F.col("__bounds").isNotNull()).groupBy(*keys, "__range").agg(
        F.count(F.lit(1)).alias("__n"), F.sum("__w").alias("__w"), F.max("__sec").alias("__sec")
    )
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counted.select(
        *keys, "__range",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__shift"),
        F.coalesce(F.sum("__w").over(earlier), F.lit(0)).alias("__shift_w"),
        F.max("__sec").over(earlier).alias("__last"),
    )
    ranked = _rank_within(_dealt(placed, tasks, [*keys, "__range"]), [*keys, "__range"], order).join(
        F.broadcast(shifts), [*keys, "__range"], "left"
    )
    return finish(
        ranked, F.coalesce("__shift", F.lit(0)), F.coalesce("__shift_w", F.lit(0)), F.col("__last")
    ), tasks


def _rank_within(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "*",
        F.row_number().over(window).cast("bigint").alias("__rank"),
        F.coalesce(F.sum("__w").over(earlier), F.lit(0)).cast("bigint").alias("__before"),
        F.lag("__sec").over(window).alias("__prev"),
    )


def _range_of(bounds: Column, key: Column) -> Column:
    """How many of the sorted bounds are not above the key (binary search)."""

    def halve(state: Column, _step: Column) -> Column:
        mid = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        below = F.get(bounds, mid) <= key
        return (
            F.when(state["lo"] >= state["hi"], state)
            .when(below, F.struct((mid + 1).alias("lo"), state["hi"].alias("hi")))
            .otherwise(F.struct(state["lo"].alias("lo"), mid.alias("hi")))
        )

    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))
    steps = F.ceil(F.log2(F.size(bounds) + 1)).cast("int")
    found = F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, halve)["lo"]
    return F.when(bounds.isNotNull(), found).otherwise(0)


def text_parts(
    lines: DataFrame,
    page: list[str],
    order: list[str],
    line: str = "line",
    out: str = "body_md",
    sep: str = "",
    keep: tuple[str, ...] = (),
    heading: Column | None = None,
    sized: DataFrame | None = None,
    part_bytes: int = PART_BYTES,
    policy: SkewPolicy = DEFAULT,
) -> DataFrame:
    """Ordered lines of a page as rows ``page..., keep..., part, text``.

    A line belongs to part ``floor(bytes before it / part_bytes)``, one byte added per
    line. Joined in order the parts are the page. No row is larger than ``part_bytes``
    and one line, however large the page. ``keep`` columns depend on the page columns.
    ``heading`` is set before the first line of each value of the first order column.
    """
    ranked, tasks = _ranked(
        lines, page, order, "__r", F.octet_length(F.col(line)) + 1,
        None if heading is None else order[0], sized, policy,
    )
    text = F.col(line)
    if heading is not None:
        text = F.concat(F.when(F.col("__r_opens"), heading).otherwise(""), text)
    items = ranked.select(
        *page, *keep,
        F.call_function("div", F.col("__r_before"), F.lit(part_bytes)).alias("part"),
        F.struct("__r", text.alias("__line")).alias("__item"),
    )
    ordered = F.sort_array(F.collect_list("__item"))["__line"]
    return _dealt(items, tasks, [*page, "part"]).groupBy(*page, *keep, "part").agg(F.array_join(ordered, sep).alias(out))


def spread(df: DataFrame, tasks: int) -> DataFrame:
    """Rows dealt evenly to ``tasks`` tasks, for costly work per row."""
    return df.repartition(tasks)


def fixed_rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A few literal rows made in the JVM."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")

"""Metric requests answered over the semantic model, or refused before any job.

A request names one measure, dimensions to group by and filters. Joins go from the
measure's table to a parent over exactly one relationship, or, if ``max_hops`` allows it, over
a chain of them to a parent's parent; everything that could repeat the measure's rows, or
could be read in two ways, is refused. Several measures, each at its own grain, are
answered together over the dimensions they share.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import Tables, ref
from .lanes import union_all
from .semantic import SemanticModel

OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "=": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
}


# What a refusal says; one request and a batch of them say the same.
UNKNOWN_METRIC = 'Unknown metric "%s"; known: %s'
UNKNOWN_DIMENSION = 'Unknown dimension "%s"; known: %s'
UNKNOWN_FILTER = 'Unknown filter column "%s".'
UNSUPPORTED = 'Unsupported filter operator "%s".'
AMBIGUOUS_NAME = '"%s" is on more than one table (%s); qualify it as table.name.'
AMBIGUOUS_JOIN = '"%s" is ambiguous: %s refers to %s by more than one key (%s).'
FAN_OUT = '"%s" would fan out "%s": one %s row can match many %s rows. Ask for a metric of %s instead.'
NOT_JOINABLE = '"%s" is on %s, which %s does not reach in %s.'
WRONG_OPERAND = '%s.%s is %s and cannot be compared with "%s".'
NOT_CONFORMED = '"%s" is %s for "%s" but %s for "%s"; qualify it as table.name.'

#: Numbers and times that text may spell, for operands.
_NUMBER = r"[ \t]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t]*"
_TIME = r"[ \t]*[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?[ \t]*"


def _joins(hops: int) -> str:
    return "one join" if hops == 1 else f"{hops} joins"


class MetricRefused(ValueError):
    """The request has no single safe answer; ``code`` says why."""

    def __init__(self, code: str, reason: str):
        super().__init__(reason)
        self.code = code
        self.reason = reason


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: str | int | float


@dataclass(frozen=True)
class MetricRequest:
    metric: str
    dimensions: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class MetricCatalog:
    """The model's schema-sized rows on the driver, so that refusals need no job."""

    measures: list
    dimensions: list
    edges: list

    @classmethod
    def of(cls, model: SemanticModel) -> MetricCatalog:
        measures = model.measures.select("entity_ordinal", "ordinal", "table", "name", "agg", "column")
        dimensions = model.dimensions.select("entity_ordinal", "ordinal", "table", "name", "column")
        edges = model.relationships.select("ordinal", "from_table", "from_column", "to_table", "to_column")

        def ordered(df: DataFrame, *by: str) -> list:
            return sorted(df.collect(), key=lambda r: tuple(r[b] for b in by))

        return cls(
            ordered(measures, "entity_ordinal", "ordinal"),
            ordered(dimensions, "entity_ordinal", "ordinal"),
            ordered(edges, "ordinal"),
        )


@dataclass
class MetricPlan:
    """Tables, keys and columns a request resolved to."""

    base: str
    agg: str
    column: str | None
    metric: str
    groups: list[tuple[str, str, str]] = field(default_factory=list)  # table, column, name
    filters: list[tuple[str, str, Filter]] = field(default_factory=list)  # table, column, filter
    joins: dict[str, tuple[str, str]] = field(default_factory=dict)  # parent: foreign, key
    via: dict[str, str] = field(default_factory=dict)  # parent: the table that holds the foreign key, if not the base

    def holder(self, parent: str) -> str:
        return self.via.get(parent, self.base)


def _names(rows: list) -> str:
    return ", ".join(row.name for row in rows) or "(none)"


def _pick(found: list, base: str, what: str):
    """The measure's own table first; otherwise the name must belong to one table."""
    own = [row for row in found if row.table == base]
    if own:
        return own[0]
    owners = list(dict.fromkeys(row.table for row in found))
    if len(owners) > 1:
        raise MetricRefused(
            "ambiguous_name", AMBIGUOUS_NAME % (what, ", ".join(owners))
        )
    return found[0]


def _matches(row, name: str, *fields: str) -> bool:
    return any(name == row[f] or name == f"{row.table}.{row[f]}" for f in fields)


def forward_paths(catalog: MetricCatalog, base: str, target: str, max_hops: int) -> list[list]:
    """Chains of relationships from foreign keys to keys, by length and then by their edges' order; no table twice."""
    out, open_ = [], [[]]
    for _ in range(max_hops):
        longer = []
        for path in open_:
            at, seen = path[-1].to_table if path else base, {base, *(e.to_table for e in path)}
            longer += [[*path, e] for e in catalog.edges if e.from_table == at and e.to_table not in seen]
        out += [path for path in longer if path[-1].to_table == target]
        open_ = [path for path in longer if path[-1].to_table != target]
    return sorted(out, key=lambda path: (len(path), [e.ordinal for e in path]))


def fanning_step(catalog: MetricCatalog, base: str, target: str, max_hops: int) -> tuple[str, str] | None:
    """``(parent, child)`` of the first step from a key back to its foreign keys on the shortest way to the target."""
    steps = [(e.ordinal, back, *ends) for e in catalog.edges for back, ends in ((0, (e.from_table, e.to_table)), (1, (e.to_table, e.from_table)))]
    ways: dict[str, list] = {base: []}
    last = ways
    for _ in range(max_hops):
        found: dict[str, list] = {}
        for step in steps:
            if step[2] in last and step[3] not in ways:
                found[step[3]] = min([*last[step[2]], step], found.get(step[3], [(float("inf"),)]))
        ways, last = {**ways, **found}, found
    return next(((a, b) for _, back, a, b in ways.get(target, []) if back), None)


def _join(plan: MetricPlan, catalog: MetricCatalog, target: str, what: str, max_hops: int) -> None:
    """Join the target's table: over its only direct key, else over the only chain of keys."""
    if target == plan.base or target in plan.joins:
        return
    paths = forward_paths(catalog, plan.base, target, max_hops)
    direct = [path for path in paths if len(path) == 1]
    if len(direct or paths) > 1:
        keys = " or ".join(" -> ".join(f"{e.from_table}.{e.from_column}" for e in path) for path in direct or paths)
        raise MetricRefused("ambiguous_join", AMBIGUOUS_JOIN % (what, plan.base, target, keys))
    if paths:
        for e in paths[0]:
            plan.joins.setdefault(e.to_table, (e.from_column, e.to_column))
            if e.from_table != plan.base:
                plan.via.setdefault(e.to_table, e.from_table)
        return
    step = fanning_step(catalog, plan.base, target, max_hops)
    if step:
        raise MetricRefused("fan_out", FAN_OUT % (what, plan.metric, *step, target))
    raise MetricRefused("not_joinable", NOT_JOINABLE % (what, target, plan.base, _joins(max_hops)))


def plan_metric(catalog: MetricCatalog, request: MetricRequest, max_hops: int = 1) -> MetricPlan:
    """Resolve a request or raise ``MetricRefused``; touches no data.

    With ``max_hops`` beyond 1, a table that no key of the measure's table leads to may be
    reached over a chain of so many keys, if there is only one such chain.
    """
    if max_hops < 1:
        raise ValueError("a join takes at least one hop")
    measure = next((m for m in catalog.measures if m.name == request.metric), None)
    if measure is None:
        raise MetricRefused(
            "unknown_metric", UNKNOWN_METRIC % (request.metric, _names(catalog.measures))
        )
    plan = MetricPlan(measure.table, measure.agg, measure.column, request.metric)
    for name in request.dimensions:
        found = [d for d in catalog.dimensions if _matches(d, name, "name")]
        if not found:
            raise MetricRefused(
                "unknown_dimension", UNKNOWN_DIMENSION % (name, _names(catalog.dimensions))
            )
        dimension = _pick(found, plan.base, name)
        _join(plan, catalog, dimension.table, name, max_hops)
        plan.groups.append((dimension.table, dimension.column, name))
    for item in request.filters:
        if item.op not in OPERATORS:
            raise MetricRefused("unsupported_operator", UNSUPPORTED % item.op)
        found = [d for d in catalog.dimensions if _matches(d, item.column, "name", "column")]
        found = found or [m for m in catalog.measures if m.column and _matches(m, item.column, "column")]
        if not found:
            raise MetricRefused("unknown_filter_column", UNKNOWN_FILTER % item.column)
        target = _pick(found, plan.base, item.column)
        _join(plan, catalog, target.table, item.column, max_hops)
        plan.filters.append((target.table, target.column, item))
    return plan


def run_plan(tables: Tables, plan: MetricPlan) -> DataFrame:
    """The lazy result of a resolved request, ordered by its dimensions."""
    out = _run(tables, [plan])
    return out.orderBy(*[ref(name).asc_nulls_last() for _, _, name in plan.groups]) if plan.groups else out


def _run(tables: Tables, plans: list[MetricPlan]) -> DataFrame:
    """Measures of one table with the same dimensions and filters, in one pass.

    Rows are added up per foreign key before any join, so a key that holds a third of
    the rows reaches the join as one row per task, and a parent joins against distinct
    keys. A parent that leads on to its own parent is added up by that key before the next
    join. Filters and the needed columns go to each table's scan.
    """
    plan = plans[0]

    def condition(table: str) -> Column:
        out = F.lit(True)
        for owner, column, item in plan.filters:
            if owner == table:
                out = out & OPERATORS[item.op](ref(column), F.lit(item.value))
        return out

    # the names used inside the plan cannot clash with the tables' own columns
    group_at = {i: f"__g{i}" for i in range(len(plan.groups))}
    key_at = {table: f"__k{i}" for i, table in enumerate(plan.joins)}
    part_at = {i: f"__part{i}" for i in range(len(plans))}

    def columns(table: str) -> list[Column]:
        """The dimensions and further keys that a table brings in."""
        keys = [ref(foreign).alias(key_at[parent]) for parent, (foreign, _) in plan.joins.items() if plan.holder(parent) == table]
        return keys + [ref(column).alias(group_at[i]) for i, (owner, column, _) in enumerate(plan.groups) if owner == table]

    def rows(table: str) -> DataFrame:
        out = tables[table].where(condition(table))
        for parent, (foreign, _) in plan.joins.items():
            if plan.holder(parent) == table:
                out = out.where(ref(foreign).isNotNull())
        return out

    parts = [(F.count(F.lit(1)) if p.agg == "count" else F.sum(ref(p.column))).alias(part_at[i]) for i, p in enumerate(plans)]
    keys = columns(plan.base)
    out = rows(plan.base).groupBy(*keys).agg(*parts) if keys else rows(plan.base).agg(*parts)
    totals = [F.sum(part_at[i]).alias(part_at[i]) for i in part_at]

    for table, (_, key) in plan.joins.items():
        parent = rows(table).select(ref(key).alias("__key"), *columns(table))
        out = out.join(parent, _same(out, key_at[table], parent, "__key"), "inner").drop("__key", key_at[table])
        if any(plan.holder(further) == table for further in plan.joins):
            out = out.groupBy(*[c for c in out.columns if c not in part_at.values()]).agg(*totals)

    names = [F.col(group_at[i]).alias(plan.groups[i][2]) for i in range(len(plan.groups))]
    if plan.joins:
        totals = [
            (F.coalesce(F.sum(part_at[i]), F.lit(0)) if p.agg == "count" else F.sum(part_at[i])).alias(part_at[i]) for i, p in enumerate(plans)
        ]
        out = out.groupBy(*[group_at[i] for i in group_at]).agg(*totals)
    return out.select(*names, *[F.col(part_at[i]).alias(p.metric) for i, p in enumerate(plans)])


def _same(left: DataFrame, a: str, right: DataFrame, b: str) -> Column:
    """Equal keys, compared as text when one side is a number kept as text."""
    text = {left.schema[a].dataType.typeName(), right.schema[b].dataType.typeName()}
    if "string" in text and len(text) > 1:
        return F.col(a).cast("string") == F.col(b).cast("string")
    return F.col(a) == F.col(b)


def _comparable(value, data_type: T.DataType) -> bool:
    """Whether an operand is of the column's kind, so that no cast can fail while a job runs."""
    if isinstance(data_type, T.StringType):
        return isinstance(value, str)
    if isinstance(data_type, T.BooleanType):
        return isinstance(value, bool)
    if isinstance(data_type, T.NumericType):
        if isinstance(value, str):
            return re.fullmatch(_NUMBER, value) is not None
        return isinstance(value, (int, float, Decimal)) and not isinstance(value, bool)
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        if isinstance(value, str):
            try:
                return re.fullmatch(_TIME, value) is not None and bool(datetime.fromisoformat(value.strip()))
            except ValueError:
                return False
        return isinstance(value, date)
    return False


def _comparable_text(value: Column, kind: Column) -> Column:
    """:func:`_comparable` for operands kept as text, by the names of the columns' types."""
    number = kind.isin("tinyint", "smallint", "int", "bigint", "float", "double") | kind.startswith("decimal")
    spelled = value.rlike(f"^(?:{_NUMBER})$") & ~value.contains("\n")
    time = value.rlike(f"^(?:{_TIME})$") & ~value.contains("\n") & F.trim(F.replace(value, F.lit("\t"), F.lit(" "))).try_cast("timestamp").isNotNull()
    fits = F.when(kind == "string", True).when(number, spelled).when(kind.isin("date", "timestamp", "timestamp_ntz"), time).otherwise(False)
    return F.coalesce(value.isNotNull() & fits, F.lit(False))


def check_operands(tables: Tables, plan: MetricPlan) -> None:
    """Refuse filters that compare a column with something of another kind."""
    for table, column, item in plan.filters:
        kind = tables[table].schema[column].dataType
        if not _comparable(item.value, kind):
            shown = "null" if item.value is None else item.value
            raise MetricRefused("wrong_operand", WRONG_OPERAND % (table, column, kind.simpleString(), shown))


def query_metric(tables: Tables, catalog: MetricCatalog, request: MetricRequest, max_hops: int = 1) -> DataFrame:
    plan = plan_metric(catalog, request, max_hops)
    check_operands(tables, plan)
    return run_plan(tables, plan)


def plan_metrics(
    catalog: MetricCatalog, metrics: Sequence[str], dimensions: Sequence[str] = (), filters: Sequence[Filter] = (), max_hops: int = 1
) -> list[MetricPlan]:
    """A plan for each measure, over dimensions that mean the same column to all of them, or ``MetricRefused``."""
    if not metrics or len(set(metrics)) < len(metrics):
        raise ValueError("name at least one measure, and each once")
    plans = [plan_metric(catalog, MetricRequest(m, tuple(dimensions), tuple(filters)), max_hops) for m in metrics]
    first = plans[0]
    for plan in plans[1:]:
        for (table, column, name), (other_table, other_column, _) in zip(first.groups, plan.groups):
            if (table, column) != (other_table, other_column):
                here, there = f"{table}.{column}", f"{other_table}.{other_column}"
                raise MetricRefused("not_conformed", NOT_CONFORMED % (name, here, first.metric, there, plan.metric))
        for (table, column, item), (other_table, other_column, _) in zip(first.filters, plan.filters):
            if (table, column) != (other_table, other_column):
                here, there = f"{table}.{column}", f"{other_table}.{other_column}"
                raise MetricRefused("not_conformed", NOT_CONFORMED % (item.column, here, first.metric, there, plan.metric))
    return plans


def query_metrics(
    tables: Tables, catalog: MetricCatalog, metrics: Sequence[str], dimensions: Sequence[str] = (), filters: Sequence[Filter] = (), max_hops: int = 1
) -> DataFrame:
    """Several measures side by side: the dimensions, then a column for each measure.

    Each measure is added up at its own grain before anything meets, so no row of one
    repeats those of another. Measures of one table are read in one pass. Results meet by
    grouping on the shared dimensions, in which nulls are equal; a group that a measure does
    not reach has count 0 and sum null.
    """
    plans = plan_metrics(catalog, metrics, dimensions, filters, max_hops)
    for plan in plans:
        check_operands(tables, plan)
    by_base: dict[str, list[MetricPlan]] = {}
    for plan in plans:
        by_base.setdefault(plan.base, []).append(plan)
    results = [_run(tables, same) for same in by_base.values()]
    names = [name for _, _, name in plans[0].groups]
    out = results[0]
    for other in results[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    # a group has at most one row of each table
    met = {p.metric: F.coalesce(F.max(ref(p.metric)), F.lit(0)) if p.agg == "count" else F.max(ref(p.metric)) for p in plans}
    out = out.groupBy(*map(ref, names)).agg(*(total.alias(name) for name, total in met.items()))
    return out.orderBy(*[ref(name).asc_nulls_last() for name in names]) if names else out


def join_loss(tables: Tables, edges: list) -> DataFrame:
    """Rows an inner join over each edge silently drops, one row per edge.

    ``edges`` are relationship rows. Rows are counted per key value first and the other
    side is made distinct, so the anti-join sees every key once however often it occurs.
    """
    frames = []
    for edge in edges:
        keyed = tables[edge.from_table].groupBy(ref(edge.from_column).alias("__fk")).agg(
            F.count(F.lit(1)).alias("n")
        )
        parent = tables[edge.to_table].select(ref(edge.to_column).alias("__key")).distinct()
        lost = keyed.join(parent, _same(keyed, "__fk", parent, "__key"), "left_anti")
        frames.append(
            lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_lost")).select(
                F.lit(edge.from_table).alias("from_table"),
                F.lit(edge.from_column).alias("from_column"),
                F.lit(edge.to_table).alias("to_table"),
                F.lit(edge.to_column).alias("to_column"),
                "rows_lost",
            )
        )
    return union_all(frames)


def _reach(edges: DataFrame, max_hops: int) -> tuple[DataFrame, DataFrame]:
    """What :func:`forward_paths` and :func:`fanning_step` find for all pairs of tables, by joins over the edges.

    ``(base, table, keys, key_names)`` and ``(base, table, parent, child)``; both are as
    small as the schema.
    """
    step = F.struct("ordinal", F.concat_ws(".", "from_table", "from_column").alias("key"))
    paths = edges.select(
        F.col("from_table").alias("base"), F.col("to_table").alias("table"), F.array("from_table", "to_table").alias("seen"), F.array(step).alias("path")
    )
    all_paths = paths
    on = edges.select(F.col("from_table").alias("table"), F.col("to_table").alias("next"), step.alias("step"))
    for _ in range(max_hops - 1):
        paths = paths.join(on, "table").where(~F.array_contains("seen", F.col("next"))).select(
            "base", F.col("next").alias("table"), F.concat("seen", F.array("next")).alias("seen"), F.concat("path", F.array("step")).alias("path")
        )
        all_paths = all_paths.union(paths)
    shown = F.struct(
        F.size("path").alias("hops"), F.col("path.ordinal").alias("ordinals"), F.array_join("path.key", " -> ").alias("keys")
    )
    found = all_paths.where("base <> table").groupBy("base", "table").agg(F.sort_array(F.collect_list(shown)).alias("paths"))
    direct = F.filter("paths", lambda p: p["hops"] == 1)
    meant = F.when(F.size(direct) > 0, direct).otherwise(F.col("paths"))
    forward = found.select("base", "table", F.size(meant).alias("keys"), F.transform(meant, lambda p: p["keys"]).alias("key_names"))

    steps = edges.select(F.inline(F.array(*(
        F.struct("ordinal", F.lit(back).alias("back"), F.col(a).alias("start"), F.col(b).alias("end"))
        for back, a, b in ((0, "from_table", "to_table"), (1, "to_table", "from_table"))
    ))))
    steps = steps.select(F.struct("ordinal", "back", "start", "end").alias("step"))
    tables = edges.select("from_table").union(edges.select("to_table")).distinct()
    kind = "array<struct<ordinal:" + edges.schema["ordinal"].dataType.simpleString() + ",back:int,start:string,end:string>>"
    ways = tables.select(F.col("from_table").alias("base"), F.col("from_table").alias("table"), F.expr(f"cast(array() as {kind})").alias("way"))
    last = ways
    for _ in range(max_hops):
        longer = last.join(steps, F.col("table") == F.col("step.start")).select(
            "base", F.col("step.end").alias("table"), F.concat("way", F.array("step")).alias("way")
        )
        last = longer.join(ways.select("base", "table"), ["base", "table"], "left_anti").groupBy("base", "table").agg(F.min("way").alias("way"))
        ways = ways.union(last)
    first = F.get(F.filter("way", lambda s: s["back"] == 1), 0)
    fanning = ways.select("base", "table", first["start"].alias("parent"), first["end"].alias("child")).where("parent is not null")
    return forward, fanning


def validate_requests(
    spark: SparkSession, model: SemanticModel, requests: DataFrame, max_hops: int = 1, columns: DataFrame | None = None
) -> DataFrame:
    """Check many requests against the model with joins: ``(request_id, status, subject, reason)``.

    ``requests`` has ``request_id``, ``metric``, ``dimensions array<string>`` and
    ``filters array<struct<column,op,value>>``. The first problem in request order is
    reported, dimensions before filters. With ``columns`` (table, column and type, as
    ``list_columns`` gives them), operands of the wrong kind are reported too, after all other problems.
    """
    valued = "value" in requests.schema["filters"].dataType.elementType.names
    measures = model.measures.withColumn(
        "place",
        F.row_number().over(Window.partitionBy("name").orderBy("entity_ordinal", "ordinal")),
    ).where("place = 1").select(F.col("name").alias("metric"), F.col("table").alias("base"))
    named = requests.join(measures, "metric", "left")

    parts = named.where("base is not null").select(
        "request_id",
        "base",
        F.posexplode(
            F.concat(
                F.transform(
                    "dimensions",
                    lambda d: F.struct(F.lit("dimension").alias("role"), d.alias("name"), F.lit("=").alias("op"), F.lit(None).cast("string").alias("value")),
                ),
                F.transform(
                    "filters",
                    lambda f: F.struct(
                        F.lit("filter").alias("role"), f["column"].alias("name"), f["op"].alias("op"),
                        (f["value"] if valued else F.lit(None)).cast("string").alias("value"),
                    ),
                ),
            )
        ).alias("position", "part"),
    ).select("request_id", "base", "position", "part.*")

    at = F.struct("entity_ordinal", "ordinal").alias("at")
    dimensions = model.dimensions.select("name", "column", "table", at)
    owners = dimensions.select(F.lit("dimension").alias("role"), "name", "table", "at", "column").unionByName(
        dimensions.select(F.lit("filter").alias("role"), "name", "table", "at", "column")
    ).unionByName(dimensions.select(F.lit("filter").alias("role"), F.col("column").alias("name"), "table", "at", "column"))
    by_measure = model.measures.where("column is not null").select(
        F.lit("filter").alias("role"), F.col("column").alias("name"), "table", at, "column"
    )
    by_measure = by_measure.join(owners, ["role", "name"], "left_anti")
    owners = owners.unionByName(by_measure)
    owners = owners.unionByName(owners.select("role", F.concat_ws(".", "table", "name").alias("name"), "table", "at", "column"))
    owners = owners.groupBy("role", "name", "table").agg(F.min(F.struct("at", "column")).alias("first"))
    owners = owners.select("role", "name", "table", "first.*")

    edges = model.relationships.select("from_table", "to_table", "from_column", "ordinal")
    forward, fanning = _reach(edges, max_hops)

    found = (
        parts.join(owners, ["role", "name"], "left")
        .withColumn("own", F.col("table") == F.col("base"))
        .groupBy("request_id", "base", "position", "role", "name", "op", "value")
        .agg(
            F.countDistinct("table").alias("owners"),
            F.max("own").alias("own"),
            F.sort_array(F.collect_list(F.struct("at", "table", "column"))).alias("places"),
            F.min(F.when(F.col("own"), F.col("column"))).alias("own_column"),
        )
        .withColumn("tables", F.col("places.table"))
        .withColumn("table", F.when(F.col("own"), F.col("base")).otherwise(F.get("tables", F.lit(0))))
        .withColumn("column", F.when(F.col("own"), F.col("own_column")).otherwise(F.get("places.column", F.lit(0))))
        .join(forward, ["base", "table"], "left")
        .join(fanning, ["base", "table"], "left")
        .join(named.select("request_id", "metric"), "request_id")
    )
    local = F.col("table") == F.col("base")
    problem = (
        F.when(~F.col("op").isin(*OPERATORS), "unsupported_operator")
        .when((F.col("owners") == 0) & (F.col("role") == "dimension"), "unknown_dimension")
        .when(F.col("owners") == 0, "unknown_filter_column")
        .when(local, F.lit(None))
        .when(F.col("owners") > 1, "ambiguous_name")
        .when(F.col("keys") > 1, "ambiguous_join")
        .when(F.col("keys") == 1, F.lit(None))
        .when(F.col("child").isNotNull(), "fan_out")
        .otherwise("not_joinable")
    )
    later = F.lit(None).cast("string")
    if columns is not None and valued:
        types = columns.select("table", "column", F.col("type").alias("column_type"))
        found = found.join(types, ["table", "column"], "left")
        wrong = (F.col("role") == "filter") & ~_comparable_text(F.col("value"), F.col("column_type"))
        later = F.when(wrong, F.format_string(WRONG_OPERAND, "table", "column", "column_type", F.coalesce("value", F.lit("null"))))
    known = {
        what: ", ".join(r["name"] for r in sorted(df.select("entity_ordinal", "ordinal", "name").collect())) or "(none)"
        for what, df in (("metrics", model.measures), ("dimensions", model.dimensions))  # as many as the schema has
    }
    say = lambda text, *values: F.format_string(text, *(F.col(v) if isinstance(v, str) else v for v in values))
    key_list = F.array_join("key_names", " or ")
    reason = (
        F.when(F.col("problem") == "unsupported_operator", say(UNSUPPORTED, "op"))
        .when(F.col("problem") == "unknown_dimension", say(UNKNOWN_DIMENSION, "name", F.lit(known["dimensions"])))
        .when(F.col("problem") == "unknown_filter_column", say(UNKNOWN_FILTER, "name"))
        .when(F.col("problem") == "ambiguous_name", say(AMBIGUOUS_NAME, "name", F.array_join("tables", ", ")))
        .when(F.col("problem") == "ambiguous_join", say(AMBIGUOUS_JOIN, "name", "base", "table", key_list))
        .when(F.col("problem") == "fan_out", say(FAN_OUT, "name", "metric", "parent", "child", "table"))
        .otherwise(say(NOT_JOINABLE, "name", "table", "base", F.lit(_joins(max_hops))))
    )
    # operands are looked at when everything else is right
    told = found.withColumn("problem", problem).withColumn("late", F.col("problem").isNull()).withColumn("operand", later)
    told = told.withColumn("reason", F.when(F.col("late"), F.col("operand")).otherwise(reason)).where("problem is not null or operand is not null")
    first = told.groupBy("request_id").agg(
        F.min_by(F.struct(F.coalesce("problem", F.lit("wrong_operand")).alias("problem"), "name", "reason"), F.struct("late", "position")).alias("bad")
    )
    unknown = F.col("base").isNull()
    return named.join(first, "request_id", "left").select(
        "request_id",
        F.when(unknown, "unknown_metric").otherwise(F.coalesce("bad.problem", F.lit("ok"))).alias("status"),
        F.when(unknown, F.col("metric")).otherwise(F.col("bad.name")).alias("subject"),
        F.when(unknown, say(UNKNOWN_METRIC, "metric", F.lit(known["metrics"]))).otherwise(F.col("bad.reason")).alias("reason"),
    )

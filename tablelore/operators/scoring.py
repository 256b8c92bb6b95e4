"""Scoring of suites and of runs: assertions, tallies, arms side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .metrics import MetricCatalog, MetricRefused, MetricRequest, plan_metric
from .relationships import with_key
from .semantic import SemanticModel
from .terms import TOP_K, resolve_terms, term_catalog
from ..tables import small_table

# Fixed value: the label of cases every arm must pass for a run to be valid.
CONTROL = "baseline"


def tally(results: DataFrame, *by: str) -> DataFrame:
    """Passed, failed and errored cases and the score, per group or overall."""

    def cases(outcome: str):
        return F.count(F.when(F.col("outcome") == outcome, 1)).alias(outcome)

    counts = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), cases("pass"), cases("fail"), cases("error")
    )
    return counts.select(
        *by, "total", F.col("pass").alias("passed"), F.col("fail").alias("failed"),
        F.col("error").alias("errored"),
        F.when(F.col("total") > 0, F.col("pass") / F.col("total")).otherwise(0.0).alias("score"),
    )


def strict_cases(runs: DataFrame) -> DataFrame:
    """Runs rolled up to cases: a case passes only when every run of it passes.

    ``runs`` is ``(arm, case, trap, run, pass, error, steps, corrections,
    budget_exhausted)``, one row per run; the last run's steps stand for the case.
    """
    return (
        runs.groupBy("arm", "case")
        .agg(
            F.min("trap").alias("trap"),
            F.count(F.when(F.col("pass"), 1)).alias("runs_passed"),
            F.count(F.lit(1)).alias("runs_total"),
            F.max("error").alias("error"),
            F.max_by("steps", "run").alias("steps"),
            F.max_by("corrections", "run").alias("corrections"),
            F.max("budget_exhausted").alias("budget_exhausted"),
        )
        .withColumn(
            "outcome",
            F.when(F.col("error"), "error")
            .when(F.col("runs_passed") == F.col("runs_total"), "pass")
            .otherwise("fail"),
        )
    )


def compare_arms(cases: DataFrame) -> DataFrame:
    """One row per arm: run pass rate, strict cases, mean effort and validity checks."""
    control = F.col("trap") == CONTROL
    failed = F.col("outcome") != "pass"
    # a case whose runs errored counts as one run that did not pass
    passed = F.when(F.col("error"), 0).otherwise(F.col("runs_passed"))
    total = F.when(F.col("error"), 1).otherwise(F.col("runs_total"))
    steps = F.when(F.col("error"), 0).otherwise(F.col("steps"))
    corrections = F.when(F.col("error"), 0).otherwise(F.col("corrections"))
    return cases.groupBy("arm").agg(
        F.sum(passed).cast("bigint").alias("runs_passed"),
        F.sum(total).cast("bigint").alias("runs_total"),
        (F.sum(passed) / F.sum(total)).alias("run_rate"),
        F.count(F.when(~failed, 1)).alias("cases_passed"),
        F.count(F.lit(1)).alias("cases_total"),
        F.avg(steps).alias("mean_steps"),
        F.avg(corrections).alias("mean_corrections"),
        F.count(F.when(F.col("budget_exhausted"), 1)).alias("budget_hits"),
        F.count(F.when(control, 1)).alias("controls"),
        F.count(F.when(control & failed, 1)).alias("controls_failed"),
    )


def arm_delta(arms: DataFrame, first: str, second: str) -> DataFrame:
    """One row: run pass rate of both arms and their difference in points."""
    wide = arms.groupBy().pivot("arm", [first, second]).agg(F.first("run_rate"))
    rates = wide.select(F.col(f"`{first}`").alias("first_rate"), F.col(f"`{second}`").alias("second_rate"))
    return rates.withColumn("delta_points", (F.col("first_rate") - F.col("second_rate")) * 100)


def case_tallies(cases: DataFrame, first: str, second: str) -> DataFrame:
    """One row per case of the first arm with both tallies and step counts."""
    shown = F.when(F.col("outcome") == "error", "error").otherwise(
        F.concat_ws("/", "runs_passed", "runs_total")
    )
    sides = cases.select("case", "trap", "arm", shown.alias("tally"), "steps")

    def side(arm: str, name: str) -> DataFrame:
        return sides.where(F.col("arm") == arm).select(
            "case", F.col("tally").alias(f"{name}_tally"), F.col("steps").alias(f"{name}_steps"),
            F.col("trap").alias(f"{name}_trap"),
        )

    return side(first, "first").join(side(second, "second"), "case", "left").select(
        "case", F.col("first_trap").alias("trap"), "first_tally",
        F.coalesce("second_tally", F.lit("-")).alias("second_tally"), "first_steps",
        F.coalesce("second_steps", F.lit(0)).alias("second_steps"),
    )


def behavior_violations(runs: DataFrame) -> DataFrame:
    """Every broken expectation of every run: ``(run_id, violation)``.

    ``runs`` carries ``used array<string>``, ``steps`` and the expectations ``required
    array<string>``, ``forbidden array<string>`` and ``max_steps``.
    """
    empty = F.array().cast("array<string>")
    missing = F.transform(
        F.array_except(F.coalesce("required", empty), "used"), lambda t: F.concat(F.lit("did not use "), t)
    )
    wrong = F.transform(
        F.array_intersect(F.coalesce("forbidden", empty), "used"), lambda t: F.concat(F.lit("used "), t)
    )
    over = F.when(
        F.col("steps") > F.col("max_steps"),
        F.array(F.concat(F.lit("took "), F.col("steps").cast("string"), F.lit(" steps, budget "), F.col("max_steps").cast("string"))),
    ).otherwise(empty)
    return runs.select("run_id", F.explode(F.concat(missing, wrong, over)).alias("violation"))


def run_suite(spark: SparkSession, model: SemanticModel, cases: list[dict]) -> DataFrame:
    """Grade assertions about a model: ``(id, kind, outcome, detail)``.

    A case asserts a relationship (present with a confidence floor, or absent), an
    entity (its table, measures and dimensions), a metric (answerable or refused) or a
    term (resolves to a target).
    """
    graded = [
        grade
        for kind, grade in (
            ("relationship", _grade_relationships),
            ("entity", _grade_entities),
            ("metric", _grade_metrics),
            ("term", _grade_terms),
        )
        if any(case["kind"] == kind for case in cases)
        for grade in [grade(spark, model, [c for c in cases if c["kind"] == kind])]
    ]
    known = {"relationship", "entity", "metric", "term"}
    strange = [
        {"id": c["id"], "kind": c["kind"], "detail": f'unknown case kind "{c["kind"]}"'}
        for c in cases
        if c["kind"] not in known
    ]
    if strange:
        graded.append(small_table(spark, strange, _GRADE))
    out = graded[0]
    for more in graded[1:]:
        out = out.unionByName(more)
    return out.select(
        "id", "kind", F.when(F.col("detail") == "", "pass").otherwise("fail").alias("outcome"), "detail"
    )


_GRADE = "id string, kind string, detail string"


def _grade_relationships(spark: SparkSession, model: SemanticModel, cases: list[dict]) -> DataFrame:
    rows = [
        {"id": c["id"], "kind": c["kind"], "key": c["edge"], "absent": bool(c.get("absent")),
         "floor": int(c.get("minConfidence", 0))}
        for c in cases
    ]
    asked = small_table(spark, rows, "id string, kind string, key string, absent boolean, floor int")
    edges = with_key(model.relationships).select("key", "confidence")
    shown = F.col("confidence").cast("string")
    found = F.col("confidence").isNotNull()
    return asked.join(edges, "key", "left").select(
        "id",
        "kind",
        F.when(F.col("absent") & found, F.concat(F.lit("inferred at "), shown, F.lit("% but must be absent")))
        .when(F.col("absent"), "")
        .when(~found, "edge not inferred")
        .when(
            F.col("confidence") < F.col("floor"),
            F.concat(F.lit("confidence "), shown, F.lit("% below floor "), F.col("floor").cast("string"), F.lit("%")),
        )
        .otherwise("")
        .alias("detail"),
    )


def _grade_entities(spark: SparkSession, model: SemanticModel, cases: list[dict]) -> DataFrame:
    rows = [
        {"id": c["id"], "kind": c["kind"], "entity": c["entity"], "table": c.get("table"),
         "measures": c.get("measures", []), "dimensions": c.get("dimensions", [])}
        for c in cases
    ]
    asked = small_table(
        spark, rows,
        "id string, kind string, entity string, table string, measures array<string>, dimensions array<string>",
    )

    def names(frame: DataFrame, alias: str) -> DataFrame:
        return frame.groupBy("entity").agg(F.collect_set("name").alias(alias))

    known = (
        model.entities.select("entity", F.col("table").alias("real_table"))
        .join(names(model.measures, "real_measures"), "entity", "left")
        .join(names(model.dimensions, "real_dimensions"), "entity", "left")
    )
    empty = F.array().cast("array<string>")

    def missing(kind: str):
        gone = F.array_except(f"{kind}s", F.coalesce(f"real_{kind}s", empty))
        return F.when(F.size(gone) > 0, F.concat(F.lit(f"missing {kind} "), F.array_join(gone, ", ")))

    wrong = F.when(
        F.col("table") != F.col("real_table"),
        F.concat(F.lit("table "), F.col("real_table"), F.lit(", expected "), F.col("table")),
    )
    return asked.join(known, "entity", "left").select(
        "id",
        "kind",
        F.when(F.col("real_table").isNull(), "entity not derived")
        .otherwise(F.concat_ws("; ", wrong, missing("measure"), missing("dimension")))
        .alias("detail"),
    )


def _grade_metrics(spark: SparkSession, model: SemanticModel, cases: list[dict]) -> DataFrame:
    catalog = MetricCatalog.of(model)
    rows = []
    for case in cases:
        asked = case["metric"]
        try:
            plan_metric(catalog, MetricRequest(asked["metric"], tuple(asked.get("dimensions", ()))))
            detail = "answerable but should have been refused" if case.get("expectRefusal") else ""
        except MetricRefused as refusal:
            detail = "" if case.get("expectRefusal") else f"refused: {refusal.reason}"
        rows.append({"id": case["id"], "kind": case["kind"], "detail": detail})
    return small_table(spark, rows, _GRADE)


def _grade_terms(spark: SparkSession, model: SemanticModel, cases: list[dict]) -> DataFrame:
    rows = [
        {"id": c["id"], "kind": c["kind"], "query_id": i, "query": c["term"], "expected": c["resolvesTo"]}
        for i, c in enumerate(cases)
    ]
    asked = small_table(
        spark, rows, "id string, kind string, query_id bigint, query string, expected string"
    )
    found = (
        resolve_terms(asked.select("query_id", "query"), term_catalog(model), TOP_K)
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("position", "target"))).alias("found"))
    )
    targets = F.col("found.target")
    return asked.join(found, "query_id", "left").select(
        "id",
        "kind",
        F.when(F.col("found").isNull(), "no match")
        .when(F.array_contains(targets, F.col("expected")), "")
        .otherwise(F.concat(F.lit("resolved to "), F.array_join(targets, ", "), F.lit(", expected "), F.col("expected")))
        .alias("detail"),
    )

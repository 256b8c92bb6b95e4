"""SQL from outside, run only when Spark's own parser and analyzer say it just reads.

Nothing is analysed before the parsed statement has passed: its plan nodes, the tables it
names and the functions it calls must all be known to read, with names spelled by
``IDENTIFIER`` put together first. What the analyzer makes of it is checked again, by the
classes of all its expressions, so a function counts by what it is and not by its name.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

#: Parsed plan nodes that only read, by class name; anything else is refused.
QUERIES = frozenset(
    """
    Aggregate Distinct Except Expand Filter Generate GlobalLimit GroupingSets Intersect Join LateralJoin LocalLimit
    LocalRelation Offset OneRowRelation PipeOperator Pivot Project Range RelationTimeTravel RepartitionByExpression Sample
    Sort SubqueryAlias Union Unpivot UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation
    UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedWith View Window
    WithWindowDefinition
    """.split()
)
#: Statements that only tell about tables; what they name or explain is checked too.
TELLING = frozenset(
    "DescribeRelation DescribeColumn DescribeFunctionCommand DescribeQueryCommand ExplainCommand ShowColumns "
    "ShowFunctions ShowTables ShowViews UnresolvedTableOrView UnresolvedNamespace CurrentNamespace".split()
)
#: Groups of Spark's built-in functions that work on their arguments alone.
GROUPS = frozenset(
    """
    agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs
    generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs
    url_funcs variant_funcs window_funcs xml_funcs
    """.split()
)
#: Functions outside those groups that only tell about the session or their argument.
HARMLESS = frozenset(
    "current_catalog current_database current_schema current_user user session_user typeof uuid version "
    "monotonically_increasing_id raise_error assert_true".split()
)
#: Spark's own expressions live here; those of UDFs, data sources and Hive do not.
EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."
#: Expressions of that package that call other code.
CALLING = frozenset(
    "ApplyFunctionExpression CallMethodViaReflection PythonUDAF PythonUDF PythonUDTF ScalaUDF TryReflect UnresolvedPolymorphicPythonUDTF V2Aggregator".split()
)
#: Table functions that make rows from their arguments alone.
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())


class NotReadOnly(ValueError):
    pass


def unfenced(text: str) -> str:
    """SQL without a surrounding Markdown code fence."""
    sql = text.strip()
    if sql.startswith("```"):
        sql = re.sub(r"^```[a-zA-Z]*\n?", "", sql)
        sql = re.sub(r"```$", "", sql)
    return sql.strip()


def split_statements(sql: str) -> list[str]:
    """Statements separated by semicolons outside of quotes and comments."""
    piece = re.compile(
        r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`"
        r"|--[^\n]*|/\*.*?\*/|;|[^;'\"`/-]+|.",
        re.S,
    )
    out = [""]
    for token in piece.findall(sql):
        if token == ";":
            out.append("")
        elif not token.startswith(("--", "/*")):
            out[-1] += token
        else:
            out[-1] += " "
    return [s.strip() for s in out if s.strip()]


def is_read_only(spark: SparkSession, text: str) -> bool:
    """True when every statement is known to do nothing but read registered tables.

    Spark's parser builds the plan. Each node of it, of every subquery, common table
    expression and expression must be of a known kind; relations must be views or tables
    of the session, not paths; functions must be built-in ones that work on their
    arguments, also where ``IDENTIFIER`` spells them. The analysed plan is then checked by
    the classes of its expressions. What registered views do inside is up to those who
    registered them.
    """
    statements = split_statements(unfenced(text))
    names = {t.name.lower() for t in spark.catalog.listTables()} if statements else set()
    return bool(statements) and all(_reads(spark, statement, names) for statement in statements)


def _items(scala) -> list:
    """The members of a Scala collection."""
    iterator, out = scala.iterator(), []
    while iterator.hasNext():
        out.append(iterator.next())
    return out


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


class _Session:
    """What Spark's session tells about names and plans."""

    def __init__(self, spark: SparkSession):
        self.spark, self.state = spark, spark._jsparkSession.sessionState()
        loader = spark.sparkContext._jvm.Thread.currentThread().getContextClassLoader()
        load = lambda name: loader.loadClass(f"org.apache.spark.sql.catalyst.{name}")
        self.plan, self.subquery = load("plans.logical.LogicalPlan"), load("expressions.PlanExpression")
        self.replaced = load("expressions.InheritAnalysisRules")

    def function(self, name: str):
        """What the registry knows of a function, or None."""
        named = self.spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)
        found = self.state.functionRegistry().lookupFunction(named)
        return found.get() if found.isDefined() else None

    def known(self, parts: list[str]) -> bool:
        """Whether a name is that of a built-in function that only works on its arguments."""
        *where, name = [p.lower() for p in parts]
        info = self.function(name) if where in ([], ["builtin"], ["system", "builtin"]) else None
        return info is not None and info.getSource() == "built-in" and (info.getGroup() in GROUPS or name in HARMLESS)

    def folded(self, e) -> str | None:
        """The text of literals put together by ``||``; None for anything else."""
        if _kind(e) == "Literal":
            return None if e.value() is None else str(e.value())
        if _kind(e) != "Concat":
            return None
        parts = [self.folded(c) for c in _items(e.children())]
        return None if None in parts else "".join(parts)

    def spelled(self, e) -> bool:
        """Whether ``IDENTIFIER(...)`` names a known function, or a column."""
        name, *arguments = _items(e.children())
        text = self.folded(name)
        if text is None:
            return False
        parts = [p.strip("`") for p in text.split(".")]
        return self.known(parts) or not arguments and self.function(parts[-1].lower()) is None and not self.spark.catalog.functionExists(text)

    def resolved(self, plan) -> bool:
        """Whether the analyzer makes nothing but Spark's own expressions of a parsed query."""
        skip = self.spark._jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()
        try:
            plans = [self.state.executePlan(plan, skip).analyzed()]
        except AnalysisException:
            return True  # it cannot run; Spark tells why
        expressions = []
        while plans or expressions:
            if expressions:
                e = expressions.pop()
                name = e.getClass().getName()
                if not name.startswith(EXPRESSIONS) or name.startswith(f"{EXPRESSIONS}objects.") or _kind(e) in CALLING:
                    return False
                if self.subquery.isInstance(e):
                    plans.append(e.plan())
                # a function that Spark replaces by others counts by its own class and its arguments
                expressions += _items(e.parameters() if self.replaced.isInstance(e) else e.children())
                continue
            node = plans.pop()
            if _kind(node) != "View":
                plans += [n for n in [*_items(node.children()), *_items(node.innerChildren())] if self.plan.isInstance(n)]
                expressions += _items(node.expressions())
        return True


def _reads(spark: SparkSession, statement: str, names: set[str]) -> bool:
    session = _Session(spark)
    try:
        root = session.state.sqlParser().parsePlan(statement)
    except ParseException:
        return False
    database = spark.catalog.currentDatabase().lower()
    plans, expressions, relations, named, queries = [root], [], [], set(names), []
    if _kind(root) in QUERIES:
        queries.append(root)
    while plans or expressions:
        if expressions:
            e = expressions.pop()
            kind = _kind(e)
            if kind == "UnresolvedFunction" and not session.known(_items(e.nameParts())):
                return False
            if kind == "UnresolvedGenerator" and not session.known([e.name().funcName()]):
                return False
            if kind == "ExpressionWithUnresolvedIdentifier" and not session.spelled(e):
                return False
            if session.subquery.isInstance(e):
                plans.append(e.plan())
            expressions += _items(e.children())
            continue
        node = plans.pop()
        kind = _kind(node)
        if kind not in QUERIES and kind not in TELLING:
            return False
        if kind in ("UnresolvedRelation", "UnresolvedTableOrView"):
            relations.append([p.lower() for p in _items(node.multipartIdentifier())])
        elif kind == "UnresolvedTableValuedFunction" and _items(node.name())[-1].lower() not in TABLE_FUNCTIONS:
            return False
        elif kind == "UnresolvedWith":
            for entry in _items(node.cteRelations()):
                named.add(entry._1().lower())
                plans.append(entry._2())
        elif kind in ("ExplainCommand", "DescribeQueryCommand"):
            told = node.logicalPlan() if kind == "ExplainCommand" else node.plan()
            plans.append(told)
            if _kind(told) in QUERIES:
                queries.append(told)
        plans += [n for n in [*_items(node.children()), *_items(node.innerChildren())] if session.plan.isInstance(n)]
        expressions += _items(node.expressions())
    if not all(r[-1] in named and (len(r) == 1 or r[-1] in names and r[:-1] in ([database], ["spark_catalog", database])) for r in relations):
        return False
    return all(session.resolved(query) for query in queries)


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    """The result of one read-only statement over the registered views."""
    if not is_read_only(spark, text):
        raise NotReadOnly("Only read-only statements (SELECT, WITH, SHOW, DESCRIBE, EXPLAIN) are run.")
    result = None
    for statement in split_statements(unfenced(text)):
        result = spark.sql(statement)
    return result

"""A guard for read-only SQL over views with allowed columns only.

The allowed tables are narrowed to their allowed columns and put, under their own names, into a session of the
guard's. A statement is parsed, analysed and run there: what the narrowed views do not have does not exist for it,
whatever its form. The analysed plan may have relational nodes of a fixed list only, so that a statement can neither start
a program nor call a table function; its leaves are the guard's own temporary views, by their full names, and constants; and no function
reaches beyond its rows. The caller's session and its views are never touched.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

# fixed values: tokens that are refused outside literals
FORBIDDEN = [
    "INFORMATION_SCHEMA", "PG_CATALOG", "PG_STAT", "PG_CLASS", "PG_ROLES", "PG_SLEEP", "PG_READ_FILE", "PG_WRITE_FILE", "WAITFOR", "BENCHMARK(", "DBMS_", "UTL_HTTP", "LOAD_FILE", "OUTFILE",
]
#: expressions that reach beyond a row, by class name; besides these only the engine's own are let through
BEYOND_ROWS = [
    "CallMethodViaReflection", "TryReflect", "InputFileName", "InputFileBlockStart", "InputFileBlockLength", "CurrentUser", "SessionUser", "CurrentDatabase", "CurrentCatalog", "SparkVersion",
    "ScalaUDF", "PythonUDF", "PythonUDAF", "PythonUDTF", "UnresolvedPolymorphicPythonUDTF", "ScalaUDAF", "ScalaAggregator", "SQLKeywords", "Collations", "SQLFunctionExpression", "SQLScalarFunction",
]
#: nodes of an analysed plan that are let through, by name; what is not here, say a program that rows are sent through, is refused
RELATIONAL = [
    "Project", "Filter", "Join", "LateralJoin", "Aggregate", "Window", "Sort", "Distinct", "Deduplicate", "Union", "Expand", "GlobalLimit", "LocalLimit", "Offset", "SubqueryAlias",
    "Subquery", "WithCTE", "CTERelationDef", "UnionLoop", "ResolvedHint", "RepartitionByExpression", "Sample", "AsOfJoin",
]
#: generators that unfold a row's own values
GENERATORS = ["Explode", "PosExplode", "Inline", "Stack", "JsonTuple", "GeneratorOuter", "VariantExplode"]
_OWN = ("org.apache.spark.sql.catalyst.", "org.apache.spark.sql.internal.")
_LEAVES = ["OneRowRelation", "LocalRelation", "CTERelationRef", "UnionLoopRef"]
_LITERAL = r"'(?:''|[^'])*'|\"(?:\\.|[^\"\\])*\"|`[^`]*`"
_DML = ("Insert", "Update", "Delete", "Merge", "Truncate")
_PROCEDURE = ("Call", "Set", "CompoundBody", "ExecuteImmediate")
_DDL = ("Create", "Drop", "Alter", "Replace", "Cache", "Uncache", "Refresh", "Show", "Use", "Rename", "Add", "Repair", "Analyze", "Load")
ROW_CAP = 1000


class Refused(ValueError):
    """A statement that the guard does not let through: ``code`` and ``detail``."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}")
        self.code, self.detail = code, detail


def _each(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _nodes(plan, below_views: bool = True) -> Iterator:
    """A plan's nodes, with common table expressions and the plans of subqueries."""
    yield plan
    if not below_views and plan.nodeName() == "View":
        return
    inner = [x for x in _each(plan.innerChildren()) if plan.nodeName() == "UnresolvedWith" and hasattr(x, "nodeName")]
    for x in [*_each(plan.children()), *inner, *_each(plan.subqueries())]:
        yield from _nodes(x, below_views)


def _expressions(expression) -> Iterator:
    yield expression
    for x in _each(expression.children()):
        yield from _expressions(x)


def _parsed(guard: SparkSession, sql: str | None) -> str:
    """The one statement of a text, after the lexical checks and those of its parsed form."""
    if not sql or not sql.strip():
        raise Refused("EMPTY")
    bare = re.sub(_LITERAL, " ", sql)
    if "--" in bare or "/*" in bare:
        raise Refused("COMMENT_DENIED")
    if any(t in bare.upper() for t in FORBIDDEN):
        raise Refused("SYSTEM_SCHEMA_DENIED")
    if ";" in bare.strip().rstrip(";").strip():
        raise Refused("MULTI_STATEMENT")
    if re.match(r"(?i)\s*copy\b", bare):
        raise Refused("COPY_DENIED")
    one = sql.strip().rstrip(";").strip()
    try:
        names = [n.nodeName() for n in _nodes(guard._jsparkSession.sessionState().sqlParser().parsePlan(one))]
    except ParseException:
        raise Refused("PARSE_FAIL") from None
    except Exception as e:  # the parser's errors come through the gateway in several classes
        if "Parse" not in str(e):
            raise
        raise Refused("PARSE_FAIL") from None
    top = names[0]
    if "Explain" in top or "Describe" in top:
        raise Refused("EXPLAIN_DENIED", top)
    if top.startswith(_DML):
        raise Refused("DML_DENIED", top)
    if top.startswith(_PROCEDURE):
        raise Refused("PROCEDURAL_DENIED", top)
    if "Command" in top or top.startswith(_DDL):
        raise Refused("DDL_DENIED", top)
    if any(n.startswith(("Intersect", "Except")) for n in names):
        raise Refused("DDL_DENIED", "set operation")
    return one


def _top_limit(plan) -> int | None:
    """The number of rows that the outermost LIMIT of an analysed statement lets through."""
    while True:
        name = plan.nodeName()
        if name == "GlobalLimit":
            return int(plan.limitExpr().eval(None))
        if name == "WithCTE":
            plan = list(_each(plan.children()))[-1]
        elif name in ("Offset", "LocalLimit"):
            plan = plan.child()
        else:
            return None


def _let_through(node, names: set[str]) -> None:
    """Refuses a node that is no view of the guard's own, no constant and none of the relational ones."""
    name = node.nodeName()
    if name == "View":
        view = node.desc().identifier()
        if not node.isTempView() or view.database().isDefined() or view.table().lower() not in names:  # a global view has a database
            raise Refused("TABLE_NOT_ALLOWED", view.unquotedString())
    elif name == "Generate":
        generator = node.generator().getClass().getSimpleName()
        if generator not in GENERATORS:
            raise Refused("SYSTEM_SCHEMA_DENIED", generator)
    elif not node.children().size():
        if name not in _LEAVES:
            raise Refused("TABLE_NOT_ALLOWED", name)
    elif name not in RELATIONAL:
        raise Refused("PROCEDURAL_DENIED", name)


def _guarded(spark: SparkSession, sql: str | None, allowed: dict[str, list[str]], cap: int) -> DataFrame:
    """The statement's rows from the guard's session, or Refused."""
    guard = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            guard.conf.set(key, value)
    one = _parsed(guard, sql)
    passed = []
    try:
        for name, columns in allowed.items():
            if spark.catalog.tableExists(name):
                table, low = spark.table(name), {c.lower() for c in columns}
                passed.append(f"guard_{uuid.uuid4().hex}")
                table.select(*[f"`{c}`" for c in table.columns if c.lower() in low]).createGlobalTempView(passed[-1])
                guard.sql(f"CREATE TEMPORARY VIEW `{name}` AS SELECT * FROM global_temp.{passed[-1]}")
        try:
            df = guard.sql(one)
            plan = df._jdf.queryExecution().analyzed()
        except AnalysisException as e:
            code = e.getCondition() or ""
            if "TABLE_OR_VIEW" in code:
                raise Refused("TABLE_NOT_ALLOWED", code) from None
            if "ROUTINE" in code:
                raise Refused("SYSTEM_SCHEMA_DENIED", code) from None
            raise Refused("COLUMN_NOT_ALLOWED" if "COLUMN" in code else "PARSE_FAIL", code) from None
        names = {n.lower() for n in allowed}
        for node in _nodes(plan, below_views=False):
            _let_through(node, names)
            for root in _each(node.expressions()):
                for x in _expressions(root):
                    kind = x.getClass().getName()
                    if kind.split(".")[-1].rstrip("$") in BEYOND_ROWS or not kind.startswith(_OWN):
                        raise Refused("SYSTEM_SCHEMA_DENIED", kind.split(".")[-1])
        limit = _top_limit(plan)
    finally:
        for name in passed:
            spark.catalog.dropGlobalTempView(name)
    if limit is not None and limit > cap:
        raise Refused("ROW_CAP_EXCEEDED", str(limit))
    return df if limit is not None else df.limit(cap)


def check(spark: SparkSession, sql: str | None, allowed: dict[str, list[str]], cap: int = ROW_CAP) -> tuple[str, str]:
    """(code, detail) for a statement over the views ``allowed`` (name to columns); code OK lets it through.

    Columns are checked by resolution: stars, aliases, joined tables, subqueries, common table expressions and union
    branches see the allowed ones only.
    """
    try:
        _guarded(spark, sql, allowed, cap)
    except Refused as e:
        return e.code, e.detail
    return "OK", ""


def query(spark: SparkSession, sql: str, allowed: dict[str, list[str]], cap: int = ROW_CAP) -> DataFrame:
    """Runs a statement that the guard lets through, with the row cap where it has no limit of its own."""
    return _guarded(spark, sql, allowed, cap)

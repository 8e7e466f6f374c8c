"""Bounded, read-only SQL: admission by the parsed plan, row, cell and output budgets, a time limit and recovery hints."""

from __future__ import annotations

import json
import math
import re
import threading
import time
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from runledger.sources.dialect import rewrite

MOST_SQL_BYTES = 1 << 20
ROW_LIMIT, CELL_BYTES, OUTPUT_BYTES, TIMEOUT_S = 1000, 65_536, 65_536, 30.0
#: Functions that reach outside the data.
REFUSED_FUNCTIONS = {"reflect", "java_method", "try_reflect", "load_extension", "input_file_name", "read_files", "from_avro", "raise_error", "python_worker_logs"}
#: Logical nodes that read nothing but relations by name, or combine queries.
_COMMAND = re.compile(
    r"Command|InsertInto|CreateTable|DropTable|DropView|SetCatalog|Truncate|Alter|MergeInto|DeleteFrom|UpdateTable|ScriptTransform|ShowTables|ShowCreate|Describe|Explain|Analyze|Refresh|Cache|Repair|LoadData|Use|ExecuteImmediate|CompoundBody|SetVariable|CreateVariable|ReplaceTable|CreateView|CreateFunction|CreateNamespace|Comment|Call"
)


class QueryError(ValueError):
    """A query that isn't admitted or failed; `hint` says what to try."""

    def __init__(self, message: str, hint: str | None = None):
        super().__init__(message)
        self.hint = hint


@dataclass
class Report:
    """Rows with their columns in alphabetical order, and what bounded them."""

    rows: list[dict[str, Any]] = field(default_factory=list)
    complete: bool = True
    limit_reason: str | None = None
    cells_truncated: int = 0
    output_bytes: int = 0
    hint: str | None = None

    def as_json(self) -> str:
        body = {"rows": self.rows, "row_count": len(self.rows), "complete": self.complete, "cells_truncated": self.cells_truncated}
        if self.limit_reason:
            body |= {"limit_reason": self.limit_reason, "hint": self.hint}
        return json.dumps({"data": body}, ensure_ascii=False, separators=(",", ":"))


def _nodes(plan) -> list:
    """All logical nodes of a parsed plan, with those inside subqueries and common table expressions."""
    todo, out = [plan], []
    while todo:
        node = todo.pop()
        out.append(node)
        for children in (node.children(), node.innerChildren()):
            todo += [children.apply(i) for i in range(children.size()) if hasattr(children.apply(i), "children") and "logical" in children.apply(i).getClass().getName().lower() or "Unresolved" in children.apply(i).getClass().getSimpleName()]
        expressions = node.expressions()
        for i in range(expressions.size()):
            found = [expressions.apply(i)]
            while found:
                e = found.pop()
                out.append(e)
                if "Subquery" in e.getClass().getSimpleName() or e.getClass().getSimpleName() in ("Exists", "ListQuery", "LateralSubquery"):
                    todo.append(e.plan())
                inner = e.children()
                found += [inner.apply(k) for k in range(inner.size())]
    return out


def admit(spark: SparkSession, sql: str, relations: set[str] | None = None) -> str:
    """The SQL to run, or QueryError unless it is one query over named relations.

    The parsed plan decides, not the text: commands, writes, files as relations (two-part names), script transforms and
    functions that reach outside are refused. With `relations`, other names than those and the query's own are refused.
    """
    if len(sql.encode()) > MOST_SQL_BYTES:
        raise QueryError("the statement is longer than 1 MiB", "send a shorter statement")
    try:
        text = rewrite(sql).strip().rstrip(";")
    except ValueError as error:
        raise QueryError(str(error), "give a longer literal, or filter blobs.text with instr") from None
    if not text:
        raise QueryError("no statement", "send one SELECT")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as error:  # the parser's exceptions are many
        raise QueryError(f"not valid SQL: {str(error).splitlines()[0]}", "a literal \\n outside quotes isn't a line end; send one statement") from None
    own: set[str] = set()
    nodes = _nodes(plan)
    for node in nodes:
        if node.getClass().getSimpleName() == "UnresolvedWith":
            ctes = node.cteRelations()
            for i in range(ctes.size()):
                entry = ctes.apply(i)
                own.add(entry._1().lower())
                nodes += _nodes(entry._2())
    for node in nodes:
        kind = node.getClass().getSimpleName()
        if _COMMAND.search(kind) and not kind.startswith(("Unresolved", "With", "SubqueryAlias")):
            raise QueryError("only queries are allowed", "send a SELECT; writes and commands are refused")
        if kind == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            name = parts.apply(0).lower()
            if parts.size() != 1:
                raise QueryError("relations are named by one word", "files and catalogs can't be read")
            if relations is not None and name not in relations | own:
                raise QueryError(f"no relation {name}", f"relations: {', '.join(sorted(relations))}")
        if kind == "UnresolvedTableValuedFunction" or kind == "UnresolvedFunction":
            parts = node.name() if kind.endswith("ValuedFunction") else node.nameParts()
            names = [parts.apply(i).lower() for i in range(parts.size())]
            if REFUSED_FUNCTIONS.intersection(names):
                raise QueryError(f"function {names[-1]} is not allowed", "use functions over the query's own values")
    return text


def prepare(spark: SparkSession, sql: str, relations: set[str] | None = None) -> DataFrame:
    """The admitted query as a DataFrame with distinct column names."""
    text = admit(spark, sql, relations)
    try:
        df = spark.sql(text)
    except Exception as error:
        raise QueryError(str(error).splitlines()[0], "list the relations and their columns, then correct the names") from None
    if len(set(df.columns)) != len(df.columns):
        raise QueryError("two columns have one name", "give every column its own alias")
    return df


def cell(value: Any, most: int) -> tuple[Any, bool]:
    """(JSON value, cut): texts are cut at a character's end, binaries become hexadecimal objects."""
    if isinstance(value, str):
        data = value.encode("utf-8", "surrogatepass")
        return (value, False) if len(data) <= most else (data[:most].decode("utf-8", "ignore"), True)
    if isinstance(value, (bytes, bytearray)):
        cut = len(value) > most // 2
        return {"type": "blob", "bytes": len(value), "hex": bytes(value[: most // 2]).hex()}, cut
    if isinstance(value, float) and not math.isfinite(value):
        return None, False
    if value is None or isinstance(value, (bool, int, float)):
        return value, False
    if hasattr(value, "asDict"):
        value = value.asDict(recursive=True)
    return cell(value if isinstance(value, str) else json.dumps(value, default=str, ensure_ascii=False, separators=(",", ":")), most)


def run(spark: SparkSession, sql: str, relations: set[str] | None = None, row_limit: int = ROW_LIMIT, cell_bytes: int = CELL_BYTES, output_bytes: int = OUTPUT_BYTES, timeout_s: float = TIMEOUT_S) -> Report:
    """Runs one admitted query within its budgets.

    One row more than the limit is fetched to tell a full result from a cut one. The job is cancelled at the time limit.
    """
    df = prepare(spark, sql, relations).limit(row_limit + 1)
    names, report = sorted(df.columns), Report()
    tag, late = f"query-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout_s, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    began = time.monotonic()
    try:
        for row in df.toLocalIterator():
            if late.is_set():
                raise QueryError("timeout")
            if len(report.rows) == row_limit:
                report.complete, report.limit_reason, report.hint = False, "row_limit", "aggregate, narrow the scope, or go on from an ordered boundary"
                break
            out = {}
            cut = 0
            for name in names:
                out[name], short = cell(row[name], cell_bytes)
                cut += short
            size = len(json.dumps(out, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")) + 1
            if report.output_bytes + size > output_bytes:
                report.complete, report.limit_reason, report.hint = False, "output_budget", "select fewer columns or shorter texts"
                break
            report.rows.append(out)
            report.output_bytes += size
            report.cells_truncated += cut
    except QueryError:
        raise QueryError(f"the query took more than {timeout_s:g} s", "filter by session, role or time before reading texts") from None
    except Exception as error:
        if late.is_set() or time.monotonic() - began >= timeout_s:
            raise QueryError(f"the query took more than {timeout_s:g} s", "filter by session, role or time before reading texts") from None
        raise QueryError(str(error).splitlines()[0], None) from None
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)
    return report

"""Checks over tables: free SQL, counts, fields; dispatch by kind; validation of definitions.

Check definitions are configuration: they are streamed to the driver in batches to build plans.
Data rows never are. Per table and batch there is one scan, whatever the number of checks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from soundcheck.functions.scalars import utc
from soundcheck.functions.text import blank_to, quote_ident, trim_space
from soundcheck.operators.expect import evaluate_expectations
from soundcheck.operators.registry import Snapshot, check_kinds, register_check_kind
from soundcheck.operators.views import SnapshotSession, subject
from soundcheck.plans.sizing import batches, broadcast_if_small, hold
from soundcheck.session import materialise
from soundcheck.schemas import CHECK_FIELDS, CHECKS, RESULT_FIELDS, RESULTS

FUSED = 200  # checks fused into one aggregation or one row of subqueries


def checks_table(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """Check definitions from dictionaries; ``check_id`` and ``ord`` default to the position."""
    made = []
    for i, row in enumerate(rows):
        unknown = set(row) - set(CHECK_FIELDS)
        if unknown:
            raise ValueError(f"unknown check field(s): {', '.join(sorted(unknown))}")
        row = {"check_id": f"c{i:04d}", "ord": i, **row}
        for number in ("expect_min", "expect_max"):
            if row.get(number) is not None:
                row[number] = float(row[number])
        made.append(tuple(row.get(f) for f in CHECK_FIELDS))
    return spark.createDataFrame(made, CHECKS)


def default_checks(checks: DataFrame) -> DataFrame:
    """Blank severity means required, blank kind means sql."""
    return checks.withColumns({"severity": blank_to("severity", "required"), "kind": blank_to("kind", "sql")})


def results(df: DataFrame) -> DataFrame:
    """Project evaluated checks to the columns of a check result."""
    for name in ("got", "detail", "error"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    if "got_num" not in df.columns:
        df = df.withColumns({"got_num": F.lit(None).cast("double"), "got_ts": F.lit(None).cast("timestamp")})
    return df.select(*RESULT_FIELDS)


def _told(error: Exception) -> str:
    """What went wrong, without the trace: the innermost condition that Spark names, if any."""
    text = (error.getMessage() if isinstance(error, PySparkException) and error.getMessage() else str(error)).strip()
    named = re.findall(r"(?m)^.*?(\[[A-Z][A-Z0-9_.]+\] .*)$", text) if "\tat " in text else []
    return named[-1].strip() if named else text


def _with_subjects(spark, checks: Sequence[Row], got: dict[str, str], errors: dict[str, str]) -> DataFrame:
    schema = T.StructType([*T._parse_datatype_string(CHECKS).fields,
                           T.StructField("got", T.StringType()), T.StructField("error", T.StringType())])
    rows = [tuple(c[f] for f in CHECK_FIELDS) + (got.get(c["check_id"], ""), errors.get(c["check_id"]))
            for c in checks]
    return spark.createDataFrame(rows, schema)


def _union(parts: list[DataFrame], spark, empty: str) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], empty)
    return reduce(DataFrame.unionByName, parts)


# -- sql ---------------------------------------------------------------------------------------

_PLACE = re.compile(r"== SQL \(line ([0-9]+), position [0-9]+\) ==")


class _Joint:
    """Queries as one row of subqueries. What fails at run time is told apart without running every query again.

    Spark says at which line of the text an expression failed, so that query is run alone and the others
    once more: two scans for a failing check. Where it does not say (a file that cannot be read), the halves
    are run, and good halves are kept.
    """

    def __init__(self, session: SparkSession):
        self.session, self.got, self.errors, self.runs = session, {}, {}, 0

    def run(self, queries: list[tuple[str, str, str]]) -> None:
        """(check_id, query, type of its value) each."""
        if not queries:
            return
        shown = [f"CAST({_utc(f'(\n{q}\n)', kind)} AS STRING) AS c{i}" for i, (_, q, kind) in enumerate(queries)]
        self.runs += 1
        try:
            row = self.session.sql("SELECT " + ",\n".join(shown)).first()
        except Exception as error:  # noqa: BLE001 - any failure of a check is its result
            self.settle(queries, shown, error)
        else:
            self.got.update({cid: row[i] or "" for i, (cid, _, _) in enumerate(queries)})

    def settle(self, queries: list[tuple[str, str, str]], shown: list[str], error: Exception) -> None:
        if len(queries) == 1:
            many = "SCALAR_SUBQUERY_TOO_MANY_ROWS" in str(error)
            self.errors[queries[0][0]] = "expected one row, one column" if many else _told(error)
            return
        place, line = _PLACE.search(str(error)), 1
        for i, text in enumerate(shown if place else ()):
            line += text.count("\n") + 1
            if int(place[1]) < line:
                self.run([queries[i]])
                self.run(queries[:i] + queries[i + 1:])
                return
        half = len(queries) // 2
        self.run(queries[:half])
        self.run(queries[half:])


def _utc(value: str, kind: str) -> str:
    """A time with zone as its UTC reading, so that its text does not depend on the session."""
    return f"timestampadd(MICROSECOND, unix_micros({value}), TIMESTAMP_NTZ '1970-01-01')" if kind == "timestamp" else value


def sql_checks(spark: SparkSession, checks: DataFrame, snapshot: Snapshot | None = None, as_of=None) -> DataFrame:
    """Run each check's SQL and evaluate its one value, trimmed; SQL NULL reads as empty text.

    A check sees the tables of ``snapshot`` and those in which it describes itself, and nothing else: its
    SQL runs unchanged in a session whose catalog holds them. A table that the snapshot lacks is an error
    row, also where the caller's session or a database has one of that name. Only queries run. Times are
    read and shown in UTC. The queries of a batch become scalar subqueries of one row, so Spark runs them
    in one job and merges equal scans. A query that does not analyse marks only its own row. Without a
    snapshot, names mean what they mean in the session.
    """
    if snapshot is None:
        return _evaluated(spark, checks, as_of, spark, lambda q: (q, spark.sql(subject(q)).schema[0].dataType.simpleString()), lambda q: set())
    with SnapshotSession(spark, snapshot) as own:
        return _evaluated(spark, checks, as_of, own.session, own.analyse, own.foreign)


def _evaluated(spark, checks: DataFrame, as_of, session, analyse, foreign) -> DataFrame:
    parts = []
    for batch in batches(checks.select(*CHECK_FIELDS), FUSED):
        joint, good = _Joint(session), []
        for c in batch:
            try:
                good.append((c["check_id"], *analyse((c["sql"] or "").strip().rstrip(";"))))
            except Exception as error:  # noqa: BLE001 - any failure of a check is its result
                several = "RETURN_MORE_THAN_ONE_OUTPUT_COLUMN" in str(error)
                joint.errors[c["check_id"]] = "expected one row, one column" if several else _told(error)
        if good and foreign("SELECT " + ", ".join(f"(\n{q}\n)" for _, q, _ in good)):  # seldom, so only then one by one
            outside = {cid: names for cid, q, _ in good if (names := foreign(subject(q)))}
            joint.errors.update({cid: f"the snapshot has no table {sorted(names)[0]}" for cid, names in outside.items()})
            good = [g for g in good if g[0] not in outside]
        joint.run(good)
        subjects = _with_subjects(spark, batch, joint.got, joint.errors).withColumn("got", trim_space("got"))
        parts.append(results(evaluate_expectations(subjects, as_of)))
    return _union(parts, spark, RESULTS)


# -- counts and fields ---------------------------------------------------------------------------

def json_filter_to_expr(text: str | None, df: DataFrame | None = None) -> Column:
    """An equality document such as ``{"a": 1, "b.c": "x"}`` as a predicate; blank or ``{}`` is true."""
    if not (text or "").strip():
        return F.lit(True)
    doc = json.loads(text)
    if not isinstance(doc, dict):
        raise ValueError("filter must be a JSON object")
    terms = []
    for key, value in doc.items():
        if key.startswith("$") or isinstance(value, (dict, list)):
            raise ValueError(f"unsupported filter operator at {key!r}: only equality is supported")
        column = F.col(".".join(quote_ident(p) for p in key.split(".")))
        terms.append(column.isNull() if value is None else column == F.lit(value))
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def filter_expr(text: str | None) -> Column:
    """A filter given as a JSON equality document or as a SQL predicate."""
    return json_filter_to_expr(text) if not (text or "").strip() or text.strip().startswith("{") else F.expr(text)


def _by_table(batch, snapshot, problem) -> tuple[dict[str, list], dict[str, str]]:
    """Group checks by table; a check that does not analyse gets an error instead."""
    grouped: dict[str, list] = {}
    errors: dict[str, str] = {}
    for c in batch:
        try:
            why = problem(c)
            if why:
                raise ValueError(why)
            if c["table_name"] not in snapshot.tables:
                raise ValueError(f"table {c['table_name']!r} not found")
            snapshot.tables[c["table_name"]].filter(filter_expr(c["filter"]))  # analyses only
            grouped.setdefault(c["table_name"], []).append(c)
        except Exception as error:  # noqa: BLE001
            errors[c["check_id"]] = _told(error)
    return grouped, errors


def _stacked(df: DataFrame, aggs: list[Column], ids: list[str]) -> DataFrame:
    """One aggregation over one scan, then one row per check: check_id, v struct."""
    row = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(cid).alias("check_id"), F.col(f"a{i}").alias("v")) for i, cid in enumerate(ids)
    ])).alias("s")).select("s.check_id", "s.v")


def _subjects(spark, batch, errors, measured: list[DataFrame], got: Column, error: Column) -> DataFrame:
    defs = _with_subjects(spark, batch, {}, errors).withColumnRenamed("error", "_early").drop("got")
    if not measured:
        return defs.withColumn("got", F.lit("")).withColumnRenamed("_early", "error")
    m = reduce(DataFrame.unionByName, measured)
    # ``defs`` is one batch of at most FUSED rows, and ``m`` has one row per check.
    return defs.join(m, "check_id", "left").withColumns({
        "got": F.coalesce(got, F.lit("")), "error": F.coalesce(F.col("_early"), error)}).drop("_early", "v")


def count_checks(spark: SparkSession, checks: DataFrame, snapshot: Snapshot, as_of=None) -> DataFrame:
    """Rows of a table that match a filter, all checks of a table in one aggregation."""
    parts = []
    for batch in batches(checks.select(*CHECK_FIELDS), FUSED):
        grouped, errors = _by_table(batch, snapshot, lambda c: None if c["table_name"] else
                                    "there is no table to count")
        measured = [
            _stacked(snapshot.tables[t], [F.count_if(filter_expr(c["filter"])) for c in cs],
                     [c["check_id"] for c in cs])
            for t, cs in grouped.items()
        ]
        subjects = _subjects(spark, batch, errors, measured, F.col("v").cast("string"), F.lit(None).cast("string"))
        parts.append(results(evaluate_expectations(
            subjects, as_of, "the count is compared with nothing")))
    return _union(parts, spark, RESULTS)


def _field_text(df: DataFrame, path: str) -> Column | None:
    """A dotted field as text (times as ISO-8601); None when the schema has no such field."""
    try:
        col = F.col(".".join(quote_ident(p) for p in path.split(".") if p))
        kind = df.select(col).schema[0].dataType
    except Exception:  # noqa: BLE001
        head, _, rest = path.partition(".")
        if head in df.columns and isinstance(df.schema[head].dataType, T.VariantType) and rest:
            return F.try_variant_get(F.col(quote_ident(head)), F.lit("$." + rest), "string")  # null where absent
        return None
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        wall = (col if isinstance(kind, T.TimestampNTZType) else utc(col)).cast("string")  # neither depends on the session
        return F.when(col.isNotNull(), F.concat(F.translate(F.left(wall, F.lit(19)), " ", "T"), F.lit("."),
                                                F.rpad(F.substring(wall, 21, 3), 3, "0"), F.lit("Z")))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.regexp_replace(col.cast("string"), r"\.0\z", "")
    return col.cast("string")


def _present(df: DataFrame, path: str) -> Column:
    """Whether the row has the field: always for a column, by its path inside a VARIANT, where JSON null is present."""
    head, _, rest = path.partition(".")
    if rest and head in df.columns and isinstance(df.schema[head].dataType, T.VariantType):
        return F.try_variant_get(F.col(quote_ident(head)), F.lit("$." + rest), "variant").isNotNull()
    return F.lit(True)


def field_checks(spark: SparkSession, checks: DataFrame, snapshot: Snapshot, as_of=None) -> DataFrame:
    """A field of the first matching row by ``order_by``, as text, in one aggregation per table.

    No matching row and a field that is not there are two distinct errors.
    """
    parts = []
    for batch in batches(checks.select(*CHECK_FIELDS), FUSED):
        grouped, errors = _by_table(batch, snapshot, lambda c: None if c["table_name"] and c["filter"] and c["field"]
                                    and c["order_by"] else "table, filter, field and order_by must all be given")
        measured = []
        for t, cs in grouped.items():
            df = snapshot.tables[t]
            aggs = []
            for c in cs:
                text = _field_text(df, c["field"])
                present = _present(df, c["field"]) if text is not None else F.lit(False)
                hit = F.struct((text if text is not None else F.lit(None).cast("string")).alias("t"),
                               present.alias("p"))
                keep = filter_expr(c["filter"])
                order = F.struct(*[F.col(quote_ident(o.strip())) for o in c["order_by"].split(",")])
                aggs.append(F.min_by(hit, F.when(keep, order)))
            measured.append(_stacked(df, aggs, [c["check_id"] for c in cs]))
        got = F.coalesce(F.col("v.t"), F.when(F.col("v.p"), F.lit("null")))
        error = (F.when(F.col("v").isNull(), F.concat(F.lit("none of the rows fits "), F.col("filter")))
                 .when(~F.col("v.p"), F.concat(F.lit("the row has no "), F.col("field"))))
        subjects = _subjects(spark, batch, errors, measured, got, error)
        parts.append(results(evaluate_expectations(
            subjects, as_of, "the field is compared with nothing")))
    return _union(parts, spark, RESULTS)


register_check_kind("sql", sql_checks)
register_check_kind("count", count_checks)
register_check_kind("field", field_checks)


# -- dispatch ------------------------------------------------------------------------------------

def unknown_kinds(checks: DataFrame) -> DataFrame:
    """A failing row for every check whose kind no evaluator is registered for."""
    known = list(check_kinds())
    return results(
        checks.filter(~F.col("kind").isin(known))
        .withColumns({"ok": F.lit(False), "got": F.lit("").cast("string"),
                      "error": F.concat(F.lit('unknown check kind "'), F.col("kind"), F.lit('"'))}))


def run_checks(spark: SparkSession, checks: DataFrame, snapshot: Snapshot, as_of=None) -> DataFrame:
    """Evaluate all checks: one result per check, in definition order, severity carried.

    Every kind runs as one plan. If a plan fails at run time, its checks are halved until the failing ones
    are alone; halves that succeed are kept, so one failing check costs about twice log2 of its number in plans.
    """
    checks = hold(default_checks(checks).select(*CHECK_FIELDS))  # definitions may come from a costly discovery
    present = {r["kind"] for r in checks.select("kind").distinct().collect()}
    parts = [unknown_kinds(checks)]

    def run(fn, mine: DataFrame, halve: bool) -> None:
        try:
            parts.append(materialise(fn(spark, mine, snapshot, as_of), "results"))
        except Exception as error:  # noqa: BLE001 - any failure of a check is its result
            for batch in batches(mine, FUSED) if halve else ():
                for half in (batch[:len(batch) // 2], batch[len(batch) // 2:]):
                    if half:
                        run(fn, spark.createDataFrame(half, CHECKS), len(half) > 1)
            if not halve:
                parts.append(results(mine.withColumns({"ok": F.lit(False), "got": F.lit(""), "error": F.lit(_told(error))})))

    for kind, fn in check_kinds().items():
        if kind in present:
            run(fn, checks.filter(F.col("kind") == kind), True)
    return _union(parts, spark, RESULTS).orderBy("ord")


# -- validation ----------------------------------------------------------------------------------

# Which capability a kind needs, and the built-in target types that have it.
KIND_CAPABILITY = {"file_exists": "file-probe", "file_count": "file-probe", "checksum": "file-probe",
                   "exit": "file-probe", "response": "http-probe", "count": "document", "field": "document",
                   "sql": None}


def validate_checks(checks: DataFrame, target_type: Column | str, capabilities: DataFrame,
                    kinds: Sequence[str] = tuple(KIND_CAPABILITY)) -> DataFrame:
    """One row per violated rule: check_id, ord, name, rule_no, violation, is_first.

    ``capabilities`` lists (target_type, capability). ``target_type`` is a column or a constant.
    """
    target = F.lit(target_type) if isinstance(target_type, str) else target_type
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    has = lambda c: F.col(c).isNotNull()
    kind = blank_to("kind", "sql")
    bounds = has("expect_min") | has("expect_max")
    expectations = (bounds.cast("int") + has("equals").cast("int") + has("max_age_s").cast("int")
                    + has("bool").cast("int"))
    needed = F.create_map(*[F.lit(x) for k, v in KIND_CAPABILITY.items() if v for x in (k, v)])
    rules = [
        (blank("name"), F.lit("a check without a name")),
        (~blank("severity") & ~F.col("severity").isin("required", "advisory"),
         F.concat(F.lit("no such severity: "), F.col("severity"))),
        (F.coalesce(F.col("keep_literal"), F.lit(False)) & ~has("equals"),
         F.lit("keep_literal is set, but there is no equals whose text could be kept")),
        (~kind.isin(list(kinds)), F.concat(F.lit("nobody evaluates the kind "), kind)),
        (F.col("_capability").isNotNull() & F.col("_have").isNull(),
         F.concat(F.lit("the target type offers no "), F.col("_capability"), F.lit(", which "), kind, F.lit(" uses"))),
        ((kind == "sql") & blank("sql"), F.lit("there is no sql to run")),
        ((kind == "sql") & (expectations == 0), F.lit("the value is compared with nothing")),
        ((kind == "sql") & (expectations > 1), F.lit("the value is compared with several things")),
        (kind.isin("file_exists", "file_count", "checksum") & blank("path"), F.lit("there is no path to look at")),
        ((kind == "checksum") & ~has("equals"), F.lit("there is no digest to compare with")),
        ((kind == "file_count") & ~bounds, F.lit("the count has no bound")),
        ((kind == "exit") & blank("capture"), F.lit("there is no capture to read")),
        ((kind == "response") & blank("url"), F.lit("there is no url to look up")),
        (kind.isin("count", "field") & blank("table_name"), F.lit("there is no table to read")),
        ((kind == "field") & blank("filter"), F.lit("nothing says which row counts")),
        ((kind == "field") & blank("field"), F.lit("nothing says which field counts")),
        ((kind == "count") & ~bounds & ~has("equals"), F.lit("the count is compared with nothing")),
        ((kind == "field") & ~bounds & ~has("equals") & ~has("max_age_s"),
         F.lit("the field is compared with nothing")),
    ]
    caps = broadcast_if_small(capabilities.select(
        F.col("target_type").alias("_t"), F.col("capability").alias("_have")).distinct())
    found = F.filter(
        F.array(*[F.struct(F.lit(i + 1).alias("rule_no"), F.when(cond, text).alias("violation"))
                  for i, (cond, text) in enumerate(rules)]),
        lambda r: r["violation"].isNotNull())
    return (
        checks.withColumn("_target", target)
        .withColumn("_capability", F.try_element_at(needed, kind))
        .join(caps, (F.col("_target") == F.col("_t")) & (F.col("_capability") == F.col("_have")), "left")
        .withColumn("_found", found)
        .select("check_id", "ord", "name", F.posexplode_outer("_found").alias("_i", "_v")).filter("_v IS NOT NULL")
        .select("check_id", "ord", "name", "_v.rule_no", "_v.violation", (F.col("_i") == 0).alias("is_first"))
    )

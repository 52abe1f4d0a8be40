"""A session of its own for each snapshot, whose catalog holds its tables and what it says of itself.

Checks are SQL that names tables. They run unchanged in a child session in which those names are the
snapshot's tables, shared with the child as global views that live as long as the run. Times are
read and shown in UTC there, whatever the zone of the caller's session.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from soundcheck.functions.text import quote_ident
from soundcheck.operators.registry import Snapshot

# Schemas that hold no user tables.
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema", "_timescaledb_internal", "_timescaledb_catalog",
                  "_timescaledb_config", "_timescaledb_cache")
# Reserved names: tables in which a snapshot describes itself.
TABLES_VIEW, PARTITIONS_VIEW, COMPONENTS_VIEW = "snapshot_tables", "snapshot_partitions", "snapshot_components"
OWN_VIEWS = (TABLES_VIEW, PARTITIONS_VIEW, COMPONENTS_VIEW)

_PART = r"(?:`(?:[^`]|``)*`|[^`\s.,()]+)"
_QUALIFIED = re.compile(rf"^[ :+-]*SubqueryAlias ({_PART}(?:\.{_PART})+)\s*$", re.M)


def split_name(table: str) -> tuple[str, str]:
    schema, _, name = table.rpartition(".")
    return schema, name


def user_tables(snapshot: Snapshot) -> list[str]:
    """Table names in (schema, name) order, system schemas left out."""
    return sorted((t for t in snapshot.tables if split_name(t)[0] not in SYSTEM_SCHEMAS and t not in OWN_VIEWS),
                  key=split_name)


def descriptions(spark: SparkSession, snapshot: Snapshot) -> dict[str, DataFrame]:
    """The snapshot's user tables, partitioned tables and components as tables."""
    return {
        TABLES_VIEW: spark.createDataFrame([split_name(t) for t in user_tables(snapshot)], "schema string, name string"),
        PARTITIONS_VIEW: spark.createDataFrame(list(snapshot.partitions.items()), "table_name string, time_column string"),
        COMPONENTS_VIEW: spark.createDataFrame([(c,) for c in snapshot.components], "component string"),
    }


def child_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark``, in UTC, without its temporary views, that reads no files by path."""
    child = spark.newSession()
    for row in spark.sql("SET").collect():
        if child.conf.isModifiable(row["key"]):
            child.conf.set(row["key"], row["value"])
    child.conf.set("spark.sql.session.timeZone", "UTC")
    child.conf.set("spark.sql.runSQLOnFiles", "false")
    return child


class SnapshotSession:
    """``with SnapshotSession(spark, snapshot) as s``: ``s.analyse(query)`` and ``s.session`` see the snapshot only.

    A table ``schema.name`` goes by both spellings, as one quoted name and as two. A table whose columns
    do not make a view (two of one name) is not there.
    """

    def __init__(self, spark: SparkSession, snapshot: Snapshot):
        self.spark, self.snapshot, self.shared = spark, snapshot, []

    def __enter__(self) -> SnapshotSession:
        self.session = child_session(self.spark)
        run = f"snapshot_{uuid.uuid4().hex}"
        for i, (name, df) in enumerate({**self.snapshot.tables, **descriptions(self.spark, self.snapshot)}.items()):
            try:
                df.createGlobalTempView(f"{run}_{i}")
                self.shared.append(f"{run}_{i}")
                self.session.sql(f"CREATE OR REPLACE TEMPORARY VIEW {quote_ident(name)} AS SELECT * FROM global_temp.{run}_{i}")
            except AnalysisException:
                continue
        return self

    def __exit__(self, *_) -> None:
        for view in self.shared:
            self.spark.catalog.dropGlobalTempView(view)

    def analyse(self, query: str) -> tuple[str, str]:
        """(the query, the type of its one column); raises what is wrong with it. Only a query of one column passes."""
        while True:
            try:
                return query, self.session.sql(subject(query)).schema[0].dataType.simpleString()
            except AnalysisException as error:
                named = self._qualified(query, error)
                if named is None:
                    raise
                query = named

    def _qualified(self, query: str, error: AnalysisException) -> str | None:
        """``query`` with the ``schema.name`` that Spark did not find as one quoted name, if it is the snapshot's."""
        if (error.getCondition() or "") != "TABLE_OR_VIEW_NOT_FOUND":
            return None
        missing = (error.getMessageParameters() or {}).get("relationName", "")
        table = ".".join(p[1:-1].replace("``", "`") for p in re.findall(r"`(?:[^`]|``)*`", missing))
        known = {t.lower(): t for t in self.snapshot.tables if "." in t}
        contexts = [c for c in error.getQueryContext() if c.fragment()]
        if table.lower() not in known or not contexts:
            raise ValueError(f"the snapshot has no table {missing or table}") from None
        start = contexts[0].startIndex() - len(OPEN)
        stop = contexts[0].stopIndex() - len(OPEN) + 1
        if not 0 <= start < stop <= len(query) or query[start:stop] != contexts[0].fragment():
            raise ValueError(f"the snapshot has no table {missing or table}") from None
        name = quote_ident(known[table.lower()])
        aliased = f"{query[:start]}{name} AS {quote_ident(split_name(table)[1])}{query[stop:]}"
        try:
            self.session.sql(subject(aliased))
        except ParseException:  # it has an alias
            return f"{query[:start]}{name}{query[stop:]}"
        except AnalysisException:
            pass
        return aliased

    def foreign(self, query: str) -> set[str]:
        """Qualified names of tables outside of the snapshot that ``query`` reads, by Spark's own account of it."""
        seen = self._reads(query) - {f"global_temp.{view}" for view in self.shared}
        if not seen:
            return set()
        own = [self._reads(f"SELECT * FROM global_temp.{view}") for view in self.shared]  # a table may be made of others
        return seen - set().union(*own)

    def _reads(self, query: str) -> set[str]:
        told = self.session.sql(f"EXPLAIN EXTENDED {query}").first()[0]
        analysed = told.partition("== Analyzed Logical Plan ==")[2].partition("== Optimized Logical Plan ==")[0]
        return set(_QUALIFIED.findall(analysed))


OPEN = "SELECT (\n"


def subject(query: str) -> str:
    """``query`` as the one value of a row: commands, several columns and several statements do not fit there."""
    return f"{OPEN}{query}\n) AS v"

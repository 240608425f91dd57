"""Queries over what is kept between runs, and over columns whose type is that of their data; with SQL that gives the same rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import dates, json_columns
from ..operators import profiler
from ..operators.field_index import FieldIndex
from ..operators.ground_truth import GroundTruth
from ..sources import many
from ..sources.catalog import Catalog
from ..sources.files import Files, shared_folder
from ..sources.tables import Store
from . import definitions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""
SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, count(CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END) AS priorities, CAST(2 AS BIGINT) AS version
FROM orders GROUP BY o_orderstatus""")
def store_reopened(spark, sf_dir):
    """Orders kept in two appends, the second with a column more, as a store opened on the folder anew has them."""
    folder, orders = _folder(spark, "store"), _t(spark, sf_dir, "orders")
    store = Store(spark, folder)
    store.load(orders.where("o_orderstatus = 'O'").drop("o_orderpriority"), "kept orders", {"o_orderstatus": "status"})
    store.load(orders.where("o_orderstatus <> 'O'"), "kept orders", {"o_orderstatus": "status"}, replace=False)
    again = Store(spark, folder)
    rows = again.tables()["kept_orders"]
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.count("o_orderpriority").alias("priorities"), F.lit(max(again.catalog.versions())).cast("long").alias("version"))


#: What a definition's file may hold.
LINES = {
    "name": "lines_by_flag",
    "description": "Lines by return flag",
    "requires": {"definition_lines": ["l_returnflag", "l_shipdate", "l_quantity"]},
    "parameters": [{"name": "since", "type": "date"}, {"name": "flag"}, {"name": "least", "type": "integer", "default": 1}],
    "sql": """
        SELECT l_returnflag AS flag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity -- {{not_a_parameter}}
        FROM definition_lines
        WHERE 1 = 1
          {? AND l_shipdate >= '{{since}}' ?}
          {? AND l_returnflag LIKE '{{flag}}%' ?}
        GROUP BY l_returnflag HAVING count(*) >= {{least}}""",
}
_RUNS = {"all": {}, "since": {"since": "1995-06-01"}, "flag": {"flag": "R"}, "both": {"since": "1995-06-01", "flag": "A"}, "none": {"least": "1000000000000"}}


@query("""
SELECT run, l_returnflag AS flag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity
FROM lineitem, (VALUES ('all', DATE '0001-01-01', ''), ('since', DATE '1995-06-01', ''), ('flag', DATE '0001-01-01', 'R'), ('both', DATE '1995-06-01', 'A')) r(run, since, flag)
WHERE l_shipdate >= since AND l_returnflag LIKE flag || '%' GROUP BY run, l_returnflag""")
def definition_from_folder(spark, sf_dir):
    """A report that is defined in a file, with and without each of its parameters."""
    folder = _folder(spark, "definitions")
    Files(spark).create(f"{folder}/lines.json", json.dumps([LINES]))
    registry, errors = definitions.load(spark, folder)
    if errors:
        raise ValueError(errors)
    report, tables, out = registry.get("lines_by_flag"), {"definition_lines": _t(spark, sf_dir, "lineitem")}, None
    for run, values in _RUNS.items():
        rows = report.build(tables, report.bind(values)).withColumn("run", F.lit(run))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""
WITH e AS (SELECT 'v' || lpad(CAST(vec_id AS VARCHAR), 12, '0') AS item_id, CASE WHEN label >= 5 THEN 'relabelled' ELSE 'type_' || CAST(label AS VARCHAR) END AS document_type,
                  TIMESTAMP '2024-01-01' + to_minutes(CAST(vec_id AS INTEGER)) + CASE WHEN label >= 5 THEN INTERVAL 100 DAY ELSE INTERVAL 0 DAY END AS labelled_at FROM embeddings WHERE label <> 4),
     r AS (SELECT *, CAST(row_number() OVER (ORDER BY labelled_at DESC, item_id) AS INTEGER) AS rank FROM e)
SELECT rank, item_id, document_type, labelled_at FROM r WHERE rank <= 100""")
def ground_truth_newest(spark, sf_dir):
    """The newest hundred labelled tables: all embeddings, then those of five labels again under a new one, and one label removed."""
    truth, rows = GroundTruth(Catalog(spark, _folder(spark, "truth"))), _t(spark, sf_dir, "embeddings")
    item, at = F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 12, "0")).alias("item_id"), F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("vec_id").cast("int"))
    truth.add(rows.select(item, F.concat(F.lit("type_"), F.col("label")).alias("document_type"), F.col("embedding").alias("vector"), at.alias("labelled_at")))
    truth.add(rows.where("label >= 5").select(item, F.lit("relabelled").alias("document_type"), F.col("embedding").alias("vector"), (at + F.expr("interval 100 days")).alias("labelled_at")))
    truth.remove(rows.where("label = 4").select(item))
    newest = truth.newest(100).select("item_id", "document_type", "labelled_at")
    rank = F.row_number().over(W.orderBy(F.desc("labelled_at"), "item_id"))
    return newest.select(rank.alias("rank"), "item_id", "document_type", F.col("labelled_at").cast("timestamp_ntz").alias("labelled_at"))


@query("""
WITH p AS (SELECT count(*) AS n, count(CASE WHEN p_size > 40 THEN 1 END) AS changed FROM part)
SELECT unnest(['first', 'again', 'changed', 'forced']) AS run, unnest([n, 0, changed, changed]) AS written, unnest([n, n, n, changed]) AS total FROM p""")
def field_index_runs(spark, sf_dir):
    """Parts as fields of an index: what is written at first, again, after some have changed, and by force."""
    fields = _t(spark, sf_dir, "part").select(F.lit("parts").alias("vertical"), F.col("p_type").alias("document_type"), F.col("p_partkey").cast("string").alias("field_name"), F.concat_ws(" ", "p_name", "p_brand").alias("text"), "p_size")
    changed = fields.where("p_size > 40").withColumn("text", F.concat("text", F.lit(" new")))
    index, out = FieldIndex(Catalog(spark, _folder(spark, "index"))), []
    for run, rows, force in (("first", fields, False), ("again", fields, False), ("changed", changed, False), ("forced", changed, True)):
        written = index.index(rows, force)
        out.append((run, written, index.current().count()))
    return spark.createDataFrame(out, "run string, written long, total long")


@query("""
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders), s AS (SELECT count(*) AS n, max(day(d)) > 12 AS told, max(CASE WHEN day(d) > 12 THEN 0 ELSE day(d) END) > 12 AS never, count(DISTINCT d) AS days FROM d)
SELECT unnest(['dmy', 'early', 'iso', 'mdy', 'mixed']) AS column_name, unnest(['DD/MM/YYYY', 'DD-MM-YYYY', 'YYYY-MM-DD', CASE WHEN told THEN 'MM/DD/YYYY' ELSE 'DD/MM/YYYY' END, NULL]) AS date_format,
       unnest([CASE WHEN told THEN 1 ELSE 2 END, 2, 1, CASE WHEN told THEN 1 ELSE 2 END, 0]) AS formats, unnest([n, n, n, n, n]) AS values, CAST(0 AS BIGINT) AS misfits, unnest([days, NULL, days, days, NULL]) AS days
FROM s""")
def date_formats(spark, sf_dir):
    """The format of five columns of dates: days above 12 decide between two, a column without such days is read day first."""
    day = F.col("o_orderdate").cast("date")
    as_text = {"iso": F.date_format(day, "yyyy-MM-dd"), "dmy": F.date_format(day, "d/M/yyyy"), "mdy": F.date_format(day, "MM/dd/yyyy"), "early": F.concat_ws("-", F.lit("07"), F.date_format(day, "MM-yyyy")), "mixed": F.when(F.col("o_orderstatus") == "O", F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "yyyyMMdd"))}
    rows = _t(spark, sf_dir, "orders").select(*[c.alias(n) for n, c in as_text.items()])
    found = dates.column_formats(rows, list(as_text))
    told = {"iso": "YYYY-MM-DD", "dmy": "DD/MM/YYYY", "mdy": "MM/DD/YYYY"}
    # The condition, which always holds, keeps Spark from taking these groups for redundant and reading every row's date.
    values = rows.unpivot([], list(told), "column_name", "value").groupBy("column_name", "value").agg(F.count("*").alias("n")).where("n > 0")
    date = F.coalesce(*[F.when(F.col("column_name") == n, dates.read(F.col("value"), f)) for n, f in told.items()])
    days = values.groupBy("column_name").agg(F.countDistinct(date).alias("days"))
    return found.select("column_name", "date_format", F.size("candidates").alias("formats"), "values", "misfits").join(days, "column_name", "left")


@query("""
SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS total, max(CAST(props->>'k' AS BIGINT)) AS most,
       '{"k":' || CAST(max(CAST(props->>'k' AS BIGINT)) AS VARCHAR) || ',"of":null}' AS encoded
FROM events GROUP BY event_type""")
def json_columns_grouped(spark, sf_dir):
    """A JSON column decoded by the type of its data, grouped, and encoded again."""
    rows = json_columns.decoded(_t(spark, sf_dir, "events"), "props")
    out = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("props.k").alias("total"), F.max("props.k").alias("most"))
    return out.withColumn("encoded", json_columns.encoded(F.struct(F.col("most").alias("k"), F.lit(None).cast("string").alias("of"))))


_KINDS = {"orders": "o_orderstatus", "part": "p_type", "events": "event_type"}


def _unpivoted(kind: str, columns: list[str]) -> str:
    cells = ", ".join(f"count({c})" for c in columns)
    return f"SELECT '{kind}' AS kind, unnest([{', '.join(repr(c) for c in columns)}]) AS column_name, (SELECT count(DISTINCT {_KINDS[kind]}) FROM {kind}) AS files, unnest([{cells}]) AS filled, unnest([{', '.join(f'count(*) - count({c})' for c in columns)}]) AS missing FROM {kind}"


_HEADERS = {"orders": ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"], "part": ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"], "events": ["event_id", "ts", "user_id", "value", "props"]}


@query(" UNION ALL ".join(_unpivoted(kind, columns) for kind, columns in _HEADERS.items()))
def files_profiled(spark, sf_dir):
    """Files of three kinds with unlike headers, read and profiled by file and column in one plan."""
    folder = _folder(spark, "files")
    for kind, by in _KINDS.items():
        _t(spark, sf_dir, kind).repartition(by).write.partitionBy(by).csv(f"{folder}/kind={kind}", header=True, escape='"')
    cells, _ = many.read(spark, [f"{folder}/kind={kind}/*" for kind in _KINDS])
    profiles = profiler.profile_cells(cells, ["file"]).withColumn("kind", F.regexp_extract("file", "kind=([a-z]+)/", 1))
    return profiles.groupBy("kind", "column_name").agg(F.countDistinct("file").alias("files"), F.sum("non_null_count").alias("filled"), F.sum("null_count").alias("missing"))

"""Queries on drifting schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollframe import runtime
from rollframe.operators import schema_drift as sd


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a rollout file against the one before it in its run."""
    return sd.drift(runtime.table(spark, sf_dir, "raw_rollouts"))


def _fields(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The columns of the rollouts with their types, but run_id, which every row has from its file."""
    return {f: t for f, t in runtime.table(spark, sf_dir, "rollouts").dtypes if f not in sd.FILE}


def _typed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    raw = runtime.table(spark, sf_dir, "raw_rollouts")
    lines = runtime.written(sd.readable(raw), "lines")
    fields = _fields(spark, sf_dir)
    names = runtime.cut(sd.aliases(sd.drift(raw), list(fields)))
    return lines, runtime.written(sd.typed_values(sd.path_values(lines), names, fields), "typed")


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all files as one table with the fields of the rollouts."""
    return sd.unified(*_typed(spark, sf_dir), _fields(spark, sf_dir))


def p4_failed_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that could not be cast, by file and field."""
    return sd.failed_casts(_typed(spark, sf_dir)[1])


def p4_loose_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that were read by a guess (percentages, yes and no, items of an array), by file and field."""
    return sd.loose_casts(_typed(spark, sf_dir)[1])


def p4_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file holds: its fields, their most frequent type and the number of lines with them."""
    return sd.fields(runtime.table(spark, sf_dir, "raw_rollouts"))


def p4_retyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that keep their name from one file to the next but not their type."""
    return p4_found(spark, sf_dir).where("change = 'type_changed'")


QUERIES = {f.__name__: f for f in (p4_found, p4_table, p4_failed_casts, p4_loose_casts, p4_fields, p4_retyped)}

_FIELDS = """
    l AS (SELECT run_id, file_seq, line_no, min(payload) AS p FROM raw_rollouts WHERE run_id IS NOT NULL AND file_seq IS NOT NULL AND json_valid(payload) AND json_type(payload) = 'OBJECT' GROUP BY ALL),
    n AS (SELECT run_id, file_seq, count(*) AS lines FROM l GROUP BY ALL),
    k AS (SELECT run_id, file_seq, line_no, p, unnest(json_keys(p)) AS field FROM l),
    t AS (SELECT run_id, file_seq, field, line_no, CASE json_type(p, '/' || field) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS type FROM k),
    c AS (SELECT run_id, file_seq, field, type, count(*) AS n FROM t WHERE type IS NOT NULL GROUP BY ALL),
    m AS (SELECT run_id, file_seq, field, type FROM c QUALIFY row_number() OVER (PARTITION BY run_id, file_seq, field ORDER BY n DESC, type) = 1),
    w AS (SELECT run_id, file_seq, field, count(*) AS with_field FROM t GROUP BY ALL),
    f AS (SELECT w.run_id, w.file_seq, w.field, m.type, with_field, lines FROM w JOIN n USING (run_id, file_seq) LEFT JOIN m USING (run_id, file_seq, field))"""
SQL = {
    "p4_fields": f"WITH {_FIELDS} SELECT * FROM f",
    "p4_retyped": f"""WITH {_FIELDS}, s AS (SELECT run_id, file_seq, lag(file_seq) OVER (PARTITION BY run_id ORDER BY file_seq) AS last_seq FROM (SELECT DISTINCT run_id, file_seq FROM raw_rollouts WHERE run_id IS NOT NULL AND file_seq IS NOT NULL)),
        o AS (SELECT * FROM f WHERE 2 * with_field >= lines)
        SELECT a.run_id, a.file_seq, 'type_changed' AS change, a.field, '' AS new_field FROM o a JOIN s USING (run_id, file_seq) JOIN o b ON b.run_id = a.run_id AND b.file_seq = s.last_seq AND b.field = a.field WHERE a.type <> b.type""",
}

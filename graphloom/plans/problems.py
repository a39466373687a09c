"""Queries of the general data problems: snapshots and orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import orphans, snapshots
from graphloom.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every node and edge added, removed or changed from one export to the next."""
    rows = snapshots.graph_records(table(spark, folder, "node_snapshots"), table(spark, folder, "edge_snapshots"))
    return snapshots.changes(rows)


def p2_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Changes per record type and snapshot."""
    return p2_found(spark, folder).groupBy("record_type", "snapshot_id", "change").agg(F.count("*").alias("n_records"))


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    keys = orphans.parents(table(spark, folder, "nodes"), table(spark, folder, "shared_nodes"))
    return orphans.orphans(orphans.references(table(spark, folder, "edges"), table(spark, folder, "hyperedges")), keys)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every reference to a missing, late or deleted node."""
    return _orphans(spark, folder).select("ref_table", "ref_key", "field", "node_ref", "reason").distinct()


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per table, field, month and reason."""
    return orphans.report(_orphans(spark, folder))


_NORMAL = "lower(trim(regexp_replace({}, '[^a-zA-Z0-9]+', '_', 'g'), '_'))"

_P2 = r"""
WITH n AS (
  SELECT DISTINCT 'node' AS record_type, id AS record_key, snapshot_id, snapshot_at, community,
    concat_ws(chr(30), coalesce(label, ''), coalesce(file_type, ''), replace(coalesce(source_file, ''), '\', '/'), coalesce(source_location, ''),
      coalesce(description, ''), array_to_string(list_sort(coalesce(tags, [])), chr(31))) AS body
  FROM node_snapshots
), e AS (
  SELECT DISTINCT 'edge' AS record_type, concat(coalesce(source, ''), '|', coalesce(target, ''), '|', coalesce(relation, '')) AS record_key, snapshot_id, snapshot_at, CAST(NULL AS int) AS community,
    concat_ws(chr(30), coalesce(confidence, ''), coalesce(CAST(weight AS varchar), ''), array_to_string(list_sort(coalesce(call_sites, [])), chr(31))) AS body
  FROM edge_snapshots
), r AS (
  SELECT *, dense_rank() OVER (PARTITION BY record_type ORDER BY snapshot_at, snapshot_id) AS turn FROM (SELECT * FROM n UNION ALL SELECT * FROM e)
), o AS (
  SELECT a.record_type, a.turn, a.community AS old, b.community AS new, count(*) AS k
  FROM r a JOIN r b ON a.record_type = b.record_type AND a.record_key = b.record_key AND b.turn = a.turn + 1
  WHERE a.community IS NOT NULL GROUP BY ALL
), g AS (
  SELECT record_type, turn, old, new FROM (SELECT *, sum(k) OVER (PARTITION BY record_type, turn, old) AS total FROM o) WHERE 2 * k > total AND new IS NOT NULL
), t AS (
  SELECT record_type, turn, min(snapshot_id) AS snapshot_id FROM r GROUP BY ALL
), a AS (
  SELECT r.record_type, r.record_key, r.turn + 1 AS turn, r.body, CASE WHEN r.community IS NULL THEN 'null' ELSE coalesce(CAST(g.new AS varchar), 'none') END AS grp
  FROM r LEFT JOIN g ON g.record_type = r.record_type AND g.turn = r.turn AND g.old = r.community
), b AS (
  SELECT record_type, record_key, turn, body, coalesce(CAST(community AS varchar), 'null') AS grp FROM r WHERE turn > 1
)
SELECT j.record_type, j.record_key, t.snapshot_id, j.change FROM (
  SELECT coalesce(a.record_type, b.record_type) AS record_type, coalesce(a.record_key, b.record_key) AS record_key, coalesce(a.turn, b.turn) AS turn,
    CASE WHEN a.record_key IS NULL THEN 'added' WHEN b.record_key IS NULL THEN 'removed' WHEN a.body <> b.body OR a.grp <> b.grp THEN 'changed' END AS change
  FROM a FULL JOIN b ON a.record_type = b.record_type AND a.record_key = b.record_key AND a.turn = b.turn
) j JOIN t ON t.record_type = j.record_type AND t.turn = j.turn WHERE j.change IS NOT NULL
"""

_P3 = f"""
WITH k AS (
  SELECT {_NORMAL.format("id")} AS id, arg_max(created_at, (updated_at, ingested_at)) AS born, arg_max(coalesce(deleted_at, TIMESTAMP '9999-01-01'), (updated_at, ingested_at)) AS gone, false AS always
  FROM nodes GROUP BY 1
  UNION ALL SELECT {_NORMAL.format("id")}, NULL, NULL, true FROM shared_nodes
), f AS (
  SELECT 'edges' AS ref_table, edge_id AS ref_key, 'source' AS field, source AS node_ref, extracted_at AS tm FROM edges
  UNION ALL SELECT 'edges', edge_id, 'target', target, extracted_at FROM edges
  UNION ALL SELECT 'hyperedges', hyperedge_key, 'members', unnest(members), derived_at FROM hyperedges
), p AS (SELECT id, min(born) AS born, min(gone) AS gone, bool_or(always) AS always FROM k GROUP BY 1
), j AS (
  SELECT f.*, CASE WHEN p.id IS NULL THEN 'missing' WHEN always THEN NULL WHEN born > tm THEN 'late' WHEN gone <= tm THEN 'deleted' END AS reason
  FROM f LEFT JOIN p ON p.id = {_NORMAL.format("f.node_ref")} WHERE coalesce(node_ref, '') <> ''
)
"""

QUERIES = {"p2_found": p2_found, "p2_totals": p2_totals, "p3_found": p3_found, "p3_report": p3_report}
SQL = {
    "p2_found": _P2,
    "p2_totals": f"SELECT record_type, snapshot_id, change, count(*) AS n_records FROM ({_P2}) GROUP BY ALL",
    "p3_found": _P3 + "SELECT DISTINCT ref_table, ref_key, field, node_ref, reason FROM j WHERE reason IS NOT NULL",
    "p3_report": _P3 + "SELECT ref_table, field, strftime(tm, '%Y-%m') AS month, reason, count(*) AS n_references, count(DISTINCT ref_key) AS n_records FROM (SELECT DISTINCT ref_table, ref_key, field, node_ref, tm, reason FROM j WHERE reason IS NOT NULL) GROUP BY ALL",
}

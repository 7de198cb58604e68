"""Domain tables as views over the test tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "cells": "SELECT DISTINCT CAST(l_suppkey % 16 AS BIGINT) AS cell FROM {lineitem}",
    "sites": """SELECT p_partkey AS site,
        concat('chr', CASE WHEN p_partkey % 25 < 22 THEN CAST(p_partkey % 25 + 1 AS VARCHAR(4))
          WHEN p_partkey % 25 = 22 THEN 'X' WHEN p_partkey % 25 = 23 THEN 'Y' ELSE 'MT' END) AS chrom,
        p_partkey * 1000 + p_size AS pos, substr('ACGT', CAST(p_partkey % 4 AS INT) + 1, 1) AS ref,
        substr('CGTA', CAST(p_partkey % 4 AS INT) + 1, 1) AS alt FROM {part}""",
    "raw_reads": """SELECT l_partkey AS site, CAST(l_suppkey % 16 AS BIGINT) AS cell,
        CAST(sum(CASE WHEN l_linenumber % 4 = 1 THEN l_quantity ELSE 0 END) AS BIGINT) AS r1,
        CAST(sum(CASE WHEN l_linenumber % 4 = 2 THEN l_quantity ELSE 0 END) AS BIGINT) AS r2,
        CAST(sum(CASE WHEN l_linenumber % 4 = 3 THEN l_quantity ELSE 0 END) AS BIGINT) AS r3,
        CAST(sum(l_quantity) AS BIGINT) AS cov FROM {lineitem} GROUP BY l_partkey, CAST(l_suppkey % 16 AS BIGINT)""",
    "reads": """SELECT s.site, c.cell, coalesce(r.r1, 0) AS r1, coalesce(r.r2, 0) AS r2, coalesce(r.r3, 0) AS r3,
        coalesce(r.cov - r.r1 - r.r2 - r.r3, 0) AS ref_reads, coalesce(r.cov, 0) AS cov
        FROM {sites} s CROSS JOIN {cells} c LEFT JOIN {raw_reads} r ON s.site = r.site AND c.cell = r.cell""",
    "pattern_reads": "SELECT site, cell % 3 AS cell, CAST(floor(sum(cov) / 150.0) AS BIGINT) AS cov FROM {reads} GROUP BY site, cell % 3",
    "genes": """SELECT s.chrom, s.pos - 3000 AS start_pos, s.pos + 50000 AS end_pos, p.p_brand AS gene
        FROM {sites} s JOIN {part} p ON s.site = p.p_partkey WHERE s.site % 40 = 0""",
    "trace": "SELECT event_id AS sample, event_type AS var, value FROM {events}",
    "background": "SELECT 'coverage' AS name, CAST(l_quantity AS BIGINT) AS n_reads, count(*) AS occurrences FROM {lineitem} GROUP BY CAST(l_quantity AS BIGINT)",
    "gt_trace": """SELECT o_orderkey AS sample, o_custkey % 50 AS site, o_custkey % 7 AS cell, o_orderstatus AS genotype,
        CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS ado FROM {orders}""",
    "tree_ids": "SELECT CAST(r_regionkey AS INT) AS tree FROM {region}",
    "nodes": """SELECT tree, 'root' AS node, CAST(NULL AS VARCHAR(20)) AS parent, CAST(4 AS DOUBLE) AS height FROM {tree_ids}
        UNION ALL SELECT tree, 'trunk', 'root', CAST(3 AS DOUBLE) FROM {tree_ids}
        UNION ALL SELECT tree, concat('r', CAST(r_regionkey AS VARCHAR(8))), 'trunk', 2 + r_regionkey / 10.0 + tree / 100.0 FROM {region} CROSS JOIN {tree_ids}
        UNION ALL SELECT tree, concat('n', CAST(n_nationkey AS VARCHAR(8))), concat('r', CAST((n_regionkey + CASE WHEN n_nationkey % 4 = 0 THEN tree ELSE 0 END) % 5 AS VARCHAR(8))),
          1 + n_nationkey / 100.0 + tree / 1000.0 FROM {nation} CROSS JOIN {tree_ids}
        UNION ALL SELECT tree, concat('s', CAST(s_suppkey AS VARCHAR(12))), concat('n', CAST((s_nationkey + CASE WHEN s_suppkey % 5 = 0 THEN tree ELSE 0 END) % 25 AS VARCHAR(8))), CAST(0 AS DOUBLE)
          FROM {supplier} CROSS JOIN {tree_ids}""",
    "cell_groups": "SELECT tree, cell, CAST((cell + CASE WHEN cell % 3 = 0 THEN tree ELSE 0 END) % 5 AS INT) AS g FROM {cells} CROSS JOIN {tree_ids}",
    "cell_nodes": """SELECT tree, concat('c', CAST(cell AS VARCHAR(8))) AS node, concat('g', CAST(g AS VARCHAR(8))) AS parent, CAST(0 AS DOUBLE) AS height FROM {cell_groups}
        UNION ALL SELECT DISTINCT tree, concat('g', CAST(g AS VARCHAR(8))), concat('m', CAST((g + CASE WHEN g % 2 = 0 THEN tree ELSE 0 END) % 2 AS VARCHAR(8))), CAST(1 + g / 10.0 + tree / 100.0 AS DOUBLE) FROM {cell_groups}
        UNION ALL SELECT DISTINCT tree, concat('m', CAST((g + CASE WHEN g % 2 = 0 THEN tree ELSE 0 END) % 2 AS VARCHAR(8))), 'trunk', CAST(2 + tree / 50.0 AS DOUBLE) FROM {cell_groups}
        UNION ALL SELECT tree, 'trunk', 'root', CAST(3 AS DOUBLE) FROM {tree_ids} UNION ALL SELECT tree, 'root', CAST(NULL AS VARCHAR(8)), CAST(4 AS DOUBLE) FROM {tree_ids}""",
    # Inner nodes have a genotype at every site, tips where they have reads.
    "tip_sites": "SELECT DISTINCT l_partkey AS site, concat('s', CAST(l_suppkey AS VARCHAR(12))) AS node FROM {lineitem}",
    "node_gt": """SELECT site, node, CASE WHEN node IN ('root', 'trunk') THEN '0/0'
          WHEN (site + length(node) * 7 + ascii(substr(node, length(node), 1))) % 11 = 0 THEN '1/1'
          WHEN (site + length(node) * 5 + ascii(substr(node, length(node), 1))) % 7 = 0 THEN '0/1'
          WHEN (site + length(node) + ascii(substr(node, length(node), 1))) % 17 = 0 THEN '1/2' ELSE '0/0' END AS genotype
        FROM (SELECT s.site, n.node FROM {sites} s CROSS JOIN {nodes} n WHERE n.tree = 0 AND substr(n.node, 1, 1) <> 's'
          UNION ALL SELECT t.site, t.node FROM {tip_sites} t JOIN {nodes} n ON n.node = t.node AND n.tree = 0) g""",
    "calls": """SELECT site, cell, cov, CASE WHEN cov = 0 THEN 0 WHEN (r1 + r2) * 3 < cov THEN 0 WHEN ref_reads * 3 < cov THEN 2 ELSE 1 END AS genotype FROM {reads}""",
}


@cache
def needs(name: str) -> tuple[str, ...]:
    return tuple(x for x in (*TABLES, *VIEWS) if "{" + x + "}" in VIEWS[name])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view, built from the tables below ``sf_dir``."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{x: view(spark, sf_dir, x) for x in needs(name)})


def with_views(names: list[str], body: str) -> str:
    """DuckDB SQL: the views that ``names`` need as common table expressions, then ``body``."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in needs(name):
            if x not in TABLES:
                add(x)
        if name not in order:
            order.append(name)

    for name in names:
        if name not in TABLES:
            add(name)
    if not order:
        return body.strip()
    parts = [f"{x} AS ({VIEWS[x].format(**{y: y for y in (*TABLES, *VIEWS)})})" for x in order]
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body

"""Raster, vector and queue views over the star-schema test tables, as DataFrames and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: View name -> (base tables, SQL that Spark and DuckDB both run).
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "px": (("lineitem",), "select l_orderkey % 64 as patch_id, cast(year(l_shipdate) as bigint) as yr, l_quantity/50.0e0 as prob, case when l_quantity>=25 then 1 else 0 end as p, case when l_extendedprice>=30000 then 1 else 0 end as t from lineitem"),
    "ras": (("lineitem",), "select l_orderkey % 97 as y, l_partkey % 89 as x, max(case when l_quantity>=45 then 1 else 0 end) as v from lineitem group by 1,2"),
    "rects": (("supplier",), "select s_suppkey as rect_id, cast((s_suppkey*37)%1000 as double) as x0, cast((s_suppkey*61)%1000 as double) as y0, cast((s_suppkey*37)%1000+100 as double) as x1, cast((s_suppkey*61)%1000+100 as double) as y1 from supplier"),
    "crowns": (("customer",), "select c_custkey as crown_id, cast((c_custkey*53)%1000 as double) as cx, cast((c_custkey*97)%1000 as double) as cy, abs(c_acctbal)/20.0e0 as area from customer"),
    "queue": (("orders",), "select o_orderkey as id, concat('r', cast(o_custkey%3 as string)) as run_name, case o_orderstatus when 'O' then 'queued' when 'P' then 'started' else 'completed' end as status, 6-cast(substr(o_orderpriority,1,1) as int) as priority from orders"),
    "foot": (("orders",), "select o_custkey as id, cast(year(o_orderdate) as bigint) as yr, o_orderkey as src_row from orders"),
    "tiles": (("embeddings",), "select vec_id, embedding, label from embeddings"),
    "boxes": (("customer",), "select c_custkey as box_id, cast((c_custkey*53)%1000 as double) as x0, cast((c_custkey*97)%1000 as double) as y0, cast((c_custkey*53)%1000+5 as double) as x1, cast((c_custkey*97)%1000+5 as double) as y1 from customer"),
}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A bridge view, or a base table if there is no view by the name."""
    if name not in VIEWS:
        return base(spark, sf_dir, name)
    tables, sql = VIEWS[name]
    for table in tables:
        sql = sql.replace(f"from {table}", f"from {{{table}}}")
    return spark.sql(sql, **{t: base(spark, sf_dir, t) for t in tables})


def with_views(sql: str, *names: str) -> str:
    """SQL for DuckDB with the views it uses in front."""
    heads = ", ".join(f"{name} as ({VIEWS[name][1]})" for name in names)
    if not heads:
        return sql
    rest = sql.strip()
    if rest.lower().startswith("with recursive"):
        return f"with recursive {heads}, {rest[14:]}"
    if rest.lower().startswith("with"):
        return f"with {heads}, {rest[4:]}"
    return f"with {heads} {rest}"

"""Views over the test tables that stand for cells, predictions and scores; the SQL runs on Spark and on DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NODES = """
select user_id as cell_id, case when user_id % 2 = 0 then 'pyramidal' else 'interneuron' end as cell_type,
 event_id as seq, id,
 case when id=1 then 1 when event_type in ('click','error') then 2 when event_type in ('view','signup') then 3 else 4 end as type,
 cast(case when id=1 then 0 else (event_id % 97) * 1.5 - 70 end as double) as x,
 cast(case when id=1 then 0 else (event_id % 89) * 1.25 - 50 end as double) as y,
 cast(case when id=1 then 0 else (event_id % 101) * 2 - 60 end as double) as z,
 cast(case when id=1 then 5 else 0.25 + (event_id % 13) * 0.125 end as double) as radius,
 cast(case when id=1 then -1 when id<=4 then 1 when id % 7 = 0 then floor(id/2) else id-3 end as int) as parent
from (select user_id, event_id, event_type,
      cast(row_number() over(partition by user_id order by event_id) as int) as id from events) e
"""
PRED = f"""
select *, case when id=1 then 1 when seq % 11 = 0 then 2 + (type - 1) % 3 else type end as pred,
 cast(50 + seq % 50 as double) / 100 as conf from ({NODES}) n
"""
SCORES = """
select concat('m', cast(m as varchar(1))) as method,
 concat(case c_custkey % 4 when 0 then 'allen' when 1 then 'lab' when 2 then 'neuromorpho' else 'hpf_ca1' end,
        '__', cast(c_custkey as varchar(20)), '.swc') as file_name,
 case when c_custkey % 3 = 0 then 'interneuron' else 'pyramidal' end as cell_type,
 cast((c_custkey * (37 + m * 4)) % 1000 as int) as f1_milli
from customer cross join (select 0 as m union all select 1 union all select 2) k
where (c_custkey + m) % 7 <> 0
"""
#: Each method's scores as files of their own.
FILES = f"""
select method, replace(file_name, '.swc', concat('_', method, '.swc')) as file_name, cell_type, f1_milli from ({SCORES}) m
"""


def view(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    """The rows of one of the views above, over a table in sf_dir."""
    spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"neuritic_{table}")
    return spark.sql(sql.replace(f"from {table}", f"from neuritic_{table}"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, NODES, "events")


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PRED, "events")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SCORES, "customer")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, FILES, "customer")

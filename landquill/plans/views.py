"""Views that give the standard test tables the shapes of survey and registry data; Spark and DuckDB read the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import broadcast_by_measure

BASE = ("customer", "orders", "lineitem", "part", "events", "supplier")

VIEWS = {
    "v_stakes": """
select c_custkey as stake_id,
  case when c_custkey % 23 = 7 then null else concat(case when c_custkey % 11 in (0, 8) then '-' else '' end,
    cast(c_custkey % 9 + 1 as string), '.', lpad(cast(c_custkey as string), 6, '0')) end as number,
  cast((c_custkey % 30) * 10.0 + ((c_custkey * 37) % 7) * 0.1 as double) as x,
  cast(floor(c_custkey / 30.0) * 10.0 + ((c_custkey * 53) % 5) * 0.1 as double) as y,
  cast(c_custkey % 3 as string) as layer
from customer
""",
    "v_lines": """
select a.stake_id * 2 as line_id, a.x + 0.1 as x1, a.y as y1, b.x as x2, b.y - 0.1 as y2
from v_stakes a join v_stakes b on b.stake_id = a.stake_id + 1
where a.stake_id % 30 < 29 and a.stake_id % 13 <> 5
union all
select a.stake_id * 2 + 1, a.x, a.y, b.x, b.y
from v_stakes a join v_stakes b on b.stake_id = a.stake_id + 30
where a.stake_id % 17 <> 3
""",
    "v_labels": """
select i as label_id,
  case when i % 5 = 0 then cast(i as string) else concat(cast(i % 700 as string), '-', cast(i % 9 as string)) end as number,
  cast((i % 30 + case when i % 30 in (5, 11, 17) then 1 else 0 end) * 10 as double) + cast(i * 7919 % 9973 as double) / 1000.0 as x,
  cast(floor(i / 300.0) * 10 as double) + cast(i * 6007 % 9967 as double) / 1000.0 as y
from (select o_orderkey as i from orders) t
""",
    "v_public": """
select s_suppkey as label_id, concat('道-', cast(s_suppkey as string)) as label,
  cast((5 + 6 * (s_suppkey % 3)) * 10.0 + 4.5 as double) as x, cast(floor(s_suppkey / 2.0) * 10.0 + 5.5 as double) as y
from supplier
""",
    "v_dem": """
select cast(floor(p_partkey / 40.0) as int) as r, cast(p_partkey % 40 as int) as c,
  case when p_partkey % 97 = 0 then null else p_size + p_retailprice / 100 end as elev
from part
""",
    "v_zones": """
select k as zone_id, j as place, cast(139000 + (k * 17) % 100 + (k * 7 + j * 13 + j * j * 5) % 41 - 20 as double) / 1000.0 as lon, cast(35900 + (k * 29) % 100 + (k * 11 + j * 19 + j * j * 3) % 37 - 18 as double) / 1000.0 as lat
from (select c_custkey as k from customer) c cross join (select 0 as j union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6) q where j < 3 + k % 5
""",
    "v_snap_a": """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders where o_orderkey % 10 <> 0
""",
    "v_snap_b": """
select o_orderkey, o_custkey,
  case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as o_orderstatus,
  case when o_orderkey % 11 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice
from orders where o_orderkey % 10 <> 1
""",
    "v_seq": """
select event_id as line_idx, cast(floor(event_id / 500.0) as int) as file_no, cast(floor(event_id / 20.0) as int) as page,
  case event_type when 'signup' then '続' when 'error' then '続更新' when 'view' then '続表題' else cast(event_id as string) end as entry,
  case when event_type = 'purchase' and event_id % 4 = 0 then '' when event_type in ('click','purchase','view') then concat(cast(user_id as string), '番', cast(event_id % 50 as string)) else '' end as parcel_no,
  case when event_type = 'signup' then '' else cast(cast(floor(value) as int) as string) end as area,
  concat('N', cast(user_id % 40 as string)) as owner_name
from events
""",
    "v_scans": """
select event_id as line_idx, cast(floor(event_id / 90.0) as int) as file_no, cast(floor(event_id / 7.0) as int) as page,
  case when event_id % 5 = 0 then '続表題' when event_type = 'signup' then '続' when event_type = 'error' then '続更新' else cast(user_id % 60 as string) end as entry,
  case when user_id % 3 = 0 or event_id % 4 = 0 then '' else concat(cast(user_id % 50 as string), '番', cast(event_id % 6 as string)) end as parcel_no,
  case when event_id % 3 = 0 then '' else cast(event_id % 90 as string) end as area,
  concat('N', cast(user_id % 40 as string)) as owner_name
from events
""",
    "v_numseq": """
select distinct l_orderkey as n, cast(floor(l_orderkey / 5000.0) as int) as file_no from lineitem
""",
    "v_text": """
select p_partkey as id,
  translate(concat(cast(p_partkey % 1500 as string), case when p_partkey % 3 = 0 then '－' when p_partkey % 3 = 1 then '番の' else '-' end, cast(p_size as string)), '0123456789', '０１２３４５６７８９') as parcel_raw,
  concat(cast(p_size as string), case when p_partkey % 2 = 0 then '・' else '.' end, cast(p_partkey % 10 as string), '0') as area_raw,
  concat(case when p_partkey % 4 = 0 then '髙' else '高' end, case when p_partkey % 5 = 0 then ' 澤' else '沢' end, p_name) as name_raw,
  case p_partkey % 6 when 0 then concat('-', cast(p_size as string), '.', cast(p_partkey as string)) when 1 then concat('交', cast(p_size as string), '.001') when 2 then concat(cast(p_partkey as string), '-', cast(p_size as string)) when 3 then '県道-5' when 4 then '山林' else p_name end as cad_text
from part
""",
    "v_records": """
select o_orderkey as property_id, o_orderkey * 100 as line_idx, cast(o_orderkey as string) as f0, '物件情報' as f1, o_orderpriority as f2, o_orderstatus as f3, concat('地区', cast(o_custkey % 20 as string)) as f4,
  concat(cast(o_orderkey as string), '-', cast(o_orderkey % 9 as string)) as f5, concat('R', cast(o_custkey as string)) as f6, '' as f7, '' as f8, concat('字', cast(o_custkey % 3 as string)) as f9, cast(o_custkey % 90 as string) as f10 from orders
union all
select o_orderkey, o_orderkey * 100 + 1, '', '所在地', concat('北市地区', cast(o_custkey % 20 as string)), '', '', '', '', '', '', '', '' from orders where o_orderkey % 4 = 0
union all
select o_orderkey, o_orderkey * 100 + 2, '', '所在地', '', '', '', '', '', '', '', '', '' from orders where o_orderkey % 12 = 0
union all
select l_orderkey, l_orderkey * 100 + 2 + n, '', '表示履歴', case when n = 1 and l_orderkey % 3 = 0 then '' else concat(cast(l_orderkey as string), '番', cast(l_orderkey % 9 as string)) end, '',
  case when l_returnflag = 'R' then concat('【', l_linestatus, '】') when l_returnflag = 'A' and l_partkey % 5 = 0 then concat('[', l_linestatus, ']') else l_linestatus end,
  cast(cast(l_quantity as int) as string), concat('登記', cast(l_suppkey as string)), '', '', '', '' from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as n from lineitem) t
union all
select o_orderkey, o_orderkey * 100 + 90, '', '所有権', concat('A', cast(c_nationkey as string)), case when o_orderkey % 6 = 0 then '持分2分の1' else '' end, c_name, '', c_mktsegment, concat('第', cast(o_orderkey % 50 as string), '号'), '', '', '' from orders join customer on c_custkey = o_custkey
union all
select o_orderkey, o_orderkey * 100 + 91, '', '所有者', concat('P', cast(o_custkey % 7 as string)), '', '', '', '', '', '', '', '' from orders where o_orderkey % 6 = 0
""",
    "v_boxes": """
select event_id as box_id, cast(floor(event_id / 50.0) as int) as page, cast((event_id * 37) % 500 as double) as y_top, cast((event_id * 71) % 900 as double) as x_left,
  event_type as text, (event_id * 13 % 100) / 100.0 as conf from events
""",
    "v_entities": """
select 1 as drawing_id, stake_id as ord, 'CIRCLE' as etype, layer, x as x1, y as y1, cast(null as double) as x2, cast(null as double) as y2,
  case when stake_id % 41 = 0 then 0.5 else 0.25 end as radius, cast(null as string) as text, cast(null as bigint) as n_points from v_stakes
union all
select 1, 10000000 + stake_id, 'MTEXT', layer, x + 0.4, y + 0.3, null, null, null, number, null from v_stakes where number is not null
union all
select 1, 20000000 + line_id, 'LWPOLYLINE', '_9-0_', x1, y1, x2, y2, null, null, case when line_id % 29 = 4 then 3 else 2 end from v_lines
union all
select 1, 30000000 + label_id, 'MTEXT', '53', x, y, null, null, null, number, null from v_labels
""",
    "v_plan": """
select 2 as drawing_id, stake_id as ord, 'CIRCLE' as etype, case when stake_id % 37 = 5 then '_f-8_' else layer end as layer, x * 10 as x1, y * 10 as y1, cast(null as double) as x2, cast(null as double) as y2,
  case when stake_id % 5 = 0 then 1.5 else 2.5 end as radius, cast(null as string) as text, cast(null as bigint) as n_points from v_stakes
union all
select 2, 10000000 + stake_id, 'TEXT', case when stake_id % 31 = 3 then '_9-1_' else layer end, x * 10 + 8, y * 10 + 6, null, null, null, number, null from v_stakes where number is not null
union all
select 2, 20000000 + line_id, 'LINE', case when line_id % 19 = 4 then '_f-0_' else '1' end, x1 * 10 + 0.1 - case when line_id % 2 = 0 then 1 else 0 end, y1 * 10, x2 * 10, y2 * 10 + case when line_id % 2 = 0 then 1 else 0 end, null, null, null from v_lines
union all
select 2, 30000000 + label_id, 'TEXT', '4', x * 10, y * 10, null, null, null, number, null from v_labels
union all
select 2, 40000000 + label_id, 'TEXT', case when label_id % 11 = 3 then '_f-0_' else '5' end, x * 10 + (label_id % 17) * 10, y * 10, null, null, null, case when label_id % 2 = 0 then '山林' else '宅地' end, null from v_labels where label_id % 3 = 0
union all
select 2, 50000000 + label_id, 'TEXT', '6', x * 10, y * 10, null, null, null, label, null from v_public
""",
    "v_sheet_stakes": """
select 100 + d as drawing_id, k as stake_id, case when k % 23 = 7 then null else concat(case when k % 11 in (0, 8) then '-' else '' end, cast(k % 9 + 1 as string), '.', lpad(cast(k as string), 6, '0')) end as number,
  x * case when d % 2 = 1 then 10 else 1 end as x, (y - d * 30) * case when d % 2 = 1 then 10 else 1 end as y, layer
from (select stake_id % 90 as k, cast(floor(stake_id / 90.0) as int) as d, x, y, layer from v_stakes) a
union all
select 100 + d, 1000 + m * 8 + k, case when m % 6 in (2, 3, 4) and (k < 4 or k = 7) then null else concat('7.', cast(900000 + m * 8 + k as string)) end,
  (1000.0 + 100 * m + case when k < 4 then case when k in (1, 2) then 40 else 0 end when k in (5, 6) then 30 else 10 end) * case when d % 2 = 1 then 10 else 1 end,
  (cast(case when k < 4 then case when k in (2, 3) then 40 else 0 end when k in (6, 7) then 30 else 10 end as double)) * case when d % 2 = 1 then 10 else 1 end, '1'
from (select cast(floor(s_suppkey / 2.0) as int) as m, cast(s_suppkey % 2 as int) as d from supplier) s cross join (select 0 as k union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6 union all select 7) q
""",
    "v_sheet_lines": """
select a.drawing_id, a.stake_id * 2 as line_id, a.x + 0.1 as x1, a.y as y1, b.x as x2, b.y - 0.1 as y2 from v_sheet_stakes a join v_sheet_stakes b on b.drawing_id = a.drawing_id and b.stake_id = a.stake_id + 1
where a.stake_id < 1000 and a.stake_id % 30 < 29 and a.stake_id % 13 <> 5
union all
select a.drawing_id, a.stake_id * 2 + 1, a.x, a.y, b.x, b.y from v_sheet_stakes a join v_sheet_stakes b on b.drawing_id = a.drawing_id and b.stake_id = a.stake_id + 30
where b.stake_id < 1000 and a.stake_id % 17 <> 3
union all
select a.drawing_id, a.stake_id * 2, a.x, a.y + 0.2, b.x, b.y from v_sheet_stakes a join v_sheet_stakes b on b.drawing_id = a.drawing_id
  and b.stake_id = a.stake_id + case when a.stake_id % 4 = 3 then -3 else 1 end where a.stake_id >= 1000
""",
    "v_sheet_labels": """
select 100 + d as drawing_id, label_id, number, x * case when d % 2 = 1 then 10 else 1 end as x, (y - d * 30) * case when d % 2 = 1 then 10 else 1 end as y
from (select label_id, number, x, y, cast(floor(y / 30.0) as int) as d from v_labels where label_id % 3 <> 1) a
union all
select 100 + d, 100000000 + m * 10 + j, case when m % 6 = 0 then concat('8-', cast(m as string)) when j = 1 or m % 6 = 5 then '5-0' when m % 6 = 3 then '7-8' else '7-7' end,
  (1000.0 + 100 * m + 20 + j) * case when d % 2 = 1 then 10 else 1 end, (20.0 + j) * case when d % 2 = 1 then 10 else 1 end
from (select cast(floor(s_suppkey / 2.0) as int) as m, cast(s_suppkey % 2 as int) as d from supplier) s cross join (select 0 as j union all select 1) q where m % 6 <> 1 and (j = 0 or m % 6 = 3)
""",
    "v_sheet_public": """
select 100 + d as drawing_id, 200000000 + m as label_id, concat('道-', cast(m + 1 as string)) as label, (1000.0 + 100 * m + 20) * case when d % 2 = 1 then 10 else 1 end as x, 20.0 * case when d % 2 = 1 then 10 else 1 end as y
from (select cast(floor(s_suppkey / 2.0) as int) as m, cast(s_suppkey % 2 as int) as d from supplier) s where m % 6 = 1
""",
    "v_sheets": """
select drawing_id, cast(stake_id as bigint) as ord, 'CIRCLE' as etype, layer, x as x1, y as y1, cast(null as double) as x2, cast(null as double) as y2, case when drawing_id % 2 = 1 then 2.5 else 0.25 end as radius, cast(null as string) as text, cast(null as bigint) as n_points from v_sheet_stakes
union all
select drawing_id, 1000000 + stake_id, case when drawing_id % 2 = 1 then 'TEXT' else 'MTEXT' end, layer, x + 0.4 * case when drawing_id % 2 = 1 then 10 else 1 end, y + 0.3, null, null, null, number, null from v_sheet_stakes where number is not null
union all
select drawing_id, 2000000 + line_id, case when drawing_id % 2 = 1 then 'LINE' else 'LWPOLYLINE' end, '2', x1, y1, x2, y2, null, null, 2 from v_sheet_lines
union all
select drawing_id, 1000000000 + label_id, case when drawing_id % 2 = 1 then 'TEXT' else 'MTEXT' end, '4', x, y, null, null, null, number, null from v_sheet_labels
union all
select drawing_id, 1000000000 + label_id, case when drawing_id % 2 = 1 then 'TEXT' else 'MTEXT' end, '6', x, y, null, null, null, label, null from v_sheet_public
""",
    "v_ocr": """
select o_orderkey as line_idx, cast(floor(o_orderkey / 30.0) as int) as page, cast(o_orderkey as string) as entry,
  concat(cast(o_orderkey as string), case when o_orderkey % 2 = 0 then '番の' else '-' end, cast(o_orderkey % 9 as string)) as parcel_no, case when o_orderkey % 3 = 0 then '' else '南市' end as location,
  case when o_orderkey % 9 = 0 then '(空)' else o_orderstatus end as land_use,
  case when o_orderkey % 4 = 0 then cast(cast(floor(o_totalprice) as bigint) as string) else concat(cast(cast(floor(o_totalprice) as bigint) as string), '.50') end as area,
  case when o_orderkey % 8 = 1 then c_name when o_orderkey % 8 = 2 then '' else concat(c_mktsegment, '市1番地') end as addr,
  case when o_orderkey % 8 = 2 then c_name when o_orderkey % 8 = 3 then '持分2分の1' else '' end as share,
  case when o_orderkey % 8 in (1, 2) then '' when o_orderkey % 8 = 4 then '昭和10年5月1日受付 第12号' else c_name end as name,
  case when o_orderkey % 8 = 5 then '平成2年1月1日受付 第7号' else '' end as receipt
from orders join customer on c_custkey = o_custkey where o_orderkey % 7 <> 3
""",
    "v_geo": """
select c_custkey as id, cast(35.0 + (c_custkey % 200) / 100.0 as double) as lat, cast(135.0 + (c_custkey % 700) / 100.0 as double) as lon, 10 + c_custkey % 6 as zoom from customer
""",
    "v_tiles": """
select cast(p_partkey % 50 as int) as tx, cast(floor(p_partkey / 50.0) as int) as ty, prio,
  case when (p_partkey + prio) % 3 = 0 then '' else concat(cast(p_size as string), ',e,', cast(p_partkey % 90 as string)) end as body,
  case when p_partkey % 50 = 0 then 128 else cast(p_partkey * 7 % 256 as int) end as red,
  case when p_partkey % 50 = 0 then 0 else cast(p_partkey * 11 % 256 as int) end as green,
  case when p_partkey % 50 = 0 then 0 else cast(p_partkey * 13 % 256 as int) end as blue
from part cross join (select 0 as prio union all select 1) p
""",
    "v_runs": """
select event_type as model, event_id as page, value as elapsed, cast(user_id * 10 as bigint) as input_tokens, cast(user_id * 3 as bigint) as output_tokens, event_id % 17 = 0 as failed from events
""",
}


def _needed(names: tuple[str, ...]) -> list[str]:
    """The named views and those that they read, in the order of definition."""
    wanted = set(names)
    for name in reversed(VIEWS):
        if name in wanted:
            wanted |= {v for v in VIEWS if v != name and v in VIEWS[name]}
    return [v for v in VIEWS if v in wanted]


_registered: dict[str, tuple] = {}


def register(spark: SparkSession, sf_dir: str) -> None:
    """Make the base tables and the views of a folder available to SQL; done once for a session and folder."""
    state = (spark.sparkContext.applicationId, spark._jsparkSession.hashCode(), sf_dir)
    if _registered.get("state") != state:
        for name in BASE:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        for name, sql in VIEWS.items():
            spark.sql(sql).createOrReplaceTempView(name)
        _registered["state"] = state


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the tables of a folder."""
    register(spark, sf_dir)
    broadcast_by_measure(spark)
    return spark.table(name)


def with_views(body: str, *names: str) -> str:
    """SQL text with the named views (and those that they read) as common table expressions in front; body may start with more."""
    heads = [f"{v} as ({VIEWS[v].strip()})" for v in _needed(names)]
    return "with recursive " + ",\n".join(heads) + (",\n" if not body.lstrip().lower().startswith("select") else "\n") + body

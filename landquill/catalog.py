"""The registered queries of the library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import blocks, boxes, diff, drawing, entities, faces, layout, raster, reconcile, sequence, spatial, traverse
from .operators.graph import many_parts_here, materialise
from .plans.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str = "", *views: str):
    """Register a query under its function's name, with SQL over the named views if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql, *views)
        return f

    return add


def c(name: str):
    return F.col(name)


# snapshots

_DIFF = """
d as (select coalesce(a.o_orderkey, b.o_orderkey)::varchar as o_orderkey, coalesce(a.o_custkey, b.o_custkey)::varchar as o_custkey, a.o_orderkey is not null as in_a, b.o_orderkey is not null as in_b,
  a.o_orderstatus as s1, b.o_orderstatus as s2, a.o_totalprice::varchar as p1, b.o_totalprice::varchar as p2
  from v_snap_a a full join v_snap_b b on a.o_orderkey = b.o_orderkey and a.o_custkey = b.o_custkey),
diff as (
  select o_orderkey, o_custkey, 'only_a' as kind, '' as "column", to_json({'o_orderstatus': s1, 'o_totalprice': p1})::varchar as value from d where not in_b
  union all select o_orderkey, o_custkey, 'only_b', '', to_json({'o_orderstatus': s2, 'o_totalprice': p2})::varchar from d where not in_a
  union all select o_orderkey, o_custkey, 'changed', 'o_orderstatus', s1 || ' → ' || s2 from d where in_a and in_b and s1 <> s2
  union all select o_orderkey, o_custkey, 'changed', 'o_totalprice', p1 || ' → ' || p2 from d where in_a and in_b and p1 <> p2)
"""


@query(_DIFF + "select * from diff", "v_snap_a", "v_snap_b")
def diff_keyed(spark, sf_dir):
    return diff.keyed_diff(view(spark, sf_dir, "v_snap_a"), view(spark, sf_dir, "v_snap_b"))


@query(
    """select *, 'A' as side from (select o_orderkey::varchar as o_orderkey, o_orderstatus from v_snap_a except select o_orderkey::varchar, o_orderstatus from v_snap_b)
    union all select *, 'B' from (select o_orderkey::varchar, o_orderstatus from v_snap_b except select o_orderkey::varchar, o_orderstatus from v_snap_a)""",
    "v_snap_a",
    "v_snap_b",
)
def diff_setwise(spark, sf_dir):
    a, b = (view(spark, sf_dir, v).select("o_orderkey", "o_orderstatus") for v in ("v_snap_a", "v_snap_b"))
    return diff.set_diff(a, b)


@query(_DIFF + 'select kind, "column", count(*) as n from diff group by all', "v_snap_a", "v_snap_b")
def diff_summary(spark, sf_dir):
    return diff.diff_summary(diff_keyed(spark, sf_dir))


@query(
    """a as (select distinct name_raw, area_raw from v_text where id % 5 <> 0), b as (select distinct name_raw, case when id % 7 = 0 then '0' else area_raw end as area_raw from v_text where id % 5 <> 1)
    select name_raw, area_raw, 'only_a' as kind, '' as "column", '' as value from (select * from a except select * from b) union all select name_raw, area_raw, 'only_b', '', '' from (select * from b except select * from a)""",
    "v_text",
)
def diff_no_key(spark, sf_dir):
    """Tables without a column that reads as a key: all columns are."""
    rows = view(spark, sf_dir, "v_text")
    older, newer = rows.where("id % 5 <> 0").select("name_raw", "area_raw"), rows.where("id % 5 <> 1").select("name_raw", F.when(c("id") % 7 == 0, "0").otherwise(c("area_raw")).alias("area_raw"))
    return diff.keyed_diff(older, newer)


# registry exports

_STRIP = "trim(regexp_replace({0}, '[【】\\[\\]]', '', 'g'))"
_IS_OLD = "regexp_matches({0}, '[【】\\[\\]]')"
_KEY = "regexp_replace(replace({0}, '番の', '番'), '番$', '')"


def _rollup(p: str, cells: dict[str, str], where: str, source: bool = False) -> str:
    """SQL of the roll-up as table p, and as table p_k with its key; cells: expressions that replace cells."""
    f = ", ".join(f"{cells.get(f'f{i}', f'f{i}')} as f{i}" for i in range(11))
    is_old = (lambda x: f"regexp_matches({x}, '[【】]')") if source else _IS_OLD.format
    now = lambda x: f"coalesce(arg_max({_STRIP.format(x)}, line_idx) filter (f1 like '表示履歴%' and {_STRIP.format(x)} <> '' and not {is_old(x)}), '')"
    full = "f1 like '所在%' and f2 <> ''" if source else "f1 like '所在%'"
    place = "o4" if source else "o4 || o9"
    parcel = "coalesce(shown, o5)" if source else "regexp_replace(coalesce(shown, o5), '([0-9]+)-([0-9]+)', '\\1番\\2', 'g')"
    one = ", ".join(f"any_value(f{i}) filter (f1 = '物件情報') as o{i}" for i in (0, 2, 3, 4, 5, 6, 9, 10))
    owner = "{'address': case when f1 like '所有者%' then '' else f2 end, 'share': case when f1 like '所有者%' then '' else f3 end, 'name': case when f1 like '所有者%' then f2 else f4 end, 'registration': case when f1 like '所有者%' then '' else f6 end, 'reference': case when f1 like '所有者%' then '' else f7 end}"
    return f"""
{p}_all as (select property_id, line_idx, {f} from v_records where {where}),
{p}_g as (select {one}, coalesce(arg_max(f2, line_idx) filter ({full}), '') as full_place, arg_min(f2, line_idx) filter (f1 like '表示履歴%' and f2 <> '') as shown, {now('f4')} as land_use, {now('f5')} as area,
  list(f2 || '|' || f4 || '|' || f5 || '|' || f6 || '|' || f7 order by line_idx) filter (f1 like '表示履歴%') as history, list({owner} order by line_idx) filter (f1 like '所有%') as owners,
  list({_STRIP.format('f4')} order by line_idx) filter (f1 like '表示履歴%' and {is_old('f4')}) as olds from {p}_all group by property_id),
{p} as (select o0 as number, o2 as kind, o3 as status, case when full_place <> '' then full_place else {place} end as location, {parcel} as parcel_no, o6 as real_estate_no, o10 as city_code, land_use, area, coalesce(history, []) as history, coalesce(owners, []) as owners, coalesce(olds, []) as olds from {p}_g),
{p}_k as (select location || '|' || {_KEY.format('parcel_no')} as key, * from {p})
"""


_OWNER = "concat_ws(' / ', nullif(o['name'], ''), nullif(o['share'], ''), nullif(o['address'], ''), nullif(o['registration'], ''), nullif(o['reference'], ''))"
_OLD = ({}, "property_id % 13 <> 1")
_NEW = (
    {
        "f2": "case when f1 = '物件情報' and property_id % 17 = 0 then 'K' when f1 = '所有権' and property_id % 31 = 0 then concat(f2, '-1') else f2 end",
        "f3": "case when f1 = '物件情報' and property_id % 19 = 0 then '閉鎖' when f1 = '所有権' and property_id % 37 = 0 then '持分3分の1' else f3 end",
        "f4": "case when f1 = '所有権' and property_id % 5 = 0 then concat(f4, 'X') when f1 = '表示履歴' and property_id % 3 = 0 and f4 = 'O' then 'F' else f4 end",
        "f5": "case when f1 = '表示履歴' and property_id % 7 = 0 then concat(f5, '.50') when f1 = '表示履歴' and property_id % 7 = 1 then concat(f5, '.0') else f5 end",
        "f6": "case when f1 = '物件情報' and property_id % 23 = 0 then concat(f6, '9') else f6 end",
        "f10": "case when f1 = '物件情報' and property_id % 29 = 0 then concat(f10, '1') else f10 end",
    },
    "property_id % 11 <> 0",
)


def _records(spark, sf_dir, version):
    cells, where = {"old": _OLD, "new": _NEW, "base": ({}, "true")}[version]
    fields = F.array(*[F.expr(cells.get(f"f{i}", f"f{i}")) for i in range(11)])
    return view(spark, sf_dir, "v_records").where(where).select(F.lit(version).alias("file"), "line_idx", fields.alias("fields"))


def _properties(spark, sf_dir, version, dialect="registry"):
    return diff.rollup_records(_records(spark, sf_dir, version), dialect=dialect)


_SHOWN = f"number, location, parcel_no, land_use, area, len(history) as n_history, array_to_string(list_transform(owners, lambda o: {_OWNER}), '; ') as owners, len(owners) as n_owners, array_to_string(olds, ',') as old_land_uses"


def _shown_columns():
    owners = F.array_join(F.transform("owners", diff.owner_text), "; ")
    return ["number", "location", "parcel_no", "land_use", "area", F.size("history").cast("long").alias("n_history"), owners.alias("owners"), F.size("owners").cast("long").alias("n_owners"), F.array_join("old_land_uses", ",").alias("old_land_uses")]


@query(_rollup("r", {}, "true") + f"select kind, status, real_estate_no, city_code, {_SHOWN} from r", "v_records")
def registry_rollup(spark, sf_dir):
    return _properties(spark, sf_dir, "base").select("kind", "status", "real_estate_no", "city_code", *_shown_columns())


_BRANCH = "regexp_replace({0}, '([0-9]+)-([0-9]+)', '\\1番\\2', 'g')"
_SOURCE_KEY = _KEY.format(_BRANCH.format("parcel_no"))


@query(_rollup("r", {}, "true", source=True) + f"select {_SOURCE_KEY} as key, {_SHOWN} from r", "v_records")
def source_rollup(spark, sf_dir):
    rows = diff.by_parcel(_properties(spark, sf_dir, "base", "source"))
    return rows.select("key", *_shown_columns())


def _keyed(spark, sf_dir, version):
    return diff.tracked(_properties(spark, sf_dir, version))


_FIELDS = (("種別", "kind"), ("状態", "status"), ("不動産番号", "real_estate_no"), ("市区町村コード等", "city_code"), ("地目", "land_use"))
_AREA = "case when {0} like '%.%' then rtrim(rtrim({0}, '0'), '.') else {0} end"
_REGISTRY_DIFF = (
    _rollup("o", *_OLD)
    + ","
    + _rollup("n", *_NEW)
    + """,
j as (select coalesce(o_k.key, n_k.key) as key, o_k.key is not null as in_o, n_k.key is not null as in_n, coalesce(n_k.location, o_k.location) as location, coalesce(n_k.parcel_no, o_k.parcel_no) as parcel_no,
  concat_ws(' / ', o_k.location, o_k.parcel_no, nullif(o_k.land_use, ''), nullif(o_k.area, '')) as t1, concat_ws(' / ', n_k.location, n_k.parcel_no, nullif(n_k.land_use, ''), nullif(n_k.area, '')) as t2,
  o_k.history as h1, n_k.history as h2, o_k.owners as w1, n_k.owners as w2, o_k.area as area_1, n_k.area as area_2, """
    + ", ".join(f"o_k.{x} as {x}_1, n_k.{x} as {x}_2" for _, x in _FIELDS)
    + """ from o_k full join n_k on o_k.key = n_k.key),
"""
    + ",\n".join(
        f"w{i} as (select key, case when o['name'] <> '' then o['name'] else '__blank_' || i end as who, list(o['address'] || '|' || o['share'] || '|' || o['name'] || '|' || o['registration'] || '|' || o['reference']) as sigs, list({_OWNER} order by i) as shown from (select key, unnest(w{i}) as o, generate_subscripts(w{i}, 1) - 1 as i from j where in_o and in_n) group by 1, 2)"
        for i in (1, 2)
    )
    + """,
w as (select coalesce(w1.key, w2.key) as key, coalesce(w1.who, w2.who) as who, w1.shown as s1, w2.shown as s2 from w1 full join w2 on w1.key = w2.key and w1.who = w2.who where w1.who is null or w2.who is null or list_sort(w1.sigs) <> list_sort(w2.sigs)),
rows_ as (
  select key, 0 as ord, '' as who, 0 as i, '追加' as kind, '物件' as item, '' as old_value, t2 as new_value, '' as note from j where not in_o
  union all select key, 0, '', 0, '削除', '物件', t1, '', '' from j where not in_n
"""
    + "".join(f"  union all select key, {n}, '', 0, '変更', '{item}', {x}_1, {x}_2, '' from j where in_o and in_n and {x}_1 <> {x}_2\n" for n, (item, x) in zip((1, 2, 5, 6, 7), _FIELDS, strict=True))
    + f"""  union all select key, 8, '', 0, '変更', '地積', area_1, area_2, '' from j where in_o and in_n and {_AREA.format('area_1')} <> {_AREA.format('area_2')}
  union all select key, 9, '', 0, '変更', '表示履歴', array_to_string(h1, chr(10)), array_to_string(h2, chr(10)), '履歴行の追加・削除・内容変更があります' from j where in_o and in_n and list_sort(h1) <> list_sort(h2)
  union all select key, 10, who, 0, '変更', '所有者', array_to_string(s1, chr(10)), array_to_string(s2, chr(10)), '' from w where s1 is not null and s2 is not null
  union all select key, 10, who, generate_subscripts(s2, 1), '追加', '所有者', '', unnest(s2), '' from w where s1 is null
  union all select key, 10, who, generate_subscripts(s1, 1), '削除', '所有者', unnest(s1), '', '' from w where s2 is null),
rd as (select key, row_number() over (partition by key order by ord, who, i) - 1 as item_ord, kind, location, parcel_no, item, old_value, new_value, note from rows_ join j using (key))
"""
)


@query(_REGISTRY_DIFF + "select * from rd", "v_records")
def registry_diff(spark, sf_dir):
    return diff.registry_diff(_keyed(spark, sf_dir, "old"), _keyed(spark, sf_dir, "new"))


@query(
    _REGISTRY_DIFF + "select 'new' as old_file, 'old' as new_file, (select count(*) from n_k) as n_old, (select count(*) from o_k) as n_new, count(*) as n_diffs, count(*) filter (kind = '削除') as added, count(*) filter (kind = '追加') as deleted, count(*) filter (kind = '変更') as changed from rd",
    "v_records",
)
def registry_diff_pairs(spark, sf_dir):
    return diff.registry_diff_all_pairs(_properties(spark, sf_dir, "old").unionByName(_properties(spark, sf_dir, "new")))


@query(
    _rollup("r", {}, "true")
    + """p as (select 'f' || k as file, k, number::bigint as n, case when number::bigint % 5 = k % 4 then 'X' || k % 3 else land_use end as u from r cross join range(10) t(k) where number::bigint % 11 <> k),
    c as (select file, count(*) as n from p group by 1),
    m as (select a.file as old_file, b.file as new_file, count(*) as shared, count(*) filter (a.u <> b.u) as changed from p a join p b on a.n = b.n and a.file < b.file group by all)
    select old_file, new_file, a.n as n_old, b.n as n_new, a.n + b.n - 2 * shared + changed as n_diffs, b.n - shared as added, a.n - shared as deleted, changed from m join c a on a.file = old_file join c b on b.file = new_file""".replace("p as", ", p as", 1),
    "v_records",
)
def registry_diff_ten_files(spark, sf_dir):
    """All pairs of ten exports, of which each lacks some properties and has other land uses."""
    n = c("number").cast("long")
    files = _properties(spark, sf_dir, "base").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).where(n % 11 != c("k"))
    use = F.when(n % 5 == c("k") % 4, F.concat(F.lit("X"), (c("k") % 3).cast("string"))).otherwise(c("land_use"))
    return diff.registry_diff_all_pairs(files.withColumn("file", F.concat(F.lit("f"), c("k").cast("string"))).withColumn("land_use", use))


# texts

_WIDE = f"'{tx.WIDE.replace(chr(39), chr(39) * 2)}', '{tx.NARROW.replace(chr(39), chr(39) * 2)}'"


def _fold(x: str) -> str:
    return f"translate({x}, {_WIDE})"


@query(f"select id, {_fold('parcel_raw')} as parcel, {_fold('area_raw')} as area, {_fold('name_raw')} as name from v_text", "v_text")
def text_width_fold(spark, sf_dir):
    return view(spark, sf_dir, "v_text").select("id", tx.width_fold(c("parcel_raw")).alias("parcel"), tx.width_fold(c("area_raw")).alias("area"), tx.nfkc(c("name_raw")).alias("name"))


_PARCEL = f"regexp_replace(replace(regexp_replace(translate({_fold('parcel_raw')}, '－ー—', '---'), '([0-9]+)-([0-9]+)', '\\1番\\2', 'g'), '番の', '番'), '番$', '')"


@query(f"select id, {_PARCEL} as key from v_text", "v_text")
def parcel_key(spark, sf_dir):
    return view(spark, sf_dir, "v_text").select("id", tx.parcel_key(c("parcel_raw")).alias("key"))


@query(f"select id, rtrim(rtrim(replace({_fold('area_raw')}, '・', '.'), '0'), '.') as area from v_text", "v_text")
def area_norm(spark, sf_dir):
    return view(spark, sf_dir, "v_text").select("id", tx.area(c("area_raw")).alias("area"))


_FORM = f"replace(translate(replace(name_raw, ' ', ''), '{tx.OLD_FORMS}', '{tx.NEW_FORMS}'), 'シヨ', 'ショ')"


@query(f"select id, {_FORM} as folded, replace(name_raw, ' ', '') <> replace(replace(replace(name_raw, ' ', ''), '髙', '高'), '澤', '沢') as variant from v_text", "v_text")
def variant_fold(spark, sf_dir):
    plain = F.replace(F.replace(c("name_raw"), F.lit("髙"), F.lit("高")), F.lit("澤"), F.lit("沢"))
    return view(spark, sf_dir, "v_text").select("id", tx.old_form_fold(tx.name_key(c("name_raw"))).alias("folded"), tx.same_but_for_form(c("name_raw"), plain).alias("variant"))


@query("select line_idx, case when trim(land_use) in ('(空)', '（空）', '(空欄)', '（空欄）', '-', '―') then '' else trim(land_use) end as land_use from v_ocr", "v_ocr")
def empty_marker(spark, sf_dir):
    return view(spark, sf_dir, "v_ocr").select("line_idx", tx.without_marker(c("land_use")).alias("land_use"))


@query("select stake_id, nullif(regexp_extract(coalesce(number, ''), '^[-交既復計]?([0-9]+)\\.', 1), '') as block, coalesce(number, '') like '-%' or coalesce(number, '') like '交%' as is_intersection from v_stakes", "v_stakes")
def block_number(spark, sf_dir):
    return view(spark, sf_dir, "v_stakes").select("stake_id", tx.block_number(c("number")).alias("block"), tx.is_intersection(c("number")).alias("is_intersection"))


@query(f"select id, case when regexp_full_match({_fold('parcel_raw')}, '[0-9]+([-番の]+[0-9]+)*') then array_to_string(list_transform(regexp_extract_all({_fold('parcel_raw')}, '[0-9]+'), lambda x: x::bigint), ',') end as key from v_text", "v_text")
def natural_sort(spark, sf_dir):
    # one small file holds many rows: dealt out, for the keys are the work
    texts = view(spark, sf_dir, "v_text").select("id", "parcel_raw").repartition("id")
    out = layout.in_parcel_order(texts, c("parcel_raw"), "id")
    return out.select("id", F.array_join(F.transform("_key", lambda x: x.cast("string")), ",").alias("key"))


@query("select id, case id % 4 when 0 then '髙橋' when 1 then chr((12353 + id % 80)::int) || 'x' when 2 then '〓' else name_raw end as decoded from v_text", "v_text")
def gaiji(spark, sf_dir):
    coded = F.expr("case id % 4 when 0 then '<00009AD9>橋' when 1 then concat('<', lpad(hex(12353 + id % 80), 8, '0'), '>x') when 2 then '<00000000>' else name_raw end")
    return view(spark, sf_dir, "v_text").select("id", tx.decode_codes(coded).alias("decoded"))


_CLASS = "case when regexp_full_match({0}, '(-|交)[0-9]+\\.[0-9]+') then 'intersection_stake' when regexp_full_match({0}, '[0-9]+\\.[0-9]+') then 'stake' when regexp_full_match({0}, '[0-9]+(-[0-9]+)?') then 'parcel_number' when regexp_matches({0}, '^(県道|河川|市道|国道|水|道)-') then 'public_land' when {0} in ('宅地', '山林') then 'land_use' else 'other' end"


@query(f"select id, {_CLASS.format('trim(cad_text)')} as category from v_text", "v_text")
def classify_text(spark, sf_dir):
    return view(spark, sf_dir, "v_text").select("id", tx.classify(c("cad_text"), plain=True).alias("category"))


@query("select id, case id % 3 when 0 then name_raw when 1 then cad_text || chr(10) || 'x' else area_raw end as cleaned from v_text", "v_text")
def mtext_clean(spark, sf_dir):
    coded = F.when(c("id") % 3 == 0, F.concat(F.lit("{\\fMS Gothic|b0;\\H2.5;"), "name_raw", F.lit("}"))).when(c("id") % 3 == 1, F.concat("cad_text", F.lit("\\Px"))).otherwise(F.concat(F.lit("\\C3;"), "area_raw"))
    return view(spark, sf_dir, "v_text").select("id", tx.clean_mtext(coded).alias("cleaned"))


@query(f"select line_idx, {_IS_OLD.format('f4')} as is_old, {_STRIP.format('f4')} as bare from v_records where f1 = '表示履歴'", "v_records")
def old_marks(spark, sf_dir):
    return view(spark, sf_dir, "v_records").where("f1 = '表示履歴'").select("line_idx", tx.is_old_value(c("f4")).alias("is_old"), tx.strip_old_marks(c("f4")).alias("bare"))


_ADDR = f"(length({{0}}) >= 4 and regexp_matches({{0}}, '{tx.ADDRESS}'))"


@query(f"select line_idx, {_ADDR.format('addr')} as is_address, addr <> '' and not {_ADDR.format('addr')} and length(addr) <= 30 as is_name from v_ocr", "v_ocr")
def address_name(spark, sf_dir):
    return view(spark, sf_dir, "v_ocr").select("line_idx", tx.looks_like_address(c("addr")).alias("is_address"), tx.looks_like_name(c("addr")).alias("is_name"))


# scanned lines

_RAW = "concat_ws(',', entry, '', parcel_no, land_use, area, addr, share, name, receipt)"


@query(
    f"""x as (select line_idx, string_split(case line_idx % 3 when 0 then {_RAW} when 1 then {_RAW} || ',extra' else entry || ',,' || parcel_no end, ',') as p from v_ocr),
    y as (select line_idx, case when len(p) > 9 then list_concat(p[1:8], [array_to_string(p[9:], ',')]) else list_concat(p, list_transform(range(9 - len(p)), lambda i: '')) end as p from x)
    select line_idx, array_to_string(list_transform(p, lambda v: case when trim(v) in ('(空)', '-', '―') then '' else trim(v) end), '|') as fields from y""",
    "v_ocr",
)
def arity_repair(spark, sf_dir):
    raw = F.concat_ws(",", "entry", F.lit(""), "parcel_no", "land_use", "area", "addr", "share", "name", "receipt")
    line = F.when(c("line_idx") % 3 == 0, raw).when(c("line_idx") % 3 == 1, F.concat(raw, F.lit(",extra"))).otherwise(F.concat_ws(",", "entry", F.lit(""), "parcel_no"))
    return view(spark, sf_dir, "v_ocr").select("line_idx", F.array_join(reconcile.repair_arity(line), "|").alias("fields"))


_DATED = "(regexp_matches({0}, '(明治|大正|昭和|平成|令和)[0-9]+年') or regexp_matches({0}, '第[0-9]+号'))"
_NAME = f"({{0}} <> '' and not {_ADDR} and length({{0}}) <= 30)"


@query(
    f"""r1 as (select line_idx, parcel_no, case when z then '' else addr end as addr, share, case when z then addr else name end as name from (select *, addr <> '' and share = '' and name = '' and {_NAME.format('addr')} as z from v_ocr)),
    r2 as (select line_idx, parcel_no, addr, case when z and name = '' then '' else share end as share, case when z and name = '' then share else name end as name from (select *, {_NAME.format('share')} and share not like '持分%' and not {_DATED.format('share')} as z from r1)),
    r3 as (select *, {_NAME.format('share')} and share not like '持分%' and not {_DATED.format('share')} as z, {_DATED.format('name')} as w, {_NAME.format('addr')} as q from r2)
    select line_idx, case when w and not z and q then '' else addr end as addr, case when w and z then '' else share end as share, case when w and z then share when w and q then addr when w then '' else name end as name, regexp_matches(parcel_no, '^[0-9]') and parcel_no not like '%番地%' as valid from r3""",
    "v_ocr",
)
def owner_drift(spark, sf_dir):
    return reconcile.repair_owner(view(spark, sf_dir, "v_ocr")).select("line_idx", "addr", "share", "name", reconcile.valid_parcel(c("parcel_no")).alias("valid"))


@query(
    f"""r as (select *, regexp_matches(name, '(明治|大正|昭和|平成|令和)[0-9]+年') or (share <> '' and share not like '持分%' and not regexp_matches(share, '(明治|大正|昭和|平成|令和)[0-9]+年')) as off from v_ocr)
    select line_idx, addr, case when off then '' else share end as share, case when off then share else name end as name from r""",
    "v_ocr",
)
def owner_drift_v1(spark, sf_dir):
    return reconcile.repair_owner_v1(view(spark, sf_dir, "v_ocr")).select("line_idx", "addr", "share", "name")


@query(
    """select line_idx, case when line_idx % 2 = 0 then '続' else entry end as entry, case when line_idx % 2 = 0 then '' else addr end as location, case when line_idx % 2 = 0 then '' else share end as parcel_no, case when line_idx % 2 = 0 then '' else name end as land_use, case when line_idx % 2 = 0 then '' else receipt end as area,
    case when line_idx % 2 = 0 then addr else '' end as addr, case when line_idx % 2 = 0 then share else '' end as share, case when line_idx % 2 = 0 then name else '' end as name, case when line_idx % 2 = 0 then receipt else '' end as receipt from v_ocr""",
    "v_ocr",
)
def early_lines(spark, sf_dir):
    """Lines of the earlier form, where an owner stands right behind 続."""
    cells = F.array(F.when(c("line_idx") % 2 == 0, sequence.MORE).otherwise(c("entry")), "addr", "share", "name", "receipt")
    return sequence.line_columns(view(spark, sf_dir, "v_ocr").select("line_idx", cells.alias("fields")), early=True)


@query("select line_idx, unnest([trim(entry), trim(parcel_no)]) as line from v_ocr", "v_ocr")
def response_lines(spark, sf_dir):
    answer = F.concat(F.lit("```csv\n "), "entry", F.lit(" \n\n"), "parcel_no", F.lit("\n```"))
    return view(spark, sf_dir, "v_ocr").select("line_idx", F.explode(reconcile.response_lines(answer)).alias("line"))


@query("select line_idx, try_cast(area as double) as number, area as shown from v_ocr", "v_ocr")
def number_or_text(spark, sf_dir):
    return view(spark, sf_dir, "v_ocr").select("line_idx", tx.number_or_text(c("area")).alias("number"), c("area").alias("shown"))


def _entries(spark, sf_dir, *markers):
    return view(spark, sf_dir, "v_seq").where(sequence.is_numbered(c("entry")) | c("entry").isin(*markers))


def _group(where: str) -> str:
    return f"""s as (select * from v_seq where entry not in ('続', '続更新', '続表題') or {where}),
    g as (select *, sum(case when entry not in ('続', '続更新', '続表題') then 1 else 0 end) over (partition by file_no order by line_idx) as g from s),
    b as (select file_no, g, entry as number, parcel_no as bp, area as ba from g where entry not in ('続', '続更新', '続表題'))
    """


@query(
    _group("entry = '続'")
    + """, n as (select *, row_number() over (partition by file_no order by line_idx) as k from g),
    dup as (select distinct x.line_idx from n x join n y on y.file_no = x.file_no and y.k between x.k + 1 and x.k + 9 and y.entry = '続' and y.g > x.g and y.owner_name = x.owner_name where x.entry = '続')
    select line_idx, g.file_no, page, coalesce(number, entry) as entry, case when entry = '続' and number is not null then bp else parcel_no end as parcel_no, case when entry = '続' and number is not null then ba else area end as area, owner_name
    from g left join b on b.file_no = g.file_no and b.g = g.g where line_idx not in (select line_idx from dup)""",
    "v_seq",
)
def carry_forward(spark, sf_dir):
    return sequence.merge_lines(_entries(spark, sf_dir, "続"), across=False)


@query("select line_idx, row_number() over (partition by file_no, page order by line_idx) - 1 as page_row from v_seq", "v_seq")
def page_index(spark, sf_dir):
    return sequence.page_index(view(spark, sf_dir, "v_seq"), "file_no").select("line_idx", c("page_row").cast("long").alias("page_row"))


@query(
    """n as (select *, row_number() over (partition by file_no order by line_idx) as k, sum(case when regexp_full_match(entry, '[0-9]+') then 1 else 0 end) over (partition by file_no order by line_idx) as g from v_seq)
    select line_idx, entry = '続' and exists (select 1 from n y where y.file_no = n.file_no and y.k between n.k + 1 and n.k + 9 and y.entry = '続' and y.g > n.g and y.owner_name = n.owner_name) as duplicate from n""",
    "v_seq",
)
def dup_suppress(spark, sf_dir):
    return sequence.mark_duplicates(view(spark, sf_dir, "v_seq"), "file_no").select("line_idx", "duplicate")


@query(
    _group("entry = '続表題'")
    + """, t as (select g.*, number, bp, ba from g left join b on b.file_no = g.file_no and b.g = g.g where g.g > 0),
    f as (select *, coalesce(nullif(bp, ''), first_value(nullif(case when entry = '続表題' then parcel_no end, '') ignore nulls) over w, '') as np, coalesce(nullif(ba, ''), first_value(nullif(case when entry = '続表題' then area end, '') ignore nulls) over w, '') as na,
      case when entry = '続表題' then sum(case when entry = '続表題' then 1 else 0 end) over w end as k from t window w as (partition by file_no, g order by line_idx rows between unbounded preceding and current row)),
    o as (select *, case when entry = '続表題' then np else parcel_no end as op, case when entry = '続表題' then na else area end as oa from f),
    z as (select *, case when op = '' then row_number() over (partition by file_no, g, op = '' order by line_idx desc) end as r from o)
    select z.line_idx, z.file_no, z.page, z.number as entry, coalesce(q.np, z.op) as parcel_no, coalesce(q.na, z.oa) as area, z.owner_name from z left join f q on q.file_no = z.file_no and q.g = z.g and q.k = z.r""",
    "v_seq",
)
def header_fill(spark, sf_dir):
    return sequence.merge_lines(_entries(spark, sf_dir, "続表題"), across=False)


@query(
    _group("entry = '続更新'")
    + """, i as (select *, row_number() over (partition by file_no, page order by line_idx) - 1 as page_row, lead(entry, 1) over w as e1, lead(area, 1) over w as a1, lead(entry, 2) over w as e2, lead(area, 2) over w as a2 from g window w as (partition by file_no order by line_idx)),
    v as (select * from i where entry <> '続更新' or (page_row = 0 and g > 0 and not coalesce(case when e1 not in ('続', '続更新', '') then a1 when e2 not in ('続', '続更新', '') then a2 end = area, false))),
    u as (select file_no, g, arg_max(area, line_idx) as area from v where entry = '続更新' and area <> '' group by all)
    select v.line_idx, v.file_no, v.page, v.entry, v.parcel_no, coalesce(u.area, v.area) as area, v.owner_name from v left join u on u.file_no = v.file_no and u.g = v.g where v.entry <> '続更新'""",
    "v_seq",
)
def backpatch(spark, sf_dir):
    return sequence.merge_lines(_entries(spark, sf_dir, "続更新"), across=False)


@query(
    """p as (select file_no, n, lag(n) over (partition by file_no order by n) as prev_n from v_numseq)
    select file_no, prev_n, n as next_n, n - prev_n - 1 as n_missing, case when n - prev_n - 1 <= 5 then 'small' else 'large' end as kind, array_to_string(range(prev_n + 1, n), ',') as missing from p where prev_n > 0 and n > prev_n + 1""",
    "v_numseq",
)
def number_gaps(spark, sf_dir):
    lines = view(spark, sf_dir, "v_numseq").select("file_no", c("n").cast("string").alias("entry"), c("n").alias("line_idx"))
    return sequence.number_gaps(lines).withColumn("missing", F.array_join(F.transform("missing", lambda x: x.cast("string")), ","))


def _source(spark, sf_dir):
    rows = diff.by_parcel(_properties(spark, sf_dir, "base", "source"))
    with many_parts_here(spark):
        return materialise(rows.withColumn("area", F.concat("area", F.lit(".5"))))


def _read(spark, sf_dir):
    area = F.concat(F.expr("cast(cast(line_idx % 50 + 1 as int) as string)"), F.when(c("line_idx") % 4 == 0, "").when(c("line_idx") % 4 == 1, "5").otherwise(".5"))
    with many_parts_here(spark):
        return materialise(reconcile.read_properties(view(spark, sf_dir, "v_ocr").select("line_idx", c("page").cast("string").alias("page"), F.lit("f").alias("file"), "location", "parcel_no", "land_use", area.alias("area"), "addr", "share", "name")))


_DRIFT = f"""
r1 as (select line_idx, parcel_no, case when z then '' else addr end as addr, share, case when z then addr else name end as name from (select *, addr <> '' and share = '' and name = '' and {_NAME.format('addr')} as z from v_ocr)),
r2 as (select line_idx, parcel_no, addr, case when z and name = '' then '' else share end as share, case when z and name = '' then share else name end as name from (select *, {_NAME.format('share')} and share not like '持分%' and not {_DATED.format('share')} as z from r1)),
r3 as (select *, {_NAME.format('share')} and share not like '持分%' and not {_DATED.format('share')} as z, {_DATED.format('name')} as w, {_NAME.format('addr')} as q from r2),
people as (select line_idx, case when w and not z and q then '' else addr end as addr, case when w and z then '' else share end as share, case when w and z then share when w and q then addr when w then '' else name end as name from r3)
"""
_RECONCILE = (
    _rollup("src", {}, "true", source=True)
    + ","
    + _DRIFT
    + f""",
sk as (select {_SOURCE_KEY} as key, location, land_use, area || '.5' as area, olds, list_filter(list_transform(owners, lambda o: o['name']), lambda x: x <> '') as names, len(owners) as n_owners, list_transform(owners, lambda o: [o['name'], o['address']]) as pairs from src),
rd as (select replace({_BRANCH.format('v_ocr.parcel_no')}, '番の', '番') as key, location, case when land_use = '(空)' then '' else land_use end as land_use, (line_idx % 50 + 1)::int::varchar || case when line_idx % 4 = 0 then '' when line_idx % 4 = 1 then '5' else '.5' end as area, page::varchar as page, people.name as name, people.addr as addr from v_ocr join people using (line_idx)),
m as (select coalesce(sk.key, rd.key) as key, sk.key is not null as in_s, rd.key is not null as in_r, coalesce(nullif(rd.location, ''), nullif(sk.location, ''), '') as location, coalesce(sk.land_use, '') as su, coalesce(rd.land_use, '') as ru, coalesce(sk.area, '') as sa, coalesce(rd.area, '') as ra, olds,
  coalesce(array_to_string(names, ', '), '') as source_owners, coalesce(rd.name, '') as read_owners, coalesce(n_owners, 0) as source_owner_count, case when coalesce(rd.name, '') <> '' or coalesce(rd.addr, '') <> '' then 1 else 0 end as read_owner_count, coalesce(page, '') as page, pairs, coalesce(rd.addr, '') as addr from sk full join rd on sk.key = rd.key),
rec as (select key, case when not in_s then 'read_only' when not in_r then 'source_only' else 'both' end as status, location,
  case when su <> '' and ru <> '' and su <> ru then case when coalesce(list_contains(olds, ru), false) then 'corrected' else 'changed' end else '' end as land_use_change,
  case when sa <> '' and ra <> '' and sa <> ra then case when ra not like '%.%' and (ra = split_part(sa, '.', 1) or ra = replace(sa, '.', '')) then 'corrected' else 'changed' end else '' end as area_change, su, ru, sa, ra, source_owners, read_owners, source_owner_count, read_owner_count, case when in_s then 'base' else '' end as file, page, pairs, addr from m),
gone as (select key, pr[1] as name, pr[2] as address, read_owners from (select key, read_owners, unnest(pairs) as pr from rec where status = 'both') where pr[1] <> '' and pr[1] <> read_owners),
fresh as (select key, read_owners as name, addr as address from rec where status = 'both' and read_owners <> '' and not coalesce(list_contains(list_transform(pairs, lambda x: x[1]), read_owners), false))
"""
)
_PICK = "case when {0} = 'changed' then {2} when {1} <> '' then {1} else {2} end"


@query(
    _RECONCILE
    + f"select key, status, location, land_use_change, area_change, su as source_land_use, ru as read_land_use, sa as source_area, ra as read_area, source_owners, read_owners, source_owner_count, read_owner_count, file, page, {_PICK.format('land_use_change', 'su', 'ru')} as land_use, {_PICK.format('area_change', 'sa', 'ra')} as area from rec",
    "v_records",
    "v_ocr",
)
def reconcile_full(spark, sf_dir):
    return reconcile.reconcile(_source(spark, sf_dir), _read(spark, sf_dir))


def _owner_differences(source, read):
    people = lambda df: df.select("key", F.posexplode("owners").alias("ord", "o")).select("key", "ord", "o.name", "o.address")
    both = source.select("key").join(read.select("key"), "key")
    with many_parts_here(source.sparkSession):
        return materialise(reconcile.match_owners(*[people(df.join(both, "key", "left_semi")) for df in (source, read)]))


@query(
    _RECONCILE
    + """select key, 1 as item_ord, location, '地目' as item, su as old_value, ru as new_value, page, '' as note from rec where status = 'both' and land_use_change = 'changed'
    union all select key, 2, location, '地目（OCR補正）', 'OCR読取値: ' || ru, '補正後: ' || su || '（照合元と一致）', page, '' from rec where status = 'both' and land_use_change = 'corrected'
    union all select key, 3, location, '地積', sa, ra, page, '' from rec where status = 'both' and area_change = 'changed'
    union all select key, 4, location, '地積（小数点補正）', '照合元: ' || sa, 'OCR読取値: ' || ra || '（整数部一致、小数点読み落とし）', page, '小数点の縦点線がOCRで認識されなかった可能性' from rec where status = 'both' and area_change = 'corrected'
    union all select gone.key, 5, location, '所有者（消失）', name, '（OCRに該当なし）', page, case when address <> '' then '照合元住所: ' || address else '' end from gone join rec using (key)
    union all select fresh.key, 5, location, '所有者（追加）', '（照合元に該当なし）', name, page, case when address <> '' then 'OCR住所: ' || address else '' end from fresh join rec using (key)""",
    "v_records",
    "v_ocr",
)
def reconcile_changes(spark, sf_dir):
    source, read = _source(spark, sf_dir), _read(spark, sf_dir)
    return reconcile.changes(reconcile.reconcile(source, read), _owner_differences(source, read))


@query(
    _RECONCILE
    + """select rec.key, location, su as land_use_old, case when land_use_change = 'corrected' then su else ru end as land_use_new, land_use_change = 'changed' as land_use_changed, land_use_change = 'corrected' as land_use_misread,
    sa as area_old, case when area_change = 'corrected' then ra || '→補正:' || sa else ra end as area_new, area_change = 'changed' as area_changed, source_owners as owner_old, read_owners as owner_new,
    exists (select 1 from gone where gone.key = rec.key) or exists (select 1 from fresh where fresh.key = rec.key) as owner_changed, page, file, source_owner_count as owner_count_old, read_owner_count as owner_count_new from rec where status = 'both'""",
    "v_records",
    "v_ocr",
)
def full_comparison(spark, sf_dir):
    source, read = _source(spark, sf_dir), _read(spark, sf_dir)
    return reconcile.full_comparison(reconcile.reconcile(source, read), _owner_differences(source, read))


@query(
    _RECONCILE
    + """select case when status = 'source_only' then '照合元のみ' else 'OCRのみ' end as category, key, location, case when status = 'source_only' then file else 'PDF p.' || page end as source, case when status = 'source_only' then 'OCR結果に該当なし（PDF範囲外の可能性）' else '照合元に該当なし（新規取得・範囲外の可能性）' end as note from rec where status <> 'both'""",
    "v_records",
    "v_ocr",
)
def reconcile_unmatched(spark, sf_dir):
    return reconcile.unmatched(reconcile_full(spark, sf_dir))


@query(
    _RECONCILE
    + """select key, case when land_use_change = 'corrected' then '地目（OCR補正）' else '地目' end as item, case when land_use_change = 'corrected' then 'OCR読取値: ' || ru else su end as old_value, case when land_use_change = 'corrected' then '補正後: ' || su || '（照合元と一致）' else ru end as new_value from rec where status = 'both' and land_use_change <> ''
    union all select key, '地積', sa, ra from rec where status = 'both' and sa <> '' and ra <> '' and sa <> ra
    union all select key, '所有者', pairs[1][1], read_owners from rec where status = 'both' and pairs[1][1] <> '' and read_owners <> '' and pairs[1][1] <> read_owners""",
    "v_records",
    "v_ocr",
)
def reconcile_v1(spark, sf_dir):
    first = F.coalesce(F.get("owners", F.lit(0))["name"], F.lit(""))
    source, read = (df.withColumn("owner", first) for df in (_source(spark, sf_dir), _read(spark, sf_dir)))
    return reconcile.reconcile_v1(source, read)


@query(
    """s as (select distinct id % 400 as key, replace(name_raw, ' ', '') as n from v_text), r as (select distinct id % 400 as key, replace(replace(name_raw, ' ', ''), case when id % 3 = 0 then '髙' else '澤' end, case when id % 3 = 0 then '高' else '沢' end) as n from v_text where id % 10 <> 7),
    a as (select *, replace(replace(n, '髙', '高'), '澤', '沢') as f, row_number() over (partition by key, replace(replace(n, '髙', '高'), '澤', '沢') order by n) as k from s where not exists (select 1 from r where r.key = s.key and r.n = s.n)),
    b as (select *, replace(replace(n, '髙', '高'), '澤', '沢') as f, row_number() over (partition by key, replace(replace(n, '髙', '高'), '澤', '沢') order by n) as k from r where not exists (select 1 from s where r.key = s.key and r.n = s.n))
    select coalesce(a.key, b.key) as key, case when b.n is null then '消失' when a.n is null then '追加' else '異体字差異' end as kind, coalesce(a.n, '') as source_name, coalesce(b.n, '') as read_name, '' as source_address, '' as read_address from a full join b on a.key = b.key and a.f = b.f and a.k = b.k""",
    "v_text",
)
def owner_match(spark, sf_dir):
    bare = F.replace(c("name_raw"), F.lit(" "), F.lit(""))
    names = view(spark, sf_dir, "v_text").select((c("id") % 400).alias("key"), bare.alias("name"), "id")
    read = names.where("id % 10 <> 7").withColumn("name", F.when(c("id") % 3 == 0, F.replace("name", F.lit("髙"), F.lit("高"))).otherwise(F.replace("name", F.lit("澤"), F.lit("沢"))))
    return reconcile.match_owners(names, read)


# drawings


def _entities(spark, sf_dir):
    return view(spark, sf_dir, "v_entities")


@query("select drawing_id, etype, count(*) as n from v_entities group by all", "v_entities")
def entity_counts(spark, sf_dir):
    return entities.entity_counts(_entities(spark, sf_dir))


@query("select drawing_id, case when count(*) filter (etype = 'MTEXT') > 0 and count(*) filter (etype = 'LWPOLYLINE') > 0 then 'mtext' else 'text' end as format from (select drawing_id, etype from v_entities union all select 3, etype from v_entities where etype <> 'LWPOLYLINE' union all select drawing_id, etype from v_plan) group by 1", "v_entities", "v_plan")
def format_detect(spark, sf_dir):
    one = _entities(spark, sf_dir).select("drawing_id", "etype")
    return entities.detect_format(one.unionByName(one.where("etype <> 'LWPOLYLINE'").withColumn("drawing_id", F.lit(3))).unionByName(view(spark, sf_dir, "v_plan").select("drawing_id", "etype")))


@query("r as (select drawing_id, round(radius, 2) as radius, count(*) as n, min(ord) as first from v_entities where etype = 'CIRCLE' group by 1, 2) select drawing_id, radius from (select *, row_number() over (partition by drawing_id order by n desc, first) as k from r) where k = 1", "v_entities")
def modal_radius(spark, sf_dir):
    return entities.modal_radius(_entities(spark, sf_dir))


@query("select drawing_id, min(ord) as stake_id, arg_min(x1, ord) as x, arg_min(y1, ord) as y, arg_min(layer, ord) as layer from v_entities where etype = 'CIRCLE' and abs(radius - 0.25) < 0.01 group by drawing_id, round(x1, 3), round(y1, 3)", "v_entities")
def round_dedupe(spark, sf_dir):
    return entities.stakes(_entities(spark, sf_dir))


@query(f"select ord, {_CLASS.format('trim(text)')} as category, text as number from v_entities where etype = 'MTEXT' and {_CLASS.format('trim(text)')} in ('stake', 'intersection_stake')", "v_entities")
def stake_texts(spark, sf_dir):
    return entities.stake_texts(_entities(spark, sf_dir)).select("ord", "category", "number")


@query("select ord, case when ord % 3 = 0 then '氏名' || text else text end as owner from v_entities where etype = 'MTEXT' and layer = '53' and ord % 3 = 0", "v_entities")
def owner_texts(spark, sf_dir):
    named = F.when((c("layer") == "53") & (c("ord") % 3 == 0), F.concat(F.lit("氏名"), "text")).otherwise(c("text"))
    return entities.owner_texts(_entities(spark, sf_dir).withColumn("text", named)).select("ord", "owner")


@query(
    """select count(*) as n_stakes, count(number) as n_named, count(*) filter (number like '-%' or number like '交%') as n_intersections, count(distinct nullif(regexp_extract(number, '^[-交]?([0-9]+)\\.', 1), '')) as n_blocks, (select count(*) from v_lines) as n_lines,
    (select count(*) from v_lines l where exists (select 1 from v_stakes s where s.number is not null and sqrt((l.x1 - s.x) * (l.x1 - s.x) + (l.y1 - s.y) * (l.y1 - s.y)) < 0.5) and exists (select 1 from v_stakes s where s.number is not null and sqrt((l.x2 - s.x) * (l.x2 - s.x) + (l.y2 - s.y) * (l.y2 - s.y)) < 0.5)) as n_matched,
    (select count(*) from v_labels) as n_labels, (select count(*) from v_public) as n_public from v_stakes""",
    "v_stakes",
    "v_lines",
    "v_labels",
    "v_public",
)
def diagnostics(spark, sf_dir):
    stakes, lines = view(spark, sf_dir, "v_stakes"), view(spark, sf_dir, "v_lines")
    return entities.diagnostics(stakes, lines, view(spark, sf_dir, "v_labels"), spatial.line_ends(lines, stakes, "number"), view(spark, sf_dir, "v_public"))


@query("select distinct nullif(regexp_extract(number, '^[-交]?([0-9]+)\\.', 1), '') as block from v_stakes where regexp_extract(number, '^[-交]?([0-9]+)\\.', 1) <> ''", "v_stakes")
def block_list(spark, sf_dir):
    return entities.block_list(view(spark, sf_dir, "v_stakes"))


@query("select label_id, number from v_labels where number in ('25', '301-4', '7-7')", "v_labels")
def target_parcels(spark, sf_dir):
    return drawing.target_parcels(view(spark, sf_dir, "v_labels"), " 25, 301-4,,7-7 ").select("label_id", "number")


# joins by distance


def _distance(a: str, ax: str, ay: str, b: str) -> str:
    return f"sqrt(({a}.{ax} - {b}.x) * ({a}.{ax} - {b}.x) + ({a}.{ay} - {b}.y) * ({a}.{ay} - {b}.y))"


@query(f"n as (select s.stake_id, l.number, {_distance('s', 'x', 'y', 'l')} as d, row_number() over (partition by s.stake_id order by {_distance('s', 'x', 'y', 'l')}, l.label_id) as k from v_stakes s join v_labels l on {_distance('s', 'x', 'y', 'l')} < 5) select s.stake_id, n.number as label, round(n.d, 6) as d from v_stakes s left join n on n.stake_id = s.stake_id and k = 1", "v_stakes", "v_labels")
def nearest_label(spark, sf_dir):
    labels = view(spark, sf_dir, "v_labels").select(c("number").alias("label"), c("x").alias("rx"), c("y").alias("ry"), "label_id")
    return spatial.nearest_within(view(spark, sf_dir, "v_stakes"), labels, 5.0, "stake_id", "label_id", ("label",)).select("stake_id", "label", F.round("d", 6).alias("d"))


def _edges_sql(name: str, where: str) -> str:
    rank = lambda k, x, y: f"(select line_id, n{k} from (select line_id, {name} as n{k}, row_number() over (partition by line_id order by {_distance('l', x, y, 's')}, stake_id) as r from v_lines l join v_stakes s on {where} and {_distance('l', x, y, 's')} < 0.5) where r = 1)"
    return f"e as (select distinct least(n1, n2) as u, greatest(n1, n2) as v from {rank(1, 'x1', 'y1')} a join {rank(2, 'x2', 'y2')} b using (line_id) where n1 <> n2)"


_EDGES = _edges_sql("number", "s.number is not null")
_AUX_NAME = "coalesce(number, '__' || stake_id)"


@query(_EDGES + " select * from e", "v_stakes", "v_lines")
def snap_edges(spark, sf_dir):
    return spatial.edges(view(spark, sf_dir, "v_lines"), view(spark, sf_dir, "v_stakes"), "number")


def _aux_stakes(spark, sf_dir):
    return view(spark, sf_dir, "v_stakes").withColumn("name", F.coalesce("number", F.concat(F.lit("__"), c("stake_id").cast("string"))))


@query(_edges_sql(_AUX_NAME, "true") + " select * from e", "v_stakes", "v_lines")
def aux_edges(spark, sf_dir):
    return spatial.edges(view(spark, sf_dir, "v_lines"), _aux_stakes(spark, sf_dir), "name")


@query(
    f"""p as (select label_id as left_id, stake_id as right_id, {_distance('l', 'x', 'y', 's')} as d, {_distance('l', 'x', 'y', 's')} * case when (label_id % 3)::varchar = layer then 0.8 else 1 end as cost from v_labels l join v_stakes s on {_distance('l', 'x', 'y', 's')} < 4)
    select left_id, right_id, round(d, 6) as d from (select *, row_number() over (partition by right_id order by cost, left_id) as k from p) where k = 1""",
    "v_stakes",
    "v_labels",
)
def assign_unique(spark, sf_dir):
    """Stakes lie further apart than twice the reach, so that each takes its cheapest label."""
    left = view(spark, sf_dir, "v_labels").select(c("label_id").alias("left_id"), "x", "y", (c("label_id") % 3).cast("string").alias("layer"))
    right = view(spark, sf_dir, "v_stakes").select(c("stake_id").alias("right_id"), c("x").alias("rx"), c("y").alias("ry"), c("layer").alias("r_layer"))
    return spatial.assign(left, right, 4.0).withColumn("d", F.round("d", 6))


@query("""t as (select * from v_entities where etype = 'MTEXT' and ord < 20000000), s as (select min(ord) as stake_id, arg_min(x1, ord) as x, arg_min(y1, ord) as y, arg_min(layer, ord) as layer from v_entities where etype = 'CIRCLE' and abs(radius - 0.25) < 0.01 group by round(x1, 3), round(y1, 3))
select stake_id, t.text as number, s.layer from s left join t on sqrt((t.x1 - s.x) * (t.x1 - s.x) + (t.y1 - s.y) * (t.y1 - s.y)) < 5""", "v_entities")
def drawing_stakes(spark, sf_dir):
    """Stakes with the numbers that the whole drawing's assignment gives them; a number's text is near one stake only."""
    return drawing.parse_entities(materialise(_entities(spark, sf_dir))).stakes.select("stake_id", "number", "layer")


_PLAN = """
fore as (select * from v_plan where layer not in ('_f-0_', '_f-8_', '_9-0_', '_9-1_')),
st as (select min(ord) as stake_id, arg_min(x1, ord) as x, arg_min(y1, ord) as y, arg_min(layer, ord) as layer from fore where etype = 'CIRCLE' group by round(x1, 3), round(y1, 3)),
pt as (select * from fore where etype = 'TEXT' and ord < 20000000),
ps as (select stake_id, pt.text as number, st.layer, x, y from st left join pt on sqrt((pt.x1 - st.x) * (pt.x1 - st.x) + (pt.y1 - st.y) * (pt.y1 - st.y)) < 12.5)
"""


@query(_PLAN + "select stake_id, number, layer from ps", "v_plan")
def drawing_text_stakes(spark, sf_dir):
    """A drawing in the text format: circles of any radius, reach by the usual radius, background layers left out."""
    return drawing.parse_entities(view(spark, sf_dir, "v_plan")).stakes.select("stake_id", "number", "layer")


@query(
    _PLAN
    + """, ln as (select ord, x1, y1, x2, y2 from fore where etype = 'LINE'),
    hit as (select ord, 1 as e, number, row_number() over (partition by ord order by sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)), stake_id) as k from ln join ps on number is not null and sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)) < 0.5
      union all select ord, 2, number, row_number() over (partition by ord order by sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)), stake_id) from ln join ps on number is not null and sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) < 0.5)
    select distinct min(number) as u, max(number) as v from hit where k = 1 group by ord having count(*) = 2 and min(number) <> max(number)""",
    "v_plan",
)
def drawing_text_edges(spark, sf_dir):
    return drawing.parse_entities(view(spark, sf_dir, "v_plan")).edges.select("u", "v")


@query(
    """p as (select * from v_plan where etype = 'TEXT' and ord between 30000000 and 39999999), u as (select * from v_plan where etype = 'TEXT' and ord between 40000000 and 49999999 and layer not in ('_f-0_', '_f-8_', '_9-0_', '_9-1_')),
    n as (select p.ord, u.text, row_number() over (partition by p.ord order by sqrt((p.x1 - u.x1) * (p.x1 - u.x1) + (p.y1 - u.y1) * (p.y1 - u.y1)), u.ord) as k from p join u on abs(p.x1 - u.x1) < 150 and abs(p.y1 - u.y1) < 150 and sqrt((p.x1 - u.x1) * (p.x1 - u.x1) + (p.y1 - u.y1) * (p.y1 - u.y1)) < 150)
    select p.ord as label_id, p.text as number, n.text as land_use, null::varchar as owner from p left join n on n.ord = p.ord and k = 1""",
    "v_plan",
)
def drawing_text_parcels(spark, sf_dir):
    return drawing.parse_entities(view(spark, sf_dir, "v_plan")).parcels.select("label_id", "number", "land_use", "owner")


# faces


def _graph(spark, sf_dir):
    stakes = view(spark, sf_dir, "v_stakes")
    return spatial.edges(view(spark, sf_dir, "v_lines"), stakes, "number"), spatial.last_places(stakes, "number")


def _half_sql(edges_sql: str, name: str) -> str:
    return (
        edges_sql
        + f""", p as (select {name} as node, arg_max(x, stake_id) as x, arg_max(y, stake_id) as y from v_stakes where {name} is not null group by 1),
h as (select e.u, e.v, atan2(q.y - p.y, q.x - p.x) as a from (select u, v from e union select v, u from e) e join p on p.node = e.u join p q on q.node = e.v),
hn as (select v as u, u as v, coalesce(lead(v) over (partition by u order by a, v), first_value(v) over (partition by u order by a, v)) as after from h),
he as (select u || '>' || v as id, u, v, v || '>' || after as next from hn)
"""
    )


_HALF = _half_sql(_EDGES, "number")


@query(_HALF + "select id, u, v, next from he", "v_stakes", "v_lines")
def half_edges(spark, sf_dir):
    return faces.half_edges(*_graph(spark, sf_dir))


def _faces_sql(half: str) -> str:
    return (
        half
        + """, w as (select id as face, id, next, u, 0 as place from he union all select w.face, he.id, he.next, he.u, w.place + 1 from w join he on he.id = w.next where he.id > w.face),
good as (select face, max(place) + 1 as n from w group by 1 having bool_or(next = face)),
f as (select face, n, list(u order by place) as ring, sum(x * y2 - x2 * y) / 2 as area from (select w.face, good.n, w.place, w.u, p.x, p.y, q.x as x2, q.y as y2 from w join good using (face) join p on p.node = w.u join he on he.id = w.id join p q on q.node = he.v) group by face, n having n >= 3)
"""
    )


_FACES = _faces_sql(_HALF)


@query(_FACES + "select face, n, array_to_string(ring, ',') as ring from f", "v_stakes", "v_lines")
def faces_(spark, sf_dir):
    return faces.faces(*_graph(spark, sf_dir)).select("face", c("n").cast("long").alias("n"), F.array_join("ring", ",").alias("ring"))


QUERIES["faces"], ORACLE_SQL["faces"] = QUERIES.pop("faces_"), ORACLE_SQL.pop("faces_")


@query(_FACES + "select face, round(area, 4) as area from f", "v_stakes", "v_lines")
def face_area(spark, sf_dir):
    return faces.faces(*_graph(spark, sf_dir)).select("face", F.round("area", 4).alias("area"))


def _rings_sql(faces_sql: str, label: str) -> str:
    """SQL from faces f (face, n, ring) and places p to simple faces, and the smallest around each row of label."""
    return (
        faces_sql
        + f""", sp as (select face, ring, n, 1 as k, [ring[1]] as path, null::varchar[] as cut from f
  union all select face, ring, n, k + 1, case when list_contains(path, ring[k + 1]) then path[:list_position(path, ring[k + 1])] else list_append(path, ring[k + 1]) end, case when list_contains(path, ring[k + 1]) then path[list_position(path, ring[k + 1]):] end from sp where k < n),
parts as (select face, k, cut as nodes from sp where len(cut) >= 3 union all select face, n + 1, path from sp where k = n and len(path) >= 3),
pv as (select face || '#' || k as face_id, i, nodes[i] as node, nodes[i % len(nodes) + 1] as after from (select face, k, nodes, unnest(range(1, len(nodes) + 1)) as i from parts)),
px as (select face_id, i, pv.node as node, a.x, a.y, b.x as x2, b.y as y2 from pv join p a on a.node = pv.node join p b on b.node = pv.after),
simple as (select face_id, abs(sum(x * y2 - x2 * y) / 2) as area, min(x) as x_min, max(x) as x_max, min(y) as y_min, max(y) as y_max, avg(x) as cx, avg(y) as cy,
  case when sum(x * y2 - x2 * y) > 0 then list_reverse(list({{'node': node, 'w': y - x}} order by i)) else list({{'node': node, 'w': y - x}} order by i) end as pts from px group by 1 having sum(x * y2 - x2 * y) <> 0),
start as (select face_id, list_reduce(list_transform(range(1, len(pts) + 1), lambda j: {{'i': j, 'w': pts[j].w}}), lambda b, q: case when q.w > b.w + 0.001 then q else b end).i as first_ from simple),
shape as (select s.*, list_transform(range(0, len(pts) + 1), lambda j: pts[((first_ - 1 + j) % len(pts) + 1)::int].node) as closed from simple s join start using (face_id)),
inside as (select l.label_id, s.face_id, s.area from {label} l join simple s on l.x between x_min and x_max and l.y between y_min and y_max join px e on e.face_id = s.face_id group by l.label_id, s.face_id, s.area having count(*) filter ((e.y > l.y) <> (e.y2 > l.y) and l.x < (e.x2 - e.x) * (l.y - e.y) / nullif(e.y2 - e.y, 0) + e.x) % 2 = 1),
hits as (select label_id, arg_min(face_id, {{'a': area, 'f': face_id}}) as face_id from inside group by 1)
"""
    )


_FOUND = """, won as (select l.label_id, l.number, h.face_id, row_number() over (partition by h.face_id order by sqrt((l.x - cx) * (l.x - cx) + (l.y - cy) * (l.y - cy)), l.label_id) as k from hits h join v_labels l using (label_id) join simple using (face_id)),
found as (select won.face_id, number as parcel_number, closed from won join shape using (face_id) where k = 1)
"""
_RINGS = _rings_sql(_FACES, "v_labels") + _FOUND


def _simple(spark, sf_dir) -> DataFrame:
    return materialise(faces.simple_faces(*_graph(spark, sf_dir)))


def _aux_simple(spark, sf_dir) -> DataFrame:
    stakes = _aux_stakes(spark, sf_dir)
    return materialise(faces.simple_faces(spatial.edges(view(spark, sf_dir, "v_lines"), stakes, "name"), spatial.last_places(stakes, "name")))


def _shown(rings: DataFrame) -> DataFrame:
    return rings.select("parcel_number", F.array_join("ring", ",").alias("ring"))


@query(_RINGS + "select parcel_number, array_to_string(closed, ',') as ring from found", "v_stakes", "v_lines", "v_labels")
def rings(spark, sf_dir):
    return _shown(faces.parcel_rings(view(spark, sf_dir, "v_labels"), _simple(spark, sf_dir)))


#: What a face belongs to where drawings meet in one table; a face's nodes are named 'drawing|number' there.
_SHEET = "split_part({}, '|', 1)"


def _auxiliary_sql(aux_faces: str, unnamed: str) -> str:
    """SQL from found (parcel_number, closed) to aux: faces over all stakes, one after the other in the order of their first open label."""
    return f""", ah as (with recursive {aux_faces} select label_id, face_id from hits),
ash as (with recursive {aux_faces} select face_id, closed[:len(closed) - 1] as nodes from shape),
oh as (select ah.face_id, l.number, l.label_id from ah join v_labels l using (label_id) where l.number not in (select parcel_number from found)),
alone as (select face_id, min(number) as number, min(label_id) as first_ from oh group by 1 having count(distinct number) = 1),
an as (select number, first_, list_filter(nodes, lambda x: {unnamed}) as named from alone join ash using (face_id)),
ac as (select number, first_, list_filter(named, lambda x, i: i = 1 or named[i - 1] <> x) as names from an),
cand as (select row_number() over (order by first_) as rn, number, names || [names[1]] as closed from ac where len(names) >= 3 and len(list_distinct(names)) = len(names) and not exists (select 1 from found where found.closed = names || [names[1]])),
gone as (select 0::bigint as rn, false as ok, []::varchar[] as nums, []::varchar[] as seqs union all
  select c.rn, not (list_contains(nums, c.number) or list_contains(seqs, array_to_string(c.closed, ','))), case when not (list_contains(nums, c.number) or list_contains(seqs, array_to_string(c.closed, ','))) then list_append(nums, c.number) else nums end,
    case when not (list_contains(nums, c.number) or list_contains(seqs, array_to_string(c.closed, ','))) then list_append(seqs, array_to_string(c.closed, ',')) else seqs end from gone join cand c on c.rn = gone.rn + 1),
aux as (select number as parcel_number, closed from cand join gone using (rn) where ok)
"""


def _unknown_sql(sheet: str) -> str:
    """SQL from shape, found and aux to unk: one row for each ring of an unmatched face, named by the first public label in it."""
    return f""", most as (select {sheet.format('face_id')} as sheet, max(area) as largest from simple group by 1),
rest as (select s.* from (select *, row_number() over (partition by closed order by area, face_id) as once from shape join most on most.sheet = {sheet.format('face_id')} where area < 0.9 * largest and area >= 10) s
  where once = 1 and not exists (select 1 from found where found.closed = s.closed) and not exists (select 1 from aux where aux.closed = s.closed)),
pin as (select l.label_id, l.label, s.face_id from v_public l join rest s on l.x between x_min and x_max and l.y between y_min and y_max join px e on e.face_id = s.face_id group by all having count(*) filter ((e.y > l.y) <> (e.y2 > l.y) and l.x < (e.x2 - e.x) * (l.y - e.y) / nullif(e.y2 - e.y, 0) + e.x) % 2 = 1),
pname as (select face_id, arg_min(label, label_id) as label from pin group by 1),
unk as (select coalesce(label, '地番不明') as parcel_number, closed from rest left join pname using (face_id))
"""


_AUX_FACES = _rings_sql(_faces_sql(_half_sql(_edges_sql(_AUX_NAME, "true"), _AUX_NAME)), "v_labels")
_AUXILIARY = _auxiliary_sql(_AUX_FACES, "not starts_with(x, '__')")


@query(_RINGS + _AUXILIARY + "select parcel_number, array_to_string(closed, ',') as ring from aux", "v_stakes", "v_lines", "v_labels")
def rings_aux(spark, sf_dir):
    labels = view(spark, sf_dir, "v_labels")
    found = materialise(faces.parcel_rings(labels, _simple(spark, sf_dir)))
    return _shown(faces.auxiliary_rings(found, labels, _aux_simple(spark, sf_dir)))


@query(_RINGS + ", aux as (select * from found where false)" + _unknown_sql("''") + "select parcel_number, array_to_string(closed, ',') as ring from unk", "v_stakes", "v_lines", "v_labels", "v_public")
def rings_unknown(spark, sf_dir):
    simple = _simple(spark, sf_dir)
    return _shown(faces.unknown_rings(faces.parcel_rings(view(spark, sf_dir, "v_labels"), simple), simple, view(spark, sf_dir, "v_public")))


_KINDS = "select 'matched' as kind, parcel_number, {0} as ring from found union all select 'auxiliary', parcel_number, {0} from aux union all select 'unknown', parcel_number, {0} from unk"


@query(_RINGS + _AUXILIARY + _unknown_sql("''") + _KINDS.format("array_to_string(closed, ',')"), "v_stakes", "v_lines", "v_labels", "v_public")
def all_rings(spark, sf_dir):
    return faces.all_rings(view(spark, sf_dir, "v_labels"), _simple(spark, sf_dir), _aux_simple(spark, sf_dir), view(spark, sf_dir, "v_public")).withColumn("ring", F.array_join("ring", ","))


@query("select number, label_id from (select *, row_number() over (order by k is null, k, number, label_id) as n from (select number, label_id, case when regexp_full_match(number, '[0-9]+([-番の]+[0-9]+)*') then list_transform(regexp_extract_all(number, '[0-9]+'), lambda x: x::bigint) end as k from v_labels)) where n <= 80", "v_labels")
def ring_preview(spark, sf_dir):
    return layout.preview(view(spark, sf_dir, "v_labels").select("number", "label_id"), "number", order="label_id")


# intersections

_FOLDED = "case when abs({0} - {1}) > pi() then 2 * pi() - abs({0} - {1}) else abs({0} - {1}) end"


@query(_HALF + f"select x.u as node, x.v as a, y.v as b from h x join h y on x.u = y.u and x.v < y.v where abs({_FOLDED.format('x.a', 'y.a')} - pi()) < radians(20)", "v_stakes", "v_lines")
def collinear_pairs(spark, sf_dir):
    return traverse.collinear_pairs(*_graph(spark, sf_dir))


_WALK = (
    _HALF
    + f""", wk as (select u as node, v as first, v as cur, a, [u, v] as seen, not (v like '-%' or v like '交%') as done, 0 as step from h where u like '-%' or u like '交%'
  union all select node, first, cur, a, seen, done, step from (select wk.node, wk.first, h.v as cur, h.a, list_append(wk.seen, h.v) as seen, not (h.v like '-%' or h.v like '交%') as done, wk.step + 1 as step,
    row_number() over (partition by wk.node, wk.first order by {_FOLDED.format('wk.a', 'h.a')}, h.v) as k from wk join h on h.u = wk.cur where not wk.done and not list_contains(wk.seen, h.v) and {_FOLDED.format('wk.a', 'h.a')} <= radians(45)) where k = 1),
ends as (select node, first, arg_max(cur, step) as "end" from wk group by 1, 2)
"""
)


@query(_WALK + "select * from ends", "v_stakes", "v_lines")
def graph_walk(spark, sf_dir):
    edges, nodes = _graph(spark, sf_dir)
    starts = traverse.headings(edges, nodes).where(tx.is_intersection(c("u"))).select(c("u").alias("node"), c("v").alias("first"))
    return traverse.walk_on(starts, edges, nodes)


_POINTS = (
    _WALK
    + f""", cp as (select x.u as node, x.v as a, y.v as b from h x join h y on x.u = y.u and x.v < y.v where abs({_FOLDED.format('x.a', 'y.a')} - pi()) < radians(20) and (x.u like '-%' or x.u like '交%')),
c1 as (select node, any_value(a) as a, any_value(b) as b from cp group by 1 having count(*) = 1),
c2 as (select c1.node, any_value(c1.a) as a, any_value(c1.b) as b, any_value(h.v) as c from c1 join h on h.u = c1.node and h.v <> c1.a and h.v <> c1.b group by 1 having count(*) = 1),
c3 as (select c2.node, ea."end" as a, eb."end" as b, ec."end" as c from c2 join ends ea on ea.node = c2.node and ea.first = c2.a join ends eb on eb.node = c2.node and eb.first = c2.b join ends ec on ec.node = c2.node and ec.first = c2.c),
c4 as (select c3.*, (o.x - d.x) * (q.y - o.y) - (o.y - d.y) * (q.x - o.x) < 0 as keep from c3 join p o on o.node = c3.node join p d on d.node = c3.c join p q on q.node = c3.a),
pts as (select node as intersection_stake, case when keep then a else b end as baseline_point1, case when a = b then '' when keep then b else a end as baseline_point2, c as extension_point1, '' as extension_point2 from c4)
"""
)


@query(_POINTS + "select * from pts", "v_stakes", "v_lines")
def intersections(spark, sf_dir):
    return traverse.intersections(*_graph(spark, sf_dir))


@query(_POINTS + "select regexp_extract(intersection_stake, '^[-交]?([0-9]+)\\.', 1) as block, count(*) as n from pts group by 1", "v_stakes", "v_lines")
def block_intersections(spark, sf_dir):
    return entities.intersections_per_block(intersections(spark, sf_dir))


@query(_POINTS + "select * from pts where regexp_extract(intersection_stake, '^[-交]?([0-9]+)\\.', 1) = '4'", "v_stakes", "v_lines")
def intersections_of_block(spark, sf_dir):
    return traverse.intersections(*_graph(spark, sf_dir), block=4)


# many drawings in one table: the twins set them side by side, and put the drawing in front of each name

_SHEETS = """z_stakes as (select drawing_id, drawing_id * 10000000::bigint + stake_id as stake_id, drawing_id || '|' || number as number, coalesce(drawing_id || '|' || number, drawing_id || '|__' || stake_id) as any_name, x + 1000000.0 * (drawing_id - 100) as x, y, layer from v_sheet_stakes),
z_lines as (select drawing_id * 10000000::bigint + line_id as line_id, x1 + 1000000.0 * (drawing_id - 100) as x1, y1, x2 + 1000000.0 * (drawing_id - 100) as x2, y2 from v_sheet_lines),
z_labels as (select label_id + drawing_id * 1000000000000 as label_id, drawing_id || '|' || number as number, x + 1000000.0 * (drawing_id - 100) as x, y from v_sheet_labels),
z_public as (select label_id + drawing_id * 1000000000000 as label_id, label, x + 1000000.0 * (drawing_id - 100) as x, y from v_sheet_public),
"""
_SHEET_VIEWS = ("v_sheet_stakes", "v_sheet_lines", "v_sheet_labels", "v_sheet_public")


def _sheets_sql(body: str) -> str:
    for name in ("stakes", "lines", "labels", "public"):
        body = body.replace(f"v_{name}", f"z_{name}")
    return _SHEETS + body


def _sheets(spark, sf_dir) -> drawing.Drawing:
    return drawing.parse_entities(materialise(view(spark, sf_dir, "v_sheets")))


@query("select drawing_id, stake_id::bigint as stake_id, number from v_sheet_stakes", "v_sheet_stakes")
def sheet_stakes(spark, sf_dir):
    """The stakes of many drawings, of both formats, at the same places and with the same ids and names."""
    return _sheets(spark, sf_dir).stakes.select("drawing_id", "stake_id", "number")


@query(_sheets_sql(_EDGES + " select split_part(u, '|', 1)::int as drawing_id, split_part(u, '|', 2) as u, split_part(v, '|', 2) as v from e"), *_SHEET_VIEWS)
def sheet_edges(spark, sf_dir):
    return _sheets(spark, sf_dir).edges.select("drawing_id", "u", "v")


_SHEET_RINGS = _RINGS + _auxiliary_sql(_rings_sql(_faces_sql(_half_sql(_edges_sql("any_name", "true"), "any_name")), "v_labels"), "not contains(x, '|__')") + _unknown_sql(_SHEET)


@query(
    _sheets_sql(_SHEET_RINGS + ", kinds as (" + _KINDS.format("closed") + ") select split_part(ring[1], '|', 1)::int as drawing_id, kind, case when contains(parcel_number, '|') then split_part(parcel_number, '|', 2) else parcel_number end as parcel_number, array_to_string(list_transform(ring, lambda x: split_part(x, '|', 2)), ',') as ring from kinds"),
    *_SHEET_VIEWS,
)
def sheet_rings(spark, sf_dir):
    """Matched, auxiliary and unknown rings of many drawings: lone loops, nested faces, numbers that come twice, faces with open and ringed parcels."""
    return drawing.drawing_rings(_sheets(spark, sf_dir)).withColumn("ring", F.array_join("ring", ","))


@query(_sheets_sql(_POINTS.replace("like '-%'", "like '%|-%'").replace("like '交%'", "like '%|交%'") + "select split_part(intersection_stake, '|', 1)::int as drawing_id, " + ", ".join(f"split_part({n}, '|', 2) as {n}" for n in ("intersection_stake", "baseline_point1", "baseline_point2", "extension_point1", "extension_point2")) + " from pts"), *_SHEET_VIEWS)
def sheet_intersections(spark, sf_dir):
    return drawing.drawing_intersections(_sheets(spark, sf_dir))


# layouts


@query(
    _POINTS
    + """, b as (select *, regexp_extract(intersection_stake, '^[-交]?([0-9]+)\\.', 1) as block from pts), n as (select *, row_number() over (partition by block order by intersection_stake) - 1 as k from b),
    s as (select block || case when k // 15 > 0 then '_' || (k // 15 + 1) else '' end as sheet, [10, 21, 32, 43, 54][((k % 15) // 3 + 1)::int] as r, (k % 15 % 3) * 18 as c, * from n)
    select * from (select sheet, r - 5 as "row", (c + 11)::int as "col", extension_point1 as value from s union all select sheet, r + 2, (c + 2)::int, baseline_point1 from s union all select sheet, r + 2, (c + 8)::int, intersection_stake from s union all select sheet, r + 2, (c + 14)::int, baseline_point2 from s) where value <> ''""",
    "v_stakes",
    "v_lines",
)
def intersection_layout(spark, sf_dir):
    return layout.intersection_layout(intersections(spark, sf_dir), "intersection_stake")


@query(
    """r as (select (label_id // 150) as ring_id, list(number order by label_id) as ring from (select label_id, label_id || '.' || number as number from v_labels) group by 1),
    pg as (select ring_id, 'P' || ring_id % 5 as parcel_number, ring, unnest(range(0, (len(ring) + 99) // 100)) as page from r),
    w as (select *, parcel_number || case when page > 0 then '_' || (page + 1) else '' end as wanted from pg),
    s as (select *, case when row_number() over (partition by wanted order by ring_id, page) = 1 then wanted else wanted || '(' || row_number() over (partition by wanted order by ring_id, page) || ')' end as sheet from w),
    cells as (select ring_id, page, sheet, unnest(range(0, len(ring[page * 100 + 1:page * 100 + 100]))) as i, ring from s)
    select ring_id, page, sheet, (5 + i % 25)::int as "row", ([1, 4, 7, 10][(i // 25 + 1)::int])::int as "col", ring[page * 100 + i + 1] as value from cells
    union all select ring_id, page, sheet, 3, 6, parcel_number from s
    union all select ring_id, page, sheet, 3, 0, regexp_extract(ring[1], '^([0-9]+)\\.', 1) from s""",
    "v_labels",
)
def ring_layout(spark, sf_dir):
    # long runs of labels stand for rings, so that pages fill
    named = view(spark, sf_dir, "v_labels").select("label_id", F.expr("label_id div 150").alias("ring_id"), F.concat(c("label_id").cast("string"), F.lit("."), "number").alias("number"))
    long = named.groupBy("ring_id").agg(F.array_sort(F.collect_list(F.struct("label_id", "number"))).alias("p")).select("ring_id", F.concat(F.lit("P"), (c("ring_id") % 5).cast("string")).alias("parcel_number"), F.transform("p", lambda x: x["number"]).alias("ring"))
    return layout.ring_layout(long).withColumn("page", c("page").cast("long"))


@query("select label_id, case when k = 1 then number else number || '(' || k || ')' end as sheet from (select label_id, number, row_number() over (partition by number order by label_id) as k from (select label_id, number[1:4] as number from v_labels))", "v_labels")
def sheet_names(spark, sf_dir):
    names = view(spark, sf_dir, "v_labels").select("label_id", F.substring("number", 1, 4).alias("number"))
    return layout.sheet_names(names, "number", "label_id").select("label_id", "sheet")


# rasters

_TX = "trunc((lon + 180) / 360 * pow(2, zoom))::int"
_TY = "trunc((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2, zoom))::int"


@query(
    f"t as (select *, {_TX} as tx, {_TY} as ty from v_geo) select id, tx, ty, round(tx / pow(2, zoom) * 360 - 180, 6) as west, round(degrees(atan((exp(pi() * (1 - 2 * ty / pow(2, zoom))) - exp(-pi() * (1 - 2 * ty / pow(2, zoom)))) / 2)), 6) as north, round(2 * pi() * 6378137 * cos(radians(lat)) / (256 * pow(2, zoom)), 6) as width, round(2 * pi() * 6378137 / (256 * pow(2, zoom)), 6) as height from t",
    "v_geo",
)
def tile_math(spark, sf_dir):
    t = view(spark, sf_dir, "v_geo").withColumn("tx", raster.tile_x(c("lon"), c("zoom"))).withColumn("ty", raster.tile_y(c("lat"), c("zoom")))
    return t.select("id", "tx", "ty", F.round(raster.tile_lon(c("tx"), c("zoom")), 6).alias("west"), F.round(raster.tile_lat(c("ty"), c("zoom")), 6).alias("north"), F.round(raster.pixel_width(c("lat"), c("zoom")), 6).alias("width"), F.round(raster.pixel_height(c("zoom")), 6).alias("height"))


@query(
    f"b as (select id, zoom, lat, lon, {_TX} as x1, {_TY} as y2, trunc((lon + 0.05 + 180) / 360 * pow(2, zoom))::int as x2, {_TY.replace('lat', '(lat + 0.04)')} as y1 from v_geo), x as (select id, y1, y2, unnest(range(x1, x2 + 1)) as tx from b) select id, tx::int as tx, unnest(range(y1, y2 + 1))::int as ty from x",
    "v_geo",
)
def tile_cover(spark, sf_dir):
    around = view(spark, sf_dir, "v_geo").select("id", "zoom", c("lat").alias("lat_min"), (c("lat") + 0.04).alias("lat_max"), c("lon").alias("lon_min"), (c("lon") + 0.05).alias("lon_max"))
    return raster.tile_cover(around.where(~raster.too_large(c("lat_min"), c("lat_max"), c("lon_min"), c("lon_max")))).select("id", "tx", "ty")


_RGB = "case when red = 128 and green = 0 and blue = 0 then null when red * 65536 + green * 256 + blue >= 8388608 then (red * 65536 + green * 256 + blue - 16777216) / 100.0 else (red * 65536 + green * 256 + blue) / 100.0 end"


@query(f"select tx, ty, prio, round({_RGB}, 2) as elev from v_tiles", "v_tiles")
def rgb_elevation(spark, sf_dir):
    return view(spark, sf_dir, "v_tiles").select("tx", "ty", "prio", F.round(raster.rgb_elevation(c("red"), c("green"), c("blue")), 2).alias("elev"))


@query("select r, c, coalesce(greatest(-32767, least(32767, round_even(elev * 10, 0)::bigint)), -32768)::smallint as q from v_dem", "v_dem")
def dem_quantise(spark, sf_dir):
    return view(spark, sf_dir, "v_dem").select("r", "c", raster.quantise(c("elev")).alias("q"))


@query("select tx, ty, arg_min(prio, prio) as prio, arg_min(body, prio) as body from v_tiles where trim(body) <> '' group by tx, ty", "v_tiles")
def tile_fallback(spark, sf_dir):
    return raster.preferred_tiles(view(spark, sf_dir, "v_tiles")).select("tx", "ty", "prio", "body")


@query(
    """t as (select tx, ty, arg_min(body, prio) as body from v_tiles where trim(body) <> '' group by tx, ty), corner as (select min(tx) as x0, min(ty) as y0 from t),
    g as (select tx, ty, string_split(body, ',') as v, a.i as row_, b.i as col_ from t, (select unnest(range(4)) as i) a, (select unnest(range(4)) as i) b)
    select ((ty - y0) * 4 + row_)::int as "row", ((tx - x0) * 4 + col_)::int as "col", case when row_ = 0 then try_cast(v[(col_ + 1)::int] as double) end as elev from g, corner""",
    "v_tiles",
)
def tile_mosaic(spark, sf_dir):
    return raster.mosaic(raster.tile_pixels(raster.preferred_tiles(view(spark, sf_dir, "v_tiles")), 4), 4)


_WIDTH, _HEIGHT = 5.0, 4.0
_SLOPE = """
z as (select r, c, elev, coalesce(elev, (select avg(elev) from v_dem)) as z from v_dem),
n as (select *, lag(z) over (partition by r order by c) as cb, lead(z) over (partition by r order by c) as ca, lag(z) over (partition by c order by r) as rb, lead(z) over (partition by c order by r) as ra from z),
gr as (select *, case when ca is not null and cb is not null then (ca - cb) / 10.0 when ca is not null then (ca - z) / 5.0 when cb is not null then (z - cb) / 5.0 else 0 end as gx, case when ra is not null and rb is not null then (ra - rb) / 8.0 when ra is not null then (ra - z) / 4.0 when rb is not null then (z - rb) / 4.0 else 0 end as gy from n),
sl as (select r, c, case when elev is not null then degrees(atan(sqrt(gx * gx + gy * gy))) end as s from gr),
cl as (select *, case when s >= 0 and s < 5 then 0 when s >= 5 and s < 15 then 1 when s >= 15 and s < 25 then 2 when s >= 25 and s < 35 then 3 when s >= 35 and s < 45 then 4 when s >= 45 and s < 90 then 5 else -1 end as class from sl)
"""


def _slope(spark, sf_dir):
    return raster.slope(view(spark, sf_dir, "v_dem").select(c("r").alias("row"), c("c").alias("col"), "elev"), _WIDTH, _HEIGHT)


@query(_SLOPE + 'select r as "row", c as "col", round(s, 6) as slope from sl', "v_dem")
def slope(spark, sf_dir):
    return _slope(spark, sf_dir).select("row", "col", F.round("slope", 6).alias("slope"))


@query(_SLOPE + 'select r as "row", c as "col", class from cl', "v_dem")
def slope_class(spark, sf_dir):
    return _slope(spark, sf_dir).select("row", "col", raster.slope_class(c("slope")).alias("class"))


_BOUNDS = (36.0, 35.9, 139.0, 139.1)
_POLYGON = [(139.01, 35.91), (139.09, 35.92), (139.08, 35.99), (139.05, 35.95), (139.02, 35.985)]


def _inside(x: str, y: str) -> str:
    sides = [f"case when ({y1} > {y}) <> ({y2} > {y}) and {x} < {x2 - x1!r} * ({y} - {y1}) / {y2 - y1!r} + {x1} then 1 else 0 end" for (x1, y1), (x2, y2) in zip(_POLYGON, [*_POLYGON[1:], _POLYGON[0]], strict=True)]
    return f"({' + '.join(sides)}) % 2 = 1"


_ZONAL = (
    _SLOPE
    + f""", px as (select *, 36.0::double + r * (({_BOUNDS[1]}::double - {_BOUNDS[0]}::double) / (select max(r) from v_dem)) as lat, 139.0::double + c * (({_BOUNDS[3]}::double - {_BOUNDS[2]}::double) / (select max(c) from v_dem)) as lon from cl),
cnt as (select class, count(*) as n from px where class >= 0 and {_inside('lon', 'lat')} group by 1),
names as (select * from (values {", ".join(f"({i}, '{n}', '{k}')" for i, (_, _, n, k) in enumerate(raster.SLOPE_CLASSES))}) t(class, name, color)),
zs as (select class, name, color, coalesce(n, 0) as n, round(coalesce(n, 0) * 20.0, 1) as area_m2, round(round(coalesce(n, 0) * 20.0, 1) / 10000, 3) as area_ha, round(case when (select sum(n) from cnt) > 0 then coalesce(n, 0)::double * 100 / (select sum(n) from cnt) else 0 end, 2) as percent from names left join cnt using (class))
"""
)


@query(_ZONAL + "select * from zs", "v_dem")
def zonal_stats(spark, sf_dir):
    return raster.zonal_stats(spark, _slope(spark, sf_dir), _POLYGON, _BOUNDS, _WIDTH * _HEIGHT)


@query(_SLOPE + 'select r as "row", c as "col", round(s, 6) as slope from sl', "v_dem")
def slope_by_blocks(spark, sf_dir):
    """Slope over blocks of 16 x 16 pixels, of which only borders are shuffled."""
    pixels = view(spark, sf_dir, "v_dem").select(c("r").alias("row"), c("c").alias("col"), "elev")
    return blocks.slope_blocks(materialise(blocks.pixel_blocks(pixels, 16)), _WIDTH, _HEIGHT, 16).select("row", "col", F.round("slope", 6).alias("slope"))


@query(
    _SLOPE
    + f""", px as (select *, 36.0::double + r * (({_BOUNDS[1]}::double - {_BOUNDS[0]}::double) / (select max(r) from v_dem)) as lat, 139.0::double + c * (({_BOUNDS[3]}::double - {_BOUNDS[2]}::double) / (select max(c) from v_dem)) as lon from cl),
vz as (select zone_id, place, lon::double as lon, lat::double as lat from v_zones),
sd as (select a.zone_id, a.lon as x1, a.lat as y1, b.lon as x2, b.lat as y2 from vz a join vz b on b.zone_id = a.zone_id and b.place = (a.place + 1) % (3 + a.zone_id % 5)),
hit as (select zone_id, r, c, class from px join sd on (y1 > lat) <> (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 where class >= 0 group by all having count(*) % 2 = 1),
cnt as (select zone_id, class, count(*) as n from hit group by all),
names as (select * from (values {", ".join(f"({i}, '{n}', '{k}')" for i, (_, _, n, k) in enumerate(raster.SLOPE_CLASSES))}) t(class, name, color)),
al as (select zone_id, names.*, coalesce(n, 0) as n, sum(coalesce(n, 0)) over (partition by zone_id) as total from (select distinct zone_id from vz) z cross join names left join cnt using (zone_id, class))
select zone_id, class, name, color, n, round(n * 20.0, 1) as area_m2, round(round(n * 20.0, 1) / 10000, 3) as area_ha, round(case when total > 0 then n::double * 100 / total else 0 end, 2) as percent from al""",
    "v_dem",
    "v_zones",
)
def zonal_stats_of_many(spark, sf_dir):
    """Slope classes inside of many overlapping polygons, some of which cross themselves."""
    zones = view(spark, sf_dir, "v_zones").select("zone_id", "place", c("lon").cast("double").alias("lon"), c("lat").cast("double").alias("lat"))
    return blocks.zonal_stats_of_many(_slope(spark, sf_dir), zones, _BOUNDS, _WIDTH * _HEIGHT)


@query(_ZONAL + "select round(sum(percent / 100 * (1 + class * 0.25)), 4) as coefficient from zs", "v_dem")
def weighted_coef(spark, sf_dir):
    return zonal_stats(spark, sf_dir).agg(F.round(F.sum(c("percent") / 100 * (1 + c("class") * 0.25)), 4).alias("coefficient"))


@query("select round(count(elev) * 100.0::double / count(*), 6) as valid_percent from v_dem", "v_dem")
def valid_percent(spark, sf_dir):
    return raster.valid_percent(view(spark, sf_dir, "v_dem")).select(F.round("valid_percent", 6).alias("valid_percent"))


_NORTH = "degrees(atan((exp(pi() * (1 - 2 * {0} / pow(2, 15))) - exp(-pi() * (1 - 2 * {0} / pow(2, 15)))) / 2))"


@query(f"e as (select min(tx) as x1, max(tx) + 1 as x2, min(ty) as y1, max(ty) + 1 as y2 from v_tiles) select round({_NORTH.format('y1')}, 6) as north, round({_NORTH.format('y2')}, 6) as south, round(x1 / pow(2, 15) * 360 - 180, 6) as west, round(x2 / pow(2, 15) * 360 - 180, 6) as east from e", "v_tiles")
def mosaic_bounds(spark, sf_dir):
    ends = raster.mosaic_bounds(view(spark, sf_dir, "v_tiles"), 15)
    return ends.select(*[F.round(x, 6).alias(x) for x in ends.columns])


# scanned pages


@query(
    """o as (select *, row_number() over (partition by page order by y_top, x_left, box_id) as k from v_boxes),
    f as (select page, k, box_id, text, conf, x_left, y_top, y_top as top, 0 as row_no from o where k = 1
      union all select o.page, o.k, o.box_id, o.text, o.conf, o.x_left, o.y_top, case when o.y_top - f.top > 15 then o.y_top else f.top end, f.row_no + case when o.y_top - f.top > 15 then 1 else 0 end from f join o on o.page = f.page and o.k = f.k + 1)
    select page, row_no, string_agg(text, ' ' order by x_left, y_top, box_id) as text, round(avg(conf), 3) as confidence, count(*) as n_boxes from f group by page, row_no""",
    "v_boxes",
)
def text_rows(spark, sf_dir):
    return boxes.group_text_rows(view(spark, sf_dir, "v_boxes")).select("page", "row_no", "text", F.round("confidence", 3).alias("confidence"), "n_boxes")


@query(
    "select model, count(*) as n_runs, count(*) filter (failed) as n_errors, round(coalesce(sum(elapsed) filter (not failed), 0), 4) as total_s, round(avg(elapsed) filter (not failed), 6) as avg_s, coalesce(sum(input_tokens) filter (not failed), 0)::bigint as input_tokens, coalesce(sum(output_tokens) filter (not failed), 0)::bigint as output_tokens, round((coalesce(sum(input_tokens) filter (not failed), 0) * 2.5 + coalesce(sum(output_tokens) filter (not failed), 0) * 10.0) / 1e6, 6) as cost from v_runs group by 1",
    "v_runs",
)
def engine_summary(spark, sf_dir):
    out = boxes.engine_summary(view(spark, sf_dir, "v_runs"), 2.5, 10.0)
    return out.withColumns({"total_s": F.round("total_s", 4), "avg_s": F.round("avg_s", 6), "cost": F.round("cost", 6)})


# further compositions


@query(
    "select o_orderkey, 'only_a' as side from v_snap_a where o_orderkey not in (select o_orderkey from v_snap_b) union all select o_orderkey, 'only_b' from v_snap_b where o_orderkey not in (select o_orderkey from v_snap_a) union all select o_orderkey, 'both' from v_snap_a where o_orderkey in (select o_orderkey from v_snap_b)",
    "v_snap_a",
    "v_snap_b",
)
def diff_key_sets(spark, sf_dir):
    return diff.key_sets(view(spark, sf_dir, "v_snap_a"), view(spark, sf_dir, "v_snap_b"), ["o_orderkey"])


@query(
    _DIFF
    + """, x as (select c_custkey::varchar as key, to_json({'c_name': c_name, 'c_mktsegment': c_mktsegment})::varchar as v, c_name as n from customer where c_custkey % 5 <> 0), y as (select c_custkey::varchar as key, to_json({'c_name': case when c_custkey % 3 = 0 then 'new' else c_name end, 'c_mktsegment': c_mktsegment})::varchar as v, case when c_custkey % 3 = 0 then 'new' else c_name end as n from customer where c_custkey % 5 <> 1)
    select 'orders' as "table", o_orderkey || '|' || o_custkey as key, kind, "column", value from diff
    union all select 'customer', key, 'only_a', '', v from x where key not in (select key from y)
    union all select 'customer', key, 'only_b', '', v from y where key not in (select key from x)
    union all select 'customer', x.key, 'changed', 'c_name', x.n || ' → ' || y.n from x join y using (key) where x.n <> y.n""",
    "v_snap_a",
    "v_snap_b",
)
def snapshot_diff(spark, sf_dir):
    a, b = view(spark, sf_dir, "v_snap_a"), view(spark, sf_dir, "v_snap_b")
    people = spark.table("customer").select("c_custkey", "c_name", "c_mktsegment")
    older = people.where("c_custkey % 5 <> 0")
    newer = people.where("c_custkey % 5 <> 1").withColumn("c_name", F.when(c("c_custkey") % 3 == 0, "new").otherwise(c("c_name")))
    return diff.snapshot_diff({"orders": a, "customer": older}, {"orders": b, "customer": newer})[0]


# the lines of each file one after the other: the last entry's number, parcel and area, and the rows written so far
_MERGE = """
n as (select *, row_number() over (partition by file_no order by line_idx) as k, sum(case when regexp_full_match(entry, '[0-9]+') then 1 else 0 end) over (partition by file_no order by line_idx) as g,
  coalesce(lag(page) over (partition by file_no order by line_idx) <> page, true) as heads, lead(entry, 1) over w as e1, lead(area, 1) over w as a1, lead(entry, 2) over w as e2, lead(area, 2) over w as a2 from v_seq window w as (partition by file_no order by line_idx)),
twice as (select distinct x.line_idx from n x join n y on y.file_no = x.file_no and y.k between x.k + 1 and x.k + 9 and y.entry = '続' and y.g > x.g and y.owner_name = x.owner_name where x.entry = '続'),
l as (select n.*, n.line_idx in (select line_idx from twice) as dup, heads and not coalesce(case when e1 not in ('続', '続更新', '') then a1 when e2 not in ('続', '続更新', '') then a2 end = area, false) as valid from n),
st as (select file_no, 0::bigint as k, null::varchar as num, ''::varchar as parcel, ''::varchar as ar, []::struct(i bigint, page int, entry varchar, parcel varchar, area varchar, owner varchar)[] as rows_ from (select distinct file_no from v_seq)
  union all
  select file_no, k, num2, parcel2, ar2, case
    when entry = '続更新' then case when valid and num is not null and area <> '' then list_transform(rows_, lambda x, i: case when i = list_position(list_reverse(list_transform(rows_, lambda y: y.parcel = parcel2)), true) * -1 + len(rows_) + 1 then {'i': x.i, 'page': x.page, 'entry': x.entry, 'parcel': x.parcel, 'area': area, 'owner': x.owner} else x end) else rows_ end
    when entry = '続表題' then case when num is null then rows_ else list_append(list_transform(rows_, lambda x, i: case when i = coalesce(list_position(list_reverse(list_transform(rows_, lambda y: y.entry = num and y.parcel = '')), true), -9) * -1 + len(rows_) + 1 then {'i': x.i, 'page': x.page, 'entry': x.entry, 'parcel': parcel2, 'area': ar2, 'owner': x.owner} else x end), {'i': line_idx, 'page': page, 'entry': num, 'parcel': parcel2, 'area': ar2, 'owner': owner_name}) end
    when entry = '続' then case when dup then rows_ when num is null then list_append(rows_, {'i': line_idx, 'page': page, 'entry': entry, 'parcel': parcel_no, 'area': area, 'owner': owner_name}) else list_append(rows_, {'i': line_idx, 'page': page, 'entry': num, 'parcel': parcel, 'area': ar, 'owner': owner_name}) end
    else list_append(rows_, {'i': line_idx, 'page': page, 'entry': entry, 'parcel': parcel_no, 'area': area, 'owner': owner_name}) end
  from (select st.file_no, l.k, l.line_idx, l.page, l.entry, l.parcel_no, l.area, l.owner_name, l.dup, l.valid, st.num, st.parcel, st.ar, st.rows_,
    case when l.entry in ('続', '続更新', '続表題') then st.num else l.entry end as num2,
    case when l.entry in ('続', '続更新') then st.parcel when l.entry = '続表題' then case when st.num is not null and st.parcel = '' then l.parcel_no else st.parcel end else l.parcel_no end as parcel2,
    case when l.entry = '続' then st.ar when l.entry = '続更新' then case when l.valid and st.num is not null and l.area <> '' then l.area else st.ar end when l.entry = '続表題' then case when st.num is not null and st.ar = '' then l.area else st.ar end else l.area end as ar2
    from st join l on l.file_no = st.file_no and l.k = st.k + 1))
select r.i as line_idx, file_no, r.page as page, r.entry as entry, r.parcel as parcel_no, r.area as area, r.owner as owner_name from (select file_no, unnest(rows_) as r from st where (file_no, k) in (select file_no, max(k) from l group by 1))
"""


@query(_MERGE, "v_seq")
def merge_ocr_lines(spark, sf_dir):
    return sequence.merge_lines(view(spark, sf_dir, "v_seq"), across=False)


# all lines of all files, one after the other: the last entry, the blank lines written so far, and what each step changes in an earlier line
_SCANS = """
n as (select *, row_number() over (order by file_no, line_idx) as k, sum(case when regexp_full_match(entry, '[0-9]+') then 1 else 0 end) over (order by file_no, line_idx) as g,
  coalesce(lag(page) over w <> page, true) as heads, lead(entry, 1) over w as e1, lead(area, 1) over w as a1, lead(entry, 2) over w as e2, lead(area, 2) over w as a2 from v_scans window w as (order by file_no, line_idx)),
twice as (select distinct x.k from n x join n y on y.k between x.k + 1 and x.k + 9 and y.entry = '続' and y.g > x.g and y.owner_name = x.owner_name where x.entry = '続'),
l as (select n.*, n.k in (select k from twice) as dup, heads and not coalesce(case when e1 not in ('続', '続更新', '') then a1 when e2 not in ('続', '続更新', '') then a2 end = area, false) as valid from n),
st as (select 0::bigint as k, null::varchar as num, ''::varchar as parcel, ''::varchar as ar, []::struct(k bigint, num varchar)[] as blanks, 0::bigint as prev, false as out, 0::bigint as target, ''::varchar as t_parcel, ''::varchar as t_area, ''::varchar as o_num, ''::varchar as o_parcel, ''::varchar as o_area
  union all
  select k, num2, parcel2, ar2,
    case when out2 and o_num2 <> '続' and o_parcel2 = '' then list_append(left_, {'k': k, 'num': o_num2}) else left_ end,
    case when out2 then k else prev end, out2,
    case when entry = '続表題' then coalesce(hit, 0) when entry = '続更新' and valid and num is not null and area <> '' then prev else 0 end,
    case when entry = '続表題' then parcel2 end, case when entry = '続表題' then ar2 else area end, o_num2, o_parcel2, o_area2
  from (select *, case when entry = '続表題' and parcel2 <> '' and hit is not null then list_filter(blanks, lambda x: x.k <> hit) else blanks end as left_,
      case when entry = '続更新' then false when entry = '続表題' then num is not null when entry = '続' then not dup else true end as out2,
      case when entry in ('続', '続表題') and num is not null then num else entry end as o_num2,
      case when entry in ('続', '続表題') and num is not null then parcel2 else parcel_no end as o_parcel2, case when entry in ('続', '続表題') and num is not null then ar2 else area end as o_area2
    from (select l.*, st.num, st.prev, st.blanks,
      case when num is null then null else list_max(list_transform(list_filter(st.blanks, lambda x: x.num = st.num), lambda x: x.k)) end as hit,
      case when l.entry in ('続', '続更新', '続表題') then st.num else l.entry end as num2,
      case when l.entry in ('続', '続更新') then st.parcel when l.entry = '続表題' then case when st.num is not null and st.parcel = '' then l.parcel_no else st.parcel end else l.parcel_no end as parcel2,
      case when l.entry = '続' then st.ar when l.entry = '続更新' then case when l.valid and st.num is not null and l.area <> '' then l.area else st.ar end when l.entry = '続表題' then case when st.num is not null and st.ar = '' then l.area else st.ar end else l.area end as ar2
      from st join l on l.k = st.k + 1) a) b),
patch as (select target, arg_max(t_parcel, k) filter (t_parcel is not null) as p, arg_max(t_area, k) as a from st where target > 0 group by 1)
select l.line_idx, l.file_no, l.page, o_num as entry, coalesce(p, o_parcel) as parcel_no, coalesce(a, o_area) as area, l.owner_name from st join l using (k) left join patch on patch.target = st.k where out
"""


@query(_SCANS, "v_scans")
def merge_scans(spark, sf_dir):
    """Files read as one sequence, with blank completions, numbers that come again and entries that go on in the next file."""
    return sequence.merge_lines(view(spark, sf_dir, "v_scans"))


@query(
    _group("entry in ('続', '続更新')")
    + """, u as (select *, case when entry = '続更新' and trim(area) <> '' then area end as new from g where g > 0 or entry = '続'),
    x as (select u.*, b.number, b.bp, coalesce(last_value(new ignore nulls) over (partition by u.file_no, u.g order by line_idx), b.ba) as now, coalesce(lead(line_idx) over (partition by u.file_no, u.g, entry = '続更新' order by line_idx), 9e18) as until from u left join b on b.file_no = u.file_no and b.g = u.g),
    y as (select x.*, (select arg_max(new, line_idx) from u z where z.file_no = x.file_no and z.g = x.g and z.entry = '続更新' and z.new is not null and z.line_idx > x.line_idx and z.line_idx < x.until) as patch from x where entry <> '続更新')
    select line_idx, file_no, page, coalesce(number, entry) as entry, case when entry = '続' and number is not null then bp else parcel_no end as parcel_no, case when number is null then area when patch is not null then patch when entry = '続' then now else area end as area, owner_name from y""",
    "v_seq",
)
def merge_lines_v1(spark, sf_dir):
    return sequence.merge_lines(_entries(spark, sf_dir, "続", "続更新"), checked=False, across=False)


@query(
    _RECONCILE
    + f"""select status as item, count(*) as n from rec group by 1 union all select 'land_use_' || land_use_change, count(*) from rec where land_use_change <> '' group by 1
    union all select 'area_' || area_change, count(*) from rec where area_change <> '' group by 1 union all select '消失', count(*) from gone group by 1 union all select '追加', count(*) from fresh group by 1""",
    "v_records",
    "v_ocr",
)
def reconcile_breakdown(spark, sf_dir):
    source, read = _source(spark, sf_dir), _read(spark, sf_dir)
    return reconcile.breakdown(reconcile.reconcile(source, read), _owner_differences(source, read))

"""Scanned registry lines against the source export: column repair, matching, and what really changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .graph import parts_for

COLUMNS = 9


def response_lines(c: Column) -> Column:
    """Trimmed lines of a reader's answer, without blank ones and code fences."""
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("```"))


def repair_arity(line: Column, columns: int = COLUMNS) -> Column:
    """The comma-separated fields of a line: padded with empty ones, what is too many joined into the last; markers emptied."""
    parts = F.split(line, ",")
    fixed = F.when(F.size(parts) > columns, F.concat(F.slice(parts, 1, columns - 1), F.array(F.array_join(F.slice(parts, F.lit(columns), F.size(parts)), ",")))).otherwise(F.concat(parts, F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.lit(columns) - F.size(parts)))))
    return F.transform(fixed, tx.without_marker)


def valid_parcel(c: Column) -> Column:
    """Whether a read parcel number starts with a digit and is no address."""
    t = tx.nfkc(tx.without_marker(c))
    return t.rlike("^[0-9]") & ~t.contains("番地")


def repair_owner(rows: DataFrame) -> DataFrame:
    """rows with addr, share and name moved to where they belong.

    In turn, each rule on what the one before left: an address alone that reads as a name is the name; a share that reads as a
    name (no 持分, era date or receipt) fills an empty name; a date or receipt as the name gives way to the share if that
    reads as a name, else to the address if that does, else to nothing.
    """
    dated = lambda c: c.rlike(tx.ERA_DATE) | c.rlike(tx.RECEIPT)
    addr, share, name = F.col("addr"), F.col("share"), F.col("name")
    blank = lambda c: c == ""
    out = rows.withColumns({c: F.trim(tx.text(F.col(c))) for c in ("addr", "share", "name")})
    alone = ~blank(addr) & blank(share) & blank(name) & tx.looks_like_name(addr)
    out = out.withColumns({"addr": F.when(alone, "").otherwise(addr), "name": F.when(alone, addr).otherwise(name)})
    named = tx.looks_like_name(share) & ~share.startswith("持分") & ~dated(share)
    out = out.withColumns({"share": F.when(named & blank(name), "").otherwise(share), "name": F.when(named & blank(name), share).otherwise(name)})
    wrong, person = dated(name), tx.looks_like_name(addr)
    moved = F.when(wrong & named, share).when(wrong & person, addr).when(wrong, "").otherwise(name)
    return out.withColumns({"name": moved, "share": F.when(wrong & named, "").otherwise(share), "addr": F.when(wrong & ~named & person, "").otherwise(addr)})


def repair_owner_v1(rows: DataFrame) -> DataFrame:
    """The earlier rule: with a date as the name, or a share that is neither blank, 持分… nor a date, the share is the name, the name the date and
    the date the receipt (columns registered and receipt, where there are such).
    """
    share, name = F.trim(tx.text(F.col("share"))), F.trim(tx.text(F.col("name")))
    off = name.rlike(tx.ERA_DATE) | ((share != "") & ~share.startswith("持分") & ~share.rlike(tx.ERA_DATE))
    moved = {"addr": F.trim(tx.text(F.col("addr"))), "share": F.when(off, "").otherwise(share), "name": F.when(off, share).otherwise(name)}
    if "registered" in rows.columns:
        date = F.trim(tx.text(F.col("registered")))
        moved["registered"] = F.when(off, name).otherwise(date)
        if "receipt" in rows.columns:
            moved["receipt"] = F.when(off, date).otherwise(F.trim(tx.text(F.col("receipt"))))
    return rows.withColumns(moved)


def read_properties(rows: DataFrame, early: bool = False) -> DataFrame:
    """One row per parcel from scanned rows (line_idx, page, file and the columns of a line): key, location, parcel_no, land_use, area,
    owners (address, share, name), page, file.

    Rows whose parcel number is no such are left out. A parcel's first row gives its attributes; every row with an owner's name or
    address appends one, after its columns are put right (early: by the earlier rule).
    """
    clean = rows.withColumns({c: tx.without_marker(F.col(c)) for c in ("location", "parcel_no", "land_use", "area", "addr", "share", "name")}).where(valid_parcel(F.col("parcel_no")))
    fixed = (repair_owner_v1 if early else repair_owner)(clean).withColumn("key", tx.parcel_key(F.col("parcel_no")))
    owner = F.struct(F.col("addr").alias("address"), "share", "name")
    first = F.min_by(F.struct("location", "parcel_no", "land_use", "area", "page", "file"), F.struct("file", "line_idx"))
    named = F.when((F.col("name") != "") | (F.col("addr") != ""), F.struct("file", "line_idx", owner.alias("o")))
    out = fixed.groupBy("key").agg(first.alias("p"), F.array_sort(F.collect_list(named)).alias("owners"))
    return out.select("key", "p.*", F.transform("owners", lambda x: x["o"]).alias("owners"))


OWNER_GONE, OWNER_NEW, OWNER_FORM = "消失", "追加", "異体字差異"


def match_owners(source: DataFrame, read: DataFrame) -> DataFrame:
    """(key, kind, source_name, read_name, source_address, read_address) of owners (key, name and, if known, address) that do not match.

    Equal normalised names match; of several on one side the last counts (by column ord, where there is one). What is left pairs off, in sorted order, where only character forms differ (異体字差異);
    the rest are 消失 (source only) and 追加 (read only).
    """
    address = lambda df: F.col("address") if "address" in df.columns else F.lit("")
    place = lambda df: (F.col("ord") if "ord" in df.columns else F.lit(0)).alias("o")
    sides = [df.select("key", place(df), tx.name_key(F.col("name")).alias("n"), F.struct(F.col("name").alias("name"), address(df).alias("address")).alias(shown)).where("n <> ''").groupBy("key", "n").agg(F.max_by(shown, F.struct("o", shown)).alias(shown)) for df, shown in ((source, "s"), (read, "r"))]
    left = [a.join(b.select("key", "n"), ["key", "n"], "left_anti").withColumn("f", tx.old_form_fold(F.col("n"))).withColumn("k", F.row_number().over(Window.partitionBy("key", "f").orderBy("n"))).drop("n") for a, b in (sides, sides[::-1])]
    both = left[0].join(left[1], ["key", "f", "k"], "full_outer")
    kind = F.when(F.col("r").isNull(), OWNER_GONE).when(F.col("s").isNull(), OWNER_NEW).otherwise(OWNER_FORM)
    return both.select("key", kind.alias("kind"), *[F.coalesce(f"{side}.{c}", F.lit("")).alias(f"{name}_{c}") for c in ("name", "address") for side, name in (("s", "source"), ("r", "read"))])


def reconcile(source: DataFrame, read: DataFrame) -> DataFrame:
    """Every parcel of either side: key, status, location, land_use_change, area_change, land_use, area, the two sides' values, owners and places.

    source: key, location, land_use, area, old_land_uses (array), owners, file. read: key, location, land_use, area, owners, page. status: both,
    source_only or read_only. location is the first not blank of read and source. A
    change counts only where both sides have a value; a read land use that is one of the source's old values, and an area
    that lost its decimal point, are 'corrected' and the source's value stands. Owners are listed by name in their order, and counted;
    what differs between them is match_owners' work.
    """
    s = source.select("key", F.struct("location", "land_use", "area", "old_land_uses", "owners", "file").alias("s"))
    r = read.select("key", F.struct("location", "land_use", "area", "owners", "page").alias("r"))
    parts = parts_for(source, read)
    both = s.repartition(parts, "key").join(r.repartition(parts, "key"), "key", "full_outer")
    status = F.when(F.col("s").isNull(), "read_only").when(F.col("r").isNull(), "source_only").otherwise("both")
    names = lambda owners: F.array_join(F.filter(F.transform(owners, lambda o: o["name"]), lambda n: n != ""), ", ")
    location = F.coalesce(F.nullif("r.location", F.lit("")), F.nullif("s.location", F.lit("")), F.lit(""))
    values = {n: tx.text(F.col(c)).alias(n) for n, c in (("source_land_use", "s.land_use"), ("read_land_use", "r.land_use"), ("source_area", "s.area"), ("read_area", "r.area"))}
    plain = both.select("key", status.alias("status"), location.alias("location"), *values.values(), *[tx.text(names(F.col(f"{x}.owners"))).alias(f"{n}_owners") for x, n in (("s", "source"), ("r", "read"))], *[F.coalesce(F.size(f"{x}.owners"), F.lit(0)).alias(f"{n}_owner_count") for x, n in (("s", "source"), ("r", "read"))], tx.text(F.col("s.file")).alias("file"), tx.text(F.col("r.page")).alias("page"), F.col("s.old_land_uses").alias("_old"))
    su, ru, sa, ra = (F.col(c) for c in values)
    # the normal forms are written out once, and only where the cells as they are differ
    unlike = lambda a, b: (a != "") & (b != "") & (a != b)
    formed = plain.withColumns({"_su": F.when(unlike(su, ru), tx.normalize(su)), "_ru": F.when(unlike(su, ru), tx.normalize(ru)), "_sa": F.when(unlike(sa, ra), tx.area(sa)), "_ra": F.when(unlike(sa, ra), tx.area(ra))})
    misread = F.coalesce(F.exists("_old", lambda x: tx.normalize(x) == F.col("_ru")), F.lit(False))
    lost = F.col("_sa").contains(".") & (tx.cross_checked_area(sa, ra) == F.col("_sa"))
    use = F.when(F.col("_su") != F.col("_ru"), F.when(misread, "corrected").otherwise("changed")).otherwise("")
    area = F.when(F.col("_sa") != F.col("_ra"), F.when(lost, "corrected").otherwise("changed")).otherwise("")
    out = formed.withColumns({"land_use_change": use, "area_change": area})
    pick = lambda change, a, b: F.when(F.col(change) == "changed", b).when(a != "", a).otherwise(b)
    order = ["key", "status", "location", "land_use_change", "area_change", *values, "source_owners", "read_owners", "source_owner_count", "read_owner_count", "file", "page"]
    return out.select(*order, pick("land_use_change", su, ru).alias("land_use"), pick("area_change", sa, ra).alias("area"))


def full_comparison(reconciled: DataFrame, owners: DataFrame) -> DataFrame:
    """One row for each parcel on both sides: what the two say, what changed, and which read values were put right.

    land_use_new is the source's value where the read one is misread; area_new shows a corrected area behind the read one. owner_changed: whether
    match_owners (owners) has a row for the parcel.
    """
    parts = parts_for(owners, reconciled)
    both = reconciled.where("status = 'both'").repartition(parts, "key").join(owners.select("key").repartition(parts, "key").distinct().withColumn("_owner", F.lit(True)), "key", "left")
    fixed = F.when(F.col("area_change") == "corrected", F.concat("read_area", F.lit("→補正:"), "source_area")).otherwise(F.col("read_area"))
    return both.select(
        "key",
        "location",
        F.col("source_land_use").alias("land_use_old"),
        F.when(F.col("land_use_change") == "corrected", F.col("source_land_use")).otherwise(F.col("read_land_use")).alias("land_use_new"),
        (F.col("land_use_change") == "changed").alias("land_use_changed"),
        (F.col("land_use_change") == "corrected").alias("land_use_misread"),
        F.col("source_area").alias("area_old"),
        fixed.alias("area_new"),
        (F.col("area_change") == "changed").alias("area_changed"),
        F.col("source_owners").alias("owner_old"),
        F.col("read_owners").alias("owner_new"),
        F.coalesce("_owner", F.lit(False)).alias("owner_changed"),
        "page",
        "file",
        F.col("source_owner_count").alias("owner_count_old"),
        F.col("read_owner_count").alias("owner_count_new"),
    )


#: Names and wording of the report's rows.
_ITEMS = {
    ("land_use", "changed"): "地目",
    ("land_use", "corrected"): "地目（OCR補正）",
    ("area", "changed"): "地積",
    ("area", "corrected"): "地積（小数点補正）",
    OWNER_FORM: "所有者（異体字）",
    OWNER_GONE: "所有者（消失）",
    OWNER_NEW: "所有者（追加）",
}
_DOT_NOTE = "小数点の縦点線がOCRで認識されなかった可能性"
_FORM_NOTE = "異体字差異の可能性あり — 要目視確認"
_NOT_READ, _NOT_IN_SOURCE = "（OCRに該当なし）", "（照合元に該当なし）"
_SOURCE_ONLY = ("照合元のみ", "OCR結果に該当なし（PDF範囲外の可能性）")
_READ_ONLY = ("OCRのみ", "照合元に該当なし（新規取得・範囲外の可能性）")
_MISREAD_USE = ("OCR読取値: ", "補正後: ", "（照合元と一致）")
_MISREAD_AREA = ("照合元: ", "OCR読取値: ", "（整数部一致、小数点読み落とし）")
_ADDRESS = ("照合元住所: ", "OCR住所: ")


def changes(reconciled: DataFrame, owners: DataFrame) -> DataFrame:
    """(key, item_ord, location, item, old_value, new_value, page, note): the report's rows of parcels on both sides; corrections say so."""
    both = reconciled.where("status = 'both'")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    row = lambda at, item, old, new, note: F.struct(F.lit(at).alias("item_ord"), F.lit(item).alias("item"), old.alias("old_value"), new.alias("new_value"), F.lit(note).alias("note"))
    su, ru, sa, ra = (F.col(c) for c in ("source_land_use", "read_land_use", "source_area", "read_area"))
    fixed = F.array_compact(
        F.array(
            F.when(F.col("land_use_change") == "changed", row(1, _ITEMS["land_use", "changed"], su, ru, "")),
            F.when(F.col("land_use_change") == "corrected", row(2, _ITEMS["land_use", "corrected"], say(_MISREAD_USE[0], ru), say(_MISREAD_USE[1], su, _MISREAD_USE[2]), "")),
            F.when(F.col("area_change") == "changed", row(3, _ITEMS["area", "changed"], sa, ra, "")),
            F.when(F.col("area_change") == "corrected", row(4, _ITEMS["area", "corrected"], say(_MISREAD_AREA[0], sa), say(_MISREAD_AREA[1], ra, _MISREAD_AREA[2]), _DOT_NOTE)),
        )
    )
    values = both.select("key", "location", "page", F.explode(fixed).alias("c")).select("key", "c.item_ord", "location", "c.item", "c.old_value", "c.new_value", "page", "c.note")
    kind = F.col("kind")
    item = F.when(kind == OWNER_FORM, _ITEMS[OWNER_FORM]).when(kind == OWNER_GONE, _ITEMS[OWNER_GONE]).otherwise(_ITEMS[OWNER_NEW])
    old = F.when(kind == OWNER_NEW, _NOT_IN_SOURCE).otherwise(F.col("source_name"))
    new = F.when(kind == OWNER_GONE, _NOT_READ).otherwise(F.col("read_name"))
    noted = lambda text, c: F.when(c != "", F.concat(F.lit(text), c)).otherwise("")
    note = F.when(kind == OWNER_FORM, _FORM_NOTE).when(kind == OWNER_GONE, noted(_ADDRESS[0], F.col("source_address"))).otherwise(noted(_ADDRESS[1], F.col("read_address")))
    parts = parts_for(owners, reconciled)
    people = owners.repartition(parts, "key").join(both.select("key", "location", "page").repartition(parts, "key"), "key").select("key", F.lit(5).alias("item_ord"), "location", item.alias("item"), old.alias("old_value"), new.alias("new_value"), "page", note.alias("note"))
    return values.unionByName(people)


def unmatched(reconciled: DataFrame) -> DataFrame:
    """(category, key, location, source, note) of parcels on one side only."""
    alone = F.col("status") == "source_only"
    source = F.when(alone, F.col("file")).otherwise(F.concat(F.lit("PDF p."), F.when(F.col("page") == "", "?").otherwise(F.col("page"))))
    category, note = (F.when(alone, a).otherwise(b) for a, b in zip(_SOURCE_ONLY, _READ_ONLY, strict=True))
    return reconciled.where("status <> 'both'").select(category.alias("category"), "key", "location", source.alias("source"), note.alias("note"))


def reconcile_v1(source: DataFrame, read: DataFrame) -> DataFrame:
    """(key, item, old_value, new_value): the earlier comparison, of land use (with the correction by old values), area as plain text and the
    first owner's name.

    source: key, land_use, area, owner, old_land_uses. read: key, land_use, area, owner.
    """
    parts = parts_for(source, read)
    both = source.select("key", F.struct("land_use", "area", "owner", "old_land_uses").alias("s")).repartition(parts, "key").join(read.select("key", F.struct("land_use", "area", "owner").alias("r")).repartition(parts, "key"), "key")
    differs = lambda c: (F.col(f"s.{c}") != "") & (F.col(f"r.{c}") != "") & (tx.normalize(F.col(f"s.{c}")) != tx.normalize(F.col(f"r.{c}")))
    row = lambda item, a, b: F.struct(F.lit(item).alias("item"), a.alias("old_value"), b.alias("new_value"))
    item = lambda name, c: row(name, F.col(f"s.{c}"), F.col(f"r.{c}"))
    misread = F.coalesce(F.array_contains(F.transform("s.old_land_uses", lambda x: tx.normalize(x)), tx.normalize(F.col("r.land_use"))), F.lit(False))
    corrected = row(_ITEMS["land_use", "corrected"], F.concat(F.lit(_MISREAD_USE[0]), "r.land_use"), F.concat(F.lit(_MISREAD_USE[1]), "s.land_use", F.lit(_MISREAD_USE[2])))
    parts = [F.when(differs("land_use"), F.when(misread, corrected).otherwise(item("地目", "land_use"))), F.when(differs("area"), item("地積", "area")), F.when(differs("owner"), item("所有者", "owner"))]
    return both.select("key", F.explode(F.array_compact(F.array(*parts))).alias("x")).select("key", "x.*")


def breakdown(reconciled: DataFrame, owners: DataFrame) -> DataFrame:
    """(item, n): parcels by status, changes by kind, owner differences by kind."""
    status = reconciled.groupBy(F.col("status").alias("item")).agg(F.count("*").alias("n"))
    changes = reconciled.select(F.explode(F.array(F.concat(F.lit("land_use_"), "land_use_change"), F.concat(F.lit("area_"), "area_change"))).alias("item")).where("not item like '%\\_'").groupBy("item").agg(F.count("*").alias("n"))
    return status.unionByName(changes).unionByName(owners.groupBy(F.col("kind").alias("item")).agg(F.count("*").alias("n")))

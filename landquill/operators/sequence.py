"""Lines whose order is data: records, continuation markers, look-ahead and gaps.

Lines have a file, a line_idx that orders them within it, a page and an entry: a number, or one of the markers 続 (more owners
of the last entry), 続更新 (new values for it) and 続表題 (the rest of its heading). Files are read in chunks that know what came before
them and see a few lines of their neighbours; windows go over chunks, pages' runs and entries, never over a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import materialise
from .ordered import in_one_order, numbered, running, running_all, with_neighbours

MORE, UPDATE, HEADING = "続", "続更新", "続表題"
LOOK_AHEAD, SMALL_GAP = 9, 5
#: Columns of a scanned line.
LINE = ("entry", "location", "parcel_no", "land_use", "area", "addr", "share", "name", "receipt")
#: Cells of a 続 line in the earlier form, where its owner stands right behind the marker.
EARLY_MORE = {"addr": 1, "share": 2, "name": 3, "receipt": 4}


def line_columns(rows: DataFrame, early: bool = False) -> DataFrame:
    """rows (fields, …) with the columns of a scanned line, trimmed; early: the earlier form of 続 lines, whose other cells are blank."""
    at = lambda i: F.trim(F.coalesce(F.get("fields", F.lit(i)), F.lit("")))
    more = (at(0) == MORE) & F.lit(early)
    cells = {c: F.when(more, at(EARLY_MORE[c]) if c in EARLY_MORE else F.lit("") if i else at(0)).otherwise(at(i)) for i, c in enumerate(LINE)}
    return rows.withColumns(cells).drop("fields")


def _filled(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def is_numbered(entry: Column) -> Column:
    return ~entry.isin(MORE, UPDATE, HEADING)


def record_groups(lines: DataFrame, opens: Column, file: str) -> DataFrame:
    """lines with record, the number of the opening line they stand under (0 before the first)."""
    return running(lines, F.when(opens, 1).otherwise(0).cast("long"), "record", file, "line_idx")


def _placed(lines: DataFrame, file: str) -> DataFrame:
    return lines if "_rn" in lines.columns else numbered(lines, "_rn", file, "line_idx")


def _part(file: str) -> Window:
    return Window.partitionBy(file, "_part").orderBy("_rn")


def page_index(lines: DataFrame, file: str) -> DataFrame:
    """lines with page_row: their 0-based place in their run of lines with the same page."""
    near = with_neighbours(_placed(lines, file), "_rn", 1, 0)
    turned = ~F.col("page").eqNullSafe(F.lag("page").over(_part(file))) | (F.col("_rn") == 1)
    runs = near.withColumn("_turn", F.when(turned, F.col("_rn"))).where("_home").drop("_home", "_part")
    out = running(runs, F.col("_turn"), "_start", file, "_rn", "max").withColumn("page_row", (F.col("_rn") - F.col("_start")).cast("int"))
    return out.drop("_turn", "_start", *([] if "_rn" in lines.columns else ["_rn"]))


def mark_duplicates(lines: DataFrame, file: str, same: tuple[str, ...] = ("owner_name",)) -> DataFrame:
    """lines with duplicate: a 続 line whose owner comes again in a 続 line below another numbered line, within 9 lines."""
    is_number = F.col("entry").rlike("^[0-9]+$")
    counted = running(_placed(lines, file), F.when(is_number, 1).otherwise(0).cast("long"), "_n", file, "_rn")
    row = F.struct(F.col("entry").alias("entry"), F.col("_n").alias("n"), *[F.trim(F.col(c)).alias(c) for c in same])
    ahead = with_neighbours(counted, "_rn", 0, LOOK_AHEAD).withColumn("_row", row).withColumn("_next", F.collect_list("_row").over(_part(file).rowsBetween(1, LOOK_AHEAD)))
    again = F.exists("_next", lambda x: (x["entry"] == MORE) & (x["n"] > F.col("_n")) & _all([x[c] == F.trim(F.col(c)) for c in same]))
    out = ahead.where("_home").withColumn("duplicate", (F.col("entry") == MORE) & (F.concat_ws("", *same) != "") & again)
    return out.drop("_n", "_row", "_next", "_part", "_home", *([] if "_rn" in lines.columns else ["_rn"]))


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def valid_updates(lines: DataFrame, file: str, fields: tuple[str, ...]) -> DataFrame:
    """lines with valid_update: a 続更新 line that heads its page and does not just repeat the next entry within two lines."""
    indexed = with_neighbours(page_index(_placed(lines, file), file), "_rn", 0, 2)
    row = F.struct((~F.col("entry").isin(MORE, UPDATE, "")).alias("entry"), *[F.trim(F.col(c)).alias(c) for c in fields])
    near = F.filter(F.array(F.lead(row, 1).over(_part(file)), F.lead(row, 2).over(_part(file))), lambda x: x.isNotNull() & x["entry"])
    first = F.get(near, F.lit(0))
    repeats = first.isNotNull() & _all([first[c] == F.trim(F.col(c)) for c in fields])
    out = indexed.withColumn("valid_update", (F.col("entry") == UPDATE) & (F.col("page_row") == 0) & ~F.coalesce(repeats, F.lit(False))).where("_home")
    return out.drop("_home", "_part", *([] if "_rn" in lines.columns else ["_rn"]))


def merge_lines(lines: DataFrame, file: str = "file_no", parcel: str = "parcel_no", updated: tuple[str, ...] = ("area",), same: tuple[str, ...] = ("owner_name",), checked: bool = True, across: bool = True) -> DataFrame:
    """The lines after merging: (all columns), with entry, parcel and updated fields filled from their entry, as if read one after the other.

    The last entry holds while marker lines follow, over the ends of files too, which are read in their order (across=False reads each file by
    itself). Its parcel number and fields are those of its numbered line; a completion (続表題) fills blank ones, an update (続更新)
    replaces the updated ones, where it is not blank. 続 and 続表題 lines are written with the entry's number and values. Beyond that

    * an update also replaces the fields of the line written just before it;
    * a completion also gives the entry's values to the latest line written so far that has the entry's number and a blank parcel number, be it of
      this entry or of an earlier one with the same number. While the entry's own parcel number is blank, that line stays blank and can be met again.

    Update lines go, as do completions and updates before any entry; 続 lines before any entry stay as they are. checked=False is the earlier form: no
    line is taken as a duplicate, and every update counts.

    No line waits for another: the entry in force is a running maximum, and which blank line a completion meets is a matter of brackets. A
    blank line opens one, under its number, and a completion with a parcel number closes the latest that is open; running sums and minima
    give every line its depth, and the lines of one number and depth meet each other in order.
    """
    fields = (parcel, *updated)
    if across:
        placed, scope = in_one_order(lines, "_rn", file, "line_idx").withColumn("_scope", F.lit(0)), "_scope"
    else:
        placed, scope = numbered(lines, "_rn", file, "line_idx").withColumn("_scope", F.col(file)), "_scope"
    # a running value reads its rows twice, and one on top of another four times: written between, rows are worked out once
    marked = materialise(placed)
    if checked:
        marked = materialise(valid_updates(materialise(mark_duplicates(marked, scope, same)), scope, updated).where("not duplicate and (entry <> '続更新' or valid_update)"))
    is_entry, kind = is_numbered(F.col("entry")), lambda k: F.col("entry") == k
    g = running(marked, F.when(is_entry, 1).otherwise(0).cast("long"), "_g", scope, "_rn").where(f"_g > 0 or entry = '{MORE}'")
    # the entry in force: of the current group the first value of its line and completions, and the last of its updates
    values = {"_entry": (F.when(is_entry, F.struct("_g", F.trim("entry").alias("v"))), "max"), "_e": (F.when(kind(UPDATE), 0).otherwise(1).cast("long"), "sum")}
    for c in fields:
        values[f"_first_{c}"] = F.when((is_entry | kind(HEADING)) & _filled(F.col(c)).isNotNull(), F.struct("_g", (-F.col("_rn")).alias("at"), F.trim(c).alias("v"))), "max"
        if c in updated:
            values[f"_last_{c}"] = F.when(kind(UPDATE) & _filled(F.col(c)).isNotNull(), F.struct("_g", F.col("_rn").alias("at"), F.trim(c).alias("v"))), "max"
    held = running_all(g, values, scope, "_rn")
    mine = lambda name: F.when(F.col(f"{name}._g") == F.col("_g"), F.col(f"{name}.v"))
    now = {f"_{c}": F.coalesce(*([mine(f"_last_{c}")] if c in updated else []), mine(f"_first_{c}"), F.lit("")) for c in fields}
    state = held.withColumns({**now, "_number": F.col("_entry.v")}).drop(*values.keys() - {"_e"})
    plain = is_entry | F.col("_number").isNull()
    state = materialise(state.withColumn("_own", F.struct(*[F.when(plain, F.trim(c)).otherwise(F.col(f"_{c}")).alias(c) for c in fields])))
    # brackets: what a completion meets
    completion = state.where(kind(HEADING)).select(scope, "_number", (F.col("_rn") * 2).alias("_at"), F.when(F.col(f"_{parcel}") != "", -1).otherwise(0).cast("long").alias("_step"), F.struct(*[F.col(f"_{c}").alias(c) for c in fields]).alias("_give"))
    blank = state.where(~kind(UPDATE) & (F.col("_own")[parcel] == "") & F.col("_number").isNotNull()).select(scope, "_number", (F.col("_rn") * 2 + 1).alias("_at"), F.lit(1).cast("long").alias("_step"))
    events = completion.unionByName(blank, allowMissingColumns=True)
    depth = running(events, F.col("_step"), "_sum", (scope, "_number"), "_at").withColumn("_sum", F.col("_sum") - F.col("_step"))
    depth = running(materialise(depth), F.col("_sum"), "_low", (scope, "_number"), "_at", "min").withColumn("_level", F.col("_sum") - F.col("_low") + F.when(F.col("_step") == 1, 1).otherwise(0)).where("_level > 0")
    met = running(depth, F.when(F.col("_step") == 1, F.col("_at")), "_of", (scope, "_number", "_level"), "_at", "max").where("_give is not null and _of is not null")
    given = met.groupBy(scope, ((F.col("_of") - 1) / 2).cast("long").alias("_rn")).agg(F.max_by("_give", "_at").alias("_give"))
    replaced = state.where(kind(UPDATE)).groupBy(scope, "_e").agg(*[F.max_by(_filled(F.col(c)), F.when(_filled(F.col(c)).isNotNull(), F.col("_rn"))).alias(f"_u_{c}") for c in updated])
    out = state.where(~kind(UPDATE)).join(given, [scope, "_rn"], "left").join(replaced, [scope, "_e"], "left")
    final = {c: F.coalesce(F.col("_give")[c], F.when(F.col("_number").isNotNull(), F.col(f"_u_{c}")) if c in updated else F.lit(None).cast("string"), F.col("_own")[c]) for c in fields}
    return out.withColumns({**final, "entry": F.coalesce("_number", "entry")}).select(*lines.columns)


def number_gaps(lines: DataFrame, file: str = "file_no") -> DataFrame:
    """(file, prev_n, next_n, n_missing, kind, missing): numbers left out between one entry and the next, by file.

    Of a number's lines the first counts. Numbers that go back give no gap. Up to 5 missing numbers are likely lost in
    reading ('small'), more are a new section ('large'); missing lists them.
    """
    numbers = lines.where(F.col("entry").rlike("^[0-9]+$")).select(file, F.col("entry").cast("long").alias("n"), "line_idx").groupBy(file, "n").agg(F.min("line_idx").alias("line_idx"))
    near = with_neighbours(numbered(numbers, "_rn", file, "line_idx"), "_rn", 1, 0)
    prev = near.withColumn("prev_n", F.lag("n").over(_part(file))).where("_home and prev_n > 0 and n > prev_n + 1")
    n = F.col("n") - F.col("prev_n") - 1
    return prev.select(file, "prev_n", F.col("n").alias("next_n"), n.alias("n_missing"), F.when(n <= SMALL_GAP, "small").otherwise("large").alias("kind"), F.sequence(F.col("prev_n") + 1, F.col("n") - 1).alias("missing"))

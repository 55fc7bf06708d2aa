"""A drawing's entities as stakes, lines, parcels, public labels and the graph of boundaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .entities import RADIUS, STAKES, boundary_lines, detect_format, modal_radius, owner_texts, stakes, words
from .graph import materialise
from .spatial import assign, edges, last_places, nearest_within

STAKE_REACH, LAND_USE_REACH, OWNER_REACH, LINE_REACH = 5.0, 15.0, 30.0, 0.5


SHEET = ("drawing_id",)


@dataclass
class Drawing:
    """The parts of drawings; every table has drawing_id, and ids, names and places only meet within one drawing."""

    stakes: DataFrame  # drawing_id, stake_id, x, y, layer, number
    lines: DataFrame  # drawing_id, line_id, x1, y1, x2, y2, layer
    parcels: DataFrame  # drawing_id, label_id, number, x, y, land_use, owner
    public_labels: DataFrame  # drawing_id, label_id, label, x, y
    edges: DataFrame  # drawing_id, u, v


def attach(parcels: DataFrame, texts: DataFrame, name: str, reach: float | str, by: tuple[str, ...] = ()) -> DataFrame:
    """parcels (by, label_id, x, y, ...) with name: the text of the nearest row of texts (by, ord, x, y, value) closer than reach."""
    right = texts.select(*by, F.col("value").alias(name), F.col("x").alias("rx"), F.col("y").alias("ry"), "ord", *([reach] if isinstance(reach, str) else []))
    return nearest_within(parcels, right, reach, "label_id", "ord", (name,), by, crowded=True).drop("d")


def target_parcels(parcels: DataFrame, wanted: str | list[str] | None = None) -> DataFrame:
    """Parcels with one of the wanted numbers: a list, or one text with commas; nothing wanted means all."""
    names = [w.strip() for w in wanted.split(",")] if isinstance(wanted, str) else list(wanted or [])
    names = [w for w in names if w]
    return parcels.where(F.col("number").isin(*names)) if names else parcels


def drawing_kinds(entities: DataFrame, form: str | None = None) -> DataFrame:
    """(drawing_id, format, reach, land_use_reach, owner_reach) of each drawing; form: the format of all, else each one's own is found out."""
    kinds = detect_format(entities) if form is None else entities.select("drawing_id").distinct().withColumn("format", F.lit(form))
    plain = F.col("format") == "text"
    scale = F.when(plain & (F.col("radius") > 0), F.col("radius") / RADIUS).otherwise(1.0)
    reach = F.when(plain, F.greatest(F.lit(STAKE_REACH), F.col("radius") * 5)).otherwise(STAKE_REACH)
    return kinds.join(modal_radius(entities), "drawing_id").select("drawing_id", "format", reach.alias("reach"), (LAND_USE_REACH * scale).alias("land_use_reach"), (OWNER_REACH * scale).alias("owner_reach"))


def parse_entities(entities: DataFrame, form: str | None = None) -> Drawing:
    """The parts of all drawings of a table at once; entities as sources.files.entities_from_tags gives them.

    form: 'mtext' or 'text', else found out for each drawing. In the text format circles of any radius are stakes, owners are not given, background
    layers hold nothing, and the reach of stake numbers, land uses and owners grows with the usual radius of the drawing's circles; the
    reach of line ends stays. In the mtext format stakes have a radius of 0.25 and lines are polylines of two points. Drawings may lie at the
    same coordinates and use the same ids and names. Rows without a drawing_id are left out.
    """
    kinds = F.broadcast(materialise(drawing_kinds(entities, form)))  # a row for each drawing
    tagged = entities.join(kinds.select("drawing_id", "format"), "drawing_id")
    forms = {plain: tagged.where(F.col("format") == ("text" if plain else "mtext")) for plain in (False, True)}
    both = lambda f: f(forms[False], False).unionByName(f(forms[True], True))
    within = lambda df, reach: df.join(kinds.select("drawing_id", reach), "drawing_id")
    circles = materialise(both(stakes))
    said = materialise(both(words))
    texts = said.where(F.col("category").isin(*STAKES)).select("drawing_id", F.col("ord").alias("left_id"), "x", "y", "layer", F.col("value").alias("number"))
    right = circles.select("drawing_id", F.col("stake_id").alias("right_id"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("layer").alias("r_layer"))
    pairs = assign(within(texts.drop("number"), "reach"), within(right, "reach"), "reach", SHEET).join(texts.select("drawing_id", "left_id", "number"), ["drawing_id", "left_id"])
    numbered = materialise(circles.join(pairs.select("drawing_id", F.col("right_id").alias("stake_id"), "number"), ["drawing_id", "stake_id"], "left"))
    lines = both(boundary_lines)
    parcels = said.where("category = 'parcel_number'").select("drawing_id", F.col("ord").alias("label_id"), F.col("value").alias("number"), "x", "y")
    for name, found in (("land_use", said.where("category = 'land_use'")), ("owner", owner_texts(forms[False]).withColumnRenamed("owner", "value"))):
        parcels = attach(within(parcels, f"{name}_reach"), within(found, f"{name}_reach"), name, f"{name}_reach", SHEET).drop(f"{name}_reach")
    public = said.where("category = 'public_land'").select("drawing_id", F.col("ord").alias("label_id"), F.col("value").alias("label"), "x", "y")
    return Drawing(numbered, lines, parcels, public, edges(lines, numbered, "number", LINE_REACH, SHEET))


def drawing_rings(drawing: Drawing, wanted: str | list[str] | None = None) -> DataFrame:
    """(drawing_id, kind, parcel_number, ring) of all drawings: matched, auxiliary and unknown rings (see faces.all_rings)."""
    from . import faces

    named = drawing.stakes.withColumn("name", F.coalesce("number", F.concat(F.lit("__"), F.col("stake_id").cast("string"))))
    simple = materialise(faces.simple_faces(drawing.edges, last_places(drawing.stakes, "number", SHEET), SHEET))
    closed = materialise(faces.simple_faces(edges(drawing.lines, named, "name", LINE_REACH, SHEET), last_places(named, "name", SHEET), SHEET))
    return faces.all_rings(materialise(drawing.parcels), simple, closed, drawing.public_labels, wanted, SHEET)


def drawing_intersections(drawing: Drawing, block: str | int | None = None) -> DataFrame:
    """(drawing_id, intersection_stake, …) of all drawings (see traverse.intersections)."""
    from . import traverse

    return traverse.intersections(drawing.edges, last_places(drawing.stakes, "number", SHEET), block, SHEET)

"""Parsing of what models and readers said: legends, title cells, detections. Text that can't be read gives no rows, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tolmark.functions.tolerance import SPACE, strip

# The kinds a detector may name.
KINDS = ("dimension", "gdt", "surface", "note", "material", "theoretical")
#: A line that begins with three digits, perhaps with a number after a point, and a tab or two spaces.
_ROW = r"^([0-9]{3})(?:[.]([0-9]+))?(\t| {2,})(.*)$"
#: Where text lines end, as Python's splitlines() has it.
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def legend_text(blocks: DataFrame, key: str = "block", raw: str = "raw") -> DataFrame:
    """key, ord, pos, sub, en, de, raw (the line): lines that begin with a number from 100 to 199, then a tab or two spaces."""
    lines = blocks.select(key, F.posexplode(F.split(F.coalesce(raw, F.lit("")), _LINE_END)).alias("ord", "line")).withColumn("line", F.regexp_replace("line", rf"{SPACE}+$", "")).where(F.col("line").rlike(_ROW))
    part = lambda k: F.regexp_extract("line", _ROW, k)
    halves = F.split(part(4), r"\t| {2,}", 2)
    return lines.where(part(1).cast("int").between(100, 199)).select(key, "ord", part(1).cast("int").alias("pos"), part(2).try_cast("int").alias("sub"), strip(F.get(halves, F.lit(0))).alias("en"), strip(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))).alias("de"), F.col("line").alias("raw"))


def _listed(raw: Column) -> Column:
    """The JSON list from the first [ to the last ], as a variant; null if there is none."""
    found = F.try_parse_json(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\[.*\]", 0))
    return F.when(F.schema_of_variant(found).startswith("ARRAY"), found)


def _items(df: DataFrame, key: list[str], raw: str) -> DataFrame:
    """A row for each object of each list: key, ord, item."""
    listed = df.select(*key, F.col(raw).alias("raw"), _listed(F.col(raw)).alias("list")).where("list IS NOT NULL")
    each = listed.select(*key, "raw", F.posexplode(F.try_variant_get("list", "$", "array<variant>")).alias("ord", "item"))
    return each.where(F.schema_of_variant("item").startswith("OBJECT"))


def _text(item: Column, field: str) -> Column:
    """A field as text: '' if it is missing; a JSON null reads 'None'."""
    held = F.try_variant_get(item, f"$.{field}", "variant")
    return F.when(held.isNull(), "").when(F.is_variant_null(held), "None").otherwise(F.coalesce(F.try_variant_get(item, f"$.{field}", "string"), F.to_json(held)))


def legend_json(blocks: DataFrame, key: str = "block", raw: str = "raw") -> DataFrame:
    """key, ord, pos, sub, en, de, raw (the whole text): objects of the list whose pos is a whole number."""
    rows = _items(blocks, [key], raw)
    pos = F.when(strip(_text(F.col("item"), "pos")).rlike(r"^[+-]?\d+$"), strip(_text(F.col("item"), "pos")).try_cast("int"))
    sub = F.try_variant_get("item", "$.sub", "int")
    return rows.select(key, "ord", pos.alias("pos"), sub.alias("sub"), strip(_text(F.col("item"), "en")).alias("en"), strip(_text(F.col("item"), "de")).alias("de"), "raw").where("pos IS NOT NULL")


def legend(blocks: DataFrame, key: str = "block", raw: str = "raw") -> DataFrame:
    """JSON where the text holds a list, lines otherwise; then rows merged."""
    as_text = blocks.where(_listed(F.col(raw)).isNull())
    return merge_rows(legend_json(blocks, key, raw).unionByName(legend_text(as_text, key, raw)), key)


def merge_rows(rows: DataFrame, key: str = "block") -> DataFrame:
    """Runs of top-level rows with the same pos become one; sub rows end a run. Columns: key, ord (the first), pos, sub, en, de, raw if there is one."""
    w = W.partitionBy(key).orderBy("ord")
    same = F.col("sub").isNull() & F.lag("sub").over(w).isNull() & (F.lag("pos").over(w) == F.col("pos"))
    runs = rows.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    said = lambda c: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("ord", F.col(c).alias("t")))), lambda x: x["t"] != ""), lambda x: x["t"]), " ").alias(c)
    first = [F.min_by("raw", "ord").alias("raw")] if "raw" in rows.columns else []
    return runs.groupBy(key, "run").agg(F.min("ord").alias("ord"), F.min("pos").alias("pos"), F.min("sub").alias("sub"), said("en"), said("de"), *first).drop("run")


def notes(rows: DataFrame, key: str = "block") -> DataFrame:
    """Legend rows as notes: sub rows hang on their pos; rows without text go."""
    child = F.col("sub").isNotNull()
    return rows.where("en <> '' OR de <> ''").select(F.col(key).alias("page"), "ord", F.when(child, F.col("sub")).otherwise(F.col("pos")).alias("pos"), F.when(child, F.col("pos")).alias("parent_pos"), F.col("sub").alias("sub_index"), F.col("en").alias("text_en"), F.col("de").alias("text_de"), *(["raw"] if "raw" in rows.columns else []))


def marks(rows: DataFrame) -> DataFrame:
    return rows.where("sub IS NULL")


def title_cell(raw: Column) -> tuple[Column, Column]:
    """label and value: a JSON object (in code fences or not), else the two sides of the first colon, else all as value."""
    text = strip(F.coalesce(raw, F.lit("")))
    bare = strip(F.regexp_replace(text, r"(?m)^```(?:json)?\s*|```$", ""))
    parsed = F.try_parse_json(bare)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    colon = bare.contains(":")
    halves = F.split(bare, ":", 2)
    label = F.when(is_object, strip(_text(parsed, "label"))).when(colon, strip(halves[0])).otherwise("")
    value = F.when(is_object, strip(_text(parsed, "value"))).when(colon, strip(F.get(halves, F.lit(1)))).otherwise(bare)
    return label, value


def split_label(label: Column) -> tuple[Column, Column]:
    """A caption in two languages at its first slash."""
    halves = F.split(label, "/", 2)
    return strip(halves[0]), F.when(label.contains("/"), strip(F.get(halves, F.lit(1)))).otherwise("")


def title_cells(cells: DataFrame, key: str = "cell", raw: str = "raw") -> DataFrame:
    label, value = title_cell(F.col(raw))
    rows = cells.select(key, label.alias("label"), value.alias("value")).where("label <> '' OR value <> ''")
    en, de = split_label(F.col("label"))
    return rows.select(key, "label", en.alias("label_en"), de.alias("label_de"), "value")


def detections(tiles: DataFrame, key: list[str], raw: str = "raw", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """key, ord, x0, y0, x1, y1, kind, conf: objects with a box of four numbers (cut to whole ones) that is not empty."""
    rows = _items(tiles, key, raw)
    box = F.try_variant_get("item", "$.box", "array<variant>")
    rows = rows.where(F.size(box) >= 4)

    def side(k: int) -> Column:
        """Numbers are cut to whole ones, strings must be whole numbers."""
        kind, text = F.schema_of_variant(box[k]), F.try_variant_get(box[k], "$", "string")
        return F.when(kind == "STRING", F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), strip(text).try_cast("int"))).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(box[k], "$", "double").try_cast("int"))

    kind = F.try_variant_get("item", "$.kind", "string")
    conf = F.when(F.try_variant_get("item", "$.conf", "variant").isNull(), 1.0).otherwise(F.try_variant_get("item", "$.conf", "double"))
    out = rows.select(*key, "ord", *(side(k).alias(s) for k, s in enumerate(("x0", "y0", "x1", "y1"))), F.when(kind.isin(*kinds), kind).otherwise("dimension").alias("kind"), conf.alias("conf"))
    return out.where("x1 > x0 AND y1 > y0 AND conf IS NOT NULL")

"""Queries over the regions of a page: title block, legend, note tables, loose text, and the reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tolmark.operators import regions, report, transcripts
from tolmark.plans.boxes import AREA_A, AREA_B, INTER, _fold
from tolmark.plans.registry import Source, query
from tolmark.plans.texts import ISLANDS, LINES, NOTES, TITLES, _legend_lines, noted

#: The page that regions are looked for on.
PAGE_W, PAGE_H = 200, 110

_CELL = "x1 - x0 >= 40 AND y1 - y0 >= 18 AND ord % 5 <> 0 AND NOT ((x1 - x0) * 100 > 95 * 100 AND (y1 - y0) * 100 > 95 * {h})"

REGIONS = f""",
gt AS (SELECT * FROM cvb WHERE x0 >= 100 AND y0 >= 66 AND x1 <= 200 AND y1 <= 110 AND {_CELL.format(h=44)}),
tr AS (SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS cells FROM gt GROUP BY page),
gm AS (SELECT * FROM cvb WHERE x0 >= 100 AND y0 >= 0 AND x1 <= 200 AND y1 <= 60 AND {_CELL.format(h=60)}),
stacks AS (SELECT page, round_even(x0 / 15, 0)::INT AS k, count(*) AS n, min(ord) AS first, min(y0) AS by0, max(y1) AS by1 FROM gm GROUP BY 1, 2),
anchor AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, first) AS r FROM stacks) WHERE r = 1),
mr AS (SELECT c.page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS cells FROM gm c JOIN anchor a ON a.page = c.page
  WHERE n < 2 OR (y0 >= by0 - greatest(20, trunc(0.05::DOUBLE * (by1 - by0))) AND y1 <= by1 + greatest(20, trunc(0.05::DOUBLE * (by1 - by0)))) GROUP BY c.page),
nr AS (SELECT page, x0, y0, x1, y1 FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY (x1 - x0) * (y1 - y0) DESC, ord) AS r FROM dets WHERE kind = 'note') WHERE r = 1),
src AS (
  SELECT page, 0 AS source, x0, y0, x1, y1 FROM mr
  UNION ALL SELECT page, 1, x0, y0, x1, y1 FROM nr a
  WHERE NOT EXISTS (SELECT 1 FROM mr b WHERE a.page = b.page AND {INTER} > 0 AND {INTER} * 2 >= least({AREA_A}, {AREA_B})))
"""


def _ink() -> Column:
    return F.col("ord") % 5 != 0


def _title_cells(s: Source) -> DataFrame:
    return regions.grid_cells(s.cvb, regions.lower_right(PAGE_W, PAGE_H), _ink())


def _legends(s: Source) -> DataFrame:
    return regions.legend_region(regions.grid_cells(s.cvb, regions.upper_right(PAGE_W, PAGE_H), _ink()))


def _sources(s: Source) -> DataFrame:
    """The largest note stands for a page's other note table."""
    tables = s.dets.where("kind = 'note'").groupBy("page").agg(F.max_by(F.struct("x0", "y0", "x1", "y1"), F.struct((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), -F.col("ord"))).alias("b"))
    return regions.note_sources(_legends(s), tables.select("page", "b.*"))


def _reads(s: Source, boxes: DataFrame) -> DataFrame:
    """What a reader said about each box: one of all cells' texts."""
    dealt = boxes.select("page", "ord").crossJoin(s.cells.agg((F.max("cell") + 1).alias("n")))  # of one row
    return dealt.select("page", "ord", (F.col("ord") % F.col("n")).alias("cell")).join(s.cells, "cell").select("page", "ord", "raw")


@query("""
SELECT page, ord, x0, y0, x1, y1,
  CASE WHEN x1 - x0 > 24 AND y1 - y0 > 24 THEN x0 + 12 ELSE x0 END AS in_x0, CASE WHEN x1 - x0 > 24 AND y1 - y0 > 24 THEN y0 + 12 ELSE y0 END AS in_y0,
  CASE WHEN x1 - x0 > 24 AND y1 - y0 > 24 THEN x1 - 12 ELSE x1 END AS in_x1, CASE WHEN x1 - x0 > 24 AND y1 - y0 > 24 THEN y1 - 12 ELSE y1 END AS in_y1
FROM cvb WHERE x1 - x0 >= 22 AND y1 - y0 >= 22 AND (x1 - x0) * (y1 - y0) * 100 <= 5 * 240 * 150""")
def rectangle_filter(s: Source) -> DataFrame:
    return regions.inset(regions.rectangles(s.cvb.drop("cells"), 240, 150, least=22), 12)


@query(REGIONS + "SELECT page, x0, y0, x1, y1, cells FROM tr")
def title_region(s: Source) -> DataFrame:
    return regions.title_region(_title_cells(s))


@query(REGIONS + "SELECT page, x0, y0, x1, y1, cells FROM mr")
def legend_region(s: Source) -> DataFrame:
    return _legends(s)


@query(REGIONS + "SELECT page, source, x0, y0, x1, y1 FROM src")
def note_sources(s: Source) -> DataFrame:
    return _sources(s)


def _wrapped(sql: str, name: str, select: str) -> str:
    """sql with its last SELECT as one more relation."""
    head, tail = sql.rsplit(select, 1)
    return f"{head}, {name} AS ({select}{tail})"


@query(LINES + _wrapped(ISLANDS.format(rows="lr"), "rows", "SELECT block, min(ord)") + """,
nb AS (SELECT block // 2 AS page, (block % 2)::INT AS source, ord, CASE WHEN sub IS NOT NULL THEN sub ELSE pos END AS pos, CASE WHEN sub IS NOT NULL THEN pos END AS parent_pos, en, de, block % 3 <> 0 AS two
  FROM rows WHERE en <> '' OR de <> ''),
par AS (SELECT DISTINCT page, pos FROM nb WHERE parent_pos IS NULL)
SELECT nb.page, source, ord, nb.pos, parent_pos, en AS text_en, de AS text_de,
  array_to_string(list_filter([CASE WHEN two AND (en = '' OR de = '') THEN 'missing translation' END, CASE WHEN parent_pos IS NOT NULL AND par.pos IS NULL THEN 'orphan sub-bullet' END], lambda x: x IS NOT NULL), '|') AS reasons
FROM nb LEFT JOIN par ON par.page = nb.page AND par.pos = nb.parent_pos""")
def notes_block(s: Source) -> DataFrame:
    """Two legends a page, read, parsed and reviewed as one list."""
    of = (F.shiftright("block", 1).alias("page"), (F.col("block") % 2).cast("int").alias("source"))
    reads = _legend_lines(s).select(*of, "raw")
    sources = s.legend.select("block").distinct().select(*of, (F.col("block") % 3 != 0).alias("two_columns"))
    found = regions.notes_of(sources, reads)
    return found.select("page", "source", "ord", "pos", "parent_pos", "text_en", "text_de", F.array_join("review_reasons", "|").alias("reasons"))


FIELDS = REGIONS + TITLES + """,
fields AS (SELECT g.page, g.ord, 'cell' AS source, label, label_en, label_de, value, CASE WHEN value = '' THEN 'empty value' WHEN label = '' THEN 'missing caption' ELSE '' END AS reasons FROM gt g JOIN tf ON tf.cell = g.ord % (SELECT max(cell) + 1 FROM cells))
"""

LOOSE = """,
taken AS (SELECT page, x0, y0, x1, y1 FROM tr UNION ALL SELECT page, x0, y0, x1, y1 FROM mr UNION ALL SELECT page, x0, y0, x1, y1 FROM dets WHERE kind = 'gdt'),
loose AS (SELECT * FROM dets a WHERE kind = 'note' AND NOT EXISTS (SELECT 1 FROM taken b WHERE a.page = b.page AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1))
""" + _wrapped(_fold("loose", "page", "ord", f"{INTER} = 0"), "free", "SELECT page, ord FROM")


@query(FIELDS + "SELECT page, ord, label, label_en, label_de, value, reasons FROM fields")
def title_block(s: Source) -> DataFrame:
    cells = _title_cells(s)
    found = regions.title_fields(cells, _reads(s, cells))
    return found.select("page", "ord", "label", "label_en", "label_de", "value", F.array_join("review_reasons", "|").alias("reasons"))


def _loose(s: Source) -> DataFrame:
    free = regions.loose_regions(s.dets.where("kind = 'note'"), regions.title_region(_title_cells(s)), _legends(s), s.dets.where("kind = 'gdt'"))
    return _reads(s, free).withColumnRenamed("raw", "text")


@query(REGIONS + LOOSE + "SELECT page, ord FROM free")
def loose_regions(s: Source) -> DataFrame:
    """Notes outside title block, legend and frames, none of which meet."""
    return regions.loose_regions(s.dets.where("kind = 'note'"), regions.title_region(_title_cells(s)), _legends(s), s.dets.where("kind = 'gdt'"))


@query(FIELDS + LOOSE + """SELECT * FROM fields
UNION ALL SELECT page, ord, 'loose', '', '', '', t, '' FROM free JOIN tc ON tc.cell = ord % (SELECT max(cell) + 1 FROM cells) WHERE t <> ''""")
def title_and_loose(s: Source) -> DataFrame:
    cells = _title_cells(s)
    both = regions.with_loose(regions.title_fields(cells, _reads(s, cells)), _loose(s))
    return both.select("page", "ord", "source", "label", "label_en", "label_de", "value", F.array_join("review_reasons", "|").alias("reasons"))


@query(REGIONS + f"""
SELECT p.page, mr.page IS NOT NULL AS legend_located, mr.cells AS legend_cells, round_even((mr.x1 - mr.x0)::DOUBLE / {PAGE_W}, 3) AS legend_w_frac, round_even((mr.y1 - mr.y0)::DOUBLE / {PAGE_H}, 3) AS legend_h_frac,
  tr.page IS NOT NULL AS title_located, tr.cells AS title_cells, round_even((tr.x1 - tr.x0)::DOUBLE / {PAGE_W}, 3) AS title_w_frac, round_even((tr.y1 - tr.y0)::DOUBLE / {PAGE_H}, 3) AS title_h_frac
FROM (SELECT DISTINCT page FROM cvb) p LEFT JOIN mr ON mr.page = p.page LEFT JOIN tr ON tr.page = p.page""")
def location_report(s: Source) -> DataFrame:
    """What drawing analysis alone finds on each page."""
    return regions.location(s.cvb, _legends(s), regions.title_region(_title_cells(s)), PAGE_W, PAGE_H)


@query(REGIONS + TITLES + """
SELECT d.page, count(*) AS characteristics, any_value(n.n) AS notes, any_value(m.n) AS marks, coalesce(any_value(t.n), 0) AS title_fields FROM dets d
LEFT JOIN (SELECT page, count(*) AS n FROM dets WHERE kind = 'note' GROUP BY page) n ON n.page = d.page
LEFT JOIN (SELECT page, count(*) AS n FROM gm GROUP BY page) m ON m.page = d.page
LEFT JOIN (SELECT g.page, count(*) AS n FROM gt g JOIN tf ON tf.cell = g.ord % (SELECT max(cell) + 1 FROM cells) GROUP BY g.page) t ON t.page = d.page GROUP BY d.page""")
def block_counts(s: Source) -> DataFrame:
    cells = _title_cells(s)
    marks = regions.grid_cells(s.cvb, regions.upper_right(PAGE_W, PAGE_H), _ink())
    return regions.optional_counts(s.dets, s.dets.where("kind = 'note'"), marks, regions.title_fields(cells, _reads(s, cells)))


@query(""",
held AS (SELECT p.page, count(g.ord) AS n FROM (SELECT DISTINCT page FROM dets) p LEFT JOIN dets g ON g.page = p.page AND g.kind = 'gdt' GROUP BY p.page),
numbered AS (SELECT page, n, unnest(range(1, n + 7)) AS seq FROM held)
SELECT page, seq, CASE seq WHEN 1 THEN 'render' WHEN 2 THEN 'notes' WHEN 3 THEN 'title' WHEN 4 THEN 'detect' ELSE CASE WHEN seq <= n + 5 THEN 'ocr' ELSE 'place' END END AS step,
  CASE WHEN seq BETWEEN 5 AND n + 5 THEN seq - 5 END AS current, CASE WHEN seq BETWEEN 5 AND n + 5 THEN n END AS total FROM numbered""")
def progress_steps(s: Source) -> DataFrame:
    return regions.progress(s.dets, s.dets.where("kind = 'gdt'"))


def _rows(relation: str, columns: str) -> str:
    packed = ", ".join(f"'{c}': {c}" for c in columns.split())
    return f"SELECT page, list({{{packed}}} ORDER BY {', '.join(columns.split())}) AS held FROM {relation} GROUP BY page"


@query(REGIONS + TITLES + NOTES + f""",
mk AS (SELECT block AS page, ord, pos, en AS text_en, de AS text_de FROM legend WHERE sub IS NULL),
fl AS (SELECT g.page, g.ord, label, label_en, label_de, value FROM gt g JOIN tf ON tf.cell = g.ord % (SELECT max(cell) + 1 FROM cells))
SELECT c.page, to_json({{'characteristics': c.held, 'notes': n.held, 'marks': m.held, 'title_fields': coalesce(t.held, [])}})::VARCHAR AS payload
FROM ({_rows("dets", "ord kind conf")}) c LEFT JOIN ({_rows("nt", "ord pos text_en text_de")}) n ON n.page = c.page
LEFT JOIN ({_rows("mk", "ord pos text_en text_de")}) m ON m.page = c.page LEFT JOIN ({_rows("fl", "ord label label_en label_de value")}) t ON t.page = c.page""")
def result_payload(s: Source) -> DataFrame:
    """All four relations of a page as one JSON text."""
    cells = _title_cells(s)
    marks = transcripts.marks(s.legend).select(F.col("block").alias("page"), "ord", "pos", F.col("en").alias("text_en"), F.col("de").alias("text_de"))
    return report.payload(s.dets, noted(s), marks, regions.title_fields(cells, _reads(s, cells)))

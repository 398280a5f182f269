"""Queries over transcriptions: tolerance notation, legends, title cells, detections, review, sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tolmark.functions import tolerance
from tolmark.operators import report, review, transcripts
from tolmark.plans.registry import Source, query

NUM = r"[+\-±]?\d+(?:[.,]\d+)?"

#: The parser over callouts, step by step: cleaned text and numbers, body without its prefix, then the rules in their order.
PARSED = rf""",
t AS (SELECT *, regexp_replace(regexp_replace(translate(raw, chr(10), ' '), '^\s+', ''), '\s+$', '') AS text FROM callouts),
n AS (SELECT *, regexp_extract_all(text, '{NUM}', 0) AS nums, starts_with(text, 'Ø') OR regexp_matches(text, '^[O0]\s*\d') AS dia, regexp_matches(text, '^[Rr]\s*\d') AS rad FROM t),
b AS (SELECT *, CASE WHEN starts_with(text, 'Ø') THEN substr(text, 2) WHEN dia THEN regexp_replace(text, '^[O0]\s*', '') WHEN rad THEN regexp_replace(text, '^[Rr]\s*', '') ELSE text END AS body FROM n),
c AS (SELECT *, regexp_extract(body, '±\s*(\d+(?:[.,]\d+)?)', 1) AS sym, regexp_extract_all(regexp_extract(body, '(?s)^(.*?)±\s*\d', 1), '{NUM}', 0) AS before,
  list_filter(regexp_extract_all(body, '{NUM}', 0), lambda x: x[1] IN ('+', '-')) AS sg, list_filter(regexp_extract_all(body, '{NUM}', 0), lambda x: x[1] NOT IN ('+', '-')) AS un FROM b),
v AS (SELECT *, replace(regexp_replace(coalesce(nums[1], ''), '^\++', ''), '.', ',') AS first,
  CASE WHEN starts_with(text, '(') AND suffix(text, ')') AND len(nums) > 0 THEN 'Reference' WHEN hint = 'material' THEN 'Material' WHEN hint = 'note' THEN 'Note' WHEN hint = 'theoretical' THEN 'Theoretical'
    WHEN hint = 'gdt' THEN CASE WHEN contains(text, '⊕') THEN 'Position' WHEN contains(text, '∥') THEN 'Parallelism' ELSE 'Flatness' END
    WHEN dia THEN 'Diameter' WHEN rad THEN 'Radius' ELSE 'Distance' END AS char_type FROM c),
p AS (SELECT id, page, raw, hint, conf, rotated, text, char_type,
  CASE WHEN char_type IN ('Reference', 'Theoretical') THEN first WHEN char_type IN ('Material', 'Note') THEN text WHEN hint = 'gdt' THEN '0'
    WHEN sym <> '' THEN replace(coalesce(before[1], ''), '.', ',') ELSE replace(coalesce(un[1], regexp_replace(sg[1], '^\++', ''), ''), '.', ',') END AS nominal,
  CASE WHEN char_type IN ('Reference', 'Theoretical', 'Material', 'Note') THEN '' WHEN hint = 'gdt' THEN first WHEN sym <> '' THEN replace(sym, '.', ',')
    WHEN len(sg) > 0 THEN replace(regexp_replace(sg[1], '^\++', ''), '.', ',') WHEN char_type = 'Radius' AND contains(upper(text), 'MAX') THEN '0' ELSE '' END AS upper_tol,
  CASE WHEN char_type IN ('Reference', 'Theoretical', 'Material', 'Note') THEN '' WHEN hint = 'gdt' THEN '0' WHEN sym <> '' THEN '-' || replace(sym, '.', ',')
    WHEN len(sg) = 1 AND sg[1][1] = '+' AND len(un) >= 2 AND replace(un[2], '.', ',') IN ('0', '0,0') THEN '0'
    WHEN len(sg) < 2 THEN '' WHEN sg[2][1] = '-' THEN replace(sg[2], '.', ',') ELSE '-' || replace(sg[2], '.', ',') END AS lower_tol
  FROM v),
ref AS (SELECT p.*, CASE WHEN hint = 'theoretical' AND regexp_matches(text, '^1\d\d$') THEN text::INT END AS note_ref_pos FROM p)"""


def parsed(s: Source) -> DataFrame:
    return s.callouts.withColumns(tolerance.parse(F.col("raw"), F.col("hint")))


def retagged(s: Source) -> DataFrame:
    at = tolerance.note_reference(F.col("raw"), F.when(F.col("hint") == "theoretical", "theoretical").otherwise(""))
    return parsed(s).withColumn("note_ref_pos", at).withColumn("subtype", F.when(F.col("note_ref_pos").isNotNull(), "note_ref").otherwise(F.col("hint")))


@query(PARSED + "SELECT id, char_type, nominal, upper_tol, lower_tol FROM p")
def parse_callout(s: Source) -> DataFrame:
    return parsed(s).select("id", "char_type", "nominal", "upper_tol", "lower_tol")


@query("SELECT id, CASE WHEN contains(raw, '⊕') THEN 'Position' WHEN contains(raw, '∥') THEN 'Parallelism' ELSE 'Flatness' END AS symbol FROM callouts")
def gdt_symbol(s: Source) -> DataFrame:
    return s.callouts.select("id", tolerance.gdt_symbol(F.col("raw")).alias("symbol"))


@query(PARSED + "SELECT id, CASE WHEN note_ref_pos IS NOT NULL THEN 'note_ref' ELSE hint END AS subtype, note_ref_pos FROM ref")
def note_ref_retag(s: Source) -> DataFrame:
    return retagged(s).select("id", "subtype", "note_ref_pos")


NOTES = """,
nt AS (SELECT block % 50 AS page, block * 1000 + ord AS ord, CASE WHEN sub IS NOT NULL THEN sub ELSE pos END AS pos, CASE WHEN sub IS NOT NULL THEN pos END AS parent_pos, sub AS sub_index, en AS text_en, de AS text_de, trim(en || ' ' || de) AS raw_text, block
  FROM legend WHERE en <> '' OR de <> '')"""


def noted(s: Source) -> DataFrame:
    rows = transcripts.notes(s.legend)
    return rows.select((F.col("page") % 50).alias("page"), (F.col("page") * 1000 + F.col("ord")).alias("ord"), "pos", "parent_pos", "sub_index", "text_en", "text_de", F.trim(F.concat_ws(" ", "text_en", "text_de")).alias("raw_text"))


def reviewed(s: Source) -> DataFrame:
    chars = retagged(s).withColumn("raw_text", F.col("raw")).withColumn("confidence", F.col("conf") / 100)
    return review.characteristics(chars, noted(s).select("page", "pos", F.col("sub_index").alias("sub")))


REVIEWED = PARSED + NOTES + """,
known AS (SELECT DISTINCT page, pos FROM nt WHERE sub_index IS NULL),
paged AS (SELECT DISTINCT page FROM nt),
rv AS (SELECT r.*, array_to_string(list_filter([
    CASE WHEN text = '' THEN 'empty read' WHEN conf < 60 THEN 'low OCR confidence' END,
    CASE WHEN text <> '' AND char_type IN ('Distance', 'Diameter', 'Radius', 'Theoretical') AND nominal = '' THEN 'missing nominal' END,
    CASE WHEN rotated THEN 'rotation ambiguity' END,
    CASE WHEN note_ref_pos IS NOT NULL AND paged.page IS NOT NULL AND known.pos IS NULL THEN 'unknown note reference' END], lambda x: x IS NOT NULL), '|') AS reasons
  FROM ref r LEFT JOIN paged ON paged.page = r.page LEFT JOIN known ON known.page = r.page AND known.pos = r.note_ref_pos)
"""


@query(REVIEWED + "SELECT id, reasons <> '' AS needs_review, reasons FROM rv")
def review_characteristic(s: Source) -> DataFrame:
    return reviewed(s).select("id", "needs_review", F.array_join("review_reasons", "|").alias("reasons"))


@query(NOTES + """,
par AS (SELECT DISTINCT page, pos FROM nt WHERE parent_pos IS NULL)
SELECT nt.ord, nt.page, array_to_string(list_filter([CASE WHEN raw_text = '' THEN 'empty read' WHEN text_en = '' OR text_de = '' THEN 'missing translation' END,
  CASE WHEN parent_pos IS NOT NULL AND par.pos IS NULL THEN 'orphan sub-bullet' END], lambda x: x IS NOT NULL), '|') AS reasons
FROM nt LEFT JOIN par ON par.page = nt.page AND par.pos = nt.parent_pos""")
def review_note(s: Source) -> DataFrame:
    return review.notes(noted(s), F.lit(True)).select("ord", "page", F.array_join("review_reasons", "|").alias("reasons"))


@query("""
SELECT block, ord, CASE WHEN en = '' AND de = '' THEN 'empty read' WHEN en = '' OR de = '' THEN 'missing translation' ELSE '' END AS reasons FROM legend WHERE sub IS NULL""")
def review_mark(s: Source) -> DataFrame:
    rows = transcripts.marks(s.legend).select("block", "ord", F.col("en").alias("text_en"), F.col("de").alias("text_de"), F.concat("en", "de").alias("raw_text"))
    return review.marks(rows, F.lit(True)).select("block", "ord", F.array_join("review_reasons", "|").alias("reasons"))


TITLES = r""",
tc AS (SELECT cell, regexp_replace(regexp_replace(coalesce(raw, ''), '^\s+', ''), '\s+$', '') AS t FROM cells),
tb AS (SELECT cell, regexp_replace(regexp_replace(regexp_replace(t, '(?m)^```(?:json)?\s*|```$', '', 'g'), '^\s+', ''), '\s+$', '') AS bare FROM tc),
tj AS (SELECT cell, bare, CASE WHEN json_valid(bare) AND starts_with(bare, '{') THEN bare::JSON END AS j FROM tb),
tl AS (SELECT cell, trim(CASE WHEN j IS NOT NULL THEN coalesce(j->>'label', '') WHEN contains(bare, ':') THEN split_part(bare, ':', 1) ELSE '' END) AS label,
  trim(CASE WHEN j IS NOT NULL THEN coalesce(j->>'value', '') WHEN contains(bare, ':') THEN substr(bare, strpos(bare, ':') + 1) ELSE bare END) AS value FROM tj),
tf AS (SELECT cell, label, trim(split_part(label, '/', 1)) AS label_en, CASE WHEN contains(label, '/') THEN trim(substr(label, strpos(label, '/') + 1)) ELSE '' END AS label_de, value FROM tl WHERE label <> '' OR value <> '')
"""


@query(TITLES + "SELECT * FROM tf")
def title_cells(s: Source) -> DataFrame:
    return transcripts.title_cells(s.cells)


@query(TITLES + "SELECT cell, CASE WHEN value = '' THEN 'empty value' WHEN label = '' THEN 'missing caption' ELSE '' END AS reasons FROM tf")
def review_title(s: Source) -> DataFrame:
    return review.title_fields(transcripts.title_cells(s.cells)).select("cell", F.array_join("review_reasons", "|").alias("reasons"))


def _legend_lines(s: Source) -> DataFrame:
    """Each block's rows as tab-separated lines."""
    line = F.concat_ws("\t", F.concat(F.col("pos").cast("string"), F.when(F.col("sub").isNotNull(), F.concat(F.lit("."), F.col("sub").cast("string"))).otherwise("")), "en", "de")
    return s.legend.groupBy("block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("t")))), lambda x: x["t"]), "\n").alias("raw"))


LINES = r""",
blocks AS (SELECT block, string_agg(pos || CASE WHEN sub IS NOT NULL THEN '.' || sub ELSE '' END || chr(9) || en || chr(9) || de, chr(10) ORDER BY ord) AS raw FROM legend GROUP BY block),
ln AS (SELECT block, generate_subscripts(l, 1)::INT - 1 AS ord, regexp_replace(unnest(l), '\s+$', '') AS line FROM (SELECT block, string_split(raw, chr(10)) AS l FROM blocks)),
lx AS (SELECT block, ord, regexp_extract(line, '^(10[0-9]|1[1-9][0-9])(?:\.(\d+))?(?:\t| {2,})(.*)$', 1) AS p, regexp_extract(line, '^(10[0-9]|1[1-9][0-9])(?:\.(\d+))?(?:\t| {2,})(.*)$', 2) AS s,
  regexp_extract(line, '^(10[0-9]|1[1-9][0-9])(?:\.(\d+))?(?:\t| {2,})(.*)$', 3) AS rest FROM ln WHERE regexp_matches(line, '^(10[0-9]|1[1-9][0-9])(?:\.(\d+))?(?:\t| {2,})(.*)$')),
lr AS (SELECT block, ord, p::INT AS pos, TRY_CAST(nullif(s, '') AS INT) AS sub, trim(regexp_extract(rest, '^(.*?)(?:\t| {2,}|$)', 1)) AS en, trim(regexp_replace(rest, '^.*?(?:\t| {2,}|$)', '')) AS de FROM lx)
"""


@query(LINES + "SELECT * FROM lr")
def legend_parse_text(s: Source) -> DataFrame:
    return transcripts.legend_text(_legend_lines(s)).drop("raw")


ISLANDS = """,
la AS (SELECT *, CASE WHEN sub IS NULL AND lag(sub) OVER w IS NULL AND lag(pos) OVER w = pos THEN 0 ELSE 1 END AS fresh FROM {rows} WINDOW w AS (PARTITION BY block ORDER BY ord)),
li AS (SELECT *, sum(fresh) OVER (PARTITION BY block ORDER BY ord) AS run FROM la)
SELECT block, min(ord) AS ord, min(pos) AS pos, min(sub) AS sub, coalesce(string_agg(en, ' ' ORDER BY ord) FILTER (WHERE en <> ''), '') AS en,
  coalesce(string_agg(de, ' ' ORDER BY ord) FILTER (WHERE de <> ''), '') AS de FROM li GROUP BY block, run"""


@query(ISLANDS.format(rows="legend"))
def legend_merge_rows(s: Source) -> DataFrame:
    return transcripts.merge_rows(s.legend)


@query(LINES + ISLANDS.format(rows="lr"))
def legend_from_text(s: Source) -> DataFrame:
    return transcripts.legend(_legend_lines(s)).drop("raw")


@query("SELECT block, ord::INT AS ord, pos, sub, trim(en) AS en, trim(de) AS de FROM (SELECT block, row_number() OVER (PARTITION BY block ORDER BY ord) - 1 AS ord, pos, sub, en, de FROM legend)")
def legend_parse_json(s: Source) -> DataFrame:
    """Each block's rows written as JSON amid prose, and read again."""
    row = F.struct("pos", "sub", "en", "de")
    blocks = s.legend.groupBy("block").agg(F.concat(F.lit("Here:\n"), F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", row.alias("r")))), lambda x: x["r"])), F.lit("\nend")).alias("raw"))
    return transcripts.legend_json(blocks).drop("raw")


@query(r""",
ls AS (SELECT tile, tx, ty, regexp_extract(raw, '(?s)\[.*\]', 0) AS l FROM said),
it AS (SELECT tile, tx, ty, generate_subscripts(a, 1)::INT - 1 AS ord, unnest(a) AS item FROM (SELECT tile, tx, ty, CASE WHEN json_valid(l) AND l <> '' THEN json_extract(l, '$[*]') ELSE [] END AS a FROM ls)),
bx AS (SELECT *, json_extract(item, '$.box[*]') AS b FROM it WHERE json_type(item) = 'OBJECT'),
dd AS (SELECT tile, tx, ty, ord, trunc(TRY_CAST(replace(b[1]::VARCHAR, '"', '') AS DOUBLE))::INT AS x0, trunc(TRY_CAST(replace(b[2]::VARCHAR, '"', '') AS DOUBLE))::INT AS y0, trunc(TRY_CAST(replace(b[3]::VARCHAR, '"', '') AS DOUBLE))::INT AS x1, trunc(TRY_CAST(replace(b[4]::VARCHAR, '"', '') AS DOUBLE))::INT AS y1,
  CASE WHEN item->>'kind' IN ('dimension', 'gdt', 'surface', 'note', 'material', 'theoretical') THEN item->>'kind' ELSE 'dimension' END AS kind, coalesce((item->>'conf')::DOUBLE, 1.0) AS conf FROM bx WHERE len(b) >= 4)
SELECT * FROM dd WHERE x1 > x0 AND y1 > y0""")
def parse_detections(s: Source) -> DataFrame:
    return transcripts.detections(s.said, ["tile", "tx", "ty"])


#: Two reads of each callout: as it is and turned round, which loses its last characters.
READS = PARSED.replace("FROM callouts", "FROM (SELECT id * 2 + k AS id, id AS own, page, k, CASE WHEN k = 0 THEN raw ELSE substr(raw, 1, 3) END AS raw, '' AS hint, CASE WHEN k = 0 THEN conf ELSE (conf * 7) % 101 END AS conf, rotated FROM callouts CROSS JOIN (VALUES (0), (1)) AS k(k))")


@query(READS.replace("p AS (SELECT id, page", "p AS (SELECT own, k, id, page") + """,
sc AS (SELECT *, CASE WHEN nominal <> '' THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN upper_tol <> '' THEN 0.5::DOUBLE ELSE 0 END + conf::DOUBLE / 100 AS score FROM p),
rk AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS nxt FROM sc WINDOW w AS (PARTITION BY own ORDER BY score DESC, k))
SELECT own AS id, k::INT AS candidate, raw AS text, conf::DOUBLE / 100 AS confidence, rotated AND nxt IS NOT NULL AND text <> '' AND score - nxt < 0.15::DOUBLE AS ambiguous FROM rk WHERE r = 1""")
def rotation_best(s: Source) -> DataFrame:
    turned = s.callouts.select("id", "rotated", F.explode(F.array(F.lit(0), F.lit(1))).alias("candidate"), "raw", "conf")
    read = turned.withColumn("text", F.when(F.col("candidate") == 0, F.col("raw")).otherwise(F.substring("raw", 1, 3))).withColumn("confidence", F.when(F.col("candidate") == 0, F.col("conf")).otherwise(F.col("conf") * 7 % 101) / 100)
    return report.best_read(read.withColumns(tolerance.parse(F.col("text"), F.lit(""))), "id", F.col("rotated"))


@query("""
SELECT id AS doc, string_agg(w, ' ' ORDER BY k) FILTER (WHERE w <> '') AS text, coalesce(avg(c) FILTER (WHERE w <> '') / 100, 0) AS confidence
FROM (SELECT id, k, trim(w) AS w, CASE WHEN k % 3 = 0 THEN NULL ELSE ((id + k * 17) % 101)::DOUBLE END AS c
  FROM (SELECT doc_id AS id, unnest(string_split(text, ' ')) AS w, unnest(range(1, len(string_split(text, ' ')) + 1)) AS k FROM documents WHERE text IS NOT NULL)) GROUP BY id""")
def word_ocr_fold(s: Source) -> DataFrame:
    """Word tables joined to texts with their mean confidence."""
    words = s.table("documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", " ")).alias("at", "word")).withColumn("ord", F.col("at") + 1)
    words = words.select(F.col("doc_id").alias("doc"), "ord", "word", F.when(F.col("ord") % 3 == 0, "-").otherwise(((F.col("doc_id") + F.col("ord") * 17) % 101).cast("string")).alias("conf"))
    joined = report.words_joined(words, ["doc"])
    return joined.select("doc", F.when(F.col("text") != "", F.col("text")).alias("text"), "confidence")


@query(PARSED + NOTES + """,
top AS (SELECT page, pos, min(ord) AS ord FROM nt WHERE sub_index IS NULL GROUP BY page, pos)
SELECT r.id, r.note_ref_pos, nt.text_en FROM ref r JOIN top ON top.page = r.page AND top.pos = r.note_ref_pos JOIN nt ON nt.page = top.page AND nt.ord = top.ord""")
def note_jump(s: Source) -> DataFrame:
    """The note that a reference points to; the first of equals."""
    top = noted(s).where("sub_index IS NULL").groupBy("page", F.col("pos").alias("note_ref_pos")).agg(F.min_by("text_en", "ord").alias("text_en"))
    return retagged(s).join(top, ["page", "note_ref_pos"]).select("id", "note_ref_pos", "text_en")


def _state(s: Source) -> DataFrame:
    return reviewed(s).withColumn("reviewed", F.col("id") % 4 == 0).withColumn("pos", F.col("id").cast("int"))


@query(REVIEWED + "SELECT page, count(*) AS \"all\", count(*) FILTER (WHERE reasons <> '' AND id % 4 <> 0) AS review, count(*) FILTER (WHERE NOT (reasons <> '' AND id % 4 <> 0)) AS ok, count(*) FILTER (WHERE id % 4 = 0 OR reasons = '') AS done FROM rv GROUP BY page")
def review_counts(s: Source) -> DataFrame:
    return report.review_counts(_state(s), ["page"])


@query(REVIEWED + "SELECT id FROM rv WHERE reasons <> '' AND id % 4 <> 0 AND contains(lower(concat_ws(' ', id, char_type, nominal, upper_tol, lower_tol)), 'dia')")
def visible_rows(s: Source) -> DataFrame:
    return report.visible(_state(s), "review", " DIA ").select("id")


@query(REVIEWED + "SELECT id, id % 4 = 0 OR (reasons <> '' AND id % 4 <> 0) AS reviewed FROM rv")
def bulk_accept(s: Source) -> DataFrame:
    return report.bulk_accept(_state(s), None, "review").select("id", "reviewed")


@query(PARSED + "SELECT id AS pos, char_type, nominal, upper_tol, lower_tol FROM p")
def export_inspection(s: Source) -> DataFrame:
    return report.workbook(parsed(s).withColumn("pos", F.col("id")))["Inspection"]


@query(NOTES + "SELECT CASE WHEN parent_pos IS NOT NULL THEN parent_pos || '.' || sub_index ELSE pos::VARCHAR END AS label, text_en, text_de FROM nt")
def export_notes(s: Source) -> DataFrame:
    return report.workbook(parsed(s).withColumn("pos", F.col("id")), notes=noted(s))["Notes"]


@query(TITLES + "SELECT label_en, label_de, value FROM tf")
def export_title(s: Source) -> DataFrame:
    return report.workbook(parsed(s).withColumn("pos", F.col("id")), title=transcripts.title_cells(s.cells))["Title Block"]


@query("SELECT block, ord, en AS text_en, de AS text_de, pos FROM legend WHERE sub IS NULL")
def export_marks(s: Source) -> DataFrame:
    return transcripts.marks(s.legend).select("block", "ord", F.col("en").alias("text_en"), F.col("de").alias("text_de"), "pos")


@query(r"""
SELECT cell, length(raw) AS chars, CASE WHEN raw = '' THEN 0 ELSE len(string_split(regexp_replace(raw, '\n$', ''), chr(10))) END::INT AS lines, contains(raw, chr(9)) AS has_tab, left(replace(raw, chr(10), ' '), 40) AS sample FROM cells""")
def raw_summaries(s: Source) -> DataFrame:
    made = report.raw_summary(F.col("raw"))
    return s.cells.select("cell", made["chars"].cast("long").alias("chars"), made["lines"].alias("lines"), made["has_tab"].alias("has_tab"), report.read_sample(F.col("raw")).alias("sample"))

"""Queries over boxes: overlap joins, suppression, clusters, order, placement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tolmark.functions import geometry as G
from tolmark.operators import cluster, order, pairs, report, suppress
from tolmark.operators.ink import legend_band as band_of
from tolmark.plans.registry import Source, query

PAGE_W, PAGE_H = 240, 150

INTER = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"
AREA_A, AREA_B = "(a.x1 - a.x0) * (a.y1 - a.y0)", "(b.x1 - b.x0) * (b.y1 - b.y0)"
UNION = f"({AREA_A} + {AREA_B} - {INTER})"


@query(f"""
SELECT a.page, a.ord AS ord_a, b.ord AS ord_b, a.kind AS kind_a, b.kind AS kind_b, round_even({INTER} / {UNION}, 3) AS iou
FROM dets a JOIN dets b ON a.page = b.page AND a.ord < b.ord WHERE {INTER} * 100 >= {UNION} * 60""")
def iou_pairs(s: Source) -> DataFrame:
    """Probable duplicates on a page."""
    return pairs.duplicates(s.dets)


@query(f"""
SELECT a.page, a.ord, b.ord AS owner FROM dets a JOIN cvb b ON a.page = b.page
WHERE {INTER} > 0 AND {INTER} * 2 >= least({AREA_A}, {AREA_B}) AND b.cells = 3""")
def overlap_smaller_frac(s: Source) -> DataFrame:
    """Detections that a legend region owns."""
    return pairs.owned(s.dets, s.cvb.where("cells = 3"))


@query(f""",
good AS (SELECT * FROM cvb a WHERE EXISTS (SELECT 1 FROM dets b WHERE a.page = b.page AND {INTER} * 2 > {UNION}))
SELECT page, 'model' AS source, ord, kind, x0, y0, x1, y1, conf FROM dets a
WHERE NOT EXISTS (SELECT 1 FROM good b WHERE a.page = b.page AND {INTER} * 2 > {UNION})
UNION ALL SELECT page, 'cv', ord, CASE WHEN cells >= 2 THEN 'gdt' ELSE 'theoretical' END, x0, y0, x1, y1, 100 FROM good""")
def hybrid_merge(s: Source) -> DataFrame:
    return pairs.hybrid(s.dets, s.cvb)


@query("""
SELECT page, ord FROM dets a WHERE kind = 'note' AND NOT EXISTS (
  SELECT 1 FROM dets b WHERE b.kind = 'gdt' AND a.page = b.page AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)""")
def exclude_antijoin(s: Source) -> DataFrame:
    """Loose text outside the regions already read."""
    return pairs.without_overlap(s.dets.where("kind = 'note'"), s.dets.where("kind = 'gdt'")).select("page", "ord")


@query(f""",
fits AS (
  SELECT a.page, a.ord, b.x0, b.y0, b.x1, b.y1, row_number() OVER (PARTITION BY a.page, a.ord ORDER BY {AREA_B} DESC, b.ord) AS r
  FROM dets a JOIN cvb b ON a.page = b.page WHERE {INTER} * 5 >= {UNION} * 2 AND {AREA_B} >= {AREA_A} AND a.kind = 'note')
SELECT d.page, d.ord, greatest(0, coalesce(f.x0, d.x0) - 8) AS x0, greatest(0, coalesce(f.y0, d.y0) - 8) AS y0,
  least({PAGE_W}, coalesce(f.x1, d.x1) + 8) AS x1, least({PAGE_H}, coalesce(f.y1, d.y1) + 8) AS y1
FROM dets d LEFT JOIN fits f ON f.page = d.page AND f.ord = d.ord AND r = 1 WHERE d.kind = 'note'""")
def snap_to_cv(s: Source) -> DataFrame:
    return pairs.snap(s.dets.where("kind = 'note'"), s.cvb, PAGE_W, PAGE_H)


def _fold(source: str, by: str, order_by: str, beside: str, extra: str = "") -> str:
    """Greedy suppression as a recursion over ranks: the state is the list of kept boxes."""
    return f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order_by}) AS r, count(*) OVER (PARTITION BY {by}) AS n FROM {source}),
step AS (
  SELECT page{extra}, r, n, [{{'ord': ord, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] AS kept FROM ranked WHERE r = 1
  UNION ALL
  SELECT s.page{extra.replace(', ', ', s.')}, b.r, s.n, CASE WHEN len(list_filter(s.kept, lambda a: NOT ({beside}))) = 0 THEN list_append(s.kept, {{'ord': b.ord, 'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1}}) ELSE s.kept END
  FROM step s JOIN ranked b ON b.page = s.page{''.join(f' AND b.{c} = s.{c}' for c in extra.split(', ') if c)} AND b.r = s.r + 1)
SELECT page, ord FROM (SELECT page, unnest(kept).ord AS ord FROM step WHERE r = n)"""


def _beside(num: int, den: int) -> str:
    return f"{INTER} = 0 OR {INTER} * {den} < {UNION} * {num}"


@query(_fold("dets", "page, kind", "conf DESC, ord", _beside(1, 2), ", kind"))
def nms_same_kind(s: Source) -> DataFrame:
    return suppress.same_kind(s.dets).select("page", "ord")


@query(_fold("dets", "page", "conf DESC, ord", _beside(7, 10)))
def nms_cross_kind(s: Source) -> DataFrame:
    return suppress.cross_kind(s.dets).select("page", "ord")


@query(_fold("cvb", "page", "(x1 - x0) * (y1 - y0) DESC, ord", _beside(1, 2)))
def nms_area(s: Source) -> DataFrame:
    return suppress.by_area(s.cvb)


@query(_fold("dets", "page", "ord", f"{INTER} = 0"))
def first_come_overlap(s: Source) -> DataFrame:
    return suppress.first_come(s.dets)


@query()
def stack_merge(s: Source) -> DataFrame:
    """Order-dependent fixpoint; held against a plain loop in the tests."""
    return cluster.stack_merge(s.dets)


@query()
def note_cluster(s: Source) -> DataFrame:
    return cluster.note_cluster(s.dets)


@query()
def detect_pipeline(s: Source) -> DataFrame:
    """Stacks merged, duplicates of a kind suppressed, rectangles merged in, then duplicates across kinds."""
    merged = cluster.stack_merge(s.dets)
    kept = suppress.same_kind(merged)
    both = pairs.hybrid(kept, s.cvb).withColumn("ord", F.when(F.col("source") == "cv", F.col("ord") + (1 << 40)).otherwise(F.col("ord")))
    return suppress.cross_kind(both).select("page", "ord", "kind", "x0", "y0", "x1", "y1")


STARTS = """
  SELECT doc_id, {n} AS n, unnest(CASE WHEN {n} <= 1024 THEN [0] ELSE list_distinct(list_append(range(0, {n} - 1024 + 1, 870), {n} - 1024)) END) AS s FROM sized"""


@query(f"""
SELECT xs.doc_id, xs.s::INT AS x0, ys.s::INT AS y0, least(xs.s + 1024, xs.n)::INT AS x1, least(ys.s + 1024, ys.n)::INT AS y1
FROM ({STARTS.format(n="w").replace("FROM sized", "FROM (SELECT doc_id, (300 + n_chars % 4000)::INT AS w FROM documents)")}) xs
JOIN ({STARTS.format(n="h").replace("FROM sized", "FROM (SELECT doc_id, (200 + (n_chars * 3) % 3000)::INT AS h FROM documents)")}) ys ON xs.doc_id = ys.doc_id""")
def tile_grid(s: Source) -> DataFrame:
    docs = s.table("documents").select("doc_id", "n_chars").where("n_chars IS NOT NULL")
    return order.tiles(docs, "doc_id", 300 + F.col("n_chars") % 4000, 200 + (F.col("n_chars") * 3) % 3000)


@query(f"""
SELECT page, ord, greatest(0, least({PAGE_W}, x0 + (ord % 40)::INT)) AS x0, greatest(0, least({PAGE_H}, y0 + (ord % 30)::INT)) AS y0,
  greatest(0, least({PAGE_W}, x1 + (ord % 40)::INT)) AS x1, greatest(0, least({PAGE_H}, y1 + (ord % 30)::INT)) AS y1 FROM dets""")
def tile_to_page(s: Source) -> DataFrame:
    return order.to_page(s.dets.select("page", "ord", "x0", "y0", "x1", "y1"), F.col("ord") % 40, F.col("ord") % 30, PAGE_W, PAGE_H)


@query("""
SELECT page, ord, row_number() OVER (PARTITION BY page ORDER BY round_even(((y0 + y1) / 2) / 60, 0), (x0 + x1) / 2, ord)::INT AS pos FROM dets""")
def reading_order(s: Source) -> DataFrame:
    return order.reading_order(s.dets)


@query("""
SELECT page, ord, row_number() OVER (PARTITION BY page ORDER BY floor(((y0 + y1) / 2) / 60 + 0.5), (x0 + x1) / 2, ord)::INT AS pos FROM dets""")
def reading_order_client(s: Source) -> DataFrame:
    return order.reading_order_client(s.dets)


@query("""
SELECT page, ord, row_number() OVER (PARTITION BY page ORDER BY round_even(y0 / 30, 0), x0, ord)::INT AS rank FROM cvb""")
def cell_order(s: Source) -> DataFrame:
    return order.cell_order(s.cvb)


@query("""
SELECT page, ord, greatest(10, x0 - 58) AS balloon_x, greatest(10, y0 - 58) AS balloon_y,
  round_even(least(greatest((x0 + x1) / 2 / (300 / 72), 0), 595), 4)::DOUBLE AS pt_x, round_even(least(greatest((y0 + y1) / 2 / (300 / 72), 0), 842), 4)::DOUBLE AS pt_y FROM dets""")
def placement(s: Source) -> DataFrame:
    return order.placement(s.dets)


@query(f"""
SELECT page, ord, (y1 - y0) * 10 > (x1 - x0) * 13 AS vertical,
  greatest(1, trunc((least(x1 - x0 + 12, {PAGE_W})) * CASE WHEN least(y1 - y0 + 12, {PAGE_H}) < 40 THEN least(3.0::DOUBLE, 40::DOUBLE / least(y1 - y0 + 12, {PAGE_H})) ELSE 1.0::DOUBLE END))::INT AS crop_w,
  greatest(1, trunc((least(y1 - y0 + 12, {PAGE_H})) * CASE WHEN least(y1 - y0 + 12, {PAGE_H}) < 40 THEN least(3.0::DOUBLE, 40::DOUBLE / least(y1 - y0 + 12, {PAGE_H})) ELSE 1.0::DOUBLE END))::INT AS crop_h,
  CASE WHEN greatest((x1 - x0) * 20, (y1 - y0) * 20) <= 1600 THEN (x1 - x0) * 20 ELSE trunc((x1 - x0) * 20 * (1600::DOUBLE / greatest((x1 - x0) * 20, (y1 - y0) * 20)))::INT END AS cap_w
FROM dets""")
def crop_sizes(s: Source) -> DataFrame:
    w, h = order.crop_size(G.width(), G.height(), 6, PAGE_W, PAGE_H)
    return s.dets.select("page", "ord", order.vertical(s.dets).alias("vertical"), w.alias("crop_w"), h.alias("crop_h"), order.capped(G.width() * 20, G.height() * 20)[0].alias("cap_w"))


@query(""",
grouped AS (SELECT page, round_even(x0 / 15, 0)::INT AS k, count(*) AS n, min(ord) AS first, min(y0) AS by0, max(y1) AS by1 FROM cvb GROUP BY 1, 2),
anchor AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, first) AS r FROM grouped) WHERE r = 1)
SELECT c.page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS cells
FROM cvb c JOIN anchor a ON a.page = c.page
WHERE n < 2 OR (y0 >= by0 - greatest(20, trunc(0.05::DOUBLE * (by1 - by0))) AND y1 <= by1 + greatest(20, trunc(0.05::DOUBLE * (by1 - by0)))) GROUP BY c.page""")
def legend_band(s: Source) -> DataFrame:
    return band_of(s.cvb)


@query("SELECT kind, count(*) AS n FROM dets GROUP BY kind")
def kind_histogram(s: Source) -> DataFrame:
    return report.histogram(s.dets, "kind")


@query(f"""
SELECT page, round_even(median((x1 - x0)::DOUBLE / {PAGE_W}), 4) AS median_w_frac, round_even(median((y1 - y0)::DOUBLE / {PAGE_H}), 4) AS median_h_frac,
  round_even(max((x1 - x0)::DOUBLE / {PAGE_W}), 4) AS max_w_frac, round_even(max((y1 - y0)::DOUBLE / {PAGE_H}), 4) AS max_h_frac,
  count(*) FILTER (WHERE (x1 - x0)::DOUBLE / {PAGE_W} > 0.15 OR (y1 - y0)::DOUBLE / {PAGE_H} > 0.10) AS oversized FROM dets GROUP BY page""")
def box_size_stats(s: Source) -> DataFrame:
    return report.box_sizes(s.dets, PAGE_W, PAGE_H)


@query("""
SELECT page, ord, conf, rank FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ord)::INT AS rank FROM dets WHERE conf < 60) WHERE rank <= 25""")
def low_conf_sample(s: Source) -> DataFrame:
    return report.sample(s.dets.where("conf < 60"), "page", ["ord"], 25).select("page", "ord", "conf", "rank")


@query(f""",
dup AS (SELECT a.page, count(*) AS n FROM dets a JOIN dets b ON a.page = b.page AND a.ord < b.ord WHERE {INTER} * 100 >= {UNION} * 60 GROUP BY a.page)
SELECT d.page, count(*) AS characteristics, count(DISTINCT kind) AS kinds, count(*) FILTER (WHERE conf < 30) AS needs_review,
  count(*) FILTER (WHERE conf < 60) AS low_confidence, coalesce(max(dup.n), 0) AS duplicates
FROM dets d LEFT JOIN dup ON dup.page = d.page GROUP BY d.page""")
def report_summary(s: Source) -> DataFrame:
    return report.summary(s.dets.withColumn("needs_review", F.col("conf") < 30), pairs.duplicates(s.dets))


def flagship(s: Source) -> DataFrame:
    """Duplicates suppressed, the rest in reading order, and a row for each kind: how many, the mean position, the first."""
    kept = suppress.same_kind(s.dets)
    placed = order.reading_order(kept)
    return kept.join(placed, ["page", "ord"]).groupBy("kind").agg(F.count("*").alias("n"), F.sum("pos").alias("positions"), F.count_if(F.col("pos") == 1).alias("firsts"))


@query()
def gold_matching(s: Source) -> DataFrame:
    """Detections assigned one to one to rectangles; held against a plain loop in the tests."""
    from tolmark.plans.extract import gold_matches

    value = F.col("ord") % 5
    return gold_matches(s.dets.withColumn("nominal", value), s.cvb.withColumn("nominal", value))

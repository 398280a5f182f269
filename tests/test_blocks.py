import duckdb
import pytest

from tolmark import plans
from tolmark.operators import regions
from tolmark.sources import carriers

SF = "/root/testdata/sf0.001"
NAMES = ["rectangle_filter", "title_region", "legend_region", "note_sources", "notes_block", "title_block", "loose_regions", "title_and_loose", "location_report", "block_counts", "progress_steps"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in carriers.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, db, name):
    found = plans.queries()[name](spark, SF)
    got = sorted(map(tuple, found.collect()), key=repr)
    want = sorted(db.sql(f"SELECT {', '.join(found.columns)} FROM ({plans.oracle_sql()[name]})").fetchall(), key=repr)
    assert got and got == want


BOX = "page long, ord long, x0 int, y0 int, x1 int, y1 int"


def test_quadrants():
    assert regions.lower_right(7016, 4961) == (3508, 2976, 7016, 4961)
    assert regions.upper_right(7016, 4961) == (3508, 0, 7016, 2728)


def test_null_sides_and_small_regions(spark):
    from pyspark.sql import functions as F

    cells = spark.createDataFrame([(1, 1, 50, 50, 95, 80), (1, 2, None, 50, 95, 80), (1, 3, 50, 50, 60, 80), (2, 4, 0, 0, 45, 30)], BOX)
    fine = regions.grid_cells(cells, (40, 40, 200, 100), F.lit(True))
    assert [x.ord for x in fine.collect()] == [1]
    assert regions.grid_cells(cells, (40, 40, 200, 79), F.lit(True)).isEmpty()
    assert regions.title_region(fine).collect()[0].cells == 1
    assert [x.ord for x in regions.rectangles(cells, 200, 200).collect()] == [1, 4]


def test_inset_keeps_small_boxes(spark):
    row = regions.inset(spark.createDataFrame([(1, 1, 0, 0, 8, 20)], BOX)).collect()[0]
    assert (row.in_x0, row.in_y0, row.in_x1, row.in_y1) == (0, 0, 8, 20)


def test_table_that_is_the_legend(spark):
    box = "page long, x0 int, y0 int, x1 int, y1 int"
    legends = spark.createDataFrame([(1, 0, 0, 10, 10), (2, 0, 0, 10, 10)], box)
    tables = spark.createDataFrame([(1, 5, 0, 15, 10), (2, 6, 0, 16, 10), (3, 0, 0, 1, 1)], box)
    got = sorted((x.page, x.source) for x in regions.note_sources(legends, tables).collect())
    assert got == [(1, 0), (2, 0), (2, 1), (3, 1)]


def test_unread_and_blank(spark):
    cells = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "page long, ord long")
    reads = spark.createDataFrame([(1, 1, "Scale / Maßstab: 1:2"), (1, 2, "  "), (1, 3, None)], "page long, ord long, raw string")
    fields = regions.title_fields(cells, reads)
    loose = spark.createDataFrame([(1, 9, " edge "), (1, 8, " "), (1, 7, None)], "page long, ord long, text string")
    got = sorted((x.source, x.ord, x.label_de, x.value) for x in regions.with_loose(fields, loose).collect())
    assert got == [("cell", 1, "Maßstab", "1:2"), ("loose", 9, "", "edge")]


def test_steps_of_an_empty_page(spark):
    pages = spark.createDataFrame([(5,)], "page long")
    got = [(x.seq, x.step, x.current, x.total) for x in regions.progress(pages, pages.limit(0)).orderBy("seq").collect()]
    assert got[4:] == [(5, "ocr", 0, 0), (6, "place", None, None)] and len(got) == 6

import random

from tolmark.plans import extract
from tolmark.sources import provider

BOX = "page long, ord long, x0 int, y0 int, x1 int, y1 int, cells int"


class Model(provider.Stub):
    def read_region(self, image):
        return provider.Read({b"p1": "Ø7 +0,1 -0,1", b"p2": "105"}[bytes(image)], 0.9)


def model():
    return Model([(10, 10, 60, 30, "dimension", 0.9), (12, 11, 61, 31, "dimension", 0.8), (200, 300, 260, 330, "theoretical", 0.7)])


def frames(spark):
    images = spark.createDataFrame([(1, bytearray(b"p1")), (2, bytearray(b"p2"))], "page long, image binary")
    tiles = images.selectExpr("page", "0L AS tile", "0 AS x0", "0 AS y0", "image")
    boxes = spark.createDataFrame([(2, 0, 199, 299, 261, 331, 1)], BOX)
    notes = spark.createDataFrame([(2, 101, None)], "page long, pos int, sub int")
    return tiles, images, boxes, notes


def test_extract(spark):
    tiles, images, boxes, notes = frames(spark)
    got = {(x.page, x.pos): x for x in extract.extract(tiles, images, boxes, notes, model).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert (got[1, 1].char_type, got[1, 1].nominal, got[1, 1].upper_tol, got[1, 1].review_reasons) == ("Diameter", "7", "0,1", [])
    assert (got[2, 2].subtype, got[2, 2].note_ref_pos, got[2, 2].review_reasons) == ("note_ref", 105, ["unknown note reference"])
    assert (got[2, 2].x0, got[2, 2].balloon_x) == (199, 141)
    assert {x.page: x.characteristics for x in extract.summary(extract.extract(tiles, images, boxes, notes, model)).collect()} == {1: 2, 2: 2}


class Turned(provider.Stub):
    """Reads a page's image followed by the degrees it was turned by."""

    def read_region(self, image):
        return provider.Read(*{b"a-90": ("Ø7 +0,1 -0,1", 0.5), b"a90": ("rubbish", 0.9), b"b-90": ("5", 0.8), b"b90": ("6", 0.9), b"c": ("8", 0.9)}[bytes(image)])


def test_upright_boxes(spark):
    rows = [(1, 0, "dimension", 0, 0, 10, 40, bytearray(b"a")), (1, 1, "dimension", 0, 0, 10, 14, bytearray(b"b")), (1, 2, "dimension", 0, 0, 10, 13, bytearray(b"c")), (1, 3, None, 0, 0, 10, 40, bytearray(b"unknown")), (1, 4, "gdt", 0, 0, 10, 40, bytearray(b"b")), (1, 5, "note", 0, 0, 10, 13, None)]
    boxes = spark.createDataFrame(rows, "page long, ord long, kind string, x0 int, y0 int, x1 int, y1 int, image binary")
    found = extract.best_reads(boxes, Turned, provider.whole, lambda image, degrees: bytes(image) + str(degrees).encode())
    got = {x.ord: (x.text, x.rotated) for x in found.collect()}
    assert got == {0: ("Ø7 +0,1 -0,1", False), 1: ("6", True), 2: ("8", False), 3: ("", False), 4: ("6", True), 5: ("", False)}
    assert extract.best_reads(boxes.limit(0), Turned, provider.whole, lambda image, degrees: image).count() == 0
    notes = spark.createDataFrame([], "page long, pos int, sub int")
    flagged = {x.ord: x.review_reasons for x in extract.characteristics(found, notes).where("ord < 3").collect()}
    assert flagged == {0: ["low OCR confidence"], 1: ["rotation ambiguity"], 2: []}


def test_manual(spark):
    rows = spark.createDataFrame([(1, 0, -5, 3, 40, 5000, bytearray(b"p1")), (1, 1, 9, 9, 9, 20, bytearray(b"p1")), (1, 2, 0, 0, 5, 5, bytearray(b"unknown"))], "page long, ord long, x0 int, y0 int, x1 int, y1 int, image binary")
    got = {x.ord: x for x in extract.manual(rows, model, 100, 200).collect()}
    assert set(got) == {0, 2} and (got[0].x0, got[0].y1, got[0].source, got[0].pos) == (0, 200, "manual", 0)
    assert got[2].review_reasons == ["empty read"]


def test_notes_region(spark):
    det = spark.createDataFrame([(1, k, 50, y, 200, y + 20, "note", 90) for k, y in enumerate((20, 50, 80))], "page long, ord long, x0 int, y0 int, x1 int, y1 int, kind string, conf int")
    assert tuple(extract.notes_region(det, spark.createDataFrame([], BOX), 1000, 1000).first()) == (1, 42, 12, 208, 108)


def test_gold_matches(spark):
    r = random.Random(3)
    one = lambda k: (k % 2, k, x := r.randrange(80), y := r.randrange(60), x + r.randint(10, 50), y + r.randint(10, 40), str(r.randrange(3)))
    a, b = [one(k) for k in range(40)], [one(k) for k in range(40)]

    def iou(p, q):
        i = max(0, min(p[4], q[4]) - max(p[2], q[2])) * max(0, min(p[5], q[5]) - max(p[3], q[3]))
        return i / ((p[4] - p[2]) * (p[5] - p[3]) + (q[4] - q[2]) * (q[5] - q[3]) - i)

    scored = sorted((-round(iou(p, q) + (p[6] == q[6]), 6), p[0], p[1], q[1]) for p in a for q in b if p[0] == q[0] and iou(p, q) >= 0.3)
    taken, want = set(), set()
    for s, page, x, y in scored:
        if not {("a", page, x), ("b", page, y)} & taken:
            taken |= {("a", page, x), ("b", page, y)}
            want.add((page, x, y))
    schema = "page long, ord long, x0 int, y0 int, x1 int, y1 int, nominal string"
    got = extract.gold_matches(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()
    assert {(x.page, x.ord, x.gold) for x in got} == want

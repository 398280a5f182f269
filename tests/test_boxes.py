import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tolmark.functions import geometry as G
from tolmark.operators import cluster, order, pairs, suppress
from tolmark.operators.pairs import F

DET = "page long, ord long, x0 int, y0 int, x1 int, y1 int, kind string, conf int"


def dets(spark, rows):
    return spark.createDataFrame([(1, k, *b, kind, conf) for k, (b, kind, conf) in enumerate(rows)], DET)


def iou(a, b):
    i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i) if i else 0.0


def crowd(seed, n=120):
    r = random.Random(seed)
    out = []
    for k in range(n):
        x, y = r.randrange(150), r.randrange(150)
        out.append((k % 3, k, x, y, x + r.randint(5, 60), y + r.randint(5, 40), r.choice(["gdt", "note", "dimension"]), r.randrange(100)))
    return out


def test_suppression_cases(spark):
    same = [((0, 0, 100, 100), "dimension", 90), ((5, 5, 105, 105), "dimension", 70)]
    assert [x.conf for x in suppress.same_kind(dets(spark, same)).collect()] == [90]
    kinds = [((0, 0, 100, 100), "dimension", 90), ((0, 0, 100, 100), "gdt", 80)]
    assert suppress.same_kind(dets(spark, kinds)).count() == 2
    assert [x.kind for x in suppress.cross_kind(dets(spark, kinds)).collect()] == ["dimension"]
    part = [((0, 0, 100, 100), "dimension", 90), ((60, 60, 160, 160), "gdt", 80)]
    assert suppress.cross_kind(dets(spark, part)).count() == 2


def test_suppression_against_loop(spark):
    rows = crowd(1)
    kept = []
    for d in sorted(rows, key=lambda d: -d[7]):
        if all(d[0] != k[0] or d[6] != k[6] or iou(d[2:6], k[2:6]) < 0.5 for k in kept):
            kept.append(d)
    got = suppress.same_kind(spark.createDataFrame(rows, DET)).collect()
    assert {(x.page, x.ord) for x in got} == {k[:2] for k in kept}


def test_hybrid_and_snap(spark):
    box = "page long, ord long, x0 int, y0 int, x1 int, y1 int, cells int"
    near = spark.createDataFrame([(1, 0, 98, 98, 162, 132, 1), (1, 1, 300, 300, 360, 330, 3)], box)
    got = pairs.hybrid(dets(spark, [((100, 100, 160, 130), "dimension", 80)]), near).collect()
    assert [(x.source, x.kind) for x in got] == [("cv", "theoretical")]
    note = dets(spark, [((60, 60, 200, 90), "note", 90)])
    snapped = pairs.snap(note, spark.createDataFrame([(1, 0, 50, 50, 220, 110, 1)], box), 1000, 1000).first()
    assert tuple(snapped)[2:] == (42, 42, 228, 118)


def test_overlap_join_is_complete_and_single(spark):
    rows = crowd(2)
    df = spark.createDataFrame(rows, DET)
    got = [(x.page, x.a_ord, x.b_ord) for x in pairs.overlap_join(df, df, F.col("a_ord") < F.col("b_ord"), cell=16).collect()]
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and iou(a[2:6], b[2:6]) > 0}
    assert len(got) == len(set(got)) and set(got) == want


def loop(items, x_tol, y_gap, cap):
    """The merge as a plain loop over lists, boxes being used up as they are absorbed."""
    changed = True
    while changed:
        changed, out, used = False, [], set()
        for i, (a, kind, conf, at) in enumerate(items):
            if i in used:
                continue
            for j in range(i + 1, len(items)):
                b = items[j]
                if j in used or b[1] != kind or not (a[0] <= b[0][2] + x_tol and b[0][0] <= a[2] + x_tol) or max(a[1] - b[0][3], b[0][1] - a[3]) > y_gap:
                    continue
                u = (min(a[0], b[0][0]), min(a[1], b[0][1]), max(a[2], b[0][2]), max(a[3], b[0][3]))
                if cap is not None and u[3] - u[1] > cap:
                    continue
                a, conf, changed = u, max(conf, b[2]), True
                used.add(j)
            out.append((a, kind, conf, at))
        items = out
    return items


def test_stack_merge(spark):
    for seed in (3, 4):
        rows = crowd(seed, 60)
        want = set()
        for page in range(3):
            own = [d for d in rows if d[0] == page]
            heights = sorted(d[5] - d[3] for d in own)
            middle = (heights[(len(heights) - 1) // 2] + heights[len(heights) // 2]) / 2
            want |= {(page, kind, at, *box, conf) for box, kind, conf, at in loop([(d[2:6], d[6], d[7], d[1]) for d in own], 20, 20, 2 * middle + 20)}
        assert set(map(tuple, cluster.stack_merge(spark.createDataFrame(rows, DET)).collect())) == want
    two = dets(spark, [((10, 10, 50, 30), "note", 80), ((12, 35, 52, 55), "note", 60)])
    assert tuple(cluster.stack_merge(two).first())[3:] == (10, 10, 52, 55, 80)


def test_note_cluster_is_confluent(spark):
    rows = crowd(5, 45)
    shuffled = [(d[0], 100 - d[1], *d[2:]) for d in rows]
    both = [sorted(map(tuple, cluster.note_cluster(spark.createDataFrame(x, DET)).collect())) for x in (rows, shuffled)]
    areas = [[(r[3] - r[1]) * (r[4] - r[2]) for r in x] for x in both]
    assert areas[0] == areas[1]
    assert cluster.note_cluster(dets(spark, [((0, 0, 5, 5), "gdt", 1)])).count() == 0


def test_order_placement_tiles(spark):
    one = dets(spark, [((200, 200, 260, 230), "note", 1)])
    xy = lambda **k: tuple(order.placement(one, **k).first())[2:4]
    assert xy() == (142, 142) and xy(dpi=150) == (171, 171) and xy(offset=70) == (130, 130) and xy(offset=500) == (10, 10)
    page = spark.createDataFrame([(1, 2000, 1000), (2, 800, 600)], "page long, w int, h int")
    got = {tuple(x) for x in order.tiles(page, "page", F.col("w"), F.col("h"), 1280, 0.15).collect()}
    assert got == {(1, 0, 0, 1280, 1000), (1, 720, 0, 2000, 1000), (2, 0, 0, 800, 600)}
    half = dets(spark, [((0, 20, 10, 40), "note", 1), ((5, 0, 15, 10), "note", 1)])
    assert [x.pos for x in order.reading_order(half).orderBy("ord").collect()] == [1, 2]
    assert [x.pos for x in order.reading_order_client(half).orderBy("ord").collect()] == [2, 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(1, 30), st.integers(1, 30)), max_size=14), st.randoms())
def test_absorb_without_cap_is_confluent(boxes, r):
    items = [((x, y, x + w, y + h), 0, k) for k, (x, y, w, h) in enumerate(boxes)]
    other = items[:]
    r.shuffle(other)
    assert {b for b, _, _ in cluster.absorb(items, 5, 5, None)} == {b for b, _, _ in cluster.absorb(other, 5, 5, None)}


def test_geometry(spark):
    df = spark.createDataFrame([((0, 0, 10, 10) + (5, 5, 15, 15)), ((0, 0, 10, 10) + (10, 0, 20, 10)), ((0, 0, 10, 10) + (0, 0, 10, 10))], "ax0 int, ay0 int, ax1 int, ay1 int, bx0 int, by0 int, bx1 int, by1 int")
    assert [round(x[0], 6) for x in df.select(G.iou("a", "b")).collect()] == [round(25 / 175, 6), 0.0, 1.0]
    assert [x[0] for x in df.select(G.overlaps("a", "b")).collect()] == [True, False, True]
    assert [x[0] for x in df.select(G.covers_smaller("a", "b", 1, 2)).collect()] == [False, False, True]
    assert [x[0] for x in df.select(G.x_aligned("a", "b", 0) & G.y_close("a", "b", 0)).collect()] == [True, True, True]

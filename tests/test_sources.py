import random

import pytest

from tolmark.sources import drawings, provider
from tolmark.streaming import edits


class Loud(provider.Stub):
    def read_region_gdt(self, image):
        raise ValueError("broken")

    def detect_regions(self, image):
        if image == b"bad":
            raise ValueError("tile")
        return super().detect_regions(image)


def test_tiling_and_retries():
    assert provider.tiling(env={}) == (1024, 0.15)
    assert provider.tiling(env={"DETECT_TILE": "800", "DETECT_OVERLAP": "x"}) == (800, 0.15)
    assert provider.tiling(512, 0.5, env={"DETECT_TILE": "800"}) == (512, 0.5)
    slept, tried = [], []

    def factory():
        tried.append(1)
        if len(tried) < 3:
            raise OSError("no model")
        return "model"

    assert provider.made(factory, sleep=slept.append) == "model" and slept == [8.0, 8.0]
    got, why = provider.with_fallback(lambda: 1 / 0, provider.Stub, attempts=2, sleep=slept.append)
    assert isinstance(got, provider.Stub) and "division" in why
    with pytest.raises(RuntimeError):
        provider.require_detector(object(), "why")
    assert provider.safe_read(provider.capability(Loud(), "read_region_gdt"), b"") == ("", 0.0)
    assert provider.capability(provider.Stub(), "read_region_gdt")(b"").text.startswith("1,2")
    assert provider.safe_read(provider.Stub(text=" ").read_region, b"").confidence == 0.0


def test_detector_and_reader_over_frames(spark):
    boxes = [(1, 2, 3, 4, "gdt", 0.5)]
    tiles = spark.createDataFrame([(1, 0, 100, 200, bytearray(b"ok")), (1, 1, 0, 0, bytearray(b"bad"))], "page long, tile long, x0 int, y0 int, image binary")
    got = provider.detect_tiles(tiles, lambda: Loud(boxes)).collect()
    assert [tuple(x) for x in got] == [(1, 0, 0, 101, 202, 103, 204, "gdt", 0.5)]
    read = provider.reader_udf(lambda: Loud(), "read_region_gdt")
    assert {tuple(x.r) for x in tiles.select(read("image").alias("r")).collect()} == {("", 0.0)}


def test_images_and_posts(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"123")
    assert bytes(drawings.images(spark, str(tmp_path)).first().image) == b"123"
    body = '{"rows": [{"id": "a", "pos": 2, "nominal": "1,2", "target_region": [0, 1, 2, 3]}]}'
    rows = drawings.posted(spark.createDataFrame([(body,), ("broken",), (None,)], "body string")).collect()
    assert [(x.id, x.pos, x.nominal, x.target_region) for x in rows] == [("a", 2, "1,2", [0.0, 1.0, 2.0, 3.0])]


def log(seed, n=300):
    r = random.Random(seed)
    return [(r.randrange(4), k, r.choice([*edits.EDITS, "redo"]), r.randrange(9), r.randrange(90), r.randrange(200)) for k in range(n)]


EDIT = "session long, seq long, op string, id int, x int, y int"


def by_snapshots(rows):
    """Undo and redo as whole copies of the state."""
    state, past, future = {}, [], []
    for op, at, x, y in rows:
        if op == "undo":
            if past:
                future.append(dict(state))
                state = past.pop()
        elif op == "redo":
            if future:
                past.append(dict(state))
                state = future.pop()
        else:
            past.append(dict(state))
            future.clear()
            row = state.get(at)
            if op == "add":
                state = {**state, at: row or (x, y, False)}
            elif op == "delete":
                state = {k: v for k, v in state.items() if k != at}
            elif row:
                state = {**state, at: (x, y, row[2]) if op == "move" else (*row[:2], True)}
    order = sorted(state.items(), key=lambda r: (int(r[1][1] / 60 + 0.5), r[1][0], r[0]))
    return [(at, k + 1, *r) for k, (at, r) in enumerate(order)]


def test_replay(spark):
    rows = log(1)
    want = {(s, *x) for s in range(4) for x in by_snapshots([(edits.EDITS.get(o, o), a, b, c) for t, _, o, a, b, c in rows if t == s])}
    assert set(map(tuple, edits.replay(spark.createDataFrame(rows, EDIT)).collect())) == want


def test_stream_equals_batch(spark, tmp_path):
    rows = log(2, 120)
    for k in range(3):
        spark.createDataFrame(rows[k * 40 : (k + 1) * 40], EDIT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(EDIT).parquet(str(tmp_path / "in"))
        seen = {}
        q = edits.stream(source).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.update({s: {tuple(x) for x in df.collect() if x[0] == s} for s in {x[0] for x in df.collect()}})).option("checkpointLocation", str(tmp_path / "state")).start()
        q.processAllAvailable()
        q.stop()
    touched = {r[0] for r in rows[80:]}
    want = {tuple(x) for x in edits.replay(spark.createDataFrame(rows, EDIT)).collect() if x[0] in touched}
    assert set().union(*seen.values()) == {x for x in want}

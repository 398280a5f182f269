import json

from tolmark.operators import report, review, transcripts
from tolmark.operators.report import F


def legend(spark, raw):
    return [tuple(x)[2:6] for x in transcripts.legend(spark.createDataFrame([(1, raw)], "block long, raw string")).orderBy("ord").collect()]


def test_legend(spark):
    assert legend(spark, '[{"pos": 101, "en": "FREE OF OIL", "de": "OELFREI"}]') == [(101, None, "FREE OF OIL", "OELFREI")]
    assert legend(spark, "101\tEN\tDE\n102   EN TEXT   DE TEXT") == [(101, None, "EN", "DE"), (102, None, "EN TEXT", "DE TEXT")]
    assert legend(spark, '[{"pos": "101", "sub": 1, "en": "x"}]') == [(101, 1, "x", "")]
    assert legend(spark, '[{"pos": 101, "en": "a", "de": ""}, {"pos": 101, "en": "b", "de": "c"}]') == [(101, None, "a b", "c")]
    assert legend(spark, "101\ta\tb\n101.1\tc\td\n101.2\te\tf\n102\tg\th") == [(101, None, "a", "b"), (101, 1, "c", "d"), (101, 2, "e", "f"), (102, None, "g", "h")]
    assert legend(spark, "garbage") == [] and legend(spark, "") == [] and legend(spark, None) == []
    assert legend(spark, "101\tA [1] B\tx") == []  # a list in the text is read as JSON
    assert legend(spark, '[{"pos": 101, "en": null}]') == [(101, None, "None", "")]


def test_detections(spark):
    raw = 'Here:\n```json\n[{"box": [1, 2, 30.9, 40], "kind": "gdt"}, {"box": [5, 5, 5, 9]}, {"kind": "note"}, {"box": [1, 2, 3, 4], "kind": "weird", "conf": 0.5}, {"box": ["1", "2", "x", 4]}, {"box": ["1.5", 2, 3, 4]}]\n```'
    df = spark.createDataFrame([(1, raw), (2, "none"), (3, None), (4, "[1, 2")], "tile long, raw string")
    got = [tuple(x) for x in transcripts.detections(df, ["tile"]).orderBy("ord").collect()]
    assert got == [(1, 0, 1, 2, 30, 40, "gdt", 1.0), (1, 3, 1, 2, 3, 4, "dimension", 0.5)]


def test_title_cells(spark):
    raws = ['{"label": "Scale / Massstab", "value": "1:2"}', '```json\n{"label": "A", "value": "b"}\n```', "just a value", "Format / Size: A2", "", "   ", None]
    df = spark.createDataFrame(list(enumerate(raws)), "cell long, raw string")
    got = {x.cell: tuple(x)[1:] for x in transcripts.title_cells(df).collect()}
    assert got == {0: ("Scale / Massstab", "Scale", "Massstab", "1:2"), 1: ("A", "A", "", "b"), 2: ("", "", "", "just a value"), 3: ("Format / Size", "Format", "Size", "A2")}


def test_review(spark):
    base = dict(page=1, char_type="Distance", nominal="1,2", raw_text="1,2 +0,1 -0,1", confidence=0.9, rotated=False, subtype="", note_ref_pos=None)
    cases = [({}, []), ({"raw_text": " ", "nominal": "", "confidence": 0.0}, ["empty read"]), ({"raw_text": "garbled", "nominal": ""}, ["missing nominal"]), ({"confidence": 0.4}, ["low OCR confidence"]), ({"rotated": True}, ["rotation ambiguity"]),
             ({"raw_text": "", "rotated": True}, ["empty read", "rotation ambiguity"]), ({"char_type": "Theoretical", "nominal": ""}, ["missing nominal"]),
             ({"subtype": "note_ref", "note_ref_pos": 101}, ["unknown note reference"]), ({"subtype": "note_ref", "note_ref_pos": 102}, []), ({"subtype": "note_ref"}, ["unknown note reference"]), ({"subtype": "note_ref", "note_ref_pos": 101, "page": 2}, [])]
    schema = "id int, page long, char_type string, nominal string, raw_text string, confidence double, rotated boolean, subtype string, note_ref_pos int"
    chars = spark.createDataFrame([{"id": k} | base | c for k, (c, _) in enumerate(cases)], schema)
    notes = spark.createDataFrame([(1, 102, None), (1, 103, None), (1, 101, 1)], "page long, pos int, sub int")
    got = {x.id: x.review_reasons for x in review.characteristics(chars, notes).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}


def test_best_read_and_words(spark):
    reads = spark.createDataFrame([(1, 0, "5", "5", "", 0.8, True), (1, 1, "5", "5", "", 0.8, True), (2, 0, "5", "5", "", 0.9, True), (2, 1, "", "", "", 0.1, True), (3, 0, "", "", "", 0.0, True), (3, 1, "", "", "", 0.0, True), (4, 0, "x", "", "", 0.5, False)], "id long, candidate int, text string, nominal string, upper_tol string, confidence double, vertical boolean")
    got = {x.id: (x.candidate, x.ambiguous) for x in report.best_read(reads, "id", F.col("vertical")).collect()}
    assert got == {1: (0, True), 2: (0, False), 3: (0, False), 4: (0, False)}
    words = spark.createDataFrame([(1, 2, "b", "50"), (1, 1, " a ", "90"), (1, 3, " ", "10"), (1, 4, "c", "-"), (2, 1, "", "7")], "doc long, ord int, word string, conf string")
    assert {x.doc: (x.text, round(x.confidence, 6)) for x in report.words_joined(words, ["doc"]).collect()} == {1: ("a b c", 0.7), 2: ("", 0.0)}


def test_workbook(spark, tmp_path):
    chars = spark.createDataFrame([(2, "Distance", "1", "", ""), (1, "Radius", "2", "", "")], "pos int, char_type string, nominal string, upper_tol string, lower_tol string")
    notes = spark.createDataFrame([(0, 101, None, None, "a", "b"), (1, 1, 101, 1, "c", "d"), (2, 2, 101, 2, "e", "f"), (3, 102, None, None, "g", "h")], "ord int, pos int, parent_pos int, sub_index int, text_en string, text_de string")
    sheets = report.workbook(chars, notes=notes, marks=notes.limit(0).drop("parent_pos", "sub_index"))
    assert list(sheets) == ["Inspection", "Notes"]
    assert [x.pos for x in sheets["Inspection"].collect()] == [1, 2]
    assert [x.label for x in sheets["Notes"].collect()] == ["101", "101.1", "101.2", "102"]
    report.write_workbook(sheets, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/Notes").count() == 4
    lines = [tuple(x) for x in spark.read.csv(f"{tmp_path}/Inspection").fillna("").collect()]
    assert lines == [*report.INSPECTION_HEADER, ("1", "Radius", "2", "", ""), ("2", "Distance", "1", "", "")]


def test_payload(spark):
    chars = spark.createDataFrame([(1, 5, "gdt", 9), (2, 1, None, None)], "page long, ord long, kind string, conf int")
    notes = spark.createDataFrame([(2, 1, 102, "b", None), (2, 0, 101, "a", "x")], "page long, ord int, pos int, text_en string, text_de string")
    title = spark.createDataFrame([(2, 4, "A / B", "A", "B", "1:2")], "page long, ord long, label string, label_en string, label_de string, value string")
    made = {x.page: json.loads(x.payload) for x in report.payload(chars, notes, notes.where("pos = 101"), title).collect()}
    assert made[1] == {"characteristics": [{"ord": 5, "kind": "gdt", "conf": 9}], "notes": None, "marks": None, "title_fields": []}
    first, second = {"ord": 0, "pos": 101, "text_en": "a", "text_de": "x"}, {"ord": 1, "pos": 102, "text_en": "b", "text_de": None}
    fields = [{"ord": 4, "label": "A / B", "label_en": "A", "label_de": "B", "value": "1:2"}]
    assert made[2] == {"characteristics": [{"ord": 1, "kind": None, "conf": None}], "notes": [first, second], "marks": [first], "title_fields": fields}

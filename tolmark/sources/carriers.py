"""Relations of detected boxes, callouts, transcriptions and edits, derived from the base tables by integer arithmetic.

Each is one SELECT that Spark and any ANSI engine read alike; ``{name}`` stands for a base table. Pages grow in number with the
data, so that no page does.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

CARRIERS: dict[str, str] = {
    # boxes that a model detected, page by page
    "dets": """
SELECT o_custkey AS page, o_orderkey AS ord,
  CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'dimension' WHEN 1 THEN 'gdt' WHEN 2 THEN 'theoretical' ELSE 'note' END AS kind,
  CAST((o_orderkey * 37) % 120 AS INT) AS x0, CAST((o_orderkey * 53) % 70 AS INT) AS y0,
  CAST((o_orderkey * 37) % 120 + 40 + o_orderkey % 60 AS INT) AS x1, CAST((o_orderkey * 53) % 70 + 20 + o_orderkey % 30 AS INT) AS y1,
  CAST((o_orderkey * 13) % 97 AS INT) AS conf
FROM {orders}""",
    # rectangles found by drawing analysis, one for each order: two of three near a detection, the third away from it
    "cvb": """
SELECT page, ord, CAST(x + ord % 9 - 4 AS INT) AS x0, CAST(y + ord % 7 - 3 AS INT) AS y0,
  CAST(x + 40 + ord % 60 + ord % 5 AS INT) AS x1, CAST(y + 20 + ord % 30 + ord % 4 AS INT) AS y1, CAST(1 + ord % 3 AS INT) AS cells
FROM (SELECT o_custkey AS page, o_orderkey AS ord, (o_orderkey * 37 + CASE WHEN o_orderkey % 3 = 1 THEN 61 ELSE 0 END) % 120 AS x,
  (o_orderkey * 53 + CASE WHEN o_orderkey % 3 = 1 THEN 37 ELSE 0 END) % 70 AS y FROM {orders})""",
    # transcribed callouts
    "callouts": """
SELECT p_partkey AS id, p_partkey % 50 AS page,
  CASE CAST(p_partkey % 16 AS INT)
    WHEN 0 THEN concat('Ø', CAST(p_size AS VARCHAR(9)), ' +0,1 -0,1') WHEN 1 THEN concat(CAST(p_size AS VARCHAR(9)), ' ±0.', CAST(p_partkey % 9 AS VARCHAR(9)))
    WHEN 2 THEN concat('R', CAST(p_size AS VARCHAR(9)), ',5 MAX') WHEN 3 THEN concat('(', CAST(p_size AS VARCHAR(9)), ')')
    WHEN 4 THEN concat('O', CAST(p_size AS VARCHAR(9)), chr(10), '+0.05', chr(10), '-0.05') WHEN 5 THEN '(optional)'
    WHEN 6 THEN concat('⊕ Ø0.', CAST(p_partkey % 7 AS VARCHAR(9)), ' A') WHEN 7 THEN concat('Ø', CAST(p_size AS VARCHAR(9)), '.6 +0.2 0.0')
    WHEN 8 THEN '  ' WHEN 9 THEN concat(CAST(p_size AS VARCHAR(9)), ' +0,2 +0,1') WHEN 10 THEN concat('-', CAST(p_size AS VARCHAR(9)), ',25')
    WHEN 11 THEN CAST(100 + p_partkey % 12 AS VARCHAR(9)) WHEN 12 THEN concat('r ', CAST(p_size AS VARCHAR(9)), ' -0,5')
    WHEN 13 THEN concat('∥ 0,', CAST(p_partkey % 5 AS VARCHAR(9))) WHEN 14 THEN concat('Cu-ETP_R', CAST(p_size AS VARCHAR(9))) ELSE concat('+', CAST(p_size AS VARCHAR(9)), ' ±1,5') END AS raw,
  CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN 'gdt' WHEN 1 THEN 'theoretical' WHEN 2 THEN 'material' WHEN 3 THEN 'note' ELSE '' END AS hint,
  CAST((p_partkey * 29) % 101 AS INT) AS conf, p_partkey % 11 = 0 AS rotated
FROM {part}""",
    # the legends' transcriptions, line by line: a whole text is one line, its halves the two languages
    "legend": """
SELECT conv_id AS block, turn AS ord, CAST(100 + floor(turn / 2) AS INT) AS pos,
  CASE WHEN role = 'system' THEN CAST(turn + 1 AS INT) ELSE NULL END AS sub,
  CASE WHEN turn % 5 = 3 THEN '' ELSE trim(substr(line, 1, CAST(floor(length(line) / 2) AS INT))) END AS en,
  CASE WHEN turn % 3 = 2 THEN '' ELSE trim(substr(line, CAST(floor(length(line) / 2) AS INT) + 1)) END AS de
FROM (SELECT conv_id, turn, role, replace(replace(replace(replace(translate(text, concat(chr(9), chr(10)), '  '), '    ', ' '), '  ', ' '), '  ', ' '), '  ', ' ') AS line FROM {conversations})""",
    # what a model said about a tile
    "said": """
SELECT event_id AS tile, CAST(user_id % 40 AS INT) AS tx, CAST(event_id % 30 AS INT) AS ty,
  CASE CAST(event_id % 7 AS INT)
    WHEN 0 THEN 'no boxes here' WHEN 1 THEN '[{"box": [1, 2' WHEN 2 THEN '{"box": [1, 2, 3, 4]}'
    WHEN 3 THEN concat('Sure:', chr(10), '[{"box": [', CAST(event_id % 50 AS VARCHAR(9)), ', 2, ', CAST(event_id % 50 + 30 AS VARCHAR(9)), ', 40], "kind": "gdt", "conf": 0.5}, {"kind": "note"}]', chr(10), 'done')
    WHEN 4 THEN concat('[{"box": [5, 5, 5, 9], "kind": "note"}, {"box": [', CAST(user_id % 90 AS VARCHAR(9)), '.7, 1.2, 99.9, 8], "kind": "weird"}]')
    WHEN 5 THEN concat('[{"box": ["1", 2, 30, 40]}, 7, {"box": [1, 2, 3]}, {"box": [0, 0, ', CAST(10 + event_id % 9 AS VARCHAR(9)), ', 12], "kind": "note", "conf": 0.25}]')
    ELSE '[]' END AS raw
FROM {events}""",
    # cells of a title block
    "cells": """
SELECT page_id AS cell, CASE CAST(page_id % 8 AS INT)
    WHEN 0 THEN url WHEN 1 THEN concat('Format / Size: A', CAST(page_id % 5 AS VARCHAR(9))) WHEN 2 THEN '' WHEN 3 THEN concat('{"label": "Scale / Massstab", "value": "1:', CAST(page_id % 20 AS VARCHAR(9)), '"}')
    WHEN 4 THEN concat('```json', chr(10), '{"label": " Weight ", "value": "', CAST(page_id AS VARCHAR(9)), ' kg"}', chr(10), '```') WHEN 5 THEN concat('A-', CAST(page_id AS VARCHAR(9)))
    WHEN 6 THEN '  Material :  ' ELSE concat(': value ', CAST(page_id AS VARCHAR(9))) END AS raw
FROM {pages}""",
    # eight by eight pixels, 1 where there is ink
    "ink": """
SELECT vec_id AS patch, embedding AS v FROM {embeddings}""",
    # edits of a review session
    "edits": """
SELECT user_id AS session, event_id AS seq, event_type AS op, CAST(event_id % 13 AS INT) AS id, CAST(event_id % 90 AS INT) AS x, CAST((event_id * 7) % 200 AS INT) AS y
FROM {events}""",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = CARRIERS[name].replace("VARCHAR(9)", "STRING")
    used = set(re.findall(r"\{(\w+)\}", text)) & set(TABLES)
    for t in used:
        text = text.replace("{" + t + "}", f"parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(text)


def ansi(body: str) -> str:
    """A query over the relations above, for an engine that has the base tables as views."""
    out = []
    for name, text in CARRIERS.items():
        if re.search(rf"\b{name}\b", body):
            for t in TABLES:
                text = text.replace("{" + t + "}", t)
            out.append(f"{name} AS ({text})")
    if not out:
        return body.strip()
    return f"WITH RECURSIVE {', '.join(out)}{',' if body.lstrip().startswith(',') else ''}{body.lstrip().removeprefix(',')}"

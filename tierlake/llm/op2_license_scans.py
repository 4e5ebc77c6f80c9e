"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Native: DataFrame and SQL functions alone.

Tokens are runs of a-z and 0-9 of the lower-cased text. A template is the set of
its SHINGLE-token shingles (one of fewer tokens: of its whole token sequence
alone). A text is cut into windows of twice as many shingles as the template
has, starting at every multiple of the template's number, so that every passage
of the template's length lies within a window. A window matches, if it holds at
least CONTAINMENT of the template's shingles. Reported is the best window of
each document and template (of equals, the first).

Retrieval: BANDS MinHash bands of one row. A window with 80 % of a template has a
Jaccard similarity of at least 0.8 / 2.2 = 0.36 with it and shares a band with a
probability of 1 - 0.64 ** 24 > 0.99997. A window shares a band only if it holds the
shingle that is the template's least one in that band, so these shingles are the
bands' index: they fetch the windows, whose own bands are then worked out and joined.

Templates are a caller's list; the shingles of their bands are literals of the query up to
LITERALS of them, and a join beyond. Their bands are broadcast up to
BROADCAST_BANDS rows, and shuffled beyond.

Defined cases: null and empty texts match nothing; there are rows for matches
alone. Repeated rows are scanned as one document if doc_id and text are equal, a
null doc_id is an id like any other. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, once, real_id, table

#: (name, text)
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("reserved", "All rights reserved."),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MIT-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
]

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 24
LITERALS = 5_000
BROADCAST_BANDS = 100_000


def tokens(text):
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def shingles(column: str, width: int):
    """Hashes of all runs of `width` tokens."""
    run = ", ".join(f"{column}[i + {d}]" for d in range(width))
    return F.expr(f"CASE WHEN size({column}) >= {width} THEN transform(sequence(0, size({column}) - {width}), i -> xxhash64({run})) ELSE array() END")


def signature(column: str):
    return F.expr(f"transform(sequence(1, {BANDS}), b -> xxhash64(b, array_min(transform({column}, s -> xxhash64(s, b)))))")


def least(column: str):
    """The shingle behind each band."""
    return F.expr(f"transform(sequence(1, {BANDS}), b -> array_min(transform({column}, s -> struct(xxhash64(s, b) AS h, s AS s))).s)")


def templates_of(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> list:
    """(name, width of its shingles, its distinct shingles, their number, its bands, the shingles behind them) per template."""
    raw = spark.createDataFrame(list(templates), "license string, text string").withColumn("t", tokens(F.col("text"))).where("size(t) > 0")
    raw = raw.withColumn("width", F.least(F.lit(SHINGLE), F.size("t")))
    out = []
    for width in range(1, SHINGLE + 1):
        own = raw.where(F.col("width") == width).withColumn("s", F.array_distinct(shingles("t", width)))
        out += own.select("license", "width", "s", F.size("s").alias("m"), signature("s").alias("bands"), least("s").alias("least")).collect()  # the caller's own list
    return out


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """k, h, license, found (template shingles in the best window), of, window (its first shingle), first and last (its first and last token from 0)."""
    spark = docs.sparkSession
    known = templates_of(spark, templates)
    tokenised = keyed(docs, doc_id, text).select("k", "h", once(tokens(F.col("text"))).alias("t"))
    out = None
    for width in sorted({r.width for r in known}):
        mine = [r for r in known if r.width == width]
        wanted = sorted({s for r in mine for s in r.least})
        signed = tokenised.select("k", "h", once(shingles("t", width)).alias("s"))
        if len(wanted) <= LITERALS:
            hits = F.expr(f"filter(transform(s, (x, i) -> CASE WHEN x IN ({', '.join(f'{s}L' if s != -(2**63) else f'CAST({s} AS BIGINT)' for s in wanted)}) THEN i END), i -> i IS NOT NULL)")
            signed = signed.withColumn("hits", once(hits))
        else:
            list_of = spark.createDataFrame([(s,) for s in wanted], "x long")
            some = signed.select("k", "h", F.posexplode("s").alias("i", "x")).join(list_of, "x").groupBy("k", "h").agg(F.collect_list("i").alias("hits"))
            signed = signed.join(some, ["k", "h"])
        signed = signed.where("size(hits) > 0")
        index = spark.createDataFrame([(r.license, r.m, r.s, b, x) for r in mine for b, x in enumerate(r.bands)], "license string, m int, template array<long>, b int, band long")
        index = F.broadcast(index) if len(mine) * BANDS <= BROADCAST_BANDS else index
        sizes = sorted({r.m for r in mine})
        starts = F.expr(f"flatten(transform(array({', '.join(map(str, sizes))}), m -> transform(array_distinct(flatten(transform(hits, i -> array(i div m, i div m - 1)))), j -> struct(m AS m, CAST(j * m AS int) AS start))))")
        windows = signed.select("k", "h", "s", F.explode(starts).alias("x")).where("x.start >= 0 OR x.start + 2 * x.m > 0")
        windows = windows.select("k", "h", "x.m", "x.start", F.expr("slice(s, greatest(x.start, 0) + 1, x.start + 2 * x.m - greatest(x.start, 0))").alias("s")).withColumn("bands", once(signature("s")))
        retrieved = windows.select("k", "h", "m", "start", "s", F.posexplode("bands").alias("b", "band")).join(index, ["m", "b", "band"])
        found = retrieved.withColumn("found", F.size(F.array_intersect("template", "s"))).where(F.col("found") >= F.lit(CONTAINMENT) * F.col("m"))
        # several bands may retrieve the same window
        best = found.groupBy("k", "h", "license").agg(F.max_by(F.struct("found", "m", "start"), F.struct("found", -F.col("start"))).alias("x"))
        best = best.select("k", "h", "license", "x.found", F.col("x.m").alias("of"), F.col("x.start").alias("window"))
        out = best if out is None else out.unionByName(best)
    return out


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    return out.select(real_id().alias("doc_id"), "license", "found", "of", "window", F.round(F.col("found") / F.col("of"), 6).alias("containment"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: The definition itself, over all windows.
ORACLE = f"""
WITH t AS (SELECT license, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in TEMPLATES)}) v(license, text)),
ts AS (SELECT license, least({SHINGLE}, len(w)) AS width, list_distinct(list_transform(generate_series(1, len(w) - least({SHINGLE}, len(w)) + 1), lambda i: list_slice(w, i, i + least({SHINGLE}, len(w)) - 1))) AS s FROM t),
tx AS (SELECT license, width, len(s) AS m, unnest(s) AS s FROM ts),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
ds AS (SELECT doc_id, width, unnest(generate_series(1, len(w) - width + 1)) AS i, w FROM d, (SELECT DISTINCT width FROM tx) WHERE len(w) >= width),
hit AS (SELECT ds.doc_id, tx.license, tx.m, ds.i - 1 AS i, tx.s FROM ds JOIN tx ON ds.width = tx.width AND list_slice(ds.w, ds.i, ds.i + ds.width - 1) = tx.s),
win AS (SELECT doc_id, license, m, s, unnest([i // m, i // m - 1]) AS j FROM hit),
counted AS (SELECT doc_id, license, m, j * m AS start, count(DISTINCT s) AS found FROM win GROUP BY ALL HAVING count(DISTINCT s) >= {CONTAINMENT} * m),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY found DESC, start) AS r FROM counted)
SELECT doc_id, license, found::INTEGER AS found, m::INTEGER AS of, start::INTEGER AS "window", round(found / m, 6) AS containment FROM best WHERE r = 1
"""

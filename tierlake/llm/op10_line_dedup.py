"""Line dedup by a deletion-neighbourhood join: lines within one edited word of an earlier line of the corpus are removed.

Native: DataFrame and SQL functions alone.

A line is its words (runs without the white space bytes 20 and 09-0D); the edit
distance counts inserted, deleted and replaced words. A line of MIN_WORDS words
or more is removed, if an earlier one (smaller doc_id, or earlier in the
document) of MIN_WORDS or more has a distance of at most 1, that is a similarity
of at least 0.8; a shorter one only if an earlier line is equal to it. Lines are
judged on the input, not on what is left. Lines without words always stay.

Method: a line emits, as hashed keys, its words with each one deleted. Two lines
of n words that differ in word i have the same key "n words, without word i":
all lines of such a group are within one edit of each other, so the group's
earliest decides. A line that is another without a word is that one's key "without
a word", and itself; the lines of such a group are within one edit of the one
that is whole. Groups therefore need a minimum, never pairs. The links that come
out are verified with the words themselves.

Before that, equal lines become one, and lines that can't have a partner leave:
two lines within one edit share their first half or their last half (of the
longer one's length), so halves are joined as keys first, and deletions are
emitted only in the half that a partner leaves open.

Defined cases: null text has no lines. Rows with equal doc_id and text are one
document; a null doc_id is the smallest. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cleanup, key_of, keyed, once, real_id, settle, table, unused

MIN_WORDS = 5
PLACE = "struct(k, h, no)"

#: Each key with a bit: n words or n + 1 words as the longer line's number, first or last half.
_HALVES = """array(
  struct(1 AS bit, xxhash64('first', n, slice(w, 1, n div 2)) AS half),
  struct(2 AS bit, xxhash64('last', n, slice(w, n div 2 + 1, n - n div 2)) AS half),
  struct(4 AS bit, xxhash64('first', n + 1, slice(w, 1, (n + 1) div 2)) AS half),
  struct(8 AS bit, xxhash64('last', n + 1, slice(w, (n + 1) div 2, n + 1 - (n + 1) div 2)) AS half))"""

#: Exclusive ors of the words' hashes with their places, up to each word; and with places less by one.
_SUMS = "aggregate(transform(w, (x, i) -> xxhash64(x, i - {d})), array(0L), (s, x) -> array_append(s, element_at(s, -1) ^ x))"

_DELETIONS = """flatten(transform(
  filter(sequence(0, n - 1), i -> (i >= n div 2 AND bits & 1 > 0) OR (i < n div 2 AND bits & 2 > 0)),
  i -> array(
    struct(xxhash64('replace', n, i, before[i] ^ after[n] ^ after[i + 1]) AS key, false AS whole),
    struct(xxhash64('delete', n - 1, before[i] ^ after[n] ^ after[i + 1]) AS key, false AS whole))))"""
_WHOLE = "CASE WHEN bits & 12 > 0 THEN array(struct(xxhash64('delete', n, before[n]) AS key, true AS whole)) ELSE array() END"

#: Is the distance of the word lists a and b at most 1? p: the first place where they differ, 0 if none.
_FIRST_DIFFERENCE = "CAST(array_position(transform(zip_with(a, b, (x, y) -> x <=> y), e -> e), false) AS int)"
_NEAR = """p = 0
  OR size(a) = size(b) AND slice(a, p + 1, size(a)) = slice(b, p + 1, size(b))
  OR size(a) = size(b) + 1 AND slice(a, p + 1, size(a)) = slice(b, p, size(a))
  OR size(b) = size(a) + 1 AND slice(a, p, size(b)) = slice(b, p + 1, size(b))"""


def words_of(line: str = "line"):
    """The line's words. Lines with no other white space than spaces, nearly all, are split at these without a regular expression."""
    spaced = f"CASE WHEN {line} RLIKE '[\\\\x09-\\\\x0D]' THEN translate({line}, '\\t\\n\\u000B\\u000C\\r', '     ') ELSE {line} END"
    return F.expr(f"array_remove(split({spaced}, ' '), '')")


def lines_of(own: DataFrame) -> DataFrame:
    """k, h, no (from 0), line, l1, l2 (hashes of the line): the lines with a word."""
    lines = own.select("k", "h", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return lines.withColumns({"l1": F.xxhash64("line"), "l2": F.xxhash64(F.lit(1), "line")})


def near_links(distinct: DataFrame) -> DataFrame:
    """k, h, no of distinct lines (l1, l2, k, h, no, line) with an earlier line within one edit, verified."""
    long = distinct.select("l1", "l2", once(words_of()).alias("w")).withColumn("n", F.size("w")).where(F.col("n") >= MIN_WORDS)
    halves = long.select("l1", "l2", F.explode(F.expr(_HALVES)).alias("x")).select("l1", "l2", "x.bit", "x.half")
    shared = settle(halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half"))
    bits = settle(halves.join(shared, "half").groupBy("l1", "l2").agg(F.bit_or("bit").alias("bits")))
    some = settle(distinct.join(bits, ["l1", "l2"]).select("k", "h", "no", "line", "bits"))

    sums = some.withColumn("w", once(words_of())).select("k", "h", "no", "bits", F.size("w").alias("n"), F.expr(_SUMS.format(d=0)).alias("before"), F.expr(_SUMS.format(d=1)).alias("after"))
    variants = settle(sums.select("k", "h", "no", F.explode(F.expr(f"concat({_DELETIONS}, {_WHOLE})")).alias("x")).select("k", "h", "no", "x.key", "x.whole"))
    groups = settle(variants.groupBy("key").agg(
        F.count("*").alias("c"), F.min(F.expr(PLACE)).alias("least"), F.min(F.expr(f"CASE WHEN whole THEN {PLACE} END")).alias("centre"),
    ).where("c > 1"))
    # a group with a centre is around it: its lines are near the centre, the centre is near all of them
    aim = F.expr("CASE WHEN centre IS NULL OR whole THEN least ELSE centre END")
    links = variants.join(groups, "key").withColumn("aim", aim).where(f"aim < {PLACE}")
    links = settle(links.select("k", "h", "no", F.col("aim.k").alias("k2"), F.col("aim.h").alias("h2"), F.col("aim.no").alias("no2")).distinct())
    other = some.select(F.col("k").alias("k2"), F.col("h").alias("h2"), F.col("no").alias("no2"), F.col("line").alias("line2"))
    both = links.join(other, ["k2", "h2", "no2"]).join(some.drop("bits"), ["k", "h", "no"])
    both = both.select("k", "h", "no", "line2", once(words_of()).alias("a")).select("k", "h", "no", "a", once(words_of("line2")).alias("b"))
    return both.withColumn("p", once(F.expr(_FIRST_DIFFERENCE))).where(_NEAR).select("k", "h", "no").distinct()


def removed_lines(own: DataFrame) -> DataFrame:
    """k, h, removed (array of line numbers): the documents that lose lines."""
    with cleanup(own.sparkSession):
        lines = lines_of(own)
        distinct = lines.groupBy("l1", "l2").agg(F.count("*").alias("c"), F.min(F.expr(PLACE)).alias("first"), F.first("line").alias("line"))
        distinct = settle(distinct.select("l1", "l2", "c", "first.k", "first.h", "first.no", "line"))
        near = near_links(distinct).withColumn("near", F.lit(True))
        fate = distinct.select("l1", "l2", "c", F.expr(PLACE).alias("first"), "k", "h", "no").join(near, ["k", "h", "no"], "left")
        fate = settle(fate.where("c > 1 OR near").select("l1", "l2", "first", F.coalesce("near", F.lit(False)).alias("near")))
        gone = lines.select("k", "h", "no", "l1", "l2").join(fate, ["l1", "l2"]).where(f"near OR first != {PLACE}")
        return settle(gone.groupBy("k", "h").agg(F.sort_array(F.collect_set("no")).alias("removed")), keep=True)


def dedup(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without the removed lines; a document that has no words left by that goes.

    n_chars, where there is one, is the new text's number of characters.
    """
    names, (k, h, removed, parts) = docs.columns, unused(docs, "k", "h", "removed", "lines")
    lost = removed_lines(keyed(docs)).withColumnsRenamed({"k": k, "h": h, "removed": removed})
    marked = docs.withColumns(dict(zip((k, h), key_of(docs["doc_id"], docs["text"]), strict=True)))
    out = marked.join(lost, [k, h], "left")
    # the lines between the removed ones, run by run: linear in the text's length
    out = out.withColumn(parts, once(F.when(F.col(removed).isNotNull(), F.split("text", "\n"))))
    runs = f"""transform(sequence(0, size({removed})), j -> slice({parts},
      CASE WHEN j = 0 THEN 1 ELSE {removed}[j - 1] + 2 END,
      CASE WHEN j = size({removed}) THEN size({parts}) ELSE {removed}[j] END - CASE WHEN j = 0 THEN 0 ELSE {removed}[j - 1] + 1 END))"""
    kept = F.expr(f"array_join(flatten({runs}), '\n')")
    changed = {"text": F.when(F.col(removed).isNotNull(), kept).otherwise(F.col("text"))}
    out = out.withColumns(changed).where(F.col(removed).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(removed).isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (numbers of the removed lines, from 0, joined by commas): one row per document."""
    own = keyed(docs)
    counts = own.select("k", "h", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    counts = counts.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    out = counts.join(removed_lines(own), ["k", "h"], "left")
    return out.select(real_id().alias("doc_id"), "n_lines", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


#: Distance at most 1, by the definition: equal, or one word replaced, or one word more or less.
ORACLE = rf"""
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS no, unnest(ls) AS line FROM docs WHERE ls IS NOT NULL),
parted AS (SELECT doc_id, no, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM lines),
own AS (SELECT *, len(w) AS n FROM parted WHERE len(w) > 0),
firsts AS (SELECT line, min({{'d': doc_id, 'no': no}}) AS place, any_value(w) AS w, any_value(n) AS n FROM own GROUP BY line),
variants AS (SELECT place, n, unnest(generate_series(1, n)) AS i, w FROM firsts WHERE n >= {MIN_WORDS}),
keys AS (SELECT place, n, i, list_slice(w, 1, i - 1) || list_slice(w, i + 1, n) AS rest FROM variants),
replaced AS (SELECT place, min(place) OVER (PARTITION BY n, i, rest) AS least FROM keys),
whole AS (SELECT place, n, w FROM firsts WHERE n >= {MIN_WORDS}),
longer AS (SELECT k.place AS a, s.place AS b FROM keys k JOIN whole s ON k.n = s.n + 1 AND k.rest = s.w),
near AS (SELECT place FROM replaced WHERE least < place UNION SELECT a FROM longer WHERE b < a UNION SELECT b FROM longer WHERE a < b),
gone AS (
  SELECT o.doc_id, o.no FROM own o JOIN firsts f ON o.line = f.line
  WHERE {{'d': o.doc_id, 'no': o.no}} <> f.place OR f.place IN (SELECT place FROM near)),
lost AS (SELECT doc_id, count(*) AS c, string_agg(no::VARCHAR, ',' ORDER BY no) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.ls), 0)::INTEGER AS n_lines, coalesce(l.c, 0)::INTEGER AS n_removed, coalesce(l.removed, '') AS removed
FROM docs d LEFT JOIN lost l ON d.doc_id = l.doc_id
"""

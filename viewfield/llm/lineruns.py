"""Removal of repeated runs of lines, native DataFrame operations only.

Each document is a sequence of line ids.  Suffixes are ranked by their first 1, 2, 4, ... lines: the rank for
twice the lines comes from the ranks of a place and of the place that many lines on (prefix doubling).  Ranks
ascend in the order of their sequences.  Suffixes of one rank form the interval of the suffix array whose
common prefix has at least that many lines; a suffix alone in its rank is done and leaves the next round.

A run counts from ``MIN_CHARS`` characters on, in one line or in many; line ends and lines of white space only
don't count and belong to no run.  Of each maximal run that comes again the first copy stays, the others go.
Such a run is the union of the shortest runs that count and start or end at one of its lines, and two of these
are alike if they have as many lines and their first 2**k and last 2**k lines are of one interval each, 2**k
being the largest power not above their lines.  So the ranks needed are those of places within such runs, up
to ``MIN_CHARS`` lines: long lines are done in the first round, and the rounds do not grow with the documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Characters from which on a repeated run goes.
MIN_CHARS = 200
#: Columns that name a document.
DOC = ["d", "t"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Add d and t, which name a document: its id (null lowest) and a hash of its text."""
    return docs.withColumn("d", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("t", F.xxhash64("text"))


def places_of(docs: DataFrame) -> DataFrame:
    """(d, t, pos, line, chars, before, through, l1, l2): each line that is not blank.

    pos counts these lines, line counts all; before and through are the characters of lines before, and with this.
    """
    each = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("x")))
    said = F.filter(each, lambda s: s.x.rlike("\\S"))
    named = F.transform(said, lambda s: F.struct(s.line.alias("line"), F.length(s.x).alias("chars"), F.xxhash64(s.x).alias("l1"), F.xxhash64(F.lit("line"), s.x).alias("l2")))
    rows = _keyed(docs.select("doc_id", "text").where("text is not null")).select(*DOC, F.posexplode_outer(named).alias("pos", "s"))
    rows = rows.where("s is not null").select(*DOC, "pos", "s.*").repartition(*DOC).dropDuplicates([*DOC, "pos"])
    upto = Window.partitionBy(*DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("through", F.sum("chars").over(upto)).withColumn("before", F.col("through") - F.col("chars"))


def shortest(places: DataFrame, least: int) -> DataFrame:
    """(d, t, pos, lines): of each place the shortest runs of ``least`` characters that start there and that end there."""
    ahead = Window.partitionBy(*DOC).orderBy("before").rangeBetween(0, least - 1)
    behind = Window.partitionBy(*DOC).orderBy("through").rangeBetween(1 - least, 0)
    rows = places.select(
        *DOC,
        "pos",
        "chars",
        F.count("*").over(ahead).alias("lines_on"),
        (F.max("through").over(ahead) - F.col("before")).alias("chars_on"),
        F.count("*").over(behind).alias("lines_back"),
        (F.col("through") - F.min("before").over(behind)).alias("chars_back"),
    )
    starts = F.when(F.col("chars_on") >= least, F.struct("pos", F.col("lines_on").alias("lines")))
    # where less is too short without its last line, the same run is found at its start
    back = F.struct((F.col("pos") - F.col("lines_back") + 1).cast("int").alias("pos"), F.col("lines_back").alias("lines"))
    ends = F.when(F.col("chars_back") - F.col("chars") >= least, back)
    return rows.select(*DOC, F.explode(F.array_compact(F.array(starts, ends))).alias("s")).select(*DOC, "s.*")


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rank rows (d, t, pos, ..., keys) whose keys come again: adds rank and whether a row is not its rank's first."""
    again = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(*DOC, "pos")).alias("first")).where("n > 1")
    ordered = stored(again.sort(*keys).withColumn("own", F.monotonically_increasing_id()).drop("n"), "ranks")
    later = F.col("first") != F.struct(*DOC, "pos")
    return stored(rows.join(ordered, keys).select(*rows.columns, F.col("own").alias("rank"), later.alias("later")), "places")


def later_copies(places: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """(d, t, pos, lines): the places where a later copy of a shortest run of ``least`` characters starts."""
    wanted, lines, found, longer = stored(shortest(places, least), "shortest"), 1, [], []
    # of a suffix's first lines: the characters before them, through them, through the first and before the last
    first = places.select(*DOC, "pos", "l1", "l2", "before", "through", F.col("through").alias("through_first"), F.col("before").alias("before_last"))
    level = _ranked(first, ["l1", "l2"]).drop("l1", "l2")
    while lines <= least and not level.isEmpty():  # each line has a character, so no shortest run has more lines
        exact = wanted.where(F.col("lines") == lines)
        found.append(exact.join(level.where("later").select(*DOC, "pos"), [*DOC, "pos"], "left_semi").select(*DOC, "pos", "lines"))
        more = wanted.where((F.col("lines") > lines) & (F.col("lines") < 2 * lines)).withColumn("last", (F.col("pos") + F.col("lines") - lines).cast("int"))
        head = level.select(*DOC, "pos", F.col("rank").alias("head"))
        tail = level.select(*DOC, F.col("pos").alias("last"), F.col("rank").alias("tail"))
        longer.append(more.join(head, [*DOC, "pos"]).join(tail, [*DOC, "last"]).select(*DOC, "pos", "lines", "head", "tail"))
        after = level.select(*DOC, (F.col("pos") - lines).alias("pos"), F.col("rank").alias("next"), "through", "before_last")
        both = level.drop("later", "through", "before_last").withColumnRenamed("rank", "this").join(after, [*DOC, "pos"])
        both = both.where((F.col("before_last") - F.col("before") < least) | (F.col("through") - F.col("through_first") < least))  # no others lie in a shortest run
        level = _ranked(both, ["this", "next"]).drop("this", "next")
        lines *= 2
    if not found:
        return wanted.limit(0)
    found.append(_ranked(reduce(DataFrame.union, longer), ["lines", "head", "tail"]).where("later").select(*DOC, "pos", "lines"))
    return reduce(DataFrame.union, found)


def runs(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """(doc_id, start, lines): the maximal runs that go, places counted among lines that are not blank."""
    return _runs(later_copies(stored(places_of(docs), "lines"), least)).select("d", "start", "lines").withColumnRenamed("d", "doc_id")


def _runs(copies: DataFrame) -> DataFrame:
    """Join copies that touch or overlap: (d, t, start, lines)."""
    one = copies.groupBy(*DOC, "pos").agg(F.max("lines").alias("lines"))
    before = Window.partitionBy(*DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*DOC).orderBy("pos")
    cut = one.withColumn("new", (F.col("pos") > F.coalesce(F.max(F.col("pos") + F.col("lines")).over(before), F.lit(-1))).cast("int"))
    return cut.withColumn("run", F.sum("new").over(upto)).groupBy(*DOC, "run").agg(F.min("pos").alias("start"), (F.max(F.col("pos") + F.col("lines")) - F.min("pos")).alias("lines"))


def dedup(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """All rows and columns, with later copies of repeated runs cut out of ``text``, and n_lines, n_removed added.

    A run counts from ``least`` characters on.

    The first copy is that of the lowest (doc_id, text hash, place).  Null texts stay null with no lines; empty
    texts have one line, which stays.  Very long texts are treated whole, an empty table gives an empty table.
    Rows that repeat both id and text are one document and stay alike.
    Columns named n_lines or n_removed are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    places = stored(places_of(docs), "lines")
    cut = _runs(later_copies(places, least))
    gone = cut.select(*DOC, F.explode(F.sequence("start", F.col("start") + F.col("lines") - 1)).alias("pos")).join(places.select(*DOC, "pos", "line"), [*DOC, "pos"])
    gone = gone.groupBy(*DOC).agg(F.array_sort(F.collect_set("line")).alias("gone"))
    rows = _keyed(docs).join(gone, DOC, "left")
    # one flag a line up to the last that goes; no array is looked up inside a loop over another
    flags = F.flatten(F.transform(F.arrays_zip("gone", F.concat(F.array(F.lit(-1)), "gone").alias("before")), lambda s: F.when(s.gone.isNotNull(), F.concat(F.array_repeat(F.lit(False), s.gone - s.before - 1), F.array(F.lit(True)))).otherwise(F.array().cast("array<boolean>"))))
    rows = rows.withColumn("flags", F.coalesce(flags, F.array().cast("array<boolean>"))).withColumn("lines", F.split("text", "\n", -1))
    kept = F.filter(F.arrays_zip("lines", "flags"), lambda s: ~F.coalesce(s.flags, F.lit(False)))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda s: s.lines), "\n"))
    return rows.select(
        *(text.alias("text") if c == "text" else F.col(c) for c in docs.columns),
        F.greatest(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
p AS (SELECT doc_id, line, x, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS pos FROM l WHERE regexp_replace(x, '\s', '', 'g') <> ''),
c AS (SELECT *, CAST(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS through, through - length(x) AS before FROM p),
e AS (SELECT doc_id, pos AS first, pos + count(*) OVER ahead - 1 AS last, max(through) OVER ahead - before AS chars
      FROM c WINDOW ahead AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND {MIN_CHARS - 1} FOLLOWING)
      UNION
      SELECT doc_id, pos - count(*) OVER behind + 1, pos, through - min(before) OVER behind
      FROM c WINDOW behind AS (PARTITION BY doc_id ORDER BY through RANGE BETWEEN {MIN_CHARS - 1} PRECEDING AND CURRENT ROW)),
t AS (SELECT doc_id, list(x ORDER BY pos) AS xs FROM p GROUP BY doc_id),
r AS (SELECT doc_id, first, last, row_number() OVER (PARTITION BY array_to_string(xs[first:last], chr(10)) ORDER BY doc_id, first) > 1 AS again
      FROM e JOIN t USING (doc_id) WHERE chars >= {MIN_CHARS}),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(first, last)) AS pos FROM r WHERE again),
k AS (SELECT l.doc_id, l.line, l.x, g.pos IS NOT NULL AS gone FROM l LEFT JOIN p USING (doc_id, line) LEFT JOIN g ON g.doc_id = p.doc_id AND g.pos = p.pos)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM k GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""

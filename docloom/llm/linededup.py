"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling, in DataFrame operations only.

A text is a sequence of lines (cut at \\n, compared without blanks at their ends, blank lines left out). Round 0 ranks the lines that
occur more than once; round r ranks the runs of 2**r lines by the pair of ranks of their halves: the distinct pairs are sorted over the
cluster and numbered in order, so ranks follow the order of suffixes cut off at 2**r lines, and the suffixes of one rank are the interval whose
longest common prefix is 2**r lines or more. A suffix that no other shares so far leaves the rounds.

A maximal repeated run is a longest run of lines that has occurred before, at a smaller (doc_id, line number). Each with at least ``min_chars``
characters is a later copy and its lines go, however many lines it has; repeats inside a text count as well. Such a run is the union of the least
stretches in it with ``min_chars`` characters, counted from each of its lines forward or back (a line with too few characters after it in
the run has enough before), and equal contents have equal stretches. So an interval is asked for at the depths of these
stretches only: a stretch of m lines, 2**r <= m < 2**(r+1), lies in the interval named by m, the rank of its first 2**r lines and that of its last
2**r. No line is empty, so m is at most ``min_chars`` and the rounds end by themselves; a longer run needs no further round, its
stretches cover it. Runs that are in no stretch leave the rounds too.

Hot lines: intervals are aggregated before the shuffle and never gathered; joins put one row per interval against the
occurrences, which the adaptive join splits. Lines are named by 128 bits of hash.

Defined results: a null text has no lines and stays null. Rows equal in doc_id and text are one document, all treated
alike. A null doc_id comes after all others. A document left without lines has the empty text. Blank lines stay. An empty table gives an empty
one. A very long text is split in the row and its lines are spread like others. Other columns pass through; names that begin with ``__`` are taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, table, text_key

MIN_CHARS = 80


def _doc(id_col: str, text_col: str):
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("k"))


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """A row per non-blank line: doc, at (its number among these), its name (a, b), its characters n, before (characters up to it) and the
    lines of its least stretches: ahead from it, and back from it where that is not the stretch ahead of another line."""
    lines = docs.where(F.col(text_col).isNotNull()).select(_doc(id_col, text_col).alias("doc"), F.split(text_col, "\n", -1).alias("lines"))
    full = F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    lines = lines.select("doc", F.posexplode(full).alias("at", "line"))
    rows = lines.select("doc", "at", F.length("line").alias("n"), F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))
    rows = rows.groupBy("doc", "at").agg(*[F.first(c).alias(c) for c in ("n", "a", "b")])  # rows equal in id and text are one document
    of = Window.partitionBy("doc")
    rows = rows.withColumn("upto", F.sum("n").over(of.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("upto") - F.col("n"))
    ahead, back = of.orderBy("before").rangeBetween(0, min_chars - 1), of.orderBy("upto").rangeBetween(1 - min_chars, 0)
    of_frame = lambda w: F.struct(F.count(F.lit(1)).over(w).cast("int").alias("m"), F.sum("n").over(w).alias("chars"))
    rows = rows.withColumn("x", of_frame(ahead)).withColumn("y", of_frame(back))
    m_ahead, m_back = F.when(F.col("x.chars") >= min_chars, F.col("x.m")), F.when(F.col("y.chars") - F.col("n") >= min_chars, F.col("y.m"))
    return rows.select("doc", "at", "n", "before", "a", "b", m_ahead.alias("ahead"), m_back.alias("back"))


def _rank(rows: DataFrame, carried: list[str], name: str) -> DataFrame:
    """The rows (doc, at, a, b, *carried) whose (a, b) is shared, with rank in place of (a, b) and first, the first occurrence's (doc, at)."""
    groups = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc", "at")).alias("first")).where("c > 1").drop("c")
    ranked = materialize(groups.orderBy("a", "b").withColumn("rank", F.monotonically_increasing_id()), f"{name}-ranks")
    out = materialize(rows.join(ranked.hint("merge"), ["a", "b"]).select("doc", "at", "rank", "first", *carried), name)
    discard(ranked)
    return out


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, removed): per document the numbers, among its non-blank lines and from 0, of those in later copies of repeated runs."""
    rows = materialize(_lines(docs, id_col, text_col, min_chars), "lines")
    suffixes = _rank(rows, ["n", "before", "ahead", "back"], "runs-1")
    discard(rows)
    ahead = suffixes.where("ahead > 1").select("doc", "at", F.col("ahead").alias("m"))
    back = suffixes.where("back > 1").select("doc", (F.col("at") - F.col("back") + 1).alias("at"), F.col("back").alias("m"))
    stretches = materialize(ahead.union(back), "stretches")
    here = F.struct("doc", "at")
    gone = [materialize(suffixes.where((F.col("ahead") == 1) & (here != F.col("first"))).select("doc", "at", F.lit(1).alias("m")), "gone")]
    active = suffixes.select("doc", "at", "rank", "before", F.col("n").alias("first_n"), F.col("n").alias("last_n"), (F.col("before") + F.col("n")).alias("upto"))
    run, held = 1, [suffixes]
    while stretches.where(F.col("m") >= run).limit(1).count():
        own = stretches.where((F.col("m") >= run) & (F.col("m") < 2 * run))
        head = own.join(active.select("doc", "at", F.col("rank").alias("a")).hint("merge"), ["doc", "at"])
        tail = active.select("doc", F.col("at").alias("end"), F.col("rank").alias("b")).hint("merge")
        named = materialize(head.withColumn("end", F.col("at") + F.col("m") - run).join(tail, ["doc", "end"]).select("doc", "at", "m", "a", "b"), "named")
        # written, so that the join below shuffles both sides itself: only such a join can be split where one interval has very many occurrences
        shared = materialize(named.groupBy("m", "a", "b").agg(F.min(here).alias("first"), F.max(here).alias("other")).where("first <> other").drop("other"), "shared")
        gone.append(materialize(named.join(shared.hint("merge"), ["m", "a", "b"]).where(here != F.col("first")).select("doc", "at", "m"), "gone"))
        discard(named, shared)
        left = active.select("doc", "at", "before", "first_n", F.col("rank").alias("a"))
        right = active.select("doc", (F.col("at") - run).alias("at"), "last_n", "upto", F.col("rank").alias("b"))
        # a run inside a stretch has too few characters without its first or without its last line
        pairs = left.join(right.hint("merge"), ["doc", "at"]).where(F.col("upto") - F.col("before") - F.greatest("first_n", "last_n") < min_chars)
        run *= 2
        active = _rank(pairs, ["before", "first_n", "last_n", "upto"], f"runs-{run}")
        discard(*held)
        held = [active]
    out = materialize(reduce(DataFrame.union, gone).select("doc", F.explode(F.sequence("at", F.col("at") + F.col("m") - 1)).alias("at")).groupBy("doc").agg(F.collect_set("at").alias("removed")), "removed-lines")
    discard(stretches, *gone, *held)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with ``__text`` (the lines that stay), ``__lines`` and ``__removed`` (numbers of lines)."""
    removed = repeated_lines(docs, id_col, text_col, min_chars).select(F.col("doc").alias("__doc"), F.col("removed").alias("__gone"))
    # merged whatever its size: the texts move once at any scale
    named = docs.withColumn("__doc", _doc(id_col, text_col)).join(removed.hint("merge"), "__doc", "left").withColumn("__all", F.split(text_col, "\n", -1))
    full = F.filter(F.transform("__all", lambda x, i: F.when(F.length(F.trim(x)) > 0, i)), lambda i: i.isNotNull())
    named = named.withColumn("__full", F.when(F.col("__gone").isNotNull(), full))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__all") - 1), F.transform("__gone", lambda o: F.get("__full", o)))
    kept = F.array_join(F.transform(stay, lambda i: F.get("__all", i)), "\n")
    return named.select(*[F.col(f"`{c}`") for c in docs.columns], F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept).alias("__text"), F.when(F.col(text_col).isNull(), 0).otherwise(F.size("__all")).alias("__lines"), F.coalesce(F.when(F.col("__gone").isNotNull(), F.size("__gone")), F.lit(0)).alias("__removed"))


def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_md5) of every document."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.md5(F.col("__text").cast("binary")).alias("kept_md5"))


#: A run counts if it has been seen before, at an earlier place; its least stretches of MIN_CHARS characters, forward and back, cover it.
OP4_SQL = f"""
WITH doc AS (SELECT DISTINCT doc_id, md5(coalesce(text, '')) AS k, text FROM documents),
l AS (SELECT doc_id, k, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, k, string_split(text, chr(10)) AS x FROM doc WHERE text IS NOT NULL)),
c AS (SELECT doc_id, k, pos, trim(line, ' ') AS line, length(trim(line, ' ')) AS n, sum(length(trim(line, ' '))) OVER (PARTITION BY doc_id, k ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto FROM l WHERE length(trim(line, ' ')) > 0),
s AS (SELECT a.doc_id, a.k, a.pos, max(b.pos) AS last, sum(b.n) AS chars, string_agg(b.line, chr(10) ORDER BY b.pos) AS name FROM c a JOIN c b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.k = b.k AND b.pos >= a.pos AND b.upto - b.n < a.upto - a.n + {MIN_CHARS} GROUP BY 1, 2, 3
  UNION SELECT a.doc_id, a.k, min(b.pos), a.pos, sum(b.n), string_agg(b.line, chr(10) ORDER BY b.pos) FROM c a JOIN c b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.k = b.k AND b.pos <= a.pos AND b.upto > a.upto - {MIN_CHARS} GROUP BY a.doc_id, a.k, a.pos),
g AS (SELECT doc_id, k, pos, last FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id NULLS LAST, k, pos) AS o FROM s WHERE chars >= {MIN_CHARS}) WHERE o > 1),
r AS (SELECT DISTINCT c.doc_id, c.k, c.pos FROM c JOIN g ON c.doc_id IS NOT DISTINCT FROM g.doc_id AND c.k = g.k AND c.pos BETWEEN g.pos AND g.last),
t AS (SELECT l.doc_id, l.k, count(*) AS n_lines, count(r.pos) AS n_removed, md5(coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE r.pos IS NULL), '')) AS kept_md5
  FROM l LEFT JOIN r ON l.doc_id IS NOT DISTINCT FROM r.doc_id AND l.k = r.k AND l.pos = r.pos GROUP BY 1, 2)
SELECT d.doc_id, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_removed, 0) AS n_removed, t.kept_md5
FROM documents d LEFT JOIN t ON d.doc_id IS NOT DISTINCT FROM t.doc_id AND md5(coalesce(d.text, '')) = t.k AND d.text IS NOT NULL
"""

"""Line deduplication with content-defined chunks, in DataFrame functions only.

A document's lines are hashed; a rolling hash over the last ``ROLL`` line hashes
ends a chunk where it is 0 modulo ``EVERY``, so an inserted or deleted line
moves no boundary further on.  Chunks of two or more lines that occur more than
once in the corpus are removed except for their first occurrence (least
document, then least position), after their bytes are compared.  A repeated
passage may be too short to hold a whole chunk or reach beyond the chunks inside
it, so windows of two lines that aren't blank can be treated in the same way.

Only hashes and positions of chunks are grouped; texts are dealt out by document
and, of chunks whose hash repeats, by hash.  Groups are counted by partial
aggregation and joined by keys that adaptive execution can split, so one chunk
may be in any share of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .learn import documents_text
from .tables import cut, table

EVERY, PRIME, BASE = 4, 2147483647, 1000003

_LINES = "split(text, '\\n', -1)"
_HASHES = f"transform({_LINES}, x -> cast(conv(substr(md5(cast(x as binary)), 1, 8), 16, 10) as bigint))"


def _chunks(every: int) -> str:
    """SQL: all chunks of ``text`` as (k, a, b, hash): number, first and last line (from 0), hash of the text."""
    roll = f"(((coalesce(get(h, i - 2), 0L) % {PRIME}) * {BASE} + coalesce(get(h, i - 1), 0L)) % {PRIME} * {BASE} + h[i]) % {PRIME} % {every} = 0"
    ends = f"transform(array({_HASHES}), h -> filter(sequence(0, size(h) - 1), i -> i = size(h) - 1 or {roll}))[0]"
    text = "xxhash64(array_join(slice(s.lines, a + 1, e - a + 1), '\\n'))"
    one = f"transform(array(if(k = 0, 0, s.ends[k - 1] + 1)), a -> named_struct('k', k, 'a', a, 'b', e, 'hash', if(e > a, {text}, 0L)))[0]"
    # each array() around a value binds it once for all elements
    return f"transform(array(named_struct('lines', {_LINES}, 'ends', {ends})), s -> transform(s.ends, (e, k) -> {one}))[0]"


def _windows() -> str:
    """SQL: (a, b, hash) of each line of ``text`` that isn't blank and the next such line, with the blank ones between."""
    at = "filter(sequence(0, size(lines) - 1), i -> trim(both ' \\t\\r' from lines[i]) <> '')"
    one = "named_struct('a', a, 'b', s.at[j + 1], 'hash', xxhash64(array_join(slice(s.lines, a + 1, s.at[j + 1] - a + 1), '\\n')))"
    bound = f"transform(array({_LINES}), lines -> named_struct('lines', lines, 'at', {at}))"
    return f"transform({bound}, s -> transform(slice(s.at, 1, greatest(size(s.at) - 1, 0)), (a, j) -> {one}))[0]"


def _merged(gone: DataFrame) -> DataFrame:
    """Ranges (doc_id, t, a, b), those of a document that touch or overlap made one."""
    each = Window.partitionBy("doc_id", "t").orderBy("a", "b")
    before = F.max("b").over(each.rowsBetween(Window.unboundedPreceding, -1))
    starts = gone.withColumn("new", F.coalesce(F.col("a") > before + 1, F.lit(True)).cast("int"))
    ranges = starts.withColumn("range", F.sum("new").over(each.rowsBetween(Window.unboundedPreceding, 0)))
    return ranges.groupBy("doc_id", "t", "range").agg(F.min("a").alias("a"), F.max("b").alias("b"))


def dedup_lines(documents: DataFrame, every: int = EVERY, whole: bool = False) -> DataFrame:
    """The rows of ``documents`` with repeated multi-line chunks cut from ``text``, and ``n_lines, n_chunks, n_removed``.

    Lines are parts between line feeds; a null text has none and stays null, an
    empty one has one.  Removed lines go with their line feed.  Rows with a null
    id are left as they are.  Each row has its own lines, also where ids repeat;
    only rows that repeat both id and text count as one document.  Of equal
    chunks the first in order of id, hash of the text and line stays.  ``whole``
    cuts every repeated passage of two or more lines that aren't blank, not only
    chunks; a repeat that overlaps its first occurrence stays.
    """
    key = ["doc_id", "t"]
    text = documents_text(documents).filter("doc_id is not null").withColumn("t", F.xxhash64("text"))
    pieces = f"transform(filter({_chunks(every)}, c -> c.b > c.a), c -> named_struct('a', c.a, 'b', c.b, 'hash', c.hash))"
    found = text.select(*key, F.expr(f"array_union({pieces}, {_windows()})" if whole else pieces).alias("pieces"))
    each = found.select(*key, F.explode("pieces").alias("c")).select(*key, "c.*")
    # what joins by hash is written before, so that both sides are exchanges whose hot keys adaptive execution can split
    often = cut(each.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"))
    each = cut(each.join(often, "hash"))
    first = cut(each.groupBy("hash").agg(F.min(F.struct(*key, "a", "b")).alias("first")))
    own = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.t") == F.col("t"))
    again = each.join(first, "hash").withColumn("is_first", own & (F.col("first.a") == F.col("a")))
    if whole:
        again = again.filter(F.col("is_first") | ~own | (F.col("first.b") < F.col("a")))
    wanted = again.groupBy(*key).agg(F.collect_set(F.struct("a", "b", "hash", "is_first")).alias("wanted"))
    # rows that repeat id and text are one document
    bodies = text.join(wanted, key).dropDuplicates(key).select(
        *key,
        F.explode(F.expr(f"transform(array({_LINES}), l -> transform(wanted, c -> named_struct('a', c.a, 'b', c.b, 'hash', c.hash, 'is_first', c.is_first, 'body', array_join(slice(l, c.a + 1, c.b - c.a + 1), '\\n'))))[0]")).alias("c"),
    ).select(*key, "c.*")
    firsts = bodies.filter("is_first").select("hash", F.col("body").alias("same"))
    gone = bodies.filter("not is_first").join(firsts, "hash").filter("body = same").select(*key, "a", "b")
    gone = _merged(gone) if whole else gone
    gone = gone.groupBy(F.col("doc_id").alias("__gone_id"), F.col("t").alias("__gone_t")).agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("__gone"))
    same = (documents["doc_id"].cast("long") == F.col("__gone_id")) & (F.xxhash64(documents["text"].cast("string")) == F.col("__gone_t"))
    joined = documents.join(gone, same, "left").drop("__gone_id", "__gone_t")
    kept = (
        f"transform(array({_LINES}), l -> array_join(flatten(transform(sequence(0, size(__gone)), j -> "
        "transform(array(if(j = 0, 0, __gone[j - 1].b + 1)), f -> slice(l, f + 1, if(j = size(__gone), size(l), get(__gone, j).a) - f))[0])), '\\n'))[0]"
    )
    removed = F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.expr("aggregate(__gone, 0, (s, g) -> s + g.b - g.a + 1)"))
    counts = {
        "n_lines": F.expr(f"if(text is null, 0, size({_LINES}))").cast("long"),
        "n_chunks": F.expr(f"if(text is null, 0, size({_chunks(every)}))").cast("long"),
        "n_removed": removed.cast("long"),
    }
    return joined.withColumns(counts | {"text": F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.expr(kept))}).drop("__gone")


def op1_lines(spark, sf_dir):
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), whole=True)
    return found.select("doc_id", "n_lines", "n_chunks", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Chunks and windows of two lines as strings; all but the first of equal ones go.
SQL = f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i, ls[i] AS line, CAST('0x' || substr(md5(ls[i]), 1, 8) AS BIGINT) AS h, len(ls) AS n FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
r AS (SELECT *, i = n OR (((coalesce(lag(h, 2) OVER w, 0) % {PRIME}) * {BASE} + coalesce(lag(h) OVER w, 0)) % {PRIME} * {BASE} + h) % {PRIME} % {EVERY} = 0 AS e FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(CAST(e AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM r),
t AS (SELECT doc_id, k, min(i) AS a, max(i) AS b FROM c GROUP BY doc_id, k),
w AS (SELECT doc_id, i AS a, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
p AS (SELECT DISTINCT doc_id, a, b, array_to_string(ls[a:b], chr(10)) AS body FROM (SELECT doc_id, a, b FROM t WHERE b > a UNION SELECT doc_id, a, b FROM w WHERE b IS NOT NULL) JOIN d USING (doc_id)),
f AS (SELECT body, doc_id AS fd, a AS fa, b AS fb FROM p QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, a, b) = 1),
g AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM p JOIN f USING (body) WHERE (doc_id <> fd OR a <> fa) AND (doc_id <> fd OR fb < a)),
m AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS kept FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_chunks, 0) AS BIGINT) AS n_chunks, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN m USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n_chunks FROM t GROUP BY doc_id) USING (doc_id)
"""

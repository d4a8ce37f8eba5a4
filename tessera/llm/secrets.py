"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds (assignments of secrets, access keys, hex strings) are matched per
text.  Weak parts (identifiers, long mixed strings, endpoints) are reported only
where complementary parts lie within one scope: spans of one document no more
than ``SCOPE`` code points apart.  Scopes are found by an interval join: parts
are put into bins of ``SCOPE`` code points and meet those of the same and the
neighbouring bins.  Parts have a least length and don't overlap within a kind,
so a bin holds a bounded number and the join is linear in the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learn import documents_text
from .tables import cut, table

#: Code points between linked parts, matches folded at a time.
SCOPE, FOLD = 200, 64

# Kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
WEAK = (
    ("ident", r"(?:A[GIRS][DIOPS]A[A-Z0-9]{12,}|(?:[Cc]lient_?[Ii][Dd]|[Uu]ser(?:name)?|[Ll]ogin|[Aa]ccess_?[Kk]ey(?:_?[Ii][Dd])?)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{4,})", 0, 8),
    ("opaque", r"[A-Za-z0-9+/_-]{24,}", 0, 24),
    ("endpoint", r"(?:https?|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp|ftp)://[A-Za-z0-9._~:@/-]{4,}", 0, 10),
)
KINDS = [kind for kind, *_ in (*BASE, *WEAK)]


def _spans(kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of all matches, leftmost and not overlapping, in code points; those with too short a group are dropped.

    The text between matches and the matches alternate, so running sums of
    their lengths give every start.
    """
    text, p = F.col("text"), F.lit(pattern)
    size = lambda c: F.transform(c, lambda x: F.char_length(x))
    between, whole = size(F.split(text, pattern, -1)), size(F.regexp_extract_all(text, p, F.lit(0)))
    part = size(F.regexp_extract_all(text, p, F.lit(group))) if group else whole
    each = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("gap"), whole.alias("size"), part.alias("part"))
    span = "array<struct<start:int,rank:int,end:int,kind:string>>"
    none, at = F.from_json(F.lit("[]"), span), F.lit(0)

    def step(s, m):
        start = s["at"] + m["gap"]
        found = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + m["size"]).alias("end"), F.lit(kind).alias("kind"))
        out = F.when(m["part"] >= least, F.concat(s["out"], F.array(found))).otherwise(s["out"])
        return F.struct((start + m["size"]).alias("at"), out.alias("out"))

    def block(s, b):
        """``FOLD`` matches at a time: what is appended to stays short, however many matches a text has."""
        own = F.struct(s["at"].alias("at"), none.alias("out"))
        return F.aggregate(F.slice(each, b * FOLD + 1, F.lit(FOLD)), own, step, lambda x: F.struct(x["at"].alias("at"), F.concat(s["outs"], F.array(x["out"])).alias("outs")))

    begin = F.struct(at.alias("at"), F.from_json(F.lit("[]"), f"array<{span}>").alias("outs"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / FOLD).cast("int"))
    # nothing to sum where there is no match
    return F.when(F.size(whole) > 0, F.aggregate(blocks, begin, block, lambda s: F.flatten(s["outs"]))).otherwise(none)


def _bins(start: Column, end: Column, reach: int) -> Column:
    return F.sequence(F.floor(start / SCOPE) - reach, F.floor((end - 1) / SCOPE) + reach)


def scan(documents: DataFrame) -> DataFrame:
    """``doc_id, base, spans``: arrays of (start, rank, end, kind), sorted by start, then kind in the order of ``KINDS``.

    ``base`` has the base kinds, ``spans`` also linked parts: a weak identifier
    or opaque string with a part of the other sort in its scope (base access keys
    count as identifiers, assignments as secrets), and an endpoint with both.
    A null text has no spans; rows without an id or with a repeated one are
    scanned like any other.
    """
    docs = documents_text(documents).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), *[_spans(*rule).alias(rule[0]) for rule in (*BASE, *WEAK)])
    found = cut(found)
    base = F.array_sort(F.concat(*[F.col(kind) for kind, *_ in BASE]))
    names, secrets = F.concat("access", "ident"), F.concat("assign", "opaque")
    parts = found.filter((F.size(names) > 0) & (F.size(secrets) > 0) & (F.size("ident") + F.size("opaque") + F.size("endpoint") > 0))
    parts = parts.dropDuplicates(["uid"])
    row = lambda kinds: parts.select("uid", F.explode(F.concat(*kinds)).alias("s"))
    left = lambda kinds: row(kinds).withColumn("bin", F.explode(_bins(F.col("s.start"), F.col("s.end"), 1)))
    right = lambda kinds: row(kinds).select("uid", F.col("s").alias("o"), F.explode(_bins(F.col("s.start"), F.col("s.end"), 0)).alias("bin"))
    near = (F.col("o.start") - F.col("s.end") <= SCOPE) & (F.col("s.start") - F.col("o.end") <= SCOPE)
    apart = (F.col("o.start") >= F.col("s.end")) | (F.col("s.start") >= F.col("o.end"))
    meet = lambda a, b: left(a).join(right(b), ["uid", "bin"]).filter(near & apart).select("uid", "s").distinct()
    linked = [
        meet(["ident"], ["assign", "opaque"]),
        meet(["opaque"], ["access", "ident"]),
        meet(["endpoint"], ["access", "ident"]).intersect(meet(["endpoint"], ["assign", "opaque"])),
    ]
    linked = reduce(DataFrame.union, linked).groupBy("uid").agg(F.collect_list("s").alias("linked"))
    out = found.select("doc_id", "uid", base.alias("base")).join(linked, "uid", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("linked", F.slice("base", 1, 0))))
    return out.select("doc_id", "base", spans.alias("spans"))


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secrets(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(kind) for kind, *_ in BASE], F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def _sql() -> str:
    """The same in SQL: per kind, pieces and matches side by side and a running sum of their lengths; links by plain comparison."""
    quoted = lambda p: p.replace("'", "''")
    parts = []
    for rank, (kind, pattern, group, least) in enumerate((*BASE, *WEAK)):
        parts.append(f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, e - m AS s, e FROM (
    SELECT doc_id, m, part, sum(g + m) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
      SELECT doc_id, i, length(gaps[i]) AS g, length(whole[i]) AS m, length(parts[i]) AS part FROM (
        SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (
          SELECT doc_id, string_split_regex(t, '{quoted(pattern)}') AS gaps, regexp_extract_all(t, '{quoted(pattern)}', 0) AS whole,
                 regexp_extract_all(t, '{quoted(pattern)}', {group}) AS parts FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))))) WHERE part >= {least}""")
    close = f"x.doc_id = y.doc_id AND y.s - x.e <= {SCOPE} AND x.s - y.e <= {SCOPE} AND (y.s >= x.e OR x.s >= y.e)"
    some = lambda kinds: f"EXISTS (SELECT 1 FROM p y WHERE {close} AND y.kind IN ({kinds}))"
    names, secrets = "'access', 'ident'", "'assign', 'opaque'"
    listed = "string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank)"
    return f"""
WITH p AS ({" UNION ALL ".join(parts)}),
k AS (SELECT * FROM p x WHERE rank < 3 OR (kind = 'ident' AND {some(secrets)}) OR (kind = 'opaque' AND {some(names)}) OR (kind = 'endpoint' AND {some(names)} AND {some(secrets)})),
b AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h, {listed} AS base FROM p WHERE rank < 3 GROUP BY doc_id),
f AS (SELECT doc_id, {listed} AS spans FROM k GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(c, 0) AS BIGINT) AS n_access, CAST(coalesce(h, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id)
"""


SQL = _sql()

"""MinHash near-duplicates by a chosen-path set similarity join.

Documents become sets of word shingles and 64 minwise tokens.  In each of
``TREES`` independent trees a node sends its documents to children by
``BRANCH`` minwise coordinates chosen by the node, a child being one value of
one coordinate.  With similarity s a pair stays together on one of b choices
with probability 1-(1-s p)^b, whose fixed point at s = 0.8, b = 2 is p = 0.94 at
any depth.  All trees draw from the same coordinates, so their misses go together:
averaged over how many coordinates agree, five trees miss a pair of similarity 0.8
with probability 1.2e-5 at depth 3 and 3.2e-5 at depth 8, closer ones less.  The first
``DEPTH`` levels are made at once; deeper ones only where needed.

* A node of at most ``SMALL`` documents is compared exhaustively.
* In a larger one every document is compared with the node's least one. Nodes
  whose documents all hang together then need nothing more; where that leaves
  ``WORK`` pairs or fewer, documents outside the main component are compared with
  all the node has, in blocks, sketches first and then the sets of those that are
  close to another component; else the node branches again, and at depth
  ``DEEPEST`` the rest is compared that way.

Candidates must pass a size bound (exact) and a sketch of two bits per
coordinate (whose loss at the threshold is about 1e-5) before sets are joined to
them and links are confirmed on full sets.  Documents with equal sets are one
class and travel as one.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, merged
from .learn import documents_text
from .tables import cut
from .words import Words, joined, lowered, mix, seeds, shingle_sets, slices

COORDINATES, TREES, BRANCH, DEPTH, DEEPEST, SMALL = 64, 5, 2, 2, 8, 40
#: Documents, and shingles of their sets, of a block of a large node; rows of sketches of a block.
GROUP, WORDS, BLOCK = 1500, 4_000_000, 4000
#: Pairs of a node (documents outside its main component times all) that are compared rather than branched on.
WORK = 20_000_000
#: Document ids that may be broadcast (8 bytes each), after they are counted.
BROADCAST = 500_000
#: Documents whose sets are gathered before they are written, so that few sets don't make a file for each piece of the corpus.
FEW = 20_000
#: Sketch bits of 128 that may differ: at similarity 0.8 12.8 do so on average (deviation 4.1).
SKETCH = 32


def _minwise(sets, n):
    """Matrix of least hashes (documents x coordinates) and a sketch of two other bits of each."""
    sig, sketch = np.zeros((len(sets), COORDINATES), dtype=np.uint32), np.zeros((2, len(sets)), dtype=np.uint64)
    full = np.flatnonzero(n > 0)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        starts = np.concatenate(([0], np.cumsum(n[full])[:-1]))
        for k, factor in enumerate(seeds(COORDINATES, 51)):
            low = np.minimum.reduceat(mix_cheap(flat, factor), starts)
            low = mix(low + np.uint64(k))
            sig[full, k] = (low >> np.uint64(32)).astype(np.uint32)
            for i in range(2):
                sketch[i, full] |= ((low >> np.uint64(7 + i)) & np.uint64(1)) << np.uint64(k)
    return sig, sketch


def mix_cheap(x, factor):
    x = x * factor
    return x ^ (x >> np.uint64(29))


def _signatures(n_words):
    def run(batches):
        for piece in slices(batches):
            buffer, offsets = joined(piece.column("text"))
            sets, n = shingle_sets(Words(lowered(buffer), offsets, "spaced"), n_words)
            sig, sketch = _minwise(sets, n)
            names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array([r.tobytes() for r in sig], pa.binary()), *(pa.array(x.view(np.int64)) for x in sketch)],
                names=["doc_id", "n", "name", "sig", "s0", "s1"],
            )

    return run


def children(node, sig, level):
    """Keys of the ``BRANCH`` children that each document's node sends it to."""
    out, last = [], None
    for k in range(BRANCH):
        pick = (mix(node + np.uint64(1000 * level + k + 1)) % np.uint64(COORDINATES - k)).astype(np.int64)
        pick = pick if last is None else (last + 1 + pick) % COORDINATES
        out.append(mix(node * np.uint64(0x9E3779B97F4A7C15) + pick.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + sig[np.arange(len(sig)), pick].astype(np.uint64)))
        last = pick
    return out


def _matrix(batch):
    return np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)


def _first_levels(batches):
    for batch in batches:
        for at in range(0, len(batch), 4000):
            piece = batch.slice(at, 4000)
            sig = _matrix(piece)
            nodes = [np.full(len(sig), np.uint64(t + 1)) for t in range(TREES)]
            for level in range(DEPTH):
                nodes = [child for node in nodes for child in children(node, sig, level)]
            yield _rows(piece, np.concatenate(nodes), len(nodes))


def _rows(piece, node, times):
    columns = [np.tile(np.asarray(piece.column(c)), times) for c in MEMBER]
    return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *map(pa.array, columns)], names=["node", *MEMBER])


def _next_level(level):
    def run(batches):
        for batch in batches:
            if len(batch):
                made = children(np.asarray(batch.column("node")).view(np.uint64), _matrix(batch), level)
                yield _rows(batch, np.concatenate(made), BRANCH)

    return run


ROW = "node long, doc long, n long, s0 long, s1 long"
MEMBER = ("doc", "n", "s0", "s1")


def _close(a: str, b: str) -> str:
    """SQL: the exact size bound and the sketch bound of a pair."""
    bits = f"bit_count({a}.s0 ^ {b}.s0) + bit_count({a}.s1 ^ {b}.s1) <= {SKETCH}"
    return f"{bits} and least({a}.n, {b}.n) * 100 >= greatest({a}.n, {b}.n) * 80"


def _pairs(frame):
    return frame.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"))


def _nodes(rows: DataFrame) -> DataFrame:
    """Size and least document of each node that has two or more."""
    least = [F.min("doc").alias("doc"), *[F.min_by(c, "doc").alias(c) for c in MEMBER[1:]]]
    return rows.groupBy("node").agg(F.count("*").alias("size"), *least).filter("size > 1").select("node", "size", F.struct(*MEMBER).alias("y"))


def _shared(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of nodes with two or more documents, with the node's size and least document."""
    return cut(rows.select("node", *MEMBER).join(nodes, "node"))


def _candidates(found: DataFrame) -> DataFrame:
    """Pairs of small nodes, and each document of a larger one with its least document."""
    found = found.select("node", "size", F.struct(*MEMBER).alias("x"), "y")
    star = _pairs(found.filter("x.doc <> y.doc").filter(_close("x", "y")))
    lists = found.filter((F.col("size") > 2) & (F.col("size") <= SMALL)).groupBy("node").agg(F.sort_array(F.collect_list("x")).alias("all"))
    each = F.expr(f"flatten(transform(all, (x, i) -> transform(filter(slice(all, i + 2, {SMALL}), y -> {_close('x', 'y')}), y -> struct(x.doc as a, y.doc as b))))")
    return star.union(lists.select(F.explode(each).alias("p")).select("p.a", "p.b")).distinct()


def _sets(n_words):
    def run(batches):
        for piece in slices(batches):
            buffer, offsets = joined(piece.column("text"))
            sets, _ = shingle_sets(Words(lowered(buffer), offsets, "spaced"), n_words)
            ends = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))), pa.int32())
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([piece.column("doc"), pa.ListArray.from_arrays(ends, pa.array(flat))], names=["doc", "words"])

    return run


def _links(docs: DataFrame, pairs: DataFrame, n_words: int, threshold: int) -> DataFrame:
    """Links among the candidate pairs, by full sets: a pair is a row, so adaptive execution can split the pairs of one document."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    sets = cut(_wanted_sets(docs, wanted, n_words))
    side = lambda n: sets.select(F.col("doc").alias(n), F.col("words").alias(f"w{n}"))
    common = F.size(F.array_intersect("wa", "wb"))
    found = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * common >= threshold * (F.size("wa") + F.size("wb") - common))
    return cut(found.select("a", "b").repartition("a", "b").distinct())


def near_duplicates(documents: DataFrame, n_words: int = 5, threshold: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each document.

    Documents are linked when the Jaccard similarity of their sets of
    ``n_words``-word shingles is at least ``threshold`` percent.  A text of fewer
    words is its whole sequence; null or empty texts have an empty set and are
    linked with nothing.  ``component_id`` is the least id reachable, ``kept``
    whether it is the document's own.  Rows that repeat an id are one document
    with several texts: each row has its own set, what is linked with one is in
    the component of all.  A null id is left as it is, unlinked, with a null
    component.  Whole texts count, however long.  The bounds before the
    confirmation hold for ``threshold`` of 80 or more; a lower one is an error.
    """
    if threshold < 80:
        raise ValueError(f"threshold must be at least 80: {threshold}")
    docs = documents_text(documents)
    signed = cut(docs.mapInArrow(_signatures(n_words), "doc_id long, n long, name binary, sig binary, s0 long, s1 long"))
    full = signed.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = cut(full.groupBy("name").agg(F.min("doc_id").alias("doc"), *[F.first(c).alias(c) for c in ("n", "s0", "s1", "sig")]))
    rows = classes.select(*MEMBER, "sig").mapInArrow(_first_levels, ROW)
    found = _shared(rows, cut(_nodes(rows)))
    pairs = cut(_candidates(found))
    groups = cut(components(_links(docs, pairs, n_words, threshold).union(_same_document(full, classes))))
    for level in range(DEPTH, DEEPEST + 1):
        again, stuck = _unsettled(found.filter(F.col("size") > SMALL).select("node", *MEMBER), groups, level == DEEPEST)
        stuck = cut(_across(stuck))
        more, links = None, []
        if not stuck.isEmpty():
            links.append(_exhaustive(docs, stuck, n_words, threshold))
        if level < DEEPEST:
            sigs = again.join(classes.select("doc", "sig"), "doc").select("node", *MEMBER, "sig")
            rows = cut(sigs.mapInArrow(_next_level(level), ROW))
            if not rows.isEmpty():
                found = _shared(rows, cut(_nodes(rows)))
                more = cut(_candidates(found).join(pairs, ["a", "b"], "left_anti"))
                pairs = pairs.union(more)
                links.append(_links(docs, more, n_words, threshold))
        if links:
            groups = cut(merged(groups, reduce(DataFrame.union, links)))
        if more is None:
            break
    top = classes.join(groups, classes["doc"] == groups["node"], "left").select("name", F.coalesce("component", "doc").alias("component"))
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    found = signed.select("doc_id", "n", F.when(linked, F.col("name")).alias("name")).join(top, "name", "left")
    component = F.coalesce("component", "doc_id")
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def _same_document(full: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between an id that has several sets and the least documents of those."""
    several = full.groupBy("doc_id").agg(F.min("name").alias("x"), F.max("name").alias("y")).filter("x <> y").select("doc_id")
    found = full.select("doc_id", "name").join(several, "doc_id", "left_semi").join(classes.select("name", "doc"), "name")
    return found.select(F.col("doc_id").alias("a"), F.col("doc").alias("b")).filter("a <> b").distinct()


def _unsettled(rows: DataFrame, groups: DataFrame, last: bool) -> tuple[DataFrame, DataFrame]:
    """Rows of large nodes that must branch again, and those that end here, with ``component``, ``apart`` and the numbers of blocks.

    ``apart`` marks documents outside the node's main component: every pair that
    could still join two components has one of them.
    """
    large = rows.join(groups.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    large = cut(large)
    parts = large.groupBy("node", "component").agg(F.count("*").alias("part"))
    ends = parts.groupBy("node").agg(F.min("component").alias("main"), F.max("component").alias("other"), F.sum("part").alias("size"), F.min_by("part", "component").alias("part"))
    away = F.col("size") - F.col("part")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    ends = ends.filter("main < other").select("node", "main", (away * F.col("size")).alias("work"), blocks(F.col("size")).alias("all"), blocks(away).alias("some"))
    large = large.join(ends, "node").withColumn("apart", F.col("component") != F.col("main"))
    stop = F.lit(True) if last else F.col("work") <= WORK
    return large.filter(~stop).select("node", *MEMBER), large.filter(stop).select("node", *MEMBER, "component", "apart", "all", "some")


def _meet(pdf):
    """Documents of either side that are close, by size and sketch, to one of the other side's in another component."""
    left, right = ([x[c].to_numpy() for c in ("n", "s0", "s1", "component")] for x in (pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]))
    found = [np.zeros(len(x[0]), dtype=bool) for x in (left, right)]
    for at in range(0, len(left[0]), 500):
        n, s0, s1, component = (x[at : at + 500, None] for x in left)
        close = np.bitwise_count((s0 ^ right[1]).view(np.uint64)) + np.bitwise_count((s1 ^ right[2]).view(np.uint64)) <= SKETCH
        close &= (np.minimum(n, right[0]) * 100 >= np.maximum(n, right[0]) * 80) & (component != right[3])
        found[0][at : at + 500] |= close.any(1)
        found[1] |= close.any(0)
    return pd.concat([x.loc[f, ["node", "doc", "apart"]] for x, f in zip((pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]), found, strict=True)])


def _across(stuck: DataFrame) -> DataFrame:
    """(node, doc, apart) of the stuck nodes' documents that are close to one in another component: only those need their sets.

    Documents set apart meet all of their node in blocks of ``BLOCK`` short rows.
    """
    block = lambda n: F.pmod(F.xxhash64("doc", F.lit(5)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = ["node", *MEMBER, "component", "apart"]
    left = stuck.filter("apart").select(*names, F.lit(0).alias("side"), block("some").alias("i"), every("all").alias("j"))
    right = stuck.select(*names, F.lit(1).alias("side"), block("all").alias("j"), every("some").alias("i"))
    tasks = left.unionByName(right).withColumn("task", F.xxhash64("node", "i", "j"))
    return tasks.groupBy("node", "task").applyInPandas(_meet, "node long, doc long, apart boolean").distinct()


def _exhaust(threshold: int):
    """All pairs of a block of set-apart documents and a block of all; of the links a spanning forest, which keeps components."""

    def run(pdf):
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sides, common = [], np.zeros((len(left), len(right)), dtype=np.int32)
        for part in (left, right):
            sets = [np.asarray(w, dtype=np.int64) for w in part["words"]]
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            order = np.argsort(flat, kind="stable")
            value, start = np.unique(flat[order], return_index=True)
            sides.append((value, np.append(start, len(flat)), owner[order], np.array([len(x) for x in sets])))
        (v, vs, vo, vn), (w, ws, wo, wn) = sides
        for i, j in zip(*np.intersect1d(v, w, return_indices=True)[1:], strict=True):
            common[np.ix_(vo[vs[i] : vs[i + 1]], wo[ws[j] : ws[j + 1]])] += 1
        x, y = np.nonzero(100 * common >= threshold * (vn[:, None] + wn - common))
        parent, out = {}, []

        def find(d):
            while parent.setdefault(d, d) != d:
                parent[d] = parent[parent[d]]
                d = parent[d]
            return d

        for a, b in zip(left["doc"].to_numpy()[x].tolist(), right["doc"].to_numpy()[y].tolist(), strict=True):
            one, two = find(a), find(b)
            if one != two:
                parent[max(one, two)] = min(one, two)
                out.append((min(a, b), max(a, b)))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _exhaustive(docs: DataFrame, stuck: DataFrame, n_words: int, threshold: int) -> DataFrame:
    """Links that join components within the stuck nodes: blocks of about ``GROUP`` documents or ``WORDS`` shingles meet in tasks of bounded size, and no pair is listed that isn't a link.

    Nodes that share documents form one group, so a pair is compared once however many nodes hold it.
    """
    stars = stuck.groupBy("node").agg(F.min("doc").alias("b"))
    groups = components(stuck.join(stars, "node").select(F.col("doc").alias("a"), "b")).withColumnRenamed("node", "doc")
    members = cut(groups.join(stuck.groupBy("doc").agg(F.bool_or("apart").alias("apart")), "doc"))
    members = cut(members.join(_wanted_sets(docs, members.select("doc"), n_words), "doc"))
    blocks = lambda n, words: F.greatest(F.ceil(n / GROUP), F.ceil(words / WORDS)).cast("int")
    here, n = F.col("apart"), F.size("words").cast("long")
    sizes = members.groupBy("component").agg(blocks(F.count("*"), F.sum(n)).alias("all"), blocks(F.count_if(here), F.sum(F.when(here, n).otherwise(0))).alias("some"))
    members = members.join(sizes, "component")
    block = lambda n: F.pmod(F.xxhash64("doc", F.lit(3)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.filter("apart").select("doc", "words", "component", F.lit(0).alias("side"), block("some").alias("i"), every("all").alias("j"))
    right = members.select("doc", "words", "component", F.lit(1).alias("side"), block("all").alias("j"), every("some").alias("i"))
    tasks = left.unionByName(right).select("doc", "words", "side", F.xxhash64("component", "i", "j").alias("task"))
    return cut(tasks.groupBy("task").applyInPandas(_exhaust(threshold), "a long, b long").distinct())


def _wanted_sets(docs: DataFrame, wanted: DataFrame, n_words: int) -> DataFrame:
    """Sets of the wanted documents. Their ids are broadcast where a count shows that they are few enough; otherwise texts are dealt out by id."""
    wanted = wanted.distinct()
    n = wanted.count()
    wanted = F.broadcast(wanted) if n <= BROADCAST else wanted
    texts = docs.withColumnRenamed("doc_id", "doc").join(wanted, "doc", "left_semi")
    sets = texts.mapInArrow(_sets(n_words), "doc long, words array<long>")
    return sets.repartition("doc") if n <= FEW else sets


def op2_near(spark, sf_dir):
    from .tables import table

    return near_duplicates(table(spark, sf_dir, "documents"), n_words=2)

"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors are normalised and rotated by a fixed random rotation, then split into
blocks of ``DIMS`` coordinates.  A cosine of ``c`` is a squared distance of
2-2c; of two vectors that close, at least one block holds no more than its share
of that budget.  In each block a grid over its first coordinates, whose cells
are as wide as the block's distance, makes the range join an equi-join of
neighbouring cells.  Candidates of any block are confirmed on the given vectors
in double precision.  The join loses nothing: the budget is widened by a margin
far above rounding.

Equal vectors are one class and are compared once; a cell with many vectors is
cut into blocks of ``CELL``, and pairs of blocks are separate tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import cut, table

DIMS, CELL, AXES, COSINE, MARGIN = 16, 4000, 2, 0.9, 1e-5
#: Rows of either side whose distances are made at once.
TILE = 256, 1024


def rotation(width: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    turn, upper = np.linalg.qr(np.random.default_rng(23).normal(size=(width, width)))
    return turn * np.sign(np.diag(upper))


def spans(width: int) -> list[tuple[int, int]]:
    """Coordinates of each block: as even as can be, ``DIMS`` at most."""
    parts = max(1, math.ceil(width / DIMS))
    edges = np.linspace(0, width, parts + 1).round().astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def forward(axes: int):
    """Half of a cell's neighbours, itself first: each pair of neighbouring cells meets in exactly one."""
    grid = np.stack(np.meshgrid(*[np.arange(-1, 2)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
    return [g for g in map(tuple, grid.tolist()) if g >= (0,) * axes]


def _blocks(width: int, cosine: float):
    turn, parts = rotation(width), spans(width)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            lists = batch.column("unit")
            unit = np.asarray(lists.flatten()).reshape(-1, width)
            turned = unit @ turn
            for k, (a, b) in enumerate(parts):
                reach = math.sqrt((2 - 2 * cosine) * (b - a) / width + MARGIN)
                axes = min(AXES, b - a)
                cell = np.floor(turned[:, a : a + axes] / reach).astype(np.int64)
                cell = np.pad(cell, ((0, 0), (0, AXES - axes)))
                part = np.ascontiguousarray(turned[:, a:b].astype(np.float32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("class"), pa.array(np.full(len(unit), k), pa.int32()), *(pa.array(cell[:, i]) for i in range(AXES)), pa.array([r.tobytes() for r in part], pa.binary())],
                    names=["class", "block", "c0", "c1", "part"],
                )

    return run


def _meet(width: int, cosine: float):
    parts = spans(width)

    def run(key, pdf):
        block = int(pdf["block"].iloc[0])
        a, b = parts[block]
        budget = (2 - 2 * cosine) * (b - a) / width + MARGIN
        values = np.frombuffer(b"".join(pdf["part"]), dtype=np.float32).reshape(len(pdf), -1)
        own, ids = pdf["side"].to_numpy() == 0, pdf["class"].to_numpy()
        inner = own & pdf["inner"].to_numpy()
        # the squared distance |x|^2 - 2xy + |y|^2 as one product, by tiles that stay in a core's cache
        square, one = (values.astype(np.float64) ** 2).sum(1).astype(np.float32)[:, None], np.ones((len(values), 1), np.float32)
        left, right, mine = np.hstack((-2 * values, square, one))[own], np.hstack((values, one, square)), ids[own]
        found = [np.empty((2, 0), np.int64)]
        for start in range(0, len(right) if len(left) else 0, TILE[1]):
            turned = np.ascontiguousarray(right[start : start + TILE[1]].T)
            for at in range(0, len(left), TILE[0]):
                close = left[at : at + TILE[0]] @ turned <= budget
                if not close.any():
                    continue
                i, j = np.divmod(np.flatnonzero(close), close.shape[1])
                x, y, j = mine[at + i], ids[start + j], start + j
                # within a cell's own block both orders meet: keep one
                both = own[j] & inner[j]
                good = (x != y) & (~both | (x < y))
                found.append(np.stack((np.minimum(x, y)[good], np.maximum(x, y)[good])))
        pairs = np.hstack(found)
        return pd.DataFrame({"a": pairs[0], "b": pairs[1]})

    return run


def _pairs(units: DataFrame, width: int, cosine: float) -> DataFrame:
    """Pairs of classes within the budget in some block."""
    rows = units.select("class", "unit").mapInArrow(_blocks(width, cosine), "class long, block int, c0 long, c1 long, part binary")
    cells = rows.groupBy("block", "c0", "c1").agg(F.count("*").alias("size"))
    most = cut(cells).agg(F.max("size")).first()[0] or 0
    chunks = max(1, math.ceil(most / CELL))
    neighbours = F.array(*[F.struct(*[F.lit(x).alias(f"d{i}") for i, x in enumerate(g)]) for g in forward(AXES)])
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("class", F.lit(7)), F.lit(chunks)).cast("int")).withColumn("g", F.explode(neighbours))
    at = [(F.col(f"c{i}") + F.col(f"g.d{i}")).alias(f"c{i}") for i in range(AXES)]
    inner = F.forall(F.array("g.d0", "g.d1"), lambda x: x == 0)
    # a cell's blocks i meet blocks j of the same cell (i <= j) and of the neighbours before it (all j)
    every = F.sequence(F.lit(0), F.lit(chunks - 1))
    rows = rows.select("class", "block", *at, "part", "chunk", inner.alias("inner"))
    own = rows.filter("inner").withColumn("i", F.col("chunk")).withColumn("j", F.explode(every)).withColumn("side", F.lit(0))
    other = rows.withColumn("j", F.col("chunk")).withColumn("i", F.explode(every)).withColumn("side", F.lit(1))
    other = other.filter(~F.col("inner") | (F.col("i") < F.col("j")))
    tasks = own.unionByName(other).select("class", "block", "part", "inner", "side", F.xxhash64("block", "c0", "c1", "i", "j").alias("task"))
    return tasks.groupBy("task").applyInPandas(_meet(width, cosine), "a long, b long").distinct()


def _dot(x: str, y: str):
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row.

    Rows are linked when their vectors' cosine is at least ``cosine``.  Null,
    empty and zero vectors, and those with null or non-finite components, are
    linked with nothing; so are vectors of different lengths.  ``n_links`` counts
    the rows linked directly, equal vectors included.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    norm = F.sqrt(_dot("v", "v"))
    fit = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = cut(rows.withColumn("good", F.coalesce(fit & (F.size("v") > 0) & F.col("vec_id").isNotNull(), F.lit(False))).withColumn("norm", F.when(F.col("good"), norm)).withColumn("good", F.col("good") & (F.coalesce("norm", F.lit(0.0)) > 0) & (F.coalesce("norm", F.lit(0.0)) < float("inf"))))
    classes = rows.filter("good").groupBy("v").agg(F.min("vec_id").alias("class"), F.count("*").alias("copies"), F.first("norm").alias("norm"))
    classes = cut(classes.withColumn("unit", F.transform("v", lambda x: x / F.col("norm"))).withColumn("width", F.size("v")))
    pairs = None
    for width in sorted(r["width"] for r in classes.select("width").distinct().collect()):
        one = _pairs(classes.filter(F.col("width") == width), width, cosine)
        pairs = one if pairs is None else pairs.union(one)
    if pairs is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    side = lambda n: classes.select(F.col("class").alias(n), F.col("v").alias(f"v{n}"), F.col("norm").alias(f"n{n}"), F.col("copies").alias(f"k{n}"))
    links = pairs.join(side("a"), "a").join(side("b"), "b").filter(_dot("va", "vb") / (F.col("na") * F.col("nb")) >= cosine).select("a", "b", "ka", "kb")
    links = cut(links)
    degree = links.select(F.col("a").alias("class"), F.col("kb").alias("n")).union(links.select("b", "ka")).groupBy("class").agg(F.sum("n").alias("n"))
    groups = components(links).withColumnRenamed("node", "class")
    known = classes.select("v", "class", "copies").join(degree, "class", "left").join(groups, "class", "left")
    known = known.select(F.col("v"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "class").alias("component"))
    found = rows.select("vec_id", F.when(F.col("good"), F.col("v")).alias("v")).join(known, "v", "left")
    component = F.coalesce("component", "vec_id")
    return found.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op9_vectors(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
g AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.vec_id <> y.vec_id AND x.n > 0 AND y.n > 0
      AND list_dot_product(x.v, y.v) / (x.n * y.n) >= 0.9),
r AS (SELECT vec_id AS node, vec_id AS reach FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node),
d AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = node LEFT JOIN d ON vec_id = a
"""

"""Embedding near-duplicates by int8 tile products with error bounds.

Equal vectors of a label become one class with a count. The classes of a label
are dealt into chunks, and every pair of chunks is a tile of bounded size. In a
tile each unit vector x is written as s q + d, q of int8; the product of two is
s s' q q' with an error of at most |d| |s'q'| + |sq| |d'| + |d| |d'|. Only pairs
whose product plus that bound reaches the threshold are computed again in double
precision. A tile returns for each class how many vectors it links with and the
smallest member of its piece of the link graph, never the pairs.

Every pair of a label must be looked at by some tile (an exact threshold has no
shorter way in general); tiles of one label are independent tasks.

Cases: vectors that are null, empty, zero, or hold nulls, NaN or infinities, and
rows without a label or vec_id link with nothing and are kept; vectors of
different length don't link; repeated rows count as further vectors; an empty
table gives no rows; columns other than vec_id, embedding and label are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.llm.components import connected_components
from kinspan.llm.staging import staged

CHUNK = 512
FOUND = "rep long, links long, low long"


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the decoded vectors, and norms of what the codes lose."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    decoded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(decoded, axis=1), np.linalg.norm(unit - decoded, axis=1)


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y have a cosine of at least the threshold.

    Rows are scaled by a power of two first, so that no norm leaves the range of
    doubles; that changes no digit of a cosine.
    """
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None]) for v in (x, y))
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    (qx, sx, ax, dx), (qy, sy, ay, dy) = quantised(x / nx[:, None]), quantised(y / ny[:, None])
    kind = np.float32 if x.shape[1] * 127 * 127 < 2**24 else np.float64  # whole numbers stay exact
    product = (qx.astype(kind) @ qy.astype(kind).T).astype(np.float64) * sx[:, None] * sy[None, :]
    bound = dx[:, None] * ay[None, :] + ax[:, None] * dy[None, :] + dx[:, None] * dy[None, :]
    i, j = np.nonzero(product + bound + 1e-9 >= threshold)
    out = np.zeros((len(x), len(y)), bool)
    for a in range(0, len(i), 65_536):
        p, q = i[a : a + 65_536], j[a : a + 65_536]
        out[p, q] = np.einsum("ij,ij->i", x[p], y[q]) / (nx[p] * ny[q]) >= threshold
    return out


def tile_links(key: tuple, part: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one tile: rows of chunk ``left`` with rows of chunk ``right`` of a label."""
    _, _, left, right = key
    rows, columns = part[part["chunk"] == left], part[part["chunk"] == right]
    if not len(rows) or not len(columns):
        return pd.DataFrame({"rep": [], "links": [], "low": []}).astype("int64")
    hit = linked(np.array(rows["embedding"].tolist(), np.float64), np.array(columns["embedding"].tolist(), np.float64), threshold)
    a, b = rows["rep"].to_numpy(), columns["rep"].to_numpy()
    if left == right:
        np.fill_diagonal(hit, False)
    low_a, low_b = a.copy(), b.copy()
    while True:
        far = np.iinfo(np.int64).max
        new_a = np.minimum(low_a, np.where(hit, low_b[None, :], far).min(axis=1))
        if left == right:
            new_b = new_a
        else:
            new_b = np.minimum(low_b, np.where(hit, new_a[:, None], far).min(axis=0))
        if (new_a == low_a).all() and (new_b == low_b).all():
            break
        low_a, low_b = new_a, new_b
    links_a = hit @ columns["copies"].to_numpy()
    out = pd.DataFrame({"rep": a, "links": links_a, "low": low_a})
    if left != right:
        out = pd.concat([out, pd.DataFrame({"rep": b, "links": hit.T @ rows["copies"].to_numpy(), "low": low_b})])
    return out[out["links"] > 0].astype("int64")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & good, F.lit(False))
    classes = rows.where(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = staged(classes.withColumn("width", F.size("embedding")), "classes")
    sizes = classes.groupBy("label", "width").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = classes.join(sizes, ["label", "width"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = tiles.select("label", "width", F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right"), "chunk", "rep", "copies", "embedding")
    found = tiles.groupBy("label", "width", "left", "right").applyInPandas(lambda key, part: tile_links(key, part, threshold), FOUND)
    found = staged(found, "tile-links")
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    counted = found.groupBy("rep").agg(F.sum("links").alias("links")).join(components, F.col("rep") == F.col("id"), "left")
    known = classes.join(counted.select("rep", "links", "component"), "rep", "left")
    known = known.select("label", "embedding", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked_rows = rows.where(usable).join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    others = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked_rows.union(others)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_embedding_dedup(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)


ORACLE = """
WITH usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
walk AS (
  WITH RECURSIVE reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
  SELECT a, min(b) AS low FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(low, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN walk w ON w.a = e.vec_id
"""

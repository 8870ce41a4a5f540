"""Centroid clustering of integer vectors by popcounts over bit planes.

A vector of 64 integers is kept as its bit planes: plane ``i`` packs bit ``i`` of all 64 components into one
uint64, and the last plane holds the signs (two's complement), so plane ``i`` weighs ``2**i`` and the last one
``-2**(width - 1)``. Then

    x . c = sum over planes i of x and j of c of weight(i) * weight(j) * popcount(x_i & c_j)

is exact, and so are norms and squared distances. Sums of vectors are counts of set bits per plane and
component, so they are exact however many vectors and however wide the numbers are.

The vectors are packed once and written; each round is one pass over the planes. A task sends the bit counts of
its vectors per cluster (clusters x planes x 64 numbers, whatever it read), and the driver sees their totals.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendery.llm.common import bound_batches, record_batch, sha256, table
from mendery.session import settle_table

COMPONENTS = 64
SCALE = 64
_SAFE_BITS = 62  # sums of products that need more are computed with Python's integers, to the same result
_LONGEST = 2**63 - 1


@dataclass(frozen=True)
class Clustering:
    centroids: int = 16
    rounds: int = 3
    salt: str = "1"


# ---------------------------------------------------------------------------------- planes


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Planes (rows, width) of integers (rows, 64) that fit into ``width`` bits with their sign."""
    out = np.empty((len(values), width), np.uint64)
    for i in range(width):
        bits = ((values >> i) & 1).astype(np.uint8)
        out[:, i] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def width_of(values: np.ndarray) -> np.ndarray:
    """Bits that each row needs, its sign included."""
    most = np.where(values >= 0, values, ~values).max(axis=1)
    return np.array([int(m).bit_length() + 1 for m in most.tolist()], np.int64)


def weights(width: int, other: int) -> np.ndarray:
    """Weight of each plane, in a type that holds the products with ``other`` planes."""
    kind = np.int64 if width + other + 8 <= _SAFE_BITS else object
    return np.array([2**i for i in range(width - 1)] + [-(2 ** (width - 1))], kind)


def dots(planes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Dot product of every row with one vector of planes: weighted popcounts."""
    n, m = planes.shape[1], other.shape[-1]
    common = np.bitwise_count(planes[:, :, None] & other[..., None, :])
    by_plane = common.astype(np.int64).astype(weights(n, m).dtype) @ weights(m, n)
    return by_plane @ weights(n, m)


def norms(planes: np.ndarray) -> np.ndarray:
    return dots(planes, planes)


def quantised(components: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles, as int64 or, where that is too narrow, Python's integers."""
    scaled = np.floor(components * SCALE)
    if np.abs(scaled).max(initial=0.0) < 2.0**62:
        return scaled.astype(np.int64)
    return np.array([[int(v) for v in row] for row in scaled], object)


def whole(planes: np.ndarray) -> list[int]:
    """The 64 integers of one vector's planes."""
    bits = np.unpackbits(planes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return [sum(int(w) * int(b) for w, b in zip(weights(len(planes), _SAFE_BITS), column, strict=True)) for column in bits.T]


class Centroids:
    """Centroids as planes of one common width."""

    def __init__(self, vectors: list[list[int]]):
        values = np.array(vectors, object)
        if max(abs(v) for row in vectors for v in row) < 2**62:
            values = values.astype(np.int64)
        self.planes = pack(values, int(width_of(values).max()))
        self.norms = [int(v) for v in norms(self.planes)]

    def nearest(self, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row (ties: the smallest) and the squared distance."""
        widest = max(planes.shape[1], self.planes.shape[1])
        kind = weights(widest, widest).dtype
        own = norms(planes).astype(kind)
        distances = np.stack([own + norm - 2 * dots(planes, c).astype(kind) for c, norm in zip(self.planes, self.norms, strict=True)])
        best = distances.argmin(axis=0)
        return best, distances[best, np.arange(len(planes))]


# ---------------------------------------------------------------------------------- Spark


def packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, planes): the vectors with 64 finite components, as bytes of eight per plane."""
    scaled = lambda x: F.abs(x.cast("double") * SCALE)
    kept = vectors.filter(
        (F.size("embedding") == COMPONENTS)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (scaled(x) < float("inf")))
    ).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    bound_batches(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("vec_id", batch_type), ("planes", pa.binary())])
        for batch in batches:
            values = quantised(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, COMPONENTS))
            ids = np.array(batch.column(0).to_pylist(), object)
            widths = width_of(values) if len(values) else np.empty(0, np.int64)
            for width in np.unique(widths):
                at = widths == width
                rows = [p.tobytes() for p in pack(values[at], int(width))]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at].tolist(), batch_type), pa.array(rows, pa.binary())], schema=out)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = kept.schema["vec_id"].dataType
    batch_type = to_arrow_type(id_type)
    return kept.mapInArrow(run, f"vec_id {id_type.simpleString()}, planes binary")


def _by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and planes of a batch, one group per width."""
    rows = column.to_pylist()
    sizes = np.array([len(r) for r in rows])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join(rows[i] for i in at), "<u8").reshape(len(at), size // 8)


def bit_counts(planes: DataFrame, centroids: Centroids) -> DataFrame:
    """(cluster, plane, is_sign, component, n): how many vectors nearest to each centroid have which bit."""
    schema = pa.schema([("cluster", pa.int32()), ("plane", pa.int32()), ("is_sign", pa.bool_()), ("counts", pa.list_(pa.int64()))])
    bound_batches(planes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = defaultdict(lambda: np.zeros(COMPONENTS, np.int64))
        members: dict[int, int] = defaultdict(int)
        for batch in batches:
            for _, rows in _by_width(batch.column(0)):
                best, _ = centroids.nearest(rows)
                width = rows.shape[1]
                for cluster in np.unique(best).tolist():
                    own = np.ascontiguousarray(rows[best == cluster])
                    members[cluster] += len(own)
                    bits = np.unpackbits(own.view(np.uint8).reshape(len(own), width, 8), axis=2, bitorder="little")
                    for i, counts in enumerate(bits.sum(axis=0, dtype=np.int64)):
                        total[cluster, i, i == width - 1] += counts
        rows = [(*key, counts.tolist()) for key, counts in total.items()]
        rows += [(cluster, -1, False, [n] + [0] * (COMPONENTS - 1)) for cluster, n in members.items()]
        if rows:
            yield record_batch(rows, schema)

    parts = planes.select("planes").mapInArrow(run, "cluster int, plane int, is_sign boolean, counts array<bigint>")
    return (
        parts.select("cluster", "plane", "is_sign", F.posexplode("counts").alias("component", "n"))
        .groupBy("cluster", "plane", "is_sign", "component")
        .agg(F.sum("n").alias("n"))
    )


def moved(centroids: list[list[int]], counts: DataFrame) -> list[list[int]]:
    """Each centroid at floor(sum / count) of its vectors; one without vectors stays.

    The totals are at most centroids x planes x 64 numbers.
    """
    sums: dict[int, list[int]] = defaultdict(lambda: [0] * COMPONENTS)
    members: dict[int, int] = {}
    for r in counts.collect():
        if r.plane < 0:
            members[r.cluster] = max(members.get(r.cluster, 0), r.n)
        else:
            sums[r.cluster][r.component] += r.n * (-(2**r.plane) if r.is_sign else 2**r.plane)
    return [[s // members[i] for s in sums[i]] if i in members else old for i, old in enumerate(centroids)]


def assigned(planes: DataFrame, centroids: Centroids) -> DataFrame:
    """(vec_id, cluster, distance) of every packed vector."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = planes.schema["vec_id"].dataType
    schema = pa.schema([("vec_id", to_arrow_type(id_type)), ("cluster", pa.int32()), ("distance", pa.int64())])
    bound_batches(planes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in _by_width(batch.column(1)):
                best, distance = centroids.nearest(rows)
                fits = [d if d <= _LONGEST else None for d in distance.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(best, pa.int32()), pa.array(fits, pa.int64())], schema=schema)

    return planes.select("vec_id", "planes").mapInArrow(run, f"vec_id {id_type.simpleString()}, cluster int, distance bigint")


def cluster(vectors: DataFrame, options: Clustering = Clustering()) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors without exactly 64 finite components give no row; a component whose product with 64 is beyond a
    double counts as not finite. Repeated rows are vectors of their own. Null ids come after all others when
    the first centroids are chosen; equal ids are ordered by their planes. With fewer vectors than centroids
    there are as many centroids as vectors; an empty table gives no rows. A distance or an inertia that no
    long can hold is null (components beyond about 2**21), the clusters are exact even then. Other columns
    are not looked at.
    """
    spark = vectors.sparkSession
    planes = settle_table(packed(vectors), "planes")
    lot = F.sha2(F.concat(F.lit(f"{options.salt}:"), F.col("vec_id").cast("string")), 256)
    seeds = planes.orderBy(lot.asc_nulls_last(), "planes").limit(options.centroids).collect()
    centroids = [whole(np.frombuffer(bytes(r.planes), "<u8")) for r in seeds]
    if not centroids:
        return _result(assigned(planes, Centroids([[0] * COMPONENTS])), spark, [], {})
    for _ in range(options.rounds):
        centroids = moved(centroids, bit_counts(planes, Centroids(centroids)))
    final = settle_table(assigned(planes, Centroids(centroids)), "assigned")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = final.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), exact).alias("inertia")).collect()
    return _result(final, spark, centroids, {r.cluster: None if r.inertia is None else int(r.inertia) for r in sums})


def _result(rows: DataFrame, spark: SparkSession, centroids: list[list[int]], inertia: dict[int, int | None]) -> DataFrame:
    fits = lambda v: v if v is not None and v <= _LONGEST else None
    total = None if None in inertia.values() else sum(inertia.values())
    facts = [(i, fits(inertia.get(i, 0)), fits(total), sha256(",".join(map(str, c)))) for i, c in enumerate(centroids)]
    of = spark.createDataFrame(facts, "number int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(of), F.col("cluster") == F.col("number")).drop("number")


def op11_bit_plane_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return cluster(table(spark, folder, "embeddings"))


def _round(n: int) -> str:
    """One round in SQL: assignments to the centroids c{n-1}, then the centroids c{n}."""
    return f"""
d{n} AS (SELECT v.vec_id, v.copy, c.number, sum((v.x - c.x) * (v.x - c.x)) AS distance
  FROM v JOIN c{n - 1} c USING (i) GROUP BY ALL),
a{n} AS (SELECT vec_id, copy, arg_min(number, (distance, number)) AS number, min(distance) AS distance FROM d{n} GROUP BY ALL),
m{n} AS (SELECT a.number, v.i, sum(v.x)::HUGEINT AS s, count(*)::HUGEINT AS k FROM a{n} a JOIN v USING (vec_id, copy) GROUP BY ALL),
c{n} AS (SELECT c.number, c.i, CASE WHEN m.k IS NULL THEN c.x ELSE (m.s - ((m.s % m.k) + m.k) % m.k) // m.k END AS x
  FROM c{n - 1} c LEFT JOIN m{n} m ON m.number = c.number AND m.i = c.i)"""


ORACLE = f"""
WITH kept AS (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY embedding) AS copy, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, copy, unnest(range(64)) AS i, unnest(list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::HUGEINT)) AS x FROM kept),
seeds AS (SELECT vec_id, copy, row_number() OVER (ORDER BY sha256('1:' || vec_id), copy) - 1 AS number FROM kept QUALIFY number < 16),
c0 AS (SELECT s.number, v.i, v.x FROM seeds s JOIN v USING (vec_id, copy)),
{_round(1)}, {_round(2)}, {_round(3)}, {_round(4)},
texts AS (SELECT number, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY number)
SELECT a.vec_id, a.number::INTEGER AS cluster, a.distance::BIGINT AS distance,
  (sum(a.distance) OVER (PARTITION BY a.number))::BIGINT AS cluster_inertia, (sum(a.distance) OVER ())::BIGINT AS inertia, t.centroid_sha256
FROM a4 a JOIN texts t USING (number)
"""

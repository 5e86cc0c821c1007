"""Centroid clustering of embeddings over subvector dictionaries, in exact integers.

Method: subvector dictionaries.  A component x is the integer floor(scale * x).  Kept
vectors are dealt into row groups of ``ROWS``; in each, every block of ``BLOCK``
dimensions is dictionary-encoded without loss: its distinct subvectors, and one code a
vector.  The row groups are written once.  In each round the squared distances of a
row group's distinct subvectors to the centroids' subvectors are computed once, and a
vector's distance to a centroid is the sum of what its codes point to.  A dictionary is
of one row group, so nothing that grows with the corpus is broadcast or held; a round
sends the centroids out (k times dim integers) and gets back the sums of each task's
vectors by cluster.  No centroid is in a task's way, however many vectors it has.

Results for odd input: vectors that are null, of another length, or that hold a null or
non-finite component are left out; a null id comes back null, and its vector starts a
centroid only if too few others do; equal ids are vectors of their own, the one with the
smaller components first; with fewer than k vectors there are as many centroids; an
empty table gives an empty one.  Integers beyond 2**27 either way are taken as 2**27, as
distances wouldn't fit 64 bits; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .storage import saved

#: Vectors of a row group, and dimensions of a block.
ROWS, BLOCK = 1 << 15, 2
LIMIT = 1 << 27
GROUPS = "ids binary, codes binary, sizes binary, entries binary"


def integers(values: pa.Array, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column are kept, and their integers."""
    n = len(values)
    size = values.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = values.flatten()  # of the rows that aren't null
    whole = flat.is_valid().to_numpy(zero_copy_only=False)
    number = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    first = np.concatenate(([0], np.cumsum(np.maximum(size, 0))))[:-1]
    right = np.flatnonzero(size == dim)
    at = first[right, None] + np.arange(dim)
    kept = whole[at].all(1) & np.isfinite(number[at]).all(1)
    mask = np.zeros(n, bool)
    mask[right[kept]] = True
    return mask, np.clip(np.floor(number[at[kept]] * scale), -LIMIT, LIMIT).astype(np.int64)


def _encoder(dim: int, scale: float):
    """mapInArrow over (vec_id, vector): row groups of GROUPS."""

    def group(ids: list[np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
        vectors = np.concatenate(rows)
        codes, sizes, entries = [], [], []
        for at in range(0, dim, BLOCK):
            part = vectors[:, at : at + BLOCK]
            key = part[:, 0].copy()
            for j in range(1, part.shape[1]):
                key = key << 29 | part[:, j] + LIMIT
            _, where, code = np.unique(key, return_index=True, return_inverse=True)
            codes.append(code.astype(np.uint16))
            sizes.append(len(where))
            entries.append(part[where].astype(np.int32).ravel())
        packed = (np.concatenate(ids), np.concatenate(codes), np.array(sizes, np.int32), np.concatenate(entries))
        return pa.RecordBatch.from_pydict({k: pa.array([x.tobytes()], pa.binary()) for k, x in zip(("ids", "codes", "sizes", "entries"), packed)})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0
        for batch in batches:
            mask, vectors = integers(batch.column("vector"), dim, scale)
            own = batch.column("vec_id").to_numpy(zero_copy_only=False)[mask]
            while len(own):
                take = ROWS - held
                ids.append(own[:take])
                rows.append(vectors[:take])
                held += len(ids[-1])
                own, vectors = own[take:], vectors[take:]
                if held == ROWS:
                    yield group(ids, rows)
                    ids, rows, held = [], [], 0
        if held:
            yield group(ids, rows)

    return encode


def _blocks(row: dict, n: int, dim: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Dimensions, distinct subvectors and codes of each block of a row group."""
    codes, sizes, entries = np.frombuffer(row["codes"], np.uint16), np.frombuffer(row["sizes"], np.int32), np.frombuffer(row["entries"], np.int32)
    begin = 0
    for i, at in enumerate(range(0, dim, BLOCK)):
        width = min(BLOCK, dim - at)
        end = begin + int(sizes[i]) * width
        yield slice(at, at + width), entries[begin:end].reshape(-1, width).astype(np.int64), codes[i * n : (i + 1) * n]
        begin = end


def assigned(row: dict, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, nearest centroid (of equal ones the first) and squared distance of a row group's vectors."""
    ids = np.frombuffer(row["ids"], np.int64)
    total = np.zeros((len(ids), len(centroids)), np.int64)
    for dims, distinct, code in _blocks(row, len(ids), centroids.shape[1]):
        partial = np.zeros((len(distinct), len(centroids)), np.int64)
        for j, d in enumerate(range(dims.start, dims.stop)):
            away = distinct[:, j, None] - centroids[None, :, d]
            partial += away * away
        total += partial[code]
    nearest = total.argmin(1)
    return ids, nearest, total[np.arange(len(ids)), nearest]


def _summed(centroids: np.ndarray):
    """mapInArrow over GROUPS: one row for each cluster of a task, with its vectors, their distances and the sums of their components."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = centroids.shape
        count, distance, total = np.zeros(k, np.int64), [0] * k, np.zeros((k, dim), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                ids, nearest, away = assigned(row, centroids)
                count += np.bincount(nearest, minlength=k)
                order = np.argsort(nearest, kind="stable")
                first = np.flatnonzero(np.diff(nearest[order], prepend=-1))
                for c, x in zip(nearest[order][first].tolist(), np.add.reduceat(away[order].astype(object), first).tolist()):
                    distance[c] += x
                for dims, distinct, code in _blocks(row, len(ids), dim):
                    total[nearest[order][first], dims] += np.add.reduceat(distinct[code[order]], first, axis=0)
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(full, pa.int32()), "n": pa.array(count[full], pa.int64()), "distance": pa.array([str(distance[c]) for c in full], pa.string()),
            "total": pa.array(total[full].tolist(), pa.list_(pa.int64()))})

    return sums


def _labelled(centroids: np.ndarray):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, nearest, away = assigned(row, centroids)
                yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "cluster": pa.array(nearest, pa.int32()), "distance": pa.array(away, pa.int64())})

    return label


def centroid_cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, k: int = 40, rounds: int = 5, scale: float = 256.0, salt: str = "2:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia (decimals) and centroid (array of its integers) of each kept vector.

    Centroids start as the k vectors with the smallest sha256 of salt and id.
    """
    spark = df.sparkSession
    A.bound_batches(spark)
    vectors = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    stored = vectors.select(F.coalesce("vec_id", F.lit(A.NULL_ID)).alias("vec_id"), "vector")
    groups = saved(stored.mapInArrow(_encoder(dim, scale), GROUPS))
    plain = (F.size("vector") == dim) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("vector", lambda x: F.greatest(F.least(F.floor(x * F.lit(scale)), F.lit(LIMIT)), F.lit(-LIMIT)))
    first = vectors.where(F.coalesce(plain, F.lit(False))).select("vec_id", whole.alias("e"))
    first = first.orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "e").limit(k).collect()  # k rows
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid array<long>")
    centroids = np.array([r.e for r in first], np.int64)
    for _ in range(rounds):
        sums = groups.mapInArrow(_summed(centroids), "cluster int, n long, distance string, total array<long>")
        each = sums.select("cluster", "n", F.posexplode("total").alias("d", "s")).groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        centroids = centroids.copy()
        for r in each.collect():  # k * dim rows at most
            centroids[r.cluster, r.d] = int(r.s) // r.n
    last = groups.mapInArrow(_summed(centroids), "cluster int, n long, distance string, total array<long>")
    inertia = {r.cluster: int(r.d) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    every = F.lit(sum(inertia.values())).cast("decimal(38,0)")
    named = spark.createDataFrame([(c, str(x), centroids[c].tolist()) for c, x in inertia.items()], "cluster int, d string, centroid array<long>")
    out = groups.mapInArrow(_labelled(centroids), "vec_id long, cluster int, distance long").join(F.broadcast(named), "cluster")
    return out.select(A.outer_id("vec_id"), "cluster", "distance", F.col("d").cast("decimal(38,0)").alias("cluster_inertia"), every.alias("inertia"), "centroid")


def digest(centroid: list[int]) -> str:
    """What the registered query shows of a centroid."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroid_cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    shown = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    return out.select("vec_id", "cluster", "distance", F.col("cluster_inertia").cast("long").alias("cluster_inertia"), F.col("inertia").cast("long").alias("inertia"), shown.alias("centroid_sha256"))


def _oracle(rounds: int = 5) -> str:
    near = "SELECT vec_id, any_value(e) AS e, min({{'d': d, 'c': c}}) AS m FROM (SELECT v.vec_id, v.e, k.c, list_sum(list_transform(list_zip(v.e, k.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i} k) GROUP BY vec_id"
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('2:', vec_id))) - 1 AS c, e FROM v QUALIFY row_number() OVER (ORDER BY sha256(concat('2:', vec_id))) <= 40)",
    ]
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({near.format(i=i)})")
        means = f"SELECT m.c AS c, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM (SELECT m, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{i}) GROUP BY m.c, i"
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n.e, o.e) AS e FROM c{i} o LEFT JOIN (SELECT c, list(x ORDER BY i) AS e FROM ({means}) GROUP BY c) n USING (c))")
    parts.append(f"z AS MATERIALIZED ({near.format(i=rounds)})")
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, m.c::INT AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia, "
        f"sha256(array_to_string(k.e, ',')) AS centroid_sha256 FROM z JOIN c{rounds} k ON k.c = m.c")


ORACLE = _oracle()

"""A kept index of vectors: clusters with radii, so that an exact search opens only clusters that can hold one of the best."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vectors that cluster centres are fitted on, at most, and clusters, at most; vectors for which a cluster gets another file.
SAMPLE, CLUSTERS, SLICE = 20_000, 256, 1_000_000


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


@dataclass(frozen=True)
class VectorIndex:
    """An index under a folder, in parts that are added one by one.

    Each part has centres of its own, fitted on at most `sample` of its vectors, so that what comes later and lies elsewhere
    is clustered as well; every vector is indexed, in the cluster of its nearest centre. A part holds vectors by cluster and a row a cluster: how many, and how far the farthest
    is from the centre. It counts once a row of `commits` names it; what a dead job left is never read.
    Rows of null id or vector, or with a null, infinite or undefined element, can't be found and are left out; other lengths than the first part's fail. Repeated rows stay. A column named score gives
    way to that of searches; vector_cluster, vector_away and placed are names of the index and fail.
    """

    spark: SparkSession
    folder: str
    id: str = "vec_id"
    vector: str = "embedding"
    clusters: int = CLUSTERS
    sample: int = SAMPLE

    def _parts(self) -> list:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return []
        return self.spark.read.schema("part string, vectors long, centres string").parquet(f"{self.folder}/commits").collect()  # a row a call of add()

    def _centres(self, vectors: DataFrame) -> list[list[float]]:
        """At most `clusters` centres, of about one cluster for a root of the sample; the sample is bounded, and always the same."""
        some = vectors.select(F.xxhash64(self.id).alias("h"), self.vector).orderBy("h").limit(self.sample).select(array_to_vector(F.col(self.vector)).alias("features")).cache()
        n = some.count()
        if n < 2:
            out = [[float(x) for x in r["features"]] for r in some.collect()]  # one row at most
        else:
            model = KMeans(k=min(self.clusters, max(2, int(n**0.5))), seed=1, maxIter=10).fit(some)
            out = [[float(x) for x in c] for c in model.clusterCenters()]
        some.unpersist()
        return out

    def add(self, vectors: DataFrame, commit: bool = True) -> VectorIndex:
        """Index vectors (id, vector, and any columns that searches shall give or ask)."""
        if taken := {"vector_cluster", "vector_away", "placed"} & {c.lower() for c in vectors.columns}:
            raise ValueError(f"column names of the index: {sorted(taken)}")
        parts, name = self._parts(), uuid.uuid4().hex
        finite = F.forall(self.vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
        held = vectors.where(F.col(self.id).isNotNull() & F.col(self.vector).isNotNull() & finite)
        size = len(json.loads(parts[0]["centres"])[0]) if parts else None
        centres = self._centres(held if size is None else held.where(F.size(self.vector) == size))
        if not centres:
            centres = [[0.0] * size] if size else []  # none, or none of that length, which fails below
        if not centres:
            return self  # no vector to begin with
        matrix, size = np.array(centres), len(centres[0])

        @F.pandas_udf("struct<vector_cluster:int,vector_away:double>")
        def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if any(len(v) != size for v in batch):
                    raise ValueError(f"vectors of this index have {size} elements")
                x = np.array([np.asarray(v, float) for v in batch]).reshape(-1, size)
                at = ((matrix**2).sum(1) - 2 * x @ matrix.T).argmin(1)
                yield pd.DataFrame({"vector_cluster": at.astype("int32"), "vector_away": np.sqrt(((x - matrix[at]) ** 2).sum(1))})

        at = f"{self.folder}/parts/{name}"
        placed = held.select("*", nearest(F.col(self.vector)).alias("placed")).select(*held.columns, "placed.*")
        slices = 1 + held.count() // (SLICE * max(1, len(centres)))  # large clusters are written by several tasks
        dealt = placed.repartition(F.col("vector_cluster"), F.pmod(F.xxhash64(self.id), F.lit(slices)))
        dealt.sortWithinPartitions("vector_cluster").write.partitionBy("vector_cluster").parquet(f"{at}/vectors")
        stored = self.spark.read.option("basePath", f"{at}/vectors").schema(placed.schema).parquet(f"{at}/vectors")
        stored.groupBy(F.col("vector_cluster").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.max("vector_away").alias("radius")).coalesce(1).write.parquet(f"{at}/clusters")
        if commit:
            n = self.spark.read.parquet(f"{at}/clusters").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            row = self.spark.createDataFrame([(name, n, json.dumps(centres))], "part string, vectors long, centres string")
            row.coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return self

    def _bounds(self, query: list[float]) -> tuple[list, list[tuple[str, int, int, float]]]:
        """Parts, and (part, cluster, vectors, greatest possible dot product) of each cluster: q.x is at most q.centre + |q| radius."""
        parts = [p for p in self._parts() if p["vectors"]]
        if not parts:
            return [], []
        q, each = np.array(query, float), []
        for p in parts:  # at most `clusters` rows a part
            centres = np.array(json.loads(p["centres"]))
            if len(q) != centres.shape[1]:
                raise ValueError(f"vectors of this index have {centres.shape[1]} elements")
            rows = self.spark.read.parquet(f"{self.folder}/parts/{p['part']}/clusters").collect()
            each += [(p["part"], r["cluster"], r["n"], float(centres[r["cluster"]] @ q + np.linalg.norm(q) * r["radius"])) for r in rows]
        return parts, sorted(each, key=lambda r: (-r[3], r[0], r[1]))

    def _read(self, chosen: list[tuple[str, int, int, float]]) -> DataFrame:
        """The vectors of clusters, from their folders alone."""
        out = None
        for part in dict.fromkeys(c[0] for c in chosen):
            at = f"{self.folder}/parts/{part}/vectors"
            rows = self.spark.read.option("basePath", at).parquet(at).where(F.col("vector_cluster").isin([c[1] for c in chosen if c[0] == part]))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def _plan(self, query: list[float], cut: int):
        """The clusters that the `cut` best can be in, and how clusters become them."""
        parts, each = self._bounds(query)
        if not parts or cut <= 0:
            return [], each, None

        def scored(chosen: list) -> DataFrame:
            rows = self._read(chosen).drop("vector_cluster", "vector_away")
            return rows.withColumn("score", F.round(dot(self.vector, F.lit([float(x) for x in query])), 4)).orderBy(F.desc("score"), self.id).limit(cut)

        first, have = [], 0
        for c in each:  # enough clusters for a first answer, which says what others must reach
            first.append(c)
            have += c[2]
            if have >= cut:
                break
        best = scored(first).agg(F.min("score"), F.count(F.lit(1))).first()
        least = best[0] - 2e-4 if best[1] >= cut else float("-inf")  # scores are rounded to 4 digits
        return [c for c in each if c[3] >= least], each, scored

    def search(self, query: list[float], k: int = 10, where: Column | None = None, wide: int = 8) -> DataFrame:
        """The k nearest (id, the other columns, score) of the wide * k vectors with the greatest dot product, the smaller id
        among equals; `where` applies after that cut. The result is that of a scan of all vectors."""
        chosen, _, scored = self._plan(query, wide * k)
        if not chosen:
            return self.spark.createDataFrame([], f"{self.id} long, score double")
        near = scored(chosen).drop(self.vector)
        return (near if where is None else near.where(where)).orderBy(F.desc("score"), self.id).limit(k)

    def read_share(self, query: list[float], k: int = 10, wide: int = 8) -> float:
        """The share of the vectors that a search reads."""
        chosen, each, _ = self._plan(query, wide * k)
        return sum(c[2] for c in chosen) / max(1, sum(c[2] for c in each))

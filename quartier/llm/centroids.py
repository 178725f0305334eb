"""Centroid clustering in integers with DataFrame expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartier.session import materialise

WIDTH, CLUSTERS, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
#: Integers above this size are refused: squared distances of 64 components must fit 64 bits.
LARGEST = 2**27


def kept_vectors(table: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long) of the rows of ``table`` with exactly ``width`` finite components.

    A component x becomes floor(scale * x), x as double.
    """
    x = F.col("embedding")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))
    return table.where((F.size(x) == width) & F.forall(x, finite)).select("vec_id", whole.alias("v"))


def _total(array: Column, start: Column | None = None) -> Column:
    return F.aggregate(array, F.lit(0).cast("long") if start is None else start, lambda s, x: s + x)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often lambda functions in the body use it."""
    return F.get(F.transform(F.array(value), body), 0)


def nearest(v: Column, centroids: list[list[int]]) -> Column:
    """struct<distance, cluster> of the centroid with the least squared distance, then the smaller number.

    The centroids are one literal array. (v - c)^2 is taken as v^2 - 2vc + c^2, exact in integers: one product for each
    component and centroid.
    """
    each = ", ".join(f"named_struct('twice', array({', '.join(f'{-2 * x}L' for x in c)}), 'square', {sum(x * x for x in c)}L)" for c in centroids)

    def best(own: Column, square: Column) -> Column:
        distance = lambda c: square + _total(F.zip_with(own, c["twice"], lambda a, b: a * b), c["square"])
        return F.array_min(F.transform(F.expr(f"array({each})"), lambda c, i: F.named_struct(F.lit("distance"), distance(c), F.lit("cluster"), i)))

    return _let(v, lambda own: _let(_total(F.transform(own, lambda x: x * x)), lambda square: best(own, square)))


def first_centroids(vectors: DataFrame, count: int, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """Of ``count`` vectors the ``clusters`` with the smallest sha256 of ``seed:vec_id``, then of the smaller vector.

    Rows are first cut by the hash's leading digits to a few times ``clusters``, so tasks send the driver no more than that.
    """
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    hashed = vectors.select(place.alias("h"), "v")
    share = (4 * clusters + 64) / max(count, 1)
    first = lambda rows: [r["v"] for r in rows.orderBy("h", "v").limit(clusters).collect()]
    if share < 1:
        found = first(hashed.where(F.substring("h", 1, 12) < f"{int(share * 2**48):012x}"))
        if len(found) == clusters:
            return found
    return first(hashed)


def moved_centroids(vectors: DataFrame, centroids: list[list[int]], total: str = "long") -> list[list[int]]:
    """Each centroid replaced by the componentwise floor(sum / count) of its vectors; one without vectors stays.

    Sums are plain columns (``total``: long, or a decimal where long could overflow), aggregated before the shuffle; the driver gets one row per cluster.
    """
    width = len(centroids[0])
    near = vectors.select("v", nearest(F.col("v"), centroids)["cluster"].alias("cluster"))
    columns = near.select("cluster", *[F.get("v", F.lit(i)).cast(total).alias(f"s{i}") for i in range(width)])
    sums = columns.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
    out = list(centroids)
    for r in sums.collect():
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return out


def cluster_vectors(
    table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, seed: int = SEED, scale: int = SCALE
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance of every kept row of ``table``; final centroids).

    Integer arithmetic throughout, so reruns and other partitionings agree. Rows whose embedding is null, of another
    width, or holds nulls or non-finite components are left out. Repeated rows each count; a null vec_id is hashed as an
    empty text; equal hashes are ordered by vector. With fewer vectors than ``clusters`` there are as many centroids as
    vectors; an empty table gives no rows and no centroids. Extra columns are not used. A component of 2**27 / scale or
    more in size raises an error, as distances would no longer fit 64 bits. Each round is one scan of the table with a few kilobytes of literal centroids; its shuffle carries one row per
    task and cluster.
    """
    vectors = kept_vectors(table, width, scale)
    size = vectors.select(F.array_max(F.transform("v", lambda x: F.abs(x))).alias("m")).agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("m")).first()
    if not size["n"]:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), []
    if size["m"] >= LARGEST:
        raise ValueError(f"a component of {size['m'] / scale} is too large for distances in 64 bits")
    total = "long" if size["m"] * size["n"] < 2**63 else "decimal(38, 0)"
    centroids = first_centroids(vectors, size["n"], clusters, seed)
    for _ in range(rounds):
        centroids = moved_centroids(vectors, centroids, total)
    near = nearest(F.col("v"), centroids)
    return vectors.select("vec_id", near.alias("near")).select("vec_id", "near.cluster", "near.distance"), centroids


def clusters_with_inertia(table: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept row; see ``cluster_vectors``."""
    found, centroids = cluster_vectors(table, **options)
    found = materialise(found)
    own = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38, 0)")).alias("s")).collect()}
    inertia = F.expr(f"element_at(array({', '.join(f'{own.get(i, 0)}L' for i in range(len(centroids)))}), cluster + 1)") if centroids else F.lit(0).cast("long")
    texts = F.array(*[F.lit(",".join(map(str, c))) for c in centroids]) if centroids else F.array(F.lit(""))
    return found.select(
        "vec_id", "cluster", "distance", inertia.alias("cluster_inertia"), F.lit(sum(own.values())).cast("long").alias("inertia"),
        F.sha2(F.get(texts, F.col("cluster")).cast("binary"), 256).alias("centroid_sha256"),
    )

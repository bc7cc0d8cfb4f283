"""Team assignment from jersey colours: k-means, the two largest clusters, and a vote."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign_teams(samples: DataFrame, keys: list[str], colour: str = "color", k: int = 5, seed: int = 42) -> DataFrame:
    """keys and team (1 or 2): the cluster most of a player's colour samples are nearest to.

    Team 1 is the largest cluster, team 2 the next; samples of smaller clusters count for
    the nearer team, ties for team 1.
    """
    vectors = samples.withColumn("features", array_to_vector(F.col(colour)))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(vectors)
    placed = model.transform(vectors)
    sizes = placed.groupBy("prediction").count().orderBy(F.desc("count"), "prediction").limit(2).collect()  # k rows at most
    centres = [model.clusterCenters()[r["prediction"]] for r in sizes] or [[0.0]]
    gaps = [F.aggregate(F.zip_with(colour, F.array(*map(F.lit, map(float, c))), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for c in centres]
    team = F.when(gaps[0] <= gaps[-1], 1).otherwise(2)
    votes = placed.select(*keys, team.alias("team")).groupBy(*keys).agg(
        F.sum(F.when(F.col("team") == 1, 1).otherwise(0)).alias("ones"), F.count(F.lit(1)).alias("n")
    )
    return votes.select(*keys, F.when(F.col("ones") * 2 >= F.col("n"), 1).otherwise(2).alias("team"))

"""Named queries of the graph operators over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import build, graph
from weftgraph.operators.components import connected_components
from weftgraph.operators.descent import neighbour_descent
from weftgraph.operators.leiden import leiden
from weftgraph.operators.partition import balanced_partition
from weftgraph.operators.pooling import assign, fit_pooling
from weftgraph.operators.reach import neighbourhood_sizes as sizes_within, personalised_pagerank as ranks_from
from weftgraph.operators.sampling import sample_neighbours
from weftgraph.operators.spectral import spectral_embedding as eigenvectors
from weftgraph.operators.walks import random_walks as walked
from weftgraph.plans.lineage import discard, materialize
from weftgraph.sources import table
from weftgraph.streaming.edges import windowed_activity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that gives the same rows."""
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


#: Edges over the embeddings: the eight nearest of each vector, and both directions of these.
NEAR = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS m FROM v),
c AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.e, b.e) / (a.m * b.m), 6) AS weight FROM n a JOIN n b ON a.vec_id <> b.vec_id),
k AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM c) WHERE r <= 8),
e AS (SELECT src, dst FROM k UNION SELECT dst, src FROM k),
d AS (SELECT src AS v, count(*) AS degree FROM e GROUP BY 1),
p AS (SELECT vec_id AS v, vec_id % 5 AS cluster FROM embeddings)"""
BOUGHT = """
i AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS m FROM lineitem),
w AS (SELECT a.m AS src, b.m AS dst, count(*) AS weight FROM i a JOIN i b USING (g) WHERE a.m < b.m GROUP BY 1, 2 HAVING count(*) >= 2),
e AS (SELECT src, dst FROM w UNION SELECT dst, src FROM w)"""


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symmetric neighbour graph of the embeddings."""
    return graph.symmetrize(build.knn(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


def over(edges: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What an operator, which may read its edges several times, makes of ``edges``. These are written once and go when its result is written."""
    written = materialize(edges)
    made = operator(written)
    out = materialize(made)
    discard(made)  # with what it reads: the edges, and the operator's own tables
    discard(written)
    return out


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id modulo 5 as clusters."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), (F.col("vec_id") % 5).alias("cluster"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), F.col("label").cast("bigint").alias("cluster"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.features(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.copurchase(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 2)


@query(f"WITH {BOUGHT} SELECT src, dst, weight FROM w")
def edges_copurchase(spark, sf_dir):
    return bought(spark, sf_dir)


@query("SELECT DISTINCT o_custkey AS src, l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def edges_bipartite(spark, sf_dir):
    return build.bipartite(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), ("o_orderkey", "l_orderkey"), "o_custkey", "l_partkey")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, user_id AS src, event_type AS dst, count(*) AS weight FROM events GROUP BY 1, 2, 3")
def edges_windowed(spark, sf_dir):
    found = windowed_activity(table(spark, sf_dir, "events"))
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "src", "dst", "weight")


@query("SELECT src, dst, count(*) AS weight FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL GROUP BY 1, 2")
def edges_transition(spark, sf_dir):
    return build.transitions(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], F.to_date("ts"))


@query(f"WITH {NEAR} SELECT src, dst, weight FROM c WHERE src < dst AND weight >= 0.3")
def cosine_pairs(spark, sf_dir):
    return build.cosine_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.3)


@query(f"WITH {NEAR} SELECT src, dst, weight FROM k")
def knn_graph(spark, sf_dir):
    return build.knn(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query(f"WITH {NEAR} SELECT src, dst FROM e")
def symmetrize(spark, sf_dir):
    return near(spark, sf_dir)


@query(f"WITH {NEAR} SELECT v, degree FROM d")
def degree(spark, sf_dir):
    return over(near(spark, sf_dir), graph.degree)


@query(f"WITH {NEAR} SELECT src, dst, round(1 / sqrt(a.degree * b.degree), 9) AS weight FROM e JOIN d a ON src = a.v JOIN d b ON dst = b.v")
def sym_norm(spark, sf_dir):
    return over(near(spark, sf_dir), graph.sym_norm).withColumn("weight", F.round("weight", 9))


@query(f"WITH {NEAR}, x AS (SELECT vec_id AS v, unnest(e) AS x, unnest(range(0, len(e)))::INT AS pos FROM v) SELECT src AS v, pos, round(avg(x), 6) + 0.0 AS x FROM e JOIN x ON dst = x.v GROUP BY 1, 2")
def mean_message_pass(spark, sf_dir):
    return over(near(spark, sf_dir), lambda e: graph.mean_messages(e, vectors(spark, sf_dir))).withColumn("x", F.round("x", 6) + F.lit(0.0))


@query(f"WITH RECURSIVE {BOUGHT}, r AS (SELECT src AS v, src AS o FROM e UNION SELECT r.v, e.dst FROM r JOIN e ON r.o = e.src) SELECT v, min(o) AS component FROM r GROUP BY 1")
def components(spark, sf_dir):
    return over(bought(spark, sf_dir), connected_components)


def _propagation(rounds: int) -> str:
    ctes = ["l0 AS (SELECT v, v AS cluster FROM d)"]
    for i in range(rounds):
        ctes.append(f"l{i + 1} AS (SELECT v, cluster FROM (SELECT src AS v, cluster, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, cluster) AS r FROM e JOIN l{i} ON dst = l{i}.v GROUP BY 1, 2) WHERE r = 1)")
    return f"WITH {NEAR}, {', '.join(ctes)} SELECT v, cluster FROM l{rounds}"


#: Rounds of propagation, each with the labels of the round before it, until one would give these again; what a vertex then has in turn is a label or two.
SETTLED = """
s AS MATERIALIZED (SELECT src, dst FROM e),
l AS (SELECT 0 AS i, v, NULL::BIGINT AS before, v AS cluster FROM d UNION ALL
  SELECT i, v, before, cluster FROM (SELECT l.i + 1 AS i, l.v, l.cluster AS before, h.cluster, bool_or(h.cluster IS DISTINCT FROM l.before) OVER () AS moves
    FROM l JOIN (SELECT src, cluster, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, cluster) AS r FROM s JOIN l ON dst = l.v GROUP BY 1, 2) h ON h.src = l.v WHERE h.r = 1) WHERE moves)"""


@query(f"WITH RECURSIVE {NEAR}, {SETTLED} SELECT v, least(before, cluster) AS cluster FROM l WHERE i = (SELECT max(i) FROM l)")
def cluster_embeddings(spark, sf_dir):
    return over(near(spark, sf_dir), graph.settled_labels)


@query(_propagation(3))
def label_propagation(spark, sf_dir):
    return over(near(spark, sf_dir), lambda e: graph.label_propagation(e, 3))


ENDS = "j AS (SELECT a.cluster AS c_a, b.cluster AS c_b FROM e JOIN p a ON src = a.v JOIN p b ON dst = b.v)"


@query(f"WITH {NEAR}, {ENDS}, s AS (SELECT c_a, count(*) AS vol, count(*) FILTER (WHERE c_a = c_b) AS i FROM j GROUP BY 1) SELECT round(sum(i) / sum(vol) - sum(vol::DOUBLE ** 2) / sum(vol)::DOUBLE ** 2, 9) AS modularity FROM s")
def modularity(spark, sf_dir):
    return over(near(spark, sf_dir), lambda e: graph.modularity(e, parts(spark, sf_dir))).select(F.round("modularity", 9).alias("modularity"))


@query(f"WITH {NEAR}, {ENDS}, s AS (SELECT c_a, count(*) AS vol, count(*) FILTER (WHERE c_a <> c_b) AS cut FROM j GROUP BY 1) SELECT c_a AS cluster, round(cut / least(vol, (SELECT sum(vol) FROM s) - vol), 9) AS conductance FROM s")
def cluster_conductance(spark, sf_dir):
    return over(near(spark, sf_dir), lambda e: graph.conductance(e, parts(spark, sf_dir))).withColumn("conductance", F.round("conductance", 9))


@query(f"WITH {NEAR} SELECT count(*) AS triangles FROM e a JOIN e b ON a.dst = b.src JOIN e c ON c.src = a.src AND c.dst = b.dst WHERE a.src < a.dst AND b.src < b.dst")
def triangle_count(spark, sf_dir):
    return over(near(spark, sf_dir), graph.triangles)


def _smoothed(hops: int) -> str:
    ctes = [
        "g AS (SELECT src, dst FROM e UNION ALL SELECT v, v FROM d)",
        "s AS (SELECT src, dst, 1 / sqrt((a.degree + 1) * (b.degree + 1)) AS w FROM g JOIN d a ON src = a.v JOIN d b ON dst = b.v)",
        "x0 AS (SELECT vec_id AS v, unnest(e) AS x, unnest(range(0, len(e)))::INT AS pos FROM v)",
    ]
    ctes += [f"x{i + 1} AS (SELECT src AS v, pos, sum(w * x) AS x FROM s JOIN x{i} ON dst = x{i}.v GROUP BY 1, 2)" for i in range(hops)]
    return f"WITH {NEAR}, {', '.join(ctes)} "


@query(_smoothed(2) + "SELECT v, pos, round(x, 6) + 0.0 AS x FROM x2")
def sgc_two_hops(spark, sf_dir):
    return over(near(spark, sf_dir), lambda e: graph.smoothed(e, vectors(spark, sf_dir), 2)).withColumn("x", F.round("x", 6) + F.lit(0.0))


@query(_smoothed(2) + """, m AS (SELECT label::BIGINT AS cluster, pos, avg(x) AS mean FROM x2 JOIN v ON vec_id = x2.v GROUP BY 1, 2),
t AS (SELECT x2.v, cluster, round(sum(x * mean), 6) AS score FROM x2 JOIN m USING (pos) GROUP BY 1, 2)
SELECT v, cluster FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY score DESC, cluster) AS r FROM t) WHERE r = 1""")
def nearest_centroid(spark, sf_dir):
    return over(near(spark, sf_dir), lambda e: graph.nearest_centroid(graph.smoothed(e, vectors(spark, sf_dir), 2), classes(spark, sf_dir)))


@query("SELECT label::BIGINT AS a, vec_id % 5 AS b, count(*) AS n FROM embeddings GROUP BY 1, 2")
def contingency(spark, sf_dir):
    return graph.contingency(classes(spark, sf_dir), parts(spark, sf_dir))


@query("""WITH t AS (SELECT label AS a, vec_id % 5 AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1, 2), s AS (SELECT sum(n) AS s FROM t),
x AS (SELECT a, sum(n) AS na FROM t GROUP BY 1), y AS (SELECT b, sum(n) AS nb FROM t GROUP BY 1),
ha AS (SELECT sum(-na / s * ln(na / s)) AS ha, sum(na * (na - 1) / 2) AS pa FROM x, s), hb AS (SELECT sum(-nb / s * ln(nb / s)) AS hb, sum(nb * (nb - 1) / 2) AS pb FROM y, s),
mi AS (SELECT sum(n / s * ln(n * s / (na * nb))) AS mi, sum(n * (n - 1) / 2) AS pn FROM t JOIN x USING (a) JOIN y USING (b), s),
best AS (SELECT sum(m) AS best FROM (SELECT max(n) AS m FROM t GROUP BY b))
SELECT round(best / s, 9) AS purity, round(2 * mi / (ha + hb), 9) AS nmi,
  round((pn - pa * pb / (s * (s - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (s * (s - 1) / 2)), 9) AS ari FROM ha, hb, mi, best, s""")
def cluster_agreement(spark, sf_dir):
    out = graph.agreement(classes(spark, sf_dir), parts(spark, sf_dir))
    return out.select(*[F.round(c, 9).alias(c) for c in ("purity", "nmi", "ari")])


@query(f"WITH {NEAR}, {ENDS} SELECT c_a AS src, c_b AS dst, count(*) AS weight FROM j GROUP BY 1, 2")
def coarsen(spark, sf_dir):
    return over(near(spark, sf_dir), lambda e: graph.coarsen(e, parts(spark, sf_dir)))


def _pagerank(rounds: int) -> str:
    ctes = ["r0 AS (SELECT v, 1.0::DOUBLE AS rank FROM d)"]
    ctes += [f"r{i + 1} AS (SELECT dst AS v, 0.15 + 0.85 * sum(rank / degree) AS rank FROM e JOIN d ON src = d.v JOIN r{i} ON src = r{i}.v GROUP BY 1)" for i in range(rounds)]
    return f"WITH {NEAR}, {', '.join(ctes)} SELECT v, round(rank, 6) AS rank FROM r{rounds}"


@query(_pagerank(5))
def pagerank(spark, sf_dir):
    return over(near(spark, sf_dir), lambda e: graph.pagerank(e, 5)).withColumn("rank", F.round("rank", 6))


@query(f"WITH {NEAR} SELECT src, dst FROM e UNION SELECT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst")
def k_hop_neighbourhood(spark, sf_dir):
    return over(near(spark, sf_dir), lambda e: graph.k_hop(e, 2))


@query(f"""WITH {NEAR}, s1 AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY md5('3|1|' || src || '|' || dst), dst) AS r FROM e) WHERE r <= 4),
s2 AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY md5('3|2|' || src || '|' || dst), dst) AS r FROM e WHERE src IN (SELECT dst FROM s1)) WHERE r <= 2)
SELECT 1 AS hop, src, dst FROM s1 UNION ALL SELECT 2, src, dst FROM s2""")
def neighbour_sample(spark, sf_dir):
    return over(near(spark, sf_dir), lambda e: sample_neighbours(e, e.select(F.col("src").alias("v")), [4, 2], seed=3))


@query()
def balanced_parts(spark, sf_dir):
    return over(near(spark, sf_dir), lambda e: balanced_partition(e, 10))


@query()
def leiden_clusters(spark, sf_dir):
    return over(near(spark, sf_dir), lambda e: leiden(e, levels=5, rounds=6, refinements=3))


@query()
def knn_descent(spark, sf_dir):
    return neighbour_descent(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query()
def soft_pooling(spark, sf_dir):
    feats = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("x"))
    return over(near(spark, sf_dir), lambda e: assign(feats, fit_pooling(e, feats, 8, steps=20)).select("v", "cluster"))


@query(f"""WITH {NEAR}, r1 AS (SELECT v, v AS o FROM d UNION SELECT src, dst FROM e), r2 AS (SELECT v, o FROM r1 UNION SELECT r1.v, e.dst FROM r1 JOIN e ON r1.o = e.src)
SELECT v, 1 AS hop, count(*) AS size FROM r1 GROUP BY 1 UNION ALL SELECT v, 2, count(*) FROM r2 GROUP BY 1""")
def neighbourhood_sizes(spark, sf_dir):
    return over(near(spark, sf_dir), lambda e: sizes_within(e, 2))


@query()
def personalised_pagerank(spark, sf_dir):
    return over(near(spark, sf_dir), lambda e: ranks_from(e, e.select(F.col("src").alias("v")), epsilon=1e-3))


@query()
def spectral_embedding(spark, sf_dir):
    return over(near(spark, sf_dir), lambda e: eigenvectors(e, 4, rounds=20)[0])


@query()
def random_walks(spark, sf_dir):
    return over(near(spark, sf_dir), lambda e: walked(e, e.select(F.col("src").alias("v")), 4, p=0.5, q=2.0))


#: Rounds of peeling, each of the edges that the one before has left, until all vertices have two neighbours or none is left.
CORE = """
r AS (SELECT 0 AS i, src, dst FROM e UNION ALL SELECT i + 1, src, dst FROM r WHERE EXISTS (SELECT 1 FROM r GROUP BY src HAVING count(*) < 2)
  AND src IN (SELECT src FROM r GROUP BY src HAVING count(*) >= 2) AND dst IN (SELECT src FROM r GROUP BY src HAVING count(*) >= 2)),
z AS (SELECT src, count(*) AS degree FROM r WHERE i = (SELECT max(i) FROM r) GROUP BY 1)"""


@query(f"WITH RECURSIVE {BOUGHT}, {CORE} SELECT src AS v FROM z WHERE (SELECT min(degree) FROM z) >= 2")
def core_k(spark, sf_dir):
    return over(graph.symmetrize(bought(spark, sf_dir)), lambda e: graph.core(e, 2))


@query()
def louvain_level(spark, sf_dir):
    return over(near(spark, sf_dir), graph.louvain_level)


def _ml_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


@query()
def kmeans_embeddings(spark, sf_dir):
    from pyspark.ml.clustering import KMeans

    rows = _ml_vectors(spark, sf_dir)
    return KMeans(k=10, seed=1).fit(rows).transform(rows).select("v", F.col("prediction").alias("cluster"))


@query()
def power_iteration_clustering(spark, sf_dir):
    from pyspark.ml.clustering import PowerIterationClustering

    edges = near(spark, sf_dir).where("src < dst").withColumn("weight", F.lit(1.0))
    return over(edges, lambda e: PowerIterationClustering(k=5, maxIter=10, weightCol="weight").assignClusters(e).select(F.col("id").alias("v"), "cluster"))


@query()
def lsh_join(spark, sf_dir):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def buckets(rows):
        rows = rows.withColumn("features", array_to_vector("v"))
        model = BucketedRandomProjectionLSH(inputCol="features", outputCol="found", bucketLength=2.0, numHashTables=3, seed=1).fit(rows)
        return model.transform(rows).withColumn("hashes", F.array(*[vector_to_array(F.col("found")[i])[0].cast("bigint") for i in range(3)]))

    found = build.bucket_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", buckets, 1.1)
    return found.withColumn("distance", F.round("distance", 6))

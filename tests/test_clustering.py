from pyspark.sql import functions as F

from conftest import SF_SMALL
from crisismap.operators import clustering as C
from crisismap.plans import fixtures as fx


def _density_fixture(spark):
    pts = []
    for i in range(6):
        for j in range(5):
            pts.append(("A", [0.5 + 0.02 * i, 0.5 + 0.02 * j]))
            pts.append(("B", [5.5 + 0.02 * i, 5.5 + 0.02 * j]))
    for k in range(41):
        pts.append(("chain", [10.0 + 0.05 * k, 0.01]))
    for k in range(5):
        pts.append(("noise", [30.0 + 3 * k, -20.0]))
    for k in range(4):
        pts.append(("small", [20.0 + 0.01 * k, 20.0]))
    rows = [(i, g, v) for i, (g, v) in enumerate(pts)]
    return spark.createDataFrame(rows, "id long, grp string, v array<double>")


def test_density_clusters(spark):
    df = _density_fixture(spark)
    out = C.cluster_density(df, "id", "v", eps=0.2, min_pts=3, min_cluster_size=10)
    by = {}
    for r in out.collect():
        by.setdefault(r.grp, set()).add(r.topic_id)
    assert len(by["A"]) == 1 and len(by["B"]) == 1 and len(by["chain"]) == 1
    assert len({*by["A"], *by["B"], *by["chain"]}) == 3 and -1 not in by["A"] | by["B"] | by["chain"]
    assert by["noise"] == {-1} and by["small"] == {-1}


def test_kmeans_covers_all_rows(spark):
    emb = fx.embeddings(spark, SF_SMALL)
    out = C.cluster_kmeans(emb, 5)
    assert out.count() == emb.count()
    assert {r.topic_id for r in out.select("topic_id").distinct().collect()} <= set(range(5))


def test_reduce_topics(spark):
    emb = fx.embeddings(spark, SF_SMALL).withColumn("topic_id", F.col("label"))
    relabelled, mapping = C.reduce_topics(emb, 4)
    assert {r.new for r in mapping.collect()} == {0, 1, 2, 3}
    assert relabelled.count() == emb.count()
    sizes = [r["count"] for r in relabelled.groupBy("topic_id").count().orderBy("topic_id").collect()]
    assert sizes == sorted(sizes, reverse=True)  # renumbered largest first


def test_chain_of_any_length_is_one_cluster(spark):
    rows = [(i, [0.1 * i, 0.0]) for i in range(600)]  # some 200 cells in a row
    df = spark.createDataFrame(rows, "id long, v array<double>")
    out = C.cluster_density(df, "id", "v", eps=0.42, min_pts=1, min_cluster_size=10, dims=2)
    assert {r.topic_id for r in out.collect()} == {0}

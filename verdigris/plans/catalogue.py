"""Queries over the tables of a folder, each with SQL for the same result where SQL can say it.

Embeddings play the items: vec_id, embedding, label. A fifth of each class is the pool, the rest the test
set; support sets are drawn from the pool; class texts are the means of another support set; the second
backbone is the reversed vector. Documents play a corpus with language as class and source as group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.functions import vec
from verdigris.operators import classifiers, communities, curation, evaluation, graphmethods, graphnet, graphs, linkage, ordering, probe, regions, reports, sampling, similarity, splits
from verdigris.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SAME, OTHER, DIM = 0.35, 0.40, 64


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: dict[tuple, object] = {}


def once(fn: Callable) -> Callable:
    """A loader that is worked out once for a session and the files of a folder, and kept; again if what it wrote is gone or
    the table was written anew: its files' names, and the length and time of what is at its path, are part of the key."""

    def load(spark: SparkSession, sf_dir: str):
        at = (fn.__name__, spark.sparkContext.applicationId, sf_dir, *readers.stamp(spark, f"{sf_dir}/embeddings.parquet"), *table(spark, sf_dir, "embeddings").inputFiles())
        path = getattr(_made.get(at), "written_at", None)
        if at not in _made or (path and not readers.exists(spark, path)):
            _made[at] = fn(spark, sf_dir)
        return _made[at]

    load.__name__, load.__doc__ = fn.__name__, fn.__doc__
    return load


@once
def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, embedding, label, split; written once, as every other query asks for it."""
    return graphs.written(splits.stratified(table(spark, sf_dir, "embeddings"), 0.2, "pool"), "items")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).filter("split = 'pool'").drop("split")


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).filter("split = 'test'").drop("split")


def support(spark: SparkSession, sf_dir: str, k: int = 4, seed: int = 1) -> DataFrame:
    return splits.support(pool(spark, sf_dir), k, seed)


@once
def texts(spark: SparkSession, sf_dir: str) -> pd.DataFrame:
    """class, vec: normalised means of a support set of 8; one row for each class."""
    means = vec.mean_vector(support(spark, sf_dir, 8, 0), ["label"], "embedding", DIM)
    return similarity.held(means.select(F.col("label").alias("class"), vec.normalized(F.col("mean")).alias("vec")), "class", "vec", most=10_000)


def support_rows(spark: SparkSession, sf_dir: str, k: int = 4, seed: int = 1, second: bool = False) -> pd.DataFrame:
    v = F.reverse("embedding") if second else F.col("embedding")
    return similarity.held(support(spark, sf_dir, k, seed).select("vec_id", "label", v.alias("vec")), "vec_id", "label", "vec")


def zero_shot_scores(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """vec_id, class, z of the test rows (or of others)."""
    return similarity.scores(tests(spark, sf_dir) if of is None else of, texts(spark, sf_dir))


def labelled(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return df.join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")


def zero_shot_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, pred, conf, right."""
    p = evaluation.softmax(zero_shot_scores(spark, sf_dir))
    best = evaluation.predicted(p, z="p").withColumnRenamed("top", "conf")
    return labelled(best, spark, sf_dir).withColumn("right", F.col("pred") == F.col("label"))


def r6(c: str, name: str | None = None):
    return F.round(F.col(c), 6).alias(name or c)


# SQL of the same tables
ITEMS = "r AS (SELECT vec_id, embedding::DOUBLE[] e, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', 'pool', vec_id::VARCHAR)), vec_id) n, count(*) OVER (PARTITION BY label) c FROM embeddings), items AS (SELECT vec_id, e, label, CASE WHEN n <= floor(0.2e0 * c) THEN 'pool' ELSE 'test' END split FROM r), pool AS (SELECT * FROM items WHERE split = 'pool'), test AS (SELECT * FROM items WHERE split = 'test')"


def support_sql(name: str, k: int, seed: int) -> str:
    return f"{name} AS (SELECT vec_id, e, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '{k}.{seed}', vec_id::VARCHAR)), vec_id) m FROM pool) WHERE m <= {k})"


def unit_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: x / greatest(sqrt(list_inner_product({v}, {v})), 1e-8))"


TEXTS = ITEMS + ", " + support_sql("sup8", 8, 0) + f", tm AS (SELECT label, i, avg(e[i]) m FROM sup8, range(1, {DIM + 1}) t(i) GROUP BY ALL), tv AS (SELECT label class, list(m ORDER BY i) v FROM tm GROUP BY label), texts AS (SELECT class, {unit_sql('v')} t FROM tv)"
ZERO = TEXTS + ", z AS (SELECT vec_id, label, class, 100 * list_inner_product(e, t) z FROM test, texts)"
PROBS = ZERO + ", ex AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) x FROM z), p AS (SELECT *, x / sum(x) OVER (PARTITION BY vec_id) p FROM ex)"
PRED = PROBS + ", pr AS (SELECT vec_id, label, class pred, p conf, class = label AS right_ FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class) = 1)"
SUPPORT = TEXTS + ", " + support_sql("sup", 4, 1)
CACHE = SUPPORT + ", cn AS (SELECT label class, count(*) n FROM sup GROUP BY 1), zc AS (SELECT q.vec_id, q.label, s.label class, sum(exp(-5e0 * (1 - list_inner_product(q.e, s.e)))) / any_value(n) z FROM test q, sup s JOIN cn ON cn.class = s.label GROUP BY ALL)"
CELLS = PRED + ", cls AS (SELECT range::INT c FROM range(10)), cells AS (SELECT a.c truth, b.c pred, count(pr.vec_id) n FROM cls a CROSS JOIN cls b LEFT JOIN pr ON pr.label = a.c AND pr.pred = b.c GROUP BY ALL)"
METRICS = CELLS + ", tp AS (SELECT truth class, n tp FROM cells WHERE truth = pred), ac AS (SELECT truth class, sum(n) a FROM cells GROUP BY 1), cl AS (SELECT pred class, sum(n) c FROM cells GROUP BY 1), cm AS (SELECT class, tp::BIGINT tp, (c - tp)::BIGINT fp, (a - tp)::BIGINT fn, coalesce(tp / nullif(c, 0)::DOUBLE, 0) \"precision\", coalesce(tp / nullif(a, 0)::DOUBLE, 0) recall, coalesce(2 * tp / nullif(a + c, 0)::DOUBLE, 0) f1 FROM tp JOIN ac USING (class) JOIN cl USING (class))"
PAIRS = f"pairs AS (SELECT a.vec_id a, b.vec_id b, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) cos, a.label = b.label same_class FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= CASE WHEN a.label = b.label THEN {SAME} ELSE {OTHER} END)"
COMPONENTS = "WITH RECURSIVE " + PAIRS + ", ed AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT vec_id node, vec_id root FROM embeddings UNION SELECT ed.b, reach.root FROM reach JOIN ed ON ed.a = reach.node), comp AS (SELECT node, min(root) root FROM reach GROUP BY node)"


# ---- vectors
@query("WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (label + 1)) e FROM embeddings), u AS (SELECT vec_id, sqrt(list_inner_product(e, e)) norm, " + unit_sql("e") + " n FROM v) SELECT vec_id, round(norm, 6) norm, round(n[1], 6) first_part, round(list_sum(n), 6) total FROM u")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", vec.scaled(F.col("embedding"), F.col("label") + 1).alias("e"))
    u = v.select("vec_id", F.sqrt(vec.dot(F.col("e"), F.col("e"))).alias("norm"), vec.normalized(F.col("e")).alias("n"))
    return u.select("vec_id", r6("norm"), F.round(F.col("n")[0], 6).alias("first_part"), F.round(vec.total(F.col("n")), 6).alias("total"))


@query("WITH " + TEXTS + " SELECT vec_id, class, round(list_inner_product(e, t), 6) cos FROM items, texts")
def dot_with_class_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = similarity.scores(table(spark, sf_dir, "embeddings"), texts(spark, sf_dir), 1.0, name="cos")
    return got.select("vec_id", "class", r6("cos"))


@query(f"SELECT label, (i - 1)::INT place, round(avg((embedding::DOUBLE[])[i]), 6) mean FROM embeddings, range(1, {DIM + 1}) t(i) GROUP BY ALL")
def class_mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = vec.mean_vector(table(spark, sf_dir, "embeddings"), ["label"], "embedding", DIM)
    return means.select("label", F.posexplode("mean").alias("place", "mean")).select("label", "place", r6("mean"))


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] e, list_reverse(embedding::DOUBLE[]) f FROM embeddings), m AS (SELECT vec_id, list_transform(list_zip(e, f), lambda x: (x[1] + x[2]) / 2) k FROM v), u AS (SELECT vec_id, " + unit_sql("k") + " k FROM m) SELECT vec_id, round(k[1], 6) first_part, round(list_sum(k), 6) total FROM u")
def view_mean_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = vec.normalized(vec.mean_of(F.array(F.transform("embedding", lambda x: x.cast("double")), F.transform(F.reverse("embedding"), lambda x: x.cast("double")))))
    return table(spark, sf_dir, "embeddings").select("vec_id", key.alias("k")).select("vec_id", F.round(F.col("k")[0], 6).alias("first_part"), F.round(vec.total(F.col("k")), 6).alias("total"))


@query("WITH " + TEXTS + f", d AS (SELECT label, i, avg(e[i]) m FROM pool, range(1, {DIM + 1}) t(i) GROUP BY ALL), dv AS (SELECT label class, list(m ORDER BY i) d FROM d GROUP BY 1), mx AS (SELECT class, list_transform(list_zip(d, t), lambda x: x[1] + 0.5e0 * x[2]) v FROM dv JOIN texts USING (class)), u AS (SELECT class, " + unit_sql("v") + f" v FROM mx) SELECT class, (i - 1)::INT place, round(v[i], 6) part FROM u, range(1, {DIM + 1}) t(i)")
def text_vector_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a class's descriptions plus half its template's vector, normalised."""
    d = vec.mean_vector(pool(spark, sf_dir), ["label"], "embedding", DIM)
    t = vec.mean_vector(support(spark, sf_dir, 8, 0), ["label"], "embedding", DIM, "t")
    mixed = d.join(t, "label").select(F.col("label").alias("class"), vec.normalized(vec.plus(F.col("mean"), vec.normalized(F.col("t")), 0.5)).alias("v"))
    return mixed.select("class", F.posexplode("v").alias("place", "part")).select("class", "place", r6("part"))


@query("WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: abs(x)) e FROM embeddings), s AS (SELECT vec_id, list_transform(e, lambda x: sqrt(x / list_sum(e))) s FROM v) SELECT vec_id, round(s[1], 6) first_part, round(list_inner_product(s, s), 6) squares FROM s")
def root_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "embeddings").select("vec_id", vec.rooted(F.transform("embedding", lambda x: F.abs(x.cast("double")))).alias("s"))
    return s.select("vec_id", F.round(F.col("s")[0], 6).alias("first_part"), F.round(vec.dot(F.col("s"), F.col("s")), 6).alias("squares"))


@query(f"WITH g AS (SELECT vec_id, vec_id % 37 g, embedding::DOUBLE[] e FROM embeddings), m AS (SELECT g, i, avg(e[i]) m FROM g, range(1, {DIM + 1}) t(i) GROUP BY ALL), mv AS (SELECT g, list(m ORDER BY i) m FROM m GROUP BY g), c AS (SELECT vec_id, g, list_transform(list_zip(e, m), lambda x: x[1] - x[2]) v FROM g JOIN mv USING (g)), u AS (SELECT vec_id, g, " + unit_sql("v") + " v FROM c) SELECT vec_id, g grp, round(v[1], 6) first_part, round(list_sum(v), 6) total FROM u")
def group_center_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").withColumn("grp", F.col("vec_id") % 37)
    centred = df.join(vec.mean_vector(df, ["grp"], "embedding", DIM), "grp").select("vec_id", "grp", vec.normalized(vec.plus(F.col("embedding"), F.col("mean"), -1.0)).alias("v"))
    return centred.select("vec_id", "grp", F.round(F.col("v")[0], 6).alias("first_part"), F.round(vec.total(F.col("v")), 6).alias("total"))


@query("WITH " + ITEMS + " SELECT t.vec_id, p.vec_id near_id, round(list_inner_product(t.e, p.e), 6) cos FROM test t, pool p QUALIFY row_number() OVER (PARTITION BY t.vec_id ORDER BY list_inner_product(t.e, p.e) DESC, p.vec_id) = 1")
def nn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.nearest(tests(spark, sf_dir), pool(spark, sf_dir)).select("vec_id", "near_id", r6("cos"))


# ---- duplicates and graphs
@query("SELECT md5(text) md5, count(*) n, min(doc_id) first_key FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def md5_exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.exact_copies(table(spark, sf_dir, "documents"))


@query("SELECT md5(text) md5, count(*) n, count(DISTINCT source) labels FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1")
def md5_label_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.label_conflicts(table(spark, sf_dir, "documents"), "source")


@query("WITH " + PAIRS + " SELECT a, b, round(cos, 6) cos FROM pairs WHERE same_class")
def cosine_pairs_same_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_pairs(table(spark, sf_dir, "embeddings"), SAME).select("a", "b", r6("cos"))


@query("WITH " + PAIRS + " SELECT a, b, round(cos, 4) cos, same_class FROM pairs")
def cosine_pairs_two_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_pairs(table(spark, sf_dir, "embeddings"), SAME, OTHER).select("a", "b", F.round("cos", 4).alias("cos"), "same_class")


VIEWS = "vw AS (SELECT vec_id * 3 id, embedding::DOUBLE[] e, label FROM embeddings UNION ALL SELECT vec_id * 3 + k, list_transform(list_zip(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), lambda x: x[1] + s * x[2]), label FROM embeddings, (VALUES (1, 0.3e0), (2, -0.3e0)) t(k, s)), u AS (SELECT id, label, " + unit_sql("e") + " e FROM vw)"


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, embedding, label: each item, and two altered views of it, as near copies."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"), "label")
    mixed = F.array(*[F.struct(F.lit(k).alias("k"), vec.normalized(vec.plus(F.col("e"), F.reverse("e"), w) if w else F.col("e")).alias("v")) for k, w in enumerate((0.0, 0.3, -0.3))])
    return e.select("vec_id", "label", F.explode(mixed).alias("m")).select((F.col("vec_id") * 3 + F.col("m.k")).alias("vec_id"), F.col("m.v").alias("embedding"), "label")


@query("WITH " + VIEWS + " SELECT x.id a, y.id b, round(list_inner_product(x.e, y.e), 4) cos, x.label IS NOT DISTINCT FROM y.label same_class FROM u x JOIN u y ON x.id < y.id WHERE list_inner_product(x.e, y.e) >= 0.8e0")
def hashed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all items and views of them by hash tables, each with a probability of 0.99999 or more."""
    return similarity.hashed_pairs(views(spark, sf_dir), 0.8, 0.8, recall=0.99999).select("a", "b", F.round("cos", 4).alias("cos"), "same_class")


@query("WITH RECURSIVE " + VIEWS + ", t AS (SELECT x.id a, y.id b FROM u x JOIN u y ON x.id <> y.id WHERE list_inner_product(x.e, y.e) >= 0.8e0), reach AS (SELECT id node, id root FROM u UNION SELECT t.b, reach.root FROM reach JOIN t ON t.a = reach.node) SELECT node, min(root) root FROM reach GROUP BY node")
def hashed_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies: components of the few links that hold them together."""
    v = views(spark, sf_dir)
    return graphs.components(similarity.hashed_pairs(v, 0.8, 0.8, recall=0.99999, forest=True), v.select(F.col("vec_id").alias("node")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_pairs(table(spark, sf_dir, "embeddings"), SAME, OTHER)


def component_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = similarity.similar_pairs(table(spark, sf_dir, "embeddings"), SAME, OTHER, forest=True)
    return graphs.components(links, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node")))


@query(COMPONENTS + " SELECT node, root FROM comp")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_table(spark, sf_dir)


@query(COMPONENTS + ", s AS (SELECT root, count(*) n FROM comp GROUP BY 1), l AS (SELECT root, count(DISTINCT label) k FROM comp JOIN embeddings ON vec_id = node GROUP BY 1) SELECT count(*) components, max(n) largest, count(*) FILTER (n = 1) single, count(*) FILTER (k > 1) mixed FROM s JOIN l USING (root)")
def component_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = component_table(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), "label"), "node")
    s = c.groupBy("root").agg(F.count("*").alias("n"), F.countDistinct("label").alias("k"))
    return s.agg(F.count("*").alias("components"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("k") > 1).alias("mixed"))


REMOVED = "h AS (SELECT doc_id, source, md5(text) m FROM documents), f AS (SELECT m, min(doc_id) first, count(DISTINCT source) k FROM h WHERE m IS NOT NULL GROUP BY 1), rem AS (SELECT doc_id, 0 p, 'unreadable' reason, NULL::BIGINT twin FROM h WHERE m IS NULL UNION ALL SELECT doc_id, 1, 'exact duplicate', first FROM h JOIN f USING (m) WHERE doc_id <> first UNION ALL SELECT doc_id, 3, 'label conflict', NULL FROM h JOIN f USING (m) WHERE k > 1), removed AS (SELECT doc_id, arg_min(reason, p) reason, arg_min(twin, p) FILTER (twin IS NOT NULL) kept_twin FROM rem GROUP BY 1)"


@query("WITH " + REMOVED + " SELECT doc_id, reason, kept_twin FROM removed")
def removal_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.removals(table(spark, sf_dir, "documents"), label="source")


@query("WITH " + REMOVED + ", k AS (SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM removed)), o AS (SELECT source, (row_number() OVER (ORDER BY min(doc_id)) - 1)::INT new_group FROM k GROUP BY 1) SELECT doc_id, lang, source, new_group FROM k JOIN o USING (source)")
def clean_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return curation.cleaned(docs, curation.removals(docs, label="source"), "source").select("doc_id", "lang", "source", "new_group")


@query("WITH " + REMOVED + " SELECT reason, count(*) n FROM removed GROUP BY 1")
def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.removals(table(spark, sf_dir, "documents"), label="source").groupBy("reason").agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT lang, count(*) files, count(DISTINCT md5(text)) contents, count(DISTINCT source) groups FROM documents GROUP BY 1) SELECT * FROM a UNION ALL SELECT 'TOTAL', sum(files)::BIGINT, sum(contents)::BIGINT, sum(groups)::BIGINT FROM a")
def audit_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.audit(table(spark, sf_dir, "documents").withColumn("m", F.md5(F.col("text").cast("binary"))), "lang", "m", "source")


@query()
def linkage_in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters of linkage_clusters, with no class in one task."""
    return linkage.linkage_in_rounds(table(spark, sf_dir, "embeddings"), SAME)


@query()
def linkage_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.clusters(table(spark, sf_dir, "embeddings"), SAME)


@query()
def louvain_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    return communities.communities(df.select("label", F.col("vec_id").alias("node")), class_edges(df))


def class_edges(df: DataFrame) -> DataFrame:
    return similarity.similar_pairs(df, 0.25).join(df.select(F.col("vec_id").alias("a"), "label"), "a").select("label", "a", "b", F.col("cos").alias("weight"))


@query()
def louvain_in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of each class by blocks of nodes and rounds of moves, with no task that has more than a block."""
    df = table(spark, sf_dir, "embeddings")
    return communities.communities_in_rounds(df.select("label", F.col("vec_id").alias("node")), class_edges(df))


@query()
def keypoint_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight keypoints to an item, cut from its vector, matched and checked for its pairs."""
    part = lambda i, n: F.transform(F.slice("embedding", i * 8 + 1, n), lambda x: x.cast("double"))
    k = table(spark, sf_dir, "embeddings").select("*", F.array(*[part(i, 2) for i in range(8)]).alias("xy"), F.array(*[vec.normalized(part(i, 8)) for i in range(8)]).alias("desc"))
    return similarity.verified_pairs(k, SAME, OTHER, least=4, ratio=0.95)


# ---- splits
@query("WITH " + ITEMS + " SELECT vec_id, label, split FROM items")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("vec_id", "label", "split")


@query("WITH " + ITEMS + ", " + support_sql("sup", 4, 1) + " SELECT vec_id, label FROM sup")
def support_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return support(spark, sf_dir).select("vec_id", "label")


@query("WITH " + ITEMS + ", " + ", ".join(support_sql(f"s{k}_{s}", k, s) for k in (1, 2, 4, 8) for s in (1, 2, 3)) + " " + " UNION ALL ".join(f"SELECT {k} k, {s} seed, vec_id, label FROM s{k}_{s}" for k in (1, 2, 4, 8) for s in (1, 2, 3)))
def support_all_k_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("seed")) for k in (1, 2, 4, 8) for s in (1, 2, 3)]))
    p = pool(spark, sf_dir).select("vec_id", "label", draws.alias("d")).select("vec_id", "label", "d.*")
    w = Window.partitionBy("k", "seed", "label").orderBy(splits.draw(F.concat_ws(".", "k", "seed"), "vec_id"), "vec_id")
    return p.withColumn("n", F.row_number().over(w)).filter("n <= k").select("k", "seed", "vec_id", "label")


@query("WITH " + ITEMS + ", " + support_sql("sup", 4, 1) + f", v AS (SELECT * FROM pool WHERE vec_id NOT IN (SELECT vec_id FROM sup)), l AS (SELECT DISTINCT v.vec_id FROM v, sup WHERE list_inner_product(v.e, sup.e) >= {SAME}) SELECT vec_id, label FROM v WHERE vec_id NOT IN (SELECT vec_id FROM l)")
def val_without_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = support(spark, sf_dir)
    rest = pool(spark, sf_dir).join(s.select("vec_id"), "vec_id", "left_anti")
    return splits.without_links(rest, s, None, SAME).select("vec_id", "label")


@query("WITH " + ITEMS + ", g AS (SELECT DISTINCT vec_id % 37 grp FROM pool), c AS (SELECT grp, row_number() OVER (ORDER BY md5(concat_ws('|', '9001', grp::VARCHAR)), grp) n, count(*) OVER () t FROM g) SELECT vec_id, vec_id % 37 grp, n <= t // 5 AS held FROM pool JOIN c ON c.grp = vec_id % 37")
def full_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.hold_out_groups(pool(spark, sf_dir).withColumn("grp", F.col("vec_id") % 37), 5, "9001", "grp").select("vec_id", "grp", "held")


@query("WITH " + ITEMS + f" SELECT vec_id, label FROM test WHERE vec_id NOT IN (SELECT t.vec_id FROM test t, pool p WHERE list_inner_product(t.e, p.e) >= {SAME})")
def purged_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.without_links(tests(spark, sf_dir), pool(spark, sf_dir), None, SAME).select("vec_id", "label")


@query("WITH " + ITEMS + ", x AS (SELECT count(DISTINCT vec_id) n FROM pool WHERE vec_id IN (SELECT vec_id FROM test)), y AS (SELECT count(*) n FROM (SELECT DISTINCT label FROM items) l WHERE label NOT IN (SELECT label FROM pool) OR label NOT IN (SELECT label FROM test)) SELECT 'shared_groups' \"check\", n FROM x UNION ALL SELECT 'missing_classes', n FROM y")
def leak_check_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.violations(pool(spark, sf_dir), tests(spark, sf_dir), "vec_id")


@query("WITH " + ITEMS + " SELECT label, count(*) FILTER (split = 'pool') pool_items, count(DISTINCT CASE WHEN split = 'pool' THEN vec_id % 37 END) pool_groups, count(*) FILTER (split = 'test') test_items, round(avg((vec_id % 3 = 0)::INT) FILTER (split = 'pool'), 6) pool_share, round(avg((vec_id % 3 = 0)::INT) FILTER (split = 'test'), 6) test_share FROM items GROUP BY label")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_pool, third = F.col("split") == "pool", (F.col("vec_id") % 3 == 0).cast("double")
    return items(spark, sf_dir).groupBy("label").agg(
        F.count_if(in_pool).alias("pool_items"), F.countDistinct(F.when(in_pool, F.col("vec_id") % 37)).alias("pool_groups"), F.count_if(~in_pool).alias("test_items"),
        F.round(F.avg(F.when(in_pool, third)), 6).alias("pool_share"), F.round(F.avg(F.when(~in_pool, third)), 6).alias("test_share"),
    )


@query("WITH " + ITEMS + " SELECT vec_id, (row_number() OVER (ORDER BY md5(concat_ws('|', 'half', grp::VARCHAR)), grp) <= count(*) OVER () // 2) tune FROM (SELECT vec_id, vec_id grp FROM pool)")
def validation_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.hold_out_groups(pool(spark, sf_dir), 2, "half", "vec_id").select("vec_id", F.col("held").alias("tune"))


# ---- classifiers
@query("WITH " + PROBS + " SELECT vec_id, class, round(z, 6) z, round(p, 6) p FROM p")
def zero_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.softmax(zero_shot_scores(spark, sf_dir)).select("vec_id", "class", r6("z"), r6("p"))


@query()
def probe_whole_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear probe with all pool rows as support, a fifth of them held out for the penalty; classes of all test rows."""
    split = splits.stratified(pool(spark, sf_dir), 0.8, "probe")
    w, c = probe.fit_tuned(split.filter("split = 'pool'"), split.filter("split = 'test'"), 10)
    return probe.predict(tests(spark, sf_dir), w).select("vec_id", "pred", r6("conf"), F.lit(c).alias("c"))


@query("WITH " + CACHE + " SELECT vec_id, class, round(z, 6) z FROM zc")
def cache_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.cache_scores(tests(spark, sf_dir), support_rows(spark, sf_dir)).select("vec_id", "class", r6("z"))


@query("WITH " + CACHE + ", f AS (SELECT vec_id, label, class, 100 * list_inner_product(q.e, t.t) + 2e0 * zc.z z FROM test q JOIN zc USING (vec_id, label) JOIN texts t USING (class)), b AS (SELECT vec_id, label, class pred FROM f QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, class) = 1) SELECT vec_id, label, pred FROM b")
def few_shot_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = similarity.score_parts(tests(spark, sf_dir), texts(spark, sf_dir), support_rows(spark, sf_dir)).withColumn("z", F.col("text") + 2e0 * F.col("cache"))
    return labelled(evaluation.predicted(both), spark, sf_dir).select("vec_id", "label", "pred")


GRID = CACHE.replace("exp(-5e0 *", "exp(-b.b *").replace("FROM test q, sup s JOIN cn ON cn.class = s.label", "FROM valid q, (SELECT unnest([1e0, 5e0, 9e0]) b) b, sup s JOIN cn ON cn.class = s.label").replace("s.label class, sum", "s.label class, b.b b, sum")


@query("WITH " + GRID.replace(", cn AS", ", valid AS (SELECT * FROM pool WHERE vec_id NOT IN (SELECT vec_id FROM sup)), cn AS") + ", w AS (SELECT unnest([0.5e0, 2e0, 8e0]) a), f AS (SELECT zc.vec_id, zc.label, class, a, b, 100 * list_inner_product(q.e, t) + a * zc.z z FROM zc JOIN valid q USING (vec_id) JOIN texts USING (class), w), p AS (SELECT a, b, label, class pred FROM f QUALIFY row_number() OVER (PARTITION BY vec_id, a, b ORDER BY z DESC, class) = 1) SELECT a, b, count(*) n, round(avg((label = pred)::INT), 6) acc FROM p GROUP BY ALL")
def cache_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy on validation of each weight and sharpness of the cache."""
    s = support(spark, sf_dir)
    valid = pool(spark, sf_dir).join(s.select("vec_id"), "vec_id", "left_anti")
    rows, parts = support_rows(spark, sf_dir), None
    for b in (1.0, 5.0, 9.0):
        x = similarity.score_parts(valid, texts(spark, sf_dir), rows, b).withColumn("b", F.lit(b))
        parts = x if parts is None else parts.union(x)
    all_z = parts.withColumnsRenamed({"text": "z", "cache": "c"}).withColumn("a", F.explode(F.array(F.lit(0.5), F.lit(2.0), F.lit(8.0)))).withColumn("z", F.col("z") + F.col("a") * F.col("c"))
    best = all_z.groupBy("vec_id", "a", "b").agg(F.max(F.struct("z", (-F.col("class")).alias("c"))).alias("m")).select("vec_id", "a", "b", (-F.col("m.c")).alias("pred"))
    return labelled(best, spark, sf_dir).groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("pred")).cast("double")), 6).alias("acc"))


@query("WITH " + CACHE + ", z2 AS (SELECT q.vec_id, s.label class, sum(exp(-5e0 * (1 - list_inner_product(list_reverse(q.e)[1:32], list_reverse(s.e)[1:32])))) / any_value(n) z FROM test q, sup s JOIN cn ON cn.class = s.label GROUP BY ALL) SELECT vec_id, class, round(100 * list_inner_product(q.e, t) + 2e0 * zc.z + 1e0 * z2.z, 6) z FROM test q JOIN zc USING (vec_id) JOIN z2 USING (vec_id, class) JOIN texts USING (class)")
def two_cache_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-shot plus the caches of two backbones; the second is the reversed vector's first half."""
    t, rows = tests(spark, sf_dir), support_rows(spark, sf_dir, second=True)
    rows = rows.assign(vec=[x[:32] for x in rows["vec"]])
    half = t.withColumn("embedding", F.slice(F.reverse("embedding"), 1, 32))
    z = similarity.scores(t, texts(spark, sf_dir)).join(similarity.cache_scores(t, support_rows(spark, sf_dir), name="c"), ["vec_id", "class"]).join(similarity.cache_scores(half, rows, name="d"), ["vec_id", "class"])
    return z.select("vec_id", "class", F.round(F.col("z") + 2e0 * F.col("c") + F.col("d"), 6).alias("z"))


@query("WITH " + ITEMS + " SELECT t.vec_id, t.label, p.label pred FROM test t, pool p QUALIFY row_number() OVER (PARTITION BY t.vec_id ORDER BY list_inner_product(t.e, p.e) DESC, p.vec_id) = 1")
def one_nn_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = similarity.nearest(tests(spark, sf_dir), pool(spark, sf_dir), carry="label")
    return labelled(got, spark, sf_dir).select("vec_id", "label", F.col("near_label").alias("pred"))


@query("WITH " + ITEMS + ", h AS (SELECT vec_id, e, label, CASE WHEN (vec_id % 37) % 5 = 0 THEN 'pool' ELSE 'test' END g FROM items), a AS (SELECT 'random' split, t.label, p.label pred FROM test t, pool p QUALIFY row_number() OVER (PARTITION BY t.vec_id ORDER BY list_inner_product(t.e, p.e) DESC, p.vec_id) = 1), b AS (SELECT 'grouped' split, t.label, p.label pred FROM h t, h p WHERE t.g = 'test' AND p.g = 'pool' QUALIFY row_number() OVER (PARTITION BY t.vec_id ORDER BY list_inner_product(t.e, p.e) DESC, p.vec_id) = 1) SELECT split, count(*) n, round(avg((label = pred)::INT), 6) acc FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1")
def leakage_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the nearest neighbour on a split by group and on a random one."""
    df = table(spark, sf_dir, "embeddings")
    mine = (F.col("vec_id") % 37) % 5 == 0
    out = None
    for name, p, t in (("random", pool(spark, sf_dir), tests(spark, sf_dir)), ("grouped", df.filter(mine), df.filter(~mine))):
        got = labelled(similarity.nearest(t, p, carry="label"), spark, sf_dir)
        row = got.agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("near_label")).cast("double")), 6).alias("acc")).select(F.lit(name).alias("split"), "n", "acc")
        out = row if out is None else out.union(row)
    return out


@query("WITH " + ITEMS + ", s AS (SELECT * FROM pool), cn AS (SELECT label class, count(*) n FROM s GROUP BY 1), z AS (SELECT q.vec_id, s.label class, sum(exp(-5e0 * (1 - list_inner_product(q.e, s.e)))) z FROM test q, s GROUP BY ALL) SELECT vec_id, class, round(z, 6) summed, round(z / n, 6) balanced FROM z JOIN cn USING (class)")
def balanced_vs_onehot_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t = pool(spark, sf_dir), tests(spark, sf_dir)
    if not similarity.fits(p):
        return similarity.cache_scores_in_blocks(t, p).select("vec_id", "class", r6("summed"), r6("balanced"))
    rows = similarity.held(p.select("vec_id", "label", F.col("embedding").alias("vec")), "vec_id", "label", "vec")
    counts = p.groupBy(F.col("label").cast("int").alias("class")).agg(F.count("*").alias("n"))
    both = similarity.cache_scores(t, rows, balanced=False, name="summed").join(F.broadcast(counts), "class").withColumn("balanced", F.col("summed") / F.col("n"))
    return both.select("vec_id", "class", r6("summed"), r6("balanced"))


@query("WITH " + ITEMS + " SELECT t.vec_id, round(max(list_inner_product(t.e, p.e)) FILTER (p.label < 5) - max(list_inner_product(t.e, p.e)) FILTER (p.label >= 5), 6) margin FROM test t, pool p GROUP BY 1")
def prototype_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearness to the positives' nearest (classes below 5) less that to the negatives'."""
    t, p = tests(spark, sf_dir), pool(spark, sf_dir)
    pos, neg = similarity.nearest(t, p.filter("label < 5")), similarity.nearest(t, p.filter("label >= 5")).withColumnRenamed("cos", "neg")
    return pos.join(neg.select("vec_id", "neg"), "vec_id").select("vec_id", F.round(F.col("cos") - F.col("neg"), 6).alias("margin"))


@query("WITH " + ITEMS + " SELECT label, count(*) n, round(1e0 / greatest(1, count(*)), 6) weight FROM pool GROUP BY 1")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.round(1e0 / F.greatest(F.lit(1), F.count("*")), 6).alias("weight"))


#: Rows of a validation set that the driver has at once at most: options are judged on all of a larger one in tasks.
TUNED_ON = 50_000


def tuning(spark: SparkSession, sf_dir: str, s: DataFrame) -> DataFrame:
    """The pool without the support set: what methods are tuned on, all of it."""
    return pool(spark, sf_dir).join(s.select("vec_id"), "vec_id", "left_anti")


def fitted(spark: SparkSession, sf_dir: str, name: str, k: int = 4, seed: int = 1) -> classifiers.Method:
    t = texts(spark, sf_dir).sort_values("class")
    s = support(spark, sf_dir, k, seed)
    valid = tuning(spark, sf_dir, s)
    twice = lambda df: classifiers.batch(df.withColumn("second", F.reverse("embedding")), second="second")
    few = valid.limit(TUNED_ON + 1).count() <= TUNED_ON
    return classifiers.METHODS[name](np.stack(t["vec"].to_list())).fit(twice(s), twice(valid) if few else judge(valid, len(t), seen, SEEN))


def method_query(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = tests(spark, sf_dir).withColumn("second", F.reverse("embedding"))
        return classifiers.predict(t, fitted(spark, sf_dir, name), second="second").select("vec_id", "pred", F.round(F.array_max("probs"), 6).alias("conf"))

    run.__name__ = f"method_{name}"
    query()(run)


for _name in ("linear_probe", "trained_cache", "two_caches", "task_residual", "feature_adapter", "class_adaptive", "text_graph"):
    method_query(_name)


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings), n AS (SELECT vec_id, i, e[i * 16 - 15:i * 16] v FROM v, range(1, 5) t(i) UNION ALL SELECT vec_id, 0, list_transform(range(1, 17), lambda k: (e[k] + e[k + 16] + e[k + 32] + e[k + 48]) / 4) FROM v), r AS (SELECT a.vec_id, a.i, b.v, list_inner_product(a.v, b.v) d FROM n a JOIN n b USING (vec_id)), x AS (SELECT vec_id, i, v, exp(CASE WHEN d > 0 THEN d ELSE 0.2e0 * d END) x FROM r), w AS (SELECT vec_id, i, v, x / sum(x) OVER (PARTITION BY vec_id, i) a FROM x), m AS (SELECT vec_id, i, k, sum(a * v[k]) m FROM w, range(1, 17) t(k) GROUP BY ALL), z AS (SELECT vec_id, i, k, m + v[k] z FROM m JOIN n USING (vec_id, i)), h AS (SELECT vec_id, i, k, (z - avg(z) OVER p) / sqrt(var_pop(z) OVER p + 1e-5) h FROM z WINDOW p AS (PARTITION BY vec_id, i)), q AS (SELECT vec_id, i, exp(h) q FROM h WHERE k = 1), s AS (SELECT vec_id, i, q / sum(q) OVER (PARTITION BY vec_id) s FROM q), o AS (SELECT vec_id, k, avg(h) a, max(h) b, sum(s * h) c FROM h JOIN s USING (vec_id, i) GROUP BY ALL) SELECT vec_id, round(sqrt(sum(a * a)), 6) mean_norm, round(sqrt(sum(b * b)), 6) max_norm, round(sqrt(sum(c * c)), 6) asked_norm FROM o GROUP BY 1")
def gated_graph_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item as a graph of its whole and four regions (its vector's quarters) through one round of attention by
    cosine, then pooled: the network's own code with plain parameters, so that SQL can say the same."""
    net = graphnet.Network(16, hidden=16, rounds=1, heads=1, gated=False, placed=False)
    plain = {k: np.zeros_like(v) for k, v in net.start(np.random.default_rng(0)).items()}
    plain |= {"enter": np.eye(16), "0.0.value": np.eye(16), "0.0.relation": np.eye(4)[:, 3:], "0.gain": np.ones(16), "ask": np.eye(16)[:, :1]}

    def run(pdfs):
        p = graphmethods.leaves(plain)
        for pdf in pdfs:
            v = np.stack(pdf["embedding"].to_list()).astype(float).reshape(-1, 4, 16)
            nodes = graphnet.Nodes.side_by_side([graphnet.Nodes.alike(v.mean(1, keepdims=True), graphnet.WHOLE), graphnet.Nodes.alike(v, graphnet.INSTANCE)])
            out = graphnet.pooled(net.states(p, nodes), nodes.live, p["ask"]).value.reshape(len(v), 3, 16)
            norms = np.linalg.norm(out, axis=2).round(6)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "mean_norm": norms[:, 0], "max_norm": norms[:, 1], "asked_norm": norms[:, 2]})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id bigint, mean_norm double, max_norm double, asked_norm double")


@query("WITH v(variant, hidden, texts, gated, placed) AS (VALUES " + ", ".join(f"('{n}', {o.get('hidden', 256)}, {int(o.get('texts', True))}, {int(o.get('gated', True))}, {int(o.get('placed', True))})" for n, o in (graphmethods.ABLATIONS | graphmethods.CANDIDATES).items()) + f") SELECT variant, ({DIM} * hidden + 5 * hidden + hidden + placed * (5 * hidden + hidden * hidden) + 2 * (hidden * hidden + 2 * hidden + 16 + gated * (2 * hidden * hidden + hidden) + 2 * hidden) + 3 * hidden * {DIM} + 2 + texts * (hidden * {DIM} + 1))::BIGINT params FROM v")
def variant_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ablations and candidates of the region graph, and how many values each trains."""
    text = np.zeros((10, DIM))
    rows = [(n, graphmethods.RegionGraph(text, **o).size) for n, o in (graphmethods.ABLATIONS | graphmethods.CANDIDATES).items()]
    return spark.createDataFrame(rows, "variant string, params bigint")


def parts(pdf: pd.DataFrame) -> graphmethods.Parts:
    """Items with four regions: their vectors' quarters, at places and of kinds cut from the vector."""
    x = np.stack(pdf["embedding"].to_list()).astype(float)
    nodes = np.zeros((len(x), 4, DIM))
    for i in range(4):
        nodes[:, i, i * 16 : i * 16 + 16] = x[:, i * 16 : i * 16 + 16]
    box = np.abs(x[:, :20]).reshape(-1, 4, 5)
    kinds = np.broadcast_to(np.array([1.0, 2, 3, 2])[:, None], (len(x), 4, 1))
    return graphmethods.Parts(x, pdf["label"].to_numpy(int), classifiers.unit(nodes), np.ones((len(x), 4)), np.concatenate([box, kinds], -1), x[:, ::-1])


def seen(pdf: pd.DataFrame) -> classifiers.Batch:
    """Items with their vectors, and reversed ones as the second backbone's."""
    x = np.stack(pdf["embedding"].to_list()).astype(float)
    return classifiers.Batch(x, pdf["label"].to_numpy(int), x[:, ::-1])


#: Items of a task that judges options or predicts by graphs of an item's parts: some seconds of work; that judges options
#: by vectors alone, and of those the items at once.
JUDGED, GRAPHS, SEEN, SLICE = 512, 4096, 16_384, 2048


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """df in tasks of about so many rows: how many tasks there are follows from the work, not from the bytes of its files."""
    return df.repartition(max(1, -(-df.count() // rows)), "vec_id")


def judge(valid: DataFrame, classes: int, read: Callable = parts, rows: int | None = None) -> classifiers.Judge:
    """Macro-F1 of options on a table: its tasks, of about so many rows that read makes items of, count for all options at
    once, and only counts come to the driver."""
    table_of = dealt(graphs.written(valid.select("vec_id", "embedding", "label"), "validation"), rows or JUDGED)
    most = min(rows or JUDGED, SLICE)

    def score(answers: Callable) -> np.ndarray | None:
        def count(pdfs):
            total = None
            for pdf in pdfs:
                for i in range(0, len(pdf), most):
                    x = read(pdf.iloc[i : i + most])
                    own = classifiers.counted(answers(x), x.y, classes)
                    total = own if total is None else total + own
            if total is not None:
                n, c = (i.ravel() for i in np.indices(total.shape[:2]))
                yield pd.DataFrame({"n": n, "c": c, "hits": total[n, c, 0], "all_of": total[n, c, 1]})

        summed = table_of.mapInPandas(count, "n int, c int, hits bigint, all_of bigint").groupBy("n", "c").agg(F.sum("hits").alias("hits"), F.sum("all_of").alias("all_of")).toPandas()
        if summed.empty:
            return None
        counts = np.zeros((summed["n"].max() + 1, classes, 2), np.int64)
        counts[summed["n"], summed["c"]] = summed[["hits", "all_of"]]
        return classifiers.f1_of(counts)

    return score


def graph_method(name: str, make: Callable[[np.ndarray], graphmethods.RegionGraph | graphmethods.PatchGraph]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t, s = texts(spark, sf_dir).sort_values("class"), support(spark, sf_dir)
        few = parts(similarity.held(s, "vec_id", "embedding", "label").sort_values("vec_id"))
        method = spark.sparkContext.broadcast(make(np.stack(t["vec"].to_list())).fit(few, judge(tuning(spark, sf_dir, s), len(t))))

        def predict(pdfs):
            for pdf in pdfs:
                if len(pdf):
                    p = graphmethods.probabilities(method.value, parts(pdf))
                    yield pd.DataFrame({"vec_id": pdf["vec_id"], "pred": p.argmax(1), "conf": p.max(1).round(6)})

        rows = dealt(tests(spark, sf_dir).select("vec_id", "embedding", "label"), GRAPHS)
        return rows.mapInPandas(predict, "vec_id bigint, pred int, conf double")

    run.__name__ = f"method_{name}"
    query()(run)


graph_method("region_graph", lambda t: graphmethods.RegionGraph(t))
graph_method("region_graph_two_caches", lambda t: graphmethods.RegionGraph(t, second=True))
graph_method("patch_graph", lambda t: graphmethods.PatchGraph(t))


@query("WITH " + ITEMS + ", m AS (SELECT t.vec_id, t.label < 5 pos, max(list_inner_product(t.e, p.e)) FILTER (p.label < 5) - max(list_inner_product(t.e, p.e)) FILTER (p.label >= 5) m FROM test t, pool p GROUP BY ALL), g AS (SELECT unnest(quantile_cont(m, [0.1, 0.3, 0.5, 0.7, 0.9])) t, unnest([10, 30, 50, 70, 90]) pct FROM m), s AS (SELECT pct, t, count(*) FILTER (pos AND m >= t) tp, count(*) FILTER (NOT pos AND m >= t) fp, count(*) FILTER (pos AND m < t) fn, count(*) FILTER (NOT pos AND m < t) tn FROM m, g GROUP BY ALL) SELECT pct, round(t, 6) threshold, round((2 * tp / (2 * tp + fp + fn)::DOUBLE + 2 * tn / (2 * tn + fp + fn)::DOUBLE) / 2, 6) macro_f1 FROM s")
def threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro-F1 of calling margins from a quantile on positive."""
    t, p = tests(spark, sf_dir), pool(spark, sf_dir)
    pos, neg = similarity.nearest(t, p.filter("label < 5")), similarity.nearest(t, p.filter("label >= 5")).withColumnRenamed("cos", "neg")
    m = labelled(pos.join(neg.select("vec_id", "neg"), "vec_id"), spark, sf_dir).select((F.col("label") < 5).alias("pos"), (F.col("cos") - F.col("neg")).alias("m"))
    shares = (10, 30, 50, 70, 90)
    m = graphs.written(m, "margins")
    levels = ordering.quantiles(m, "m", [x / 100 for x in shares]).drop("n").first()
    options = m.withColumn("o", F.explode(F.array(*[F.struct(F.lit(i).alias("pct"), F.lit(v).alias("t")) for i, v in zip(shares, levels)])))
    hit = F.col("m") >= F.col("o.t")
    s = options.groupBy("o.pct", "o.t").agg(F.count_if(F.col("pos") & hit).alias("tp"), F.count_if(~F.col("pos") & hit).alias("fp"), F.count_if(F.col("pos") & ~hit).alias("fn"), F.count_if(~F.col("pos") & ~hit).alias("tn"))
    f1 = lambda a: 2 * F.col(a) / (2 * F.col(a) + F.col("fp") + F.col("fn"))
    return s.select("pct", r6("t", "threshold"), F.round((f1("tp") + f1("tn")) / 2, 6).alias("macro_f1"))


@query("WITH " + PRED + ", o AS (SELECT vec_id // 10 photo, pred, conf FROM pr) SELECT photo, pred, count(*) n, count(*) FILTER (conf < 0.5e0) unsure, round(count(*) / sum(count(*)) OVER (PARTITION BY photo)::DOUBLE, 6) share FROM o GROUP BY photo, pred")
def crowded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of one picture (ten neighbouring items) counted by predicted class."""
    o = zero_shot_predictions(spark, sf_dir).withColumn("photo", F.floor(F.col("vec_id") / 10))
    c = o.groupBy("photo", "pred").agg(F.count("*").alias("n"), F.count_if(F.col("conf") < 0.5).alias("unsure"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("photo")), 6))


# ---- evaluation
@query("WITH " + CELLS + " SELECT truth, pred, n, round(n / nullif(sum(n) OVER (PARTITION BY truth), 0)::DOUBLE, 6) share FROM cells")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(zero_shot_predictions(spark, sf_dir), 10).select("truth", "pred", "n", r6("share"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(zero_shot_predictions(spark, sf_dir), 10)


@query("WITH " + METRICS + " SELECT class, tp, fp, fn, round(\"precision\", 6) \"precision\", round(recall, 6) recall, round(f1, 6) f1 FROM cm")
def per_class_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.class_metrics(cells(spark, sf_dir)).select("class", "tp", "fp", "fn", r6("precision"), r6("recall"), r6("f1"))


@query("WITH " + METRICS + " SELECT round(sum(tp) / sum(tp + fn)::DOUBLE, 6) acc, round(avg(f1), 6) macro_f1, round(avg(\"precision\"), 6) macro_precision, round(avg(recall), 6) macro_recall FROM cm")
def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary(cells(spark, sf_dir)).select(*[r6(c) for c in ("acc", "macro_f1", "macro_precision", "macro_recall")])


@query("WITH " + ZERO + ", g AS (SELECT class, z, sum((label = class)::INT) pos, count(*) n FROM z GROUP BY ALL), k AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY class ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2e0 rk FROM g) SELECT class, round((sum(rk * pos) - sum(pos) * (sum(pos) + 1) / 2e0) / nullif(sum(pos) * sum(n - pos), 0)::DOUBLE, 6) auroc FROM k GROUP BY 1")
def auroc_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.auroc(labelled(zero_shot_scores(spark, sf_dir), spark, sf_dir)).select("class", r6("auroc"))


@query("WITH " + PRED + ", b AS (SELECT ceil(conf * 10)::INT bin, count(*) n, avg(right_::INT) acc, avg(conf) mc FROM pr WHERE conf > 0 GROUP BY 1) SELECT round(sum(n * abs(acc - mc)) / (SELECT count(*) FROM pr), 6) ece FROM b")
def ece_10bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.ece(zero_shot_predictions(spark, sf_dir)).select(r6("ece"))


@query("WITH " + PRED + ", b AS (SELECT ceil(conf * 10)::INT bin, count(*) n, avg(right_::INT) acc, avg(conf) mc FROM pr WHERE conf > 0 GROUP BY 1) SELECT bin, n, round(acc, 6) acc, round(mc, 6) mean_conf FROM b")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.calibration_bins(zero_shot_predictions(spark, sf_dir)).select("bin", "n", r6("acc"), r6("mean_conf"))


@query("WITH " + PRED + ", g AS (SELECT (50 + range) / 100e0 t FROM range(50)), k AS (SELECT t, count(*) n, avg(right_::INT) acc FROM g JOIN pr ON conf >= t GROUP BY 1 HAVING count(*) >= 10 AND avg(right_::INT) >= 0.05e0) SELECT min(t) threshold FROM k")
def unsure_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.unsure_below(zero_shot_predictions(spark, sf_dir), 0.05)


@query("WITH " + ZERO + ", g AS (SELECT unnest([0.5e0, 1e0, 2e0, 4e0, 8e0, 16e0]) tau), m AS (SELECT tau, vec_id, max(z) top, max(z) FILTER (class = label) own FROM z, g GROUP BY ALL), s AS (SELECT tau, z.vec_id, ln(sum(exp((z - top) / tau))) - any_value((own - top) / tau) nll FROM z JOIN m USING (vec_id) GROUP BY ALL) SELECT tau, round(avg(nll), 6) nll FROM s GROUP BY 1")
def temperature_grid_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.temperature_grid(labelled(zero_shot_scores(spark, sf_dir), spark, sf_dir), [0.5, 1.0, 2.0, 4.0, 8.0, 16.0]).select("tau", r6("nll"))


@query()
def calibration_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature and class biases fitted on the pool."""
    z = labelled(zero_shot_scores(spark, sf_dir, pool(spark, sf_dir)), spark, sf_dir)
    tau, bias = evaluation.fit_calibration(z, 10)
    return spark.createDataFrame(pd.DataFrame({"class": np.arange(len(bias)), "tau": tau, "bias": bias}))


@query("SELECT round(quantile_cont(value, 0.05), 6) q05, round(quantile_cont(value, 0.5), 6) q50, round(quantile_cont(value, 0.95), 6) q95, round(quantile_cont(value, 0.99), 6) q99 FROM events")
def quantiles_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ordering.quantiles(table(spark, sf_dir, "events"), "value", [0.05, 0.5, 0.95, 0.99])
    return got.select(*[r6(f"q{i}", n) for i, n in enumerate(("q05", "q50", "q95", "q99"))])


@query("SELECT count(value) n, round(avg(value), 6) mean, round(stddev_samp(value), 6) std, round(min(value), 6) lo, round(quantile_cont(value, 0.25), 6) q25, round(quantile_cont(value, 0.5), 6) q50, round(quantile_cont(value, 0.75), 6) q75, round(max(value), 6) hi FROM events")
def described_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reports.described(table(spark, sf_dir, "events"), "value")
    return d.select("n", *[r6(c) for c in ("mean", "std", "lo", "q25", "q50", "q75", "hi")])


@query("SELECT round(avg((value >= 50)::INT), 6) share FROM events")
def share_over_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.round(F.avg((F.col("value") >= 50).cast("double")), 6).alias("share"))


@query("WITH " + PRED + ", nn AS (SELECT t.vec_id, p.label pred FROM test t, pool p QUALIFY row_number() OVER (PARTITION BY t.vec_id ORDER BY list_inner_product(t.e, p.e) DESC, p.vec_id) = 1) SELECT vec_id, pr.pred = label AS zero_shot, nn.pred = label AS one_nn, (pr.pred = label)::INT + (nn.pred = label)::INT n_right FROM pr JOIN nn USING (vec_id)")
def model_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.agreement([("zero_shot", zero_shot_predictions(spark, sf_dir)), ("one_nn", one_nn_classify(spark, sf_dir))], table(spark, sf_dir, "embeddings"))


@query("WITH " + PRED + " SELECT vec_id, label, pred, right_ AS \"right\", round(conf, 6) conf FROM pr QUALIFY row_number() OVER (PARTITION BY label, right_ ORDER BY conf DESC, vec_id) <= CASE WHEN right_ THEN 3 ELSE 1 END")
def class_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.examples(zero_shot_predictions(spark, sf_dir)).select("vec_id", "label", "pred", "right", r6("conf"))


# ---- explanations
@query("WITH " + CACHE + ", pa AS (SELECT vec_id, class, 100 * list_inner_product(q.e, t) text_part, 2e0 * zc.z cache_part FROM test q JOIN zc USING (vec_id) JOIN texts USING (class)) SELECT vec_id, class, round(text_part, 6) text_part, round(cache_part, 6) cache_part, round(text_part + cache_part, 6) z, round(text_part - avg(text_part) OVER (PARTITION BY vec_id), 6) text_centred FROM pa")
def score_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score as the sum of its parts, and a part less its mean over the classes."""
    both = similarity.score_parts(tests(spark, sf_dir), texts(spark, sf_dir), support_rows(spark, sf_dir)).select("vec_id", "class", F.col("text").alias("text_part"), (2e0 * F.col("cache")).alias("cache_part"))
    centred = F.col("text_part") - F.avg("text_part").over(Window.partitionBy("vec_id"))
    return both.select("vec_id", "class", r6("text_part"), r6("cache_part"), F.round(F.col("text_part") + F.col("cache_part"), 6).alias("z"), F.round(centred, 6).alias("text_centred"))


@query("WITH " + ZERO + ", k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, class) n FROM z) SELECT a.vec_id, a.class pred, round(a.z - b.z, 6) margin FROM k a JOIN k b ON a.vec_id = b.vec_id AND a.n = 1 AND b.n = 2")
def top2_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.margins(zero_shot_scores(spark, sf_dir)).select("vec_id", "pred", r6("margin"))


@query("WITH " + ITEMS + ", " + support_sql("sup", 4, 1) + ", v AS (SELECT * FROM pool WHERE vec_id NOT IN (SELECT vec_id FROM sup)), lim AS (SELECT quantile_cont(m, 0.05) t FROM (SELECT max(list_inner_product(v.e, sup.e)) m FROM v, sup GROUP BY v.vec_id)), f AS (SELECT q.vec_id, max(list_inner_product(q.e, sup.e)) m FROM test q, sup GROUP BY 1) SELECT vec_id, round(m, 6) familiarity, m >= t AS familiar FROM f, lim")
def familiarity_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearness to the support set, and whether it reaches the fifth percentile of validation."""
    s = support(spark, sf_dir)
    valid = pool(spark, sf_dir).join(s.select("vec_id"), "vec_id", "left_anti")
    limit = ordering.quantiles(similarity.nearest(valid, s), "cos", [0.05]).first()["q0"]
    return similarity.nearest(tests(spark, sf_dir), s).select("vec_id", r6("cos", "familiarity"), (F.col("cos") >= F.lit(limit)).alias("familiar"))


@query("WITH " + TEXTS + ", g AS (SELECT range r FROM range(4)), a AS (SELECT vec_id, class, 100 * list_inner_product(e, t) z FROM test, texts), b AS (SELECT vec_id, class FROM a QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, class) = 1), o AS (SELECT vec_id, class, r, a.z - 100 * list_inner_product(q.e[r * 16 + 1:r * 16 + 16], t[r * 16 + 1:r * 16 + 16]) z FROM a JOIN test q USING (vec_id) JOIN texts USING (class), g), m AS (SELECT a.vec_id, max(z) FILTER (a.class = b.class) - max(z) FILTER (a.class <> b.class) m FROM a JOIN b USING (vec_id) GROUP BY 1), mo AS (SELECT o.vec_id, r, max(z) FILTER (o.class = b.class) - max(z) FILTER (o.class <> b.class) m FROM o JOIN b USING (vec_id) GROUP BY ALL) SELECT vec_id, r::INT region, round(m.m - mo.m, 6) importance FROM m JOIN mo USING (vec_id)")
def occlusion_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a quarter of the vector adds to the margin of the predicted class."""
    t, text = tests(spark, sf_dir), texts(spark, sf_dir)
    whole = similarity.scores(t, text)
    parts = None
    for r in range(4):
        cut = text.assign(vec=[np.asarray(v)[r * 16 : r * 16 + 16] for v in text["vec"]])
        x = similarity.scores(t.withColumn("embedding", F.slice("embedding", r * 16 + 1, 16)), cut, name="part").withColumn("region", F.lit(r))
        parts = x if parts is None else parts.union(x)
    pred = evaluation.predicted(whole).select("vec_id", "pred")
    margin = lambda z: F.max(F.when(F.col("class") == F.col("pred"), z)) - F.max(F.when(F.col("class") != F.col("pred"), z))
    m = whole.join(pred, "vec_id").groupBy("vec_id").agg(margin(F.col("z")).alias("m"))
    without = whole.join(parts, ["vec_id", "class"]).join(pred, "vec_id").groupBy("vec_id", "region").agg(margin(F.col("z") - F.col("part")).alias("mo"))
    return without.join(m, "vec_id").select("vec_id", "region", F.round(F.col("m") - F.col("mo"), 6).alias("importance"))


# ---- regions: four boxes to an item, from its vector's components
def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.abs(F.col("embedding")[i].cast("double"))
    box = lambda k: F.struct(e(4 * k).alias("x0"), e(4 * k + 1).alias("y0"), (e(4 * k) + e(4 * k + 2)).alias("x1"), (e(4 * k + 1) + e(4 * k + 3)).alias("y1"), e(32 + k).alias("score"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array(*[box(k) for k in range(6)]).alias("boxes"))


BOXES = "bx AS (SELECT vec_id, k, abs(e[4 * k + 1]) x0, abs(e[4 * k + 2]) y0, abs(e[4 * k + 1]) + abs(e[4 * k + 3]) x1, abs(e[4 * k + 2]) + abs(e[4 * k + 4]) y1, abs(e[33 + k]) score FROM (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings), range(6) t(k)), ba AS (SELECT *, (x1 - x0) * (y1 - y0) area FROM bx)"


@query("WITH " + BOXES + " SELECT vec_id, k::INT box, round((x0 + x1) / 2 / 2, 6) cx, round((y0 + y1) / 2, 6) cy, round((x1 - x0) / 2, 6) w, round(y1 - y0, 6) h, round(area, 6) area FROM ba")
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).select("vec_id", F.posexplode("boxes").alias("box", "b"))
    g = b.select("vec_id", "box", regions.geometry(F.col("b"), F.lit(2e0), F.lit(1e0)).alias("g"), regions.area(F.col("b")).alias("area"))
    return g.select("vec_id", "box", *[F.round(F.col(f"g.{c}"), 6).alias(c) for c in ("cx", "cy", "w", "h")], r6("area"))


@query("WITH " + BOXES + ", j AS (SELECT a.vec_id, a.k i, b.k j, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) common, a.area aa, b.area ab FROM ba a JOIN ba b ON a.vec_id = b.vec_id AND a.k < b.k) SELECT vec_id, i::INT i, j::INT j, round(common / greatest(aa + ab - common, 1e-6), 6) iou FROM j")
def pairwise_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = boxes(spark, sf_dir).select("vec_id", F.explode(regions.pairs(F.col("boxes"))).alias("p"))
    return p.select("vec_id", "p.i", "p.j", F.round(regions.overlap(F.col("p.a"), F.col("p.b")), 6).alias("iou"))


@query("WITH " + BOXES + ", f AS (SELECT vec_id, count(*) FILTER (area < 0.85 AND area > 0.002 AND score >= 0.06) a, count(*) FILTER (area < 0.98 AND area > 0.002 AND score >= 0.02) b FROM ba GROUP BY 1) SELECT vec_id, (CASE WHEN a > 0 THEN a ELSE b END)::INT n FROM f")
def detection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that pass the filter, or the wider one where none does."""
    first, second = regions.detections(F.col("boxes"), 0.06, 0.85), regions.detections(F.col("boxes"), 0.02, 0.98)
    return boxes(spark, sf_dir).select("vec_id", F.size(F.when(F.size(first) > 0, first).otherwise(second)).alias("n"))


@query("WITH " + BOXES + ", f AS (SELECT vec_id, count(*) FILTER (k < 3 AND score >= 0.1) a, count(*) FILTER (k >= 3 AND score >= 0.05) b FROM ba GROUP BY 1) SELECT vec_id, least(a, greatest(2, 4 - b))::INT instances, least(b, 4 - least(a, greatest(2, 4 - b)))::INT spots FROM f")
def slot_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda lo, hi, s: F.filter(F.transform(F.slice("boxes", lo + 1, hi - lo), lambda b: F.struct(b["score"].alias("score"), F.lit(lo).alias("kind"))), lambda b: b["score"] >= s)
    taken = boxes(spark, sf_dir).select("vec_id", regions.slots(kind(0, 3, 0.1), kind(3, 6, 0.05)).alias("s"))
    return taken.select("vec_id", F.size(F.filter("s", lambda b: b["kind"] == 0)).alias("instances"), F.size(F.filter("s", lambda b: b["kind"] == 3)).alias("spots"))


@query("WITH " + BOXES + ", c AS (SELECT vec_id, (x0 + x1) / 2 x, (y0 + y1) / 2 y FROM ba WHERE k = 0) SELECT vec_id, bool_or(x >= x0 AND x <= x1 AND y >= y0 AND y <= y1) hit FROM c JOIN ba USING (vec_id) WHERE k > 0 GROUP BY 1")
def point_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("boxes")[0]
    return boxes(spark, sf_dir).select("vec_id", regions.inside((b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2, F.slice("boxes", 2, 5)).alias("hit"))


@query("WITH " + BOXES + ", p AS (SELECT vec_id, x0 * 100 x0, y0 * 100 y0, x1 * 100 x1, y1 * 100 y1 FROM ba WHERE k = 0), m AS (SELECT *, 0.1e0 * greatest(x1 - x0, y1 - y0) m FROM p), q AS (SELECT vec_id, greatest(0, x0 - m) a, greatest(0, y0 - m) b, least(100, x1 + m) c, least(80, y1 + m) d FROM m) SELECT vec_id, round(a, 6) x0, round(b, 6) y0, round(greatest(c, a + 8), 6) x1, round(greatest(d, b + 8), 6) y1 FROM q")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("boxes")[0]
    pixels = F.struct(*[(b[c] * 100).alias(c) for c in ("x0", "y0", "x1", "y1")])
    out = boxes(spark, sf_dir).select("vec_id", pixels.alias("b")).select("vec_id", regions.expanded(F.col("b"), 0.1, F.lit(100e0), F.lit(80e0)).alias("c"))
    return out.select("vec_id", *[F.round(F.col(f"c.{c}"), 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("WITH s AS (SELECT * FROM (VALUES (3, 1, 1), (3, 2, 3), (3, 3, 2), (4, 2, 4), (4, 4, 2), (4, 3, 2)) t(n, w, h)), p AS (SELECT n, w, h, r.range r, c.range c FROM s, range(4) r, range(4) c WHERE r.range <= n - h AND c.range <= n - w) SELECT round_even(r * 336e0 / n, 0)::INT \"top\", round_even(c * 336e0 / n, 0)::INT \"left\", round_even((r + h) * 336e0 / n, 0)::INT bottom, round_even((c + w) * 336e0 / n, 0)::INT \"right\" FROM p UNION ALL SELECT 0, 0, 336, 336")
def grid_windows_26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.grid_windows(spark)


# ---- reports: events play a log of runs
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.element_at(F.array(*map(F.lit, reports.SIZES)), (F.col("user_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("method"), size.alias("K"), (F.col("event_id") % 3 + 1).alias("seed"), F.col("value").alias("score"))


RUNS = "runs AS (SELECT event_id run_id, event_type method, (['1', '2', '4', '8', '16', 'full'])[user_id % 6 + 1] K, event_id % 3 + 1 seed, value score FROM events)"


@query("WITH " + RUNS + ", w AS (SELECT *, CASE WHEN run_id % 2 = 0 THEN 0 ELSE 1 END p FROM runs WHERE method <> 'error') SELECT method, K, seed, run_id, CASE WHEN p = 0 THEN score END score, CASE WHEN p = 1 THEN score END other FROM w QUALIFY row_number() OVER (PARTITION BY method, K, seed ORDER BY p, run_id DESC) = 1")
def runs_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logs of differing columns put together; of repeats the preferred log's newest run."""
    log = run_log(spark, sf_dir)
    even, odd = log.filter("run_id % 2 = 0"), log.filter("run_id % 2 = 1").withColumnRenamed("score", "other")
    return reports.all_runs([(0, even), (1, odd)], exclude=("error",)).select("method", "K", "seed", "run_id", "score", "other")


@query("WITH " + RUNS + " SELECT method, K, round(avg(score), 6) mean, round(coalesce(stddev_samp(score), 0), 6) std, round(min(score), 6) lo, round(max(score), 6) hi, count(score) n FROM runs GROUP BY ALL")
def mean_std_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = reports.mean_std(run_log(spark, sf_dir), ["method", "K"], "score")
    return m.select("method", "K", *[r6(c) for c in ("mean", "std", "lo", "hi")], "n")


@query("WITH " + RUNS + ", m AS (SELECT method, K, round(avg(score), 3) v FROM runs GROUP BY ALL) SELECT method, " + ", ".join(f"max(v) FILTER (K = '{s}') k_{s}" for s in reports.SIZES) + " FROM m GROUP BY 1")
def pivot_table_by_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = reports.mean_std(run_log(spark, sf_dir), ["method", "K"], "score").withColumn("v", F.round("mean", 3))
    return reports.by_size(m, "method", "v")


@query("WITH " + RUNS + ", m AS (SELECT method, K, avg(score) a FROM runs GROUP BY ALL) SELECT method, round(avg(a), 6) mean_of_means, row_number() OVER (ORDER BY avg(a) DESC, method)::INT place FROM m GROUP BY 1")
def rank_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = reports.mean_std(run_log(spark, sf_dir), ["method", "K"], "score").groupBy("method").agg(F.avg("mean").alias("m"))
    return m.select("method", r6("m", "mean_of_means"), F.row_number().over(Window.orderBy(F.desc("m"), "method")).alias("place"))


@query("WITH " + RUNS + ", s AS (SELECT method, K, seed, round_even(avg(score), 4) a FROM runs GROUP BY ALL), c AS (SELECT method, K, round_even(avg(a), 4) b FROM s GROUP BY ALL) SELECT method, round(avg(b), 6) val_mean FROM c GROUP BY 1")
def candidate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over sizes of means over seeds, rounded at each level."""
    s = run_log(spark, sf_dir).groupBy("method", "K", "seed").agg(F.bround(F.avg("score"), 4).alias("a"))
    c = s.groupBy("method", "K").agg(F.bround(F.avg("a"), 4).alias("b"))
    return c.groupBy("method").agg(F.round(F.avg("b"), 6).alias("val_mean"))


@query("WITH " + RUNS + ", pl AS (SELECT m.method, k.K, s.seed FROM (SELECT DISTINCT method FROM runs) m, (SELECT unnest(['1', '2', '4', '8', '16', 'full']) K) k, (SELECT unnest([1, 2, 3, 4]) seed) s) SELECT * FROM pl WHERE (method, K, seed) NOT IN (SELECT (method, K, seed) FROM runs)")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of a grid of methods, sizes and seeds that the log does not have."""
    log = run_log(spark, sf_dir)
    plan = log.select("method").distinct().withColumn("K", F.explode(F.array(*map(F.lit, reports.SIZES)))).withColumn("seed", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])))
    return reports.pending(plan, log.withColumn("seed", F.col("seed").cast("int")), ["method", "K", "seed"])


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) median, count(*) n FROM events GROUP BY 1")
def timing_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    medians = ordering.quantiles(events, "value", [0.5], ["event_type"]).select(F.col("event_type").alias("_e"), r6("q0", "median"))
    counts = events.groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.join(medians, F.col("event_type").eqNullSafe(F.col("_e")), "left").select("event_type", "median", "n")


@query("SELECT l_returnflag, l_linestatus, count(*) n, round(avg(l_quantity), 6) mean, round(stddev_samp(l_quantity), 6) std, round(avg((l_discount >= 0.05)::INT), 6) share FROM lineitem GROUP BY ALL")
def lineitem_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return df.agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.stddev_samp("l_quantity"), 6).alias("std"), F.round(F.avg((F.col("l_discount") >= 0.05).cast("double")), 6).alias("share"))


@query("WITH b AS (SELECT value, CASE WHEN value >= 0 AND value < 10 THEN 0 WHEN value >= 10 AND value < 50 THEN 1 WHEN value >= 50 AND value < 200 THEN 2 END band FROM events) SELECT band, count(*) n, round(avg(value), 6) mean FROM b WHERE band IS NOT NULL GROUP BY 1")
def value_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "events").select("value", sampling.band(F.col("value"), [0, 10, 50, 200]).alias("band"))
    return b.filter("band is not null").groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(concat_ws('|', 'look', event_id::VARCHAR)), event_id) <= 5")
def sample_per_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five events of each type to look at."""
    return sampling.per_stratum(table(spark, sf_dir, "events"), 5, "look", "event_id", ["event_type"]).select("event_id", "event_type")


@query("WITH " + BOXES + ", s AS (SELECT vec_id, bool_or(score >= 0.1e0) found, count(*) FILTER (k >= 3 AND score >= 0.05e0) spots FROM ba GROUP BY 1) SELECT label, count(*) n, round(avg(found::INT), 6) object_found, round(avg(spots), 6) spots FROM s JOIN embeddings USING (vec_id) GROUP BY 1")
def region_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each class how often an object is found, and how many spots."""
    found = F.exists("boxes", lambda b: b["score"] >= 0.1).cast("double")
    spots = F.size(F.filter(F.slice("boxes", 4, 3), lambda b: b["score"] >= 0.05))
    rows = labelled(boxes(spark, sf_dir).select("vec_id", found.alias("found"), spots.alias("spots")), spark, sf_dir)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("found"), 6).alias("object_found"), F.round(F.avg("spots"), 6).alias("spots"))


# ---- parsing
@query(r"SELECT page_id, regexp_extract(url, '^(\w+)://([^/]+)/(.*)$', 1) scheme, regexp_extract(url, '^(\w+)://([^/]+)/(.*)$', 2) host, concat_ws('#', regexp_extract(url, '^(\w+)://([^/]+)/(.*)$', 2), regexp_extract(url, '^(\w+)://([^/]+)/(.*)$', 3)) track FROM pages WHERE regexp_matches(url, '^(\w+)://([^/]+)/(.*)$')")
def parse_structured_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "pages").select("page_id", *readers.name_parts(F.col("url"), r"^(\w+)://([^/]+)/(.*)$", ["scheme", "host", "rest"]))
    return parts.filter("scheme is not null").select("page_id", "scheme", "host", F.concat_ws("#", "host", "rest").alias("track"))


@query("WITH b AS (SELECT vec_id, [[round(x0, 3), round(y0, 3)], [round(x1, 3), round(y1, 3)]] j FROM (SELECT vec_id, embedding[1]::DOUBLE x0, embedding[2]::DOUBLE y0, embedding[3]::DOUBLE x1, embedding[4]::DOUBLE y1 FROM embeddings)) SELECT vec_id, len(j)::INT n, j[1][1] + 0e0 x0, j[2][2] + 0e0 y1 FROM b")
def parse_boxes_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.round(F.col("embedding")[i].cast("double"), 3)
    text = table(spark, sf_dir, "embeddings").select("vec_id", F.to_json(F.array(F.array(e(0), e(1)), F.array(e(2), e(3)))).alias("j"))
    parsed = text.select("vec_id", F.from_json("j", "array<array<double>>").alias("b"))
    return parsed.select("vec_id", F.size("b").alias("n"), (F.col("b")[0][0] + 0e0).alias("x0"), (F.col("b")[1][1] + 0e0).alias("y1"))


@query("SELECT p_partkey, lower(p_brand) label FROM part")
def label_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of a file from its name or nearest folder; parts play files in folders named by brand."""
    df = table(spark, sf_dir, "part")
    path = F.concat_ws("/", F.lit("data"), F.col("p_brand"), F.concat(F.lit("x-"), F.col("p_partkey").cast("string")))
    labels = readers.labels_of(df.select("p_partkey", path.alias("path")), df.select(F.col("p_brand").alias("class")))
    return labels.select("p_partkey", "label")


@query("SELECT event_id, len(props)::INT size, md5(props) md5 FROM events")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.length("props").alias("size"), F.md5(F.col("props").cast("binary")).alias("md5"))


@query("SELECT r_regionkey, 'a photo of ' || lower(r_name) || '.' phrase FROM region")
def template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_regionkey", F.format_string("a photo of %s.", F.lower("r_name")).alias("phrase"))


@query("SELECT 'p' || l_orderkey AS path, count(*) n, round(sum(l_quantity), 6) total FROM lineitem GROUP BY 1")
def ground_truth_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 'path label x0 y0 x1 y1' parsed, the boxes of one path joined; line items play boxes of orders."""
    line = F.concat_ws(" ", F.concat(F.lit("p"), F.col("l_orderkey").cast("string")), F.lit("1"), F.col("l_quantity").cast("string"), F.lit("0"), F.lit("1"), F.lit("1"))
    got = readers.ground_truth(table(spark, sf_dir, "lineitem").select(line.alias("value")))
    return got.select("path", F.size("boxes").cast("bigint").alias("n"), F.round(F.aggregate("boxes", F.lit(0e0), lambda s, b: s + b[0]), 6).alias("total"))


@query(r"SELECT doc_id, len(x)::INT n, coalesce(list_sum(list_transform(x, lambda v: len(v))), 0)::BIGINT digits FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') x FROM documents)")
def numbers_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All numbers of a free-form line."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("([0-9]+)")).alias("x"))
    return x.select("doc_id", F.size("x").alias("n"), F.aggregate("x", F.lit(0).cast("bigint"), lambda s, v: s + F.length(v)).alias("digits"))

"""More queries over the same tables: extraction through encoders and detectors, stored models and predictions, the whole
cleaning chain, winners and formatted reports, tiles, and what is written and read back."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.functions import tables, vec
from verdigris.operators import classifiers, curation, evaluation, graphmethods, graphs, regions, reports, sampling, similarity, splits
from verdigris.operators.gradients import Var
from verdigris.plans import catalogue
from verdigris.plans.catalogue import BOXES, CACHE, DIM, GRID, ITEMS, METRICS, OTHER, PAIRS, PROBS, RUNS, SAME, TEXTS, boxes, edges, labelled, pool, query, r6, run_log, support, support_rows, support_sql, table, tests, texts, unit_sql
from verdigris.sources import domains, encoders, formats, models, readers
from verdigris.streaming import arrivals, logs

LETTERS = encoders.Letters()


# ---- extraction
def letters_sql(text: str) -> str:
    """The letter vector of a lower-case text, unit length."""
    counts = f"list_transform(range(97, 123), lambda c: (len({text}) - len(replace({text}, chr(c::INT), '')))::DOUBLE)"
    return f"list_transform({counts}, lambda x: x / greatest(sqrt(list_inner_product({counts}, {counts})), 1e-8))"


@query("WITH t AS (SELECT doc_id, lower(coalesce(text, '')) t FROM documents), v AS (SELECT doc_id, " + letters_sql("t") + " v FROM t) SELECT doc_id, round(v[5]::FLOAT::DOUBLE, 5) e, round(v[20]::FLOAT::DOUBLE, 5) t, len(v)::INT dim FROM v")
def encode_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded whole, written to the feature store, and one partition of it read back."""
    store = graphs.workspace(spark, "features")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = encoders.encoded(docs, LETTERS, encoders.whole(), "global", "doc_id", "text").withColumn("vec", F.col("vecs")[0])
    readers.save_features(got.select("path", "vec", "backbone", "mode"), store)
    back = domains.Store(spark, store, "letters", optional=("grid",)).features()
    return back.select(F.col("path").cast("bigint").alias("doc_id"), F.round(F.col("vec")[4].cast("double"), 5).alias("e"), F.round(F.col("vec")[19].cast("double"), 5).alias("t"), F.size("vec").alias("dim"))


@query("WITH d AS (SELECT doc_id, lower(text) t FROM documents WHERE text IS NOT NULL), g AS (SELECT range::INT cell, range // 3 r, range % 3 c FROM range(9)), y AS (SELECT doc_id, cell, c, substr(t, 1 + floor(r / 3 * len(t))::BIGINT, floor((r + 1) / 3 * len(t))::BIGINT - floor(r / 3 * len(t))::BIGINT) t FROM d, g), x AS (SELECT doc_id, cell, substr(t, 1 + floor(c / 3 * len(t))::BIGINT, floor((c + 1) / 3 * len(t))::BIGINT - floor(c / 3 * len(t))::BIGINT) t FROM y), v AS (SELECT doc_id, cell, " + letters_sql("t") + " v FROM x) SELECT doc_id, cell, round(v[1]::FLOAT::DOUBLE, 5) a, round(v[5]::FLOAT::DOUBLE, 5) e FROM v")
def encode_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine cells of each document, each encoded on its own."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    got = encoders.encoded(docs, LETTERS, encoders.grid_cells(3), "grid", "doc_id", "text")
    cells = got.select(F.col("path").cast("bigint").alias("doc_id"), F.posexplode("vecs").alias("cell", "v"))
    return cells.select("doc_id", "cell", F.round(F.col("v")[0].cast("double"), 5).alias("a"), F.round(F.col("v")[4].cast("double"), 5).alias("e"))


# Fixed values of these queries: phrases of a class.
TEMPLATES, DESCRIPTIONS = ("a photo of {}.",), ("{} with brown spots", "a leaf of {}", "{}")


@query("WITH c AS (SELECT DISTINCT lower(n_name) name FROM nation), p AS (SELECT name, 't' kind, 'a photo of ' || name || '.' t FROM c UNION ALL SELECT name, 'd', name || ' with brown spots' FROM c UNION ALL SELECT name, 'd', 'a leaf of ' || name FROM c UNION ALL SELECT name, 'd', name FROM c), v AS (SELECT name, kind, " + letters_sql("t") + " v FROM p), m AS (SELECT name, kind, i, avg(v[i]) m FROM v, range(1, 27) t(i) GROUP BY ALL), l AS (SELECT name, list(d + 0.5e0 * t ORDER BY i) v FROM (SELECT name, i, max(m) FILTER (kind = 'd') d, max(m) FILTER (kind = 't') t FROM m GROUP BY ALL) GROUP BY 1), u AS (SELECT name, " + unit_sql("v") + " v FROM l) SELECT name, round(v[1], 5) a, round(list_sum(v), 5) total FROM u")
def encode_class_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class vectors from templates and descriptions through a text encoder, stored and read as a small table."""
    names = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name")).distinct()
    at = graphs.workspace(spark, "texts")
    stored = readers.cached(spark, at, lambda: encoders.class_vectors(names, LETTERS, "name", TEMPLATES, DESCRIPTIONS))
    return stored.select("name", F.round(F.col("vec")[0], 5).alias("a"), F.round(vec.total(F.col("vec")), 5).alias("total"))


PROMPTS = {"a fruit": "object", "a lesion": "instance", "a bruise": "instance", "a dot": "spot", "a hole": "spot", "rust": "spot"}
RAW = "raw AS (SELECT vec_id, k, abs(e[5 * k + 1]) cx, abs(e[5 * k + 2]) cy, abs(e[5 * k + 3]) w, abs(e[5 * k + 4]) h, abs(e[5 * k + 5]) score FROM (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings), range(6) t(k)), co AS (SELECT vec_id, k, score, greatest(0, least((cx - w / 2) * 640, 640)) x0, greatest(0, least((cy - h / 2) * 640, 480)) y0, greatest(0, least((cx + w / 2) * 640, 640)) x1, greatest(0, least((cy + h / 2) * 640, 480)) y1 FROM raw), sz AS (SELECT *, (x1 - x0) * (y1 - y0) ar FROM co)"


def nms_sql(source: str, by: str, ids: str = "vec_id") -> str:
    """Recursive common table expressions `sup` of (ids, grp, kept positions) for boxes (ids, grp, k, x0.., score, ar): one box a step."""
    key = f"{ids}, grp" if by else ids
    return (
        f"od AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, k) n FROM {source}), "
        f"ov AS (SELECT a.{ids}, a.grp, a.n i, b.n j FROM od a JOIN od b ON a.{ids} = b.{ids} AND a.grp = b.grp AND a.n < b.n WHERE greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / greatest(a.ar + b.ar - greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)), 1e-6) > 0.3), "
        f"bl AS (SELECT od.{ids}, od.grp, od.n, coalesce(list(ov.i) FILTER (ov.i IS NOT NULL), []) blockers FROM od LEFT JOIN ov ON ov.{ids} = od.{ids} AND ov.grp = od.grp AND ov.j = od.n GROUP BY ALL), "
        f"st AS (SELECT {ids}, grp, 1::BIGINT n, [1::BIGINT] kept FROM bl WHERE n = 1 UNION ALL SELECT st.{ids}, st.grp, bl.n, CASE WHEN list_has_any(st.kept, bl.blockers) THEN st.kept ELSE list_append(st.kept, bl.n) END FROM st JOIN bl ON bl.{ids} = st.{ids} AND bl.grp = st.grp AND bl.n = st.n + 1), "
        f"sup AS (SELECT {ids}, grp, arg_max(kept, n) kept FROM st GROUP BY ALL)"
    )


@query("WITH RECURSIVE " + RAW + ", f AS (SELECT *, CASE WHEN k = 0 THEN 'object' WHEN k < 3 THEN 'instance' ELSE 'spot' END grp, ar / (640 * 480) sh FROM sz), a AS (SELECT * FROM f WHERE sh > 0.002 AND CASE grp WHEN 'object' THEN score >= 0.2 AND sh < 0.85 WHEN 'instance' THEN score >= 0.06 AND sh < 0.85 ELSE score >= 0.05 AND sh < 0.12 END), w AS (SELECT * FROM a UNION ALL SELECT * FROM f WHERE grp = 'object' AND score >= 0.2 AND sh > 0.002 AND sh >= 0.85 AND sh < 0.98), " + nms_sql("w", "grp") + ", n AS (SELECT vec_id, coalesce(max(len(kept)) FILTER (grp = 'instance'), 0) i, coalesce(max(len(kept)) FILTER (grp = 'spot'), 0) s FROM embeddings LEFT JOIN sup USING (vec_id) GROUP BY 1), o AS (SELECT vec_id, max(round(x0, 4)) x0 FROM w WHERE grp = 'object' GROUP BY 1) SELECT n.vec_id, o.x0 object_x0, least(i, greatest(2, 4 - s))::INT instances, least(s, 4 - least(i, greatest(2, 4 - s)))::INT spots FROM n LEFT JOIN o USING (vec_id)")
def detect_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw detections of a plug-in detector made into an object and up to four regions of an item."""
    raw = encoders.detected(table(spark, sf_dir, "embeddings"), encoders.Stripes(), list(PROMPTS), "vec_id", "embedding")
    got = raw.select(F.col("path").cast("bigint").alias("vec_id"), encoders.item_regions(F.col("raw"), PROMPTS, F.lit(640), F.lit(480)).alias("r"))
    count = lambda kind: F.size(F.filter("r.regions", lambda b: b["kind"] == kind))
    return got.select("vec_id", F.round("r.object.x0", 4).alias("object_x0"), count("instance").alias("instances"), count("spot").alias("spots"))


@query("WITH e AS (SELECT vec_id, 300 + (vec_id % 400) w, 200 + (vec_id % 90) h FROM embeddings), x AS (SELECT vec_id, w, h, greatest(0, floor((w - 224) / 112)) + 1 nx, greatest(0, floor((h - 224) / 112)) + 1 ny FROM e) SELECT vec_id, (nx * ny)::INT n, round(least(1, ((nx - 1) * 112 + 224) / w), 6) right_edge FROM x")
def tile_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed tiles of items of differing sizes, as shares of their sides."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", (300 + F.col("vec_id") % 400).alias("w"), (200 + F.col("vec_id") % 90).alias("h"))
    t = df.select("vec_id", encoders.tiles(F.col("w"), F.col("h"), 224, 112).alias("t"))
    return t.select("vec_id", F.size("t").alias("n"), F.round(F.array_max(F.transform("t", lambda b: b["x1"])), 6).alias("right_edge"))


@query("WITH RECURSIVE " + BOXES + ", b AS (SELECT vec_id, 'x' grp, k, x0, y0, x1, y1, score, area ar FROM ba), " + nms_sql("b", "grp") + " SELECT vec_id, len(kept)::INT n, (SELECT round(max(score), 6) FROM b WHERE b.vec_id = sup.vec_id) best FROM sup")
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many boxes suppression leaves, and the best score."""
    kept = boxes(spark, sf_dir).select("vec_id", regions.suppressed(F.col("boxes")).alias("kept"))
    return kept.select("vec_id", F.size("kept").alias("n"), F.round(F.col("kept")[0]["score"], 6).alias("best"))


@query("WITH " + BOXES + " SELECT a.vec_id, a.k::INT i, b.k::INT j, round(sqrt(power((a.x0 + a.x1 - b.x0 - b.x1) / 2, 2) + power((a.y0 + a.y1 - b.y0 - b.y1) / 2, 2)), 6) apart, round(a.score * b.score, 6) product FROM ba a JOIN ba b ON a.vec_id = b.vec_id AND a.k < b.k")
def box_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre distances and products of scores of an item's boxes."""
    b = boxes(spark, sf_dir).select("vec_id", F.posexplode(regions.pairs(F.col("boxes"))).alias("n", "p")).select("vec_id", "p.i", "p.j", "p.a", "p.b")
    far = F.hypot((F.col("a.x0") + F.col("a.x1") - F.col("b.x0") - F.col("b.x1")) / 2, (F.col("a.y0") + F.col("a.y1") - F.col("b.y0") - F.col("b.y1")) / 2)
    return b.select("vec_id", "i", "j", F.round(far, 6).alias("apart"), F.round(F.col("a.score") * F.col("b.score"), 6).alias("product"))


@query("WITH " + BOXES + ", h AS (SELECT vec_id, i - 1 pos FROM (SELECT vec_id, e, list_position(e, list_max(e)) i FROM (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings))), p AS (SELECT vec_id, (pos % 8 + 0.5e0) / 8 x, (pos // 8 + 0.5e0) / 8 y FROM h) SELECT vec_id, bool_or(x >= x0 AND x <= x1 AND y >= y0 AND y <= y1) hit FROM p JOIN ba USING (vec_id) GROUP BY 1")
def pointing_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the largest cell of an 8 by 8 heat map lies in any of the item's boxes; the vector plays the map."""
    heat = table(spark, sf_dir, "embeddings").select("vec_id", regions.hottest(F.col("embedding"), 8).alias("p"))
    return heat.join(boxes(spark, sf_dir), "vec_id").select("vec_id", regions.inside(F.col("p.x"), F.col("p.y"), F.col("boxes")).alias("hit"))


@query("WITH s AS (SELECT * FROM (VALUES (3, 1, 1), (3, 2, 3), (3, 3, 2), (4, 2, 4), (4, 4, 2), (4, 3, 2), (4, 2, 2), (4, 2, 3), (4, 3, 2), (4, 3, 3)) t(n, w, h)), p AS (SELECT n, w, h, r.range r, c.range c FROM s, range(4) r, range(4) c WHERE r.range <= n - h AND c.range <= n - w), u AS (SELECT round_even(r * 336e0 / n, 0)::INT \"top\", round_even(c * 336e0 / n, 0)::INT \"left\", round_even((r + h) * 336e0 / n, 0)::INT bottom, round_even((c + w) * 336e0 / n, 0)::INT \"right\" FROM p UNION SELECT 0, 0, 336, 336) SELECT * FROM u")
def window_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of both families, each place once, in the order first met."""
    return regions.window_union(spark, [regions.WINDOWS, regions.WINDOWS_OF_ONE_GRID]).drop("place")


@query("WITH " + ITEMS + ", " + support_sql("sup", 4, 1) + ", w AS (SELECT vec_id, label, range w, list_concat(e[range + 1:], e[:range]) v FROM sup, range(26)), n AS (SELECT vec_id, label, w, " + unit_sql("v") + " v FROM w), m AS (SELECT vec_id, label, i, avg(v[i]) m FROM n, range(1, 65) t(i) GROUP BY ALL), l AS (SELECT vec_id, label, list(m ORDER BY i) k FROM m GROUP BY ALL), u AS (SELECT vec_id, label, " + unit_sql("k") + " k FROM l) SELECT vec_id, label, round(k[1], 6) first_part, round(list_sum(k), 6) total FROM u")
def window_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache keys of support items as the normalised mean of their 26 windows' unit vectors, gathered once and kept. Rotations
    of the vector play the windows."""
    rotated = F.transform(F.sequence(F.lit(0), F.lit(25)), lambda w: F.concat(F.slice("embedding", w + 1, F.size("embedding") - w), F.slice("embedding", F.lit(1), w)))

    def keys() -> DataFrame:
        views = support(spark, sf_dir).select("vec_id", "label", F.explode(rotated).alias("v")).select("vec_id", "label", vec.normalized(F.col("v")).alias("v"))
        return vec.mean_vector(views, ["vec_id", "label"], "v", DIM).select("vec_id", "label", vec.normalized(F.col("mean")).alias("key"))

    kept = readers.cached(spark, graphs.workspace(spark, "window-keys"), keys)
    return kept.select("vec_id", "label", F.round(F.col("key")[0], 6).alias("first_part"), F.round(vec.total(F.col("key")), 6).alias("total"))


# ---- stored models and predictions
SERVED = CACHE + ", sv AS (SELECT vec_id, zc.class, 100 * list_inner_product(q.e, t) text_part, 2e0 * zc.z cache_part, (zc.class - 4) * 0.1e0 bias_part FROM test q JOIN zc USING (vec_id) JOIN texts USING (class)), sz AS (SELECT *, text_part + cache_part + bias_part z FROM sv), sx AS (SELECT *, exp((z - max(z) OVER i) / 1.5e0) x FROM sz WINDOW i AS (PARTITION BY vec_id)), sp AS (SELECT *, x / sum(x) OVER i p, text_part - avg(text_part) OVER i tc, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, class) n FROM sx WINDOW i AS (PARTITION BY vec_id))"


def served(spark: SparkSession, sf_dir: str) -> models.CacheModel:
    """A cache model with its calibration, exported and loaded again."""
    t, s = texts(spark, sf_dir).sort_values("class"), support_rows(spark, sf_dir)
    made = models.CacheModel(np.stack(t["vec"].to_list()), np.stack(s["vec"].to_list()).astype(float), s["label"].to_numpy(int), 2.0, 5.0, 1.5, (np.arange(len(t)) - 4) * 0.1, familiar=0.3, sure=0.5, facts={"k": 4})
    at = graphs.workspace(spark, "model")
    models.save(made, spark, at)
    return models.load(spark, at)


@query("WITH " + SERVED + " SELECT vec_id, class, round(text_part, 6) text_part, round(cache_part, 6) cache_part, round(z, 6) z, round(p, 6) p FROM sp")
def model_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and calibrated probabilities of a model that was written and read back."""
    m = served(spark, sf_dir)
    p = evaluation.calibrated(m.parts(tests(spark, sf_dir)).drop("z").withColumn("z", F.col("text_part") + F.col("cache_part")), m.tau, m.bias)
    return p.select("vec_id", "class", r6("text_part"), r6("cache_part"), F.round(F.col("z") + F.col("bias_part"), 6).alias("z"), r6("p"))


@query("WITH " + SERVED + ", b AS (SELECT a.vec_id, a.class pred, a.z - c.z margin, a.p conf FROM sp a JOIN sp c ON a.vec_id = c.vec_id AND a.n = 1 AND c.n = 2), f AS (SELECT q.vec_id, max(list_inner_product(q.e, s.e)) fam FROM test q, sup s GROUP BY 1) SELECT sp.vec_id, sp.class, round(tc, 6) text_part_centred, round(p, 6) p, pred, round(margin, 6) margin, round(fam, 6) familiarity, conf < 0.5e0 unsure, fam >= 0.3e0 familiar FROM sp JOIN b USING (vec_id) JOIN f USING (vec_id)")
def explain_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the loaded model tells about every test item: parts, probabilities, prediction, margin, familiarity, flags."""
    got = served(spark, sf_dir).explain(tests(spark, sf_dir))
    return got.select("vec_id", "class", r6("text_part_centred"), r6("p"), "pred", r6("margin"), r6("familiarity"), "unsure", "familiar")


@query("WITH " + PROBS + ", b AS (SELECT vec_id, label, class pred FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p::FLOAT DESC, class) = 1) SELECT label, pred, count(*) n FROM b GROUP BY ALL")
def prediction_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of a run written to the prediction store, read back by run, and counted against the labels."""
    p = evaluation.softmax(catalogue.zero_shot_scores(spark, sf_dir))
    wide = p.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "p"))), lambda x: x["p"]).alias("probs"))
    at = graphs.workspace(spark, "predictions")
    readers.save_predictions(wide, at, "zero_shot", "0", 1, "vec_id")
    back = readers.predictions(spark, at, "zero_shot", "0", 1).withColumn("vec_id", F.col("path").cast("bigint"))
    return labelled(back, spark, sf_dir).groupBy("label", "pred").agg(F.count("*").alias("n"))


# ---- cleaning
NEAR, CHECKED = 0.4, 22


CHAIN = PAIRS + f", st AS (SELECT a, b, round(cos, 4) cos FROM pairs), sg AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) s FROM embeddings), vf AS (SELECT a, b, cos FROM st JOIN sg x ON x.vec_id = a JOIN sg y ON y.vec_id = b WHERE cos >= {NEAR} OR len(list_filter(list_zip(x.s, y.s), lambda z: z[1] <> z[2])) <= {CHECKED})"


@query("WITH RECURSIVE " + CHAIN + ", nr AS (SELECT DISTINCT a, b FROM vf), sq AS (SELECT node, row_number() OVER (ORDER BY node) n FROM (SELECT a node FROM nr UNION SELECT b FROM nr)), bl AS (SELECT n, node, coalesce(list(nr.a ORDER BY nr.a) FILTER (nr.a IS NOT NULL), []) earlier FROM sq LEFT JOIN nr ON nr.b = node GROUP BY ALL), fd AS (SELECT 0::BIGINT n, []::BIGINT[] kept, []::BIGINT[] gone, []::BIGINT[] twins UNION ALL SELECT bl.n, CASE WHEN list_has_any(kept, earlier) THEN kept ELSE list_append(kept, node) END, CASE WHEN list_has_any(kept, earlier) THEN list_append(gone, node) ELSE gone END, CASE WHEN list_has_any(kept, earlier) THEN list_append(twins, list_min(list_intersect(kept, earlier))) ELSE twins END FROM fd JOIN bl ON bl.n = fd.n + 1), l AS (SELECT gone, twins FROM fd ORDER BY n DESC LIMIT 1), ng AS (SELECT unnest(gone) node, unnest(twins) twin FROM l), ex AS (SELECT vec_id, min(vec_id) OVER (PARTITION BY label, round(embedding[1]::DOUBLE, 2), round(embedding[2]::DOUBLE, 2)) first FROM embeddings), rm AS (SELECT vec_id, 1 p, 'exact duplicate' reason, first twin FROM ex WHERE first <> vec_id UNION ALL SELECT node, 2, 'near-identical', twin FROM ng) SELECT vec_id, arg_min(reason, p) reason, arg_min(twin, p) kept_twin FROM rm GROUP BY 1")
def clean_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From candidate pairs to the removal log: pairs above the thresholds, their cosine stored at four places; kept if that is
    NEAR or more or the signs' hashes are CHECKED bits apart at most; of near copies all but the first independent ones go, after
    the exact copies (rows whose first components are the same play those)."""
    df = table(spark, sf_dir, "embeddings")
    near = curation.near_pairs(edges(spark, sf_dir), df, NEAR, CHECKED)
    nodes = df.select(F.col("vec_id").alias("node"))
    twins = graphs.first_independent_set(nodes, near).filter("not kept").select(F.col("node").alias("key"), "twin")
    content = F.concat_ws("|", "label", *[F.round(F.col("embedding")[i].cast("double"), 2).cast("string") for i in (0, 1)])
    return curation.removals(df.withColumn("content", content), twins, "vec_id", "content")


@query("WITH " + CHAIN + " SELECT a % 37 one, b % 37 other, count(*) n, round(sum(cos), 4) weight FROM (SELECT least(a % 37, b % 37) a, greatest(a % 37, b % 37) b, cos FROM vf WHERE a % 37 <> b % 37) GROUP BY ALL")
def session_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified pairs as weighted edges between the sessions of their ends."""
    df = table(spark, sf_dir, "embeddings")
    session = df.select("vec_id", (F.col("vec_id") % 37).alias("session"))
    near = curation.near_pairs(edges(spark, sf_dir), df, NEAR, CHECKED)
    return graphs.lifted_edges(near, session, "vec_id", "session", "cos").select("one", "other", "n", F.round("weight", 4).alias("weight"))


@query("WITH RECURSIVE " + PAIRS + ", nr AS (SELECT a, b FROM pairs), sq AS (SELECT node, row_number() OVER (ORDER BY node) n FROM (SELECT a node FROM nr UNION SELECT b FROM nr)), bl AS (SELECT n, node, coalesce(list(nr.a ORDER BY nr.a) FILTER (nr.a IS NOT NULL), []) earlier FROM sq LEFT JOIN nr ON nr.b = node GROUP BY ALL), fd AS (SELECT 0::BIGINT n, []::BIGINT[] kept UNION ALL SELECT bl.n, CASE WHEN list_has_any(kept, earlier) THEN kept ELSE list_append(kept, node) END FROM fd JOIN bl ON bl.n = fd.n + 1), l AS (SELECT kept FROM fd ORDER BY n DESC LIMIT 1), g AS (SELECT b node, min(a) twin FROM nr, l WHERE list_contains(kept, a) GROUP BY 1) SELECT vec_id node, twin IS NULL OR list_contains(kept, vec_id) AS kept, CASE WHEN NOT list_contains(kept, vec_id) THEN twin END twin FROM embeddings LEFT JOIN g ON g.node = vec_id, l")
def near_dup_lfmis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in order, each kept unless an earlier kept one is its near copy."""
    nodes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"))
    return graphs.first_independent_set(nodes, edges(spark, sf_dir))


@query("WITH " + catalogue.REMOVED + " SELECT split_part(reason, ' ', 1) kind, count(*) n FROM removed WHERE starts_with(reason, 'exact') OR starts_with(reason, 'label') GROUP BY 1")
def reason_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removals whose reason begins with a word."""
    log = curation.removals(table(spark, sf_dir, "documents"), label="source")
    some = log.filter(F.col("reason").startswith("exact") | F.col("reason").startswith("label"))
    return some.groupBy(F.split("reason", " ")[0].alias("kind")).agg(F.count("*").alias("n"))


HEX = "hx AS (SELECT vec_id, label, list_transform(embedding[1:16], lambda x: floor(abs(x) * 8)::INT % 16) d FROM embeddings), hs AS (SELECT vec_id, label, array_to_string(list_transform(d, lambda i: substr('0123456789abcdef', i + 1, 1)), '') h, list_concat(list_transform(d, lambda i: i & 1), list_concat(list_transform(d, lambda i: (i >> 1) & 1), list_concat(list_transform(d, lambda i: (i >> 2) & 1), list_transform(d, lambda i: (i >> 3) & 1)))) s FROM hx)"


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, h: coarse components as a hash of 16 hexadecimal digits, and its halves high and low."""
    digit = lambda x: F.substring(F.lit("0123456789abcdef"), (F.floor(F.abs(x.cast("double")) * 8) % 16).cast("int") + 1, F.lit(1))
    half = lambda at: F.conv(F.substring("h", at, 8), 16, 10).cast("bigint")
    df = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.array_join(F.transform(F.slice("embedding", 1, 16), digit), "").alias("h"))
    return df.withColumns({"high": half(1), "low": half(9)})


def hash_pairs_sql(most: int) -> str:
    return f"WITH {HEX}, p AS (SELECT a.vec_id a, b.vec_id b, len(list_filter(list_zip(a.s, b.s), lambda x: x[1] <> x[2]))::INT bits FROM hs a JOIN hs b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT a, b, bits FROM p WHERE bits <= {most}"


@query(hash_pairs_sql(4))
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a class whose 64-bit hashes differ in at most four bits: five bands, of which one is the same."""
    return similarity.close_hashes(hashes(spark, sf_dir), 4)


@query(hash_pairs_sql(3))
def hex_hash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a class whose hashes, given as hexadecimal text, differ in at most three bits, counted on the text."""
    df = hashes(spark, sf_dir)
    near, h = similarity.close_hashes(df, 3), df.select("vec_id", "h")
    both = near.join(h.select(F.col("vec_id").alias("a"), F.col("h").alias("x")), "a").join(h.select(F.col("vec_id").alias("b"), F.col("h").alias("y")), "b")
    return both.select("a", "b", vec.hex_hamming(F.col("x"), F.col("y")).alias("bits"))


@query("WITH " + PAIRS + f", x AS (SELECT vec_id FROM embeddings WHERE vec_id % 5 = 0), y AS (SELECT vec_id FROM embeddings WHERE vec_id % 5 = 1), e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), l AS (SELECT a vec_id FROM e WHERE a IN (FROM x) AND b IN (FROM y) UNION SELECT p.vec_id FROM embeddings p, embeddings q WHERE p.vec_id IN (FROM x) AND q.vec_id IN (FROM y) AND list_inner_product(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= {OTHER}) SELECT DISTINCT vec_id FROM l")
def linked_either_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one side with an edge, in either direction, or a cosine above the threshold, to a row of another."""
    df = table(spark, sf_dir, "embeddings")
    return similarity.linked(df.filter("vec_id % 5 = 0"), df.filter("vec_id % 5 = 1"), edges(spark, sf_dir), OTHER)


@query("WITH RECURSIVE n AS (SELECT c_mktsegment, c_nationkey::VARCHAR grp, count(*) n FROM customer GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('quota|' || grp), grp) i, sum(n) OVER (PARTITION BY c_mktsegment) t FROM n), f AS (SELECT c_mktsegment, 0::BIGINT i, 0::HUGEINT have, NULL::VARCHAR grp FROM o GROUP BY 1 UNION ALL SELECT o.c_mktsegment, o.i, CASE WHEN f.have + o.n <= t * 0.2e0 * 1.05e0 THEN f.have + o.n ELSE f.have END, CASE WHEN f.have + o.n <= t * 0.2e0 * 1.05e0 THEN o.grp END FROM f JOIN o ON o.c_mktsegment = f.c_mktsegment AND o.i = f.i + 1) SELECT c_mktsegment AS label, grp c_nationkey FROM f WHERE grp IS NOT NULL")
def quota_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups taken in a drawn order while a class stays within a fifth of its rows; one that would break it is skipped."""
    return splits.quota(table(spark, sf_dir, "customer"), 0.2, "c_nationkey", "c_mktsegment", "c_mktsegment")


@query("WITH c AS (SELECT vec_id % 37 grp, label, count(*) n FROM embeddings GROUP BY ALL), t AS (SELECT label, sum(n) * 0.2e0 target FROM c GROUP BY 1), d AS (SELECT r.range try, ('0x' || substr(md5('share|' || r.range), 1, 8))::BIGINT / 4294967296e0 * 0.9e0 + 0.05e0 share FROM range(2000) r), m AS (SELECT d.try, g.grp FROM d, (SELECT DISTINCT grp FROM c) g WHERE ('0x' || substr(md5('in|' || d.try || '|' || g.grp), 1, 8))::BIGINT / 4294967296e0 < share), s AS (SELECT m.try, label, sum(n) have FROM m JOIN c USING (grp) GROUP BY ALL), e AS (SELECT d.try, max(abs(coalesce(have, 0) / target - 1)) err, bool_or(coalesce(have, 0) > target * 1.25e0) over_ FROM d CROSS JOIN t LEFT JOIN s ON s.try = d.try AND s.label = t.label GROUP BY 1), b AS (SELECT try, err FROM e WHERE NOT over_ ORDER BY err, try LIMIT 1) SELECT grp, grp IN (SELECT m.grp FROM m JOIN b USING (try)) in_pool, round((SELECT err FROM b), 6) error FROM (SELECT DISTINCT grp FROM c)")
def best_group_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of drawn subsets of the groups, that whose classes together come nearest a fifth of each."""
    got = splits.best_assignment(table(spark, sf_dir, "embeddings").withColumn("grp", F.col("vec_id") % 37), 0.2, "grp", tries=2000)
    return got.select("grp", "in_pool", r6("error"))


# ---- points of one table in boxes of another
@query("WITH p AS (SELECT o_orderkey point, o_totalprice / 1000 x, (o_custkey % 1000)::DOUBLE y FROM orders), b AS (SELECT p_partkey box, p_retailprice % 500 x0, (p_partkey * 7 % 1000)::DOUBLE y0, p_size s FROM part) SELECT point, box FROM p JOIN b ON x >= x0 AND x <= x0 + s / 5e0 AND y >= y0 AND y <= y0 + s")
def spots_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a spot (price and customer), every part as a box of its price, number and size."""
    spots = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point"), (F.col("o_totalprice") / 1000).alias("x"), (F.col("o_custkey") % 1000).alias("y"))
    x0, y0 = F.col("p_retailprice") % 500, (F.col("p_partkey") * 7 % 1000).cast("double")
    boxes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("box"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("p_size") / F.lit(5e0)).alias("x1"), (y0 + F.col("p_size")).alias("y1"))
    return regions.points_in_boxes(spots, boxes)


# ---- winners and formatted reports
@query("WITH " + GRID.replace(", cn AS", ", valid AS (SELECT * FROM pool WHERE vec_id NOT IN (SELECT vec_id FROM sup)), cn AS") + ", w AS (SELECT unnest([0.5e0, 2e0, 8e0]) a), f AS (SELECT zc.vec_id, zc.label, class, a, b, 100 * list_inner_product(q.e, t) + a * zc.z z FROM zc JOIN valid q USING (vec_id) JOIN texts USING (class), w), p AS (SELECT a, b, label, class pred FROM f QUALIFY row_number() OVER (PARTITION BY vec_id, a, b ORDER BY z DESC, class) = 1), g AS (SELECT a, b, round(avg((label = pred)::INT), 6) acc FROM p GROUP BY ALL) SELECT a, b, acc FROM g ORDER BY acc DESC, a, b LIMIT 1")
def grid_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight and sharpness of largest accuracy on validation, the first of equal ones."""
    return reports.winner(catalogue.cache_grid_search(spark, sf_dir), "acc", ["a", "b"]).select("a", "b", "acc")


@query("WITH " + RUNS + ", m AS (SELECT method, K, round_even(avg(score), 3) a, round_even(coalesce(stddev_samp(score), 0), 3) s FROM runs GROUP BY ALL), c AS (SELECT method, K, a, printf('%.3f', a) || ' ± ' || printf('%.3f', s) cell FROM m) SELECT method, " + ", ".join(f"max(cell) FILTER (K = '{s}') k_{s}" for s in reports.SIZES) + ", row_number() OVER (ORDER BY max(a) FILTER (K = '4') DESC, method)::INT place FROM c GROUP BY 1")
def formatted_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'mean ± std' for each method and support size, methods in the order of their mean at size 4."""
    return reports.formatted(reports.mean_std(run_log(spark, sf_dir), ["method", "K"], "score"), "method", "4")


@query("WITH " + RUNS + ", t AS (SELECT method, score / 100 acc, (user_id % 7)::DOUBLE macro_f1 FROM runs JOIN events ON event_id = run_id) SELECT method, " + ", ".join(f"round_even({f}({m}), 4) {m}_{n}" for m in ("acc", "macro_f1") for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"))) + " FROM t GROUP BY 1")
def metrics_by_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each metric's mean, deviation and maximum at four places, a row for each method."""
    log = run_log(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), (F.col("user_id") % 7).alias("macro_f1")), "run_id").withColumn("acc", F.col("score") / 100)
    return reports.statistics(log, "method", ["acc", "macro_f1"])


@query("WITH " + METRICS + ", nn AS (SELECT t.vec_id, t.label, p.label pred FROM test t, pool p QUALIFY row_number() OVER (PARTITION BY t.vec_id ORDER BY list_inner_product(t.e, p.e) DESC, p.vec_id) = 1), n1 AS (SELECT c class, count(*) FILTER (label = c AND pred = c) tp, count(*) FILTER (label = c) + count(*) FILTER (pred = c) al FROM nn, cls GROUP BY 1), f2 AS (SELECT class, coalesce(2 * tp / nullif(al, 0)::DOUBLE, 0) f FROM n1) SELECT class, round(cm.f1, 6) one, round(f2.f, 6) other, row_number() OVER (ORDER BY round(f2.f - cm.f1, 9), class)::INT place FROM cm JOIN f2 USING (class)")
def f1_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes in the order of what the nearest neighbour gains in F1 over zero-shot."""
    f1 = lambda df: evaluation.class_metrics(evaluation.confusion(df, 10)).select("class", "f1")
    got = reports.differences(f1(catalogue.zero_shot_predictions(spark, sf_dir)), f1(catalogue.one_nn_classify(spark, sf_dir)), "class", "f1")
    return got.select("class", r6("one"), r6("other"), "place")


@query("WITH " + RUNS + ", m AS (SELECT method, K, avg(score) mean FROM runs GROUP BY ALL) SELECT method, K, round(mean, 6) mean, round(mean - avg(mean) OVER (PARTITION BY K), 6) gain, row_number() OVER (PARTITION BY K ORDER BY mean DESC, method)::INT place FROM m")
def figure_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data behind a bar figure: each method's mean at a size, its gain over the size's mean, its place."""
    return reports.bars(run_log(spark, sf_dir), "score").select("method", "K", r6("mean"), r6("gain"), "place")


@query("WITH " + RUNS + ", m AS (SELECT method, K, avg(score) mean, min(score) lo, max(score) hi FROM runs WHERE score IS NOT NULL GROUP BY ALL), o AS (SELECT method, row_number() OVER (ORDER BY avg(mean) DESC, method)::INT place FROM m GROUP BY 1) SELECT method, K, round(mean, 6) mean, round(lo, 6) lo, round(hi, 6) hi, place, greatest(0e0, floor((min(lo) OVER (PARTITION BY K) - 0.02) * 20) / 20) \"start\", round(mean, 3) = max(round(mean, 3)) OVER (PARTITION BY K) best FROM m JOIN o USING (method)")
def figure_dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data behind a comparison by dots: mean and range of each method at a size, its row, the panel's bound and best."""
    return reports.dots(run_log(spark, sf_dir), "score").select("method", "K", r6("mean"), r6("lo"), r6("hi"), "place", "start", "best")


#: Verdicts of three models on the test items; the final one is zero-shot.
VERDICTS = CACHE + ", ff AS (SELECT vec_id, label, class pred FROM (SELECT vec_id, label, class, 100 * list_inner_product(q.e, t.t) + 2e0 * zc.z z FROM test q JOIN zc USING (vec_id, label) JOIN texts t USING (class)) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, class) = 1), zt AS (SELECT vec_id, class, 100 * list_inner_product(e, t) z FROM test, texts), zp AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) x FROM zt), zq AS (SELECT *, x / sum(x) OVER (PARTITION BY vec_id) p FROM zp), zs AS (SELECT vec_id, class pred, p conf FROM zq QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class) = 1), nn AS (SELECT t.vec_id, p.label pred FROM test t, pool p QUALIFY row_number() OVER (PARTITION BY t.vec_id ORDER BY list_inner_product(t.e, p.e) DESC, p.vec_id) = 1), vd AS (SELECT vec_id, label, zs.pred, round(conf, 6) conf, zs.pred = label AS right_, ((zs.pred = label)::INT + (nn.pred = label)::INT + (ff.pred = label)::INT)::INT n_right, 3 models FROM ff JOIN zs USING (vec_id) JOIN nn USING (vec_id))"


def three_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = [("zero_shot", catalogue.zero_shot_predictions(spark, sf_dir)), ("one_nn", catalogue.one_nn_classify(spark, sf_dir)), ("few_shot", catalogue.few_shot_predictions(spark, sf_dir))]
    return reports.verdicts(models, "zero_shot").withColumn("conf", r6("conf"))


@query("WITH " + VERDICTS + ' SELECT vec_id, label, pred, conf, right_ AS "right", n_right, models FROM vd')
def figure_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data behind a grid of models and items: how many of three models are right on every test item."""
    return three_models(spark, sf_dir)


@query("WITH " + VERDICTS + " SELECT vec_id, label, conf, n_right, models FROM vd WHERE right_ QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 6")
def figure_right_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data behind a plate of items: the first six of each class that the final model has right, with all verdicts."""
    return reports.first_of_class(three_models(spark, sf_dir).filter("right"), 6).select("vec_id", "label", "conf", "n_right", "models")


@query("WITH " + BOXES + ", m AS (SELECT 'signed' model, vec_id, embedding::DOUBLE[] h FROM embeddings UNION ALL SELECT 'absolute', vec_id, list_transform(embedding::DOUBLE[], lambda x: abs(x)) FROM embeddings), hot AS (SELECT model, vec_id, list_position(h, list_max(h)) - 1 i FROM m), xy AS (SELECT model, vec_id, (i % 8 + 0.5e0) / 8 * 0.6e0 x, (i // 8 + 0.5e0) / 8 * 0.5e0 y FROM hot), hit AS (SELECT model, vec_id, bool_or(x >= x0 AND x <= x1 AND y >= y0 AND y <= y1) hit FROM xy JOIN ba USING (vec_id) GROUP BY ALL) SELECT model, round(avg(hit::INT), 6) on_box, count(*) n FROM hit GROUP BY 1")
def heat_on_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pointing game: how often the hottest of 8 x 8 patches lies in one of the item's boxes, for two ways to read a map."""
    e = F.col("embedding").cast("array<double>")
    maps = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.create_map(F.lit("signed"), e, F.lit("absolute"), F.transform(e, F.abs))).alias("model", "heat"))
    maps = maps.select("model", "vec_id", regions.hottest(F.col("heat"), 8).alias("at"))
    maps = maps.withColumn("at", F.struct((F.col("at.x") * 0.6).alias("x"), (F.col("at.y") * 0.5).alias("y")))
    return regions.pointing_game(maps.join(boxes(spark, sf_dir), "vec_id")).select("model", r6("on_box"), "n")


@query("SELECT * FROM (VALUES (0, '| region | name |'), (1, '|-|-|')) h(n, line) UNION ALL SELECT 2 + r_regionkey, '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region")
def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small table as the lines of a Markdown table."""
    text = readers.markdown(table(spark, sf_dir, "region").orderBy("r_regionkey").select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name")))
    return spark.createDataFrame(list(enumerate(text.splitlines())), "n int, line string")


@query("WITH " + RUNS + " SELECT method, K, count(*) n, round(sum(score), 4) acc, count(DISTINCT seed) seeds FROM runs GROUP BY ALL")
def run_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs appended to a log of JSON lines in two goes and read back under its schema."""
    at = graphs.workspace(spark, "log")
    log = run_log(spark, sf_dir).select("method", "K", F.col("seed").cast("int").alias("seed"), F.col("score").alias("acc"), "run_id")
    for rest in (0, 1):
        readers.append_runs(log.filter(F.pmod("run_id", F.lit(2)) == rest).drop("run_id"), at)
    back = readers.run_log(spark, at)
    return back.groupBy("method", "K").agg(F.count("*").alias("n"), F.round(F.sum("acc"), 4).alias("acc"), F.countDistinct("seed").alias("seeds"))


@query("SELECT lower(r_name) class_name, count(*) files, max(md5(r_name || chr(10))) md5 FROM region GROUP BY 1")
def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in folders named by class ('1. Africa'), scanned with their contents' hashes."""
    at = graphs.workspace(spark, "images")
    rows = table(spark, sf_dir, "region").select(F.concat(F.col("r_regionkey").cast("string"), F.lit(". "), F.initcap("r_name")).alias("folder"), "r_name")
    names = [r[0] for r in rows.select("folder").distinct().orderBy("folder").collect()]  # five folders
    for name in names:
        rows.filter(F.col("folder") == name).select("r_name").coalesce(1).write.text(f"{at}/{name}")
    return readers.files(spark, at, "part-*").groupBy("class_name").agg(F.count("*").alias("files"), F.max("md5").alias("md5"))


@query("SELECT * FROM (VALUES ('beans', 2, 'a leaf of {}.', 3::BIGINT)) t(domain, classes, template, items)")
def domain_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A domain opened with its overrides from a JSON file, and its items, the cleaned table before the raw one."""
    top = graphs.workspace(spark, "domains")
    readers.write_json(spark, {"templates": ["a leaf of {}."], "unknown": 1}, f"{top}/beans/prompts.json")
    raw = spark.createDataFrame([(f"p{i}", i % 2, "x", "m", 0) for i in range(5)], readers.ITEMS)
    raw.coalesce(1).write.parquet(f"{top}/beans/items")
    raw.limit(3).coalesce(1).write.parquet(f"{top}/beans/items_clean")
    d = domains.Domain.open(spark, "beans", top, classes=("rust", "scab"))
    settings = readers.read_json(spark, f"{d.folder}/prompts.json", "templates array<string>")
    return settings.select(F.lit(d.name).alias("domain"), F.lit(len(d.classes)).alias("classes"), F.element_at("templates", 1).alias("template")).join(d.items(spark).agg(F.count("*").alias("items")))


@query("WITH " + ITEMS + ", " + ", ".join(support_sql(f"s{k}", k, 1) for k in (1, 4)) + " SELECT vec_id, label FROM s4")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support sets stored by split, size and seed, and one of them read."""
    at = graphs.workspace(spark, "splits")
    for k in (1, 4):
        rows = support(spark, sf_dir, k, 1).select("vec_id", "label", F.lit("support").alias("split"), F.lit(str(k)).alias("k"), F.lit(1).alias("seed"))
        readers.save_splits(rows, at)
    return readers.splits(spark, at, "support", "4", 1).select("vec_id", "label")


@query("SELECT vec_id, array_to_string(list_transform(range(10), lambda c: (c = label)::INT), '') one_hot, CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 2 END kind FROM embeddings")
def one_hot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hot labels, and the kind of a node: 1 for the object's, 2 for the rest."""
    df = table(spark, sf_dir, "embeddings")
    return df.select("vec_id", F.array_join(vec.one_hot(F.col("label"), 10).cast("array<string>"), "").alias("one_hot"), F.when(F.col("vec_id") % 4 == 0, 1).otherwise(2).alias("kind"))


@query("WITH " + ITEMS + ", p AS (SELECT t.vec_id test_id, p.vec_id pool_id, round(list_inner_product(t.e, p.e), 6) cos FROM test t, pool p QUALIFY row_number() OVER (PARTITION BY t.vec_id ORDER BY list_inner_product(t.e, p.e) DESC, p.vec_id) = 1) SELECT * FROM p ORDER BY cos DESC, test_id LIMIT 16")
def top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen test rows that lie nearest to a pool row."""
    near = similarity.nearest(tests(spark, sf_dir), pool(spark, sf_dir)).select(F.col("vec_id").alias("test_id"), F.col("near_id").alias("pool_id"), r6("cos"))
    return near.orderBy(F.desc("cos"), "test_id").limit(16)


@query("WITH " + ITEMS + ", tl AS (SELECT vec_id, range::INT r, e[range * 16 + 1:range * 16 + 16] v FROM items, range(4)), tu AS (SELECT vec_id, r, " + unit_sql("v") + " u FROM tl), s AS (SELECT t.vec_id, t.r, max(list_inner_product(t.u, p.u)) FILTER (i.label < 5) - max(list_inner_product(t.u, p.u)) FILTER (i.label >= 5) m FROM tu t JOIN test q USING (vec_id), tu p JOIN pool i USING (vec_id) WHERE p.r = 0 GROUP BY ALL) SELECT vec_id, round(max(m), 6) margin, arg_max(r, m) tile FROM s GROUP BY 1")
def tile_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest prototype margin of an item's tiles (its vector's quarters); first quarters of the pool are the prototypes."""
    tile = lambda r: vec.normalized(F.slice("embedding", r * 16 + 1, 16))
    t = tests(spark, sf_dir).select("vec_id", F.posexplode(F.array(*[tile(r) for r in range(4)])).alias("tile", "embedding"))
    p = pool(spark, sf_dir).withColumn("embedding", tile(0))
    return similarity.tile_margins(t, p.filter("label < 5"), p.filter("label >= 5")).select("vec_id", r6("margin"), "tile")


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings), q AS (SELECT vec_id, range i, e[range * 16 + 1:range * 16 + 16] v FROM v, range(4)), c AS (SELECT vec_id, k, avg(v[k]) a, max(v[k]) b, min(v[k]) d, stddev_samp(v[k]) s, sum(v[k] * exp(v[k])) / sum(exp(v[k])) w FROM q, range(1, 17) t(k) GROUP BY ALL) SELECT vec_id, round(sum(a), 5) mean, round(sum(b), 5) max, round(sum(d), 5) min, round(sum(s), 5) std, round(sum(w), 5) softmax FROM c GROUP BY 1")
def patch_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aggregations of the patch graph over an item's patches (its vector's quarters), summed."""
    names = ("mean", "max", "min", "std", "softmax")

    def run(pdfs):
        for pdf in pdfs:
            h = Var(np.stack(pdf["embedding"].to_list()).astype(float).reshape(-1, 4, 16))
            out = {m: graphmethods.aggregated(h, m, Var(np.ones(1))).value.sum(1).round(5) for m in names}
            yield pd.DataFrame({"vec_id": pdf["vec_id"], **out})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id bigint, " + ", ".join(f"{m} double" for m in names))


@query("WITH d AS (SELECT vec_id, label, count(*) OVER (PARTITION BY label) n FROM embeddings), w AS (SELECT vec_id, label, 1e0 / n w FROM d), c AS (SELECT *, sum(w) OVER (ORDER BY vec_id ROWS UNBOUNDED PRECEDING) hi, sum(w) OVER () t FROM w), u AS (SELECT range i, ('0x' || substr(md5('draw|' || range), 1, 8))::BIGINT / 4294967296e0 u FROM range(500)) SELECT i, min(vec_id) vec_id FROM u JOIN c ON round(hi / t, 9) > round(u, 9) GROUP BY 1")
def weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hundred draws with replacement in which every class is as likely as any other."""
    df = table(spark, sf_dir, "embeddings")
    n = df.groupBy("label").agg(F.count("*").alias("n"))
    return sampling.drawn(df.join(F.broadcast(n), "label").select("vec_id", (1e0 / F.col("n")).alias("w")), 500, "draw", "vec_id", "w")


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings), d AS (SELECT vec_id, i, e[i * 8 + 1:i * 8 + 8] v FROM v, range(8) t(i)), u AS (SELECT vec_id, i, " + unit_sql("v") + " u FROM d), p AS (SELECT a, b FROM (" + "SELECT a.vec_id a, b.vec_id b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= " + str(SAME) + ")), m AS (SELECT p.a, p.b, x.i, y.i j, sqrt(greatest(0, 2 - 2 * list_inner_product(x.u, y.u))) d FROM p JOIN u x ON x.vec_id = p.a JOIN u y ON y.vec_id = p.b), r AS (SELECT *, row_number() OVER (PARTITION BY a, b, i ORDER BY d, j) fwd, row_number() OVER (PARTITION BY a, b, j ORDER BY d, i) bwd, lead(d) OVER (PARTITION BY a, b, i ORDER BY d, j) later FROM m) SELECT a, b, count(*)::INT matches FROM r WHERE fwd = 1 AND bwd = 1 AND d < 0.95e0 * later GROUP BY ALL HAVING count(*) >= 4")
def keypoint_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a class with four or more mutual keypoint matches; eight keypoints to an item, cut from its vector."""
    part = lambda i, n: F.transform(F.slice("embedding", i * 8 + 1, n), lambda x: x.cast("double"))
    df = table(spark, sf_dir, "embeddings")
    k = df.select("*", F.array(*[part(i, 2) for i in range(8)]).alias("xy"), F.array(*[vec.normalized(part(i, 8)) for i in range(8)]).alias("desc"))
    return similarity.verified_pairs(k, SAME, least=4, ratio=0.95, inliers=False).select("a", "b", "matches")


@query()
def leakage_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of a linear probe and of the nearest neighbour on a split by group and on a random one."""
    df = table(spark, sf_dir, "embeddings")
    mine = (F.col("vec_id") % 37) % 5 == 0
    out = None
    text = np.zeros((10, DIM))
    for name, p, t in (("random", pool(spark, sf_dir), tests(spark, sf_dir)), ("grouped", df.filter(mine), df.filter(~mine))):
        shown = splits.support(p, 16, 1)
        probe = classifiers.METHODS["linear_probe"](text).fit(classifiers.batch(shown), classifiers.batch(splits.support(p.join(shown.select("vec_id"), "vec_id", "left_anti"), 16, 2)))
        got = {"linear_probe": classifiers.predict(t, probe).select("vec_id", "pred"), "one_nn": similarity.nearest(t, p, carry="label").select("vec_id", F.col("near_label").alias("pred"))}
        for method, x in got.items():
            row = labelled(x, spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("pred")).cast("double")), 6).alias("acc")).select(F.lit(name).alias("split"), F.lit(method).alias("method"), "n", "acc")
            out = row if out is None else out.union(row)
    return out


@query("WITH " + TEXTS + ", " + BOXES + ", c AS (SELECT vec_id, k, least(1, greatest(0, x0)) a, least(1, greatest(0, x1)) b FROM ba WHERE score >= 0.1e0), p AS (SELECT c.vec_id, k, class, sum(x.e[i] * t.t[i]) z FROM c JOIN (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings) x USING (vec_id), texts t, range(1, 65) r(i) WHERE i > floor(a * 64) AND i <= greatest(floor(a * 64) + 8, floor(b * 64)) GROUP BY ALL), w AS (SELECT vec_id, k, class FROM p QUALIFY row_number() OVER (PARTITION BY vec_id, k ORDER BY round(z, 9) DESC, class) = 1) SELECT vec_id, class, count(*) n, round(count(*) / sum(count(*)) OVER (PARTITION BY vec_id)::DOUBLE, 6) share FROM w GROUP BY vec_id, class")
def crowded_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects found in an item, each cut out (the components that its box spans), classified and counted."""
    kept = boxes(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    one = kept.select("vec_id", "embedding", F.posexplode(F.filter("boxes", lambda b: b["score"] >= 0.1)).alias("k", "b"))
    share = lambda x: F.least(F.lit(1e0), F.greatest(F.lit(0e0), x))
    start = F.floor(share(F.col("b.x0")) * DIM)
    end = F.greatest(start + 8, F.floor(share(F.col("b.x1")) * DIM))
    cut = F.transform("embedding", lambda x, i: F.when((i >= start) & (i < end), x.cast("double")).otherwise(0e0))
    crops = one.select((F.col("vec_id") * 8 + F.col("k")).alias("crop"), cut.alias("embedding"))
    z = similarity.scores(crops, texts(spark, sf_dir), 1.0, key="crop").withColumn("z", F.round("z", 9))
    pred = evaluation.predicted(z, "crop").select(F.floor(F.col("crop") / 8).cast("bigint").alias("vec_id"), F.col("pred").alias("class"))
    n = pred.groupBy("vec_id", "class").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("vec_id")), 6))


@query("SELECT doc_id, len(text)::INT n, CASE WHEN doc_id <= (SELECT max(doc_id) FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50)) THEN 1 ELSE 2 END go FROM documents")
def resumed_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extraction that first does fifty items, then in batches what is left; go tells in which each item was done."""
    docs, at = table(spark, sf_dir, "documents").select("doc_id", "text"), graphs.workspace(spark, "extracted")
    make = lambda go: lambda df: df.select("doc_id", F.length("text").alias("n"), F.lit(go).alias("go"))
    readers.resumed(docs, at, make(1), "doc_id", limit=50)
    return readers.resumed(docs, at, make(2), "doc_id", batch=60)


# ---- data sources
@query("WITH " + RUNS + " SELECT method, K, count(*) n, round(sum(score), 4) acc, count(DISTINCT seed) seeds FROM runs WHERE method IS NOT NULL GROUP BY ALL")
def run_log_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs appended to a log by two appends at once, as two drivers would, and read back by format."""
    at = graphs.workspace(spark, "log")
    log = run_log(spark, sf_dir).select("method", "K", F.col("seed").cast("int").alias("seed"), F.col("score").alias("acc"), "run_id")
    with ThreadPoolExecutor(2) as both:
        list(both.map(lambda rest: formats.append_runs(log.filter(F.pmod("run_id", F.lit(2)) == rest).drop("run_id"), at), (0, 1)))
    back = spark.read.format("run_log").load(at)
    return back.groupBy("method", "K").agg(F.count("*").alias("n"), F.round(F.sum("acc"), 4).alias("acc"), F.countDistinct("seed").alias("seeds"))


@query("SELECT 'p' || l_orderkey AS path, count(*) n, round(sum(l_quantity), 6) total FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY 1")
def ground_truth_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all line items written as text and read by format, the label's filter pushed to the lines; boxes of a path added up."""
    at = graphs.workspace(spark, "lines")
    fields = [F.concat(F.lit("p"), F.col("l_orderkey").cast("string")), F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("string"), F.lit("0"), F.lit("1"), F.lit("1")]
    table(spark, sf_dir, "lineitem").select(F.concat_ws(" ", *fields)).write.text(at)
    formats.register(spark)
    got = spark.read.format("ground_truth").load(at).filter(F.col("label").isin(1, 2))
    total = F.aggregate("boxes", F.lit(0e0), lambda s, b: s + b[0])
    return got.groupBy("path").agg(F.sum(F.size("boxes")).alias("n"), F.round(F.sum(total), 6).alias("total"))


# ---- table functions, called from SQL
@query(catalogue.ORACLES["nms"])
def nms_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppression as a table function over the boxes of all items, partitioned by item."""
    tables.register(spark)
    rows = boxes(spark, sf_dir).select(F.col("vec_id").alias("item"), F.posexplode("boxes").alias("k", "b")).select("item", "k", "b.*")
    return spark.sql("SELECT item vec_id, count(*)::INT n, round(max(score), 6) best FROM suppressed(TABLE(SELECT * FROM {rows}) PARTITION BY item) GROUP BY item", rows=rows)


@query("WITH e AS (SELECT vec_id, 300 + (vec_id % 400) w, 200 + (vec_id % 90) h FROM embeddings), x AS (SELECT vec_id, w, h, greatest(0, floor((w - 224) / 112)) + 1 nx, greatest(0, floor((h - 224) / 112)) + 1 ny FROM e), t AS (SELECT vec_id, w, h, nx, c, r FROM x, range(8) a(c), range(8) b(r) WHERE c < nx AND r < ny) SELECT vec_id, (r * nx + c)::INT place, round(least(1, c * 112 / w), 6) x0, round(least(1, (r * 112 + 224) / h), 6) y1 FROM t")
def tiles_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of items of differing sizes from a table function."""
    tables.register(spark)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), (300 + F.col("vec_id") % 400).alias("width"), (200 + F.col("vec_id") % 90).alias("height"))
    return spark.sql("SELECT item vec_id, place, round(x0, 6) x0, round(y1, 6) y1 FROM tiles(TABLE(SELECT * FROM {rows}), 224, 112)", rows=rows)


# ---- streams, run until what is there has been read
def drained(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """What a stream has given once all that is there is read, as a table."""
    at = graphs.workspace(spark, "stream")
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query("WITH e AS (SELECT event_type, value, ts, time_bucket(INTERVAL '1 hour', ts) \"start\" FROM events), w AS (SELECT \"start\", event_type, count(*) n, round(sum(value), 4) total FROM e GROUP BY ALL) SELECT strftime(\"start\", '%Y-%m-%d %H:%M') \"start\", event_type, n, total FROM w WHERE \"start\" + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted in windows of an hour as they arrive; only windows that the watermark has passed are there."""
    at = graphs.workspace(spark, "events")
    events = table(spark, sf_dir, "events").select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    events.coalesce(4).write.parquet(at)
    got = drained(logs.event_windows(spark.readStream.schema(events.schema).parquet(at), "1 hour"), spark)
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH " + RUNS + " SELECT method, K, count(DISTINCT seed) n FROM runs GROUP BY ALL")
def stream_run_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log read as a stream: of runs that are there several times one is left."""
    at = graphs.workspace(spark, "tailed")
    log = run_log(spark, sf_dir).select("method", "K", F.col("seed").cast("int").alias("seed"), F.col("score").alias("acc"), F.lit("last-epoch").alias("variant"))
    readers.append_runs(log.coalesce(2), at)
    got = drained(logs.tail(spark, at).select("method", "K", "seed"), spark)
    return got.groupBy("method", "K").agg(F.count("*").alias("n"))


@query("WITH " + ITEMS + f" SELECT t.vec_id, p.vec_id near_id, round(list_inner_product(t.e, p.e), 6) cos FROM test t, pool p WHERE list_inner_product(t.e, p.e) >= {SAME} QUALIFY row_number() OVER (PARTITION BY t.vec_id ORDER BY list_inner_product(t.e, p.e) DESC, p.vec_id) = 1")
def stream_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving rows, batch by batch, that are linked to a reference set."""
    at = graphs.workspace(spark, "arrivals")
    rows = tests(spark, sf_dir).select("vec_id", "embedding")
    rows.coalesce(3).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    logs.check_arrivals(stream, pool(spark, sf_dir), SAME, lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}"), f"{at}/checkpoint").awaitTermination()
    found = spark.read.schema("vec_id bigint, near_id bigint, cos double").parquet(f"{at}/out")
    return found.select("vec_id", "near_id", r6("cos"))


@query("WITH RECURSIVE " + hash_pairs_sql(4)[5:].split(" SELECT a, b, bits")[0] + ", e AS (SELECT a, b FROM p WHERE bits <= 4), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT a node, a root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node WHERE r.root < u.b) SELECT node vec_id, least(node, min(root)) root FROM r GROUP BY node")
def stream_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving rows, file by file, whose hash differs in at most four bits from that of another arrival of their class, and the smallest row that each hangs together with."""
    at = graphs.workspace(spark, "arrivals")
    rows = hashes(spark, sf_dir).select("vec_id", "label", "high", "low", F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("vec_id"), F.lit(600))).alias("ts"))
    rows.repartition(3).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    found = drained(arrivals.links(stream, 4, forest=True), spark)
    return graphs.components(found.select(F.col("late").alias("a"), F.col("early").alias("b"))).select(F.col("node").alias("vec_id"), "root")

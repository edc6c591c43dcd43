"""Registered queries: draws, splits, balance, curves, models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import series as SR
from ..operators import balance as B
from ..operators import evaluation as E
from ..operators import labels as L
from ..operators import models as M
from ..operators import sampling as N
from ..operators import stacks as ST
from ..operators import timeseries as TS
from ..functions import values as V
from ..session import scratch, settled
from ..sources import sinks as SK
from .catalog_labels import _case, rounded
from .registry import IMAGES_SQL, PIXELS_SQL, SCORES_SQL, images, pixels, polygons, query, scores, series, table

H = "md5(concat_ws('#', {}, {}))"


def _s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


@query("N1_draw_points", f"""WITH g AS (SELECT 'id_' || p_partkey AS id, p_size / 10.0::DOUBLE AS latitude, p_retailprice AS longitude FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)),
s AS (SELECT * FROM g ORDER BY {H.format(42, 'id')}, id LIMIT 25) SELECT id, latitude AS "YCoordinate", longitude AS "XCoordinate" FROM s""")
def _(spark, d):
    g = table(spark, d, "part").select(F.concat(F.lit("id_"), _s("p_partkey")).alias("id"), (F.col("p_size") / 10.0).alias("latitude"), F.col("p_retailprice").alias("longitude"))
    done = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.concat(F.lit("id_"), _s("l_partkey")).alias("id"))
    return N.draw_points(g, done, 25)


@query("N2_pixels_per_image", "WITH " + PIXELS_SQL + f""", r AS (SELECT file_id, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY file_id ORDER BY {H.format(42, 'file_id, l_orderkey, l_linenumber, l_partkey')}, l_orderkey, l_linenumber, l_partkey) AS rn FROM pixels)
SELECT file_id, l_orderkey, l_linenumber, l_partkey FROM r WHERE rn <= 100""")
def _(spark, d):
    return N.pixels_per_image(pixels(spark, d), 100, ["l_orderkey", "l_linenumber", "l_partkey"]).select("file_id", "l_orderkey", "l_linenumber", "l_partkey")


@query("N3_pick_images", "WITH " + IMAGES_SQL + f" SELECT unique_id FROM images WHERE percent_coverage > 0 AND irrigation > 1 ORDER BY {H.format(42, 'unique_id')}, unique_id LIMIT 10")
def _(spark, d):
    return N.pick_images(images(spark, d), 10).select("unique_id")


@query("N4_budget_sites", "WITH " + IMAGES_SQL + f""", k AS (SELECT image_id, bool_or(operator_initials = 'KL') AS has_kl FROM images GROUP BY 1), u AS (SELECT i.unique_id, i.year, k.has_kl FROM images i JOIN k USING (image_id) WHERE i.unique_id IN (SELECT min(unique_id) FROM images GROUP BY image_id)),
c AS (SELECT greatest(0, 4000 - count(*)) AS b FROM u WHERE has_kl), rest AS (SELECT *, count(*) OVER () AS tot, count(*) OVER (PARTITION BY year) AS n FROM u WHERE NOT has_kl),
q AS (SELECT rest.*, least(n, greatest(1, CAST(round_even(b * n / tot::DOUBLE, 0) AS BIGINT))) AS quota, b FROM rest, c), p AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY {H.format(42, 'unique_id')}, unique_id) AS rn FROM q),
f AS (SELECT *, row_number() OVER (ORDER BY {H.format(42, 'unique_id')}, unique_id) AS k FROM p WHERE rn <= quota)
SELECT unique_id, CAST(CASE WHEN has_kl OR unique_id IN (SELECT unique_id FROM f WHERE k <= b) THEN 1 ELSE 2 END AS INTEGER) AS part FROM u""")
def _(spark, d):
    i = images(spark, d)
    per = i.groupBy("image_id").agg(F.bool_or(F.col("operator_initials") == "KL").alias("has_kl"), F.min("unique_id").alias("unique_id"), F.min("year").alias("year"))
    return N.budget_sites(per, 4000, "has_kl").select("unique_id", "part")


def _sites_sql(y="CAST(max(CAST(o_orderpriority = '5-LOW' AS INTEGER)) AS INTEGER)"):
    return f"sites AS (SELECT CAST(o_custkey AS VARCHAR) AS site, {y} AS y FROM orders GROUP BY 1)"


def _sites(spark, d):
    return table(spark, d, "orders").groupBy(_s("o_custkey").alias("site")).agg(F.max((F.col("o_orderpriority") == "5-LOW").cast("int")).alias("y"))


@query("N5_one_shot_split", "WITH " + _sites_sql() + f""", p AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {H.format(42, 'site')}, site) - 1 AS pos, count(*) OVER (PARTITION BY y) AS n FROM sites), t AS (SELECT *, greatest(1, CAST(round(n * 0.2::DOUBLE) AS BIGINT)) AS nt FROM p)
SELECT site, y, true AS stratified, CASE WHEN pos < nt THEN 'test' WHEN pos < nt + greatest(1, CAST(round((n - nt) * (0.2::DOUBLE / (1 - 0.2::DOUBLE))) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM t""")
def _(spark, d):
    return N.one_shot_split(_sites(spark, d))


@query("N6_heldout_and_folds", "WITH " + _sites_sql() + f""", p AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {H.format(42, 'site')}, site) - 1 AS pos, count(*) OVER (PARTITION BY y) AS n FROM sites), t AS (SELECT site, y, pos < greatest(1, CAST(round(n * 0.2::DOUBLE) AS BIGINT)) AS test FROM p),
f AS (SELECT site, y, row_number() OVER (PARTITION BY y ORDER BY {H.format(43, 'site')}, site) - 1 AS pos FROM t WHERE NOT test)
SELECT site, y, CAST(pos % 5 + 1 AS INTEGER) AS fold, 'train' AS split FROM f UNION ALL SELECT site, y, CAST(NULL AS INTEGER), 'test' FROM t WHERE test""")
def _(spark, d):
    return N.heldout_and_folds(_sites(spark, d))


@query("N7_group_shuffle", "WITH " + _sites_sql() + f", p AS (SELECT site, row_number() OVER (ORDER BY {H.format(42, 'site')}, site) - 1 AS pos, count(*) OVER () AS n FROM sites) SELECT site, CASE WHEN pos < ceil(n * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM p")
def _(spark, d):
    return N.group_shuffle(_sites(spark, d), 0.3)


@query("L8_disjoint_splits", "SELECT count(*) AS shared_sites FROM orders WHERE false")
def _(spark, d):
    return N.shared_sites(N.one_shot_split(_sites(spark, d))).agg(F.count("*").alias("shared_sites"))


@query("W4_split_manifest", "WITH " + _sites_sql() + f""", p AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {H.format(42, 'site')}, site) - 1 AS pos, count(*) OVER (PARTITION BY y) AS n FROM sites), t AS (SELECT site, y, pos < greatest(1, CAST(round(n * 0.2::DOUBLE) AS BIGINT)) AS test FROM p),
f AS (SELECT site, row_number() OVER (PARTITION BY y ORDER BY {H.format(43, 'site')}, site) - 1 AS pos FROM t WHERE NOT test), a AS (SELECT site, CAST(pos % 5 + 1 AS INTEGER) AS fold, 'train' AS split FROM f UNION ALL SELECT site, CAST(NULL AS INTEGER), 'test' FROM t WHERE test)
SELECT split, fold, count(DISTINCT a.site) AS sites, count(*) AS files FROM a JOIN orders ON CAST(o_custkey AS VARCHAR) = a.site GROUP BY 1, 2""")
def _(spark, d):
    files = table(spark, d, "orders").select(_s("o_custkey").alias("site"), _s("o_orderkey").alias("stem"))
    return SK.split_metadata(files.join(N.heldout_and_folds(_sites(spark, d)), "site"))


@query("N8_rule_split", "WITH " + IMAGES_SQL + f""", w AS (SELECT *, contains(source_file, '1-25') AS ps, contains(source_file, '26-50') AS ex FROM images),
b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {_case(V.PRIORITY_PS_FIRST)}, unique_id) AS rn FROM w WHERE ps), e AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {_case(V.PRIORITY_TRAIN)}, unique_id) AS rn FROM w WHERE ex),
t AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {_case(V.PRIORITY_TRAIN)}, unique_id) AS rn FROM w WHERE NOT ps AND NOT ex)
SELECT unique_id, CASE WHEN rn = 1 THEN 'test_base' ELSE 'test_duplicates' END AS split FROM b UNION ALL SELECT unique_id, 'test_extra' FROM e WHERE rn = 1 UNION ALL SELECT unique_id, 'train' FROM t WHERE rn = 1""")
def _(spark, d):
    return L.rule_split(images(spark, d), ["1-25"], ["26-50"], V.PRIORITY_PS_FIRST, V.PRIORITY_TRAIN).select("unique_id", "split")


@query("N9_downsample_zero", f"""WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity > 45 AS INTEGER) AS y FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {H.format(42, 'l_orderkey, l_linenumber, l_partkey')}, l_orderkey, l_linenumber, l_partkey) AS rn FROM o)
SELECT l_orderkey, l_linenumber, l_partkey, y FROM r WHERE y = 1 OR rn <= (SELECT CAST(floor(count(*) * 3.0) AS BIGINT) FROM o WHERE y = 1)""")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") > 45).cast("int").alias("y"))
    return N.downsample_zero(li, "y", ["l_orderkey", "l_linenumber", "l_partkey"])


@query("N11_group_splits", "WITH " + IMAGES_SQL + " SELECT site_id, count(*) AS n, count(*) FILTER (irrigation = 5) AS pos FROM images GROUP BY 1 HAVING count(*) >= 20 AND count(*) FILTER (irrigation = 5) >= 30")
def _(spark, d):
    return N.group_splits(images(spark, d).withColumn("y", (F.col("irrigation") == 5).cast("int")), "site_id", "y", 20, 30)


@query("N12_stratum_weights", "WITH " + SCORES_SQL + " SELECT doc_id, CASE WHEN stratum = 'en' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM scores")
def _(spark, d):
    return N.stratum_weights(scores(spark, d), "stratum", "en", 3.0).select("doc_id", "weight")


@query("J8_pair_by_uid", "SELECT CAST(l.doc_id AS VARCHAR) AS uid, d.source AS image_path, l.quality AS mask, CASE WHEN d.doc_id % 3 = 0 THEN d.lang END AS json_path FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def _(spark, d):
    doc = table(spark, d, "documents")
    img = doc.select(_s("doc_id").alias("uid"), F.col("source").alias("image_path"))
    msk = table(spark, d, "labels").select(_s("doc_id").alias("uid"), F.col("quality").alias("mask"))
    js = doc.filter("doc_id % 3 = 0").select(_s("doc_id").alias("uid"), F.col("lang").alias("json_path"))
    return ST.pair_by_uid(img, msk, js)


@query("J9_pair_preferred", """WITH l AS (SELECT doc_id, 'plain_' || doc_id AS label_path, false AS v FROM labels UNION ALL SELECT doc_id, 'KL_' || doc_id, true FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'JL_' || doc_id, true FROM labels WHERE doc_id % 5 = 0)
SELECT CAST(d.doc_id AS VARCHAR) AS pair_id, arg_min(label_path, (NOT v, label_path)) AS label_path FROM documents d JOIN l ON d.doc_id = l.doc_id GROUP BY 1""")
def _(spark, d):
    lab = table(spark, d, "labels")

    def part(df, prefix, variant):
        return df.select(_s("doc_id").alias("pair_id"), F.concat(F.lit(prefix), _s("doc_id")).alias("label_path"), F.lit(variant).alias("is_variant"))

    both = part(lab, "plain_", False).unionByName(part(lab.filter("quality = 1"), "KL_", True)).unionByName(part(lab.filter("doc_id % 5 = 0"), "JL_", True))
    return ST.pair_preferred(table(spark, d, "documents").select(_s("doc_id").alias("pair_id")), both)


@query("J19_site_labels", """WITH s AS (SELECT DISTINCT source AS site FROM documents), t AS (SELECT source AS site, CAST(arg_max(CAST(quality AS INTEGER), l.doc_id) AS INTEGER) AS y FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE d.source <> 'src7' GROUP BY 1), p AS (SELECT source AS site, CAST(bool_or(n_chars > 5000) AS INTEGER) AS y FROM documents WHERE lang <> 'en' GROUP BY 1)
SELECT s.site, CAST(coalesce(t.y, p.y, 0) AS INTEGER) AS y FROM s LEFT JOIN t USING (site) LEFT JOIN p USING (site)""")
def _(spark, d):
    doc = table(spark, d, "documents").select("doc_id", F.col("source").alias("site"), "n_chars", "lang")
    t = table(spark, d, "labels").join(doc, "doc_id").filter("site <> 'src7'").select("site", F.col("doc_id").alias("line"), F.col("quality").alias("irrigation"))
    px = doc.filter("lang <> 'en'").select("site", (F.col("n_chars") > 5000).cast("int").alias("irrigated"))
    return N.site_labels(doc, t, px)


@query("S11_load_report", """WITH s AS (SELECT DISTINCT doc_id FROM documents), m AS (SELECT doc_id FROM documents WHERE lang <> 'de'), p AS (SELECT doc_id FROM labels)
SELECT count(*) AS listed, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM m)) AS not_in_manifest, count(*) FILTER (doc_id IN (SELECT doc_id FROM m) AND doc_id NOT IN (SELECT doc_id FROM p)) AS without_pixels, count(*) FILTER (doc_id IN (SELECT doc_id FROM m) AND doc_id IN (SELECT doc_id FROM p)) AS loaded FROM s""")
def _(spark, d):
    doc = table(spark, d, "documents")
    return ST.load_report(doc, doc.filter("lang <> 'de'"), table(spark, d, "labels"), "doc_id")


@query("S11_load_listed", "SELECT l.doc_id, CAST(l.doc_id % 10 AS INTEGER) AS row, CAST(l.doc_id % 7 AS INTEGER) AS col, l.toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE d.lang <> 'de'")
def _(spark, d):
    doc = table(spark, d, "documents")
    px = table(spark, d, "labels").withColumns({"row": (F.col("doc_id") % 10).cast("int"), "col": (F.col("doc_id") % 7).cast("int")})
    return ST.load_listed(doc, doc.filter("lang <> 'de'"), px, ["toxic"], "doc_id")


@query("W6_unfinished", "WITH " + IMAGES_SQL + " SELECT DISTINCT site_id, year FROM images WHERE (site_id, year) NOT IN (SELECT (site_id, year) FROM images WHERE percent_coverage > 84)")
def _(spark, d):
    i = images(spark, d)
    return SK.unfinished(i.select("site_id", "year").distinct(), i.filter("percent_coverage > 84"), ["site_id", "year"])


# --- curves and metrics -------------------------------------------------------

CURVE_SQL = SCORES_SQL + """, g AS (SELECT p AS threshold, count(*) FILTER (y = 1) AS pos, count(*) AS n FROM scores GROUP BY 1), cv AS (SELECT threshold, pos, n, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS flagged, CAST(sum(pos) OVER () AS BIGINT) AS total_pos, CAST(sum(n) OVER () AS BIGINT) AS total FROM g WINDOW w AS (ORDER BY threshold DESC)),
f AS (SELECT *, tp / flagged::DOUBLE AS pr, tp / total_pos::DOUBLE AS rc FROM cv), ff AS (SELECT *, 2 * pr * rc / (pr + rc + 1e-8) AS f1 FROM f)
"""


@query("M6_precision_recall_curve", "WITH " + CURVE_SQL + " SELECT threshold, tp, flagged, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1 FROM ff")
def _(spark, d):
    return rounded(E.with_precision_recall(E.score_curve(scores(spark, d), "y", "p")).select("threshold", "tp", "flagged", "precision", "recall", "f1"))


@query("M6_best_threshold", "WITH " + CURVE_SQL + " SELECT threshold, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1 FROM ff ORDER BY ff.f1 DESC, threshold LIMIT 1")
def _(spark, d):
    return rounded(E.best_threshold(E.score_curve(scores(spark, d), "y", "p")))


AUC_SQL = CURVE_SQL + """, au AS (SELECT sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*) AS auc FROM scores a, scores b WHERE a.y = 1 AND b.y = 0), ap AS (SELECT sum(pr * pos) / max(total_pos) AS ap, max(total) AS n, max(total_pos) AS n_pos FROM ff)"""


@query("M7_curve_metrics", "WITH " + AUC_SQL + " SELECT round(ap, 6) AS average_precision, round(auc, 6) AS roc_auc, n, n_pos FROM ap, au")
def _(spark, d):
    return rounded(E.curve_metrics(E.score_curve(scores(spark, d), "y", "p")))


@query("M7_hard_metrics", "WITH " + SCORES_SQL + """, h AS (SELECT fold, y, CAST(p > 0.4 AS INTEGER) AS g FROM scores), c AS (SELECT fold, count(*) FILTER (y = 1 AND g = 1) AS tp, count(*) FILTER (y = 0 AND g = 1) AS fp, count(*) FILTER (y = 1 AND g = 0) AS fn, count(*) FILTER (y = 0 AND g = 0) AS tn FROM h GROUP BY 1)
SELECT fold, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1_score,
 round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp)::DOUBLE * (tn + fn)), 6) AS mcc, round((tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2, 6) AS balanced_accuracy FROM c""")
def _(spark, d):
    s = scores(spark, d).withColumn("g", (F.col("p") > 0.4).cast("int"))
    return rounded(E.hard_metrics(s, "y", "g", ["fold"]))


@query("M11_metrics_at", "WITH " + AUC_SQL + """, c AS (SELECT count(*) FILTER (y = 1 AND p >= 0.5)::DOUBLE AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn FROM scores)
SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1_score, round(ap, 6) AS average_precision, round(auc, 6) AS roc_auc FROM c, ap, au""")
def _(spark, d):
    return rounded(E.metrics_at(scores(spark, d), "y", "p"))


@query("M15_stratum_thresholds", "WITH " + SCORES_SQL + """, th AS (SELECT round(0.05 + 0.05 * i, 2)::DOUBLE AS t FROM (SELECT unnest(range(0, 19)) AS i)), st AS (SELECT DISTINCT stratum AS s FROM scores),
r AS (SELECT s, t, count(*) FILTER (y = 1 AND p >= t) AS tp, count(*) FILTER (y = 0 AND p >= t) AS fp, count(*) FILTER (y = 1 AND p < t) AS fn FROM st, th, scores WHERE y = 0 OR stratum = s GROUP BY 1, 2), f AS (SELECT s, t, CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1 FROM r)
SELECT s AS stratum, arg_min(t, (-f1, t)) AS threshold, round(max(f1), 6) AS f1 FROM f GROUP BY 1""")
def _(spark, d):
    s = scores(spark, d)
    strata = ["de", "en", "es", "fr", "ru", "zh", "it", "pt"]
    return rounded(E.stratum_thresholds(s, "stratum", "y", "p", strata))


@query("M16_lift", "WITH " + SCORES_SQL + ", m AS (SELECT CAST(fold AS VARCHAR) AS label, avg(CAST(y = pred AS INTEGER)) AS acc FROM scores GROUP BY 1) SELECT label, round(acc, 6) AS acc, round(acc - (SELECT acc FROM m WHERE label = '0'), 6) AS lift_acc FROM m")
def _(spark, d):
    m = scores(spark, d).groupBy(_s("fold").alias("label")).agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("acc"))
    return rounded(E.lift_over(m, "0", ["acc"]))


# --- models: a rule that any right model must return ---------------------------

# Every vector is a series with gaps whose level follows its label, far apart between the classes; the target is a rule on the label.
RULE_SQL = """r AS (SELECT vec_id AS id, CAST(label >= 7 AS INTEGER) AS y, label, vec_id // 4 % 5 AS fold, 2016 + vec_id % 10 AS year,
  list_extract(['smallholder', 'medium', 'large'], CAST(vec_id % 3 + 1 AS INTEGER)) AS stratum, CASE WHEN vec_id // 4 % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM embeddings)"""
ONES = "1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1_score, 1.0::DOUBLE AS average_precision, 1.0::DOUBLE AS roc_auc"
SCORES_ONE = ["precision", "recall", "f1_score", "average_precision", "roc_auc"]
STRATA = ("smallholder", "medium", "large")


# Over the series the target is a rule that a model has to find in noise: whether the present ones of five steps are wet on average, and one label in twenty is wrong, by a hash
# of the row. Models see the filled series of all 64 steps.
WET, WET_FROM, WET_STEPS = 0.02, 10, 5
WRONG = "vec_id * 2654435761 % 4294967296 {} 65536 % 20 = 0"
NOISY_SQL = f"""wet AS (SELECT vec_id, list_filter(list_transform(range({WET_FROM}, {WET_FROM + WET_STEPS}), lambda t: CASE WHEN (vec_id * 7 + t * 3) % 5 <> 0 AND vec_id % 97 <> 5 THEN CAST(embedding[t + 1] AS DOUBLE) END), lambda x: x IS NOT NULL) AS steps FROM embeddings),
r AS (SELECT vec_id AS id, CAST(coalesce(list_sum(steps) / len(steps) > {WET}, false) <> ({WRONG.format("//")}) AS INTEGER) AS y, vec_id // 4 % 5 AS fold, 2016 + vec_id % 10 AS year,
  list_extract(['smallholder', 'medium', 'large'], CAST(vec_id % 3 + 1 AS INTEGER)) AS stratum, CASE WHEN vec_id // 4 % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM wet)"""


def _marked(rows, v, y=None):
    """id, y, raw series ``v`` (null where missing), site fold, year, stratum, split by site."""
    k = F.col("vec_id")
    return rows.select(
        k.alias("id"), ((F.col("label") >= 7) if y is None else y).cast("int").alias("y"), v.alias("v"), F.expr("cast(vec_id div 4 % 5 as int)").alias("fold"), (2016 + k % 10).cast("int").alias("year"),
        F.element_at(F.array(*[F.lit(x) for x in STRATA]), (k % 3 + 1).cast("int")).alias("stratum"),
        F.when(F.expr("vec_id div 4 % 4 = 0"), "test").otherwise("train").alias("split"))


def _rule_rows(spark, d, steps: int = 42):
    k = F.col("vec_id")
    level = 10.0 * F.col("label") + F.when(F.col("label") >= 7, 100.0).otherwise(0.0)
    v = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.when((k * 7 + i * 3) % 5 != 0, level))
    return _marked(table(spark, d, "embeddings"), v)


def _series_rows(spark, d):
    """The embedding series themselves, 64 steps with their gaps, and the noisy target."""
    steps = F.filter(F.slice("v", WET_FROM + 1, WET_STEPS), lambda x: x.isNotNull())
    wet = F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(steps), F.lit(0)) > WET
    return _marked(series(spark, d), F.col("v"), F.coalesce(wet, F.lit(False)) != F.expr(WRONG.format("div")))


def _filled(spark, d, rows=_rule_rows):
    return rows(spark, d).withColumn("v", SR.interpolate("v"))


def _vec(spark, d, rows=_rule_rows):
    return M.with_vector(_filled(spark, d, rows), "v")


def model_query(name, sql, series_sql, scores, judge=None):
    """A query over the made-up rows and, as ``name_series``, over the embedding series with their noisy target. There SQL gives rows and counts, and each of the ``scores`` must reach its
    floor, which a model that has learnt nothing does not."""
    def register(made):
        query(name, sql)(lambda spark, d: made(spark, d, _rule_rows))
        query(f"{name}_series", series_sql)(lambda spark, d: (judge or above)(made(spark, d, _series_rows), scores))
        return made

    return register


#: What a score must reach on the noisy target, two rows in five of which are positive. Scores by chance: 0.5 for both curves' areas' ranks, the share of positives for precision and average precision, no correlation.
FLOORS = {"roc_auc": 0.58, "average_precision": 0.5, "auprc": 0.5, "precision": 0.52, "recall": 0.25, "f1_score": 0.35, "accuracy": 0.6, "balanced_accuracy": 0.55, "mcc": 0.1}


def floor_of(score):
    """Floor of a score by its name; deviations, thresholds and recalls of one stratum have none but 0, lifts -1."""
    base = score.removesuffix("_mean")
    return -1.0 if base.startswith("lift") else FLOORS.get(base, 0.0)


def above(rows, scores, where=None):
    """``rows`` with, for each of the ``scores``, whether it is from its floor to 1; where ``where`` does not hold, from 0."""
    low = lambda c: F.lit(floor_of(c)) if where is None else F.when(where, floor_of(c)).otherwise(F.lit(min(0.0, floor_of(c))))
    return rows.withColumns({c: F.coalesce(F.col(c).between(low(c), F.lit(1.0)), F.lit(False)) for c in scores})


def bounds_sql(scores):
    return ", ".join(f"true AS {c}" for c in scores)


def judged(guesses, _):
    """Counts of guessed rows, and whether the guesses are better than chance."""
    names = ["precision", "recall", "f1_score", "accuracy"]
    guesses = settled(guesses)
    counts = guesses.agg(F.struct(F.count("*").alias("n"), F.sum("y").alias("pos"))).scalar()
    return above(E.binary_metrics(guesses, "y", "guess"), names).withColumn("c", counts).select("c.n", "c.pos", *names)


def _guesses(spark, d, rows, kind, params=None, balanced=True):
    data = _vec(spark, d, rows)
    s = M.score(M.fit(data.filter("split = 'train'"), kind, params, balanced=balanced), data.filter("split = 'test'"))
    return s.select("id", "y", (F.col("p") >= 0.5).cast("int").alias("guess"))


GUESS_SQL = "WITH " + RULE_SQL + " SELECT id, y, y AS guess FROM r WHERE split = 'test'"
GUESSED_SQL = "WITH " + NOISY_SQL + " SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS pos, true AS precision, true AS recall, true AS f1_score, true AS accuracy FROM r WHERE split = 'test'"
BOUNDS = bounds_sql(SCORES_ONE)


@model_query("M1_random_forest", GUESS_SQL, GUESSED_SQL, [], judged)
def _(spark, d, rows):
    return _guesses(spark, d, rows, "random_forest")


@model_query("W8_save_model", GUESS_SQL, GUESSED_SQL, [], judged)
def _(spark, d, rows):
    """Saved, loaded and scored."""
    data = _vec(spark, d, rows)
    folder = scratch(spark, "model")
    M.save_model(M.fit(data.filter("split = 'train'"), "random_forest"), folder)
    return M.score(M.load_model(folder), data.filter("split = 'test'")).select("id", "y", (F.col("p") >= 0.5).cast("int").alias("guess"))


@model_query("M2_gradient_boosting", GUESS_SQL, GUESSED_SQL, [], judged)
def _(spark, d, rows):
    return _guesses(spark, d, rows, "gradient_boosting", balanced=False)


@model_query("M3_model_choice", GUESS_SQL, GUESSED_SQL, [], judged)
def _(spark, d, rows):
    """A tree by name; the forest parameter in the list is not one of its own and is left out."""
    return _guesses(spark, d, rows, "decision_tree", {"numTrees": 99})


MODELS_SQL = "SELECT unnest(['forest_full', 'forest_small', 'forest_tiny', 'boosting', 'tree', 'linear']) AS model, "


@model_query("M4_compare_models", MODELS_SQL + ONES, MODELS_SQL + BOUNDS, SCORES_ONE)
def _(spark, d, rows):
    data = _vec(spark, d, rows)
    return rounded(M.compare_models(data.filter("split = 'train'"), data.filter("split = 'test'")).select("model", *SCORES_ONE))


@query("M5_standardise", """WITH c AS (SELECT vec_id AS id, vec_id % 4 = 0 AS test, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings), m AS (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb FROM c WHERE NOT test)
SELECT id, round((a - ma) / sa, 6) AS a, round((b - mb) / sb, 6) AS b FROM c, m WHERE test""")
def _(spark, d):
    e = M.with_vector(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 2).alias("v")), "v")
    s = M.standardised(e.filter("id % 4 <> 0"), e.filter("id % 4 = 0"))
    return rounded(s.select("id", F.col("xs")[0].alias("a"), F.col("xs")[1].alias("b")))


# A forest scores a perfect rule 0 or 1, so the best threshold is 1 and the published strict comparison leaves no hit.
@query("M8_train_fold", "WITH " + RULE_SQL + """, t AS (SELECT count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM r WHERE fold = 0)
SELECT 1.0::DOUBLE AS threshold, 0::BIGINT AS tp, 0::BIGINT AS fp, pos AS fn, neg AS tn, 0.0::DOUBLE AS precision, 0.0::DOUBLE AS recall, 1.0::DOUBLE AS average_precision, 1.0::DOUBLE AS roc_auc, round(pos / (pos + neg)::DOUBLE, 6) AS irrigation_ratio FROM t""")
def _(spark, d):
    return _fold(spark, d, _rule_rows)


def _fold(spark, d, rows):
    data = settled(_filled(spark, d, rows))
    m = M.train_fold(data.filter("fold <> 0"), data.filter("fold = 0"))[1]
    return rounded(m.select("threshold", "tp", "fp", "fn", "tn", "precision", "recall", "average_precision", "roc_auc", "irrigation_ratio"))


FOLD_SCORES = ["threshold", "precision", "recall", "average_precision", "roc_auc"]


@query("M8_train_fold_series", "WITH " + NOISY_SQL + ", t AS (SELECT count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM r WHERE fold = 0) SELECT pos, neg, " + bounds_sql(FOLD_SCORES) + ", round(pos / (pos + neg)::DOUBLE, 6) AS irrigation_ratio FROM t")
def _(spark, d):
    m = _fold(spark, d, _series_rows).select((F.col("tp") + F.col("fn")).alias("pos"), (F.col("fp") + F.col("tn")).alias("neg"), *FOLD_SCORES, "irrigation_ratio")
    return above(m, FOLD_SCORES)


M9_METRICS = ["accuracy", "precision", "recall", "f1_score", "average_precision", "roc_auc", "mcc", "balanced_accuracy"]
M9_BOUNDS = [f"{m}_{part}" for m in M9_METRICS for part in ("mean", "std")]


@model_query("M9_cross_validate", "WITH " + RULE_SQL + ", f AS (SELECT fold, avg(CAST(y = 0 AS DOUBLE)) AS a FROM r GROUP BY 1) SELECT round(avg(a), 6) AS accuracy_mean, round(stddev_pop(a), 6) AS accuracy_std, " + ", ".join(
    f"{v}::DOUBLE AS {m}_mean, 0.0::DOUBLE AS {m}_std" for m, v in (("precision", 0.0), ("recall", 0.0), ("f1_score", 0.0), ("average_precision", 1.0), ("roc_auc", 1.0), ("mcc", 0.0), ("balanced_accuracy", 0.5))) + ", count(*) AS n_folds FROM f",
    f"SELECT {bounds_sql(M9_BOUNDS)}, 5::BIGINT AS n_folds", M9_BOUNDS)
def _(spark, d, rows):
    config = {"folds": [0, 1, 2, 3, 4], "model": {"type": "random_forest", "params": {"min_samples_leaf": 1}}, "sampling": {"target_ratio": 3.0, "use_smote": True}, "metrics": M9_METRICS}
    return rounded(M.experiment(_filled(spark, d, rows), config))


def curve_told(curve, scores):
    """F1 on the training rows near 1 at every share, on the others above chance from two thirds of the rows on."""
    low = F.when(F.col("part") == "train", 0.8).when(F.col("share") > 0.6, FLOORS["f1_score"]).otherwise(0.0)
    return curve.withColumns({"mean": F.col("mean").between(low, F.lit(1.0)), "std": F.col("std").between(0, 0.5)})


CURVE_ROWS_SQL = "SELECT unnest([0.1, 0.28, 0.46, 0.64, 0.82, 1.0])::DOUBLE AS share, part, {} FROM (SELECT unnest(['train', 'validation']) AS part)"


@model_query("M10_learning_curve", CURVE_ROWS_SQL.format("1.0::DOUBLE AS mean, 0.0::DOUBLE AS std"), CURVE_ROWS_SQL.format("true AS mean, true AS std"), ["mean", "std"], curve_told)
def _(spark, d, rows):
    return rounded(M.learning_curve(_filled(spark, d, rows), M.SHARES, [0, 1, 2, 3, 4]))


LEVELS_SQL = """WITH l AS (SELECT 'drop' AS sweep, unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6])::DOUBLE AS level UNION ALL SELECT 'noise', unnest([0.0, 0.02, 0.05, 0.08, 0.12, 0.16, 0.2])::DOUBLE)
SELECT model, sweep, level, {} FROM l, (SELECT unnest(['forest_full', 'forest_small']) AS model)"""


@model_query("M12_robustness", LEVELS_SQL.format(ONES), LEVELS_SQL.format(BOUNDS), SCORES_ONE, lambda rows, names: above(rows, names, F.col("level") <= 0.05))
def _(spark, d, rows):
    """Both forests at all 14 levels; the raw test series are degraded, gaps included."""
    train = settled(_vec(spark, d, rows).filter("split = 'train'"))
    names = ("forest_full", "forest_small")
    models = dict(zip(names, M.each(train, lambda name: M.fit(train, *M.COMPARISON[name]), names)))
    return rounded(M.robustness(models, rows(spark, d).filter("split = 'test'").select("id", "y", "v")).select("model", "sweep", "level", *SCORES_ONE))


SETTINGS_SQL = "SELECT unnest(['in_distribution', 'early_to_late', 'late_to_early']) AS setting, "


@model_query("M13_year_transfer", SETTINGS_SQL + ONES, SETTINGS_SQL + BOUNDS, SCORES_ONE)
def _(spark, d, rows):
    return rounded(M.year_transfer(_vec(spark, d, rows), "year", 2020, *M.COMPARISON["forest_small"]).select("setting", *SCORES_ONE))


GROUPS_SQL = "WITH " + RULE_SQL + ", g AS (SELECT stratum FROM r GROUP BY 1 HAVING count(*) >= 20 AND sum(y) >= 5) SELECT stratum, {} FROM g"


@model_query("M13_leave_group_out", GROUPS_SQL.format(ONES), GROUPS_SQL.format(BOUNDS).replace(RULE_SQL, NOISY_SQL), SCORES_ONE)
def _(spark, d, rows):
    return rounded(M.leave_group_out(_vec(spark, d, rows), "stratum", None, *M.COMPARISON["forest_small"]).select("stratum", *SCORES_ONE))


EXPERIMENTS = {
    "E0 baseline": ("full_mean", "full_p90"), "E2 centre": ("center_mean",), "E3 20 m": ("d20m_mean",), "E3 30 m": ("d30m_mean",),
    "E4 max": ("full_max", "full_mean"), "E4 share": ("full_frac_high", "full_mean"), "E5 x3": ("full_mean", "full_p90"), "E5 x5": ("full_mean", "full_p90")}
VARIANTS = ("full_mean", "full_p90", "center_mean", "d20m_mean", "d30m_mean", "full_max", "full_frac_high")
STRATUM_SCORES = ["precision", "recall", "f1_score", "auprc", *[f"recall_{s}" for s in STRATA]]
COUNTED_SQL = bounds_sql(STRATUM_SCORES) + ", " + ", ".join(f"count(*) FILTER (y = 1 AND stratum = '{s}') AS n_{s}" for s in STRATA) + " FROM r WHERE split = 'test'"
STRATUM_COUNTS_SQL = "1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1_score, 1.0::DOUBLE AS auprc, " + ", ".join(
    f"1.0::DOUBLE AS recall_{s}, count(*) FILTER (y = 1 AND stratum = '{s}') AS n_{s}" for s in STRATA) + " FROM r WHERE split = 'test'"


EXPERIMENTS_SQL = "WITH " + RULE_SQL + ", x AS (SELECT " + STRATUM_COUNTS_SQL + "), l AS (SELECT unnest([" + ", ".join(
    [f"{{'label': '{k}', 'n': {len(v) * 3}}}" for k, v in EXPERIMENTS.items()] + ["{'label': 'E6 thresholds', 'n': 1}"]) + """]) AS e)
SELECT e.label AS label, CAST(e.n AS INTEGER) AS n_feats, x.*, 0.0::DOUBLE AS lift_recall_smallholder FROM l, x"""


@model_query("M14_experiments", EXPERIMENTS_SQL, EXPERIMENTS_SQL.replace(RULE_SQL, NOISY_SQL).replace(STRATUM_COUNTS_SQL, COUNTED_SQL).replace("0.0::DOUBLE AS lift", "true AS lift"), [*STRATUM_SCORES, "lift_recall_smallholder"])
def _(spark, d, source):
    """All nine experiments on one shared split; columns are the spatial variants of three steps."""
    rows = _filled(spark, d, source)
    columns = [f"ndvi_{v}_t{t:02d}" for v in VARIANTS for t in range(3)]
    wide = settled(rows.select("*", *[F.col("v")[WET_FROM + int(c[-2:])].alias(c) for c in columns]))

    def row(label):
        times = {"E5 x3": 3.0, "E5 x5": 5.0}.get(label)
        data = N.stratum_weights(wide, "stratum", "smallholder", times) if times else wide
        return M.run_experiment(data, M.variant_columns(columns, EXPERIMENTS[label]), label, extra_weight="weight" if times else None)

    out = M.each(wide, row, EXPERIMENTS)
    out.append(M.stratum_experiment(M.with_vector(wide, "v"), "E6 thresholds", [0, 1, 2, 3, 4]))
    names = ["label", "n_feats", "precision", "recall", "f1_score", "auprc", *[f"{p}_{s}" for s in STRATA for p in ("recall", "n")]]
    return rounded(E.lift_over(reduce(DataFrame.unionByName, out).select(*names), "E0 baseline", ["recall_smallholder"]))


E6_SQL = "WITH " + RULE_SQL + " SELECT 'E6' AS label, "


@model_query("M15_out_of_fold_thresholds", E6_SQL + STRATUM_COUNTS_SQL, E6_SQL.replace(RULE_SQL, NOISY_SQL) + COUNTED_SQL, STRATUM_SCORES)
def _(spark, d, rows):
    """Thresholds from site folds of the training rows, refit, held-out test."""
    names = ["label", "precision", "recall", "f1_score", "auprc", *[f"{p}_{s}" for s in STRATA for p in ("recall", "n")]]
    return rounded(M.stratum_experiment(_vec(spark, d, rows), "E6", [0, 1, 2, 3, 4]).select(*names))


@query("M17_top_features", "SELECT CAST(i AS INTEGER) AS pos, 'v_t' || lpad(CAST(i AS VARCHAR), 2, '0') AS feature, CASE WHEN i = 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS importance FROM (SELECT unnest(range(0, 42)) AS i) ORDER BY importance DESC, i LIMIT 15")
def _(spark, d):
    """Only step 10 tells the classes apart."""
    rows = _filled(spark, d).withColumn("v", F.transform("v", lambda x, i: F.when(i == 10, x).otherwise(0.0)))
    model = M.fit(M.with_vector(rows, "v"), "random_forest", {"featureSubsetStrategy": "all"})
    return rounded(M.top_features(model, [f"v_t{i:02d}" for i in range(42)], 15))


@query("M17_top_features_series", "SELECT 15::BIGINT AS n, true AS importance, true AS falling, true AS wet")
def _(spark, d):
    """All 64 steps of the series; the first five hold at least three of those that decide."""
    model = M.fit(_vec(spark, d, _series_rows), "random_forest")
    top = M.top_features(model, [f"v_t{i:02d}" for i in range(64)], 15).agg(F.count("*").alias("n"), F.collect_list("importance").alias("all"), F.slice(F.collect_list("pos"), 1, WET_STEPS).alias("first"))
    wet = F.size(F.filter("first", lambda p: p.between(WET_FROM, WET_FROM + WET_STEPS - 1))) >= 3
    return top.select("n", wet.alias("wet"), F.forall("all", lambda x: (x > 0) & (x < 1)).alias("importance"), (F.sort_array("all", asc=False) == F.col("all")).alias("falling"))


GRID_SQL = "WITH " + RULE_SQL + """, p AS (SELECT id % 7 AS file_id, CAST(id // 7 // 50 AS INTEGER) AS "row", CAST(id // 7 % 50 AS INTEGER) AS col, y FROM r WHERE id % 3 <> 1), h AS (SELECT max("row") AS top FROM p),
g AS (SELECT file_id, CAST(a AS INTEGER) AS "row", CAST(b AS INTEGER) AS col FROM (SELECT DISTINCT file_id FROM p), (SELECT unnest(range(0, (SELECT top FROM h) + 1)) AS a), (SELECT unnest(range(0, 50)) AS b))
SELECT g.file_id, g."row", g.col, CAST(coalesce(y, -1) AS INTEGER) AS guess FROM g LEFT JOIN p ON g.file_id = p.file_id AND g."row" = p."row" AND g.col = p.col"""


@query("M18_predict_grid", GRID_SQL)
def _(spark, d):
    return _grid(spark, d, _rule_rows)


@query("M18_predict_grid_series", GRID_SQL.replace(RULE_SQL, NOISY_SQL).replace("SELECT g.file_id, g.\"row\", g.col, CAST(coalesce(y, -1) AS INTEGER) AS guess FROM g", "SELECT g.file_id, count(*) AS pixels, count(*) FILTER (y IS NULL) AS missing, true AS right_guesses FROM g") + " GROUP BY 1")
def _(spark, d):
    """Pixels and missing ones of each image, and whether three guesses in four are right (three in five are the commoner class)."""
    truth = _series_rows(spark, d).select((F.col("id") % 7).alias("file_id"), F.expr("cast(id div 7 div 50 as int)").alias("row"), F.expr("cast(id div 7 % 50 as int)").alias("col"), "y")
    met = _grid(spark, d, _series_rows).join(truth, ["file_id", "row", "col"], "left")
    told = F.col("guess") >= 0
    return met.groupBy("file_id").agg(
        F.count("*").alias("pixels"), F.count_if(~told).alias("missing"), (F.avg(F.when(told, (F.col("guess") == F.col("y")).cast("double"))) >= 0.75).alias("right_guesses"))


def _grid(spark, d, rows):
    """Every image as high as the data need; pixels without a guess (every third id) are -1."""
    from ..operators.raster import rebuild_mask

    data = _vec(spark, d, rows)
    model = M.fit(data.filter("split = 'train'"), "random_forest")
    guesses = settled(M.score(model, data.filter("id % 3 <> 1")).select(
        (F.col("id") % 7).alias("file_id"), F.expr("cast(id div 7 div 50 as int)").alias("row"), F.expr("cast(id div 7 % 50 as int)").alias("col"), (F.col("p") >= 0.5).cast("int").alias("guess")))
    height = (guesses.agg(F.max("row")).first()[0] or 0) + 1
    return rebuild_mask(guesses, guesses, height, 50, "guess")


@query("T14_cluster_series", """SELECT count(*) AS n_pixels, round(avg(CAST(label >= 7 AS DOUBLE)), 6) AS frac_irrigated, 100.0 * (label % 4)::DOUBLE AS first_mean, 100.0 * (label % 4)::DOUBLE AS last_mean, 42 AS steps
FROM embeddings WHERE vec_id % 97 <> 5 GROUP BY label % 4""")
def _(spark, d):
    """Four levels of series; those that miss most of their steps take no part."""
    rows = _rule_rows(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    v = F.transform("v", lambda x, i: F.when(x.isNotNull() & ((F.col("id") % 97 != 5) | (i < 10)), 100.0 * (F.col("label") % 4)))
    report = M.cluster_report(M.cluster_series(rows.withColumn("v", v), "v", 4), "y")
    return rounded(report.select("n_pixels", "frac_irrigated", F.col("mean_curve")[0].alias("first_mean"), F.element_at("mean_curve", -1).alias("last_mean"), F.size("mean_curve").alias("steps")))


@query("T14_cluster_series_series", "WITH " + NOISY_SQL + " SELECT CAST(count(*) AS BIGINT) AS n_pixels, CAST(count(*) FILTER (y = 1) AS BIGINT) AS n_irrigated, 4::BIGINT AS clusters, 64 AS steps FROM r WHERE id % 97 <> 5")
def _(spark, d):
    """The embedding series; those that miss all their steps take no part."""
    report = M.cluster_report(M.cluster_series(_series_rows(spark, d), "v", 4), "y")
    return report.agg(
        F.sum("n_pixels").alias("n_pixels"), F.round(F.sum(F.col("n_pixels") * F.col("frac_irrigated"))).cast("bigint").alias("n_irrigated"), F.count("*").alias("clusters"), F.max(F.size("mean_curve")).alias("steps"))


@query("N10_nearest_neighbours", """WITH p AS (SELECT vec_id AS id, embedding AS v FROM embeddings WHERE label >= 7), j AS (SELECT a.id, b.id AS neighbour, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2)) AS d FROM p a JOIN p b ON a.id <> b.id)
SELECT id, neighbour, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbour) AS rn FROM j) WHERE rn <= 5""")
def _(spark, d):
    p = table(spark, d, "embeddings").filter("label >= 7").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return B.nearest_neighbours(p, "id", "v", 5, block_rows=60)


@query("N10_oversample", "SELECT CAST(CASE WHEN label >= 7 THEN 1 ELSE 0 END AS INTEGER) AS y, synthetic, CASE WHEN synthetic THEN (SELECT greatest(0, count(*) FILTER (label < 7) - count(*) FILTER (label >= 7)) FROM embeddings) ELSE count(*) END AS n FROM embeddings, (SELECT unnest([true, false]) AS synthetic) WHERE label >= 7 OR NOT synthetic GROUP BY 1, 2")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") >= 7).cast("int").alias("y"), F.col("embedding").alias("v"))
    return B.oversample(e, "y", "id", "v").groupBy("y", "synthetic").agg(F.count("*").alias("n"))


@query("M7_best_split_metrics", "WITH " + AUC_SQL + """, b AS (SELECT threshold FROM ff ORDER BY f1 DESC, threshold LIMIT 1), c AS (SELECT count(*) FILTER (y = 1 AND p > threshold) AS tp, count(*) FILTER (y = 0 AND p > threshold) AS fp, count(*) FILTER (y = 1 AND p <= threshold) AS fn, count(*) FILTER (y = 0 AND p <= threshold) AS tn, any_value(threshold) AS threshold FROM scores, b)
SELECT threshold, tp, fp, fn, tn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(ap, 6) AS average_precision, round(auc, 6) AS roc_auc, round((tp + fn) / (tp + fp + fn + tn)::DOUBLE, 6) AS irrigation_ratio FROM c, ap, au""")
def _(spark, d):
    return rounded(M.fold_metrics(scores(spark, d)).select("threshold", "tp", "fp", "fn", "tn", "precision", "recall", "average_precision", "roc_auc", "irrigation_ratio"))

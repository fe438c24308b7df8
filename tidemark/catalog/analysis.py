"""Queries of metrics, drift, correlation, vectors, graphs, risk and streams."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordered import gone_at_exit, shared_folder
from ..operators import clustering, correlation, drift, graphs, labels, metrics, models, risk, vectors
from ..plans import datasets
from ..streaming import bars
from .base import PREDICTIONS_SQL, SERIES_SQL, TICKS_SQL, TRADES_SQL, hourly, lag_sql, predictions_of, query, read, ticks, trades_of, with_candles

C = with_candles
ORDER = ("l_shipdate", "l_orderkey", "l_linenumber")
_ORDER = "l_shipdate, l_orderkey, l_linenumber"


@query("regression_metrics", f"WITH {PREDICTIONS_SQL} SELECT count(*) AS n, sqrt(avg((y - s) ** 2)) AS rmse, avg(abs(y - s)) AS mae, 100 * avg(CASE WHEN y <> 0 THEN abs((y - s) / y) END) AS mape_nonzero, 1 - sum((y - s) ** 2) / (var_pop(y) * count(*)) AS r2 FROM pred WHERE y IS NOT NULL AND s IS NOT NULL", "n", "rmse mae mape_nonzero r2")
def regression_metrics(spark, d):
    return metrics.regression(predictions_of(spark, d), "y", "s")


_CONFUSION = "count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y <> 1 AND p = 1) AS fp, count(*) FILTER (y <> 1 AND p <> 1) AS tn, count(*) FILTER (y = 1 AND p <> 1) AS fn"


@query("confusion_metrics", f"WITH {PREDICTIONS_SQL} SELECT *, (tp + tn)::DOUBLE / (tp + fp + tn + fn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM (SELECT {_CONFUSION} FROM pred WHERE y IS NOT NULL AND p IS NOT NULL)", "tp fp tn fn", "accuracy precision recall")
def confusion_metrics(spark, d):
    return metrics.confusion(predictions_of(spark, d))


@query("confusion_table", f"WITH {PREDICTIONS_SQL} SELECT y AS actual, p AS predicted, count(*) AS n FROM pred GROUP BY y, p", "actual predicted n")
def confusion_table(spark, d):
    return metrics.confusion_table(predictions_of(spark, d))


@query("per_class_metrics", f"WITH {PREDICTIONS_SQL}, c AS (SELECT unnest([0, 1]) AS label) SELECT label, (SELECT count(*) FROM pred WHERE y = label) AS support, coalesce((SELECT count(*) FROM pred WHERE y = label AND p = label) / nullif((SELECT count(*) FROM pred WHERE p = label), 0), 0) AS precision, coalesce((SELECT count(*) FROM pred WHERE y = label AND p = label) / nullif((SELECT count(*) FROM pred WHERE y = label), 0), 0) AS recall FROM c", "label support", "precision recall")
def per_class_metrics(spark, d):
    return metrics.per_class(predictions_of(spark, d).filter("y IS NOT NULL AND p IS NOT NULL"))


_CLASSES = "c AS (SELECT y AS label FROM pred UNION SELECT p FROM pred), k AS (SELECT label, (SELECT count(*) FROM pred WHERE y = label) AS support, (SELECT count(*) FROM pred WHERE p = label) AS named, (SELECT count(*) FROM pred WHERE y = label AND p = label) AS hit FROM c), s AS (SELECT support, CASE WHEN named > 0 THEN hit / named ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall FROM k), t AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM s)"
_AVERAGES = [f"{kind}_{c}" for kind in ("macro", "weighted") for c in ("precision", "recall", "f1")]


@query("averaged_metrics", f"WITH {PREDICTIONS_SQL}, {_CLASSES} SELECT {', '.join(f'avg({c}) AS macro_{c}, sum({c} * support) / sum(support) AS weighted_{c}' for c in ('precision', 'recall', 'f1'))} FROM t", "", " ".join(_AVERAGES))
def averaged_metrics(spark, d):
    return metrics.averaged(metrics.per_class(predictions_of(spark, d)))


@query("roc_auc", f"WITH {PREDICTIONS_SQL}, r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS k FROM pred WHERE y IS NOT NULL AND s IS NOT NULL) SELECT sum(y)::BIGINT AS positives, (count(*) - sum(y))::BIGINT AS negatives, (sum(CASE WHEN y = 1 THEN k ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM r", "positives negatives", "auc")
def roc_auc(spark, d):
    return metrics.roc_auc(predictions_of(spark, d))


@query("average_precision", f"WITH {PREDICTIONS_SQL}, r AS (SELECT y, sum(y) OVER w / row_number() OVER w AS pr FROM pred WHERE y IS NOT NULL AND s IS NOT NULL WINDOW w AS (ORDER BY s DESC, doc_id ROWS UNBOUNDED PRECEDING)) SELECT sum(y)::BIGINT AS positives, sum(y * pr) / sum(y) AS average_precision FROM r", "positives", "average_precision")
def average_precision(spark, d):
    return metrics.average_precision(predictions_of(spark, d))


@query("log_loss", f"WITH {PREDICTIONS_SQL} SELECT count(s) AS n, avg(-CASE WHEN y = 1 THEN ln(greatest(1e-15, least(1 - 1e-15, s))) ELSE ln(1 - greatest(1e-15, least(1 - 1e-15, s))) END) AS log_loss FROM pred WHERE s IS NOT NULL", "n", "log_loss")
def log_loss(spark, d):
    return metrics.log_loss(predictions_of(spark, d).filter("s IS NOT NULL"))


_BINS = f"WITH {PREDICTIONS_SQL}, b AS (SELECT least(9, floor(s * 10))::INT AS bin, s, y FROM pred WHERE s IS NOT NULL) SELECT g.bin, count(b.s) AS n, coalesce(avg(b.s), (g.bin + 0.5) / 10) AS mean_probability, coalesce(avg(CASE WHEN b.s IS NOT NULL THEN (b.y = 1)::INT END), 0) AS positive_share FROM (SELECT unnest(range(10))::INT AS bin) g LEFT JOIN b USING (bin) GROUP BY g.bin"


@query("calibration_bins", _BINS, "bin n", "mean_probability positive_share")
def calibration_bins(spark, d):
    return metrics.calibration(predictions_of(spark, d))


@query("calibration_error", f"SELECT avg(abs(mean_probability - positive_share)) AS mean_gap, sum(abs(mean_probability - positive_share) * n) / sum(n) AS weighted_gap FROM ({_BINS}) WHERE n > 0", "", "mean_gap weighted_gap")
def calibration_error(spark, d):
    return metrics.calibration_error(metrics.calibration(predictions_of(spark, d)))


@query("trade_metrics", f"WITH {TRADES_SQL} SELECT l_returnflag, count(*) AS n, count(*) FILTER (r > 0) AS wins, sum(r) FILTER (r > 0) / -sum(r) FILTER (r < 0) AS profit_factor, avg(r) AS expectancy, avg((r > 0)::INT) AS win_rate, avg(r) FILTER (r > 0) / abs(avg(r) FILTER (r < 0)) AS risk_reward, sqrt(252.0) * avg(r) / stddev_samp(r) AS sharpe, sqrt(252.0) * avg(r) / stddev_samp(r) FILTER (r < 0) AS sortino FROM trades GROUP BY l_returnflag", "l_returnflag n wins", "profit_factor expectancy win_rate risk_reward sharpe sortino")
def trade_metrics(spark, d):
    return metrics.trades(trades_of(spark, d), by=("l_returnflag",))


@query("risk_metrics", f"WITH {TRADES_SQL}, v AS (SELECT l_returnflag, quantile_cont(r, 0.05) AS var_95, quantile_cont(r, 0.01) AS var_99, avg(r) / stddev_samp(r) AS sharpe_plain FROM trades GROUP BY l_returnflag) SELECT v.*, (SELECT avg(r) FROM trades t WHERE t.l_returnflag = v.l_returnflag AND r <= v.var_95) AS cvar_95 FROM v", "l_returnflag", "var_95 var_99 cvar_95 sharpe_plain")
def risk_metrics(spark, d):
    return metrics.risk(trades_of(spark, d), by=("l_returnflag",))


_CURVE = f"curve AS (SELECT *, 1000000 + sum(r) OVER w AS equity FROM trades WINDOW w AS (PARTITION BY l_returnflag ORDER BY {_ORDER})), dd AS (SELECT *, greatest(1000000, max(equity) OVER (PARTITION BY l_returnflag ORDER BY {_ORDER})) AS peak FROM curve)"


@query("equity_drawdown", f"WITH {TRADES_SQL}, {_CURVE} SELECT l_returnflag, min((equity - peak) / peak) AS max_drawdown, max(peak) - min(equity) AS global_drawdown FROM dd GROUP BY l_returnflag", "l_returnflag", "max_drawdown global_drawdown")
def equity_drawdown(spark, d):
    curve = metrics.equity(trades_of(spark, d), by=("l_returnflag",), order=ORDER, start=1_000_000.0)
    return metrics.drawdown(curve, ("l_returnflag",), "l_shipdate")


@query("win_loss_streaks", f"WITH {TRADES_SQL}, a AS (SELECT *, r > 0 AS win, row_number() OVER (PARTITION BY l_returnflag ORDER BY {_ORDER}) - row_number() OVER (PARTITION BY l_returnflag, r > 0 ORDER BY {_ORDER}) AS g FROM trades), s AS (SELECT l_returnflag, win, g, count(*) AS n FROM a GROUP BY ALL) SELECT l_returnflag, max(n) FILTER (win) AS max_wins, max(n) FILTER (NOT win) AS max_losses FROM s GROUP BY l_returnflag", "l_returnflag max_wins max_losses")
def win_loss_streaks(spark, d):
    return metrics.streaks(trades_of(spark, d), by=("l_returnflag",), order=ORDER)


@query("total_returns", C(f"SELECT symbol, exp(sum(ln(1 + r))) - 1 AS total FROM (SELECT symbol, close / {lag_sql('close')} - 1 AS r FROM candles) WHERE r IS NOT NULL GROUP BY symbol"), "symbol", "total")
def total_returns(spark, d):
    from ..operators.price import return_features

    rows = return_features(hourly(spark, d), ()).filter(F.col("log_return_1").isNotNull())
    return rows.groupBy("symbol").agg(metrics.total_return("return_1").alias("total"))


@query("importance_shares", "SELECT p_partkey, abs(p_retailprice) / sum(abs(p_retailprice)) OVER (PARTITION BY p_brand) AS share FROM part", "p_partkey", "share")
def importance_shares(spark, d):
    return metrics.normalized_importance(read(spark, d, "part"), "p_retailprice", ("p_brand",))


@query("importance_means", "SELECT feature, avg(v) AS importance, count(*) AS n FROM (SELECT 'quantity' AS feature, l_quantity AS v FROM lineitem UNION ALL SELECT 'tax', l_tax FROM lineitem) GROUP BY feature", "feature n", "importance")
def importance_means(spark, d):
    maps = read(spark, d, "lineitem").select(F.create_map(F.lit("quantity"), F.col("l_quantity"), F.lit("tax"), F.col("l_tax")).alias("importance"))
    return metrics.mean_importance(maps)


@query("model_comparison", f"WITH {TRADES_SQL}, a AS (SELECT l_returnflag, avg(r) AS m FROM trades WHERE l_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT l_returnflag, avg(r) AS m FROM trades WHERE l_orderkey % 2 = 1 GROUP BY 1) SELECT l_returnflag, b.m - a.m AS m_delta, b.m > a.m AS m_better, exp(-2 * abs(b.m - a.m) / greatest(abs(a.m), abs(b.m))) AS m_p FROM a JOIN b USING (l_returnflag)", "l_returnflag m_better", "m_delta m_p")
def model_comparison(spark, d):
    t = trades_of(spark, d)
    a, b = (t.filter(F.col("l_orderkey") % 2 == k).groupBy("l_returnflag").agg(F.avg("r").alias("m")) for k in (0, 1))
    return metrics.compare(a, b, ["l_returnflag"], ["m"])


@query("composite_ranking", "SELECT p_partkey, (least(1, p_size / 50.0) * 2 + least(1, p_retailprice / 2000.0)) / 3 AS score, rank() OVER (ORDER BY (least(1, p_size / 50.0) * 2 + least(1, p_retailprice / 2000.0)) / 3 DESC) AS position FROM part QUALIFY position <= 20", "p_partkey position", "score")
def composite_ranking(spark, d):
    from pyspark.sql import Window

    scored = read(spark, d, "part").select("p_partkey", metrics.composite_score({"size": (F.col("p_size") / 50.0, 2.0), "price": (F.col("p_retailprice") / 2000.0, 1.0)}).alias("score"))
    return scored.withColumn("position", F.rank().over(Window.orderBy(F.desc("score")))).filter("position <= 20")


_PSI = "WITH ref AS (SELECT {x} AS x FROM {t} WHERE {a}), cur AS (SELECT {x} AS x FROM {t} WHERE NOT ({a})), q AS (SELECT list_sort(list_distinct(quantile_cont(x, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS e FROM ref), b AS (SELECT unnest(range(len(e) - 1)) AS k FROM q), h AS (SELECT k, (SELECT count(*) FROM ref, q WHERE x >= e[k + 1] AND (x < e[k + 2] OR (k = len(e) - 2 AND x <= e[k + 2]))) AS r, (SELECT count(*) FROM cur, q WHERE x >= e[k + 1] AND (x < e[k + 2] OR (k = len(e) - 2 AND x <= e[k + 2]))) AS c FROM b), p AS (SELECT greatest(r / sum(r) OVER (), 1e-8) AS r, greatest(c / sum(c) OVER (), 1e-8) AS c FROM h) SELECT '{x}' AS feature, sum((c - r) * ln(c / r)) AS psi, (SELECT abs((SELECT avg(x) FROM cur) - avg(x)) / (stddev_samp(x) + 1e-8) FROM ref) AS mean_shift FROM p"


@query("drift", _PSI.format(x="l_extendedprice", t="lineitem", a="l_shipdate < TIMESTAMP '1995-06-01'"), "feature", "psi mean_shift")
def feature_drift(spark, d):
    rows = read(spark, d, "lineitem")
    old = F.col("l_shipdate") < F.lit("1995-06-01").cast("timestamp")
    return drift.stability(rows.filter(old), rows.filter(~old), ["l_extendedprice"])


_RETURNS = "rr AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS pos, x FROM (SELECT symbol, ts, (close - b) / b AS x FROM (SELECT symbol, ts, close, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS b FROM candles) WHERE b <> 0))"


@query("correlation_matrix", C("SELECT p.symbol AS a, q.symbol AS b, count(*) AS n, corr(p.x, q.x) AS r FROM rr p JOIN rr q ON p.pos = q.pos AND p.symbol < q.symbol GROUP BY p.symbol, q.symbol", _RETURNS), "a b n", "r")
def correlation_matrix(spark, d):
    return correlation.matrix(correlation.returns_by_position(hourly(spark, d)))


@query("spearman", C("SELECT a, b, count(*) AS n, corr(rx, ry) AS rho FROM (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM (SELECT p.symbol AS a, q.symbol AS b, p.x, q.x AS y FROM rr p JOIN rr q ON p.pos = q.pos AND p.symbol < q.symbol)) GROUP BY a, b", _RETURNS), "a b n", "rho")
def spearman(spark, d):
    return correlation.spearman(correlation.returns_by_position(hourly(spark, d)))


@query("gamma", C("SELECT a, b, any_value(n) AS n, (sum((s > 0)::INT) - sum((s < 0)::INT)) / nullif(sum((s <> 0)::INT), 0) AS gamma FROM (SELECT p.a, p.b, p.n, sign((p.x - q.x) * (p.y - q.y)) AS s FROM pp p JOIN pp q ON p.a = q.a AND p.b = q.b AND p.pos < q.pos) GROUP BY a, b", _RETURNS + ", pp AS (SELECT p.symbol AS a, q.symbol AS b, p.pos, p.x, q.x AS y, count(*) OVER (PARTITION BY p.symbol, q.symbol) AS n FROM rr p JOIN rr q ON p.pos = q.pos AND p.symbol < q.symbol)"), "a b n", "gamma")
def gamma(spark, d):
    return correlation.gamma(correlation.returns_by_position(hourly(spark, d)))


_BEST_LAG = C("SELECT a, b, lag, n, r FROM (SELECT p.symbol AS a, q.symbol AS b, l.lag, count(*) AS n, corr(p.x, q.x) AS r FROM rr p, (SELECT unnest(range(-10, 11))::INT AS lag) l JOIN rr q ON q.pos = p.pos - l.lag AND p.symbol < q.symbol GROUP BY ALL HAVING count(*) >= 30) QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY round(abs(r), 12) DESC, lag) = 1", _RETURNS)


@query("best_lag", _BEST_LAG, "a b lag n", "r")
def best_lag(spark, d):
    return correlation.best_lag(correlation.returns_by_position(hourly(spark, d)))


@query("leading_symbols", f"SELECT *, CASE WHEN lag > 0 THEN a ELSE b END AS leader FROM ({_BEST_LAG}) WHERE lag <> 0", "a b lag n leader", "r")
def leading_symbols(spark, d):
    return correlation.leading(best_lag(spark, d))


@query("vector_distances", "SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE - 0.1) ** 2))) AS euclidean, list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE - 0.1))) AS manhattan, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE - 0.1))) AS chebyshev, 1 - list_sum(embedding::DOUBLE[]) * 0.1 / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE ** 2))) * sqrt(len(embedding) * 0.01)) AS cosine FROM embeddings", "vec_id", "euclidean manhattan chebyshev cosine")
def vector_distances(spark, d):
    v = F.col("embedding")
    other = F.array_repeat(F.lit(0.1), F.size(v))
    return read(spark, d, "embeddings").select("vec_id", *[vectors.distance(v, other, m).alias(m) for m in ("euclidean", "manhattan", "chebyshev", "cosine")])


@query("centroids", "SELECT label, count(*) AS n, list_sum(c) AS total FROM (SELECT label, vec_id FROM embeddings) JOIN (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label) USING (label) GROUP BY label, c", "label n", "total")
def centroids(spark, d):
    out = vectors.centroids(read(spark, d, "embeddings"), "label", "embedding")
    return out.withColumn("total", F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x))


@query("inertia", "WITH u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM u GROUP BY label, i) SELECT label, sum((x - m) ** 2) AS inertia FROM u JOIN m USING (label, i) GROUP BY label", "label", "inertia")
def inertia(spark, d):
    rows = read(spark, d, "embeddings")
    return vectors.inertia(rows, vectors.centroids(rows, "label", "embedding"), "label", "embedding")


@query("k_means")
def k_means(spark, d):
    return vectors.k_means(read(spark, d, "embeddings"), "embedding", 4, 8)[0].select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


_NEAR = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_distance(a.e, b.e) <= 1.1), n AS (SELECT v.vec_id, count(b) AS n_near FROM v LEFT JOIN near ON a = v.vec_id GROUP BY v.vec_id), core AS (SELECT vec_id FROM n WHERE n_near >= 3)"


@query("dbscan", f"WITH RECURSIVE {_NEAR}, l AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)), r AS (SELECT vec_id AS node, vec_id AS dest FROM core UNION SELECT r.node, l.b FROM r JOIN l ON r.dest = l.a), c AS (SELECT node, min(dest) AS cluster FROM r GROUP BY node), e AS (SELECT a, min(cluster) AS cluster FROM near JOIN c ON c.node = b WHERE a NOT IN (FROM core) GROUP BY a) SELECT n.vec_id, n_near, CASE WHEN c.node IS NOT NULL THEN 'core' WHEN e.a IS NOT NULL THEN 'border' ELSE 'noise' END AS kind, coalesce(c.cluster, e.cluster, -1) AS cluster FROM n LEFT JOIN c ON c.node = n.vec_id LEFT JOIN e ON e.a = n.vec_id", "vec_id n_near kind cluster")
def dbscan(spark, d):
    """Density clusters of all vectors; noise is -1."""
    return clustering.dbscan(read(spark, d, "embeddings"), "vec_id", "embedding", 1.1, 3).fillna(-1, subset=["cluster"])


def _brand_profiles(spark, d):
    """What each brand's parts sell for, by all line items."""
    parts = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = read(spark, d, "lineitem").join(parts, "l_partkey").groupBy("p_brand")
    return rows.agg(F.avg("l_quantity").alias("quantity"), (F.avg("l_discount") * 100).alias("discount"), (F.avg("l_tax") * 100).alias("tax"), (F.avg("l_extendedprice") / 1000).alias("price"))


def _profile_gap(a, b):
    return F.sqrt(sum((a[c] - b[c]) * (a[c] - b[c]) for c in ("quantity", "discount", "tax", "price")))


@query("complete_linkage", keys="first second size", values="height")
def complete_linkage(spark, d):
    """The merges of all brands by the distance of their profiles."""
    return clustering.linkage(clustering.distance_table(_brand_profiles(spark, d), "p_brand", _profile_gap))


@query("linkage_clusters", keys="p_brand cluster")
def linkage_clusters(spark, d):
    """Five clusters of brands, cut from the hierarchy."""
    items = _brand_profiles(spark, d)
    return clustering.cut(items, "p_brand", clustering.linkage(clustering.distance_table(items, "p_brand", _profile_gap)), 5)


@query("principal_components")
def principal_components(spark, d):
    rows = read(spark, d, "embeddings")
    mean, components, _ = vectors.principal_components(rows, "embedding", 3)
    return vectors.projected(rows, "embedding", mean, components).select("vec_id", F.transform("projected", lambda x: F.round(x, 6)).alias("projected"))


@query("independent_components")
def independent_components(spark, d):
    """The independent components of quantity, discount and tax of all line items, which are drawn apart from each other."""
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity", F.col("l_discount") * 100, F.col("l_tax") * 100).alias("v"))
    mean, rows_ = vectors.independent_components(rows, "v", 3)
    return vectors.projected(rows, "v", mean, rows_).select("l_orderkey", "l_linenumber", F.transform("projected", lambda x: F.round(x, 4)).alias("projected"))


@query("random_projection")
def random_projection(spark, d):
    return vectors.random_projection(read(spark, d, "embeddings"), "embedding", 64, 4).select("vec_id", F.transform("projected", lambda x: F.round(x, 6)).alias("projected"))


def _supplies(spark, d):
    """Which nations supplied others, and how often, as a graph of nations."""
    s = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    c = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    every = rows.join(o, "o_orderkey").join(s, "s_suppkey").join(c, "c_custkey").filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    return every.withColumn("kind", F.lit("SUPPLIES"))


def _strongest(spark, d, k=3):
    """The k destinations that each nation supplied most; with equal weights the smaller ones."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return _supplies(spark, d).withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def _edges(spark, d):
    """The five nations that each nation supplied most."""
    return _strongest(spark, d, 5)


_EDGES = "edges AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY count(*) DESC, c_nationkey) <= 5)"


@query("graph_neighbours", f"WITH {_EDGES} SELECT DISTINCT * FROM (SELECT src AS node, dst AS neighbour FROM edges UNION ALL SELECT dst, src FROM edges) WHERE node IN (1, 2)", "node neighbour")
def graph_neighbours(spark, d):
    return graphs.neighbours(_edges(spark, d), spark.createDataFrame([(1,), (2,)], "node int"))


@query("graph_subgraph", f"WITH {_EDGES} SELECT src, dst, weight FROM edges WHERE src < 10 AND dst < 10", "src dst weight")
def graph_subgraph(spark, d):
    return graphs.subgraph(_edges(spark, d), read(spark, d, "nation").filter("n_nationkey < 10").select(F.col("n_nationkey").alias("node")))


@query("graph_statistics", f"WITH {_EDGES} SELECT (SELECT count(*) FROM nation) AS nodes, count(*) AS edges, count(*) / (25.0 * 24) AS density, 2 * count(*) / 25.0 AS mean_degree FROM edges", "nodes edges", "density mean_degree")
def graph_statistics(spark, d):
    return graphs.statistics(_edges(spark, d), read(spark, d, "nation").select(F.col("n_nationkey").alias("node")))


@query("graph_distances", f"WITH RECURSIVE {_EDGES}, r AS (SELECT n_nationkey AS source, n_nationkey AS node, 0 AS depth FROM nation UNION SELECT r.source, e.dst, depth + 1 FROM r JOIN edges e ON e.src = r.node WHERE depth < 3) SELECT source, node, min(depth) AS depth FROM r GROUP BY source, node", "source node depth")
def graph_distances(spark, d):
    return graphs.distances(_edges(spark, d), read(spark, d, "nation").select(F.col("n_nationkey").alias("node")), 3)


# The same on every edge; distances on each nation's strongest edges, as with every edge nearly all of them are one.
_EVERY = _EDGES[: _EDGES.index(" QUALIFY")] + ")"
_STRONGEST = _EDGES[: _EDGES.index(" QUALIFY")] + " QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY count(*) DESC, c_nationkey) <= 3)"


@query("graph_neighbours_all", f"WITH {_EVERY} SELECT DISTINCT * FROM (SELECT src AS node, dst AS neighbour FROM edges UNION ALL SELECT dst, src FROM edges) WHERE node IN (1, 2)", "node neighbour")
def graph_neighbours_all(spark, d):
    return graphs.neighbours(_supplies(spark, d), spark.createDataFrame([(1,), (2,)], "node int"))


@query("graph_subgraph_all", f"WITH {_EVERY} SELECT src, dst, weight FROM edges WHERE src < 10 AND dst < 10", "src dst weight")
def graph_subgraph_all(spark, d):
    return graphs.subgraph(_supplies(spark, d), read(spark, d, "nation").filter("n_nationkey < 10").select(F.col("n_nationkey").alias("node")))


@query("graph_statistics_all", f"WITH {_EVERY} SELECT (SELECT count(*) FROM nation) AS nodes, count(*) AS edges, count(*) / (25.0 * 24) AS density, 2 * count(*) / 25.0 AS mean_degree FROM edges", "nodes edges", "density mean_degree")
def graph_statistics_all(spark, d):
    return graphs.statistics(_supplies(spark, d), read(spark, d, "nation").select(F.col("n_nationkey").alias("node")))


@query("graph_distances_strongest", f"WITH RECURSIVE {_STRONGEST}, r AS (SELECT n_nationkey AS source, n_nationkey AS node, 0 AS depth FROM nation UNION SELECT r.source, e.dst, depth + 1 FROM r JOIN edges e ON e.src = r.node WHERE depth < 3) SELECT source, node, min(depth) AS depth FROM r GROUP BY source, node", "source node depth")
def graph_distances_strongest(spark, d):
    return graphs.distances(_strongest(spark, d), read(spark, d, "nation").select(F.col("n_nationkey").alias("node")), 3)


_PLACES_SQL = "t AS (SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region UNION ALL SELECT 'world', NULL)"


def _places(spark, d):
    """The hierarchy of customers, nations, regions and the world."""

    def level(table, node, parent):
        return read(spark, d, table).select(F.concat(F.lit(node[0]), node).alias("node"), parent.alias("parent"))

    customers = read(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    return customers.unionByName(level("nation", "n_nationkey", F.concat(F.lit("r"), "n_regionkey"))).unionByName(level("region", "r_regionkey", F.lit("world"))).unionByName(spark.createDataFrame([("world", None)], "node string, parent string"))


@query("ontology_ancestors", f"WITH RECURSIVE {_PLACES_SQL}, r AS (SELECT node, parent AS ancestor, 1 AS depth FROM t WHERE parent IS NOT NULL UNION ALL SELECT r.node, t.parent, depth + 1 FROM r JOIN t ON t.node = r.ancestor WHERE t.parent IS NOT NULL) SELECT * FROM r", "node ancestor depth")
def ontology_ancestors(spark, d):
    return graphs.ancestors(_places(spark, d))


@query("ontology_subtypes", "SELECT 'r1' AS node UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1", "node")
def ontology_subtypes(spark, d):
    return graphs.subtypes(_places(spark, d), "r1")


@query("correlation_edges", C("SELECT a AS src, b AS dst, CASE WHEN r > 0 THEN 'CORRELATES_WITH' ELSE 'OPPOSITE_OF' END AS kind, abs(r) AS weight FROM (SELECT p.symbol AS a, q.symbol AS b, corr(p.x, q.x) AS r FROM rr p JOIN rr q ON p.pos = q.pos AND p.symbol < q.symbol GROUP BY ALL) WHERE abs(r) > 0.01", _RETURNS), "src dst kind", "weight")
def correlation_edges(spark, d):
    return graphs.correlation_edges(correlation.matrix(correlation.returns_by_position(hourly(spark, d))), 0.01)


@query("inverse_volatility", C("SELECT symbol, v AS volatility, (1 / v) / sum(1 / v) OVER () AS weight FROM (SELECT symbol, stddev_samp(x) AS v FROM rr GROUP BY symbol)", _RETURNS), "symbol", "volatility weight")
def inverse_volatility(spark, d):
    return risk.inverse_volatility(correlation.returns_by_position(hourly(spark, d)), value="x")


@query("risk_parity")
def risk_parity(spark, d):
    r = correlation.returns_by_position(hourly(spark, d))
    names, mean, cov = risk.covariance(r, time="pos", value="x")
    rows = [(n, *(round(float(risk.allocation(mean, cov, k)[i]), 6) for k in ("mean_variance", "minimum_variance", "risk_parity"))) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "symbol string, mean_variance double, minimum_variance double, risk_parity double")


@query("position_sizes", "SELECT p_partkey, CASE WHEN l > 0 THEN least(100, greatest(0.01, l)) ELSE 0 END AS lots FROM (SELECT p_partkey, CASE WHEN p_size <> 25 THEN 10000 * 0.01 / abs(p_size - 25) ELSE 0 END AS l FROM part)", "p_partkey", "lots")
def position_sizes(spark, d):
    return read(spark, d, "part").select("p_partkey", risk.position_size(F.lit(10000.0), F.col("p_size").cast("double"), F.lit(25.0)).alias("lots"))


@query("exposure_allocation", "SELECT p_brand AS symbol, sum(abs(p_size * p_retailprice)) AS exposure, sum(abs(p_size * p_retailprice)) / (SELECT sum(abs(p_size * p_retailprice)) FROM part) AS share FROM part GROUP BY p_brand", "symbol", "exposure share")
def exposure_allocation(spark, d):
    return risk.allocations(read(spark, d, "part").select(F.col("p_brand").alias("symbol"), F.col("p_size").alias("quantity"), F.col("p_retailprice").alias("price")))


def _signals(spark, d):
    from ..operators.indicators import calendar

    return calendar(hourly(spark, d)).withColumn("size", F.lit(10.0))


@query("trade_signals", C(f"SELECT symbol, ts, CASE WHEN rejected IS NULL THEN sign(50 - close) ELSE 0 END AS side, rejected FROM (SELECT symbol, ts, close, CASE WHEN close = 50 THEN 'no_side' WHEN abs(close - 50) / 50 < 0.3 THEN 'confidence' WHEN NOT (hour(ts) >= 7 AND hour(ts) < 17) THEN 'session' END AS rejected FROM candles)"), "symbol rejected", "side", "ts")
def trade_signals(spark, d):
    return risk.signals(_signals(spark, d), 50 - F.col("close"), F.abs(F.col("close") - 50) / 50, 0.3, ["london", "london_ny_overlap"])


@query("backtest")
def backtest(spark, d):
    rows = risk.signals(_signals(spark, d), 50 - F.col("close"), F.abs(F.col("close") - 50) / 50, 0.3, cooldown=3)
    return risk.backtest(rows, F.col("side"), F.col("size"), 2 * F.col("size"), 10)


@query("monte_carlo")
def monte_carlo(spark, d):
    r = correlation.returns_by_position(hourly(spark, d)).select("symbol", "pos", (F.col("x") / 100).alias("r"))
    return risk.bands(risk.reshuffled(r, 50, ids=("symbol", "pos")))


@query("equity_bands", keys="step", values="mean low median high")
def equity_bands(spark, d):
    """Bands of the equity after every step of fifty orders of all returns."""
    r = correlation.returns_by_position(hourly(spark, d)).select("symbol", "pos", (F.col("x") / 100).alias("r"))
    return risk.equity_bands(r, 50, ids=("symbol", "pos"))


_DIMENSIONS = {"period": "strftime(l_shipdate, '%Y-%m')", "flag": "l_returnflag", "status": "l_linestatus", "line": "l_linenumber::VARCHAR"}


@query("performance_report", "WITH t AS (SELECT l_extendedprice * (l_discount - 0.05) AS r, " + ", ".join(f"{x} AS {n}" for n, x in _DIMENSIONS.items()) + " FROM lineitem) SELECT CASE " + " ".join(f"WHEN grouping({n}) = 0 THEN '{n}'" for n in _DIMENSIONS) + " ELSE 'all' END AS dimension, CASE " + " ".join(f"WHEN grouping({n}) = 0 THEN {n}" for n in _DIMENSIONS) + " END AS value, count(r) AS trades, count(*) FILTER (r > 0) AS wins, sum(r) AS total, avg(r) AS expectancy, avg((r > 0)::INT) AS win_rate, sum(r) FILTER (r > 0) / -sum(r) FILTER (r < 0) AS profit_factor, max(r) AS best, min(r) AS worst FROM t GROUP BY GROUPING SETS (" + ", ".join(f"({n})" for n in _DIMENSIONS) + ", ())", "dimension value trades wins", "expectancy win_rate profit_factor best worst")
def performance_report(spark, d):
    """All line items as trades, by month, flag, status and line, in one pass."""
    rows = read(spark, d, "lineitem").withColumn("r", F.col("l_extendedprice") * (F.col("l_discount") - 0.05))
    return metrics.report(rows, "r", {"period": F.date_format("l_shipdate", "yyyy-MM"), "flag": F.col("l_returnflag"), "status": F.col("l_linestatus"), "line": F.col("l_linenumber")})


@query("model_promotion", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN false WHEN c_nationkey = 0 THEN true ELSE c_acctbal - 1000 >= 0.005 END AS promoted FROM customer", "c_custkey promoted")
def model_promotion(spark, d):
    challenger, champion = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), F.when(F.col("c_nationkey") != 0, F.lit(1000.0))
    return read(spark, d, "customer").select("c_custkey", risk.promotion(challenger, champion).alias("promoted"))


@query("meta_labels", C(f"SELECT symbol, ts, CASE WHEN r IS NOT NULL THEN coalesce(sign(r) = sign(50 - close) AND close <> 50 AND abs(close - 50) / 50 >= 0.55, false)::INT END AS label FROM (SELECT symbol, ts, close, lead(close, 3) OVER ({SERIES_SQL}) / close - 1 AS r FROM candles)"), "symbol", "label", "ts")
def meta_labels(spark, d):
    return hourly(spark, d).withColumn("label", labels.meta_label(3, F.signum(50 - F.col("close")), F.abs(F.col("close") - 50) / 50))


@query("training_table")
def training_table(spark, d):
    return datasets.training_table(hourly(spark, d), ["returns", "momentum", "channels", "rsi"])


def _folder(spark) -> str:
    """A new folder that driver and executors share, which goes when the session ends."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    gone_at_exit(spark, path)
    return path


#: Rows of a micro-batch where workers put a symbol's rows of one into order.
SLICE = 1_000_000


def _stream_of(spark, source, at: str, order: tuple[str, ...] = ()):
    """Rows as a stream of the files that they are written to.

    With `order`, micro-batches follow each other in it and have about SLICE rows each. A stream takes files by the time of their
    writing, so slices are written one after the other, a second apart, as some stores keep whole seconds.
    """
    schema, slices = T.StructType(source.schema.fields), -(-source.count() // SLICE) if order else 1
    stream = spark.readStream.schema(schema)
    if slices <= 1:
        source.write.parquet(f"{at}/in")
        return stream.parquet(f"{at}/in")
    ranged = source.repartitionByRange(slices, *[F.col(c).asc_nulls_last() for c in order])
    ranged.withColumn("_slice", F.spark_partition_id()).write.partitionBy("_slice").parquet(f"{at}/slices")
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("_slice", T.IntegerType())])).parquet(f"{at}/slices")
    for k in sorted(r["_slice"] for r in rows.select("_slice").distinct().collect()):  # a row for each slice
        began = time.monotonic()
        rows.filter(F.col("_slice") == k).drop("_slice").coalesce(1).write.mode("append").parquet(f"{at}/in")
        time.sleep(max(0.0, 1 - (time.monotonic() - began)))
    return stream.option("maxFilesPerTrigger", 1).parquet(f"{at}/in")


def _streamed(spark, source, make, mode: str = "append", order: tuple[str, ...] = ()):
    """Runs a stream over the rows once, into a folder of its own, and reads what it wrote."""
    at = _folder(spark)
    out = make(_stream_of(spark, source, at, order))
    bars.stream_into(out, f"{at}/out", f"{at}/state", mode).awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def _tick_source(spark, d):
    return read(spark, d, "events").select(F.col("event_type").alias("symbol"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("last"), F.lit(1.0).alias("volume"))


@query("stream_tumbling_bars", C("SELECT symbol, ts, open, high, low, close, volume::BIGINT AS ticks FROM candles"), "symbol ticks", "high low", "ts")
def stream_tumbling_bars(spark, d):
    """All bars: a closing tick lets the watermark pass the last one."""
    return _streamed(spark, bars.with_closing_tick(_tick_source(spark, d)), lambda s: bars.tumbling_bars(s, "1 hour"))


@query("stream_volume_bars", f"WITH {TICKS_SQL}, g AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) - 1) // 20 AS g FROM ticks) SELECT symbol, min(ts) AS ts, first(last ORDER BY ts, event_id) AS open, max(last) AS high, min(last) AS low, last(last ORDER BY ts, event_id) AS close, count(*) AS volume FROM g GROUP BY symbol, g", "symbol", "open high low close volume", "ts")
def stream_volume_bars(spark, d):
    """Bars of 20 ticks; the last one of each symbol closes when the watermark is an hour past it.

    The watermark stays behind all ticks until the closing one, so a bar goes on over any pause, whatever the micro-batches.
    """
    rows, order = _tick_source(spark, d), ("ts", "event_id")
    span = 1 + (rows.agg(F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))).first()[0] or 0)
    return _streamed(spark, bars.with_closing_tick(rows, f"{span + 86_400} seconds"), lambda s: bars.volume_bars(s, 20.0, order, idle=3600, late=f"{span} seconds"), order=order)


@query("stream_distinct_ticks", "SELECT DISTINCT event_type AS symbol, ts, value AS last FROM events", "symbol", "last", "ts")
def stream_distinct_ticks(spark, d):
    """Every tick comes twice and is kept once."""
    rows = _tick_source(spark, d)
    return _streamed(spark, rows.unionByName(rows), bars.distinct_ticks)


@query("stream_live_monitor", "WITH r AS (SELECT event_type AS symbol, ts, event_id, (value - 50) / 1000 AS r FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 500), e AS (SELECT *, 1 + sum(r) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS equity FROM r), p AS (SELECT *, greatest(1, max(equity) OVER (PARTITION BY symbol ORDER BY ts, event_id)) AS peak FROM e) SELECT symbol, max(ts) AS ts, count(*) AS n, 1 + sum(r) AS equity, avg((r > 0)::INT) AS win_rate, avg(r) / stddev_samp(r) AS sharpe, min(equity / peak - 1) AS drawdown FROM p GROUP BY symbol", "symbol n", "equity win_rate sharpe drawdown", "ts")
def stream_live_monitor(spark, d):
    """The last snapshot of each symbol."""
    rows, at = _tick_source(spark, d).withColumn("r", (F.col("last") - 50) / 1000), _folder(spark)
    shown = bars.live_monitor(_stream_of(spark, rows, at, ("ts", "event_id")), order=("ts", "event_id"))
    bars.upsert_batches(shown, lambda batch, number: batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}"), f"{at}/state", "update").awaitTermination()
    written = spark.read.schema(T.StructType([*shown.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{at}/out")
    return written.groupBy("symbol").agg(F.max_by(F.struct(*shown.columns[1:]), "batch").alias("_s")).select("symbol", "_s.*")


@query("stream_predictions", "SELECT l_orderkey, l_linenumber, round((SELECT regr_intercept(l_extendedprice, l_quantity) FROM lineitem) + (SELECT regr_slope(l_extendedprice, l_quantity) FROM lineitem) * x.l_quantity, 3) AS prediction FROM lineitem x", "l_orderkey l_linenumber", "prediction")
def stream_predictions(spark, d):
    """A model fitted on a table scores the rows of a stream as they come."""
    rows = read(spark, d, "lineitem")
    fitted = models.least_squares(rows, ["l_quantity"], "l_extendedprice")
    return _streamed(spark, rows.select("l_orderkey", "l_linenumber", "l_quantity"), lambda s: s.select("l_orderkey", "l_linenumber", F.round(models.linear(fitted, ["l_quantity"]), 3).alias("prediction")))


@query("stream_windowed_predictions", C("SELECT symbol, ts, n AS rows, 0.5 * close + 0.5 * m AS prediction FROM (SELECT symbol, ts, close, count(*) OVER w AS n, avg(close) OVER w AS m FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE n >= 5"), "symbol rows", "prediction", "ts")
def stream_windowed_predictions(spark, d):
    """Streamed candles, each halfway between its close and the mean of the last twenty."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, bars.ROCKS)
    try:
        return _streamed(spark, hourly(spark, d), lambda s: bars.windowed_predictions(s, ["close"], _halfway, 20, 5))
    finally:
        spark.conf.set(name, before)


def _halfway(windows):
    return 0.5 * windows[:, -1, 0] + 0.5 * windows[:, :, 0].mean(1)


@query("batch_sliding_bars", "SELECT event_type AS symbol, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL (k * 15) MINUTE AS ts, max(value) AS high, min(value) AS low, count(*) AS ticks FROM events, (SELECT unnest(range(4)) AS k) GROUP BY 1, 2", "symbol ticks", "high low", "ts")
def batch_sliding_bars(spark, d):
    return bars.sliding_bars(ticks(spark, d))


@query("batch_activity_sessions", "SELECT symbol, min(ts) AS ts, max(ts) + INTERVAL 30 MINUTE AS end_ts, count(*) AS ticks, max(value) AS high FROM (SELECT *, sum(n) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS g FROM (SELECT event_type AS symbol, ts, event_id, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events)) GROUP BY symbol, g", "symbol ticks", "high", "ts end_ts")
def batch_activity_sessions(spark, d):
    return bars.activity_sessions(ticks(spark, d))



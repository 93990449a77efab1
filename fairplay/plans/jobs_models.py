"""Registered jobs for profiles (P), clustering (K), anomalies (A) and prediction (M).

Statistics on a given labelling / scoring are checked against DuckDB: the
labelling is the player's first position (a fixed partition of the players)
and the stand-in anomaly score is -max |z| over the standardised profile.
Model fits (k-means, mixtures, forests, boosted trees) are checked by
properties in the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fairplay.operators import anomaly as AN
from fairplay.operators import cluster as CL
from fairplay.operators import predict as PR
from fairplay.operators.profiles import POSITION_CODES, PROFILE_FEATURES, player_profile, position_column
from fairplay.functions.numeric import fixed
from fairplay.plans.catalog import job
from fairplay.plans.jobs_text import _q
from fairplay.plans.oracle import fixed_sql, with_views
from fairplay.session import cut_lineage
from fairplay.sources import tables as TB

FEATS = PROFILE_FEATURES
CONTAMINATION = 0.1
Z_CUT = 3.0
DBSCAN_EPS = 2.0


# ---------------------------------------------------------------- shared inputs
def _profiles(spark, sf_dir):
    return player_profile(TB.player_match(spark, sf_dir))


def _labels_from_profiles(prof):
    expr = None
    for i, code in enumerate(POSITION_CODES):
        cond = F.col(position_column(code)) == 1
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return prof.select(F.col("player_id").alias("id"), expr.otherwise(F.lit(-1)).alias("label"))


def _inputs(spark, sf_dir):
    """Profiles (materialised once), their long form, the standardised long form
    (materialised: the cluster statistics read it from many branches) and the
    given labelling."""
    prof = cut_lineage(_profiles(spark, sf_dir))
    raw = CL.to_long(prof, "player_id", FEATS)
    std = cut_lineage(CL.standardize_long(raw))
    return prof, raw, std, _labels_from_profiles(prof)


def _standin_scores(std):
    per = std.groupBy("id").agg((-F.max(F.abs("value"))).alias("score"))
    return per.withColumn("is_anomaly", F.col("score") < -Z_CUT)


_POS_CASE = " ".join(f"WHEN '{c}' THEN 1" for c in POSITION_CODES)
PROFILE_SQL = {
    "pm_agg": """
  SELECT player_id, avg(fouls) AS avg_fouls_per_game, avg(yellow_cards) AS avg_yellow_cards_per_game,
         avg(red_cards) AS avg_red_cards_per_game, CAST(sum(fouls) AS BIGINT) AS total_fouls,
         CAST(sum(yellow_cards) AS BIGINT) AS total_yellow_cards, CAST(sum(red_cards) AS BIGINT) AS total_red_cards,
         CAST(sum(minutes_played) AS BIGINT) AS _minutes, coalesce(stddev_samp(fouls), 0.0) AS fouls_std,
         avg(fouls) FILTER (WHERE month(match_date) IN (8, 9, 10)) AS _early,
         avg(fouls) FILTER (WHERE month(match_date) IN (4, 5, 6)) AS _late,
         arg_min(position, (match_date, match_id)) FILTER (WHERE position IS NOT NULL) AS _first_position,
         count(*) FILTER (WHERE fouls >= 3) AS high_foul_games,
         count(*) FILTER (WHERE yellow_cards > 0 OR red_cards > 0) AS card_games
  FROM player_match GROUP BY player_id""",
    "pm_team": """
  SELECT player_id, avg(m) AS team_avg_fouls FROM (
    SELECT player_id, team, avg(fouls) AS m FROM player_match GROUP BY player_id, team) t GROUP BY player_id""",
    "prof": f"""
  SELECT a.player_id, avg_fouls_per_game, avg_yellow_cards_per_game, avg_red_cards_per_game, total_fouls,
         total_yellow_cards, total_red_cards, fouls_std, high_foul_games, card_games, t.team_avg_fouls,
         coalesce(total_fouls / nullif(CAST(_minutes AS DOUBLE), 0), 0.0) AS fouls_per_minute,
         coalesce((total_yellow_cards + total_red_cards) / nullif(CAST(_minutes AS DOUBLE), 0), 0.0) AS cards_per_minute,
         coalesce(fouls_std / nullif(avg_fouls_per_game, 0), 0.0) AS fouls_cv,
         coalesce(_early, avg_fouls_per_game) AS fouls_early_season,
         coalesce(_late, avg_fouls_per_game) AS fouls_late_season,
         total_yellow_cards + total_red_cards * 2 AS disciplinary_points,
         total_fouls / (total_yellow_cards + total_red_cards + 1) AS foul_to_card_ratio,
         {", ".join(f"CAST(coalesce(_first_position = '{c}', false) AS INTEGER) AS {position_column(c)}" for c in POSITION_CODES)}
  FROM pm_agg a LEFT JOIN pm_team t ON a.player_id = t.player_id""",
}
_LABEL_CASE = "CASE " + " ".join(f"WHEN {position_column(c)} = 1 THEN {i}" for i, c in enumerate(POSITION_CODES)) + " ELSE -1 END"
CLUSTER_SQL = {
    **PROFILE_SQL,
    "wide": "SELECT player_id AS id, " + ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FEATS) + " FROM prof",
    "raw": "SELECT * FROM (UNPIVOT wide ON " + ", ".join(FEATS) + " INTO NAME feature VALUE value) u",
    "std": """
  SELECT id, feature, (value - avg(value) OVER (PARTITION BY feature)) /
         CASE WHEN stddev_pop(value) OVER (PARTITION BY feature) IS NULL OR stddev_pop(value) OVER (PARTITION BY feature) = 0
              THEN 1.0 ELSE stddev_pop(value) OVER (PARTITION BY feature) END AS value
  FROM raw""",
    "labels": f"SELECT player_id AS id, {_LABEL_CASE} AS label FROM prof",
}
CL_VIEWS = with_views("player_match", extra=CLUSTER_SQL)


def _views(extra: dict[str, str]) -> str:
    return with_views("player_match", extra={**CLUSTER_SQL, **extra})


@job("p01_p08_player_profile", with_views("player_match", extra=PROFILE_SQL) + "SELECT * FROM prof")
def p01_p08_player_profile(spark, sf_dir):
    """P1-P8 in one aggregation per player (+ the two-level team mean)."""
    return _profiles(spark, sf_dir)


# ---------------------------------------------------------------- K
@job("k08_cluster_centers", CL_VIEWS + """
SELECT l.label, s.feature, avg(s.value) AS center FROM std s JOIN labels l ON s.id = l.id
WHERE l.label <> -1 GROUP BY l.label, s.feature""")
def k08_cluster_centers(spark, sf_dir):
    _, _, std, labels = _inputs(spark, sf_dir)
    return CL.centers(std, labels)


K7_SQL = {
    "pts": "SELECT s.id, s.feature, s.value, l.label FROM std s JOIN labels l ON s.id = l.id WHERE l.label <> -1",
    "csum": "SELECT label, feature, sum(value) AS s, avg(value) AS mu FROM pts GROUP BY label, feature",
    "ccount": "SELECT label, count(*) AS n_c FROM labels WHERE label <> -1 GROUP BY label",
    "norms": "SELECT id, label, sum(value * value) AS nx FROM pts GROUP BY id, label",
    "qc": "SELECT label, sum(nx) AS q_c FROM norms GROUP BY label",
    "dots": "SELECT p.id, c.label AS c, sum(p.value * c.s) AS xs FROM pts p JOIN csum c ON p.feature = c.feature GROUP BY p.id, c.label",
    "per": """
  SELECT d.id, n.label, d.c = n.label AS own, cc.n_c,
         CASE WHEN d.c = n.label THEN (cc.n_c * n.nx - 2 * d.xs + q.q_c) / nullif(cc.n_c - 1, 0)
              ELSE (cc.n_c * n.nx - 2 * d.xs + q.q_c) / cc.n_c END AS d
  FROM dots d JOIN norms n ON d.id = n.id JOIN ccount cc ON cc.label = d.c JOIN qc q ON q.label = d.c""",
    "sil": """
  SELECT id, max(d) FILTER (WHERE own) AS a, max(n_c) FILTER (WHERE own) AS n_own,
         min(d) FILTER (WHERE NOT own) AS b FROM per GROUP BY id""",
    "grand": "SELECT feature, avg(value) AS g FROM pts GROUP BY feature",
    "bss": "SELECT sum(cc.n_c * (c.mu - g.g) * (c.mu - g.g)) AS bss FROM csum c JOIN ccount cc ON c.label = cc.label JOIN grand g ON c.feature = g.feature",
    "wrows": "SELECT p.id, p.label, (p.value - c.mu) * (p.value - c.mu) AS sq FROM pts p JOIN csum c ON p.label = c.label AND p.feature = c.feature",
    "scatter": "SELECT label, avg(dist) AS s_c FROM (SELECT id, label, sqrt(sum(sq)) AS dist FROM wrows GROUP BY id, label) x GROUP BY label",
    "pairs": """
  SELECT a.label AS i, b.label AS j, sqrt(sum((a.mu - b.mu) * (a.mu - b.mu))) AS d_ij
  FROM csum a JOIN csum b ON a.feature = b.feature WHERE a.label <> b.label GROUP BY a.label, b.label""",
    "db": """
  SELECT avg(r_i) AS davies_bouldin FROM (
    SELECT p.i, max((si.s_c + sj.s_c) / nullif(p.d_ij, 0)) AS r_i
    FROM pairs p JOIN scatter si ON p.i = si.label JOIN scatter sj ON p.j = sj.label GROUP BY p.i) r""",
}


@job("k07_cluster_metrics", _views(K7_SQL) + """
SELECT n_clusters, noise_points, silhouette_sq_euclidean,
       CASE WHEN n_clusters < 2 THEN NULL ELSE (bss / (n_clusters - 1)) / nullif(wss / (n - n_clusters), 0) END AS calinski_harabasz,
       CASE WHEN n_clusters < 2 THEN NULL ELSE davies_bouldin END AS davies_bouldin
FROM (SELECT count(*) AS n, count(DISTINCT label) AS n_clusters FROM labels WHERE label <> -1) s,
     (SELECT count(*) FILTER (WHERE label = -1) AS noise_points FROM labels) nz,
     (SELECT avg(CASE WHEN n_own <= 1 OR b IS NULL THEN 0.0
                      ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END) AS silhouette_sq_euclidean FROM sil) si,
     bss, (SELECT sum(sq) AS wss FROM wrows) w, db""")
def k07_cluster_metrics(spark, sf_dir):
    _, _, std, labels = _inputs(spark, sf_dir)
    return CL.cluster_metrics(std, labels)


@job("k09_cluster_profiles", CL_VIEWS + """
SELECT s.label, s.feature, s.mean, s.std, s.min, s.max, z.size, z.percent
FROM (SELECT l.label, r.feature, avg(r.value) AS mean, stddev_samp(r.value) AS std, min(r.value) AS min, max(r.value) AS max
      FROM raw r JOIN labels l ON r.id = l.id WHERE l.label <> -1 GROUP BY l.label, r.feature) s
JOIN (SELECT label, count(*) AS size, count(*) / (SELECT count(*) FROM labels) * 100.0 AS percent
      FROM labels WHERE label <> -1 GROUP BY label) z ON s.label = z.label""")
def k09_cluster_profiles(spark, sf_dir):
    """K9 on the profile values as measured (the description of each cluster)."""
    _, raw, _, labels = _inputs(spark, sf_dir)
    return CL.cluster_profiles(raw, labels)


@job("k09_cluster_medians", CL_VIEWS + """
SELECT l.label, r.feature, median(r.value) AS median FROM raw r JOIN labels l ON r.id = l.id WHERE l.label <> -1 GROUP BY l.label, r.feature""", doubles=["median"])
def k09_cluster_medians(spark, sf_dir):
    _, raw, _, labels = _inputs(spark, sf_dir)
    return CL.cluster_medians(raw, labels)


_FEAT_POS = "CASE feature " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(FEATS)) + f" ELSE {len(FEATS)} END"
K10_SQL = {
    "overall": "SELECT feature, avg(value) AS overall_mean FROM raw GROUP BY feature",
    "cm": "SELECT l.label, s.feature, avg(s.value) AS cluster_mean FROM raw s JOIN labels l ON s.id = l.id WHERE l.label <> -1 GROUP BY l.label, s.feature",
    "imp": """
  SELECT cm.label, cm.feature, cm.cluster_mean, o.overall_mean,
         coalesce(abs((cm.cluster_mean - o.overall_mean) / nullif(o.overall_mean, 0)), 0.0) AS importance,
         cm.cluster_mean - o.overall_mean AS difference
  FROM cm JOIN overall o ON cm.feature = o.feature""",
    "top": f"""
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY importance DESC, {_FEAT_POS}) AS INTEGER) AS rank FROM imp) r
  WHERE rank <= 5""",
}


@job("k10_top_features", _views(K10_SQL) + "SELECT * FROM top")
def k10_top_features(spark, sf_dir):
    _, raw, _, labels = _inputs(spark, sf_dir)
    return CL.top_features(raw, labels, 5, FEATS)


def _wording_sql() -> str:
    arms = []
    for word, hi, lo in CL.WORDING:
        arms.append(f"WHEN contains(lower(feature), '{word}') THEN CASE WHEN cluster_mean > overall_mean "
                    f"THEN '{hi}' ELSE '{lo}' END")
    return "CASE " + " ".join(arms) + " END"


@job("k14_cluster_wording", _views({**K10_SQL, "ph": f"""
  SELECT label, string_agg(phrase, ', ' ORDER BY rank) AS parts FROM (
    SELECT label, rank, {_wording_sql()} AS phrase FROM top WHERE rank <= 3) p
  WHERE phrase IS NOT NULL GROUP BY label""",
    "sz": "SELECT label, count(*) AS size FROM labels WHERE label <> -1 GROUP BY label"}) + """
SELECT sz.label, CASE WHEN coalesce(ph.parts, '') <> '' THEN 'Players with ' || ph.parts
                      ELSE 'Cluster ' || CAST(sz.label AS VARCHAR) || ' - ' || CAST(sz.size AS VARCHAR) || ' players' END
       AS interpretation
FROM sz LEFT JOIN ph ON sz.label = ph.label""")
def k14_cluster_wording(spark, sf_dir):
    _, raw, _, labels = _inputs(spark, sf_dir)
    top = CL.top_features(raw, labels, 5, FEATS)
    sizes = labels.where(F.col("label") != CL.NOISE).groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return CL.interpret(top, sizes)


@job("k11_cluster_examples")
def k11_cluster_examples(spark, sf_dir):
    _, _, _, labels = _inputs(spark, sf_dir)
    return CL.examples(labels, 5, 42)


def _vectors(spark, sf_dir):
    """(id, the features, ``features``) of every player; the profiles are materialised once, as the
    scaler reads them as well."""
    prof = cut_lineage(_profiles(spark, sf_dir))
    scaled = CL.scale_wide(prof, FEATS)
    return CL.assemble(scaled.withColumnRenamed("player_id", "id"), FEATS)


@job("k01_kmeans")
def k01_kmeans(spark, sf_dir):
    """K1 + K12: best of 10 k-means restarts (k = 5), labels for every player."""
    vec = _vectors(spark, sf_dir)
    model, _ = CL.kmeans_best(vec, k=5, restarts=10)
    return model.transform(vec).select("id", F.col("prediction").alias("label"))


@job("k02_gaussian_mixture")
def k02_gaussian_mixture(spark, sf_dir):
    vec = _vectors(spark, sf_dir)
    model = CL.gaussian_mixture(vec, k=5)
    return model.transform(vec).select("id", F.col("prediction").alias("label"))


@job("k03_dbscan")
def k03_dbscan(spark, sf_dir):
    """K3 on the standardised profiles (leaves over all dimensions, exact distances)."""
    from fairplay.operators.neighbors import dbscan

    return dbscan(_profile_points(spark, sf_dir), eps=DBSCAN_EPS, min_samples=5)


VECTOR_SQL = {"vec": "SELECT id, list(value ORDER BY feature) AS x FROM std GROUP BY id",
              "dist": "SELECT a.id, b.id AS nid, list_distance(a.x, b.x) AS d FROM vec a JOIN vec b ON a.id <> b.id"}


@job("k03_dbscan_core", _views(VECTOR_SQL) + f"""
SELECT v.id, count(d.nid) + 1 >= 5 AS is_core, coalesce(max(d.core_near), 0) = 0 AND count(d.nid) + 1 < 5 AS is_noise
FROM vec v LEFT JOIN (SELECT d.*, CASE WHEN c.n >= 4 THEN 1 ELSE 0 END AS core_near FROM dist d
                      JOIN (SELECT id, count(*) AS n FROM dist WHERE d <= {DBSCAN_EPS} GROUP BY id) c ON d.nid = c.id
                      WHERE d.d <= {DBSCAN_EPS}) d ON v.id = d.id
GROUP BY v.id""")
def k03_dbscan_core(spark, sf_dir):
    """K3: which points are core and which are noise."""
    return k03_dbscan(spark, sf_dir).select("id", "is_core", (F.col("label") == -1).alias("is_noise"))


@job("k12_assign_nearest", _views({**VECTOR_SQL, "cents": "SELECT l.label, feature, avg(value) AS c FROM std JOIN labels l ON std.id = l.id WHERE l.label <> -1 GROUP BY l.label, feature",
     "far": "SELECT std.id, cents.label, sum((value - c) * (value - c)) AS d FROM std JOIN cents USING (feature) GROUP BY std.id, cents.label"}) + """
SELECT id, CAST(label AS INTEGER) AS prediction FROM far QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, label) = 1""")
def k12_assign_nearest(spark, sf_dir):
    """The nearest cluster centre of every player, for the given labelling."""
    prof = cut_lineage(_profiles(spark, sf_dir))
    vec = CL.assemble(CL.scale_wide(prof, FEATS).withColumnRenamed("player_id", "id"), FEATS)
    return CL.assign_to_clusters(vec, vec, _labels_from_profiles(prof)).select("id", F.col("prediction").cast("int").alias("prediction"))


@job("k12_density_assignment")
def k12_density_assignment(spark, sf_dir):
    """The players that the density clustering leaves out, and all others, by nearest density centre."""
    vec = cut_lineage(_vectors(spark, sf_dir))
    found = k03_dbscan(spark, sf_dir).select("id", "label")
    return CL.assign_to_clusters(vec, vec, found).select("id", F.col("prediction").cast("long").alias("prediction")).join(
        found.withColumnRenamed("label", "density_label"), "id")


@job("k13_pca_scatter")
def k13_pca_scatter(spark, sf_dir):
    """Points, centres and variance ratio in the plane of the first two components."""
    prof = cut_lineage(_profiles(spark, sf_dir))
    vec = CL.assemble(CL.scale_wide(prof, FEATS).withColumnRenamed("player_id", "id"), FEATS)
    return CL.pca_scatter(vec, _labels_from_profiles(prof))


@job("k04_hierarchical")
def k04_hierarchical(spark, sf_dir):
    vec = _vectors(spark, sf_dir)
    return CL.hierarchical(vec, k=5).select("id", "label")


@job("k05_optimal_k")
def k05_optimal_k(spark, sf_dir):
    """K5: k = 2..15 with 10 starts each, and the best k by each method."""
    vec = _vectors(spark, sf_dir)
    table, _ = CL.find_optimal_k(vec, max_k=15, starts=10)
    return table


@job("k13_pca_projection")
def k13_pca_projection(spark, sf_dir):
    vec = _vectors(spark, sf_dir)
    proj, _ = CL.pca_projection(vec, 2)
    return proj.select("id", "pc1", "pc2")


def _embedding_points(spark, sf_dir):
    """(id, x, g): embeddings as vectors, grid coordinates = first two principal components."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    emb = TB.read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    vec = emb.withColumn("features", array_to_vector("x"))
    from pyspark.ml.feature import PCA

    model = PCA(k=2, inputCol="features", outputCol="_pc").fit(vec)
    return model.transform(vec).select("id", "x", vector_to_array("_pc").alias("g"))


# ---------------------------------------------------------------- A
def _profile_points(spark, sf_dir):
    """(id, x, g): standardised profile vectors; grid = first two principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    vec = _vectors(spark, sf_dir)
    model = PCA(k=2, inputCol="features", outputCol="_pc").fit(vec)
    return model.transform(vec).select("id", vector_to_array("features").alias("x"),
                                       vector_to_array("_pc").alias("g"))


@job("a01_isolation_forest")
def a01_isolation_forest(spark, sf_dir):
    return AN.isolation_forest(_profile_points(spark, sf_dir), CONTAMINATION).select("id", "score", "is_anomaly")


@job("a02_kernel_novelty")
def a02_kernel_novelty(spark, sf_dir):
    return AN.kernel_novelty(_profile_points(spark, sf_dir), CONTAMINATION).select("id", "score", "is_anomaly")


@job("a03_local_outlier_factor")
def a03_local_outlier_factor(spark, sf_dir):
    from fairplay.operators.neighbors import local_outlier_factor

    lof = cut_lineage(local_outlier_factor(_profile_points(spark, sf_dir), k=20))  # the cut is one of these very scores
    scored = lof.withColumnRenamed("negative_outlier_factor", "score")
    return AN.flag_lowest(scored, CONTAMINATION).select("id", "lof", "score", "is_anomaly")


@job("a03_lof_values", _views(VECTOR_SQL) + """,
nn AS (SELECT id, nid, d FROM dist QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, nid) <= 20),
kd AS (SELECT id, max(d) AS kd FROM nn GROUP BY id),
lrd AS (SELECT nn.id, 1.0::DOUBLE / (avg(greatest(nn.d, kd.kd)) + 1e-10::DOUBLE) AS lrd FROM nn JOIN kd ON kd.id = nn.nid GROUP BY nn.id)
SELECT nn.id, avg(n.lrd) / any_value(o.lrd) AS lof FROM nn JOIN lrd n ON n.id = nn.nid JOIN lrd o ON o.id = nn.id GROUP BY nn.id""", doubles=["lof"])
def a03_lof_values(spark, sf_dir):
    """A3: the factor of every player, from exact neighbours."""
    from fairplay.operators.neighbors import local_outlier_factor

    return local_outlier_factor(_profile_points(spark, sf_dir), k=20).select("id", "lof")


A_SQL = {"scores": f"SELECT id, -max(abs(value)) AS score, -max(abs(value)) < -{Z_CUT} AS is_anomaly FROM std GROUP BY id"}


@job("a04_anomaly_set", _views(A_SQL) + "SELECT id, score FROM scores WHERE is_anomaly")
def a04_anomaly_set(spark, sf_dir):
    _, _, std, _ = _inputs(spark, sf_dir)
    flagged, _ = AN.anomaly_set(_standin_scores(std))
    return flagged


@job("a04_anomaly_counts", _views(A_SQL) + """
SELECT count(*) AS total, count(*) FILTER (WHERE is_anomaly) AS n_anomalies,
       count(*) FILTER (WHERE is_anomaly) / count(*) AS anomaly_rate FROM scores""")
def a04_anomaly_counts(spark, sf_dir):
    _, _, std, _ = _inputs(spark, sf_dir)
    _, summary = AN.anomaly_set(_standin_scores(std))
    return summary


A5_SQL = {**A_SQL, "rraw": f"SELECT id, feature, {fixed_sql('value', 9)} AS value FROM raw", "dev": """
  SELECT r.id, r.feature, r.value, st.mean, (r.value - st.mean) / st.std AS z_score,
         r.below / r.n * 100.0 AS percentile
  FROM (SELECT id, feature, value, rank() OVER (PARTITION BY feature ORDER BY value) - 1 AS below,
               count(*) OVER (PARTITION BY feature) AS n FROM rraw) r
  JOIN (SELECT feature, avg(value) AS mean, stddev_samp(value) AS std FROM rraw GROUP BY feature) st
    ON r.feature = st.feature
  WHERE st.std > 0 AND r.id IN (SELECT id FROM scores WHERE is_anomaly)"""}


def _dev(spark, sf_dir):
    """Deviations on the profile values rounded to 9 decimals (so ties between
    players are ties in every engine, not float noise)."""
    _, raw, std, _ = _inputs(spark, sf_dir)
    raw = raw.withColumn("value", fixed("value", 9))
    flagged = _standin_scores(std).where("is_anomaly").select("id")
    return AN.deviations(raw, flagged)


@job("a05_deviations", _views(A5_SQL) + "SELECT * FROM dev")
def a05_deviations(spark, sf_dir):
    return _dev(spark, sf_dir)


A6_SQL = {**A5_SQL, "ext": f"""
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY abs(z_score) DESC, {_FEAT_POS}) AS INTEGER) AS rank
                 FROM dev) d WHERE rank <= 5"""}


@job("a06_extreme_features", _views(A6_SQL) + "SELECT * FROM ext")
def a06_extreme_features(spark, sf_dir):
    return AN.extreme_features(_dev(spark, sf_dir), 5, FEATS)


@job("a07_anomaly_wording", _views({**A6_SQL, "parts": """
  SELECT id, string_agg(CASE WHEN z_score > 0 THEN 'extremely high' ELSE 'extremely low' END || ' ' ||
                        replace(replace(replace(feature, '_', ' '), 'avg ', ''), 'per game', ''), ', ' ORDER BY rank) AS parts
  FROM ext WHERE rank <= 3 AND abs(z_score) > 2 GROUP BY id"""}) + """
SELECT s.id, CASE WHEN p.parts IS NOT NULL THEN 'Player with ' || p.parts
                  WHEN s.id NOT IN (SELECT id FROM ext) THEN 'Unusual overall pattern'
                  ELSE 'Unusual behavioral pattern' END AS summary
FROM (SELECT id FROM scores WHERE is_anomaly) s LEFT JOIN parts p ON s.id = p.id""")
def a07_anomaly_wording(spark, sf_dir):
    _, raw, std, _ = _inputs(spark, sf_dir)
    raw = raw.withColumn("value", fixed("value", 9))
    flagged = _standin_scores(std).where("is_anomaly").select("id")
    ext = AN.extreme_features(AN.deviations(raw, flagged), 5, FEATS)
    return AN.anomaly_wording(ext, flagged)


@job("a08_score_summary", _views(A_SQL) + f"""
SELECT count(*) AS total_samples, count(*) FILTER (WHERE is_anomaly) AS n_anomalies,
       count(*) FILTER (WHERE is_anomaly) / count(*) AS anomaly_rate, min(score) AS score_min,
       max(score) AS score_max, avg(score) AS score_mean, stddev_pop(score) AS score_std,
       {CONTAMINATION!r} AS contamination FROM scores""")
def a08_score_summary(spark, sf_dir):
    _, _, std, _ = _inputs(spark, sf_dir)
    return AN.score_summary(_standin_scores(std), CONTAMINATION)


# ---------------------------------------------------------------- M
def _standin_long(spark, sf_dir):
    pm = TB.player_match(spark, sf_dir)
    pred = PR.standin_predictions(pm)
    split = PR.time_split(pred, "match_date", ["match_id"]).drop("_pos")
    members = [F.struct(F.lit(m).alias("model"), F.lit(t).alias("target"),
                        F.col(t).cast("double").alias("actual"),
                        PR.non_negative(F.col(f"pred_{m}_{t}")).alias("prediction"))
               for m in PR.MODELS for t in PR.TARGETS]
    ens = [F.struct(F.lit("ensemble").alias("model"), F.lit(t).alias("target"),
                    F.col(t).cast("double").alias("actual"),
                    PR.ensemble({m: F.col(f"pred_{m}_{t}") for m in PR.MODELS}).alias("prediction"))
           for t in PR.TARGETS]
    return split.select("player_id", "match_id", "match_date", "split",
                        F.explode(F.array(*members, *ens)).alias("p")).select(
        "player_id", "match_id", "match_date", "split", "p.*")


def _standin_sql() -> dict[str, str]:
    cols = []
    for m, n in PR.STANDIN_WINDOWS.items():
        for t in PR.TARGETS:
            cols.append(f"avg(CAST({t} AS DOUBLE)) OVER (PARTITION BY player_id ORDER BY match_date, match_id "
                        f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS pred_{m}_{t}")
    sel = []
    for m in PR.MODELS:
        for t in PR.TARGETS:
            sel.append(f"SELECT player_id, match_id, match_date, split, '{m}' AS model, '{t}' AS target, "
                       f"CAST({t} AS DOUBLE) AS actual, greatest(pred_{m}_{t}, 0.0) AS prediction FROM sp")
    for t in PR.TARGETS:
        num = " + ".join(f"coalesce(pred_{m}_{t} * {w!r}, 0.0)" for m, w in PR.ENSEMBLE_WEIGHTS.items())
        den = " + ".join(f"CASE WHEN pred_{m}_{t} IS NOT NULL THEN {w!r} ELSE 0.0 END" for m, w in PR.ENSEMBLE_WEIGHTS.items())
        sel.append(f"SELECT player_id, match_id, match_date, split, 'ensemble' AS model, '{t}' AS target, "
                   f"CAST({t} AS DOUBLE) AS actual, CASE WHEN ({den}) > 0 THEN ({num}) / ({den}) END AS prediction FROM sp")
    return {
        "pr": "SELECT *, " + ", ".join(cols) + " FROM player_match",
        "ix": "SELECT *, row_number() OVER (ORDER BY match_date, match_id) AS _pos, count(*) OVER () AS _n FROM pr",
        "sp": f"""SELECT * EXCLUDE (_pos, _n), CASE WHEN _pos <= floor(_n * {1 - 0.2!r}) AND _pos <= floor(_n * {1 - 0.2 - 0.1!r}) THEN 'train'
                       WHEN _pos <= floor(_n * {1 - 0.2!r}) THEN 'val' ELSE 'test' END AS split FROM ix""",
        "lp": "\n UNION ALL\n".join(sel),
    }


M_VIEWS = with_views("player_match", extra=_standin_sql())


@job("m15_time_split", M_VIEWS + """
SELECT split, count(*) AS rows, min(match_date) AS first_date, max(match_date) AS last_date FROM sp GROUP BY split""")
def m15_time_split(spark, sf_dir):
    pm = TB.player_match(spark, sf_dir)
    s = PR.time_split(pm, "match_date", ["match_id"])
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.min("match_date").alias("first_date"),
                                  F.max("match_date").alias("last_date"))


@job("m16_random_split")
def m16_random_split(spark, sf_dir):
    pm = TB.player_match(spark, sf_dir)
    return PR.random_split(pm, ["player_id", "match_id"]).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


_M8 = """
SELECT model, target, sqrt(avg((prediction - actual) * (prediction - actual))) AS rmse,
       avg(abs(prediction - actual)) AS mae,
       1 - sum((prediction - actual) * (prediction - actual)) / nullif(var_pop(actual) * count(*), 0) AS r2,
       avg((prediction - actual) * (prediction - actual)) AS mse, avg(actual) AS mean_actual,
       avg(prediction) AS mean_predicted, stddev_samp(actual) AS std_actual, stddev_pop(prediction) AS std_predicted,
       count(*) AS samples
FROM lp WHERE split = 'test' AND prediction IS NOT NULL AND actual IS NOT NULL GROUP BY model, target"""


def _metrics(spark, sf_dir):
    lp = _standin_long(spark, sf_dir).where(F.col("split") == "test")
    return PR.regression_metrics(lp, "actual", "prediction", ["model", "target"])


@job("m08_m11_regression_metrics", M_VIEWS + _M8)
def m08_m11_regression_metrics(spark, sf_dir):
    """M8 on the test split for the three members (M9 clamp) and their ensemble."""
    return _metrics(spark, sf_dir)


@job("m14_best_model", with_views("player_match", extra={**_standin_sql(), "ev": _M8}) + """
SELECT target, arg_min(model, (rmse, model)) AS best_model, min(rmse) AS best_rmse FROM ev GROUP BY target""")
def m14_best_model(spark, sf_dir):
    return PR.best_model(_metrics(spark, sf_dir), "rmse")


def _risk_sql(p: str, t: str) -> str:
    lo, mid, hi = PR.RISK_THRESHOLDS[t]
    return (f"CASE WHEN {p} <= {lo!r} THEN 'low' WHEN {p} <= {mid!r} THEN 'medium' "
            f"WHEN {p} <= {hi!r} THEN 'high' ELSE 'very_high' END")


def _pct_sql(p: str, t: str) -> str:
    arms = " ".join(f"WHEN {p} <= {cut!r} THEN {float(pct)!r}" for cut, pct in PR.STEP_PERCENTILES[t])
    return f"CASE {arms} ELSE 99.0 END"


def _overall_sql(cols: dict[str, str]) -> tuple[str, str]:
    score = " + ".join(f"{cols[t]} * {w!r}" for t, w in PR.OVERALL_WEIGHTS.items())
    lo, mid, hi = PR.OVERALL_CUTS
    level = (f"CASE WHEN ({score}) <= {lo!r} THEN 'low' WHEN ({score}) <= {mid!r} THEN 'medium' "
             f"WHEN ({score}) <= {hi!r} THEN 'high' ELSE 'very_high' END")
    return score, level


_RISK_COLS = {t: f"ens_{t}" for t in PR.TARGETS}
_SCORE, _LEVEL = _overall_sql(_RISK_COLS)


@job("m17_m19_risk_grades", with_views("player_match", extra={**_standin_sql(), "ens": """
  SELECT player_id, match_id, """ + ", ".join(
    f"max(prediction) FILTER (WHERE model = 'ensemble' AND target = '{t}') AS ens_{t}" for t in PR.TARGETS)
    + " FROM lp GROUP BY player_id, match_id"}) + "SELECT player_id, match_id, "
     + ", ".join(f"{_risk_sql(f'ens_{t}', t)} AS {t}_risk, {_pct_sql(f'ens_{t}', t)} AS {t}_percentile"
                 for t in PR.TARGETS)
     + f", {_SCORE} AS overall_score, {_LEVEL} AS overall_risk FROM ens WHERE "
     + " AND ".join(f"ens_{t} IS NOT NULL" for t in PR.TARGETS))
def m17_m19_risk_grades(spark, sf_dir):
    """M17-M19 on the ensemble prediction of every (player, match) that has one."""
    lp = _standin_long(spark, sf_dir).where(F.col("model") == "ensemble")
    wide = lp.groupBy("player_id", "match_id").pivot("target", PR.TARGETS).agg(F.max("prediction"))
    wide = wide.where(" AND ".join(f"{t} IS NOT NULL" for t in PR.TARGETS))
    cols = {}
    for t in PR.TARGETS:
        cols[f"{t}_risk"] = PR.risk_level(F.col(t), t)
        cols[f"{t}_percentile"] = PR.step_percentile(F.col(t), t)
    score, level = PR.overall_risk({t: F.col(t) for t in PR.TARGETS})
    cols["overall_score"] = score
    cols["overall_risk"] = level
    return wide.withColumns(cols).drop(*PR.TARGETS)


_M20_PRED = {t: f"pred_{t}" for t in PR.TARGETS}
_M20_SCORE, _M20_LEVEL = _overall_sql(_M20_PRED)


@job("m20_player_risk", with_views("player_match", extra={"rc": """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY match_date DESC, match_id DESC) AS _r
                 FROM player_match) x WHERE _r <= 10""", "ag": """
  SELECT player_id, """ + ", ".join(f"avg(CAST({t} AS DOUBLE)) AS pred_{t}" for t in PR.TARGETS) + """,
         arg_max(player_name, (match_date, match_id)) AS player_name, arg_max(position, (match_date, match_id)) AS position,
         arg_max(team, (match_date, match_id)) AS team, count(*) AS recent_games, max(match_date) AS last_game_date
  FROM rc GROUP BY player_id"""}) + "SELECT *, "
     + ", ".join(f"{_risk_sql(f'pred_{t}', t)} AS {t}_risk, {_pct_sql(f'pred_{t}', t)} AS {t}_percentile"
                 for t in PR.TARGETS)
     + f", {_M20_SCORE} AS overall_score, {_M20_LEVEL} AS overall_risk FROM ag")
def m20_player_risk(spark, sf_dir):
    return PR.player_risk(TB.player_match(spark, sf_dir), 10)


@job("m01_m12_train_evaluate")
def m01_m12_train_evaluate(spark, sf_dir):
    """Fit the member models per target on the look-back
    features (time split), evaluate on the test split."""
    from fairplay.plans.training import train_and_evaluate

    return train_and_evaluate(spark, sf_dir)


@job("m01_boosted_main")
def m01_boosted_main(spark, sf_dir):
    """M1: the main boosted model of each target, fitted and evaluated (time split)."""
    from fairplay.plans.training import train_and_evaluate

    return train_and_evaluate(spark, sf_dir, ["xgboost"])


@job("m02_random_forest")
def m02_random_forest(spark, sf_dir):
    """M2: the random forest of each target, fitted and evaluated."""
    from fairplay.plans.training import train_and_evaluate

    return train_and_evaluate(spark, sf_dir, ["random_forest"])


@job("m03_boosted_second")
def m03_boosted_second(spark, sf_dir):
    """M3: the second boosted model of each target, fitted and evaluated."""
    from fairplay.plans.training import train_and_evaluate

    return train_and_evaluate(spark, sf_dir, ["gradient_boosting"])


@job("m04_m05_linear")
def m04_m05_linear(spark, sf_dir):
    """M4, M5: ridge or lasso of each target, fitted and evaluated."""
    from fairplay.plans.training import train_and_evaluate

    return train_and_evaluate(spark, sf_dir, ["linear"])


@job("m10_predict_all")
def m10_predict_all(spark, sf_dir):
    """Predictions of all targets from fitted linear models, with totals."""
    from fairplay.plans.training import train_and_predict

    return train_and_predict(spark, sf_dir)


@job("m12_importance")
def m12_importance(spark, sf_dir):
    """Feature importances of the fitted forests."""
    from fairplay.plans.training import train_and_explain

    return train_and_explain(spark, sf_dir)


_SHARES = ("fouls", "fouls_drawn", "yellow_cards", "red_cards", "appearances")


@job("m13_average_importance", with_views("player_season", extra={
    "sums": "SELECT league, " + ", ".join(f"sum({c}) AS {c}" for c in _SHARES) + " FROM player_season GROUP BY league",
    "shares": " UNION ALL ".join(
        f"SELECT league AS model, '{c}' AS feature, CAST({c} AS DOUBLE) / ({' + '.join(_SHARES)}) AS importance FROM sums WHERE {c} > league_floor"
        .replace("league_floor", "100") for c in _SHARES)}) + """
SELECT feature, sum(importance) / (SELECT count(DISTINCT model) FROM shares) AS importance FROM shares GROUP BY feature""", doubles=["importance"])
def m13_average_importance(spark, sf_dir):
    """M13 on a stand-in: a feature's share of a league's counts, leagues as models; a
    feature that a league lacks (100 or fewer) counts 0."""
    ps = TB.player_season(spark, sf_dir)
    sums = ps.groupBy("league").agg(*[F.sum(c).alias(c) for c in _SHARES])
    total = sum((F.col(c) for c in _SHARES[1:]), F.col(_SHARES[0]))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n")) for c in _SHARES])).alias("r")
    shares = sums.select(F.col("league").alias("model"), total.alias("t"), rows).where("r.n > 100").select(
        "model", "r.feature", (F.col("r.n").cast("double") / F.col("t")).alias("importance"))
    return PR.average_importance(cut_lineage(shares))

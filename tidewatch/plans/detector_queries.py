"""Registered queries: detectors, vibration, embeddings, faults."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import alerts, clean, embeddings, evaluate, faults, features, scan, scoring, splits, thresholds, vibration
from tidewatch.operators.detectors.base import mean_and_cov
from tidewatch.operators.detectors import autoencoder, envelope, halfspace, isolation, neighbours, oneclass, sequence, store, tuning
from tidewatch.plans import retraining
from tidewatch.plans.base import fragment, r, rsql, scaled, stored_grid, with_ctes
from tidewatch.plans.evaluation_queries import feature_store, model_scores
from tidewatch.plans.operations_queries import readings_table, registry_table
from tidewatch.plans.store import stored
from tidewatch.session import materialize, scratch_path
from tidewatch.sources.files import classify_images
from tidewatch.sources.series import table

QUERIES, ORACLES = {}, {}
ROW = ["sensor_id", "pos"]


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def complete(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_incomplete(feature_store(spark, sf), features.FEATURES)


def scored_test(model, spark: SparkSession, sf: str) -> DataFrame:
    test = complete(spark, sf).where(F.col("split") == "test")
    return model.transform(test).select(*ROW, "ts", "label", "score")


# ---- detectors on the feature table ---------------------------------------------


@query("isolation_forest")
def forest(spark, sf):
    train = splits.normal_rows(complete(spark, sf))
    return scored_test(isolation.fit(train, features.FEATURES, ROW), spark, sf)


@query("half_space_trees")
def half_space(spark, sf):
    train = splits.normal_rows(complete(spark, sf))
    return scored_test(halfspace.fit(train, features.FEATURES, ["ts", "sensor_id"]), spark, sf)


@query("half_space_trees_prequential")
def half_space_online(spark, sf):
    rows = feature_store(spark, sf).where(F.col("pos") >= 0)
    unit = rows.withColumns({c: F.least(F.greatest((F.col(c) + 3) / 6, F.lit(0.0)), F.lit(1.0)) for c in features.FEATURES})
    return halfspace.prequential(unit.na.fill(0.0), features.FEATURES, ["sensor_id"])


@query("elliptic_envelope")
def robust(spark, sf):
    train = splits.normal_rows(complete(spark, sf))
    model = envelope.fit(train, features.FEATURES, ROW)
    if model is None:  # singular for every support fraction: the model is skipped
        return scored_test(envelope.plain(train, ["roll_mean_15", "roll_std_15"]), spark, sf).where(F.lit(False))
    return scored_test(model, spark, sf)


FAR = 1e8


@query(
    "covariance_uncentred",
    f"""WITH x AS (SELECT l_quantity + {FAR}::DOUBLE AS a, l_discount * 10 + {FAR}::DOUBLE AS b FROM lineitem)
        SELECT i, j, round(v, 3) + 0.0::DOUBLE AS cov FROM (
          SELECT 0 AS i, 0 AS j, var_pop(a) AS v FROM x UNION ALL SELECT 0, 1, covar_pop(a, b) FROM x
          UNION ALL SELECT 1, 0, covar_pop(a, b) FROM x UNION ALL SELECT 1, 1, var_pop(b) FROM x)""",
)
def covariance_uncentred(spark, sf):
    """Covariance of data far from zero; only the finished matrix comes from the driver."""
    rows = table(spark, sf, "lineitem").select(
        F.array(F.col("l_quantity") + F.lit(FAR), F.col("l_discount") * 10 + F.lit(FAR)).alias("x")
    )
    _, _, cov = mean_and_cov(rows)
    cells = [(i, j, float(cov[i, j])) for i in range(2) for j in range(2)]
    return spark.createDataFrame(cells, "i int, j int, cov double").select("i", "j", r("cov", 3).alias("cov"))


@query(
    "mahalanobis",
    with_ctes(
        ["zscores"],
        """, c AS (SELECT avg(roll_mean_15) AS ma, avg(roll_std_15) AS mb, var_pop(roll_mean_15) AS a, var_pop(roll_std_15) AS b,
                        covar_pop(roll_mean_15, roll_std_15) AS ab
                 FROM zscores WHERE split = 'train' AND label = 0 AND roll_mean_60 IS NOT NULL)
        SELECT sensor_id, pos, round((b * power(roll_mean_15 - ma, 2) - 2 * ab * (roll_mean_15 - ma) * (roll_std_15 - mb)
                                      + a * power(roll_std_15 - mb, 2)) / (a * b - ab * ab), 6) + 0.0::DOUBLE AS score
        FROM zscores CROSS JOIN c WHERE split = 'test' AND roll_mean_60 IS NOT NULL""",
    ),
)
def covariance(spark, sf):
    train = splits.normal_rows(complete(spark, sf))
    out = scored_test(envelope.plain(train, ["roll_mean_15", "roll_std_15"]), spark, sf)
    return out.select(*ROW, r("score").alias("score"))


@query("one_class_svm")
def one_class(spark, sf):
    train = splits.normal_rows(complete(spark, sf))
    return scored_test(oneclass.fit(train, features.FEATURES), spark, sf)


@query("local_outlier_factor_events")
def lof_events(spark, sf):
    train = splits.normal_rows(complete(spark, sf))
    return scored_test(neighbours.fit(train, features.FEATURES, 20), spark, sf)


@query("tune_one_class_svm")
def tuned_margin(spark, sf):
    """Share of outliers (nu) and threshold with the best F1 on validation rows of labelled incidents; scores of the test rows."""
    rows = materialize(with_incidents(spark, sf), "tuning-rows")
    train, held = splits.normal_rows(rows), rows.where("split = 'val'")
    model, nu, threshold = tuning.tune(lambda nu: oneclass.fit(train, features.FEATURES, nu=nu), oneclass.NU_GRID, held)
    scored = model.transform(rows.where("split = 'test'"))
    return scored.select(*ROW, "label", "score", F.lit(nu).alias("nu"), (F.col("score") > threshold).cast("int").alias("pred"))


LOF_SQL = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), refs AS (SELECT * FROM e WHERE label < 5),
       rr AS (SELECT a.vec_id AS q, b.vec_id AS o, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: power(p[1] - p[2], 2)))) AS d
              FROM refs a JOIN refs b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY d) <= 20),
       kd AS (SELECT q, max(d) AS kdist FROM rr GROUP BY 1),
       lrd AS (SELECT rr.q, 1 / (avg(greatest(d, kdist)) + 1e-10) AS lrd FROM rr JOIN kd ON kd.q = rr.o GROUP BY 1),
       qr AS (SELECT a.vec_id AS q, b.vec_id AS o, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: power(p[1] - p[2], 2)))) AS d
              FROM e a JOIN refs b ON a.label >= 5 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY d) <= 20)
       SELECT qr.q AS vec_id, round(avg(lrd) * (avg(greatest(d, kdist)) + 1e-10), 6) + 0.0::DOUBLE AS score
       FROM qr JOIN kd ON kd.q = qr.o JOIN lrd ON lrd.q = qr.o GROUP BY 1"""


@query("local_outlier_factor", LOF_SQL)
def lof_embeddings(spark, sf):
    """Reference: the embeddings of classes 0-4; scored: all others."""
    rows = table(spark, sf, "embeddings")
    model = neighbours.fit(rows.where("label < 5"), "embedding", 20)
    return model.transform(rows.where("label >= 5")).select("vec_id", r("score").alias("score"))


@query("local_outlier_factor_probing", LOF_SQL)
def lof_embeddings_probing(spark, sf):
    """The same by probing; with fewer than a thousand references there is one cell and nothing to miss."""
    rows = table(spark, sf, "embeddings")
    model = neighbours.fit(rows.where("label < 5"), "embedding", 20, recall=0.95)
    return model.transform(rows.where("label >= 5")).select("vec_id", r("score").alias("score"))


@query("local_outlier_factor_events_probing")
def lof_events_probing(spark, sf):
    """Every test row by the cells it probes, with a recall of 0.95 or more."""
    train = splits.normal_rows(complete(spark, sf))
    return scored_test(neighbours.fit(train, features.FEATURES, 20, recall=0.95), spark, sf)


@query("tune_neighbours")
def tuned(spark, sf):
    """Neighbour count and threshold with the best F1: class 9 counts as defective."""
    rows = table(spark, sf, "embeddings")
    held = rows.where("label >= 5").withColumn("label", (F.col("label") == 9).cast("int"))
    model, k, threshold = tuning.tune(
        lambda k: neighbours.fit(rows.where("label < 5"), "embedding", k), neighbours.K_GRID, held
    )
    return model.transform(held).select(
        "vec_id", "label", "score", F.lit(k).alias("k"), (F.col("score") > threshold).cast("int").alias("pred")
    )


@query(
    "sequence_windows",
    with_ctes(
        ["scaled"],
        """SELECT sensor_id, pos, 15 AS n, round(list_sum(s), 6) + 0.0::DOUBLE AS total, round(s[1], 6) + 0.0::DOUBLE AS oldest,
                  round(s[8], 6) + 0.0::DOUBLE AS middle, round(s[15], 6) + 0.0::DOUBLE AS newest
           FROM (SELECT sensor_id, pos, list_concat(list_transform(range(0, 15 - len(w)), lambda i: w[1]), w) AS s
                 FROM (SELECT sensor_id, pos, list(x) OVER (PARTITION BY sensor_id ORDER BY pos ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS w
                       FROM scaled))""",
    ),
)
def sequence_rows(spark, sf):
    rows = sequence.sequences(scaled(spark, sf), ["value_scaled"], ["sensor_id"])
    s = F.col("sequence")
    return rows.select(
        *ROW,
        F.size(s).alias("n"),
        r(F.aggregate(s, F.lit(0.0), lambda a, v: a + v)).alias("total"),
        *[r(F.element_at(s, i)).alias(n) for i, n in ((1, "oldest"), (8, "middle"), (15, "newest"))],
    )


@query("sequence_reconstruction")
def reconstruction(spark, sf):
    """Linear autoencoder over 15 x 22 windows; the score is the last step's squared error."""
    rows = sequence.sequences(complete(spark, sf), features.FEATURES, ["sensor_id"])
    model = sequence.fit(splits.normal_rows(rows), len(features.FEATURES))
    return model.transform(rows.where("split = 'test'")).select(*ROW, "label", "score")


@query("sequence_autoencoder")
def curved_reconstruction(spark, sf):
    """The same by a non-linear autoencoder."""
    rows = materialize(sequence.sequences(complete(spark, sf), features.FEATURES, ["sensor_id"]), "autoencoder-windows")
    model = autoencoder.fit(splits.normal_rows(rows), len(features.FEATURES))
    return model.transform(rows.where("split = 'test'")).select(*ROW, "label", "score")


@query(
    "contamination_offset",
    with_ctes(
        ["scores"],
        f"SELECT model, {rsql('quantile_cont(-score, 0.01::DOUBLE)', '\"offset\"')} FROM scores WHERE split = 'train' AND label = 0 GROUP BY 1",
    ),
)
def offsets(spark, sf):
    train = splits.normal_rows(model_scores(spark, sf))
    return isolation.contamination_offsets(train, ["model"], 0.01).withColumn("offset", r("offset"))


@query("retrain_and_promote")
def retrained(spark, sf):
    ranked, _, _ = retraining.retrain(readings_table(spark, sf), registry_table(spark, sf), trees=100)
    return ranked


@query("retrain_registry")
def retrained_registry(spark, sf):
    """The registry after retraining: one production model, whose artifact can be loaded."""
    root = scratch_path(spark, "models")
    _, registry, artifacts = retraining.retrain(readings_table(spark, sf), registry_table(spark, sf), trees=100, root=root)
    for path in artifacts.values():
        store.load(spark, path)
    return registry.select("name", "artifact_path", "threshold", "is_production")


@query(
    "model_round_trip",
    with_ctes(
        ["zscores"],
        """, c AS (SELECT avg(roll_mean_15) AS ma, avg(roll_std_15) AS mb, var_pop(roll_mean_15) AS a, var_pop(roll_std_15) AS b,
                        covar_pop(roll_mean_15, roll_std_15) AS ab
                 FROM zscores WHERE split = 'train' AND label = 0 AND roll_mean_60 IS NOT NULL)
        SELECT sensor_id, pos, round((b * power(roll_mean_15 - ma, 2) - 2 * ab * (roll_mean_15 - ma) * (roll_std_15 - mb)
                                      + a * power(roll_std_15 - mb, 2)) / (a * b - ab * ab), 6) + 0.0::DOUBLE AS score
        FROM zscores CROSS JOIN c WHERE split = 'val' AND roll_mean_60 IS NOT NULL""",
    ),
)
def round_trip(spark, sf):
    """A model that was written, read back and then applied."""
    rows = complete(spark, sf)
    fitted = envelope.plain(splits.normal_rows(rows), ["roll_mean_15", "roll_std_15"])
    model = store.load(spark, store.save(fitted, spark, scratch_path(spark, "models")))
    return model.transform(rows.where("split = 'val'")).select(*ROW, r("score").alias("score"))


# ---- vibration: embeddings read as 64-sample signals ---------------------------------


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("signal"))


fragment("samples", "SELECT vec_id, unnest(range(0, 64)) AS n, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings")
fragment(
    "time_rows",
    """SELECT vec_id, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak, max(abs(x)) / (sqrt(avg(x * x)) + 1e-9) AS crest_factor,
              avg(power(x - m, 4)) / power(avg(power(x - m, 2)), 2) AS kurtosis, avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5) AS skewness,
              avg(power(x - m, 2)) AS variance
       FROM (SELECT *, avg(x) OVER (PARTITION BY vec_id) AS m FROM samples) GROUP BY 1""",
    "samples",
)
fragment(
    "power_rows",
    """SELECT vec_id, f, power(sum(x * cos(2 * pi() * f * n / 64)), 2) + power(sum(x * sin(2 * pi() * f * n / 64)), 2) AS p
       FROM samples CROSS JOIN (SELECT unnest(range(0, 33)) AS f) GROUP BY 1, 2""",
    "samples",
)
fragment(
    "spectral_rows",
    """SELECT vec_id, arg_max(f, p) * 20000 / 64.0::DOUBLE AS dominant_freq, sum(f * 20000 / 64.0::DOUBLE * p) / any_value(total) AS spectral_centroid,
              -sum(CASE WHEN p > 0 THEN p / total * log2(p / total) ELSE 0 END) AS spectral_entropy, any_value(total) AS total_power
       FROM (SELECT *, sum(p) OVER (PARTITION BY vec_id) + 1e-9 AS total FROM power_rows) GROUP BY 1""",
    "power_rows",
)
TIME_SQL = ", ".join(rsql(c, c) for c in vibration.TIME_FEATURES)
SNAPSHOT_SQL = f"vec_id, {TIME_SQL}, {rsql('dominant_freq', 'dominant_freq')}, {rsql('spectral_centroid', 'spectral_centroid', 4)}, {rsql('spectral_entropy', 'spectral_entropy')}, {rsql('total_power', 'total_power')}"


def rounded_snapshot(df: DataFrame) -> list:
    return [r(c, 4 if c == "spectral_centroid" else 6).alias(c) for c in vibration.FEATURES]


@query("vibration_time_features", with_ctes(["time_rows"], f"SELECT vec_id, {TIME_SQL} FROM time_rows"))
def time_rows(spark, sf):
    """From long form: the path for snapshots stored one sample per row."""
    out = vibration.time_features(vibration.long_form(signals(spark, sf), ["vec_id"]), ["vec_id"])
    return out.select("vec_id", *[r(c).alias(c) for c in vibration.TIME_FEATURES])


@query(
    "vibration_power_spectrum",
    with_ctes(["power_rows"], f"SELECT vec_id, f AS bin, {rsql('p', 'power')} FROM power_rows"),
)
def spectrum_rows(spark, sf):
    power = signals(spark, sf).select("vec_id", vibration.power_spectrum(F.col("signal")).alias("p"))
    return power.select("vec_id", F.posexplode("p").alias("bin", "power")).withColumn("power", r("power"))


@query(
    "vibration_snapshot_features",
    with_ctes(
        ["time_rows", "spectral_rows"],
        f"SELECT {SNAPSHOT_SQL}, row_number() OVER (ORDER BY vec_id) - 1 AS file_index FROM time_rows JOIN spectral_rows USING (vec_id)",
    ),
)
def snapshots(spark, sf):
    out = vibration.index_snapshots(vibration.snapshot_features(signals(spark, sf), ["vec_id"]), "vec_id")
    return out.select("vec_id", "file_index", *rounded_snapshot(out))


@query(
    "vibration_strided_subset",
    """SELECT vec_id, i // 4 AS file_index FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings)
       WHERE i % 4 = 0""",
)
def subset(spark, sf):
    rows = vibration.index_snapshots(signals(spark, sf).select("vec_id"), "vec_id")
    total = rows.count()
    return vibration.strided(rows, total, total // 4)


@query(
    "vibration_waveform",
    """SELECT vec_id, n // 4 AS place, round(x, 6) + 0.0::DOUBLE AS x FROM (
         SELECT vec_id, unnest(range(0, 64)) AS n, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) WHERE n % 4 = 0""",
)
def waveform(spark, sf):
    thin = signals(spark, sf).select("vec_id", vibration.thin_waveform(F.col("signal"), 16).alias("w"))
    out = thin.select("vec_id", F.posexplode("w").alias("place", "x"))
    return out.withColumn("x", r(F.col("x").cast("double")))


@query(
    "vibration_spectrum_head",
    with_ctes(
        ["power_rows"],
        f"SELECT vec_id, f AS bin, f * 20000 / 64.0::DOUBLE AS frequency, {rsql('sqrt(p)', 'magnitude', 5)} FROM power_rows WHERE f < 20",
    ),
)
def spectrum_head(spark, sf):
    power = signals(spark, sf).select("vec_id", "signal", vibration.power_spectrum(F.col("signal")).alias("p"))
    head = vibration.spectrum_head(F.col("p"), F.size("signal"), bins=20)
    out = power.select("vec_id", F.posexplode(head).alias("bin", "b"))
    return out.select("vec_id", "bin", "b.frequency", r("b.magnitude", 5).alias("magnitude"))


@query(
    "prefix_split",
    """SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY vec_id) <= 400 THEN 1 ELSE 0 END AS is_normal FROM embeddings""",
)
def prefix(spark, sf):
    return splits.prefix_split(signals(spark, sf), "vec_id", 400).select("vec_id", "is_normal")


def degradation(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        rows = vibration.index_snapshots(vibration.snapshot_features(signals(spark, sf), ["vec_id"]), "vec_id")
        normalised, model = vibration.fit_degradation(stored(spark, sf, "snapshots", lambda: rows))
        return vibration.score_snapshots(normalised, model)

    return stored(spark, sf, "degradation", build)


@query("vibration_scores")
def vibration_scores(spark, sf):
    return degradation(spark, sf).select("vec_id", "file_index", "is_normal", "anomaly_score", "is_anomaly")


@query("vibration_score_range")
def vibration_range(spark, sf):
    return vibration.score_range(degradation(spark, sf))


@query("vibration_status", "SELECT count(*) > 0 AS dataset_available, count(DISTINCT vec_id) AS total_snapshots, true AS model_loaded FROM embeddings")
def vibration_status(spark, sf):
    return vibration.dataset_status(signals(spark, sf), "vec_id", True)


@query(
    "degradation_trend",
    with_ctes(
        ["time_rows"],
        f"""SELECT i AS file_index, {rsql('crest_factor', 'score')}, {rsql('rms', 'rms')}
            FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM time_rows) ORDER BY i DESC LIMIT 100""",
    ),
)
def trend(spark, sf):
    """The newest 100 snapshots; here the crest factor stands for the score."""
    rows = vibration.index_snapshots(vibration.snapshot_features(signals(spark, sf), ["vec_id"]), "vec_id")
    out = alerts.trend(rows.withColumn("score", F.col("crest_factor")))
    return out.select("file_index", r("score").alias("score"), r("rms").alias("rms"))


# ---- image embeddings and images -------------------------------------------------------


def good_and_rest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").withColumn("label", (F.col("label") >= 5).cast("int"))


def image_scores(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        rows = good_and_rest(spark, sf)
        model = embeddings.fit_good(rows.where("label = 0"), "embedding", ["vec_id"])
        return embeddings.with_decision(rows, model).select("vec_id", "label", "raw")

    return stored(spark, sf, "image_scores", build)


@query("image_verdicts")
def verdicts(spark, sf):
    rows = image_scores(spark, sf)
    limit = embeddings.midpoint_threshold(rows.withColumn("k", F.lit("all")), ["k"]).select("threshold").scalar()
    return embeddings.verdict(rows, limit)


@query(
    "midpoint_threshold",
    """SELECT event_type AS sensor_id, round(g, 6) + 0.0::DOUBLE AS good_mean, round(d, 6) + 0.0::DOUBLE AS defect_mean,
              round((g + d) / 2, 6) + 0.0::DOUBLE AS threshold
       FROM (SELECT event_type, avg(value) FILTER (user_id % 2 = 0) AS g, avg(value) FILTER (user_id % 2 = 1) AS d FROM events GROUP BY 1)""",
)
def midpoints(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("sensor_id"), (F.col("user_id") % 2).alias("label"), F.col("value").alias("score")
    )
    out = thresholds.midpoint(rows, ["sensor_id"])
    return out.select("sensor_id", *[r(c).alias(c) for c in ("good_mean", "defect_mean", "threshold")])


def page_images(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as image files: class, split and extension follow from the page number."""
    n = F.col("page_id")
    folder = F.when(n % 3 == 0, "ok_front/").when(n % 3 == 1, "def_front/").otherwise("other/")
    part = F.when(n % 2 == 0, "vision/test/").otherwise("vision/train/")
    ext = F.element_at(F.array(*[F.lit(e) for e in (".png", ".jpg", ".JPEG", ".txt")]), (n % 4 + 1).cast("int"))
    return table(spark, sf, "pages").select(
        F.concat(part, folder, n.cast("string"), ext).alias("path"), F.encode("html", "UTF-8").alias("content")
    )


fragment(
    "images",
    """SELECT page_id, path, CASE WHEN page_id % 3 = 0 THEN 'good' ELSE 'defective' END AS label,
              CASE WHEN page_id % 2 = 0 THEN 'test' ELSE 'train' END AS split, html
       FROM (SELECT *, CASE WHEN page_id % 2 = 0 THEN 'vision/test/' ELSE 'vision/train/' END
                       || CASE page_id % 3 WHEN 0 THEN 'ok_front/' WHEN 1 THEN 'def_front/' ELSE 'other/' END || page_id
                       || CASE page_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.JPEG' ELSE '.txt' END AS path FROM pages)
       WHERE page_id % 3 < 2 AND page_id % 4 < 3""",
)


@query("classify_images", with_ctes(["images"], "SELECT path, label, split FROM images"))
def classified(spark, sf):
    return classify_images(page_images(spark, sf)).select("path", "label", "split")


@query(
    "image_gallery",
    with_ctes(
        ["images"],
        """SELECT label, place, regexp_replace(path, '^.*/', '') AS filename,
                  'data:' || CASE WHEN path LIKE '%.png' THEN 'image/png' ELSE 'image/jpeg' END || ';base64,' || base64(encode(html)) AS data
           FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(path || '42'), path) AS place FROM images WHERE split = 'test')
           WHERE place <= 5""",
    ),
)
def image_gallery(spark, sf):
    return embeddings.gallery(classify_images(page_images(spark, sf)).where("split = 'test'"))


@query("decode_data_uri", "SELECT page_id, md5(html) AS content_hash FROM pages")
def decoded(spark, sf):
    """Every page encoded as a data URI and decoded again; odd pages without a header."""
    rows = table(spark, sf, "pages").withColumn("uri", embeddings.data_uri(F.col("url"), F.encode("html", "UTF-8")))
    text = F.when(F.col("page_id") % 2 == 0, F.col("uri")).otherwise(F.regexp_replace("uri", "^[^,]*,", ""))
    return rows.select("page_id", F.md5(embeddings.decode_data_uri(text)).alias("content_hash"))


# ---- faults -----------------------------------------------------------------------------

KINDS = ("spike", "gradual_drift", "sensor_stuck", "missing_values", "overheating", "vibration_fault", "unheard_of")
LEGACY_KINDS = ("spike", "drift", "stuck", "dropout", "overheating")


def fault_schedule(spark: SparkSession, sf: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Large events start a fault in their slot: type, length and size from their property."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf, "events").where(F.col("value") > 120).withColumn("k", k)
    slot = clean.floor_div(F.unix_seconds(F.col("ts").cast("timestamp")), 300) * 300
    schedule = rows.select(
        F.col("event_id").alias("fault_id"),
        F.col("event_type").alias("sensor_id"),
        F.element_at(F.array(*[F.lit(t) for t in kinds]), F.col("k") % len(kinds) + 1).alias("fault_type"),
        F.timestamp_seconds(slot).alias("start"),
        (F.col("k") % 20).alias("duration_steps"),
        F.col("k").cast("double").alias("magnitude"),
    )
    return schedule


def schedule_sql(kinds: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(kinds))
    return f"""SELECT event_id AS fault_id, event_type AS sensor_id, CASE k % {len(kinds)} {cases} END AS fault_type,
                      CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 AS begin_s, k % 20 AS duration_steps, k::DOUBLE AS magnitude
               FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) WHERE value > 120"""


fragment("schedule", schedule_sql(KINDS))
fragment("legacy_schedule", schedule_sql(LEGACY_KINDS))


def injected_sql(schedule: str, value: str) -> str:
    return with_ctes(
        ["grid", schedule],
        f""", usable AS (SELECT * FROM {schedule} WHERE fault_type <> 'vibration_fault' AND duration_steps > 0
                       QUALIFY row_number() OVER (PARTITION BY sensor_id, begin_s ORDER BY fault_id DESC) = 1),
        g AS (SELECT *, epoch(ts)::BIGINT AS s FROM grid),
        a AS (SELECT g.sensor_id, g.pos, g.ts, g.value, u.fault_id, u.fault_type, u.magnitude, u.duration_steps, (g.s - u.begin_s) // 300 AS step
              FROM g ASOF JOIN usable u ON g.sensor_id = u.sensor_id AND g.s >= u.begin_s),
        c AS (SELECT *, first_value(value) OVER (PARTITION BY fault_id ORDER BY step) AS held FROM a WHERE step < duration_steps)
        SELECT g.sensor_id, g.pos, c.fault_id, c.fault_type, c.step,
               round(CASE WHEN c.fault_id IS NULL THEN g.value ELSE {value} END, 6) + 0.0::DOUBLE AS injected
        FROM g LEFT JOIN c USING (sensor_id, pos)""",
    )


@query(
    "inject_faults",
    injected_sql(
        "schedule",
        """CASE c.fault_type WHEN 'spike' THEN c.value + CASE WHEN step < least(3, duration_steps) THEN magnitude ELSE 0 END
               WHEN 'gradual_drift' THEN c.value + magnitude * step / duration_steps::DOUBLE WHEN 'sensor_stuck' THEN held
               WHEN 'missing_values' THEN NULL WHEN 'overheating' THEN c.value + magnitude * power(step / duration_steps::DOUBLE, 2)
               ELSE c.value END""",
    ),
)
def injected(spark, sf):
    out = faults.inject(stored_grid(spark, sf), fault_schedule(spark, sf))
    return out.select(*ROW, "fault_id", "fault_type", "step", r("injected").alias("injected"))


@query(
    "inject_faults_legacy",
    injected_sql(
        "legacy_schedule",
        """CASE c.fault_type WHEN 'spike' THEN c.value + magnitude WHEN 'drift' THEN c.value + magnitude * power(1.1::DOUBLE, step)
               WHEN 'stuck' THEN held WHEN 'dropout' THEN 0 WHEN 'overheating' THEN c.value + magnitude + 2 * step ELSE c.value END""",
    ),
)
def injected_legacy(spark, sf):
    out = faults.inject(stored_grid(spark, sf), fault_schedule(spark, sf, LEGACY_KINDS), legacy=True)
    return out.select(*ROW, "fault_id", "fault_type", "step", r("injected").alias("injected"))


@query("inject_noise")
def noisy(spark, sf):
    """Noise is drawn from a hash of the row, so every run gives the same values."""
    out = faults.inject(stored_grid(spark, sf), fault_schedule(spark, sf, ("noise_burst",)))
    return out.select(*ROW, "fault_id", "step", "value", "injected")


@query(
    "rejected_faults",
    with_ctes(["schedule"], "SELECT fault_id, sensor_id FROM schedule WHERE fault_type = 'vibration_fault'"),
)
def rejected(spark, sf):
    return faults.rejected_requests(fault_schedule(spark, sf)).select("fault_id", "sensor_id")


@query(
    "fault_status",
    with_ctes(
        ["schedule"],
        """SELECT fault_id, sensor_id, fault_type, duration_steps, magnitude, step, passed >= 1 AND step < duration_steps AS active
           FROM (SELECT *, greatest(0, least(passed, duration_steps)) AS step FROM (
             SELECT *, CAST(floor((epoch(TIMESTAMP '2024-01-15 12:00:00') - begin_s) / 300) AS BIGINT) + 1 AS passed FROM schedule))""",
    ),
)
def fault_states(spark, sf):
    return faults.fault_status(fault_schedule(spark, sf), "2024-01-15 12:00:00")


@query(
    "fault_types",
    with_ctes(["schedule"], "SELECT fault_type, fault_type IN ('spike', 'gradual_drift', 'sensor_stuck', 'missing_values', 'noise_burst', 'overheating', 'vibration_fault') AS known, count(*) AS n FROM schedule GROUP BY 1"),
)
def fault_types(spark, sf):
    kind = F.col("fault_type")
    return fault_schedule(spark, sf).groupBy(kind, kind.isin(*faults.FAULT_TYPES).alias("known")).agg(F.count("*").alias("n"))


# ---- leaderboard ----------------------------------------------------------------

# fixed values: an incident is a reading beyond this share of its sensor's, and lasts some minutes
INCIDENT_SHARE, INCIDENT_MINUTES = 0.995, 25


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    """(sensor_id, start, end): what the values themselves show, so that labels say something about the features."""
    rows = stored_grid(spark, sf)
    limits = scan.exact_quantiles(rows, ["sensor_id"], "value", [INCIDENT_SHARE]).select("sensor_id", "quantile")
    beyond = rows.where("imputed = 0").join(limits, "sensor_id").where(F.col("value") > F.col("quantile"))
    return beyond.select("sensor_id", F.col("ts").alias("start"), (F.col("ts") + F.expr(f"INTERVAL {INCIDENT_MINUTES} MINUTES")).alias("end"))


INCIDENT_SQL = f"""inc AS (
      SELECT g.sensor_id, g.ts AS s, g.ts + INTERVAL {INCIDENT_MINUTES} MINUTES AS e FROM grid g
      JOIN (SELECT sensor_id, quantile_cont(value, {INCIDENT_SHARE}) AS q FROM grid GROUP BY 1) USING (sensor_id) WHERE imputed = 0 AND value > q)"""


@query(
    "incident_labels",
    with_ctes(
        ["labelled"],
        f""", {INCIDENT_SQL}
        SELECT sensor_id, pos, CASE WHEN EXISTS (SELECT 1 FROM inc WHERE inc.sensor_id = l.sensor_id AND l.ts BETWEEN s AND e) THEN 1 ELSE 0 END AS label
        FROM labelled l""",
    ),
)
def incident_labels(spark, sf):
    """Every reading with the label of the incidents around it."""
    return splits.label_from_table(stored_grid(spark, sf), incidents(spark, sf)).select(*ROW, "label")


def with_incidents(spark: SparkSession, sf: str) -> DataFrame:
    return splits.label_from_table(complete(spark, sf).drop("label"), incidents(spark, sf))


@query("evaluation_all_detectors")
def evaluate_detectors(spark, sf):
    """One ranked row per detector on the same test rows, thresholds from validation, with the cost of scoring."""
    return stored(spark, sf, "leaderboard", lambda: leaderboard(spark, sf))


BASELINE_NAME = "Rolling Z-score (Baseline)"


def fitted_detectors(spark: SparkSession, rows: DataFrame) -> dict[str, object]:
    train = splits.normal_rows(rows)
    fitted = {
        "Isolation Forest": isolation.fit(train, features.FEATURES, ROW),
        "Half-space Trees (Online)": halfspace.fit(train, features.FEATURES, ["ts", "sensor_id"]),
        "Elliptic Envelope": envelope.fit(train, features.FEATURES, ROW),
        "One-class SVM": oneclass.fit(train, features.FEATURES),
        "Local Outlier Factor": neighbours.fit(train, features.FEATURES, 20, recall=0.95),
    }
    return {name: model for name, model in fitted.items() if model is not None}


def detector_scores(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(model, row, split, label, score) of all detectors on validation and test rows, and (model, ms_per_row):
    the wall time in which each scored its rows to a stored table, over their number."""
    root = scratch_path(spark, "detector-scores")

    def build() -> DataFrame:
        rows = materialize(with_incidents(spark, sf), "incident-rows")
        held = rows.where("split <> 'train'")
        columns = [*ROW, "split", "label", "score"]
        jobs = {BASELINE_NAME: held.withColumn("score", F.abs("zscore_15"))}
        jobs |= {name: model.transform(held) for name, model in fitted_detectors(spark, rows).items()}
        windows = materialize(sequence.sequences(rows, features.FEATURES, ["sensor_id"]), "incident-windows")
        coder = sequence.fit(splits.normal_rows(windows), len(features.FEATURES))
        jobs["Sequence Reconstruction"] = coder.transform(windows.where("split <> 'train'"))
        costs = []
        for i, (name, scored) in enumerate(jobs.items()):  # a few detectors
            begun = time.perf_counter()
            scored.select(F.lit(name).alias("model"), *columns).write.parquet(f"{root}/detector={i}")
            costs.append((name, 1000 * (time.perf_counter() - begun)))
        spark.createDataFrame(costs, "model string, ms double").write.parquet(f"{root}-costs")
        return spark.read.parquet(root).drop("detector").join(spark.read.parquet(f"{root}-costs"), "model")

    both = stored(spark, sf, "detector_scores", build)
    costs = both.groupBy("model").agg((F.max("ms") / F.count("*")).alias("ms_per_row"))
    return both.drop("ms"), costs


def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    long, costs = detector_scores(spark, sf)
    limits = thresholds.best_linear(long.where("split = 'val'"), ["model"]).select("model", "threshold")
    preds = long.where("split = 'test'").join(limits, "model").withColumn(
        "pred", (F.col("score") > F.col("threshold")).cast("int")
    )
    results = evaluate.evaluation(preds).join(costs, "model").withColumnRenamed("ms_per_row", "avg_inference_ms")
    results = results.withColumn("throughput_rps", F.lit(1000.0) / (F.col("avg_inference_ms") + F.lit(evaluate.EPS)))
    return evaluate.rank_models(results)


@query("ensemble_of_detectors")
def detectors_vote(spark, sf):
    """Votes of all detectors on every test reading, each at the threshold its validation rows chose."""
    long, _ = detector_scores(spark, sf)
    limits = {
        row["model"]: row["threshold"]
        for row in thresholds.best_linear(long.where("split = 'val'"), ["model"]).select("model", "threshold").collect()  # one each
    }
    names = {model: f"score_{i}" for i, model in enumerate(sorted(limits))}
    wide = long.where("split = 'test'").groupBy(*ROW, "label").agg(
        *[F.max(F.when(F.col("model") == model, F.col("score"))).alias(column) for model, column in names.items()]
    )
    voted = scoring.ensemble_vote(wide, {model: (column, limits[model]) for model, column in names.items()})
    return voted.select(*ROW, "label", "votes", "total_models", "ensemble_confidence", "is_anomaly", "message", "model_details")

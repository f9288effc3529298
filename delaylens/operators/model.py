"""Delay-risk model on Spark ML: assemble, weighted boosted trees, score,
importance, artifacts, and the scorable / rejected split for serving.

The split rows are stored once; every pass over them reads only its columns.
GBT runs many jobs, one or more per tree level, over all training rows, though it
tells them apart by bin only (``maxBins``). So beyond ``WHOLE_ROWS`` the features
are cut into their bins first, and rows alike in all bins and label become one row
that has the sum of their weights: every gradient, impurity and gain is that of all
rows, and the passes grow with the occupied bins. Up to ``WHOLE_ROWS`` rows GBT
itself looks at every row to find its bins, and gets the rows as they are.

The boosting loop checkpoints its prediction / error data into the shared
checkpoint folder every 10 iterations, so a lost executor does not replay all
earlier trees. Node-id caching is off: at depth 5 it costs more checkpoint I/O
than it saves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FEATURES, LABEL
from ..session import ensure_checkpoint_dir, has_scratch
from .features import fill_weight_from_rows
from .geo import add_coordinates, with_distance
from .joins import stored_side
from .metrics import with_risk
from .sellers import enrich_seller_rate, fill_seller_rate, mean_seller_rate
from .split import Split, assign_split

# Upstream hyper-parameters (100 rounds, rate 0.1, depth 5,
# positive-class weight 10, seed 42, 20 % stratified hold-out).
DEFAULT_PARAMS = {"rounds": 100, "step": 0.1, "depth": 5, "pos_weight": 10.0, "seed": 42, "test_fraction": 0.2}


#: Suffixes of the matrix columns: value with the missing ones filled, indicator.
FILLED, MISSING = "__filled", "__missing"
#: Its bin; bins of a feature at most (GBT's ``maxBins``), and the rows up to which
#: GBT finds bins by all rows instead of a sample of about so many.
BIN, BINS, WHOLE_ROWS = "__bin", 32, 10_000


@dataclass
class TrainResult:
    model: PipelineModel
    train: DataFrame
    test: DataFrame


def build_pipeline(rounds: int = 100, step: float = 0.1, depth: int = 5, seed: int = 42, fills: dict[str, float] | None = None,
                   cuts: dict[str, list[float]] | None = None) -> Pipeline:
    """M1 + M3: feature matrix, bins by ``cuts`` (if given) and weighted GBT.

    The upstream trees learn at each split which way missing values go; Spark's
    send NaN one fixed way. So a missing value (NULL or NaN) is replaced by a
    neutral one (``fills``, the training means) and told by an indicator of its
    own, on which trees can split: the direction is learned from the labels.
    Indicators of features that are never missing give no split candidates.
    """
    fills = fills or {}
    parts = []
    for f in FEATURES:
        parts.append(f"coalesce(nanvl(cast(`{f}` as double), cast(null as double)), {float(fills.get(f) or 0.0)!r}D) AS `{f}{FILLED}`")
        parts.append(f"cast(`{f}` IS NULL OR isnan(cast(`{f}` as double)) AS double) AS `{f}{MISSING}`")
    matrix = SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")
    inputs = [f + (BIN if cuts else FILLED) for f in FEATURES]
    assembler = VectorAssembler(inputCols=inputs + [f + MISSING for f in FEATURES], outputCol="features")
    binned = Bucketizer(
        splitsArray=[[-float("inf"), *cuts[f], float("inf")] for f in FEATURES], inputCols=[f + FILLED for f in FEATURES], outputCols=inputs
    ) if cuts else None
    gbt = GBTClassifier(
        featuresCol="features",
        labelCol=LABEL,
        weightCol="weight",
        maxIter=rounds,
        stepSize=step,
        maxDepth=depth,
        seed=seed,
        lossType="logistic",
        maxBins=BINS,
        cacheNodeIds=False,
        checkpointInterval=10,
    )
    return Pipeline(stages=[matrix, *([binned] if binned else []), assembler, gbt])


def training_means(rows: DataFrame) -> dict[str, float]:
    """Mean of each feature over the rows that have it, and the number of rows: one
    row."""
    known = {f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in FEATURES}
    return rows.agg(*[F.avg(x).alias(f) for f, x in known.items()], F.count(F.lit(1)).alias("rows")).first().asDict()


def bin_cuts(matrix: DataFrame) -> dict[str, list[float]]:
    """Where the bins of each filled feature start, the first left out: every value
    of a feature of at most ``BINS`` values, else its quantiles."""
    names = [f + FILLED for f in FEATURES]
    sizes = matrix.agg(*[F.approx_count_distinct(n, 0.02).alias(n) for n in names]).first()
    found = matrix.approxQuantile(names, [k / BINS for k in range(1, BINS)], 0.001)
    ends = {float("-inf"), float("inf")}
    cuts = {f: sorted(set(q) - ends) or [0.0] for f, q in zip(FEATURES, found)}
    for f, n in zip(FEATURES, names):
        if sizes[n] <= 2 * BINS:  # an estimate
            values = sorted(r[0] for r in matrix.select(n).distinct().limit(BINS + 1).collect())
            if len(values) <= BINS and not ends.intersection(values):
                cuts[f] = values[1:] or values
    return cuts


def fit_cells(train: DataFrame, pipeline: Pipeline) -> PipelineModel:
    """Fit on one row for all rows alike in bins and label. Indicators that are the
    same in all rows, on which no tree can split, are left out."""
    *prepare, assembler, gbt = pipeline.getStages()
    rows = PipelineModel(prepare).transform(train)
    ever = rows.agg(*[F.max(f + MISSING).alias(f) for f in FEATURES], *[F.min(f + MISSING).alias(f"not {f}") for f in FEATURES]).first()
    assembler.setInputCols([f + BIN for f in FEATURES] + [f + MISSING for f in FEATURES if ever[f] != ever[f"not {f}"]])
    alike = [*[f + BIN for f in FEATURES], *[f + MISSING for f in FEATURES], LABEL]
    cells = rows.groupBy(*alike).agg(F.sum("weight").alias("weight"))
    # as many even tasks as run at once: each tree level is a job
    cells = cells.repartition(max(2, train.sparkSession.sparkContext.defaultParallelism)).persist()
    fitted = Pipeline(stages=[assembler, gbt]).fit(cells)
    cells.unpersist()
    return PipelineModel([*prepare, *fitted.stages])


def with_class_weight(df: DataFrame, pos_weight: float = 10.0) -> DataFrame:
    return df.withColumn("weight", F.when(F.col(LABEL) == 1, F.lit(float(pos_weight))).otherwise(F.lit(1.0)))


def train_gbt(features: DataFrame, hash_columns: list[str] | None = None, **params) -> TrainResult:
    """M2 + M3: exact stratified split, then fit on the training part. The rows'
    places in the split follow ``hash_columns`` (default: all)."""
    p = {**DEFAULT_PARAMS, **params}
    ensure_checkpoint_dir(features.sparkSession)
    keep = [c for c in features.columns if c in ("order_id", "seller_id", *(hash_columns or ())) and c not in FEATURES]
    data = features.select(*FEATURES, F.col(LABEL).cast("double").alias(LABEL), *keep)
    # the narrow training rows are stored once: cheaper than re-deriving the
    # feature chain in each branch of the split
    assigned = assign_split(stored_side(data, "training-rows"), LABEL, p["test_fraction"], p["seed"], hash_columns)
    split = Split.of(stored_side(assigned, "split-rows"))
    train = with_class_weight(split.train, p["pos_weight"])
    if not has_scratch(train.sparkSession):
        train = train.persist()
    facts = training_means(train)
    shape = (p["rounds"], p["step"], p["depth"], p["seed"], facts)
    if facts["rows"] > WHOLE_ROWS:
        matrix = build_pipeline(*shape).getStages()[0].transform(train)
        model = fit_cells(train, build_pipeline(*shape, bin_cuts(matrix)))
    else:
        model = build_pipeline(*shape).fit(train)
    train.unpersist()
    return TrainResult(model, split.train, split.test)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """M4: hard prediction and positive-class probability."""
    out = model.transform(df)
    return out.withColumn("delay_risk_probability", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", *[f + suffix for f in FEATURES for suffix in (FILLED, MISSING, BIN)]
    )


def evaluation_frame(model: PipelineModel, test: DataFrame) -> DataFrame:
    """(y, p, pred) over the hold-out, ready for the metric operators."""
    scored = predict(model, test)
    return scored.select(
        F.col(LABEL).cast("int").alias("y"),
        F.col("delay_risk_probability").alias("p"),
        F.col("prediction").cast("int").alias("pred"),
    )


def feature_importance(spark: SparkSession, root: str, k: int = 10) -> DataFrame:
    """M8/F2: top-k features by gain, the mean impurity gain of the splits that
    use a feature or its indicator of missing values, over the nodes of all trees
    of the stored model (``root``), and their number. Features that no split uses
    have no row. Ties go by name."""
    nodes = spark.read.parquet(f"{root}/model/stages/*/data").select("nodeData.gain", "nodeData.split.featureIndex")
    assembler = next(x for x in PipelineModel.load(f"{root}/model").stages if isinstance(x, VectorAssembler))
    names = F.array(*[F.lit(c.rpartition("__")[0]) for c in assembler.getInputCols()])
    used = nodes.filter(F.col("featureIndex") >= 0)
    return (
        used.groupBy(F.get(names, F.col("featureIndex")).alias("feature"))
        .agg(F.avg("gain").alias("mean_gain"), F.count(F.lit(1)).alias("splits"))
        .orderBy(F.desc("mean_gain"), "feature")
        .limit(k)
    )


# --------------------------------------------------------------------------- artifacts

def training_stats(features: DataFrame, profile: DataFrame) -> DataFrame:
    """One row of fill values stored with the model, so scoring does not
    depend on the composition of the scored batch."""
    return features.agg(F.avg("product_weight_g").alias("mean_weight_g")).select(
        "mean_weight_g", mean_seller_rate(profile).alias("mean_seller_rate")
    )


def save_artifacts(model: PipelineModel, profile: DataFrame, centroid: DataFrame, stats: DataFrame, root: str) -> None:
    """A8 + A9: Spark ML writer for the model, Parquet for the tables."""
    model.write().overwrite().save(f"{root}/model")
    profile.write.mode("overwrite").parquet(f"{root}/seller_profile")
    centroid.write.mode("overwrite").parquet(f"{root}/geo_centroid")
    stats.write.mode("overwrite").parquet(f"{root}/training_stats")


@dataclass
class Artifacts:
    model: PipelineModel
    seller_profile: DataFrame
    geo_centroid: DataFrame
    stats: DataFrame

    def fill_values(self) -> tuple[float | None, float | None]:
        """(mean weight, mean seller rate): one stored row."""
        row = self.stats.first()
        return (row["mean_weight_g"], row["mean_seller_rate"]) if row else (None, None)


def load_artifacts(spark: SparkSession, root: str) -> Artifacts:
    return Artifacts(
        PipelineModel.load(f"{root}/model"),
        spark.read.parquet(f"{root}/seller_profile"),
        spark.read.parquet(f"{root}/geo_centroid"),
        spark.read.parquet(f"{root}/training_stats"),
    )


# --------------------------------------------------------------------------- serving

def split_scorable(df: DataFrame, centroid: DataFrame, profile: DataFrame, mean_weight=None, rate_fill=None):
    """Feature rows that can be scored, and the rest with a reason.

    Upstream silently drops rows without a distance; here they are kept apart
    with ``no_seller_geo`` or ``no_customer_geo``. Other missing features are
    left to the trees, as in training.
    """
    cols = set(df.columns)
    if "s_lat" not in cols:
        df = add_coordinates(df, centroid, "seller_zip_code_prefix", "s_lat", "s_lng")
    if "c_lat" not in cols:
        df = add_coordinates(df, centroid, "customer_zip_code_prefix", "c_lat", "c_lng")
    df = with_distance(df)
    if "seller_late_rate" not in df.columns:
        df = enrich_seller_rate(df, profile)
    if rate_fill is None:
        df = fill_seller_rate(df, profile)
    else:
        df = df.withColumn("seller_late_rate", F.coalesce(F.col("seller_late_rate"), F.lit(float(rate_fill))))
    df = fill_weight_from_rows(df, mean_weight)
    reason = F.when(F.col("s_lat").isNull(), "no_seller_geo").when(F.col("distance_km").isNull(), "no_customer_geo")
    tagged = df.withColumn("reject_reason", reason)
    scorable = tagged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    rejected = tagged.filter(F.col("reject_reason").isNotNull()).withColumnRenamed("reject_reason", "reason")
    return scorable, rejected


def score_orders(df: DataFrame, artifacts: Artifacts, threshold: float = 0.5, use_stored_fills: bool = True,
                 fills: tuple | None = None):
    """M9 + M10: stored profile and centroid, model probability, strict flag.

    With ``use_stored_fills`` the weight and unknown-seller fills come from
    the training statistics (required for streams); otherwise the weight
    falls back to the batch mean as upstream. Returns (scored, rejected)."""
    if fills is not None:
        weight, rate = fills
    else:
        weight, rate = artifacts.fill_values() if use_stored_fills else (None, None)
    scorable, rejected = split_scorable(df, artifacts.geo_centroid, artifacts.seller_profile, weight, rate)
    scored = with_risk(predict(artifacts.model, scorable), "delay_risk_probability", threshold)
    return scored, rejected

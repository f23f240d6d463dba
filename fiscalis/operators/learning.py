"""Per-region learners on the same prepared columns: linear models in one grouped
pass, tree ensembles for all regions at once."""

from __future__ import annotations

from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalis import reference_data as ref
from fiscalis.operators import ensembles
from fiscalis.operators.histogram_trees import Rules
from fiscalis.operators.linear import fit_linear, linear_value, normal_equations
from fiscalis.operators.ranking import group_medians

NUMERIC = ["PRE", "CRE", "ratio_cre_pre", "obr_lag_1", "obr_lag_2", "obr_lag_3", "obr_lag_4", "anio"]
PREPARED = [f"x_{c}" for c in NUMERIC]
FLAGS = [f"cap_{c}" for c, _, _ in ref.CHAPTERS]
ROW_KEYS = ["ccaa_slug", "entidad_id", "anio", "capitulo_id", "OBR", "is_test"]


# --- preparation -------------------------------------------------------------

def chapter_modes(rows: DataFrame) -> DataFrame:
    """The most frequent chapter per region, the smallest on ties."""
    counts = rows.where(F.col("capitulo_id").isNotNull()).groupBy("ccaa_slug", "capitulo_id").agg(
        F.count(F.lit(1)).alias("n"))
    return counts.groupBy("ccaa_slug").agg(F.min(F.struct(-F.col("n"), "capitulo_id")).alias("m")).select(
        "ccaa_slug", F.col("m.capitulo_id").alias("_mode"))


def numeric_medians(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(ccaa_slug, _medians): median of each column per region, as a map that
    leaves out columns without any value."""
    long = rows.select("ccaa_slug", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ["ccaa_slug"], columns, "variable", "value")
    medians = group_medians(long, ["ccaa_slug", "variable"], "value")
    return medians.groupBy("ccaa_slug").agg(F.map_from_entries(
        F.collect_list(F.struct("variable", "median"))).alias("_medians"))


def fit_preparation(train: DataFrame) -> DataFrame:
    """(ccaa_slug, _medians, _mode): what `apply_preparation` needs to know of the train rows."""
    return numeric_medians(train, NUMERIC).join(chapter_modes(train), "ccaa_slug", "left")


def apply_preparation(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """Numeric columns as distance to the region's train median, so that a
    missing value is 0, and one 0/1 column per chapter, a missing chapter being
    the region's most frequent one."""
    joined = rows.join(fitted, "ccaa_slug")
    chapter = F.coalesce("capitulo_id", "_mode")

    def shifted(c: str):
        middle = F.try_element_at("_medians", F.lit(c))
        return F.coalesce(F.col(c).cast("double") - middle, F.lit(0.0)).alias(f"x_{c}")

    return joined.select(
        *[c for c in ROW_KEYS if c in rows.columns], *[shifted(c) for c in NUMERIC],
        *[F.when(chapter == c, 1.0).otherwise(0.0).alias(f"cap_{c}") for c, _, _ in ref.CHAPTERS])


def prepare(rows: DataFrame) -> DataFrame:
    """The preparation fitted on train rows and applied to all."""
    return apply_preparation(rows, fit_preparation(rows.where(~F.col("is_test"))))


def standardise(design: DataFrame) -> DataFrame:
    """z_ columns: the prepared numeric columns less the region's train mean, in train standard
    deviations (of the population); a column without spread is only shifted."""
    train = design.where(~F.col("is_test"))
    stats = train.groupBy("ccaa_slug").agg(*[F.avg(c).alias(f"_m_{c}") for c in PREPARED], *[F.stddev_pop(c).alias(f"_s_{c}") for c in PREPARED])

    def scaled(c: str):
        spread = F.when(F.col(f"_s_{c}") > 1e-9 * (1 + F.abs(f"_m_{c}")), F.col(f"_s_{c}")).otherwise(F.lit(1.0))
        return ((F.col(c) - F.col(f"_m_{c}")) / spread).alias(f"z_{c.removeprefix('x_')}")

    return design.join(stats, "ccaa_slug").select(*design.columns, *[scaled(c) for c in PREPARED])


def preparation_stages(numeric: list[str], categorical: list[str]) -> list:
    """The same preparation as MLlib stages for one region's rows: median
    imputing and scaling, most frequent category and one-hot. Columns without
    any value must be left out."""
    filled = [f"{c}_f" for c in numeric]
    return [
        Imputer(strategy="median", inputCols=numeric, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_numeric"),
        StandardScaler(inputCol="_numeric", outputCol="_scaled", withMean=True, withStd=True),
        StringIndexer(inputCols=categorical, outputCols=[f"{c}_i" for c in categorical], handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"{c}_i" for c in categorical], outputCols=[f"{c}_v" for c in categorical]),
        VectorAssembler(inputCols=["_scaled", *[f"{c}_v" for c in categorical]], outputCol="features"),
    ]


def fill_modes(df: DataFrame, categorical: list[str]) -> DataFrame:
    """Missing categories become the most frequent one of the table."""
    row = df.agg(*[F.mode(c, deterministic=True).alias(c) for c in categorical]).first()
    return df.fillna({c: row[c] for c in categorical if row[c] is not None})


def target(log: bool):
    return F.log1p("OBR") if log else F.col("OBR")


# --- learners -----------------------------------------------------------------

def linear_equations(design: DataFrame, alpha: float, log: bool = False) -> DataFrame:
    """What is left of the normal equations of a linear model per region, over its train rows."""
    rows = design.where(~F.col("is_test")).withColumn("_target", target(log))
    fit = fit_linear(rows, "ccaa_slug", PREPARED, FLAGS, "_target", alpha)
    return normal_equations(rows, fit, "ccaa_slug", PREPARED, FLAGS, "_target", alpha)


def fit_credit(rows: DataFrame, medians: DataFrame) -> DataFrame:
    """Stored weights of a straight line per region from the credit to the amount, over train rows.
    Where credit and budget are missing the train median stands in, kept as `credito_ausente`."""
    train = with_credit(rows.where(~F.col("is_test")).join(medians.select("ccaa_slug", F.col("median").alias("credito_ausente")), "ccaa_slug"))
    fit = train.groupBy("ccaa_slug").agg(
        F.coalesce(F.regr_intercept("OBR", "credito"), F.avg("OBR")).alias("a"), F.coalesce(F.regr_slope("OBR", "credito"), F.lit(0.0)).alias("credito"),
        F.max("credito_ausente").alias("credito_ausente"))
    return fit.unpivot(["ccaa_slug"], ["a", "credito", "credito_ausente"], "columna", "peso").withColumn(
        "columna", F.when(F.col("columna") == "a", "").otherwise(F.col("columna")))


def with_credit(rows: DataFrame) -> DataFrame:
    return rows.withColumn("credito", F.coalesce("CRE", "PRE", "credito_ausente"))


def linear_predictions(design: DataFrame, model: str, alpha: float, log: bool = False) -> DataFrame:
    """Test rows of all regions with the forecast of a linear model per region,
    fitted for all regions in one pass."""
    rows = design.withColumn("_target", target(log))
    fit = fit_linear(rows.where(~F.col("is_test")), "ccaa_slug", PREPARED, FLAGS, "_target", alpha)
    value = linear_value([*PREPARED, *FLAGS])
    out = rows.where(F.col("is_test")).join(fit, "ccaa_slug")
    return out.select(
        *[c for c in ROW_KEYS if c in out.columns and c != "is_test"], F.lit(model).alias("modelo"),
        (F.expm1(value) if log else value).alias("prediccion"))


FOREST = Rules(trees=300, rate=0.0, depth=6)
SHALLOW_FOREST = Rules(trees=300, rate=0.0, depth=5)
BOOSTING = Rules(trees=300, rate=0.05, depth=4)
# Second-order gain: an L2 term of 1 on leaf values, as one third-party booster has it; regions are trained with
# the first, the estimator's own defaults are the second.
SECOND_ORDER = Rules(trees=300, rate=0.05, depth=4, penalty=1.0)
DEEP_SECOND_ORDER = Rules(trees=500, rate=0.05, depth=6, penalty=1.0)
# Leaf by leaf, as the other has it: 63 leaves, 20 rows in each at least.
LEAF_WISE = Rules(trees=500, rate=0.05, depth=None, leaves=63, least_rows=20)


def fit_trees(design: DataFrame, rules: Rules, log: bool = False) -> DataFrame:
    """The tree model of every region of a design with row numbers, from its train rows."""
    return ensembles.fit_trees(design.where(~F.col("is_test")), rules, PREPARED, FLAGS, target(log))


def tree_predictions(design: DataFrame, model: DataFrame, name: str, log: bool = False) -> DataFrame:
    """Test rows of all regions with the forecast of their region's model."""
    test = design.where(F.col("is_test"))
    keys = [c for c in ROW_KEYS if c in design.columns and c != "is_test"]
    value = F.expm1("forecast") if log else F.col("forecast")
    found = ensembles.forecast_trees(test, model, PREPARED, FLAGS)
    return test.join(found, "number").select(*keys, F.lit(name).alias("modelo"), value.alias("prediccion"))


def importances(model: DataFrame, top: int = 10) -> DataFrame:
    """The strongest columns of each region's tree model."""
    return ensembles.importances(model, [*NUMERIC, *FLAGS], top)

"""Queries of labels, splits, metrics and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.catalog import base as B
from postwatch.catalog.base import query
from postwatch.functions import arrays as A
from postwatch.operators import metrics, ordinal
from postwatch.plans import classify


@query(
    "class_counts",
    "SELECT quality + toxic AS label, count(*) AS n FROM labels GROUP BY 1",
)
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = B.table(spark, sf_dir, "labels")
    return metrics.class_counts(labels.select((F.col("quality") + F.col("toxic")).alias("label")))


@query(
    "class_weights",
    """SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight
FROM (SELECT label % 3 AS label, count(*) AS n FROM embeddings GROUP BY 1)""",
)
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = metrics.class_weights(three_classes(spark, sf_dir))
    return weights.withColumn("weight", F.round("weight", 6))


def three_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored vectors with their labels in three classes."""
    return B.table(spark, sf_dir, "embeddings").withColumn("label", F.col("label") % 3)


@query(
    "relabel_binary",
    "SELECT vec_id, CASE WHEN label % 3 = 2 THEN 0 ELSE label % 3 END AS label FROM embeddings",
)
def relabel_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return three_classes(spark, sf_dir).select(
        "vec_id", A.binary_label(F.col("label")).alias("label")
    )


@query(
    "one_hot",
    """SELECT vec_id, array_to_string([CAST(label % 3 = 0 AS INTEGER), CAST(label % 3 = 1 AS INTEGER),
       CAST(label % 3 = 2 AS INTEGER)], ' ') AS one_hot FROM embeddings""",
)
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return three_classes(spark, sf_dir).select(
        "vec_id", B.joined(A.one_hot(F.col("label"), 3)).alias("one_hot")
    )


def class_scores() -> Column:
    """Scores of three classes: the greatest of every third number of a vector."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(2)),
        lambda c: F.array_max(F.filter("embedding", lambda x, i: i % 3 == c)),
    )


SCORES = """list_transform([0, 1, 2], lambda c: list_max(list_filter(embedding,
         lambda x, i: (i - 1) % 3 = c)))"""


@query(
    "argmax_label",
    """SELECT vec_id, p AS label, CASE p WHEN 0 THEN 'negative' WHEN 1 THEN 'positive'
       WHEN 2 THEN 'neutral' END AS sentiment
FROM (SELECT vec_id, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS p
      FROM (SELECT vec_id, """ + SCORES + """ AS s FROM embeddings))""",
)
def argmax_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = A.argmax(class_scores())
    return B.table(spark, sf_dir, "embeddings").select(
        "vec_id", label.alias("label"), A.label_name(label).alias("sentiment")
    )


RANKED = """r AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS r, count(*) OVER () AS n,
               CAST(floor(count(*) OVER () * 0.2) AS BIGINT) AS t FROM embeddings)"""


def _split(name: str, sql: str, build) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(B.table(spark, sf_dir, "embeddings")).select("vec_id", "label", "split")

    query(name, sql)(run)


_split(
    "split_positional",
    f"""WITH {RANKED} SELECT vec_id, label,
  CASE WHEN r < t THEN 'test' WHEN r < 2 * t THEN 'valid' ELSE 'train' END AS split FROM r""",
    lambda df: ordinal.split_positional(df, "vec_id"),
)
_split(
    "split_positional_compat",
    f"""WITH {RANKED} SELECT vec_id, label,
  CASE WHEN r < t THEN 'test' WHEN r < 2 * t THEN 'valid' ELSE 'train' END AS split
FROM r WHERE r <> t AND r <> 2 * t""",
    lambda df: ordinal.split_positional(df, "vec_id", compat=True),
)
_split(
    "split_60_40",
    f"""WITH {RANKED} SELECT vec_id, label,
  CASE WHEN r < ceil(n * 0.6) THEN 'train' ELSE 'test' END AS split FROM r""",
    lambda df: ordinal.split_head(df, "vec_id"),
)
_split(
    "split_tail",
    f"""WITH {RANKED} SELECT vec_id, label,
  CASE WHEN r >= n - floor(n * 0.3) THEN 'valid' ELSE 'train' END AS split FROM r""",
    lambda df: ordinal.split_tail(df, "vec_id", 0.3),
)
_split(
    "split_hash",
    """SELECT vec_id, label,
  CASE WHEN CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 2000
       THEN 'valid' ELSE 'train' END AS split FROM embeddings""",
    lambda df: ordinal.split_hash(df, "vec_id"),
)


# Predictions: the place of the greatest number of a vector, in three classes.
JUDGED = """j AS (SELECT vec_id, label % 3 AS y_true,
             CAST((list_position(embedding, list_max(embedding)) - 1) % 3 AS INTEGER) AS y_pred
      FROM embeddings)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return three_classes(spark, sf_dir).select(
        "vec_id", F.col("label").alias("y_true"), (A.argmax(F.col("embedding")) % 3).alias("y_pred")
    )


@query(
    "confusion_matrix",
    f"WITH {JUDGED} SELECT y_true, y_pred, count(*) AS n FROM j GROUP BY ALL",
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(judged(spark, sf_dir))


@query(
    "confusion_matrix_dense",
    f"""WITH {JUDGED},
c AS (SELECT unnest([0, 1, 2, 3]) AS y_true)
SELECT c.y_true, count(*) FILTER (WHERE y_pred = 0) AS pred_0,
       count(*) FILTER (WHERE y_pred = 1) AS pred_1, count(*) FILTER (WHERE y_pred = 2) AS pred_2,
       count(*) FILTER (WHERE y_pred = 3) AS pred_3
FROM c LEFT JOIN j ON c.y_true = j.y_true GROUP BY c.y_true""",
)
def confusion_matrix_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.dense_matrix(metrics.confusion_matrix(judged(spark, sf_dir)), [0, 1, 2, 3])


@query(
    "accuracy",
    f"WITH {JUDGED} SELECT round(avg(CAST(y_true = y_pred AS INTEGER)), 6) AS accuracy FROM j",
)
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy(judged(spark, sf_dir)).select(
        F.round("accuracy", 6).alias("accuracy")
    )


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def sql_binary(y: str, p: str) -> str:
    """Sums behind the binary metrics."""
    return f"""sum(CAST(round_even({y} * round_even({p}, 0), 0) AS DOUBLE)) AS tp,
       sum(CAST(round_even({p}, 0) AS DOUBLE)) AS pp, CAST(sum({y}) AS DOUBLE) AS pos,
       CAST(sum(1 - {y}) AS DOUBLE) AS neg"""


SQL_BINARY = """prec AS "precision", rec AS recall,
       2 * (prec * rec) / (prec + rec + 0.0000001) AS f1,
       (pp - tp) / (neg + 0.0000001) AS fprate
FROM (SELECT *, tp / (pp + 0.0000001) AS prec, tp / nullif(pos, 0) AS rec FROM b)"""
SQL_BINARY_ROUNDED = """round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1,
       round(fprate, 6) AS fprate"""


@query(
    "binary_metrics",
    f"""WITH b AS (SELECT {sql_binary("quality", "toxic")} FROM labels)
SELECT {SQL_BINARY_ROUNDED} FROM (SELECT {SQL_BINARY})""",
)
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.binary_metrics(B.table(spark, sf_dir, "labels"), "quality", "toxic")
    return _rounded(found, *found.columns)


@query(
    "micro_metrics",
    f"""WITH c AS (SELECT unnest([CAST(label % 3 = i AS INTEGER) FOR i IN [0, 1, 2]]) AS y,
                  unnest([CAST(x AS DOUBLE) + 0.25 FOR x IN {SCORES}]) AS p FROM embeddings),
b AS (SELECT {sql_binary("y", "p")} FROM c)
SELECT {SQL_BINARY_ROUNDED} FROM (SELECT {SQL_BINARY})""",
)
def micro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.transform(class_scores(), lambda x: x.cast("double") + 0.25)
    rows = three_classes(spark, sf_dir).select(
        A.one_hot(F.col("label"), 3).alias("y"), scores.alias("scores")
    )
    found = metrics.micro_metrics(rows, "y", "scores")
    return _rounded(found, *found.columns)


@query(
    "per_class_metrics",
    f"""WITH {JUDGED}, k AS (SELECT unnest([0, 1, 2]) AS label),
s AS (SELECT label, count(*) FILTER (WHERE y_true = label) AS actual,
             count(*) FILTER (WHERE y_pred = label) AS predicted,
             count(*) FILTER (WHERE y_true = label AND y_pred = label) AS hits,
             count(*) FILTER (WHERE y_true <> label AND y_pred <> label) AS tn,
             avg(CAST(y_true = y_pred AS INTEGER)) AS accuracy FROM k CROSS JOIN j GROUP BY label),
m AS (SELECT *, hits / nullif(predicted, 0) AS p, hits / nullif(actual, 0) AS r,
             tn / nullif(tn + predicted - hits, 0) AS s FROM s)
SELECT label, round(accuracy, 6) AS accuracy, round(p, 6) AS "precision", round(r, 6) AS recall,
       round(2 * p * r / nullif(p + r, 0), 6) AS f1, round(s, 6) AS specificity FROM m""",
)
def per_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.per_class_metrics(metrics.confusion_matrix(judged(spark, sf_dir)))
    return _rounded(found, *found.columns[1:])


@query(
    "leaderboard",
    f"""WITH c AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS run,
                  label % 2 AS y FROM embeddings),
b AS (SELECT run, {sql_binary("y", "CAST(x > 0.1 AS INTEGER)")} FROM c GROUP BY run)
SELECT run, {SQL_BINARY_ROUNDED}
FROM (SELECT CAST(run AS INTEGER) AS run, {SQL_BINARY})
WHERE recall > 0 AND "precision" IS NOT NULL
ORDER BY f1 DESC, recall DESC, "precision" DESC, run LIMIT 8""",
)
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each place of the vectors is a run that predicts 1 above a border."""
    embeddings = B.table(spark, sf_dir, "embeddings")
    runs = embeddings.select(
        F.posexplode("embedding").alias("run", "x"), (F.col("label") % 2).alias("y")
    ).withColumn("p", (F.col("x") > 0.1).cast("int"))
    found = metrics.leaderboard(metrics.binary_metrics(runs, "y", "p", by=["run"]))
    return _rounded(found, *found.columns[1:])


def _unnested(values: dict) -> str:
    out = []
    for name, choices in values.items():
        items = ", ".join(f"'{c}'" if isinstance(c, str) else
                          f"CAST({c} AS DOUBLE)" if isinstance(c, float) else str(c) for c in choices)
        out.append(f'(SELECT unnest([{items}]) AS "{name}")')
    return " CROSS JOIN ".join(out)


@query(
    "param_grid",
    f"""WITH w AS (SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight
           FROM (SELECT label % 3 AS label, count(*) AS n FROM embeddings GROUP BY 1))
SELECT * FROM w CROSS JOIN {_unnested(classify.CNN_GRID)}""",
)
def param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = classify.run_plan(three_classes(spark, sf_dir), "label", classify.CNN_GRID)
    return plan.withColumn("weight", F.round("weight", 6))


@query(
    "nb_gaussian_stats",
    """SELECT label, pos, count(*) AS n, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance
FROM (SELECT label % 3 AS label, CAST(unnest(embedding) AS DOUBLE) AS x,
             CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos FROM embeddings)
GROUP BY ALL""",
)
def nb_gaussian_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify.gaussian_stats(three_classes(spark, sf_dir), "label", "embedding")
    return _rounded(found, "mean", "variance")

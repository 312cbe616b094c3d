"""Score trees and score documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.strict_json import parse_whole
from .paths import exists, file_path

RESULT_FILE = "statistical_analysis/result_stats.json"

TEXT_BY_NAME = T.MapType(T.StringType(), T.StringType())

# Fixed value: the first member of a JSON object, if it is a number.
FIRST_NUMBER = (
    r'^\s*\{\s*"(?:[^"\\]|\\.)*"\s*:\s*'
    r"(-?(?:[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|Infinity)|NaN)\s*[,}]"
)


def read_scores(spark: SparkSession, root: str, layout: str = "tree") -> DataFrame:
    """``model, dataset, score`` from result files; the first JSON value times 100.

    Layout ``tree`` is ``{root}/{model}/{dataset}/statistical_analysis/result_stats.json``;
    ``partitioned`` is what ``sinks.write_metrics`` writes.  A file that is not valid
    JSON, or whose first value is not a number, has a null score; ``valid_scores``
    leaves those out.
    """
    if layout == "tree":
        found = f"{root.rstrip('/')}/*/*/{RESULT_FILE}"
        if not exists(spark, found):
            return spark.createDataFrame([], "model string, dataset string, score double")
        files = spark.read.text(found, wholetext=True)
        pattern = r"([^/]+)/([^/]+)/" + RESULT_FILE.replace(".", r"\.") + "$"
        named = files.select(
            F.regexp_extract(file_path(), pattern, 1).alias("model"),
            F.regexp_extract(file_path(), pattern, 2).alias("dataset"),
            "value",
        )
    else:
        # Given types keep names such as 007 or 1e3 as they are written.
        named = spark.read.schema("value string, model string, dataset string").text(root)
    valid = parse_whole(F.col("value"), TEXT_BY_NAME).isNotNull()
    first = F.when(valid, F.regexp_extract("value", FIRST_NUMBER, 1).try_cast("double"))
    return named.select("model", "dataset", F.round(first * 100, 2).alias("score"))


def valid_scores(scores: DataFrame) -> DataFrame:
    """Scores that exist; a model without any disappears."""
    return scores.filter(F.col("score").isNotNull())


def read_scores_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``{model: {dataset: score}}`` as rows; nulls stay null.

    ``lines=True`` reads one such object per line, as ``sinks.write_scores`` writes them.
    """
    docs = spark.read.text(path, wholetext=not lines)
    scores = F.from_json("value", "map<string,map<string,double>>")
    models = docs.select(F.explode_outer(scores).alias("model", "_scores"))
    return models.filter(F.col("model").isNotNull()).select("model", F.explode("_scores").alias("dataset", "score"))

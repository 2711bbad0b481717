"""An evaluation run: all questions are answered in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evals
from ..sources import tables
from .ask import run as ask
from .index import Index


def run(index: Index, questions: DataFrame, output: str | None = None, judge=None, **options) -> tuple[DataFrame, DataFrame]:
    """(results, one-row summary). output: a path for JSON lines of the results. Without a judge the run is dry."""
    answers = ask(index, questions.select(F.col("id").alias("query_id"), F.col("question").alias("query")), **options)
    answers = answers.withColumnsRenamed({"query_id": "question_id", "query": "question"}).withColumns({"retrieval_ms": F.lit(0.0), "error": F.lit(None).cast("string")})
    results = evals.evaluate(questions, answers, judge)
    if output:
        tables.write_results(results, output)
        results = index.spark.read.schema(evals.RESULT).json(output)
    return results, evals.summary(results)

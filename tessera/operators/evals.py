"""Evaluation of answers: recall of files, judge scores, and the summary of a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_recall, judge_scores

RESULT = (
    "question_id string, question string, answer string, retrieved_files array<string>, expected_files array<string>, file_recall double, "
    "judge_scores struct<faithfulness:double,completeness:double,relevance:double,explanation:string>, retrieval_ms double, llm_ms double, total_ms double, "
    "cache_hit boolean, input_tokens int, output_tokens int, tags array<string>, error string"
)


def evaluate(questions: DataFrame, answers: DataFrame, judge: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Results of questions (id, question, expected_files, tags) and answers (question_id, answer, relevant_files, ...).

    judge(question, answer) gives the judge model's raw text; without one the scores are null.
    """
    a = answers.withColumnRenamed("question_id", "id")
    kinds = dict(c.split(maxsplit=1) for c in RESULT.split(", "))
    out = questions.select("id", "question", "expected_files", "tags").join(a.drop("question"), "id", "left")
    out = out.withColumn("retrieved_files", F.col("relevant_files"))
    scores = F.lit(None) if judge is None else F.when(F.col("error").isNull() if "error" in a.columns else F.lit(True), judge_scores(judge(F.col("question"), F.substring("answer", 1, 3000))))
    values = {"question_id": F.col("id"), "file_recall": file_recall("expected_files", "retrieved_files"), "judge_scores": scores}
    return out.select(*[values.get(c, F.col(c) if c in out.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def summary(results: DataFrame) -> DataFrame:
    """One row: counts, means over answered (and judged) questions, 0.0 where there are none, and token totals."""
    good = F.col("error").isNull()
    mean = lambda c, when=good: F.coalesce(F.avg(F.when(when, c)), F.lit(0.0))
    judged = good & F.col("judge_scores").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0)).cast("long")
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(good).alias("successful"),
        F.count_if(~good).alias("failed"),
        *[mean(F.col(f"judge_scores.{c}"), judged).alias(f"mean_{c}") for c in ("faithfulness", "completeness", "relevance")],
        mean(F.col("file_recall")).alias("mean_file_recall"),
        mean(F.col("retrieval_ms")).alias("mean_retrieval_ms"),
        mean(F.when(F.col("cache_hit"), 1.0).otherwise(0.0)).alias("cache_hit_rate"),
        total("input_tokens").alias("total_input_tokens"),
        total("output_tokens").alias("total_output_tokens"),
    )

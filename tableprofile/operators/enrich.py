"""Calling an injected answer function over many prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

EMPTY_ANSWER = "(no answer)"
FAILED_ANSWER = "(the answer could not be generated)"

Answer = Callable[[str], str]


def answer_prompts(
    prompts: DataFrame,
    make_answer: Callable[[], Answer],
    prompt: str = "prompt",
    tasks: int | None = None,
) -> DataFrame:
    """Replace the prompt by ``answer`` and ``error``.

    ``make_answer`` is called once per task and returns the function that answers one
    prompt, so that a client is opened once per task. A prompt that fails gives a
    fixed text and the error, and the others go on. A task that is repeated asks again.
    ``tasks`` spreads slow calls over more tasks than the size of the prompts asks for.
    Answers stay whole.
    """
    if tasks is not None:
        prompts = prompts.repartition(tasks)
    keys = [f for f in prompts.schema.fields if f.name != prompt]
    schema = T.StructType([*keys, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = make_answer()

        def one(text: str | None) -> tuple[str, str | None]:
            if text is None:
                return FAILED_ANSWER, "no prompt"
            try:
                said = (answer(text) or "").strip()
            except Exception as e:  # noqa: BLE001 - any failure of the injected function
                return FAILED_ANSWER, f"{type(e).__name__}: {e}"
            return said or EMPTY_ANSWER, None

        for batch in batches:
            answers = [one(text) for text in batch[prompt]]
            result = batch.drop(columns=prompt)
            result["answer"] = [a for a, _ in answers]
            result["error"] = [e for _, e in answers]
            yield result

    return prompts.mapInPandas(run, schema)


def batch_answers(
    questions: DataFrame,
    build_prompts: Callable[[DataFrame], DataFrame],
    make_answer: Callable[[], Answer],
    keys: Sequence[str] = ("question",),
    tasks: int | None = None,
) -> DataFrame:
    """Answer every different question once.

    Repeated questions collapse before prompts are built, so copies cost no call and
    the long prompts are not shuffled for it.
    """
    return answer_prompts(build_prompts(questions.select(*keys).distinct()), make_answer, tasks=tasks)


# Prompts that are asked before their answers are written down.
PROMPTS_PER_RUN = 10_000


def ledger_answers(
    prompts: DataFrame,
    make_answer: Callable[[], Answer],
    ledger_path: str,
    prompt: str = "prompt",
    prompts_per_run: int = PROMPTS_PER_RUN,
    tasks: int | None = None,
) -> DataFrame:
    """Replace the prompt by ``answer`` and ``error``, asking nothing that the ledger has an answer to.

    The ledger is a table of answers by the digest of their prompt. Only different prompts
    that are not in it are asked, ``prompts_per_run`` at a time, and each run's answers are
    written before the next is asked. So a job that broke off asks again at most what its
    last run had not written, and equal prompts of different questions cost one call. Runs
    are slices of the digests; one that is repeated replaces its own folder. Prompts that
    failed are in no run's answers and are asked again by the next job; here they give
    ``FAILED_ANSWER`` and the error. A null prompt is not asked.
    """
    spark = prompts.sparkSession
    digest = F.sha2(F.col(prompt), 256)
    keyed = prompts.withColumn("_digest", digest)
    known = _ledger(spark, ledger_path)
    asked = keyed.where(F.col(prompt).isNotNull()).join(known.where("error IS NULL"), "_digest", "left_anti")
    # Written with the prompts, so that each run reads its own folder and prompts are built once.
    todo_path, n = scratch_path(spark, "prompts"), asked.select("_digest").distinct().count()
    if n:
        runs = -(-n // prompts_per_run)
        run = F.pmod(F.xxhash64("_digest"), F.lit(runs)).cast("int")
        once = asked.groupBy("_digest").agg(F.min(prompt).alias("prompt"))
        once.withColumn("run", run).write.partitionBy("run").parquet(todo_path)
        todo = spark.read.schema("_digest string, prompt string, run int").parquet(todo_path)
        job = f"{runs}-{spark.range(1).select(F.uuid()).first()[0]}"
        for i in range(runs):
            answers = answer_prompts(todo.where(F.col("run") == i).drop("run"), make_answer, tasks=tasks)
            answers.write.mode("overwrite").parquet(f"{ledger_path}/job={job}/run={i}")
    # A prompt that failed before may have an answer since.
    found = _ledger(spark, ledger_path).groupBy("_digest").agg(
        F.min_by("answer", F.struct(F.col("error").isNotNull(), F.col("job"))).alias("answer"),
        F.min_by("error", F.struct(F.col("error").isNotNull(), F.col("job"))).alias("error"),
    )
    unasked = F.col(prompt).isNull()
    return keyed.join(found, "_digest", "left").select(
        *(F.col(c) for c in prompts.columns if c != prompt),
        F.when(unasked, F.lit(FAILED_ANSWER)).otherwise(F.col("answer")).alias("answer"),
        F.when(unasked, F.lit("no prompt")).otherwise(F.col("error")).alias("error"),
    )


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    schema = "_digest string, answer string, error string, job string, run int"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def gather_answers(answers: DataFrame, keys: Sequence[str] = ("doc_id", "question")) -> DataFrame:
    """One row per question: its answers from all windows, in the order of the document, and how many failed.

    ``answers`` comes from prompts on windows. A row holds one document's answers, not texts.
    """
    place = F.struct("part_no", "window_no", "answer")
    return answers.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(place)), lambda a: a["answer"]).alias("answers"),
        F.count("error").alias("failed"),
    )

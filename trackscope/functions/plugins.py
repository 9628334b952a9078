"""Functions that a user brings: rewards, batch matchers and table functions, and a registry of rewards by name."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import StringType, StructField, StructType

from . import answers

#: name -> function of (completions, solutions) to scores.
REWARDS: dict[str, Callable[[pd.Series, pd.Series], pd.Series]] = {}


def reward(name: str):
    """Registers a reward: a function of two series (completions, solutions) to a series of doubles."""

    def keep(function: Callable[[pd.Series, pd.Series], pd.Series]):
        REWARDS[name] = function
        return function

    return keep


def _plain(text: str | None) -> str | None:
    if text is None:
        return None
    match = re.search(r"<answer>(.*?)</answer>", text, re.S)
    return re.sub(answers.PREFIX_PATTERN, "", (match.group(1) if match else text).strip().lower()).strip(answers.ANSWER_ENDS)


@reward("answer_accuracy")
def answer_accuracy(completions: pd.Series, solutions: pd.Series) -> pd.Series:
    """1 where the normalised answers are equal and not empty, else 0; nulls give 0."""
    return pd.Series([float(bool(a) and a == b) for a, b in zip(map(_plain, completions), map(_plain, solutions))])


def register_rewards(spark: SparkSession) -> None:
    """Makes every registered reward an SQL function of its name, in Arrow batches."""
    for name, function in REWARDS.items():
        spark.udf.register(name, _vectorized(function))


def _vectorized(function: Callable[[pd.Series, pd.Series], pd.Series]):
    @pandas_udf("double")
    def apply(completions: pd.Series, solutions: pd.Series) -> pd.Series:
        return function(completions, solutions)

    return apply


def map_batches(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A batch matcher over the rows where they lie."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(each, schema)


def asked(df: DataFrame, prompt: str, answer: str, client: Callable[[list[str]], list[str | None]], retries: int = 3, wait: Callable[[int], None] | None = None) -> DataFrame:
    """``df`` with ``answer``, what a judge or model says to ``prompt``.

    ``client`` takes the prompts of a batch and gives an answer for each; it is called on the executors, where the rows
    lie. A call that raises is tried ``retries`` times, with ``wait(attempt)`` before the next; then its answers are
    null. Null prompts are not sent. Other columns stay.
    """
    names = df.columns

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sent = batch[prompt].notna().to_numpy()
            answers_ = [None] * len(batch)
            for attempt in range(retries if sent.any() else 0):
                try:
                    said = client(batch.loc[sent, prompt].tolist())
                    for place, text in zip(sent.nonzero()[0], said, strict=True):
                        answers_[place] = text
                    break
                except Exception:  # noqa: BLE001 - whatever a client raises is a failed call
                    if wait and attempt + 1 < retries:
                        wait(attempt)
            yield batch[names].assign(**{answer: pd.Series(answers_, index=batch.index, dtype=object)})

    return df.mapInPandas(each, StructType([*df.schema.fields, StructField(answer, StringType())]))


def recorded(df: DataFrame, prompt: str, answer: str, table: DataFrame) -> DataFrame:
    """``df`` with ``answer`` from a table of recorded answers (prompt, answer), the greatest of several; null without one."""
    known = table.where(F.col("prompt").isNotNull()).groupBy(F.col("prompt").alias("_p")).agg(F.max("answer").alias(answer))
    return df.drop(answer).join(known, F.col(prompt) == F.col("_p"), "left").drop("_p")


@udtf(returnType="letter string, species string")
class QuestionOptions:
    """Rows of the options "(A) species" of a question."""

    def eval(self, question: str):
        for letter, species in re.findall(answers.OPTION_LINE, question or ""):
            yield letter.upper(), species.strip()


def register_table_functions(spark: SparkSession) -> None:
    spark.udtf.register("question_options", QuestionOptions)

"""Calls of a language model from tasks: bounded concurrency, retries, failures as rows, counters, and a cache that several runs share.

A provider is a function from a prompt to an answer. ``asked`` calls it for each prompt of a table; ``chat_provider`` makes one for servers with the usual chat
protocol over HTTP. Addresses and models are plain settings; a key is named by the environment variable that holds it on the executors and is read at the call, so it is in no plan,
no closure and no event log.

Defined cases: null prompts are skipped, equal prompts are asked once; a provider that fails ATTEMPTS times gives a row with a null answer and the error; a null answer of a
provider counts as a failure; an empty table makes no call.
"""

from __future__ import annotations

import json
import os
import random
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sawmill.plans.tables import saved

#: Calls of one prompt, at most, and the bounds of the random waits between them, in seconds.
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 6, 1.0, 60.0
#: Calls that a task has open at once, and prompts of a task: what a lost executor asks again.
CONCURRENCY, PER_TASK = 8, 256
ANSWERS = "prompt string, answer string, error string, attempts int, seconds double"
#: Names of settings in the session: the server's address, the model and the variable that holds the key.
URL, MODEL, KEY_VARIABLE = "sawmill.model.url", "sawmill.model.name", "sawmill.model.key-variable"


def chat_provider(url: str, model: str, key_variable: str | None = None, timeout: float = 60.0) -> Callable[[str], str]:
    """A provider that posts a prompt as one system message, at temperature 0, and takes the first choice's text."""

    def ask(prompt: str) -> str:
        headers = {"Content-Type": "application/json"}
        if key_variable is not None:
            headers["Authorization"] = f"Bearer {os.environ[key_variable]}"
        body = {"model": model, "temperature": 0, "messages": [{"role": "system", "content": prompt}]}
        request = urllib.request.Request(url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=timeout) as found:
            return json.load(found)["choices"][0]["message"]["content"]

    return ask


def configured_provider(spark: SparkSession) -> Callable[[str], str] | None:
    """The provider that the session's settings name; None without an address, which means that texts are their own templates."""
    url = spark.conf.get(URL, None)
    return chat_provider(url, spark.conf.get(MODEL, ""), spark.conf.get(KEY_VARIABLE, None)) if url else None


def _tried(provider: Callable[[str], str], prompt: str, attempts: int, first: float, longest: float) -> tuple:
    """(prompt, answer, error, attempts, seconds): waits between calls are random, up to a bound that doubles."""
    began, error = time.monotonic(), None
    for k in range(attempts):
        if k:
            time.sleep(random.uniform(0, min(longest, first * 2 ** (k - 1))))
        try:
            if (answer := provider(prompt)) is None:
                raise ValueError("no answer")
            return prompt, answer, None, k + 1, time.monotonic() - began
        except Exception as e:  # a provider may fail in any way; what it says is the row's error
            error = f"{type(e).__name__}: {e}"
    return prompt, None, error, attempts, time.monotonic() - began


def asked(prompts: DataFrame, provider: Callable[[str], str], attempts: int = ATTEMPTS, first_wait: float = FIRST_WAIT, longest_wait: float = LONGEST_WAIT, concurrency: int = CONCURRENCY, per_task: int = PER_TASK) -> tuple[DataFrame, dict]:
    """(ANSWERS for each distinct prompt of prompts(prompt), counters of this run).

    Answers are a table in the shared folder before anything reads them, so that losing an executor later repeats no call; while they are made, a lost task repeats its own prompts only, of which there are
    about ``per_task``. counters: prompts, answered, failed, attempts, seconds (of all calls together) and characters (of prompts and answers).
    """
    distinct = saved(prompts.select(F.col("prompt").cast("string").alias("prompt")).where("prompt is not null").distinct(), "prompts")
    counters = Observation()

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for part in parts:
                rows = pool.map(lambda p: _tried(provider, p, attempts, first_wait, longest_wait), part["prompt"])
                yield pd.DataFrame(list(rows), columns=["prompt", "answer", "error", "attempts", "seconds"])

    tasks = max(1, -(-distinct.count() // per_task))
    found = distinct.repartition(tasks, "prompt").mapInPandas(ask, ANSWERS)
    long = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    size = F.length("prompt") + F.coalesce(F.length("answer"), F.lit(0))
    found = found.observe(counters, F.count("*").alias("prompts"), F.count("answer").alias("answered"), F.count("error").alias("failed"), long("attempts").alias("attempts"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), long(size).alias("characters"))
    return saved(found, "answers"), counters.get


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(prompt, answer) of a cache that runs append to; of several answers to one prompt that of the run with the smallest name. Without a folder it is empty."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder) or not any(s.getPath().getName().startswith("run=") for s in files.listStatus(folder)):
        return spark.createDataFrame([], "prompt string, answer string")
    rows = spark.read.schema("prompt string, answer string, run string").parquet(path)
    return rows.groupBy("prompt").agg(F.min_by("answer", "run").alias("answer"))


def append_cache(answers: DataFrame, path: str) -> None:
    """Adds answers(prompt, answer) to a cache; null answers are left out.

    A run writes a hidden folder of its own and publishes it by one rename, so that runs at the same time lose nothing and nobody reads half of a run.
    """
    spark, run = answers.sparkSession, uuid.uuid4().hex
    answers.where("answer is not null").select("prompt", "answer").write.parquet(f"{path}/.new-{run}")
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}") for name in (f".new-{run}", f"run={run}"))
    if not old.getFileSystem(spark._jsc.hadoopConfiguration()).rename(old, new):
        raise OSError(f"{new} could not be published")

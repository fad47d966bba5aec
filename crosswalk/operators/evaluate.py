"""Evaluating candidates by an external judge: one that replays stored answers, one of rules, or any function of a row."""

from __future__ import annotations

import json
import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosswalk.functions.values import UNDECIDED
from crosswalk.sinks.tables import put

RESULT = "key string, target string, rationale string, status string, error string, attempts int"


class Evaluator(Protocol):
    def __call__(self, source: str, candidates: list[str]) -> tuple[str | None, str]:
        """The chosen candidate, or none, and why."""


def first_candidate(source: str, candidates: list[str]) -> tuple[str | None, str]:
    """A rule for tests: the best-ranked candidate."""
    return (candidates[0], "the best-ranked candidate by similarity") if candidates else (None, "no candidate was offered at all")


def evaluate(rows: DataFrame, judge: Callable[[str, list[str]], tuple[str | None, str]], at_once: int = 16, retries: int = 1) -> DataFrame:
    """Judges rows (key, source, candidates) in ``at_once`` tasks; a row that fails more than ``retries`` times is a failed row, not a failed job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, source, candidates in zip(pdf["key"], pdf["source"], pdf["candidates"], strict=True):
                for attempt in range(1, retries + 2):
                    try:
                        target, why = judge(source, list(candidates) if candidates is not None else [])
                        out.append((key, target, why, "evaluated", None, attempt))
                        break
                    except Exception as e:  # noqa: BLE001 - whatever a judge raises is its answer
                        if attempt > retries:
                            out.append((key, None, None, "failed", str(e), attempt))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in RESULT.split(", ")])

    return rows.select("key", "source", "candidates").repartition(at_once).mapInPandas(run, RESULT)


def well_formed(answer, candidates: list[str], least: int = 20) -> str | None:
    """What is wrong with an answer, which must be an object with a target that was offered (or none, or undecided) and a reason of ``least`` characters; None if nothing is."""
    if not isinstance(answer, dict) or set(answer) - {"target", "rationale"} or "target" not in answer:
        return "not an object of target and rationale"
    if answer["target"] not in (None, UNDECIDED, *candidates):
        return f"target {answer['target']!r} was not offered"
    return None if isinstance(answer.get("rationale"), str) and len(answer["rationale"]) >= least else "rationale is too short"


class Calls:
    """Judges asked side by side: at most ``in_flight`` at once, each for ``limit`` seconds; a call beyond that is given up and its place is free again."""

    def __init__(self, judges: dict[str, Callable], check: Callable = well_formed, in_flight: int = 8, limit: float = 120.0, retries: int = 1):
        self.judges, self.check, self.in_flight, self.limit, self.retries = judges, check, in_flight, limit, retries

    def ask(self, row: tuple, attempt: int, done: queue.Queue) -> tuple:
        token, (key, kind, source, candidates) = object(), row

        def call() -> None:
            try:
                if kind not in self.judges:
                    raise ValueError(f"no judge of {kind}")
                answer = self.judges[kind](source, candidates)
                wrong = self.check(answer, candidates)
                done.put((token, answer, f"malformed: {wrong}" if wrong else None))
            except Exception as e:  # noqa: BLE001 - whatever a judge raises is its answer
                done.put((token, None, str(e) or type(e).__name__))

        # a thread that a session needn't wait for
        threading.Thread(target=call, daemon=True).start()
        return token, row, attempt, time.monotonic() + self.limit

    def __call__(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        """Results in the form of RESULT, each as soon as it is there."""
        done: queue.Queue = queue.Queue()
        running: dict[object, tuple] = {}
        waiting: list[tuple[tuple, int]] = []
        more = True
        while True:
            while len(running) < self.in_flight and (waiting or more):
                if not waiting:
                    row = next(rows, None)
                    more = row is not None
                    if not more:
                        break
                    waiting.append((row, 1))
                token, *rest = self.ask(*waiting.pop(), done)
                running[token] = tuple(rest)
            if not running:
                return
            soonest = min(end for _, _, end in running.values())
            try:
                token, answer, error = done.get(timeout=max(0.0, soonest - time.monotonic()))
                ended = [(token, answer, error)] if token in running else []  # an answer that comes too late
            except queue.Empty:
                now = time.monotonic()
                ended = [(t, None, f"no answer within {self.limit:g} s") for t, (_, _, end) in running.items() if end <= now]
            for token, answer, error in ended:
                row, attempt, _ = running.pop(token)
                if error is None:
                    yield row[0], answer["target"], answer["rationale"], "evaluated", None, attempt
                elif attempt <= self.retries:
                    waiting.append((row, attempt + 1))
                else:
                    yield row[0], None, None, "failed", error, attempt


def evaluate_all(rows: DataFrame, judges: dict[str, Callable[[str, list[str]], dict]], path: str, at_once: int = 16, in_flight: int = 8, limit: float = 120.0, retries: int = 1, keep: int = 20, check: Callable = well_formed) -> DataFrame:
    """Judges rows (key, kind, source, candidates) by the judge of their kind, and keeps answers in the folder ``path`` as they come, ``keep`` to a file.

    A row that has an evaluated answer there is not asked again, so a run that was killed goes on where its last files end; failed rows are asked again. ``at_once``
    tasks have ``in_flight`` calls each. Returns all rows' answers in the form of RESULT, the evaluated one of a key before failed ones. Keys must be distinct.
    """
    spark = rows.sparkSession
    names = [x.split()[0] for x in RESULT.split(", ")]
    known = answers(spark, path)
    asked = rows.select("key", "kind", "source", "candidates")
    if known is not None:
        asked = asked.join(known.where("status = 'evaluated'").select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given = ((k, kind, s, list(c) if c is not None else []) for pdf in batches for k, kind, s, c in zip(pdf["key"], pdf["kind"], pdf["source"], pdf["candidates"], strict=True))
        part: list[tuple] = []
        for result in Calls(judges, check, in_flight, limit, retries)(given):
            part.append(result)
            if len(part) == keep:
                yield _kept(path, part, names)
                part = []
        if part:
            yield _kept(path, part, names)

    asked.repartition(at_once).mapInPandas(run, "n long").agg(F.sum("n")).collect()
    got = answers(spark, path)
    if got is None:
        return spark.createDataFrame([], RESULT)
    best = Window.partitionBy("key").orderBy((F.col("status") == "evaluated").desc(), F.desc("attempts"), "target", "rationale")
    return got.join(rows.select("key"), "key", "left_semi").withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def _kept(path: str, part: list[tuple], names: list[str]) -> pd.DataFrame:
    put(f"{path.rstrip('/')}/answers-{uuid.uuid4().hex}.json", "".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in part).encode())
    return pd.DataFrame({"n": [len(part)]})


def answers(spark: SparkSession, path: str) -> DataFrame | None:
    """The answers that :func:`evaluate_all` has kept in a folder; None without the folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(RESULT).json(f"{path.rstrip('/')}/answers-*.json") if _any(spark, path) else None


def _any(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/answers-*.json")
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at))


def replay(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored answers (key, target, rationale) of rows; those without one are pending."""
    got = rows.select("key").join(stored, "key", "left")
    return got.select("key", "target", "rationale", F.when(F.col("rationale").isNull(), "pending").otherwise("evaluated").alias("status"))


def prompt(kind: str, source: str, definition: str, candidates: list[tuple[str, str]]) -> str:
    """A judge's question about one class or property."""
    lines = [f"Choose the target {kind} that means the same as {source}.", f"Definition: {definition or 'none'}", "Candidates:"]
    lines += [f"- {ident}: {text or 'no definition'}" for ident, text in candidates]
    return "\n".join([*lines, "Answer with one of these names, or none, and a reason of 20 characters or more."])


def progress(rows: DataFrame) -> DataFrame:
    """Rows by status and their share in percent."""
    n = rows.groupBy("status").agg(F.count("*").alias("n"))
    return n.join(n.agg(F.sum("n").alias("total"))).select("status", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("percent"))

"""Labelling by a model that is plugged in: rows go to it in Arrow batches, calls that fail are tried again, and what came
of each row is a status, so that successes, failures and inconsistencies are written from one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A model gets a row's text and the number of the attempt, and gives its output or raises.
Model = Callable[[str, int], str]


def labelled_by(df: DataFrame, model: Model, text_col: str, id_col: str = "job_id", attempts: int = 3) -> DataFrame:
    """id, output, error and attempts for every row: the first attempt that succeeds, else the last error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for text in b.column(1).to_pylist():
                said, error, k = None, None, 0
                while said is None and k < attempts:
                    k += 1
                    try:
                        said, error = model(text or "", k), None
                    except ImportError:
                        raise
                    except Exception as e:  # whatever else a model raises is its failure, and goes into the row
                        error = f"{type(e).__name__}: {e}"
                out.append((said, error, k))
            said, errors, tries = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, pa.string()), pa.array(errors, pa.string()), pa.array(tries, pa.int32())], names=[id_col, "output", "error", "attempts"])

    rows = df.select(id_col, text_col)
    return rows.mapInArrow(run, f"{id_col} {rows.schema[0].dataType.simpleString()}, output string, error string, attempts int")


def outcomes(done: DataFrame, consistent) -> DataFrame:
    """done with status: failure without an output, inconsistency where consistent (a condition) doesn't hold, else success."""
    return done.withColumn("status", F.when(F.col("output").isNull(), "failure").when(~F.coalesce(consistent, F.lit(False)), "inconsistency").otherwise("success"))


def checked(done: DataFrame, most_failures: int) -> DataFrame:
    """done, or an error if more rows than that have no output. Counts, so done is best a written table."""
    failed = done.where("output is null").count()
    if failed > most_failures:
        raise RuntimeError(f"{failed} rows failed, more than {most_failures}")
    return done


def scored_by(df: DataFrame, scorers: dict[str, Callable]) -> DataFrame:
    """df with a column for each named scorer, a function of a row's columns (by name) to a Column."""
    return df.select("*", *[f({c: F.col(c) for c in df.columns}).alias(k) for k, f in scorers.items()])

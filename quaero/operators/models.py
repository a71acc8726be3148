"""The contract for user models (H1-H9): a factory per partition, batches in, rows out."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from quaero.sources.workdir import staged

# Called once per partition; returns a function from a batch to the batch's output columns,
# in the same row order.
ModelFactory = Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]


def apply_model(df: DataFrame, model: ModelFactory, output: str, attempts: int = 2,
                pause: float = 0.0) -> DataFrame:
    """Add the model's output columns and ``error``.

    If a batch fails, it is halved until the rows at fault are alone; each of these is tried up
    to ``attempts`` times with ``pause`` seconds in between (S12).  A row that still fails keeps
    its input, has NULL outputs and the message in ``error``; the job goes on.  A model with an
    attribute ``reads`` is sent these columns only; all others stay in the JVM.
    """
    added = T.StructType.fromDDL(output)
    names = added.names
    base = [c for c in df.columns if c not in [*names, "error"]]
    reads = list(getattr(model, "reads", base))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = model()

        def checked(part: pd.DataFrame) -> list[dict]:
            out = call(part)[names]
            if len(out) != len(part):
                raise ValueError(f"model returned {len(out)} rows for {len(part)}")
            return [{**r, "error": None} for r in out.to_dict("records")]

        def single(row: pd.DataFrame) -> list[dict]:
            failure = None
            for n in range(attempts):
                if n:
                    time.sleep(pause)
                try:
                    return checked(row)
                except Exception as e:  # noqa: BLE001 - any failure becomes a dead letter
                    failure = f"{type(e).__name__}: {e}"
            return [{**dict.fromkeys(names), "error": failure}]

        def halved(part: pd.DataFrame) -> list[dict]:
            if len(part) <= 1:
                return single(part) if len(part) else []
            try:
                return checked(part)
            except Exception:  # noqa: BLE001
                middle = len(part) // 2
                return [r for half in (part[:middle], part[middle:])
                        for r in halved(half.reset_index(drop=True))]

        for batch in batches:
            rows = halved(batch[reads].reset_index(drop=True))
            yield pd.DataFrame(rows, columns=[*names, "error"], dtype=object)

    # Not deterministic, so that Spark neither repeats a call nor moves a filter below it.
    schema = T.StructType([*added, T.StructField("error", T.StringType())])
    called = F.pandas_udf(run, schema).asNondeterministic()
    kept = [F.col(f"`{c}`") for c in base]
    return df.select(*kept, called(F.struct(*[F.col(f"`{c}`") for c in reads])).alias("_model")).select(
        *kept, "_model.*")


def noted(df: DataFrame, step: str, failures: list[DataFrame] | None) -> DataFrame:
    """``df`` without its ``error`` column; with ``failures``, its dead letters are added to these.

    Dead letters are ``query_id, step, error``.  The frame is written first, so that no model call
    is repeated for them.
    """
    if failures is None:
        return df.drop("error")
    done = staged(df, step)
    failures.append(done.where("error is not null").select("query_id", F.lit(step).alias("step"), "error"))
    return done.drop("error")


def split_failures(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that worked, dead letters) of a frame with an ``error`` column.

    Written first, so that each row is sent to the model once and lands on one side only.
    """
    done = staged(df, "modelled")
    return done.where("error is null").drop("error"), done.where("error is not null")

"""A time limit for the work on one document."""

from __future__ import annotations

import signal
import threading
import warnings
from collections.abc import Callable
from typing import TypeVar

from pyspark import Accumulator, AccumulatorParam
from pyspark.sql import SparkSession

R = TypeVar("R")


class TookTooLong(Exception):
    pass


def _ring(*_: object) -> None:
    raise TookTooLong


class DocumentFailed(Exception):
    pass


class _Causes(AccumulatorParam):
    """Causes by document; those of a task that runs again are the same."""

    def zero(self, value: dict[str, str]) -> dict[str, str]:
        return {}

    def addInPlace(self, value1: dict[str, str], value2: dict[str, str]) -> dict[str, str]:  # noqa: N802
        return value1 | value2


def failures(spark: SparkSession) -> Accumulator:
    """Where the documents that fail are entered, with the cause of each."""
    return spark.sparkContext.accumulator({}, _Causes())


def timed(work: Callable[[], R], seconds: float) -> R:
    """The result of `work`; an error if it takes too long. Only a main thread can hold the time."""
    held = threading.current_thread() is threading.main_thread()
    try:
        if held:
            before = signal.signal(signal.SIGALRM, _ring)
            signal.setitimer(signal.ITIMER_REAL, seconds)
        return work()
    finally:
        if held:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)


def guarded(work: Callable[[], R], seconds: float) -> R | None:
    """The result of `work`, or None with a warning if it fails or takes too long."""
    try:
        return timed(work, seconds)
    except Exception as error:  # noqa: BLE001  one document must not end the batch
        warnings.warn(f"a document was left empty: {error!r}", stacklevel=2)
        return None


def answered(document: str, work: Callable[[], list], seconds: float, failed: Accumulator | None = None) -> list:
    """The rows of a document. If it fails or takes too long, that is an error that names it, or else entered in `failed`."""
    try:
        return timed(work, seconds)
    except Exception as error:  # noqa: BLE001  any failure
        if failed is None:
            raise DocumentFailed(f"document {document!r}: {error!r}") from error
        failed.add({document: repr(error)})
        return []

"""The library's functions under names for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from .workers import reachable

_SPAN = "inicio int, fim int, trecho string, familia string"


class DetectCitations:
    """Table function: the citations of a text, one row each."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        from citaforge.operators.detect import detect

        for s in detect(text or ""):
            yield s.start, s.end, text[s.start : s.end], s.family


def register(spark: SparkSession) -> None:
    """`detect_citations(text)` as a table function; `identifier_digits`, `class_marks`, `court_acronym`, `diploma_code` and `article_key` as scalar ones."""
    from pyspark.sql import functions as F

    from ..operators import keys
    from . import strings

    reachable(spark)
    spark.udtf.register("detect_citations", F.udtf(DetectCitations, returnType=_SPAN))
    scalars = {"identifier_digits": strings.identifier_digits, "court_acronym": keys.court_acronym, "diploma_code": lambda t: keys.diploma_code(t)[0], "article_key": keys.cited_article}
    for name, f in scalars.items():
        spark.udf.register(name, F.udf(lambda t, f=f: None if t is None else f(t), T.StringType(), useArrow=True))
    spark.udf.register("class_marks", F.udf(lambda t: None if t is None else strings.class_marks(t), T.ArrayType(T.StringType()), useArrow=True))

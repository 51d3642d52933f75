"""A set of named tables, and user SQL over them."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from ..errors import ParamsError, QueryError
from ..plans.sqltext import KEYS, parameters, with_keys


_ONE_AT_A_TIME = threading.RLock()


@contextmanager
def _views(spark: SparkSession, frames: Mapping[str, DataFrame]) -> Iterator[None]:
    """Frames as views while a text is analysed (which binds them): one text at a time, and a session's own views come back."""
    with _ONE_AT_A_TIME:
        catalog = spark._jsparkSession.sessionState().catalog()
        own = {name: spark.table(name) for name in frames if catalog.getTempView(name).isDefined()}
        try:
            for name, frame in frames.items():
                frame.createOrReplaceTempView(name)
            yield
        finally:
            for name in frames:
                if name in own:
                    own[name].createOrReplaceTempView(name)
                else:
                    spark.catalog.dropTempView(name)


class Tables:
    """Tables by name: frames, functions that make frames, or a folder of Parquet files."""

    #: What manifests and snapshots call this backend.
    BACKEND = "Spark"

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame | Callable[[], DataFrame]] | str):
        self.spark = spark
        self.folder = tables if isinstance(tables, str) else None
        self.made: dict[str, DataFrame | Callable[[], DataFrame]] = {} if isinstance(tables, str) else dict(tables)
        self.absent: set[str] = set()

    def with_tables(self, **more: DataFrame) -> Tables:
        out = Tables(self.spark, self.made)
        out.folder = self.folder
        out.made |= more
        return out

    def names(self) -> list[str]:
        return sorted(self.made)

    def table(self, name: str) -> DataFrame:
        found = self.made.get(name)
        if found is None:
            if self.folder is not None:
                found = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                try:
                    return self.spark.table(name)
                except AnalysisException as e:
                    raise QueryError(message=f"no table {name}") from e
        if not isinstance(found, DataFrame):
            found = found()
        self.made[name] = found
        return found

    def sql(self, text: str, params: Mapping[str, Any] | None = None, keys: DataFrame | None = None, view: str = "", path: str = "$root") -> DataFrame:
        """The rows of user SQL. Tables that it names are views while it is analysed, in any number of threads; ``:keys`` is a relation of keys.

        Each ``:name`` needs a value, and each value a ``:name``.
        """
        names, takes = parameters(text)
        bound = dict(params or {})
        if missing := [n for n in names if n not in bound]:
            raise ParamsError(view, path, f"no value for :{', :'.join(missing)}")
        if extra := [n for n in bound if n not in names]:
            raise ParamsError(view, path, f"no parameter :{', :'.join(extra)}")
        if takes and keys is None:
            raise ParamsError(view, path, "the text takes keys, and there are none")
        relation = f"{KEYS}_{uuid.uuid4().hex}"
        if takes:
            text = with_keys(text, relation)
        frames = {relation: keys} if takes else {}
        for word in set(re.findall(r"[A-Za-z_]\w*", text)):
            if word in self.made or (self.folder is not None and self._exists(word)):
                frames[word] = self.table(word)
        try:
            with _views(self.spark, frames):
                return self.spark.sql(text, args=bound) if bound else self.spark.sql(text)
        except (AnalysisException, ParseException) as e:
            raise QueryError(view, path, f"{e}\n  sql: {text}") from e

    def _exists(self, name: str) -> bool:
        if name in self.absent:
            return False
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.parquet")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        if not found:
            self.absent.add(name)
        return found

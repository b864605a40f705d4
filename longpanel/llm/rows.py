"""Numbers that tell the rows of a table apart, the same in every job that reads it.

``monotonically_increasing_id`` counts within the splits of a scan, which Spark sizes by the cores alive when a job is
planned: two jobs may number the rows of the same files differently. Here a row is its file and its place in that file.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stage

#: Bits of the place in a file.
PLACE_BITS = 40
#: Plans whose every row is one row of one file.
_ROWWISE = ("Project", "Filter", "SubqueryAlias")


def _one_scan(docs: DataFrame) -> bool:
    plan = docs._jdf.queryExecution().analyzed()
    while plan.children().size() == 1:
        if plan.getClass().getSimpleName() not in _ROWWISE:
            return False
        plan = plan.children().head()
    return plan.getClass().getSimpleName() == "LogicalRelation"


def with_row(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number in ``name`` that no other row has, whatever the splits of the files are.

    Taken from the file and the place in it where ``docs`` is a scan of Parquet files, else ``docs`` is numbered once and
    written with its numbers.
    """
    if _one_scan(docs):
        path, place, file = (f"{x}_{uuid.uuid4().hex}" for x in ("path", "place", "file"))
        try:
            meta = docs.metadataColumn("_metadata")
            placed = docs.select("*", meta["file_path"].alias(path), meta["row_index"].alias(place))
        except AnalysisException:  # a format without places
            placed = None
        if placed is not None:
            paths = sorted(r[path] for r in placed.select(path).distinct().collect())
            files = docs.sparkSession.createDataFrame(list(enumerate(paths)), f"{file} long, {path} string")
            row = F.shiftleft(file, PLACE_BITS) + F.col(place)
            return placed.join(F.broadcast(files), path).select(*docs.columns, row.alias(name))
    return stage(docs.withColumn(name, F.monotonically_increasing_id()), "rows")

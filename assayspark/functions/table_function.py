"""A table function for SQL: the rows of a table of each document.

    spark.udtf.register("assay_rows", AssayRows)
    SELECT * FROM assay_rows(TABLE(documents), 'cells')

The table has columns file_id and text; further ones are ignored. Documents are read one at a time, so that PARTITION BY
is not needed: it would shuffle and sort the texts. Beside the tables there are 'values', the cells that are not empty, each with its row's metabolite.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, Row, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from assayspark.functions.one_document import READ, rows_of
from assayspark.model import PAIRS


_PAIRS = ArrayType(StructType([StructField("key", StringType()), StructField("value", StringType()), StructField("dup", IntegerType())]))
_TYPES = {"string": StringType(), "int": IntegerType(), "boolean": BooleanType(), PAIRS: _PAIRS}


def _schema(ddl: str) -> StructType:
    """The schema of file_id and the DDL's columns; analyze() runs where no session could read DDL."""
    fields = [f.split(" ", 1) for f in re.split(r", (?![^<]*>)", f"file_id string, {ddl}")]
    return StructType([StructField(name, _TYPES[kind]) for name, kind in fields])


@udtf
class AssayRows:
    @staticmethod
    def analyze(documents: AnalyzeArgument, table: AnalyzeArgument) -> AnalyzeResult:
        if not documents.isTable or not {"file_id", "text"} <= set(documents.dataType.fieldNames()):
            raise ValueError("the first argument must be a table with file_id and text")
        if table.value not in READ:
            raise ValueError(f"{table.value} is none of {', '.join(READ)}")
        return AnalyzeResult(_schema(READ[table.value]))

    def eval(self, document: Row, table: str) -> Iterator[tuple]:
        """A document without text, or that can't be read, has no rows."""
        try:
            rows = list(rows_of(document["text"] or "", table))
        except (ValueError, TypeError, KeyError, AttributeError):
            return
        for row in rows:
            yield (document["file_id"], *row)

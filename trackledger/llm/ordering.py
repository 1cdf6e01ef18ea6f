"""Parts of a table in the order of a column, without a sort in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Parts:
    """Ranges of a column with about equal numbers of rows: whole numbers, or texts in the order of their bytes.

    Texts go by seven bytes after what all of them begin with; those that agree in these are
    in one part.  Part 0 holds the nulls, and the parts after it ascend.  As many parts as the session has
    shuffle partitions are made, so what the driver keeps does not follow the rows.
    """

    def __init__(self, rows: DataFrame, column: str):
        spark = rows.sparkSession
        self.is_text = rows.schema[column].dataType.simpleString() == "string"
        self.skipped = 0
        if self.is_text:
            least, most = rows.agg(F.min(column), F.max(column)).first()
            pairs = zip((least or "").encode(), (most or "").encode(), strict=False)
            self.skipped = next((k for k, (a, b) in enumerate(pairs) if a != b), min(len((least or "").encode()), len((most or "").encode())))
        self.count = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        shares = [k / self.count for k in range(1, self.count)]
        found = rows.agg(F.percentile_approx(self.number(F.col(column)), shares, 10_000)).first()[0] if shares else None
        self.splits = np.unique(np.array(found or [], dtype=np.int64))
        self.held = spark.sparkContext.broadcast(self.splits)

    def number(self, value: Column) -> Column:
        """A whole number that never falls as the value rises."""
        if not self.is_text:
            return value.cast("long")
        raw = F.hex(F.substring(value.cast("binary"), self.skipped + 1, 7))
        return F.conv(F.rpad(raw, 14, "0"), 16, 10).cast("long")

    def column(self, value: Column) -> Column:
        """The part of each value."""
        held = self.held

        def part(values: pa.Array) -> pa.Array:
            null = values.is_null().to_numpy(zero_copy_only=False)
            at = np.searchsorted(held.value, values.fill_null(0).to_numpy(zero_copy_only=False), side="left") + 1
            return pa.array(np.where(null, 0, at).astype(np.int32))

        return F.arrow_udf(part, "int")(self.number(value))

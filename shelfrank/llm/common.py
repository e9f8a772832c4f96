"""Helpers shared by the corpus operators.

Conventions of every operator here:

* a null text is an empty text; a null id is kept as null;
* repeated rows give repeated results, one output row per input row, unless
  the operator's docstring says otherwise;
* an empty input gives an empty result with the same schema;
* only the named id and text columns are read; with ``carry=True`` the result
  also has the ``text`` as it was (a null stays null) and ``doc``, a struct of
  all other columns, where no name can clash with one of the operator's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a task handles at once. Rows are never cut: a longer
#: text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Rows in an Arrow batch, unless the session sets its own number.
BATCH_ROWS = 1_000


def text_of(col: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def small_batches(spark: SparkSession) -> None:
    """Texts are long rows: where the session has not chosen otherwise, Arrow
    batches get ``BATCH_ROWS`` rows instead of Spark's default of 10,000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def utf8_input(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """``id``, ``utf8`` (text as bytes, may be null) and, when asked for,
    ``doc`` (all other input columns)."""
    small_batches(docs.sparkSession)
    cols = [F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("utf8")]
    if carry:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("doc"))
    return docs.select(*cols)


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    """The texts of a batch; null is the empty text."""
    return [t.as_py() or b"" for t in batch.column(batch.schema.get_field_index("utf8"))]


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` text bytes each, so that the
    working memory follows the slice and the longest text, not the batch."""
    texts = batch.column(batch.schema.get_field_index("utf8"))
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        n = n or 0
        if i > start and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def out_batch(batch: pa.RecordBatch, carry: bool, **cols) -> pa.RecordBatch:
    """``id`` of the input batch, the given columns, and ``text`` and ``doc`` when
    carried."""
    arrays, names = [batch.column(0)], ["id"]
    for name, values in cols.items():
        arrays.append(values)
        names.append(name)
    if carry:
        arrays += [batch.column(batch.schema.get_field_index("utf8")).cast(pa.string()),
                   batch.column(batch.schema.get_field_index("doc"))]
        names += ["text", "doc"]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def id_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def schema_of(ddl: str, source: DataFrame, text: bool = True) -> StructType:
    """The schema of ``ddl``, and of ``text`` and ``doc`` if ``source`` carries
    them (as types, since DDL text loses which nested fields are never null)."""
    out = StructType.fromDDL(ddl)
    if "doc" in source.columns:
        out = (out.add("text", "string") if text else out).add("doc", source.schema["doc"].dataType)
    return out

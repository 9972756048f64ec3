"""Computing columns from whole texts, batch by batch, beside carried columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType, _parse_datatype_string

from frostline.llm import common


def with_texts(
    docs: DataFrame,
    keep: Sequence[str],
    added: str,
    compute: Callable[[], Callable[[pa.Array], list]],
    text: str = "text",
) -> DataFrame:
    """docs' columns `keep` and those of the schema `added`. `compute()` is called
    once per task and gives a function from a block of texts to one list or array
    per added column. Kept columns ride in one struct, so their names cannot
    clash with anything; a kept column that an added one replaces goes."""
    common.bounded_batches(docs.sparkSession)
    new: StructType = _parse_datatype_string(added)
    keep = [x for x in keep if x not in new.names]
    kept = StructType([docs.schema[x] for x in keep])
    schema = StructType([StructField("kept", kept), *new.fields]) if keep else new
    types = [to_arrow_type(f.dataType) for f in new.fields]
    column = F.col(f"`{text}`").cast("string").alias("text")
    packed = docs.select(*([F.struct(*(F.col(f"`{x}`") for x in keep)).alias("kept")] if keep else []), column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = compute()
        for batch in batches:
            for block in common.text_blocks(batch):
                found = [
                    x if isinstance(x, pa.Array) else pa.array(x, t)
                    for x, t in zip(function(block.column("text")), types, strict=True)
                ]
                own = [block.column("kept")] if keep else []
                yield pa.RecordBatch.from_arrays([*own, *found], names=schema.names)

    out = packed.mapInArrow(run, schema)
    return out.select(*([F.col("kept.*")] if keep else []), *new.names)


def partial_rows(docs: DataFrame, columns: Sequence[str], schema: str | DataType, run: Callable) -> DataFrame:
    """What `run` makes of the Arrow batches of some columns."""
    common.bounded_batches(docs.sparkSession)
    return docs.select(*columns).mapInArrow(run, schema)

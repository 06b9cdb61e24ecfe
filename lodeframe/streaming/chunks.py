"""Compressed streams whose chunks are rows: of each key they are taken in order, one at a time, and state never leaves the task.

A stream's chunks stream through in order; what is held is one key's compressor or decompressor, not its data.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def _ordered(rows: DataFrame, by: str, order: str, data: str) -> tuple[DataFrame, str]:
    kinds = {n: rows.schema[n].dataType.simpleString() for n in (by, order)}
    streams = rows.select(by, order, data).repartition(by).sortWithinPartitions(by, order)
    return streams, f"{by} {kinds[by]}, {order} {kinds[order]}, {data} binary"


def deflate_chunks(rows: DataFrame, by: str, order: str, data: str, level: int = 6) -> DataFrame:
    """``(by, order, data)``: each chunk's share of its key's zlib stream, flushed so that what came before can be read at once; a last
    row with a null ``order`` finishes the stream. Null chunks are empty."""
    streams, schema = _ordered(rows, by, order, data)
    kinds = [rows.schema[by].dataType, rows.schema[order].dataType]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [*(to_arrow_type(k) for k in kinds), pa.binary()]
        key, packer = None, None

        def table(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], [by, order, data])

        for batch in source:
            out = []
            for k, place, chunk in zip(*(batch.column(n).to_pylist() for n in (by, order, data)), strict=True):
                if packer is None or k != key:
                    if packer is not None:
                        out.append((key, None, packer.flush()))
                    key, packer = k, zlib.compressobj(level)
                out.append((k, place, packer.compress(chunk or b"") + packer.flush(zlib.Z_SYNC_FLUSH)))
            yield table(out)
        if packer is not None:
            yield table([(key, None, packer.flush())])

    return streams.mapInArrow(batches, schema)


def inflate_chunks(rows: DataFrame, by: str, order: str, data: str) -> DataFrame:
    """``(by, order, data)``: what each chunk adds to its key's bytes. A null ``order`` comes last. Bytes behind a stream's end raise,
    and so does a stream that is cut off; its checksum is verified."""
    from pyspark.sql import functions as F

    kinds = {n: rows.schema[n].dataType.simpleString() for n in (by, order)}
    streams = rows.select(by, order, data).repartition(by).sortWithinPartitions(F.col(by), F.col(order).asc_nulls_last())

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reader = None, None
        for batch in source:
            out = []
            for k, chunk in zip(batch.column(by).to_pylist(), batch.column(data).to_pylist(), strict=True):
                if reader is None or k != key:
                    if reader is not None and not reader.eof:
                        raise ValueError(f"the stream of {key!r} is cut off")
                    key, reader = k, zlib.decompressobj()
                if reader.eof and chunk:
                    raise ValueError(f"the stream of {key!r} has ended")
                out.append(reader.decompress(chunk or b""))
                if reader.unused_data:
                    raise ValueError(f"the stream of {key!r} has ended")
            yield pa.RecordBatch.from_arrays([batch.column(by), batch.column(order), pa.array(out, pa.binary())], [by, order, data])
        if reader is not None and not reader.eof:
            raise ValueError(f"the stream of {key!r} is cut off")

    return streams.mapInArrow(batches, f"{by} {kinds[by]}, {order} {kinds[order]}, {data} binary")

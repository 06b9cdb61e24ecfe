"""Per-key state over streams: incremental checksums, a cache of least recently used keys, streamed compression.

State is a few values a key, kept by Structured Streaming; rows of a key in one batch are taken in the order of ``order``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_checksum(stream: DataFrame, key: str, order: str, data: str) -> DataFrame:
    """Per key and batch: ``(key, crc32, adler32, size)`` of all bytes so far."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        crc, adler, size = state.get if state.exists else (0, 1, 0)
        for x in pd.concat(list(batches)).sort_values(order)[data]:
            crc, adler, size = zlib.crc32(bytes(x), crc), zlib.adler32(bytes(x), adler), size + len(x)
        state.update((crc, adler, size))
        yield pd.DataFrame({key: [k[0]], "crc32": [crc], "adler32": [adler], "size": [size]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, crc32 long, adler32 long, size long", "crc32 long, adler32 long, size long", "update", GroupStateTimeout.NoTimeout)


def lru_cache(stream: DataFrame, key: str, order: str, item: str, capacity: int) -> DataFrame:
    """Per row: ``(key, item, hit)`` of a cache of the last ``capacity`` different items of each key."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        items, hits = [], []
        for x in pd.concat(list(batches)).sort_values(order)[item]:
            hits.append(x in held)
            if x in held:
                held.remove(x)
            held = [*held, x][-capacity:]
            items.append(x)
        state.update((held,))
        yield pd.DataFrame({key: [k[0]] * len(items), item: items, "hit": hits})

    names = {n: stream.schema[n].dataType.simpleString() for n in (key, item)}
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {names[key]}, {item} {names[item]}, hit boolean", f"held array<{names[item]}>", "append", GroupStateTimeout.NoTimeout)


def compressed_blocks(stream: DataFrame, key: str, order: str, data: str, block: int = 65_536) -> DataFrame:
    """Per key, each time ``block`` bytes are pending: a raw DEFLATE block of them. Blocks of a key put together, with an empty final
    block behind, are one stream; what is pending waits in the state."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, number = state.get if state.exists else (b"", 0)
        pending = bytes(pending) + b"".join(bytes(x) for x in pd.concat(list(batches)).sort_values(order)[data])
        out = []
        while len(pending) >= block:
            packer = zlib.compressobj(6, zlib.DEFLATED, -15)
            out.append((k[0], number, packer.compress(pending[:block]) + packer.flush(zlib.Z_FULL_FLUSH)))
            pending, number = pending[block:], number + 1
        state.update((pending, number))
        if out:
            yield pd.DataFrame(out, columns=[key, "number", "block"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, number long, block binary", "pending binary, number long", "append", GroupStateTimeout.NoTimeout)


#: A final empty DEFLATE block, which ends a stream of blocks.
FINAL_BLOCK = b"\x03\x00"

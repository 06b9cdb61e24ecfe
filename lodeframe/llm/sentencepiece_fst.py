"""SentencePiece encoding and decoding by weighted finite-state transduction.

Three machines are compiled from a model file: the normaliser, the lexicon (a trie of pieces, each an arc with its weight, and an
arc of byte pieces for every character that no piece has), and, for models of merges (BPE), an acceptor of neighbouring
pieces. Composed with an input, the paths are its segmentations, and the tropical-semiring shortest path is the encoding. In a
unigram model a piece weighs minus its score. In a BPE model a neighbourhood weighs nothing if merging in the model's order would
leave its two pieces as they are, and infinity if not; one finite path remains, and it is the one that merging reaches. No
merge crosses the places where texts are cut into chunks, so each different chunk is composed once and kept in a bounded
cache; a unigram's texts are cut where no piece can cross.

The normaliser is a deterministic transducer: at each place the longest key of the model's character map is replaced by its
output, a character that no key begins with stays, and two states, behind a space or not, say which spaces are left out.

Defined results: a null or empty text has no ids and decodes to the empty text; a text's own meta symbols decode to spaces, as
everywhere in SentencePiece; where the normaliser changes a text it decodes to the normalised one; repeated rows are each
encoded; an empty table gives an empty result; other columns of the input are left out. Models with user-defined pieces, with
the space as a suffix, or that keep spaces unescaped, aren't supported and raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.common import PieceCache, crc, text_buffers

META = "▁"
_INF = float("inf")
_UNKNOWN = -1


class Normaliser:
    """A model's normaliser, compiled. Its character map is a double-array trie over UTF-8 bytes, whose walk is the transducer's:
    a unit holds the label of the byte that leads to it, whether a key ends there, and where its own bytes begin."""

    def __init__(self, spec):
        self.prefix, self.trim = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        blob = spec.precompiled_charsmap
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.outputs = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def _longest(self, data: bytes, at: int) -> tuple[int, int]:
        """How many bytes the longest key from ``at`` on has, 0 if there is none, and where its output stands."""
        node = self._offset(self.units[0])
        best, place = 0, 0
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best, place = i + 1 - at, self.units[node] & 0x7FFFFFFF
        return best, place

    def _mapped(self, text: str) -> list[str]:
        """The outputs of the keys and characters of a text."""
        data, at, out = text.encode("utf-8", "replace"), 0, []
        while at < len(data):
            n, place = self._longest(data, at)
            if n:
                out.append(self.outputs[place : self.outputs.index(b"\0", place)].decode("utf-8", "replace"))
            else:
                n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                out.append(data[at : at + n].decode("utf-8", "replace"))
            at += n
        return out

    def __call__(self, text: str) -> str:
        """The normalised text, with spaces for meta symbols."""
        if self.units:
            parts = self._mapped(text)
        elif self.trim:
            parts = list(text)
        else:
            return (" " if self.prefix else "") + text.replace(META, " ") if text else ""
        if not self.trim:
            body = "".join(parts)
        else:
            out, after_space = [], True
            for part in parts:
                if after_space:
                    part = part.lstrip(" ")
                if part:
                    out.append(part)
                    after_space = part.endswith(" ")
            body = "".join(out).replace(META, " ").rstrip(" ")
            if not body and not "".join(parts).strip(" "):
                return ""
        return (" " if self.prefix else "") + body.replace(META, " ") if parts else ""


class Transducer:
    """The compiled machines of one model."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that keep spaces, or have them as suffixes, aren't supported")
        if any(piece.type == proto.SentencePiece.USER_DEFINED for piece in proto.pieces):
            raise ValueError("models with user-defined pieces aren't supported")
        self.normalise = Normaliser(spec)
        self.prefix = spec.add_dummy_prefix
        self.merges = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        kinds = proto.SentencePiece
        self.ids: dict[str, int] = {}
        self.cost: list[float] = []
        self.texts: list[str] = []
        self.bytes = [0] * 256
        surface = []
        for i, piece in enumerate(proto.pieces):
            self.texts.append(piece.piece)
            self.cost.append(-piece.score)
            if piece.type == kinds.BYTE:
                self.bytes[int(piece.piece[3:5], 16)] = i
                surface.append(bytes([int(piece.piece[3:5], 16)]))
            elif piece.type in (kinds.NORMAL, kinds.UNUSED):
                self.ids[piece.piece] = i
                surface.append(piece.piece.replace(META, " ").encode())
            else:
                surface.append(b"")
        self.byte_cost = max(self.cost) + 10
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_sizes = np.array([len(x) for x in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_sizes) - self.surface_sizes
        # The lexicon: node[character] = [next node, id of the piece that ends here or -1].
        self.root: dict = {}
        for text, i in self.ids.items():
            node = self.root
            for c in text[:-1]:
                node = node.setdefault(c, [{}, -1])[0]
            node.setdefault(text[-1], [{}, -1])[1] = i
        self._spines: dict[int, tuple | None] = {}
        self._allowed: dict[int, bool] = {}
        # A cut before a stop after an ASCII letter is safe if no piece has such a stop behind a letter. Such cuts, and those
        # below, are places that no piece crosses, so neither merges nor unigram paths do.
        self.stops = bytes(ord(c) for c in ".,!?;:" if not any(c in x[1:] and any(a.isascii() and a.isalpha() and b == c for a, b in zip(x, x[1:], strict=False)) for x in self.ids))
        self.line_cut = not any("\n" in x for x in self.ids)
        self.space_cut = not any(META in x.lstrip(META) for x in self.ids)

    def _spine(self, piece: int) -> tuple | None:
        """The symbols along the left and the right edge of a piece as it is merged, each with the time at which it goes into the
        next; None if merging doesn't end in the piece."""
        if piece in self._spines:
            return self._spines[piece]
        text = self.texts[piece]
        # A symbol: (text, time made, left part, right part).
        row = [(c, -_INF, None, None) for c in text]
        while len(row) > 1:
            best, at = _INF, -1
            for k in range(len(row) - 1):
                i = self.ids.get(row[k][0] + row[k + 1][0])
                if i is not None and self.cost[i] < best:
                    best, at = self.cost[i], k
            if at < 0:
                self._spines[piece] = None
                return None
            left, right = row[at], row[at + 1]
            row[at : at + 2] = [(left[0] + right[0], max(best, left[1], right[1]), left, right)]
        edges = []
        for side in (2, 3):
            symbol, until, edge = row[0], _INF, []
            while symbol is not None:
                edge.append((symbol[0], until))
                until, symbol = symbol[1], symbol[side]
            edges.append(edge[::-1])
        self._spines[piece] = (edges[0], edges[1])
        return self._spines[piece]

    def allowed(self, a: int, b: int) -> bool:
        """Whether merging leaves the pieces a and b, side by side, as they are."""
        key = a * 1_000_003 + b
        found = self._allowed.get(key)
        if found is None:
            found = self._allowed[key] = self._meet(a, b)
        return found

    def _meet(self, a: int, b: int) -> bool:
        left, right = self._spine(a), self._spine(b)
        if left is None or right is None:
            return False
        left, right, i, j = left[1], right[0], 0, 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            across = self.ids.get(x + y)
            # Of equal merges the leftmost goes first: within a, then across, then within b.
            if across is not None and self.cost[across] < x_until and self.cost[across] <= y_until:
                return False
            if x_until == y_until == _INF:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def shortest(self, text: str) -> list[int]:
        """The ids of the shortest path over a normalised text."""
        n = len(text)
        dist = [_INF] * (n + 1)
        last: list[int] = [_UNKNOWN] * (n + 1)
        back = [0] * (n + 1)
        dist[0] = 0.0
        merges, cost = self.merges, self.cost
        for start in range(n):
            here = dist[start]
            if here == _INF:
                continue
            before = last[start]
            node, end = self.root, start
            while end < n:
                arc = node.get(text[end])
                if arc is None:
                    break
                end += 1
                node, piece = arc
                if piece < 0:
                    continue
                if merges:
                    if dist[end] == _INF and (self.allowed(before, piece) if before >= 0 else self._spine(piece) is not None):
                        dist[end], last[end], back[end] = 0.0, piece, start
                elif here + cost[piece] < dist[end]:
                    dist[end], last[end], back[end] = here + cost[piece], piece, start
            if text[start] not in self.ids and here + self.byte_cost < dist[start + 1]:
                dist[start + 1], last[start + 1], back[start + 1] = here if merges else here + self.byte_cost, _UNKNOWN, start
        out: list[int] = []
        at = n
        while at:
            if last[at] == _UNKNOWN:
                out += [self.bytes[c] for c in reversed(text[back[at] : at].encode("utf-8", "replace"))]
            else:
                out.append(last[at])
            at = back[at]
        return out[::-1]

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self._allowed) > 2_000_000:
            self._allowed.clear()
        found = [self.shortest(x.replace(" ", META)) for x in chunks]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.int32, int(sizes.sum())), sizes


class Encoder:
    """A transducer behind a cache of chunks."""

    def __init__(self, model: bytes):
        self.machine = Transducer(model)
        self.cache = PieceCache(self.machine.encode_chunks)
        self.letter, self.stop = np.zeros(256, bool), np.zeros(256, bool)
        self.letter[[*range(65, 91), *range(97, 123)]] = True
        self.stop[list(self.machine.stops)] = True

    def normalised(self, texts: list[str | None]) -> list[str]:
        return [self.machine.normalise(x) if x else "" for x in texts]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 bounds of the texts among them."""
        data, at = text_buffers(pa.array(self.normalised(texts), pa.string()))
        if not len(data):
            return np.zeros(0, np.int32), at
        cut = np.zeros(len(data), bool)
        if self.machine.space_cut:
            space = data == 32
            cut |= space
            cut[1:] &= ~space[:-1]
        if self.machine.line_cut:
            line = data == 10
            cut |= line
            cut[1:] |= line[:-1]
        cut[1:] |= self.stop[data[1:]] & self.letter[data[:-1]]
        cut[at[:-1][at[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        ids, sizes = self.cache.runs(data, starts, np.append(starts[1:], len(data)))
        return ids, np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, at)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all decoded texts, and the n + 1 bounds of the texts among them."""
        m = self.machine
        sizes = m.surface_sizes[ids]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        data = m.surface[np.repeat(m.surface_at[ids] - bounds[:-1], sizes) + np.arange(bounds[-1])]
        text_at = bounds[at]
        if m.prefix and len(data):
            first = text_at[:-1][np.diff(text_at) > 0]
            first = first[data[first] == 32]
            data = np.delete(data, first)
            text_at = text_at - np.searchsorted(first, text_at)
        return data, text_at


_encoders: dict[int, tuple[object, Encoder]] = {}


def _encoder(shared) -> Encoder:
    if id(shared) not in _encoders:
        _encoders.clear()
        _encoders[id(shared)] = (shared, Encoder(shared.value))
    return _encoders[id(shared)][1]


def _shared(spark: SparkSession, model_path: str):
    """The model file, some hundred kilobytes whatever the corpus, read on the driver and broadcast."""
    with open(model_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _lists(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))


def encode(df: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, n_tokens, tokens)`` of ``(doc_id, text)``."""
    shared = _shared(df.sparkSession, model_path)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in source:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids, at = encoder.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), _lists(ids, at)], ["doc_id", "n_tokens", "tokens"])

    return df.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(batches, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, tokens array<int>")


def decode(df: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, tokens)``; bytes that aren't UTF-8 become replacement characters."""
    shared = _shared(df.sparkSession, model_path)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in source:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [x or [] for x in part.column("tokens").to_pylist()]
                at = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
                data, text_at = encoder.decode(np.array([i for x in rows for i in x], np.int64), at)
                raw = data.tobytes()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(text_at[:-1], text_at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select("doc_id", "tokens").mapInArrow(batches, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, text string")


def digests(df: DataFrame, model_path: str) -> DataFrame:
    """Per document: ``doc_id, n_tokens, ids_crc32`` of its ids as little-endian unsigned 32-bit integers, ``decoded_sha256`` of what
    the ids decode to, and whether that is the text."""
    shared = _shared(df.sparkSession, model_path)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in source:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = part.column("text").to_pylist()
                ids, at = encoder.encode(texts)
                data, text_at = encoder.decode(ids, at)
                raw, flat = data.tobytes(), ids.astype("<u4")
                sums, hashes, same = [], [], []
                for i, text in enumerate(texts):
                    own = raw[text_at[i] : text_at[i + 1]]
                    sums.append(crc(flat[at[i] : at[i + 1]].tobytes()))
                    hashes.append(hashlib.sha256(own).hexdigest())
                    same.append(own == (text or "").encode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array(sums, pa.int64()), pa.array(hashes), pa.array(same)], ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])

    return df.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        batches, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    )


def sentencepiece_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))

"""Byte-level BPE encoding and decoding of a text column (operator 1).

Every block of about 12 MB of text is one corpus for ``bpe.replay``: distinct pre-tokens, an inverted
index from token pair to positions, merges in rank order.  There is no shuffle: blocks are made where
the rows are read.  Ids are binary columns of little-endian unsigned 32-bit numbers.

Defined cases: null and empty texts have no ids; texts of any length are encoded whole; repeated rows
give repeated results; an empty table gives an empty result; other columns of the input are ignored,
so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quernel.llm import bpe


class Decoder:
    """Bytes of ids: one table of all tokens' bytes."""

    def __init__(self, token_bytes: list[bytes | None]):
        known = [b or b"" for b in token_bytes]
        self.lengths = np.fromiter(map(len, known), np.int64, len(known))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(known), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.flat[bpe.gather(self.starts, self.lengths, ids)].tobytes()


_decoders: dict[str, Decoder] = {}


def _decoder(path: str, pattern: str) -> Decoder:
    if path not in _decoders:
        _decoders[path] = Decoder(bpe.encoder(path, pattern).merges.token_bytes)
    return _decoders[path]


def encode(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id_col, n_tokens long, ids binary; with decoded also the bytes that the ids decode to, from the same pass."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = bpe.encoder(vocabulary, pattern), _decoder(vocabulary, pattern) if decoded else None
        for t in bpe.blocks(batches, "text"):
            done = encoder.block(t["text"].combine_chunks() if isinstance(t["text"], pa.ChunkedArray) else t["text"])
            for start in range(0, len(t), 1000):
                rows = range(start, min(start + 1000, len(t)))
                ids = [done.text(k) for k in rows]
                columns = [t["id"].slice(start, len(rows)).combine_chunks(), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
                names = ["id", "n_tokens", "ids"]
                if decoder:
                    columns.append(pa.array([decoder.decode(x) for x in ids], pa.binary()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = f"id {kind}, n_tokens long, ids binary" + ", decoded binary" * decoded
    narrow = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    return narrow.mapInArrow(run, out).withColumnRenamed("id", id_col)


def decode(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, decoded binary.  Null ids decode to no bytes; an id outside the vocabulary is an error."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(vocabulary, pattern)
        for b in batches:
            made = [decoder.decode(np.frombuffer(x or b"", "<u4")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["id", "decoded"])

    return df.select(df[id_col].alias("id"), df[ids_col].alias("ids")).mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)

"""Subword pieces by a distinct-chunk table: each distinct marked word is segmented once and its ids are put back by position.

The model marks a space as one character. If none of its pieces has another character before a mark, no piece can cross from one
marked word into the next, so a text's segmentation is that of its marked words (a run of marks and what follows it) one after the
other. The same holds around characters that stand in no longer piece, such as a line feed here. ``chunk_pattern`` proves both from
the piece list and raises if the first does not hold. The table lives in the Python worker and is emptied when it holds ``TABLE_ROWS`` words, so
memory stays bounded; nothing is shuffled.

Defined cases: a null text is empty and has no ids; the dummy mark in front of a text is added exactly as the library adds it, also to
a text of white space; repeated rows are encoded one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from voxtable.llm.common import kept, text_slices

MODEL = "piece_bpe_32k.model"
#: Distinct words a worker remembers at most.
TABLE_ROWS = 600_000
MARK = "▁"


def chunk_pattern(model) -> re.Pattern:
    """Splits a normalised, marked text into parts that the model segments independently."""
    joined, seen = set(), set()
    for i in range(model.vocab_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        if MARK in piece.lstrip(MARK):
            raise ValueError(f"piece {i} crosses a mark; encode whole texts instead")
        seen.update(piece)
        if len(piece) > 1:
            joined.update(piece)
    # ASCII characters that no longer piece holds stand alone.
    alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
    return re.compile(f"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+", re.S)


class Encoder:
    def __init__(self, path: str, rows: int = TABLE_ROWS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pattern = chunk_pattern(self.model)
        # Words are segmented as parts of a text, so without the mark that the library puts in front of a text.
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=_without_dummy(open(path, "rb").read()))
        self.rows, self.table = rows, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text, equal to those of the library."""
        if not texts:
            return []
        split = [self.pattern.findall(t) for t in self.model.normalize(texts)]
        new = list(dict.fromkeys(c for chunks in split for c in chunks if c not in self.table))
        if len(self.table) + len(new) > self.rows:
            self.table = {}
            new = list(dict.fromkeys(c for chunks in split for c in chunks))
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            self.table.update(zip(part, (np.array(x, np.uint16).tobytes() for x in self.bare.encode(part, num_threads=1))))
        get = self.table.__getitem__
        return [np.frombuffer(b"".join(map(get, chunks)), np.uint16) for chunks in split]


def _without_dummy(proto: bytes) -> bytes:
    """The model file with add_dummy_prefix (field 3 of normalizer_spec, field 3 of the model) off; a repeated field overrides."""
    add = b"\x1a\x02\x18\x00"
    return proto + add


def tokenise(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids (array), decoded (text): every text's ids, and what the library decodes from them."""
    path = model or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(f"pieces of {path}", lambda: Encoder(path))
        for batch, raw in text_slices(batches, "text"):
            ids = encoder.encode([t.decode() for t in raw])
            decoded = encoder.model.decode([x.tolist() for x in ids], num_threads=1)
            offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat), pa.array(decoded)], ["doc_id", "ids", "decoded"])

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, without sending ids or texts out of the task."""
    path = model or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(f"pieces of {path}", lambda: Encoder(path))
        decimal = np.array([str(i) for i in range(encoder.model.vocab_size())], object)
        for batch, raw in text_slices(batches, "text"):
            ids = encoder.encode([t.decode() for t in raw])
            decoded = encoder.model.decode([x.tolist() for x in ids], num_threads=1)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(",".join(decimal[x]).encode()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

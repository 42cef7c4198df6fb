"""Document fingerprints by consistent weighted sampling: equal samples of two documents are as frequent as their generalised Jaccard similarity.

A document is a set of weighted terms: its pairs of neighbouring words (the first and the last word also pair with the edge), each with
its number of occurrences S. For every sample j and term, three numbers follow from a hash of both: r and c from Gamma(2, 1), b from [0, 1). With
t = floor(ln S / r + b), the sample takes the term with the least ln c - r (t - b) - r, and records that term together with t. Two documents
record the same with the probability sum(min(S, T)) / sum(max(S, T)) over all terms. A fingerprint holds ``SAMPLES`` records of 16 bits.

Words are runs of bytes outside ASCII white space, case counts. Terms are known by 64-bit hashes, so equal texts have equal fingerprints, in whatever task,
batch or order they are read, and so do texts that differ in white space only.

``edits`` also fingerprints an edited text for every document: its last quarter replaced by the head of the next document in the order of ids. A range sort puts
neighbours side by side; each task looks one row ahead, and only the first and last row of each task meet in a small second step.

Defined cases: a null text is empty; texts without words have the fingerprint of zeros, like each other and unlike all others; ids ascend with null first, rows
with equal ids by a hash of their text, equal rows side by side; a lone row is its own next; an empty table gives an empty result; other columns are ignored; terms of
long texts are sampled in blocks, so memory follows the text, not text times samples.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtable.llm.common import WordHasher, joined_words, mixed
from voxtable.session import written

SAMPLES = 64
#: Documents that share one table of terms: at most so many bytes of text, one document at least.
SLICE_BYTES = 1 << 18
#: Pairs of a document and a term that are sampled at once.
BLOCK = 1 << 11
WHITE = b" \t\n\x0b\x0c\r"
EDGE = 0x5DEECE66D1CE4E5B
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def new_hasher() -> WordHasher:
    return WordHasher(WHITE, lower=False)


def weighted_terms(hasher: WordHasher, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, occurrences) of every distinct term of every text, ordered by term and document."""
    h, _, _, doc = joined_words(hasher, texts)
    if not len(h):
        return doc, h, np.zeros(0, np.int64)
    last = np.flatnonzero(np.diff(doc, append=-1))
    with np.errstate(over="ignore"):
        before = np.where(np.diff(doc, prepend=-1) != 0, _U(EDGE), np.roll(h, 1))
        term, owner = np.concatenate([mixed(before * _U(3) + h), mixed(h[last] * _U(3) + _U(EDGE))]), np.concatenate([doc, doc[last]])
    order = np.lexsort((owner, term))
    term, owner = term[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])]))
    return owner[first], term[first], np.diff(np.append(first, len(term)))


def _gamma(z: np.ndarray) -> np.ndarray:
    """A Gamma(2, 1) number from each 64-bit number: minus the logarithm of the product of two uniform ones, its halves."""
    halves = (z | _U(0x100000001)).view(np.uint32).reshape(*z.shape, 2)
    out = halves[..., 0].astype(np.float32)
    out *= halves[..., 1]
    np.log(out, out=out)
    return np.subtract(np.float32(64 * np.log(2)), out, out=out)


_SAMPLE = mixed((np.arange(SAMPLES, dtype=np.uint64) + _U(1)) * _U(0xD1342543DE82EF95)) | _U(1)


def draws(term: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For every (term, weight) and sample: the value to be minimised in the upper 32 bits, what is recorded in the lower."""
    with np.errstate(over="ignore"):
        one = mixed(term[:, None] ^ _SAMPLE)
        two = (one ^ one >> _U(29)) * _GOLD
        record = two ^ two >> _U(32)
        record *= _SAMPLE
    r, value = _gamma(one), _gamma(two)
    np.log(value, out=value)
    record >>= _U(32)
    b = record.astype(np.float32)
    b *= np.float32(2.0**-32)
    # A weight of one has t = 0.
    heavy = np.flatnonzero(weight > 1)
    if len(heavy):
        t = np.floor(np.log(weight[heavy].astype(np.float32))[:, None] / r[heavy] + b[heavy])
        value[heavy] -= r[heavy] * t
        with np.errstate(over="ignore"):
            record[heavy] = mixed(record[heavy] + (t.astype(np.int64).astype(np.uint64) << _U(32))) >> _U(32)
    b -= 1
    b *= r
    value += b
    bits = value.view(np.int32)
    # Floats in the order of their values as unsigned numbers.
    ordered = (bits ^ (bits >> 31 | np.int32(-(1 << 31)))).view(np.uint32).astype(np.uint64)
    ordered <<= _U(32)
    ordered |= record
    return ordered


def fingerprints(hasher: WordHasher, texts: list[bytes]) -> np.ndarray:
    """One row of ``SAMPLES`` records for each text: 0 for texts without words, else 1 to 65535."""
    out = np.full((len(texts), SAMPLES), np.iinfo(np.uint64).max, np.uint64)
    owner, term, weight = weighted_terms(hasher, texts)
    some = np.zeros(len(texts), bool)
    some[owner] = True
    for at in range(0, len(owner), BLOCK):
        docs, terms, weights = owner[at : at + BLOCK], term[at : at + BLOCK], weight[at : at + BLOCK]
        # Neighbours with one term and weight share their draws.
        new = np.concatenate([[True], (terms[1:] != terms[:-1]) | (weights[1:] != weights[:-1])])
        table, row = draws(terms[new], weights[new]), np.cumsum(new) - 1
        order = np.argsort(docs, kind="stable")
        docs = docs[order]
        first = np.flatnonzero(np.diff(docs, prepend=-1))
        least = np.minimum.reduceat(table[row[order]], first, axis=0)
        out[docs[first]] = np.minimum(out[docs[first]], least)
    records = ((out & _U(0xFFFFFFFF)) % _U(65535)).astype(np.uint16) + np.uint16(1)
    records[~some] = 0
    return records


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (a == b).mean(1)


def fingerprint_text(records: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in records.astype(">u2")]


def fingerprinted(docs: DataFrame, column: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of their ``text``, in place of a column of that name."""
    from pyspark.sql.types import StringType, StructType

    from voxtable.llm.common import text_slices

    docs = docs.drop(column)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = new_hasher()
        for batch, texts in text_slices(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fingerprint_text(fingerprints(hasher, texts)), pa.string())], [*names, column])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(column, StringType()))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many code points of the head of ``following``, or all."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Beside finished rows: the first and last row of each task with their texts, for the step between tasks.
_NAMES = [part.split()[0] for part in EDITS.split(", ")]


def _finished(hasher: WordHasher, ids: list, texts: list[str]) -> list[pa.Array]:
    """The columns of all documents but the last, which is only the next of the one before it."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    raw = [x.encode() for x in changed]
    both = fingerprints(hasher, [t.encode() for t in texts] + raw)
    own, other = both[: len(texts)], both[len(texts) :]
    return [
        pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
        pa.array(fingerprint_text(own[:-1]), pa.string()), pa.array(fingerprint_text(other), pa.string()),
        pa.array(likeness(own[:-1], other), pa.float64()), pa.array(likeness(own[:-1], own[1:]), pa.float64()),
    ]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of consecutive rows, about ``SLICE_BYTES`` at a time; each slice begins with the last row of the one before."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            text = batch.column(1)[k].as_py() or ""
            ids.append(batch.column(0)[k].as_py())
            texts.append(text)
            size += len(text)
            if size >= SLICE_BYTES and len(ids) > 1:
                yield ids, texts
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
    if len(ids) > 1:
        yield ids, texts


def edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    keys = ["doc_id", "_mark", "_row"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_mark", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, part, first, last = new_hasher(), TaskContext.get().partitionId(), None, None

        def seen(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal first, last
            for batch in source:
                if batch.num_rows:
                    first = batch.slice(0, 1) if first is None else first
                    last = batch.slice(batch.num_rows - 1)
                    yield batch

        for ids, texts in _slices(seen(batches)):
            done = _finished(hasher, ids, texts)
            n = len(done[0])
            yield pa.RecordBatch.from_arrays([*done, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], [*_NAMES, "part", "head", "tail"])
        if first is not None:
            empty = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [last.column(0), *empty, pa.array([part], pa.int32()), first.column(1).cast(pa.string()), last.column(1).cast(pa.string())], [*_NAMES, "part", "head", "tail"])

    done = written(spread.mapInArrow(run, EDITS + ", part int, head string, tail string"), "edits")
    # One row for each task: its last document meets the first of the task after it, the very last the very first.
    edges = done.where("part is not null").select("doc_id", "part", "head", "tail")
    order = edges.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(0)))).alias("next"))
    heads = edges.select(F.col("part").alias("next"), F.col("head").alias("following"))
    met = edges.join(order, "part").join(heads, "next").select("doc_id", "tail", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = new_hasher()
        for batch in batches:
            for doc_id, tail, following in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays(_finished(hasher, [doc_id, None], [tail, following]), _NAMES)

    return done.where("part is null").select(*_NAMES).unionByName(met.mapInArrow(close, EDITS))

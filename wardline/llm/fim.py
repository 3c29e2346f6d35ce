"""Fill-in-middle transformation by displacement scatter.

Spark draws each document's form and cuts from a hash of its id. A task takes the texts of a
batch as one byte array, scans it for the bytes where the cuts fall, and puts into a difference
array by how much each run of bytes (prefix, middle, suffix) moves in the output. Its cumulative
sum is every byte's shift; one numpy scatter writes the output. ``restore`` scans an output for
its marks and gathers the bytes back in the same way. No rows are exchanged, and the sums run in
windows, so a task holds the bytes of a batch (or of one document) twice and a fixed rest.

Cases: a null text is empty; empty texts, and such that hold a mark, stay plain. A null id is
hashed as an empty one; repeated rows are transformed each, alike. Other columns are not read,
so any names may occur."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import slices
from .words import text_bytes

#: Fixed values of the output's format: what stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARK = 3  # bytes of each
#: Bytes whose shifts are in memory at once.
WINDOW = 1 << 20


def _draw(k: int) -> Column:
    """The k-th group of 8 hex digits of the id's SHA-256, as a number."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def cuts(docs: DataFrame, plain_of_100: int = 10, spm_of_100: int = 20) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.char_length(text).cast("long").alias("n"),
                       *(_draw(k).alias(f"h{k}") for k in range(1, 5)))
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(m))
    form = F.when((F.col("n") == 0) | marked | (F.col("h3") % 100 >= 100 - plain_of_100), "plain").when(
        F.col("h4") % 100 < spm_of_100, "spm").otherwise("psm")
    one, other = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    cut = F.col("form") != "plain"
    return rows.withColumn("form", form).select(
        "doc_id", "text", "n", "form", F.when(cut, F.least(one, other)).alias("prefix_chars"),
        F.when(cut, F.abs(one - other)).alias("middle_chars"))


def _starts(raw: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Per window its first byte, how many code points came before, and where those in it start."""
    before = 0
    for lo in range(0, len(raw), WINDOW):
        at = lo + np.flatnonzero((raw[lo:lo + WINDOW] & 0xC0) != 0x80)
        yield lo, before, at
        before += len(at)


def byte_cuts(raw: np.ndarray, off: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """The byte at which code point ``chars[k, i]`` of document i starts (its end, if there is none)."""
    first = np.zeros(len(off), np.int64)  # code points before each document
    for lo, before, at in _starts(raw):
        inside = off >= lo
        first[inside] = before + np.searchsorted(at, off[inside])
    want, out = first[:-1] + chars, np.broadcast_to(off[1:], chars.shape).copy()
    for _, before, at in _starts(raw):
        here = (want >= before) & (want < before + len(at)) & (want < first[1:])
        out[here] = at[want[here] - before]
    return out


def _shifts(n: int, at: np.ndarray, by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Per window the shift of each of ``n`` bytes: runs that start at ``at`` (in order) move by ``by``."""
    jump, carry = np.diff(by, prepend=0), 0
    for lo in range(0, n, WINDOW):
        hi = min(n, lo + WINDOW)
        a, z = np.searchsorted(at, [lo, hi])
        step = np.zeros(hi - lo, np.int64)
        np.add.at(step, at[a:z] - lo, jump[a:z])  # empty runs start where the next one does
        step[0] += carry
        shift = np.cumsum(step)
        carry = int(shift[-1])
        yield lo, shift


def scatter(raw: np.ndarray, off: np.ndarray, p: np.ndarray, m: np.ndarray, cut: np.ndarray, spm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the outputs; ``p`` and ``m`` are the bytes where prefix and middle end."""
    start, end = off[:-1], off[1:]
    np_, nm, ns = p - start, m - p, end - m
    moved = np.concatenate([[0], np.cumsum(np.where(cut, 3 * _MARK, 0))])  # marks before each document
    prefix = np.where(spm, 2 * _MARK + ns, _MARK)
    middle = 3 * _MARK + ns
    suffix = np.where(spm, _MARK - np_ - nm, 2 * _MARK - nm)
    by = np.where(cut, np.stack([prefix, middle, suffix]), 0) + moved[:-1]
    at = np.where(cut, np.stack([start, p, m]), start)
    out_off = off + moved
    out = np.empty(int(out_off[-1]), np.uint8)
    for lo, shift in _shifts(len(raw), at.T.ravel(), by.T.ravel()):
        out[np.arange(lo, lo + len(shift)) + shift] = raw[lo:lo + len(shift)]
    first = out_off[:-1]
    for mark, place in ((PREFIX, np.where(spm, first + _MARK + ns, first)),
                        (SUFFIX, np.where(spm, first, first + _MARK + np_)),
                        (MIDDLE, first + 2 * _MARK + np_ + ns)):
        for k, byte in enumerate(mark.encode()):
            out[place[cut] + k] = byte
    return out, out_off


def gather(raw: np.ndarray, off: np.ndarray, cut: np.ndarray, spm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts that the outputs were made from."""
    found = {m: np.zeros(len(cut), np.int64) for m in b"PSM"}
    for lo in range(0, len(raw) - 2, WINDOW):
        part = raw[lo:lo + WINDOW + 2]  # a mark may reach two bytes into the next window
        at = np.flatnonzero((part[:-2] == ord("<")) & (part[2:] == ord(">")))
        letter, at = part[at + 1], lo + at
        row = np.searchsorted(off, at, "right") - 1
        inside = cut[row] & (at + 2 < off[row + 1])
        for m, place in found.items():
            mine = inside & (letter == m)
            place[row[mine]] = at[mine]
    start, end = off[:-1], off[1:]
    p, s, m = found.values()
    np_ = np.where(spm, m - p, s - p) - _MARK
    nm = end - m - _MARK
    text_off = off - np.concatenate([[0], np.cumsum(np.where(cut, 3 * _MARK, 0))])
    first = text_off[:-1]
    at = np.where(cut, np.stack([first, first + np_, first + np_ + nm]), first)
    by = np.where(cut, np.stack([p + _MARK, m + _MARK, s + _MARK]) - at, start - first)
    out = np.empty(int(text_off[-1]), np.uint8)
    for lo, shift in _shifts(len(out), at.T.ravel(), by.T.ravel()):
        out[lo:lo + len(shift)] = raw[np.arange(lo, lo + len(shift)) + shift]
    return out, text_off


def _strings(raw: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(raw))


def _forms(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    form = np.array(b.column("form").to_pylist(), object)
    return form != "plain", form == "spm"


def transform(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw, off = text_bytes(b.column("text"))
            cut, spm = _forms(b)
            a, c = (b.column(k).fill_null(0).to_numpy(zero_copy_only=False) for k in ("prefix_chars", "middle_chars"))
            p, m = byte_cuts(raw, off, np.stack([a, a + c]))
            yield pa.RecordBatch.from_arrays([b.column(k) for k in kept] + [_strings(*scatter(raw, off, p, m, cut, spm))], [*kept, "output"])

    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    rows = cuts(docs)
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in kept)
    return rows.mapInArrow(run, f"{kinds}, output string")


def restore(rows: DataFrame) -> DataFrame:
    """``rows`` (output, form and any others) with ``restored``, the text before the transformation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "output"):
            raw, off = text_bytes(b.column("output"))
            yield pa.RecordBatch.from_arrays([*b.columns, _strings(*gather(raw, off, *_forms(b)))], [*b.schema.names, "restored"])

    return rows.mapInArrow(run, StructType([*rows.schema, StructField("restored", StringType())]))


def digest(rows: DataFrame) -> DataFrame:
    """``rows`` of ``transform``, with hashes in place of the output and of the text restored from it."""
    return restore(rows).select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                                F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))

"""Suffix-array deduplication: every byte of a repeated ``length``-byte string that also
starts earlier goes.

Strings meet by content, not by document. Each window of ``length`` bytes is named by its
least ``_GRAM``-byte gram (leftmost on ties), so equal windows have equal grams; the windows
around one occurrence of a gram are one segment. Segments are grouped by gram. Equal segments
repeat their first one whole; where a gram has several different segments, their bytes form
shards whose suffixes are sorted by external induction (``induced``), and windows within a
common prefix of ``length`` repeat the first of them. A gram of so many segments that they
don't fit a shard has its windows dealt one by one, by their own content.

The text itself moves twice, compressed, to its own segments; what moves by gram is ids.

Cases: null and empty texts keep nothing and lose nothing; texts that equal an earlier one
lose every byte if they have ``length``; repeated rows are one document and give equal rows;
rows of one id and different texts are documents of their own, in the order of their SHA-256;
rows without an id come after all others; other columns are not read. Texts are the same if
their SHA-256 is."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.groups import ordered_rank
from .common import bucketed, free_names, give_back, groups, partitions, slices, store
from .induced import suffixes
from .words import _CODE, _DOWN, _UP, mix, text_bytes

_GRAM = 24
_CHUNK = 1 << 19  # windows in one numpy pass
_SHARD = 1 << 20  # bytes sorted at once
_OUT = 4 << 20  # bytes of text that a task holds before it sends them on
_SPLIT = 4096  # segments of one gram that stay together
_WAYS = 8  # a gram of more than _SPLIT times as many segments is dealt by window
_HELD = 1 << 16  # windows whose first a task looks for at once
_LAST = 1 << 62  # ids of rows without an id start here


def segments(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(gram, content, row, first window, windows, gram's distance) of every segment. A segment's
    windows start at consecutive bytes and share the gram that names them."""
    found = []
    span = length - _GRAM + 1
    for lo in range(0, max(len(raw) - length + 1, 0), _CHUNK):
        x = raw[lo:lo + _CHUNK + length - 1]
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_CODE[x] * _UP[:len(x)], out=sums[1:])
        n = len(x) - _GRAM + 1
        gram = mix((sums[_GRAM:] - sums[:-_GRAM]) * _DOWN[:n])
        # The place in the low bits makes the least gram's leftmost place the minimum.
        best = (gram & ~np.uint64((1 << 20) - 1)) | np.arange(n, dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        m = n - span + 1
        at = (np.minimum(best[:m], best[span - width:span - width + m]) & np.uint64((1 << 20) - 1)).astype(np.int64)
        start = np.arange(m)
        row = np.searchsorted(off, start + lo, "right") - 1
        inside = start + lo + length <= off[row + 1]
        at, start, row = at[inside], start[inside], row[inside]
        if not len(at):
            continue
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
        cut = np.flatnonzero(new)
        first, row, at = start[cut], row[cut], at[cut]
        last = start[np.append(cut[1:], len(start)) - 1]
        content = mix((sums[last + length] - sums[first]) * _DOWN[first] + (last - first).astype(np.uint64))
        found.append((gram[at], content, row, first + lo - off[row], last - first + 1, at - first))
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


class Places:
    """The place ``doc`` of every document in the order of all: that of its id, and of its text among
    those of one id. Ids are places themselves unless some id has several texts; then they are moved up by as
    many bits as these need, after being numbered if they are too large for that."""

    def __init__(self, docs: DataFrame):
        self.sha = F.sha2(F.coalesce("text", F.lit("")), 256)
        own = F.lit(_LAST) + F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2)
        self.id, self.bits, self.several, self.ranks = F.coalesce(F.col("doc_id").cast("long"), own), 0, None, None
        hashed = store(docs.select("doc_id", self.id.alias("id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                                   self.sha.alias("sha")))
        several = store(hashed.where(F.col("id") < _LAST).groupBy("id").agg(F.min("sha").alias("least"), F.max("sha").alias("most"))
                        .where("least <> most").select("id"))
        if not several.isEmpty():
            texts = hashed.join(several, "id").select("id", "sha").distinct()
            self.several = store(texts.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("sha")) - 1))
            ids = hashed.where(F.col("id") < _LAST)
            nth, low, high = self.several.agg(F.max("nth")).first()[0], *ids.agg(F.min("id"), F.max("id")).first()
            self.bits = nth.bit_length()
            if max(-low, high) >= _LAST >> self.bits:
                parts = [F.shiftright("id", k).alias(f"b{k}") for k in (42, 21)]
                self.ranks = store(ordered_rank(ids.select("id", *parts).distinct(), [], ["b42", "b21"], ["id"]).select("id", "rank"))
        #: (doc_id, n_bytes, sha, doc) of every row.
        self.rows = self.of(hashed.withColumnRenamed("id", "id_"), F.col("id_"), F.col("sha"), "doc").drop("id_")

    def of(self, df: DataFrame, own: Column, sha: Column, name: str) -> DataFrame:
        """``df`` with the places of its rows, given their id and SHA-256, as column ``name``."""
        if self.several is None:
            return df.withColumn(name, own)
        i, h = free_names(df, "place_id", "place_sha")
        df = df.withColumns({i: own, h: sha}).join(self.several.select(F.col("id").alias(i), F.col("sha").alias(h), F.col("nth").alias(f"{i}_nth")), [i, h], "left")
        number = F.col(i)
        if self.ranks is not None:
            df = df.join(self.ranks.select(F.col("id").alias(i), F.col("rank").alias(f"{i}_rank")), i, "left")
            number = F.col(f"{i}_rank")
        place = F.when(F.col(i) >= _LAST, F.col(i)).otherwise(F.shiftleft(number, self.bits) + F.coalesce(f"{i}_nth", F.lit(0)))
        return df.withColumn(name, place).drop(i, h, f"{i}_nth", f"{i}_rank")


def _fresh(b: pa.RecordBatch, seen: dict[bytes, int]) -> pa.RecordBatch:
    """Without rows whose text this task has met under a smaller id."""
    keep = []
    for d, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
        key = hashlib.blake2b(t or b"", digest_size=16).digest()
        keep.append(seen.get(key, _LAST * 2) > d)
        if keep[-1]:
            seen[key] = d
    return b.filter(pa.array(keep))


def shared_segments(texts: DataFrame, length: int) -> DataFrame:
    """(doc, gram, at, whole): segments whose gram occurs again. ``whole`` ones repeat an earlier
    equal segment; of the others each is the first of its content, and its gram has several.
    ``at`` packs first window, distance of the gram and windows."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for b in slices(batches):
            b = _fresh(b, seen)
            gram, content, row, first, n, far = segments(*text_bytes(b.column(1)), length)
            doc, at = b.column(0).to_numpy()[row], (first << 16) | (far << 8) | n
            order = np.lexsort((at, doc, content, gram))
            gram, content, doc, at = (x[order] for x in (gram, content, doc, at))
            again = np.zeros(len(gram), bool)  # the batch has an earlier equal one
            again[1:] = (gram[1:] == gram[:-1]) & (content[1:] == content[:-1]) & (
                (doc[1:] != doc[:-1]) | (at[1:] != at[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                gram.view(np.int64), content.view(np.int64), doc, at, again)], names)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pending = None, None  # the last row; the first segment of its gram while it is the only content
        for b in batches:
            known = b.filter(b.column(4))
            yield pa.RecordBatch.from_arrays([known.column(2), known.column(0), known.column(3), known.column(4)], out_names)
            b = b.filter(pc.invert(b.column(4)))
            if not b.num_rows:
                continue
            rows = np.column_stack([b.column(k).to_numpy() for k in range(4)])
            before = np.vstack([[last] if last is not None else rows[:1], rows[:-1]])
            same_gram, same = rows[:, 0] == before[:, 0], rows[:, 1] == before[:, 1]
            if last is None:
                same_gram[0] = False
            same &= same_gram
            whole = same & (rows[:, 2:] != before[:, 2:]).any(1)
            several = same_gram & ~same  # a further content of a gram
            group = np.cumsum(~same_gram)  # 0: the gram of the batch before
            more = np.bincount(group[several], minlength=group[-1] + 1) > 0
            first = ~same_gram & more[group]
            out = [rows[several | first], rows[whole]]
            if pending is not None and more[0]:
                out[0] = np.vstack([pending, out[0]])
            if group[-1]:
                pending = None if more[-1] else rows[np.flatnonzero(~same_gram)[-1]]
            elif more[0]:
                pending = None
            last = rows[-1]
            r = np.vstack(out)
            yield pa.RecordBatch.from_arrays([pa.array(r[:, 2]), pa.array(r[:, 0]), pa.array(r[:, 3]),
                                              pa.array(np.arange(len(r)) >= len(out[0]))], out_names)

    names, out_names = ["gram", "content", "doc", "at", "again"], ["doc", "gram", "at", "whole"]
    sent = texts.mapInArrow(send, "gram long, content long, doc long, at long, again boolean")
    # A gram sends one segment per content and batch; those that are settled go anywhere.
    to = F.when(F.col("again"), F.xxhash64("doc", "at")).otherwise(F.col("gram"))
    dealt = sent.withColumn("to", to).repartition(partitions(texts.sparkSession), "to").sortWithinPartitions(*names[:4]).select(*names)
    return store(dealt.mapInArrow(pick, "doc long, gram long, at long, whole boolean"))


def texts_of(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, z, parts, most): the compressed text of every document in ``found``, its segments, and
    the most ways of one of their grams."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        pack = zstandard.ZstdCompressor(level=1)
        for b in slices(batches):
            b = _fresh(b, seen)
            z = [pack.compress(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z, pa.binary())], ["doc", "z"])

    # Only segments that are not settled need their gram's count.
    several = found.where(~F.col("whole"))
    many = several.groupBy("gram").agg(F.ceil(F.count("*") / _SPLIT).cast("int").alias("ways"))
    rows = several.join(many, "gram").select("doc", "at", "gram", "ways").union(
        found.where("whole").select("doc", "at", "gram", F.lit(None).cast("int").alias("ways")))
    parts = rows.groupBy("doc").agg(F.collect_list(F.struct("at", "gram", "ways")).alias("parts"), F.max("ways").alias("most"))
    packed = texts.mapInArrow(send, "doc long, z binary").dropDuplicates(["doc"])
    return bucketed(packed.join(parts, "doc").repartition(partitions(texts.sparkSession), "doc"), "doc")


def _lists(col: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and flat fields of a column of lists of numbers' structs; nulls are 0."""
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    fields = [pc.fill_null(f, 0).to_numpy(zero_copy_only=False) for f in col.flatten().flatten()]
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int64), fields


def bodies(texts: DataFrame, length: int) -> DataFrame:
    """(gram, way, doc, first, body): bytes of segments, split by distance from their gram; those of
    one gram and way are at most _WAYS * _SPLIT. ``texts`` has the columns of ``texts_of``."""
    span = length - _GRAM + 1

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
            zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        out, size = [], 0
        for b in slices(batches, "z", 1 << 20):
            off, (at, gram, ways) = _lists(b.column(2))
            for i, doc in enumerate(b.column(0).to_pylist()):
                own = np.flatnonzero((ways[off[i]:off[i + 1]] > 0) & (ways[off[i]:off[i + 1]] <= _WAYS)) + off[i]
                if not len(own):
                    continue
                text = unpack.decompress(b.column(1)[i].as_py())
                for p, g, w in zip(at[own].tolist(), gram[own].tolist(), ways[own].tolist()):
                    first, far, n = p >> 16, p >> 8 & 255, p & 255
                    for k in range(min(w, span)):  # windows at like distances from the gram
                        near, wide = k * span // min(w, span), (k + 1) * span // min(w, span)
                        lo, hi = max(first, first + far - wide + 1), min(first + n, first + far - near + 1)
                        if lo < hi:
                            out.append((g, k, doc, lo, text[lo:hi + length - 1]))
                            size += hi - lo + length
                    if size > _OUT:
                        yield table(out)
                        out, size = [], 0
        if out:
            yield table(out)

    names = ["gram", "way", "doc", "first", "body"]
    return texts.select("doc", "z", "parts").mapInArrow(cut, "gram long, way int, doc long, first long, body binary")


def hot_windows(texts: DataFrame, length: int) -> DataFrame:
    """(window, doc, first): the windows of grams with more than _WAYS ways, by a digest of their
    bytes. Those that repeat one of the same task have none."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        least: dict[bytes, tuple[int, int]] = {}
        again: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            doc, first = zip(*least.values(), *again)
            out = pa.RecordBatch.from_arrays([pa.array([*least, *[None] * len(again)], pa.binary()),
                                              pa.array(doc, pa.int64()), pa.array(first, pa.int64())], ["window", "doc", "first"])
            least.clear()
            again.clear()
            return out

        for b in slices(batches, "z", 1 << 20):
            off, (parts, _, ways) = _lists(b.column(2))
            for i, doc in enumerate(b.column(0).to_pylist()):
                own = parts[off[i]:off[i + 1]][ways[off[i]:off[i + 1]] > _WAYS]
                text = unpack.decompress(b.column(1)[i].as_py()) if len(own) else b""
                for p in own.tolist():
                    for at in range(p >> 16, (p >> 16) + (p & 255)):
                        key, own = hashlib.blake2b(text[at:at + length], digest_size=16).digest(), (doc, at)
                        held = least.setdefault(key, own)
                        if held != own:
                            least[key] = min(held, own)
                            again.append(max(held, own))
                    if len(least) + len(again) >= _HELD:
                        yield flush()
        if least:
            yield flush()

    return texts.where(F.col("most") > _WAYS).select("doc", "z", "parts").mapInArrow(cut, "window binary, doc long, first long")


def repeated_runs(texts: DataFrame, length: int) -> DataFrame:
    """(doc, start, stop): runs of windows, by first byte, that repeat an earlier window of another
    content's segment. ``texts`` has the columns of ``texts_of``."""
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for t in groups(batches, 2):
            if held and size + t["body"].nbytes > _SHARD:
                yield from _repeats(pa.concat_tables(held), length)
                held, size = [], 0
                give_back()
            held.append(t)
            size += t["body"].nbytes
        if held:
            yield from _repeats(pa.concat_tables(held), length)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last window
        for b in batches:
            window, rows = b.column(0), b.num_rows
            if not rows:
                continue
            again = np.array(window.is_null())
            again[1:] |= pc.fill_null(pc.equal(window.slice(1), window.slice(0, rows - 1)), False).to_numpy(zero_copy_only=False)
            again[0] |= window[0].is_valid and window[0].as_py() == last
            last = window[-1].as_py()
            b = b.filter(pa.array(again))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pc.add(b.column(2), 1)], ["doc", "start", "stop"])

    n = partitions(texts.sparkSession)
    dealt = bodies(texts, length).repartition(n, "gram", "way").sortWithinPartitions("gram", "way", "doc", "first")
    # A window sends one row per task's share; those that are settled go anywhere.
    to = F.when(F.col("window").isNull(), F.xxhash64("doc", "first")).otherwise(F.xxhash64("window"))
    single = hot_windows(texts, length).withColumn("to", to).repartition(n, "to") \
        .sortWithinPartitions("window", "doc", "first").select("window", "doc", "first")
    kinds = "doc long, start long, stop long"
    return dealt.mapInArrow(sort, kinds).union(single.mapInArrow(pick, kinds))


def _repeats(t: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Windows of a shard that repeat an earlier one, as runs."""
    bodies = t["body"].to_pylist()
    size = np.array([len(x) for x in bodies], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    text = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.uint16) + 2
    text[begin + size] = 1
    doc, first = t["doc"].to_numpy(), t["first"].to_numpy()
    seen_pos, seen_group, group = [], [], 0
    for pos, lcp in suffixes(text, length):
        name = group + np.cumsum(lcp < length)
        group = int(name[-1])
        body = np.searchsorted(begin, pos, "right") - 1
        window = pos + length <= begin[body] + size[body]
        again = lcp >= length
        tied = again.copy()
        tied[:-1] |= again[1:]
        tied[-1] = True  # the next chunk may go on
        use = window & tied
        seen_pos.append(pos[use])
        seen_group.append(name[use])
    pos, name = np.concatenate(seen_pos), np.concatenate(seen_group)
    body = np.searchsorted(begin, pos, "right") - 1
    where = first[body] + pos - begin[body]
    order = np.lexsort((where, doc[body], name))
    name, d, where = name[order], doc[body][order], where[order]
    later = np.zeros(len(name), bool)
    later[1:] = name[1:] == name[:-1]
    d, where = d[later], where[later]
    if not len(d):
        return
    order = np.lexsort((where, d))
    d, where = d[order], where[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (where[1:] > where[:-1] + 1)
    at = np.flatnonzero(new)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d[at], where[at], where[np.append(at[1:], len(d)) - 1] + 1)],
                                     ["doc", "start", "stop"])


def kept_texts(texts: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """(doc, n_removed, n_spans, kept): what is left of every document in ``texts``."""
    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
            zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc", "n_removed", "n_spans", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        out, size = [], 0
        for b in slices(batches, "z", 1 << 20):
            off, (at, _, ways) = _lists(b.column(2))
            more, (start, stop) = _lists(b.column(3))
            for i, doc in enumerate(b.column(0).to_pylist()):
                text = unpack.decompress(b.column(1)[i].as_py())
                whole = at[off[i]:off[i + 1]][ways[off[i]:off[i + 1]] == 0]
                lo = np.concatenate([whole >> 16, start[more[i]:more[i + 1]]])
                hi = np.concatenate([(whole >> 16) + (whole & 255), stop[more[i]:more[i + 1]]]) + length - 1
                order = np.argsort(lo, kind="stable")
                kept, n, done = [], 0, -1
                for first, end in zip(lo[order].tolist(), hi[order].tolist()):
                    if first > done:
                        n += 1
                        kept.append(text[max(done, 0):first])
                    done = max(min(end, len(text)), done)
                left = b"".join([*kept, text[max(done, 0):]])
                out.append((doc, len(text) - len(left), n, left))
                size += len(left)
                if size > _OUT:
                    yield table(out)
                    out, size = [], 0
        if out:
            yield table(out)

    of = runs.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    return texts.join(of, "doc", "left").select("z", "parts", "runs", "doc").select("doc", "z", "parts", "runs").mapInArrow(
        run, "doc long, n_removed long, n_spans long, kept binary")


def _found(docs: DataFrame, length: int) -> tuple[Places, DataFrame, DataFrame]:
    """Places, the rows (doc_id, doc, n_bytes, sha, copy), and what is left of documents. ``copy``: an
    earlier document has the same text, and it is long enough to go."""
    places = Places(docs)
    rows = places.rows.join(places.rows.groupBy("sha").agg(F.min("doc").alias("least")), "sha")
    rows = rows.withColumn("copy", (F.col("least") < F.col("doc")) & (F.col("n_bytes") >= length))
    texts = places.of(docs.select("doc_id", "text"), places.id, places.sha, "doc").select("doc", "text")
    own = texts_of(texts, shared_segments(texts, length))
    return places, rows, kept_texts(own, store(repeated_runs(own, length)), length)


def repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    _, rows, kept = _found(docs, length)
    kept = kept.select("doc", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha"))
    zero = F.lit(0).cast("long")
    return rows.join(kept, "doc", "left").select(
        "doc_id", "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(F.col("copy"), F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with what is left of each text, and ``n_chars`` (if there) as its length. A character
    of which only some bytes stay goes whole. Rows whose text equals an earlier one lose it all
    if it has ``length`` bytes; no row goes."""
    places, rows, kept = _found(docs, length)
    copies = rows.where("copy").select("doc", F.lit(b"").alias("left")).distinct()
    changed = kept.where("n_removed > 0").select("doc", F.col("kept").alias("left")).join(copies.select("doc"), "doc", "left_anti").union(copies)
    doc, left = free_names(docs, "doc", "left")
    change = store(changed.mapInArrow(_as_text, "doc long, left string")).select(F.col("doc").alias(doc), F.col("left").alias(left))
    joined = places.of(docs, places.id, places.sha, doc).join(change, doc, "left")
    new = {"text": F.coalesce(left, "text")} | ({"n_chars": F.when(F.col(left).isNull(), F.col("n_chars")).otherwise(F.char_length(left)).cast(
        docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def _as_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [x.decode(errors="ignore") for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc", "left"])

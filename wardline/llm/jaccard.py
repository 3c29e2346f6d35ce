"""Exact n-gram Jaccard join with set-relation skipping.

Texts become sets of distinct word shingles; equal sets are one set from then on. A set is
listed under the tokens of its prefix (rarest first), so any two linked sets share a list.
Lists are worked off by relation, not pair by pair:

1. The set with the fewest rare tokens leads its list; lists of one leader become one, and
   every member is compared with the leader. Members that link with it answer for each
   other: pairs within one component need no comparison.
2. Lists with several components left are cut into cells of bounded size. In a cell the
   answers come from those of its set with the fewest rare tokens: any other is that set
   less what it lacks plus what it adds, so overlaps are one product over its tokens plus
   an index over the additions. Blocks of lists, ordered by size and position, are skipped when size or
   position rules out all their pairs.

Only links between different components leave a cell; components close them.

Cases: null or empty texts have no shingles, link with nothing and are their own
component; texts of fewer than ``words`` words are one shingle, their whole sequence;
repeated rows share a set; null ids take part but never name a component; other columns
are not read. Shingles and sets are 64-bit hashes."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, free_names, groups, partitions, slices, store
from .words import mix, text_bytes, words

#: Tokens in at most so many lists keep their exact frequency for the order of prefixes; it is
#: a bound on what every task holds, and touches speed only: any common order gives the same links.
FREQUENT = 1 << 19
#: Shingles of a cell's two sides; more go to more cells.
CELL = (1 << 16, 1 << 18)
_BLOCK = 32
_STEP = np.uint64(0x9FB21C651E98DF25)


def shingles(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row) of each row's distinct shingles, ordered by row and hash, and the size per row."""
    raw, off = text_bytes(text)
    h, _, _, row = words(raw, off)
    rows = len(off) - 1
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    start = np.arange(len(h))
    start = start[(start - first[row] == 0) | (start - first[row] + n <= count[row])]
    width = np.minimum(count[row[start]], n)
    out = np.zeros(len(start), np.uint64)
    for k in range(n):
        at = np.minimum(start + k, len(h) - 1)
        out = np.where(k < width, mix(out * _STEP + h[at]), out) if len(h) else out
    owner = row[start]
    if len(out):
        out = np.concatenate([np.sort(x) for x in np.split(out, np.flatnonzero(np.diff(owner)) + 1)])
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[new], owner[new]
    return out, owner, np.bincount(owner, minlength=rows)


def _sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    end = np.cumsum(size)
    return total[end] - total[end - size]


def set_ids(token: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set."""
    return mix(_sums(mix(token), size) ^ mix(_sums(mix(token ^ _STEP), size) + size.astype(np.uint64))).view(np.int64)


def _fresh(ids: np.ndarray, size: np.ndarray, seen: set[int]) -> np.ndarray:
    """Rows whose non-empty set this task meets for the first time."""
    out = np.zeros(len(ids), bool)
    for i, (s, n) in enumerate(zip(ids.tolist(), size.tolist())):
        if n and s not in seen:
            seen.add(s)
            out[i] = True
    return out


def _key():
    return F.xxhash64("doc_id", "text").alias("key")


def document_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, key, n_shingles, set_id) of every row; ``key`` names its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            token, _, size = shingles(b.column(2), n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size), pa.array(set_ids(token, size))],
                                             ["doc_id", "key", "n_shingles", "set_id"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _key(), "text").mapInArrow(run, f"doc_id {ids}, key long, n_shingles long, set_id long")


def _count_key(token: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    return (token % np.uint64(parts)).astype(np.int64), (token >> np.uint64(32)).astype(np.uint32)


def frequent_tokens(docs: DataFrame, n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the most frequent tokens, at most ``FREQUENT``. All tokens are counted,
    as packed 32-bit fingerprints within a part."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            part, key = _count_key(np.concatenate(held), parts)
            order = np.lexsort((key, part))
            part, key = part[order], key[order]
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            return pa.RecordBatch.from_arrays([pa.array(part[cut]), pa.array(
                [x.tobytes() for x in np.split(key, cut[1:])], pa.binary())], ["part", "keys"])

        for b in slices(batches):
            held.append(shingles(b.column(0), n)[0])
            size += len(held[-1])
            if size > 1 << 19:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def count(t: pa.Table) -> pa.Table:
        keys, c = np.unique(np.frombuffer(b"".join(t["keys"].to_pylist()), np.uint32), return_counts=True)
        keys, c = keys[c >= 8], c[c >= 8]
        part = t["part"][0].as_py()
        return pa.table({"key": (np.int64(part) << 32) | keys.astype(np.int64), "count": c.astype(np.int64)})

    counted = store(docs.select("text").mapInArrow(send, "part long, keys binary").groupBy("part")
                    .applyInArrow(count, "key long, count long"))
    level = F.floor(F.log2("count")).cast("int")
    least, total = None, 0
    for r in sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True):  # at most 64 rows
        if total + r["count"] > FREQUENT:
            break
        least, total = r["level"], total + r["count"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t = counted.where(level >= least).orderBy("key").toArrow()
    return np.array(t["key"], np.int64), np.array(t["count"], np.int64)


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of size n with any set that it links with."""
    return -(-n * percent // 100)


def leader_lists(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(leader, set_id, meta, leader_meta): the sets of all token lists that a set leads, itself
    included. ``meta`` holds size, first position in those lists and share of rare tokens. Two
    sets that share a prefix token share the leader of its list."""
    parts = 4 * partitions(docs.sparkSession)
    keys, counts = frequent_tokens(docs, n, parts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches):
            token, row, size = shingles(b.column(0), n)
            ids = set_ids(token, size)
            use = _fresh(ids, size, seen)
            token, row = token[use[row]], row[use[row]]
            size = np.where(use, size, 0)
            part, key = _count_key(token, parts)
            key = (part << 32) | key.astype(np.int64)
            at = np.searchsorted(keys, key)
            known = np.zeros(len(key), np.int64)
            if len(keys):
                hit = keys[np.minimum(at, len(keys) - 1)] == key
                known[hit] = counts[at[hit]]
            order = np.argsort((row << 36) | known, kind="stable")  # tokens are in order already
            token, row = token[order], row[order]
            first = np.cumsum(size) - size
            pos = np.arange(len(token)) - first[row]
            rare = 255 * np.bincount(row[known[order] == 0], minlength=len(size)) // np.maximum(size, 1)
            keep = pos <= (size - _needed(size, percent))[row]
            token, row, pos = token[keep], row[keep], pos[keep]
            meta = (size[row] << 33) | (pos << 8) | rare[row]
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(ids[row]), pa.array(meta)],
                                             ["token", "set_id", "meta"])

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "set_id", "meta", "leader", "leader_meta"]
        last = None  # (token, set, meta, leader, leader's meta, already sent, led by a late one)
        for b in batches:
            token, ids, meta = (b.column(k).to_numpy() for k in range(3))
            head = [np.array([x]) for x in last[:3]] if last else [np.zeros(0, np.int64)] * 3
            token, ids, meta = (np.concatenate(x) for x in zip(head, (token, ids, meta)))
            same = np.zeros(len(token), bool)
            same[1:] = token[1:] == token[:-1]
            again = np.zeros(len(token), bool)
            again[1:] = same[1:] & (ids[1:] == ids[:-1])
            token, ids, meta, same = (x[~again] for x in (token, ids, meta, same))
            late = np.concatenate([np.array([last[6]] if last else [], bool), b.column(3).to_numpy(zero_copy_only=False)])[~again]
            start = np.maximum.accumulate(np.where(same, 0, np.arange(len(token))))
            leader, leader_meta = ids[start], meta[start]
            if last:
                carried = start == 0
                leader[carried], leader_meta[carried] = last[3], last[4]
            multi = same.copy()
            multi[:-1] |= same[1:]
            if last and last[5]:
                multi[0] = False
            sent = bool(multi[-1]) or bool(last and last[5] and len(token) == 1)
            led_late = late[start]  # then no set of the list is early, and no pair needs it
            last = (token[-1], ids[-1], meta[-1], leader[-1], leader_meta[-1], sent, led_late[-1])
            multi &= ~led_late
            yield pa.RecordBatch.from_arrays([pa.array(x[multi]) for x in (token, ids, meta, leader, leader_meta)], names)

    lists = docs.select("text").mapInArrow(send, "token long, set_id long, meta long")
    # Of two linked sets the smaller has a shared token in this shorter prefix.
    size, pos = F.shiftright("meta", 33), F.shiftright("meta", 8).bitwiseAND((1 << 25) - 1)
    early = pos <= size - F.ceil(2 * percent * size / (100 + percent))
    lists = lists.withColumn("late", ~early).repartition(partitions(docs.sparkSession), "token").sortWithinPartitions(
        "token", "late", F.col("meta").bitwiseAND(255), "set_id")
    led = lists.mapInArrow(lead, "token long, set_id long, meta long, leader long, leader_meta long")
    return store(led.groupBy("leader", "set_id").agg(F.min("meta").alias("meta"), F.min("leader_meta").alias("leader_meta")))


def set_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, z): the compressed text of each key in ``wanted(key, set_id)``."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for b in slices(batches):
            z = [pack.compress(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z, pa.binary())], ["key", "z"])

    texts = docs.where("text is not null").select(_key(), "text").mapInArrow(send, "key long, z binary")
    return store(texts.join(wanted, "key").groupBy("key").agg(F.first("set_id").alias("set_id"), F.first("z").alias("z")).drop("key"))


def _sets(z: list[bytes], n: int) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    token, _, size = shingles(pa.array([unpack.decompress(x) for x in z], pa.large_binary()), n)
    return np.split(token, np.cumsum(size)[:-1])


def _links(overlap, na, nb, percent: int):
    return 100 * overlap >= percent * (na + nb - overlap)


def star_links(lists: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(u, v): members that link with the leader of one of their lists."""
    a, b = F.shiftright("leader_meta", 33), F.shiftright("meta", 33)
    pairs = lists.where((F.col("set_id") != F.col("leader")) & (100 * F.least(a, b) >= percent * F.greatest(a, b))) \
        .select(F.col("leader").alias("u"), F.col("set_id").alias("v"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders: dict[int, np.ndarray] = {}
        for b in slices(batches, "zv", 1 << 20):
            u = b.column("u").to_pylist()
            new = {x: z for x, z in zip(u, b.column("zu").to_pylist()) if x not in leaders}
            if len(leaders) > 256:
                leaders = {x: leaders[x] for x in set(u) if x in leaders}
            leaders |= dict(zip(new, _sets(list(new.values()), n)))
            ok = []
            for x, s in zip(u, _sets(b.column("zv").to_pylist(), n)):
                t = leaders[x]
                ok.append(_links(len(np.intersect1d(s, t, True)), len(s), len(t), percent))
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    member = pairs.join(texts.select(F.col("set_id").alias("v"), F.col("z").alias("zv")), "v")
    both = member.join(texts.select(F.col("set_id").alias("u"), F.col("z").alias("zu")), "u")
    return both.select("u", "v", "zu", "zv").mapInArrow(verify, "u long, v long")


def cell_pairs(a: list[np.ndarray], b: list[np.ndarray], base: np.ndarray, meta_a: np.ndarray, meta_b: np.ndarray,
               percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked sets, a x b. Overlaps are derived from those with the set ``base``."""
    def split(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        has = np.zeros((len(sets), len(base)), np.float32)
        token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(base, token), len(base) - 1)
        inside = base[at] == token
        has[owner[inside], at[inside]] = 1
        return has, token[~inside], owner[~inside]

    def order(meta: np.ndarray) -> list[np.ndarray]:
        by = np.lexsort(((meta >> 8) & ((1 << 25) - 1), meta >> 33))
        return np.split(by, range(_BLOCK, len(by), _BLOCK))

    has_a, more_a, own_a = split(a)
    has_b, more_b, own_b = split(b)
    by = np.argsort(more_b, kind="stable")
    more_b, own_b = more_b[by], own_b[by]
    na, nb = meta_a >> 33, meta_b >> 33
    rest_a = na - ((meta_a >> 8) & ((1 << 25) - 1))  # tokens from the shared one on
    rest_b = nb - ((meta_b >> 8) & ((1 << 25) - 1))
    blocks_b = [(k, nb[k].min(), nb[k].max(), rest_b[k].max()) for k in order(meta_b)]
    extra_start, extra_end = np.searchsorted(more_b, more_a, "left"), np.searchsorted(more_b, more_a, "right")
    for i in order(meta_a):
        low, high, rest = na[i].min(), na[i].max(), rest_a[i].max()
        j = [k for k, b_low, b_high, b_rest in blocks_b
             if 100 * b_high >= percent * low and 100 * high >= percent * b_low
             and (100 + percent) * min(rest, b_rest) >= percent * (low + b_low)]
        if not j:
            continue
        j = np.concatenate(j)
        overlap = has_a[i] @ has_b[j].T
        place_b = np.full(len(b), -1)
        place_b[j] = np.arange(len(j))
        place_a = np.full(len(a), -1)
        place_a[i] = np.arange(len(i))
        mine = np.flatnonzero(place_a[own_a] >= 0)
        n = extra_end[mine] - extra_start[mine]
        left = np.repeat(place_a[own_a[mine]], n)
        right = place_b[own_b[np.repeat(extra_start[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())]]
        np.add.at(overlap, (left[right >= 0], right[right >= 0]), 1)
        x, y = np.nonzero(_links(overlap.astype(np.int64), na[i][:, None], nb[j][None], percent))
        yield i[x], j[y]


def _with_partner(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows of lists, ordered by size, for which size and position allow a link with a set of another
    component that the leader's answers do not give."""
    for t in groups(batches, 1):
        meta, comp = t["meta"].to_numpy(), t["component"].to_numpy()
        size, rest = meta >> 33, (meta >> 33) - ((meta >> 8) & ((1 << 25) - 1))
        told = t["set_id"].to_numpy() == t["leader"].to_numpy()
        keep = np.zeros(len(meta), bool)
        for lo in range(0, len(meta), 256):
            i = np.arange(lo, min(lo + 256, len(meta)))
            j = np.arange(lo, np.searchsorted(size, size[i[-1]] * 100 // percent + 1, "right"))
            for j in np.split(j, range(4096, len(j), 4096)):
                a, b = size[i][:, None], size[j]
                ok = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
                ok &= (100 + percent) * np.minimum(rest[i][:, None], rest[j]) >= percent * (a + b)
                ok &= (comp[i][:, None] != comp[j]) & ~told[i][:, None] & ~told[j]
                keep[i] |= ok.any(1)
                keep[j] |= ok.any(0)
        yield from t.filter(pa.array(keep)).combine_chunks().to_batches()


def cell_links(lists: DataFrame, texts: DataFrame, component: DataFrame, n: int, percent: int) -> DataFrame:
    """(u, v): further links between sets of different components, one per set and component."""
    names = component.select(F.col("id").alias("set_id"), "component")
    named = lists.join(names, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    lead = names.select(F.col("set_id").alias("leader"), F.col("component").alias("main"))
    named = named.join(lead, "leader", "left").withColumn("other", F.coalesce("main", "leader") != F.col("component"))
    lone = named.groupBy("leader").agg(F.max(F.col("other").cast("int")).alias("any"), F.count("*").alias("n")).where("n > 2 and any = 1")
    dealt = named.join(lone.select("leader"), "leader").repartition(partitions(lists.sparkSession), "leader").sortWithinPartitions("leader", "meta")
    named = store(dealt.select("leader", "set_id", "meta", "component", "other").mapInArrow(
        lambda batches: _with_partner(batches, percent), "leader long, set_id long, meta long, component long, other boolean"))
    size = F.shiftright("meta", 33)
    open_lists = named.groupBy("leader").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("other"), size)).alias("others"), F.sum(F.when(~F.col("other"), size)).alias("mains")) \
        .where("n > 1 and others > 0").select(
            "leader", F.ceil(F.col("others") / CELL[0]).alias("no"), F.ceil(F.greatest("mains", F.lit(1)) / CELL[1]).alias("nm"))
    rows = named.join(open_lists, "leader").join(texts, "set_id").withColumn(
        "i", F.pmod(F.xxhash64("set_id"), F.when(F.col("other"), F.col("no")).otherwise(F.col("nm"))))

    def cells(count: str, cell) -> F.Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), F.col(count) - 1), lambda k: F.struct(
            *(x.alias(c) for x, c in zip(cell(k), ("kind", "i", "j", "left")))))

    i = F.col("i")
    with_main = cells("nm", lambda k: (F.lit(0), i, k, F.lit(True)))
    with_other = cells("no", lambda k: (F.lit(1), F.least(i, k), F.greatest(i, k), i <= k))
    of_main = cells("no", lambda k: (F.lit(0), k, i, F.lit(False)))
    rows = rows.withColumn("cell", F.explode(F.when(F.col("other"), F.concat(with_main, with_other)).otherwise(of_main)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for t in groups(batches, 4):
            held.append(t)
            size += t["z"].nbytes
            if size > 1 << 20:
                yield from links_of(held)
                held, size = [], 0
        yield from links_of(held)

    def links_of(cells_of: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        known = dict.fromkeys((i, z) for t in cells_of for i, z in zip(t["set_id"].to_pylist(), t["z"].to_pylist()))
        decoded = dict(zip((i for i, _ in known), _sets([z for _, z in known], n))) if known else {}
        for t in cells_of:
            left = t["left"].to_numpy()
            ids, meta, comp = t["set_id"].to_numpy(), t["meta"].to_numpy(), t["component"].to_numpy()
            a = np.flatnonzero(left)
            b = a if t["kind"][0].as_py() and t["i"][0] == t["j"][0] else np.flatnonzero(~left)
            if not len(a) or not len(b):
                continue
            sets = [decoded[k] for k in ids.tolist()]
            base = sets[int((meta & 255).argmin())]
            found: dict[tuple[int, int], tuple[int, int]] = {}
            for x, y in cell_pairs([sets[k] for k in a], [sets[k] for k in b], base, meta[a], meta[b], percent):
                for u, v in zip(a[x], b[y]):
                    if comp[u] != comp[v]:
                        found.setdefault((ids[u], comp[v]), (ids[u], ids[v]))
            if found:
                u, v = np.array(list(found.values())).T
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    cell = ["leader", "kind", "i", "j"]
    rows = rows.select("leader", "cell.kind", "cell.i", "cell.j", "cell.left", "set_id", "meta", "component", "z")
    return rows.repartition(partitions(lists.sparkSession), *cell).sortWithinPartitions(*cell).mapInArrow(work, "u long, v long")


def _components(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``document_sets``, and (set_id, component) of every set that is not empty."""
    rows = store(document_sets(docs, words))
    lists = leader_lists(docs, words, percent)
    one = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("key").alias("key"))
    texts = set_texts(docs, one.join(lists.select("set_id").distinct(), "set_id", "left_semi"))
    star = store(star_links(lists, texts, words, percent))
    first = components(star)
    links = star.union(cell_links(lists, texts, first, words, percent))
    closed = components(links).select(F.col("id").alias("set_id"), "component")
    return rows, one.join(closed, "set_id", "left").select("set_id", F.coalesce("component", "set_id").alias("component"))


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: link where 100 |A and B| >= percent |A or B|."""
    rows, sets = _components(docs, words, percent)
    own = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    named = own.join(sets, "set_id")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = named.join(least, "component").select("set_id", "component_id")
    return rows.join(by_set, "set_id", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their group: of the least
    id (none is last), then of the least hash of id and text; of equal ones a single row. Rows without
    words are linked with nothing and stay."""
    rows, sets = _components(docs.select("doc_id", "text"), words, percent)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"]
    texts = rows.where("n_shingles > 0").join(sets, "set_id").groupBy("component", "key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    best = texts.groupBy("component").agg(first.alias("best"))
    ranked = texts.join(best, "component").withColumn("stays", F.col("key") == F.col("best"))
    # only the keys that need something are stored: the planner sees how few they are
    acted = store(ranked.where(~F.col("stays") | (F.col("n") > 1)).select("key", "stays"))
    key, = free_names(docs, "key")
    kept = docs.withColumn(key, _key()).join(acted.where(~F.col("stays")).select(F.col("key").alias(key)), key, "left_anti")
    many = acted.where("stays").select(F.col("key").alias(key))
    if many.isEmpty():
        return kept.select(*(f"`{c}`" for c in docs.columns))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = kept.join(many, key, "left_semi").groupBy(key).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row"))
    return kept.join(many, key, "left_anti").select(*(f"`{c}`" for c in docs.columns)).unionByName(once.select("row.*"))

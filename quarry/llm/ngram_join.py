"""N-gram Jaccard self-join with adaptive multi-match prefixes (operator 10).

Texts become sets of word shingles. A global order puts the shingles known to be
shared last (by estimated count, then hash). With own-overlap bound
``c = ceil(t n)``, a document publishes its first ``n - c + l`` shingles, and ``l``
grows with the estimated cost of its candidates. Two linked documents share at
least ``min(l)`` published shingles, and in general, with ``s`` shared ones and
published lengths ``p``, at most ``s + max(n - p)`` shingles: a pair below the
overlap its two sizes call for is dropped before any set is shipped. What remains
is verified on the whole sets.

Only connections are asked for, so near-copy groups are collapsed on the way: a
leader round links every document to one central partner, and the closing round
tests every candidate whose members still lie in different components, those of
frequent shingles tile by tile. No candidate between two components goes untested;
pairs inside one are not made.

The order only steers cost. Any order gives the same links, which is why the
estimated counts may come from chunk-wise counting and a bounded list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import byte_batches, components, discard, released, written

SHINGLE = 5
PERCENT = 75
FLUSH = 4_000_000  # shingles counted together in one task
LOCAL_MIN = 4  # a chunk reports a shingle that this many of its documents share
MAX_HEAVY = 1_000_000  # entries of the broadcast count list: 16 MB at most
MIN_EXTRA, MAX_EXTRA = 3, 16  # shortest and longest extension of a prefix
UNKNOWN_SHARE = 8  # one in so many shingles without a count is taken to have a partner
BUCKET_TOKENS = 2_000_000  # published shingles in one pruning task
DIGEST = 40  # bits of a published shingle that are compared before any is sent whole
MAX_FILTER = 29  # the broadcast filter of shared digests has 2 to this power bits (64 MB) at most
HOT_POSTING = 32  # a shingle that more classes publish is handled by tiles, not pairs
BITS = 2048  # parity bits of a set; in tiles, of a larger set two for a shingle at least
TILE_DOCS = 1_000
TILE_TOKENS = 2_000_000
BROADCAST_IDS = 1_000_000  # candidate ids broadcast at most (8 MB); more are joined by shuffle
MAX_LABELS = 4_000_000  # classes with their component, of those that the leader round linked, broadcast at most (64 MB)


def _signature(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set: the class id and its check."""
    if not len(s):
        return 0, 0
    n = np.uint64(len(s))
    a = W.mix(np.array([np.add.reduce(W.mix(s)) + n], np.uint64))
    b = W.mix(np.array([np.bitwise_xor.reduce(W.mix(s * np.uint64(0xA0761D6478BD642F) + n))], np.uint64))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    hashes, offsets = W.batch_words(batch.column("text"))
    for i in range(batch.num_rows):
        yield i, W.shingle_set(hashes[offsets[i] : offsets[i + 1]], k)


def _profile(k: int, hashed: bool = False):
    """Per row its set size and class (``hashed``: and its text_hash); per chunk the
    shingles shared in it."""

    def run(batches):
        pending, size, seen = [], 0, set()

        def flush():
            u, c = np.unique(np.concatenate(pending), return_counts=True)
            keep = c >= LOCAL_MIN
            m = int(keep.sum())
            none = pa.nulls(m, pa.int64())
            return pa.RecordBatch.from_arrays(
                [none, none, pa.array(u[keep].view(np.int64)), none, pa.array(c[keep].astype(np.int64))],
                names=["doc_id", "n", "node", "check", "shared"],
            )

        def with_hash(rows, hashes):
            return rows.append_column("text_hash", hashes) if hashed else rows

        for batch in batches:
            n, node, check = [], [], []
            for _, s in _sets(batch, k):
                a, b = _signature(s)
                n.append(len(s))
                node.append(a)
                check.append(b)
                if len(s) and a not in seen:
                    seen.add(a)
                    pending.append(s)
                    size += len(s)
            rows = pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(node, pa.int64()),
                    pa.array(check, pa.int64()),
                    pa.nulls(len(n), pa.int64()),
                ],
                names=["doc_id", "n", "node", "check", "shared"],
            )
            yield with_hash(rows, batch.column("text_hash") if hashed else None)
            if size >= FLUSH:
                shared = flush()
                yield with_hash(shared, pa.nulls(shared.num_rows, pa.int64()))
                pending, size, seen = [], 0, set()
        if pending:
            shared = flush()
            yield with_hash(shared, pa.nulls(shared.num_rows, pa.int64()))

    return run


def required(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any set it links to."""
    return -(-percent * n // 100)


def _prefix(s: np.ndarray, hashes: np.ndarray, counts: np.ndarray, percent: int):
    """(published shingles, estimated candidate cost) of one set."""
    n = len(s)
    if len(hashes):
        at = np.searchsorted(hashes, s)
        at[at == len(hashes)] = 0
        df = np.where(hashes[at] == s, counts[at], 0)
        order = np.argsort(df, kind="stable")  # s is sorted: ties by hash
        s, df = s[order], df[order]
    else:
        df = np.zeros(n, np.int64)
    c = required(n, percent)
    # postings that the shortest prefix reads; a shingle not known to be shared still
    # has a small chance of a partner
    cost = int(df[: n - c + 1].sum()) + (n - c + 1) // UNKNOWN_SHARE
    extra = min(MIN_EXTRA + int(math.log2(1 + cost)), MAX_EXTRA, c)
    return s[: n - c + extra], cost


# a published shingle, its class, the set's size, the prefix's extension and its cost
_ENTRY = np.dtype([("token", "<u8"), ("node", "<i8"), ("n", "<u4"), ("extra", "u1"), ("cost", "<u4")])


def _pack(e: np.ndarray) -> bytes:
    """Entries as compressed byte planes in token order: the high bytes of tokens, sizes
    and costs repeat, so a plane of them takes little room in the shuffle."""
    e = e[np.argsort(e["token"], kind="stable")]
    planes = np.frombuffer(e.tobytes(), np.uint8).reshape(len(e), _ENTRY.itemsize)
    body = pa.compress(np.ascontiguousarray(planes.T), codec="zstd", asbytes=True)
    return np.uint32(len(e)).tobytes() + body


def _unpack(packed: pa.BinaryScalar) -> np.ndarray:
    data = packed.as_buffer()
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    planes = pa.decompress(data.slice(4), decompressed_size=n * _ENTRY.itemsize, codec="zstd")
    rows = np.frombuffer(planes, np.uint8).reshape(_ENTRY.itemsize, n).T
    return np.ascontiguousarray(rows).reshape(-1).view(_ENTRY)


def _prefixes(batches, k: int, percent: int, heavy, seen: set):
    """``(class, set size, prefix, cost)`` of every set with shingles; copies of a set in
    ``seen`` are passed over."""
    hashes, counts = heavy.value
    for batch in batches:
        for _, s in _sets(batch, k):
            if not len(s):
                continue
            a, _ = _signature(s)
            if a not in seen:
                seen.add(a)
                yield a, len(s), *_prefix(s, hashes, counts, percent)


def _pack_digests(d: np.ndarray) -> bytes:
    """Sorted digests as compressed byte planes of their differences."""
    steps = np.diff(d, prepend=np.uint64(0)).astype("<u8")
    planes = steps.view(np.uint8).reshape(len(d), 8)[:, : DIGEST // 8]
    body = pa.compress(np.ascontiguousarray(planes.T), codec="zstd", asbytes=True)
    return np.uint32(len(d)).tobytes() + body


def _unpack_digests(packed: pa.BinaryScalar) -> np.ndarray:
    data = packed.as_buffer()
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    planes = pa.decompress(data.slice(4), decompressed_size=n * (DIGEST // 8), codec="zstd")
    steps = np.zeros((n, 8), np.uint8)
    steps[:, : DIGEST // 8] = np.frombuffer(planes, np.uint8).reshape(DIGEST // 8, n).T
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


def _announce(k: int, percent: int, buckets: int, heavy):
    """Digests of published shingles by bucket (their highest bits), packed: one row per
    bucket and chunk. A digest that a chunk holds more than once comes twice."""

    def run(batches):
        toks, size, seen = [], 0, set()

        def flush():
            d = np.sort(np.concatenate(toks) >> np.uint64(64 - DIGEST))
            third = np.zeros(len(d), bool)
            third[2:] = (d[2:] == d[1:-1]) & (d[1:-1] == d[:-2])
            d = d[~third]
            b = (d >> np.uint64(DIGEST - buckets)).astype(np.int32)
            cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            ends = np.r_[cuts[1:], len(b)]
            return pa.RecordBatch.from_arrays(
                [pa.array(b[cuts]), pa.array([_pack_digests(d[i:j]) for i, j in zip(cuts, ends)], pa.binary())],
                names=["bucket", "digests"],
            )

        for _, _, prefix, _ in _prefixes(batches, k, percent, heavy, seen):
            toks.append(prefix)
            size += len(prefix)
            if size >= FLUSH:
                yield flush()
                toks, size = [], 0
                seen.clear()
        if size:
            yield flush()

    return run


def _announced_twice(buckets: int, bits: int):
    """Per bucket its part of the filter: a bit for every digest that came more than once."""

    def run(batches):
        packed = [_unpack_digests(x) for batch in batches for x in batch.column("digests")]
        if not packed:
            return
        d = np.concatenate(packed)
        del packed
        d.sort()
        d = d[1:][d[1:] == d[:-1]] >> np.uint64(DIGEST - bits)
        b = (d >> np.uint64(bits - buckets)).astype(np.int32)
        for bucket in np.unique(b):
            mark = np.zeros(1 << (bits - buckets), bool)
            mark[(d[b == bucket] & np.uint64(len(mark) - 1)).astype(np.int64)] = True
            part = pa.compress(np.packbits(mark, bitorder="little"), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([part], pa.binary())], names=["bucket", "part"]
            )

    return run


def _least_shared(n: int, percent: int) -> int:
    """Published shingles that a set of ``n`` has in common with any set it links to, at
    least: the smaller of two extensions."""
    return min(MIN_EXTRA, required(required(n, percent), percent))


def _publish(k: int, percent: int, buckets: int, heavy, shared):
    """Published shingles that others may publish too by bucket, packed: one row per
    bucket and chunk. Copies of one set inside a chunk are published once, and sets with
    too few such shingles for any link not at all."""

    def run(batches):
        bits, marks = shared.value
        toks, heads, size, seen = [], [], 0, set()

        def flush():
            t = np.concatenate(toks)
            e = np.empty(len(t), _ENTRY)
            e["token"] = t
            lengths = [len(x) for x in toks]
            for name, column in zip(("node", "n", "extra", "cost"), zip(*heads)):
                e[name] = np.repeat(np.array(column, np.int64), lengths)
            b = (t % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(b, kind="stable")
            e, b = e[order], b[order]
            cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            ends = np.r_[cuts[1:], len(b)]
            return pa.RecordBatch.from_arrays(
                [pa.array(b[cuts]), pa.array([_pack(e[i:j]) for i, j in zip(cuts, ends)], pa.binary())],
                names=["bucket", "entries"],
            )

        for a, n, prefix, cost in _prefixes(batches, k, percent, heavy, seen):
            at = (prefix >> np.uint64(64 - bits)).astype(np.int64)
            sent = prefix[(marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
            if len(sent) < _least_shared(n, percent):
                continue
            toks.append(sent)
            extra = len(prefix) - n + required(n, percent)
            heads.append((a, n, extra, min(cost, 0xFFFFFFFF)))
            size += len(sent)
            if size >= FLUSH // 4:
                yield flush()
                toks, heads, size = [], [], 0
                seen.clear()
        if size:
            yield flush()

    return run


POSTING = (
    "token long, m long, lead long, lead_n long, lead_p long, members array<struct<node:bigint,n:bigint,p:bigint>>"
)


def _common(batches, percent: int, per_row: int):
    """Published shingles that two classes or more have in common, of one partition,
    each with its posting's size and leader (the class of the highest cost) and its
    members; beyond ``per_row`` of them the shingle has several rows."""
    packed = [_unpack(x) for batch in batches for x in batch.column("entries")]
    if not packed:
        return
    e = np.concatenate(packed)
    del packed
    # tokens seen once go first: most of them
    order = np.argsort(e["token"], kind="stable")
    t = e["token"][order]
    same = np.zeros(len(t), bool)
    same[1:] = t[1:] == t[:-1]
    same[:-1] |= t[1:] == t[:-1]
    e = e[order[same]]
    e = e[np.lexsort((e["node"], e["cost"], e["token"]))]
    if not len(e):
        return
    fresh = np.ones(len(e), bool)  # copies of one set from several chunks
    fresh[1:] = (e["token"][1:] != e["token"][:-1]) | (e["node"][1:] != e["node"][:-1])
    e = e[fresh]
    cuts = np.flatnonzero(np.r_[True, e["token"][1:] != e["token"][:-1]])
    m = np.diff(np.r_[cuts, len(e)])
    cuts, m = cuts[m > 1], m[m > 1]
    rows = -(-m // per_row)
    nth = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
    start = np.repeat(cuts, rows) + nth * per_row
    size, last = np.repeat(m, rows), np.repeat(cuts + m - 1, rows)
    length = np.minimum(size - nth * per_row, per_row)
    for i in range(0, len(start), 10_000):
        some = length[i : i + 10_000]
        offsets = np.r_[0, np.cumsum(some)]
        x = e[np.arange(offsets[-1]) + np.repeat(start[i : i + 10_000] - offsets[:-1], some)]
        lead = e[last[i : i + 10_000]]
        n, lead_n = x["n"].astype(np.int64), lead["n"].astype(np.int64)
        p = n - required(n, percent) + x["extra"]
        lead_p = lead_n - required(lead_n, percent) + lead["extra"]
        members = pa.StructArray.from_arrays(
            [pa.array(c.astype(np.int64)) for c in (x["node"], n, p)], names=["node", "n", "p"]
        )
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(lead["token"].copy().view(np.int64)),
                *(pa.array(c.astype(np.int64)) for c in (size[i : i + 10_000], lead["node"], lead_n, lead_p)),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), members),
            ],
            names=["token", "m", "lead", "lead_n", "lead_p", "members"],
        )


def _gathered(batches, rows: int) -> Iterator[pa.Array]:
    """The members of ``rows`` postings at a time."""
    some, size = [], 0
    for batch in batches:
        some.append(batch.column("members"))
        size += batch.num_rows
        if size >= rows:
            yield pa.concat_arrays(some)
            some, size = [], 0
    if size:
        yield pa.concat_arrays(some)


def _found(known: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``x`` in the sorted ``known``, and whether they are there."""
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return at, known[at] == x


def _spanning(batches, labels):
    """``(node, n, p, component)``, each ``(postings, members)``, of some postings of one
    size that more than one component publishes."""
    known, component = labels.value
    for members in _gathered(batches, 16_384):
        sizes = np.diff(members.offsets.to_numpy())
        node, n, p = (members.flatten().field(c).to_numpy(zero_copy_only=False) for c in range(3))
        begin = np.cumsum(sizes) - sizes
        comp = node
        if len(known):
            at, there = _found(known, node)
            comp = np.where(there, component[at], node)
        for size in np.unique(sizes):
            at = begin[sizes == size][:, None] + np.arange(size)
            c = comp[at]
            at = at[(c != c[:, :1]).any(axis=1)]
            if len(at):
                yield node[at], n[at], p[at], comp[at]


def _few_pairs(labels, percent: int):
    """Pairs of classes of different components and similar sizes, once for every posting."""

    def run(batches):
        for node, n, p, comp in _spanning(batches, labels):
            i, j = np.triu_indices(node.shape[1], 1)
            step = max(1, 100_000 // len(i))
            for r in range(0, len(node), step):
                some = slice(r, r + step)
                na, nb = n[some][:, i], n[some][:, j]
                keep = comp[some][:, i] != comp[some][:, j]
                keep &= 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
                a, b = node[some][:, i][keep], node[some][:, j][keep]
                columns = [a, na[keep], p[some][:, i][keep]], [b, nb[keep], p[some][:, j][keep]]
                columns = [np.where(a < b, x, y) for x, y in zip(*columns)] + [np.where(a < b, y, x) for x, y in zip(*columns)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], names=["a", "na", "pa", "b", "nb", "pb"]
                )

    return run


def _few_counts(labels, asked):
    """Postings that more than one component publishes by class, of the classes ``asked``
    (None: of all), summed within ``FLUSH`` of them."""

    def run(batches):
        wanted = asked.value
        pending, size = [], 0

        def counted():
            u, c = np.unique(np.concatenate(pending), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(c.astype(np.int64))], names=["node", "shared"])

        for node, *_ in _spanning(batches, labels):
            node = node.reshape(-1)
            if wanted is not None:
                node = node[_found(wanted, node)[1]] if len(wanted) else node[:0]
            pending.append(node)
            size += len(node)
            if size >= FLUSH:
                yield counted()
                pending, size = [], 0
        if pending:
            yield counted()

    return run


def _parities(s: np.ndarray, bits: int) -> np.ndarray:
    odd = np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool))


def _full_sets(k: int):
    def run(batches):
        for batch in batches:
            node, bits, wide, sets = [], [], [], []
            for _, s in _sets(batch, k):
                node.append(_signature(s)[0])
                bits.append(_parities(s, BITS).view(np.int64))
                wide.append(_parities(s, max(BITS, 1 << (2 * len(s)).bit_length())).tobytes() if 2 * len(s) > BITS else None)
                sets.append(s.view(np.int64))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), pa.array(bits, lists), pa.array(wide, pa.binary()), pa.array(sets, lists)],
                names=["node", "bits", "wide", "tokens"],
            )

    return run


class NgramJoin:
    """Links of ``docs(doc_id, text)``; see :func:`classes`."""

    def __init__(self, docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT):
        self.docs = docs.select("doc_id", "text")
        self.spark = docs.sparkSession
        self.k, self.percent = shingle, percent
        byte_batches(self.spark)

    # -- pass 1: sizes, classes of equal sets, shared shingles ------------------

    def profile(self, hashed: bool = False) -> DataFrame:
        docs = self.docs.withColumn("text_hash", F.xxhash64("text")) if hashed else self.docs
        both = written(
            docs.mapInArrow(
                _profile(self.k, hashed),
                "doc_id long, n long, node long, check long, shared long" + ", text_hash long" * hashed,
            )
        )
        self.rows = both.where("shared is null").drop("shared")
        heavy = (
            both.where("shared is not null")
            .groupBy("node")
            .agg(F.sum("shared").alias("df"))
            .orderBy(F.desc("df"), "node")
            .limit(MAX_HEAVY)
            .toArrow()
        )
        h = heavy.column("node").to_numpy().view(np.uint64)
        c = heavy.column("df").to_numpy()
        order = np.argsort(h)
        self.heavy = self.spark.sparkContext.broadcast((h[order], c[order]))
        if not self.rows.where("n > 0").groupBy("node").agg(
            F.min("check").alias("a"), F.max("check").alias("b")
        ).where("a <> b").isEmpty():
            raise RuntimeError("two sets share a 64-bit class id; choose another shingle hash")
        self.reps = written(
            self.rows.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"))
        )
        ids = self.rows.where("n > 0 and doc_id is not null").select("doc_id").distinct()
        copies = written(ids.join(self.reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti"))
        many = copies.count()
        if many > BROADCAST_IDS:  # the others publish the same shingles once more
            copies = copies.where(F.pmod(F.xxhash64("doc_id"), F.lit(many)) < BROADCAST_IDS)
        known = self.docs.where("doc_id is not null and text is not null")
        self.known = known.join(F.broadcast(copies), "doc_id", "left_anti") if many else known
        return self.rows

    # -- pass 2: published shingles in common ------------------------------------

    def postings(self) -> DataFrame:
        """A row for each published shingle of two classes or more, with its classes."""
        total = self.rows.agg(F.sum("n")).first()[0] or 0
        published = total * (100 - self.percent) // 100
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-published // BUCKET_TOKENS))
        shared = self._shared(published, parts)
        packed = self.known.mapInArrow(
            _publish(self.k, self.percent, 8 * parts, self.heavy, shared), "bucket int, entries binary"
        ).repartition(parts, "bucket")
        percent, per_row = self.percent, max(HOT_POSTING, 32)
        self.post = written(packed.mapInArrow(lambda batches: _common(batches, percent, per_row), POSTING))
        return self.post

    def _shared(self, published: int, parts: int):
        """Broadcast ``(bits, marks)``: a filter, by their highest bits, of the shingles that
        more than one set publishes. It passes all of those and a few others."""
        bits = min(max(16, published.bit_length() + 1), MAX_FILTER)
        buckets = min(bits - 3, (2 * parts - 1).bit_length())  # 2 to this power, of whole bytes of the filter
        digests = self.known.mapInArrow(
            _announce(self.k, self.percent, buckets, self.heavy), "bucket int, digests binary"
        ).repartition(parts, "bucket")
        found = digests.mapInArrow(_announced_twice(buckets, bits), "bucket int, part binary").toArrow()
        marks = np.zeros(1 << (bits - 3), np.uint8)
        width = 1 << (bits - buckets - 3)
        for bucket, part in zip(found.column("bucket").to_pylist(), found.column("part")):
            data = pa.decompress(part.as_buffer(), decompressed_size=width, codec="zstd")
            marks[bucket * width : (bucket + 1) * width] = np.frombuffer(data, np.uint8)
        return self.spark.sparkContext.broadcast((bits, marks))

    # -- candidates ----------------------------------------------------------------

    def _similar_size(self, a: str, b: str) -> str:
        return f"100 * least({a}, {b}) >= {self.percent} * greatest({a}, {b})"

    def _enough(self, s: str, na: str, pa_: str, nb: str, pb: str) -> str:
        """SQL: sets that share ``s`` published shingles may reach the threshold."""
        t = self.percent
        return f"{100 + t} * ({s} + greatest({na} - {pa_}, {nb} - {pb})) >= {t} * ({na} + {nb})"

    def _sets_of(self, nodes: DataFrame) -> DataFrame:
        """``(node, bits, tokens)``: the whole sets of ``nodes(node)``, read from their
        representatives' texts, and the parities of their shingles by bit (``wide``: of more
        bits, for larger sets)."""
        ids = written(nodes.join(self.reps, "node").select(F.col("rep").alias("doc_id")))
        if ids.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        texts = self.docs.join(ids, "doc_id", "left_semi")
        columns = "node long, bits array<bigint>, wide binary, tokens array<bigint>"
        return written(texts.mapInArrow(_full_sets(self.k), columns))

    def _sets_named(self, sets: DataFrame, nodes: DataFrame) -> DataFrame:
        """The sets of ``nodes`` alone, so that no other is shuffled."""
        nodes = written(nodes.distinct())
        if nodes.count() <= BROADCAST_IDS:
            nodes = F.broadcast(nodes)
        return sets.join(nodes, "node", "left_semi")

    def _verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of ``pairs(a, b)`` whose whole sets reach the threshold.

        Two sets differ in at least as many shingles as their parity bits do, which
        bounds the overlap: few pairs below the threshold get their sets shipped.
        """
        bits_a = sets.select(F.col("node").alias("a"), F.col("bits").alias("u"), F.size("tokens").alias("na"))
        bits_b = sets.select(F.col("node").alias("b"), F.col("bits").alias("v"), F.size("tokens").alias("nb"))
        apart = F.expr("aggregate(zip_with(u, v, (i, j) -> bit_count(i ^ j)), 0, (t, i) -> t + i)")
        pairs = written(
            pairs.join(bits_a, "a")
            .join(bits_b, "b")
            .withColumn("most", (F.col("na") + F.col("nb") - apart) / 2)
            .where(f"100 * most >= {self.percent} * (na + nb - most)")
            .select("a", "b")
        )
        # the sets of a go straight to their partners where the pairs can be broadcast
        left = self._sets_named(sets, pairs.select(F.col("a").alias("node")))
        left = left.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
        right = self._sets_named(sets, pairs.select(F.col("b").alias("node")))
        right = right.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
        few = F.broadcast(pairs) if pairs.count() <= BROADCAST_IDS else pairs
        return (
            left.join(few, "a")
            .join(right, "b")
            .withColumn("both", F.size(F.array_intersect("x", "y")))
            .where(f"100 * both >= {self.percent} * (size(x) + size(y) - both)")
            .select("a", "b")
        )

    def _leader_round(self) -> DataFrame:
        """``(id, component)`` after linking each class to the leader it shares most
        published shingles with. A leader outranks its followers, so the links form
        trees, and doubling the pointers finds the roots."""
        counted = (
            self.post.select("lead", "lead_n", "lead_p", F.inline("members"))
            .where("node <> lead")
            .where(self._similar_size("n", "lead_n"))
            .groupBy("node", "n", "p", "lead", "lead_n", "lead_p")
            .agg(F.count("*").alias("s"))
        )
        best = (
            counted.where(self._enough("s", "n", "p", "lead_n", "lead_p"))
            .groupBy(F.col("node").alias("a"))
            .agg(F.max(F.struct("s", "lead")).alias("m"))
            .select("a", F.col("m.lead").alias("b"))
        )
        pairs = written(best)
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        sets = self._sets_of(nodes)
        tree = written(self._verified(pairs, sets))
        discard(sets)
        while True:
            up = tree.select(F.col("a").alias("b"), F.col("b").alias("c"))
            after = written(tree.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"), "c"))
            tree = after.select("a", "b")
            if after.where("c is not null").isEmpty():
                return tree.select(F.col("a").alias("id"), F.col("b").alias("component"))

    def _remaining(self, comp: DataFrame) -> DataFrame:
        """Links between different components: all of them up to connection.

        Shingles that few classes publish give candidate pairs, counted and filtered.
        The classes of a shingle that many publish meet in their leader's block, which
        is compared tile by tile; a tile reports links that join its components, never
        its pairs. Both ways verify whole sets.
        """
        percent, labels = self.percent, self._labels(comp)
        columns = "a long, na long, pa long, b long, nb long, pb long"
        pairs = written(
            self.post.where(f"m <= {HOT_POSTING}")
            .mapInArrow(_few_pairs(labels, percent), columns)
            .groupBy("a", "na", "pa", "b", "nb", "pb")
            .agg(F.count("*").alias("s"))
            .where(self._enough("s", "na", "pa", "nb", "pb"))
            .select("a", "b")
        )

        hot = self.post.where(f"m > {HOT_POSTING}").select("token", "lead", F.inline("members"))
        few = F.broadcast(comp) if comp.count() <= BROADCAST_IDS else comp
        hot = written(
            hot.join(few, hot.node == few.id, "left").select(*hot.columns, F.coalesce("component", "node").alias("comp"))
        )
        spans = hot.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        hot = written(hot.join(spans.select("token"), "token", "left_semi"))
        tiles = self._tiles(hot, labels)
        nodes = (
            pairs.select(F.col("a").alias("node"))
            .union(pairs.select(F.col("b").alias("node")))
            .union(tiles.select("node"))
            .distinct()
        )
        sets = self._sets_of(nodes)
        place = ["block", "kind", "lo", "hi"]
        outlines = sets.select("node", F.size("tokens").alias("n"), "bits", "wide")
        outlines = self._sets_named(outlines, tiles.select("node"))
        chosen = tiles.join(outlines, "node").groupBy(*place).applyInArrow(
            _tile_partners(percent), "block long, kind string, lo int, hi int, node long"
        )
        tiles = written(tiles.join(written(chosen), [*place, "node"], "left_semi"))
        in_tiles = self._sets_named(sets, tiles.select("node")).select("node", "tokens")
        blocks = tiles.join(in_tiles, "node").groupBy(*place).applyInArrow(_tile_links(percent), "a long, b long")
        links = written(self._verified(pairs, sets).union(blocks))
        discard(sets)
        return links

    def _labels(self, comp: DataFrame):
        """``comp(id, component)`` broadcast, sorted by id. Beyond ``MAX_LABELS``, a part of
        them: the other classes stand alone, and pairs inside their components are made."""
        many = comp.count()
        if many > MAX_LABELS:
            comp = comp.where(F.pmod(F.xxhash64("id"), F.lit(many)) < MAX_LABELS)
        got = comp.toArrow()
        known, component = got.column("id").to_numpy(), got.column("component").to_numpy()
        order = np.argsort(known)
        return self.spark.sparkContext.broadcast((known[order], component[order]))

    def _tiles(self, post: DataFrame, labels) -> DataFrame:
        """``(block, kind, lo, hi, node, comp, part)``: which classes meet in which tile.

        Two linked classes share at least the smaller of their extensions, so one with
        fewer shared shingles in all than any extension in its block stays out of it.
        In a block, the classes outside its largest component (R) meet each other and
        those inside it (A). Both are dealt by hash to tiles of bounded size, and every
        pair of tiles that has work to do becomes one task.
        """
        hot = (
            post.select(F.col("lead").alias("block"), "node", "n", "p", "comp")
            .distinct()
            .withColumn("extra", F.expr(f"p - n + ceil({self.percent} * n / 100)"))
        )
        nodes = written(hot.select("node").distinct())
        asked = np.sort(nodes.toArrow().column("node").to_numpy()) if nodes.count() <= MAX_LABELS else None
        few = self.post.where(f"m <= {HOT_POSTING}").mapInArrow(
            _few_counts(labels, self.spark.sparkContext.broadcast(asked)), "node long, shared long"
        )
        counts = few.union(post.groupBy("node").agg(F.count("*").alias("shared")))
        shared = counts.groupBy("node").agg(F.sum("shared").alias("shared"))
        least = hot.groupBy("block").agg(F.min("extra").alias("least"))
        members = written(
            hot.join(least, "block").join(shared, "node").where("shared >= least").select("block", "node", "n", "comp")
        )
        sizes = members.groupBy("block", "comp").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))
        stats = (
            sizes.groupBy("block")
            .agg(
                F.max(F.struct("docs", "comp", "tokens")).alias("top"),
                F.sum("docs").alias("docs"),
                F.sum("tokens").alias("tokens"),
                F.count("*").alias("comps"),
            )
            .where("comps > 1")
            .select(
                "block",
                F.col("top.comp").alias("main"),
                F.expr(
                    f"cast(greatest(ceil((docs - top.docs) / {TILE_DOCS}), ceil((tokens - top.tokens) / {TILE_TOKENS}))"
                    " as int)"
                ).alias("nr"),
                F.expr(
                    f"cast(greatest(ceil(top.docs / {TILE_DOCS}), ceil(top.tokens / {TILE_TOKENS})) as int)"
                ).alias("na"),
            )
        )
        placed = (
            members.join(stats, "block")
            .withColumn("rest", F.expr("comp <> main"))
            .withColumn("tile", F.expr("cast(pmod(xxhash64(node), if(rest, nr, na)) as int)"))
        )
        with_rest = "transform(sequence(0, nr - 1), j -> named_struct('kind', 'R', 'lo', least(tile, j), 'hi', greatest(tile, j), 'part', if(tile <= j, 0, 1)))"
        with_main = "transform(sequence(0, na - 1), j -> named_struct('kind', 'A', 'lo', tile, 'hi', j, 'part', 0))"
        as_main = "transform(sequence(0, nr - 1), i -> named_struct('kind', 'A', 'lo', i, 'hi', tile, 'part', 1))"
        keys = F.expr(f"if(rest, concat({with_rest}, {with_main}), {as_main})")
        return written(placed.select("block", "node", "comp", F.inline(keys)))

    def components(self) -> DataFrame:
        """``(node, component)`` of every class that has a link."""
        self.postings()
        released(self.spark)
        trees = self._leader_round()
        released(self.spark)
        rest = self._remaining(trees)
        discard(self.post)
        released(self.spark)
        up = trees.select(F.col("id").alias("a"), F.col("component").alias("ca"))
        to = trees.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        edges = written(
            rest.join(up, "a", "left")
            .join(to, "b", "left")
            .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
            .where("a <> b")
        )
        roots = trees.select("id", "component").union(
            trees.select(F.col("component").alias("id"), "component").distinct()
        )
        if edges.isEmpty():
            return roots
        joined = components(edges).select(F.col("id").alias("component"), F.col("component").alias("top"))
        return roots.join(joined, "component", "full").select(
            F.coalesce("id", "component").alias("id"), F.coalesce("top", "component").alias("component")
        )


def _folded(parity: np.ndarray, bits: int) -> np.ndarray:
    """Parities of ``bits`` bits, from those of more."""
    while parity.shape[1] * 8 > bits:
        half = parity.shape[1] // 2
        parity = parity[:, :half] ^ parity[:, half:]
    return np.ascontiguousarray(parity).view(np.uint64)


def _tile_partners(percent: int):
    """The classes of a tile pair that the parities leave a partner in another component."""

    def run(key, table):
        inside = key[1].as_py() == "R" and key[2] == key[3]
        node, comp, part, n = (table.column(c).to_numpy() for c in ("node", "comp", "part", "n"))
        narrow, wide = table.column("bits").to_pylist(), table.column("wide").to_pylist()
        parity = [w or np.array(x, np.int64).tobytes() for x, w in zip(narrow, wide)]
        bits = np.array([8 * len(x) for x in parity])
        rows = {w: np.flatnonzero(bits == w) for w in np.unique(bits)}
        packed = {w: np.frombuffer(b"".join(parity[i] for i in at), np.uint8).reshape(len(at), -1) for w, at in rows.items()}
        found = np.zeros(len(node), bool)
        for wa, wb in ((a, b) for a in rows for b in rows if a <= b):
            a, b = rows[wa], rows[wb]
            x, y = _folded(packed[wa], wa), _folded(packed[wb], wa)
            for i, own in zip(a, x):
                near = comp[b] != comp[i]
                near &= 100 * np.minimum(n[i], n[b]) >= percent * np.maximum(n[i], n[b])
                near &= inside | (part[b] != part[i])
                at = np.flatnonzero(near)
                apart = np.bitwise_count(y[at] ^ own).sum(axis=1, dtype=np.int64)
                total = n[i].astype(np.int64) + n[b[at]]
                # half of what the sizes leave is the overlap at most
                hit = b[at][100 * (total - apart) >= percent * (total + apart)]
                if len(hit):
                    found[i] = True
                    found[hit] = True
        at = np.flatnonzero(found)
        same = [pa.array([key[c].as_py()] * len(at), t) for c, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int32()))]
        return pa.table([*same, pa.array(node[at])], names=["block", "kind", "lo", "hi", "node"])

    return run


def _tile_links(percent: int):
    """Links between components in one tile pair, one per pair of components at most."""

    def run(key, table):
        kind, lo, hi = key[1].as_py(), key[2].as_py(), key[3].as_py()
        nodes = table.column("node").to_numpy()
        label = table.column("comp").to_numpy().copy()
        part = table.column("part").to_numpy()
        tokens = table.column("tokens").combine_chunks()
        tokens = tokens.chunk(0) if isinstance(tokens, pa.ChunkedArray) else tokens
        size = np.diff(tokens.offsets.to_numpy()).astype(np.int64)
        _, ids = np.unique(tokens.flatten().to_numpy(), return_inverse=True)
        begin = np.cumsum(size) - size
        inside = kind == "R" and lo == hi
        left = np.arange(len(nodes)) if inside else np.flatnonzero(part == 0)
        right = left if inside else np.flatnonzero(part == 1)
        found = []
        if len(right) and len(left):
            flat = np.concatenate([ids[begin[r] : begin[r] + size[r]] for r in right])
            cuts = np.cumsum(size[right]) - size[right]
            mark = np.zeros(int(ids.max()) + 1, bool)
            for x in left:
                own = ids[begin[x] : begin[x] + size[x]]
                mark[own] = True
                both = np.add.reduceat(mark[flat], cuts, dtype=np.int64)
                mark[own] = False
                hit = right[100 * both >= percent * (size[x] + size[right] - both)]
                hit = hit[label[hit] != label[x]]
                for c, first in zip(*np.unique(label[hit], return_index=True)):
                    found.append((nodes[x], nodes[hit[first]]))
                    label[label == c] = label[x]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs(doc_id, text)``.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased; a set holds the
    distinct ``shingle``-word shingles (fewer words: the whole sequence). Documents
    link when ``100 * |A and B| >= percent * |A or B|``.

    * null or blank text: an empty set, linked with nothing, its own component;
    * null doc_id: one row with a null component, linked with nothing;
    * equal texts and ties: one class, however many rows; repeated rows give
      repeated result rows;
    * rows that repeat a doc_id with another text are joined by their texts;
    * an empty table gives no rows; other columns are ignored.
    """
    job = NgramJoin(docs, shingle, percent)
    rows = job.profile()
    comp = job.components()
    named = written(
        job.reps.join(comp, job.reps.node == comp.id, "left").select(
            "node", "rep", F.coalesce("component", "node").alias("c")
        )
    )
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    by_node = named.join(least, "c").select("node", "component_id")
    known = rows.where("n > 0 and doc_id is not null").join(by_node, "node")
    rest = rows.where("not (n > 0 and doc_id is not null)").withColumn("component_id", F.col("doc_id"))
    return known.unionByName(rest.select(*known.columns)).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id"
    )


def _stand_in(text_hash):
    """The id of a row without one, from its text's hash."""
    last = (1 << 63) - 1
    return F.lit(last) - text_hash.bitwiseAND(F.lit(last >> 1))


def one_per_group(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, null_ids_apart: bool = True
) -> DataFrame:
    """One row of ``docs`` for every component of its texts: the one with the smallest
    doc_id, then text hash, then row.

    Rows with a null doc_id are compared by their texts and come after all others. With
    ``null_ids_apart`` one of them stays beside the component's row with an id. Blank
    texts link with nothing: of those with one doc_id and text, one row stays.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), _stand_in(F.xxhash64("text")))
    keyed = docs.withColumn("_key", key).withColumn("_hash", F.xxhash64("text"))
    job = NgramJoin(docs.select(key.alias("doc_id"), "text"), shingle, percent)
    job.profile(hashed=True)
    comp = job.components()
    texts = written(
        job.rows.groupBy("node", "n", F.col("doc_id").alias("_key"), F.col("text_hash").alias("_hash")).agg(
            (F.count("*") > 1).alias("many")
        )
    )
    texts = texts.withColumn("null_id", F.col("_key") == _stand_in(F.col("_hash")))
    texts = texts.withColumn("apart", F.col("null_id") & F.lit(null_ids_apart))
    first = F.min(F.struct("null_id", "_key", "_hash", "many")).alias("first")
    by_node = texts.where("n > 0").groupBy("node", "apart").agg(first).select("node", "apart", "first.*")
    by_class = (
        by_node.join(comp, F.col("node") == F.col("id"), "left")
        .groupBy(F.coalesce("component", "node").alias("c"), "apart")
        .agg(first)
        .select("first._key", "first._hash", "first.many")
    )
    kept = written(by_class.union(texts.where("n = 0").select("_key", "_hash", "many")))

    def rows_of(keys, how="left_semi"):
        keys = keys.select("_key", "_hash")
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
        return keyed.join(keys, ["_key", "_hash"], how)

    # the fewer keys are sent: those that stay or those that go
    once = kept.where("not many")
    gone = written(texts.select("_key", "_hash").distinct().join(once, ["_key", "_hash"], "left_anti"))
    out = rows_of(once) if once.count() <= gone.count() else rows_of(gone, "left_anti")
    out = out.select(*docs.columns)
    repeated = kept.where("many")
    if repeated.isEmpty():
        return out
    one = rows_of(repeated).groupBy("_key", "_hash").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return out.unionByName(one.select("row.*"))

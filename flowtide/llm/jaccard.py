"""N-gram Jaccard join by vertical partitioning, and the components of its links.

1. *Sets.* One Arrow pass reads each whole text once, cuts it into words and hashes its 5-word shingles. Equal sets are one class:
   within a task only the first document of a class goes on, and later only one of each class.
2. *Global order.* A task packs its shingles into fragments by hash range, a few bytes each. It counts a shingle that several of
   its sets hold once, and keeps the others of them to itself, so a fragment gets a very common shingle once a pack. A fragment
   sums the counts. The global order is (log2 of that sum, hash), rare first. Shingles of one document overlap with nothing.
3. *Candidates.* By the prefix filter, linked sets share one of their first n - ceil(0.75 n) + 1 shingles in that order. A set
   whose unique shingles fill its prefix is out; the others give a few postings.
4. *Vertical counts.* The order is cut into fragments at fixed pivots. For a candidate pair the overlap is counted in each fragment
   on its own and summed per pair; links are pairs with 100 * overlap >= 75 * union.
5. *Components without all pairs.* A posting list first links its sets to one centre (two rounds with other centres), and components
   are found by alternating large-star and small-star steps. Only pairs from different components are then compared, all of
   them; so a group of n near copies costs about n comparisons, and no link between components is lost.

Sets are told apart by 128 bits of a hash of their shingles' 64-bit hashes, shingles in overlaps by 48 bits.

Defined cases: null or empty text has no shingles and is linked with nothing; with fewer than five words the whole sequence is the
one shingle; repeated rows are documents with equal sets; a document with a null id takes part but is never the smallest id; ties
between rows are ordered as in :mod:`repeats`; a text of any length is one row in memory; an empty table gives no rows; extra
columns are ignored or, in :func:`drop_near_duplicates`, kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, discard, redealt, spool, table, utf8
from .repeats import numbered_rows

WIDTH, PERCENT = 5, 75
#: Bits of a shingle's hash that fragments hold; entries that a task packs at once.
BITS, PACK = 48, 1 << 20
#: Shingles that a fragment holds on average at most.
FRAGMENT = 1 << 23
#: Bytes of text that a shingle takes at least on average: only the number of fragments depends on it.
SHINGLE_BYTES = 4
#: Rows that no fragment reads: sizes and names of a task's sets, places of its sets that hold a shingle counted for another, and the
#: rows of the table with the names of their sets.
SETS, REPEATS, MEMBERS = -1, -2, -3
#: Cuts of the global order (by log2 of a shingle's document count) into vertical fragments.
PIVOTS = (2, 4, 7)
STAR_ROUNDS = 2
#: Blocks of a cluster whose sets are compared with one another: sets in a block, most such blocks, sets in a block beyond that.
BLOCK, BLOCKS, LARGE_BLOCK = 128, 64, 16384
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0x27D4EB2F165667C5)]


def shingle_hashes(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text in UTF-8 (ASCII lower case, ASCII white space)."""
    words = np.array(list(map(xxhash.xxh3_64_intdigest, raw.lower().split())), np.uint64)
    n = len(words)
    if not n:
        return words
    span = min(n, width)
    x = np.full(n - span + 1, span, np.uint64)
    for k in range(span):
        x += words[k : n - span + 1 + k] * _ODD[k % len(_ODD)]
        x ^= x >> np.uint64(31)
    x *= _ODD[1]
    x ^= x >> np.uint64(29)
    return np.unique(x)


def prefix_length(n: int) -> int:
    """How many first shingles of a set of n two linked sets can't both miss."""
    return n - (PERCENT * n + 99) // 100 + 1


def _pack(values: np.ndarray) -> bytes:
    """Byte planes of 64-bit numbers: small numbers leave planes of zeros, which compress away."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def set_name(h: np.ndarray) -> bytes:
    """The name of a set: 128 bits of a hash of its sorted shingles."""
    return xxhash.xxh3_128_digest(h.tobytes())


_PACKED = "part int, frag int, a binary, b binary"


def _packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["part", "frag", "a", "b"])


def packed_shingles(rows: DataFrame, fragments: int) -> DataFrame:
    """A task's shingles in each fragment with the place of a set that holds them and how many do; the other places of such a pack
    in fragment REPEATS; in fragment SETS the sizes and names of the task's sets, in MEMBERS the keys of its rows and their sets' names.

    Of equal sets in a task only the first is packed. rows: key and text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: set[bytes] = set()
        sizes: list[int] = []
        names: list[bytes] = []
        held: list[np.ndarray] = []
        base = n_held = 0

        def packed() -> Iterator[pa.RecordBatch]:
            lengths = [len(x) for x in held]
            h = np.concatenate(held)
            held.clear()  # here and below: a pack is held as few times as can be
            h >>= np.uint64(64 - BITS)
            order = np.argsort(h, kind="stable")
            h = h[order]
            idx = np.repeat(np.arange(base, base + len(lengths), dtype=np.uint64), lengths)[order]
            del order
            first = np.append(True, h[1:] != h[:-1])
            if not first.all():
                yield _packed_rows([(part, REPEATS, _pack(np.diff(h[~first], prepend=np.uint64(0))), _pack(idx[~first]))])
            times = np.diff(np.append(np.flatnonzero(first), len(h))).astype(np.uint64)
            h, idx = h[first], idx[first]
            times <<= np.uint64(32)
            idx |= times
            del times, first
            frag = h >> np.uint64(BITS - 32)
            frag *= np.uint64(fragments)
            frag >>= np.uint64(32)
            cuts = np.concatenate([[0], np.flatnonzero(frag[1:] != frag[:-1]) + 1, [len(h)]])
            number = frag[cuts[:-1]].tolist()
            del frag
            out = []
            for k, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                out.append((part, number[k], _pack(np.diff(h[lo:hi], prepend=np.uint64(0))), _pack(idx[lo:hi])))
                if len(out) >= 64:
                    yield _packed_rows(out)
                    out = []
            if out:
                yield _packed_rows(out)

        for batch in batches:
            own: list[tuple[int, bytes]] = []
            for raw in utf8(batch["text"]):
                h = shingle_hashes(raw)
                name = set_name(h)
                own.append((len(h), name))
                if not len(h) or name in seen:
                    continue
                seen.add(name)
                held.append(h)
                sizes.append(len(h))
                names.append(name)
                n_held += len(h)
                if n_held >= PACK:
                    yield from packed()
                    base, n_held = len(sizes), 0
            if own:
                keys = batch["key"].to_numpy(zero_copy_only=False).astype(np.int64)
                yield _packed_rows([(part, MEMBERS, _pack(np.concatenate([keys, [n for n, _ in own]])), b"".join(name for _, name in own))])
        if held:
            yield from packed()
        if sizes:
            yield _packed_rows([(part, SETS, _pack(np.array(sizes)), b"".join(names))])

    return arrow_map(rows.select("key", F.col("doc.text").cast("string").alias("text")), run, _PACKED)


def shared_shingles(packed: DataFrame) -> DataFrame:
    """For each fragment, the shingles of two or more sets, sent back to the tasks that packed them: place of the set and order key.
    The rows of SETS, REPEATS and MEMBERS go through unchanged, dealt out by task.
    """
    sent = packed.repartition("frag", F.when(F.col("frag") < 0, F.col("part"))).sortWithinPartitions("frag")

    def solve(frag: int, parts: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([np.cumsum(_unpack(a)) for _, a, _ in parts])
        idx = np.concatenate([_unpack(b) for _, _, b in parts])
        origin = np.repeat(np.array([p for p, _, _ in parts]), [len(b) // 8 for _, _, b in parts])
        order = np.argsort(h, kind="stable")
        h = h[order]
        head = np.flatnonzero(np.diff(h, prepend=h[0] ^ np.uint64(1)))
        df = np.add.reduceat(idx[order] >> np.uint64(32), head)
        idx &= np.uint64(0xFFFFFFFF)
        times = np.repeat(df, np.diff(np.append(head, len(h))))
        kept = times > 1
        h, times, order = h[kept], times[kept], order[kept]
        key = (np.floor(np.log2(times)).astype(np.uint64) << np.uint64(BITS)) | h
        origin, idx = origin[order], idx[order]
        by = np.argsort(origin, kind="stable")
        key, origin, idx = key[by], origin[by], idx[by]
        cuts = np.append(np.flatnonzero(np.diff(origin, prepend=-1)), len(origin)) if len(origin) else np.zeros(0, int)
        out = [(int(origin[lo]), frag, _pack(idx[lo:hi]), _pack(key[lo:hi])) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        if out:
            yield _packed_rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for part, frag, a, b in zip(*(batch[c].to_pylist() for c in ("part", "frag", "a", "b")), strict=True):
                if frag < 0:
                    yield _packed_rows([(part, frag, a, b)])
                    continue
                if frag != now and parts:
                    yield from solve(now, parts)
                    parts = []
                now = frag
                parts.append((part, a, b))
        if parts:
            yield from solve(now, parts)

    return arrow_map(sent, run, _PACKED)


_LIVE = "key long, name1 long, name2 long, nid long, n int, n_prefix int, keys array<long>"


def named_sets(packed: DataFrame) -> DataFrame:
    """The rows of the table (key, name1 and name2 of their sets, n) and the sets that can be linked (nid, name1, name2, n, their shared
    shingles in global order, and how many of them lie in the prefix); key is null in the latter, nid in the former."""
    rows = shared_shingles(packed).repartition("part").sortWithinPartitions("part", "frag")
    columns = [x.split()[0] for x in _LIVE.split(", ")]

    def named(names: bytes | np.ndarray) -> list[pa.Array]:
        both = np.frombuffer(names, np.int64).reshape(-1, 2)
        return [pa.array(both[:, 0]), pa.array(both[:, 1])]

    def members(a: bytes, b: bytes) -> pa.RecordBatch:
        keys, sizes = _unpack(a).view(np.int64).reshape(2, -1)
        none = pa.nulls(len(keys), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(keys), *named(b), none, pa.array(sizes, pa.int32()), pa.nulls(len(keys), pa.int32()), pa.nulls(len(keys), pa.list_(pa.int64()))], columns)

    def solve(part: int, head: tuple[bytes, bytes], parts: list[tuple[bytes, bytes]], repeats: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        sizes, names = _unpack(head[0]).astype(np.int64), np.frombuffer(head[1], np.int64).reshape(-1, 2)
        idx = np.concatenate([_unpack(a).astype(np.uint32) for a, _ in parts])
        key = np.concatenate([_unpack(b) for _, b in parts]).astype(np.int64)
        parts.clear()
        if repeats:
            counted, at = np.unique(key & ((1 << BITS) - 1), return_index=True)
            again = np.concatenate([np.cumsum(_unpack(a)) for a, _ in repeats]).astype(np.int64)
            idx = np.concatenate([idx, *(_unpack(b).astype(np.uint32) for _, b in repeats)])
            key = np.concatenate([key, key[at[np.searchsorted(counted, again)]]])
            del counted, at, again
        order = np.argsort(idx, kind="stable")
        idx, key = idx[order], key[order]
        del order
        shared = np.bincount(idx, minlength=len(sizes))
        begin = np.concatenate([[0], np.cumsum(shared)])
        prefix = sizes - (PERCENT * sizes + 99) // 100 + 1 - (sizes - shared)
        live = np.flatnonzero(prefix > 0)
        for cut in range(0, len(live), 500):
            own = live[cut : cut + 500]
            ends = np.concatenate([[0], np.cumsum(shared[own])])
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.sort(key[begin[i] : begin[i + 1]]) for i in own.tolist()])))
            nid = (np.int64(part) << 32) + own
            yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.int64()), *named(names[own].tobytes()), pa.array(nid), pa.array(sizes[own], pa.int32()), pa.array(prefix[own], pa.int32()), keys], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, parts, repeats = None, None, [], []
        for batch in batches:
            for part, frag, a, b in zip(*(batch[c].to_pylist() for c in ("part", "frag", "a", "b")), strict=True):
                if part != now:
                    if head and parts:
                        yield from solve(now, head, parts, repeats)
                    now, head, parts, repeats = part, None, [], []
                if frag == MEMBERS:
                    yield members(a, b)
                elif frag == SETS:
                    head = (a, b)
                else:
                    (repeats if frag == REPEATS else parts).append((a, b))
        if head and parts:
            yield from solve(now, head, parts, repeats)

    return arrow_map(rows, run, _LIVE)


def segments(live: DataFrame) -> DataFrame:
    """The sets cut at the pivots of the global order: nid, frag, seg."""
    cuts = [0, *[p << BITS for p in PIVOTS], 63 << BITS]
    part = lambda lo, hi: F.filter("keys", lambda k: (k >= F.lit(lo)) & (k < F.lit(hi)))
    pieces = F.array(*[F.struct(F.lit(i).alias("frag"), part(lo, hi).alias("seg")) for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))])
    return live.select("nid", F.explode(pieces).alias("p")).select("nid", "p.frag", "p.seg").where(F.size("seg") > 0)


def links_of(pairs: DataFrame, segs: DataFrame) -> DataFrame:
    """The pairs (a, na, b, nb) that are links: overlaps are counted in each fragment and summed."""
    left = pairs.join(segs.select(F.col("nid").alias("a"), "frag", F.col("seg").alias("seg_a")), "a")
    both = left.join(segs.select(F.col("nid").alias("b"), "frag", F.col("seg").alias("seg_b")), ["b", "frag"])
    counts = both.select("a", "b", "na", "nb", F.size(F.array_intersect("seg_a", "seg_b")).cast("long").alias("part"))
    total = counts.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("overlap"))
    return total.where(F.col("overlap") * 100 >= (F.col("na") + F.col("nb") - F.col("overlap")) * PERCENT).select("a", "b")


def are_stars(e: DataFrame) -> bool:
    """Whether each node u of the edges (u, v), u > v, has one v, and no v is a u: then each v is the least of its component."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of each node with an edge (a, b), by large-star and small-star steps."""
    e = spool(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    while not are_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = redealt(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = spool(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(redealt(least), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        small = spool(small.distinct(), "small-star")
        discard(e, large)
        e = small
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._spool_path = e._spool_path
    return out


def clusters(postings: DataFrame) -> DataFrame:
    """nid, cluster, block, blocks: sets that posting lists connect, checked or not, and how they are cut into blocks.

    A cluster has a block for each ``BLOCK`` sets, up to ``BLOCKS`` of them, then blocks grow to ``LARGE_BLOCK`` sets: a set goes to as
    many tasks as its cluster has blocks, and a task gets two blocks.
    """
    heads = redealt(postings.groupBy("key").agg(F.min("nid").alias("a")))
    named = components(postings.join(heads, "key").select("a", F.col("nid").alias("b")).distinct())
    members = spool(named.select(F.col("node").alias("nid"), F.col("root").alias("cluster")).unionByName(named.select(F.col("root").alias("nid"), F.col("root").alias("cluster")).distinct()), "clusters")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("g"))
    blocks = F.greatest(F.least(F.ceil(F.col("g") / BLOCK), F.lit(BLOCKS)), F.ceil(F.col("g") / LARGE_BLOCK)).cast("int")
    return members.join(redealt(sizes.select("cluster", blocks.alias("blocks"))), "cluster").withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))


def block_links(members: DataFrame, live: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Links (a, b) that unite sets of different components, from all pairs of sets of a cluster.

    Each pair of blocks is one group of rows; within it overlaps are counted fragment by fragment of the global order and summed, and of
    the links found only those that unite are given out.
    """
    sets = live.select("nid", "n", "keys").join(members, "nid")
    if labels is not None:
        sets = sets.join(labels.select(F.col("node").alias("nid"), "root"), "nid", "left").withColumn("comp", F.coalesce("root", "nid")).drop("root")
    else:
        sets = sets.withColumn("comp", F.col("nid"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = sets.withColumn("other", other).select("cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "nid", "n", "comp", "keys")
    dealt = rows.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi")
    cuts = np.array([p << BITS for p in PIVOTS], np.int64)

    def solve(same: bool, lo: int, block: np.ndarray, nid: np.ndarray, n: np.ndarray, comp: np.ndarray, keys: list[np.ndarray]) -> list[tuple[int, int]]:
        left = np.arange(len(nid)) if same else np.flatnonzero(block == lo)
        right = np.arange(len(nid)) if same else np.flatnonzero(block != lo)
        if len(set(comp.tolist())) < 2 or not len(left) or not len(right):
            return []
        posted = np.concatenate([keys[j] for j in right])
        owner = np.repeat(np.arange(len(right)), [len(keys[j]) for j in right])
        order = np.argsort(posted, kind="stable")
        posted, owner = posted[order], owner[order]
        parent: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = parent.get(up, up)
                c = parent[c]
            return c

        out = []
        n_right, comp_right = n[right].astype(np.int64), comp[right]
        for i in left.tolist():
            unlike = comp_right != comp[i]
            if same:
                unlike[: i + 1] = False
            if not unlike.any():
                continue
            size = int(n[i])
            needed = -(-PERCENT * (size + n_right) // (100 + PERCENT))
            overlap = np.zeros(len(right), np.int64)
            rest = len(keys[i])
            for fragment in np.split(keys[i], np.searchsorted(keys[i], cuts)):
                first, last = np.searchsorted(posted, fragment), np.searchsorted(posted, fragment, side="right")
                width = last - first
                if width.sum():
                    ends = np.cumsum(width)
                    overlap += np.bincount(owner[np.arange(ends[-1]) + np.repeat(first - (ends - width), width)], minlength=len(right))
                rest -= len(fragment)
                unlike &= overlap + rest >= needed
                if not unlike.any():
                    break
            for j in np.flatnonzero(unlike & (overlap * 100 >= (size + n_right - overlap) * PERCENT)).tolist():
                x, y = find(int(comp[i])), find(int(comp_right[j]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((int(nid[i]), int(nid[right[j]])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            c = list(zip(*held, strict=True))
            found = solve(now[1] == now[2], now[1], np.array(c[0]), np.array(c[1], np.int64), np.array(c[2]), np.array(c[3], np.int64), list(c[4]))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        for batch in batches:
            names = ("cluster", "lo", "hi", "block", "nid", "n", "comp")
            lists = batch["keys"]
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for k, (cluster, lo, hi, *rest) in enumerate(zip(*(batch[c].to_pylist() for c in names), strict=True)):
                if (cluster, lo, hi) != now:
                    if held:
                        yield close()
                        held = []
                    now = (cluster, lo, hi)
                held.append((*rest, values[ends[k] : ends[k + 1]]))
        if held:
            yield close()

    return arrow_map(dealt, run, "a long, b long")


def link_components(live: DataFrame) -> DataFrame:
    """node, root over the sets of ``live`` (one row of each class)."""
    segs = segments(live)
    # A posting: shingle, set, size, and place in the prefix (0-based).
    first = F.expr("posexplode(slice(keys, 1, n_prefix))")
    unique_before = F.col("n") - F.size("keys")
    postings = live.select("nid", "n", unique_before.alias("alone"), first).select("nid", "n", F.col("col").alias("key"), (F.col("pos") + F.col("alone")).alias("pos"))
    postings = spool(postings, "postings")
    labels: DataFrame | None = None
    for step in range(STAR_ROUNDS + 1):
        named = postings.withColumn("comp", F.col("nid")) if labels is None else (
            postings.join(labels.select(F.col("node").alias("nid"), "root"), "nid", "left").withColumn("comp", F.coalesce("root", "nid")).drop("root")
        )
        # posting lists with sets of more than one component
        open_keys = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        named = spool(named.join(redealt(open_keys), "key", "left_semi"), "open-postings")
        if named.limit(1).count() == 0:
            break
        if step < STAR_ROUNDS:
            # sets of like size in a list meet its centre; each set keeps the centre that it shares most lists with
            step_of = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / PERCENT)) + 0.5 * step)
            mixed = named.withColumn("class", step_of).withColumn("rank", F.xxhash64("nid", F.lit(step)))
            centres = mixed.groupBy("key", "class").agg(F.min("rank").alias("rank"))
            ends = mixed.join(centres, ["key", "class", "rank"]).select("key", "class", F.col("nid").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("comp_b"))
            met = mixed.join(ends, ["key", "class"]).where(F.col("comp") != F.col("comp_b"))
            counted = met.groupBy(F.col("nid").alias("a"), F.col("n").alias("na"), "b", "nb").agg(F.count("*").alias("lists"))
            pairs = counted.groupBy("a", "na").agg(F.max(F.struct("lists", "b", "nb")).alias("best")).select("a", "na", F.col("best.b").alias("b"), F.col("best.nb").alias("nb"))
            pairs = spool(pairs, "pairs")
            links = spool(links_of(pairs, segs), "links")
            discard(pairs)
        else:
            # all that is left: sets of different components that share a posting list, in blocks
            members = clusters(named)
            links = spool(block_links(members, live, labels), "links")
        edges = links if labels is None else links.unionByName(labels.select(F.col("node").alias("a"), F.col("root").alias("b")))
        before, labels = labels, components(edges)
        discard(before, links, named)
    discard(postings)
    if labels is None:
        return live.limit(0).select(F.col("nid").alias("node"), F.col("nid").alias("root"))
    return labels


def named_components(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (key, place, doc) of :func:`repeats.numbered_rows`: key, place, n, name1, name2 of each row, and of each class of equal
    sets its name1, name2, place (the first row that holds it) and first (the first row of its component)."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length(F.col("doc.text").cast("string"))).alias("n")).first()[0] or 0
    fragments = min(max(256, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHINGLE_BYTES // FRAGMENT), (1 << 31) - 1)
    sets = spool(named_sets(packed_shingles(rows, fragments)), "sets")
    members = sets.where("key is not null").select("key", "n", "name1", "name2")
    plain = dict(rows.dtypes)["place"] == "bigint"
    members = members.withColumn("place", F.col("key")) if plain else members.join(rows.select("key", "place"), "key")
    live = sets.where("key is null").drop("key")
    one = live.groupBy("name1", "name2").agg(F.min("nid").alias("nid"))
    live = spool(live.join(one, ["name1", "name2", "nid"], "left_semi"), "live")
    roots = link_components(live.drop("name1", "name2"))
    classes = members.where("n > 0").groupBy("name1", "name2").agg(F.min("place").alias("place"))
    linked = live.select("name1", "name2", "nid").join(roots.withColumnRenamed("node", "nid"), "nid", "left").select("name1", "name2", F.coalesce("root", "nid").alias("root"))
    classes = spool(classes.join(linked, ["name1", "name2"], "left"), "classes")
    firsts = classes.where("root is not null").groupBy("root").agg(F.min("place").alias("first"))
    return members, classes.join(redealt(firsts), "root", "left").withColumn("first", F.coalesce("first", "place")).drop("root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id of each row: the smallest doc_id with an equal set, as text (null without words, and
    where no row of the set has an id)."""
    members, classes = named_components(numbered_rows(docs.select("doc_id", "text")))
    own = lambda c: F.col(c) if dict(members.dtypes)["place"] == "bigint" else F.col(f"{c}.id")
    found = spool(classes.select("name1", "name2", own("first").alias("component_id"), own("place").cast("string").alias("class_id")), "components")
    out = members.withColumn("doc_id", own("place")).join(found, ["name1", "name2"], "left")
    some = F.col("n") > 0
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(some, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(some, F.col("class_id")).alias("class_id"),
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The first row of each component, by doc_id and then as :mod:`repeats` orders rows; a row with a null id only where the component has
    no id. Unlike, unlinked texts stay even if they share an id or have none; rows without words are linked with nothing and stay. All
    columns stay as they are."""
    rows = numbered_rows(docs)
    members, classes = named_components(rows)
    key = F.col("first") if dict(rows.dtypes)["place"] == "bigint" else F.col("first.row")
    kept = classes.select(key.alias("key")).distinct().unionByName(members.where("n = 0").select("key"))
    return rows.join(spool(kept, "kept"), "key", "left_semi").select(*[F.col("doc").getField(n).alias(n) for n in docs.columns])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op2_jaccard."""
    return near_duplicates(table(spark, sf_dir, "documents"))


#: DuckDB SQL of op2: all pairs that share a shingle, counted, and the closure of their links.
ORACLE = f"""WITH RECURSIVE cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {WIDTH} THEN [array_to_string(words, ' ')]
  ELSE list_sort(list_distinct([array_to_string(words[i : i + {WIDTH - 1}], ' ') for i in range(1, len(words) - {WIDTH - 2})])) END AS shingles FROM cut),
named AS (SELECT doc_id, len(shingles) AS n, md5(array_to_string(shingles, chr(10))) AS name FROM sets),
held AS (SELECT doc_id, unnest(shingles) AS shingle FROM sets),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS overlap FROM held x JOIN held y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN named p ON p.doc_id = a JOIN named q ON q.doc_id = b WHERE 100 * overlap >= {PERCENT} * (p.n + q.n - overlap)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS node FROM named UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON a = node),
roots AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, CASE WHEN n > 0 THEN CAST(min(doc_id) OVER (PARTITION BY name) AS VARCHAR) END AS class_id FROM named JOIN roots USING (doc_id)"""

"""SimHash near-dedup with bit-sliced comparison.

A fingerprint of 64 bits is made from the hashes of a text's word shingles; fingerprints
at a few differing bits are linked, and linked documents form components.

Candidates: at 3 differing bits or fewer, one of four 16-bit blocks is equal, and one of
the four 12-bit parts of what remains is equal too; so sixteen tables of 28-bit keys hold
every linked pair. Equal fingerprints are one row there. A bucket that is large is dealt
in tiles of chunk pairs, none left out. Within a tile, bit planes are held vertically (one
64-bit word has one bit of 64 fingerprints), and all distances of a fingerprint to the
tile grow together in carry-save counters; lanes over the radius stick, and a row of which
all lanes are over is abandoned. Each tile gives a spanning forest of its links, not its
pairs, and a distributed component search joins the forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import components, in_parts, lean, packed, ship, small_or_not, unpacked, written

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Distinct fingerprints in a chunk of a large bucket; a tile has two chunks.
CHUNK = 512
#: Shingles that are counted at once.
STEP = 1 << 16
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bits of a text's parities at most; longer texts are told apart less well by them, and verified.
WIDEST = 1 << 14


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number; 0 without words."""
    words = text.encode().lower().split() if text else []  # bytes: lower() and split() know ASCII alone
    if not words:
        return 0
    if len(words) < size:
        words = [b" ".join(words)]
        size = 1
    total, n = np.zeros(64, dtype=np.int64), len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        part = words[at : min(n, at + STEP) + size - 1]
        hashes = np.fromiter((digest(x, SEED) for x in map(b" ".join, zip(*[part[i:] for i in range(size)]))), dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = np.packbits(2 * total > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprinted(docs: DataFrame, text: str, carried: dict[str, Column]) -> DataFrame:
    """(row, fp): the carried columns in a struct beside the text's fingerprint."""
    ship(docs.sparkSession)
    rows = docs.select(F.struct(*[c.alias(n) for n, c in carried.items()]).alias("row"), F.col(f"`{text}`").alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t) for _, texts in in_parts(b.column(1)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["row", "fp"])

    return rows.mapInArrow(lean(work), rows.select("row", F.lit(0).cast("long").alias("fp")).schema)


def table_keys(fp: Column) -> Column:
    """The sixteen keys: table number, a 16-bit block, and a 12-bit part of the other three blocks."""
    block = [F.shiftrightunsigned(fp, 16 * b).bitwiseAND(0xFFFF) for b in range(4)]
    keys = []
    for b in range(4):
        x, y, z = (block[i] for i in range(4) if i != b)
        rest = x.bitwiseOR(F.shiftleft(y, 16)).bitwiseOR(F.shiftleft(z, 32))
        for c in range(4):
            part = F.shiftrightunsigned(rest, 12 * c).bitwiseAND(0xFFF)
            keys.append(F.lit(4 * b + c).cast("long") * F.lit(1 << 28) + block[b] * F.lit(1 << 12) + part)
    return F.array(*keys)


def near_pairs(values: np.ndarray, starts: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b), a > b, of values at radius or fewer differing bits within the same run.

    values: uint64, run after run; starts: where runs begin. Runs of up to 64 are compared
    all at once, a word of lanes each; longer ones one at a time, with words of lanes.
    """
    ends = np.append(starts[1:], len(values))
    sizes = ends - starts
    out: list[tuple[np.ndarray, np.ndarray]] = []
    short = np.flatnonzero((sizes > 1) & (sizes <= 64))
    if len(short):
        run = np.repeat(np.arange(len(short)), sizes[short])
        first = np.repeat(starts[short], sizes[short])
        lane = np.arange(len(run)) - np.repeat(np.cumsum(sizes[short]) - sizes[short], sizes[short])
        place = first + lane
        mine, heads = values[place], np.flatnonzero(lane == 0)
        planes = [np.bitwise_or.reduceat(((mine >> np.uint64(p)) & np.uint64(1)) << lane.astype(np.uint64), heads) for p in range(64)]
        # only lanes before one's own
        alive = ((np.uint64(1) << lane.astype(np.uint64)) - np.uint64(1))[:, None]
        rows, over = _sliced(mine, lambda p, rows: planes[p][run[rows]][:, None], alive, radius)
        out.append(_places(rows, ~over & alive[rows], place, lambda r: first[r]))
    for k in np.flatnonzero(sizes > 64):
        a, n = int(starts[k]), int(sizes[k])
        mine, width = values[a : a + n], -(-n // 64)
        padded = np.zeros((width * 64, 8), dtype=np.uint8)
        padded[:n] = mine.view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(padded, axis=1, bitorder="little")
        planes = np.packbits(bits, axis=0, bitorder="little").T.copy().view("<u8")  # 64 x width
        lanes = np.arange(width * 64).reshape(width, 64)
        for at in range(0, n, 1024):
            q = np.arange(at, min(n, at + 1024))
            mask = np.packbits(lanes[None] < q[:, None, None], axis=2, bitorder="little").reshape(len(q), width, 8).view("<u8")[..., 0]
            rows, over = _sliced(mine[q], lambda p, rows: np.broadcast_to(planes[p], (len(rows), width)), mask, radius)
            out.append(_places(rows, ~over & mask[rows], q + a, lambda r: np.full(len(r), a)))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _sliced(values: np.ndarray, plane, alive: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows left, words of lanes over the radius): distances of each value to its lanes, counted bit plane by bit plane.

    The counters are carry-save: word i holds bit i of 64 distances. A carry out of the last
    one sticks in over, and so does what a comparison with the radius finds every 8 planes.
    """
    rows = np.flatnonzero(alive.any(axis=1))
    over = ~alive[rows]
    count = [np.zeros(over.shape, np.uint64) for _ in range(max(1, radius.bit_length()))]
    for p in range(64):
        own = (np.uint64(0) - ((values[rows] >> np.uint64(p)) & np.uint64(1)))[:, None]
        carry = plane(p, rows) ^ own
        for c in count:
            more = c & carry
            c ^= carry
            carry = more
        over |= carry
        if p % 8 == 7:
            over |= _above(count, radius)
            going = (over != FULL).any(axis=1)
            if not going.all():
                rows, over, count = rows[going], over[going], [c[going] for c in count]
                if not len(rows):
                    break
    return rows, over


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is greater than the radius."""
    above, equal = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for i in range(len(count) - 1, -1, -1):
        if radius >> i & 1:
            equal &= count[i]
        else:
            above |= equal & count[i]
            equal &= ~count[i]
    return above


def _places(rows: np.ndarray, near: np.ndarray, place: np.ndarray, first) -> tuple[np.ndarray, np.ndarray]:
    r, word = np.nonzero(near)
    bits = np.unpackbits(np.ascontiguousarray(near[r, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    hit, lane = np.nonzero(bits)
    who = rows[r[hit]]
    return place[who], first(who) + word[hit] * 64 + lane


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place linked to each of n places, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = np.minimum(new, new[new])
        while (jump := new[new])[0:].tobytes() != new.tobytes():
            new = jump
        if np.array_equal(new, root):
            return root
        root = new


def linked_runs(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) to the smallest place of each component, run by run; batches are sorted by k, i, j."""
    held: list[np.ndarray] = []

    def edges(values: np.ndarray, changes: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate([[0], changes]).astype(np.int64)
        a, b = near_pairs(values.view(np.uint64), starts, radius)
        used, back = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = forest(len(used), back[: len(a)], back[len(a) :])
        here = np.flatnonzero(root != np.arange(len(used)))
        return pa.RecordBatch.from_arrays([pa.array(values[used[here]]), pa.array(values[used[root[here]]])], ["a", "b"])

    for batch in batches:
        rows = np.stack([np.asarray(batch.column(i).to_numpy(zero_copy_only=False), dtype=np.int64) for i in range(4)], axis=1)
        if held:
            rows = np.concatenate([*held, rows])
        changes = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
        if not len(changes):
            held = [rows]
            continue
        held = [rows[changes[-1] :]]
        yield edges(np.ascontiguousarray(rows[: changes[-1], 3]), changes[:-1])
    if held:
        yield edges(np.ascontiguousarray(held[0][:, 3]), np.empty(0, np.int64))


def linked(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(node, component) of the distinct fingerprints fps (fp) that have a neighbour within the radius."""
    if not 0 <= radius <= 3:
        raise ValueError("the tables are complete up to a radius of 3")
    keyed = written(fps.select("fp", F.explode(table_keys(F.col("fp"))).alias("k")), "simhash-keys")
    counts = keyed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    sized = keyed.join(counts, "k").withColumn("m", F.when(F.col("n") <= 2 * chunk, F.lit(1)).otherwise(F.ceil(F.col("n") / chunk)).cast("int"))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("m")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    dealt = sized.select("k", "fp", F.explode(tiles).alias("t")).select("k", "t.i", "t.j", "fp")
    together = dealt.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "fp")
    edges = together.mapInArrow(lean(lambda batches: linked_runs(batches, radius)), "a long, b long")
    return components(edges, "simhash")


def grouped(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, carried: dict[str, Column] | None = None) -> DataFrame:
    """(key, further carried columns, fp, node, component_id) of every document.

    component_id is the smallest key reachable by links, the own one included (null keys
    count as none; null if a component has no other); node tells components apart. Null,
    empty and blank texts have fingerprint 0, which links like any other. Rows repeat as
    given and are in one component. Very long texts are hashed whole. An empty table gives
    an empty one. Extra columns of docs are not looked at.
    """
    marked = fingerprinted(docs, text, {"key": F.col(f"`{key}`"), **(carried or {})})
    marked = written(marked.select("row.*", "fp"), "simhash-marks")
    each = marked.groupBy("fp").agg(F.min("key").alias("low"))
    links = linked(each.select("fp"), radius)
    named = each.join(links, each.fp == links.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("c"))
    # written, so that the join deals a hot component by itself and not as the aggregate needs it
    lows = written(named.groupBy(F.col("c").alias("lc")).agg(F.min("low").alias("component_id")), "simhash-lows")
    ids = named.join(lows, F.col("c") == F.col("lc")).select(F.col("fp").alias("nfp"), F.col("c").alias("node"), "component_id")
    return marked.join(ids, F.col("fp") == F.col("nfp")).drop("nfp")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- near copies by similarity: SimHash at a wide radius, within blocks, and verified


def sketch(text: str, size: int, functions: int) -> tuple[int, list[int], int, bytes]:
    """The fingerprint and the smallest hash under each function, of the text's distinct shingles (of all words, if fewer; of none, the empty one); how many there are, and their parities."""
    words = text.encode().lower().split()
    if len(words) < size:
        words, size = [b" ".join(words)], 1
    n, least, seen = len(words) - size + 1, [], np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        part = words[at : min(n, at + STEP) + size - 1]
        hashes = np.fromiter((digest(x, SEED) for x in map(b" ".join, zip(*[part[i:] for i in range(size)]))), dtype="<u8")
        seen = np.union1d(seen, hashes)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(seen), STEP):
        total += np.unpackbits(seen[at : at + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    for f in range(functions):
        least.append(mixed(seen ^ np.uint64(0x9E3779B97F4A7C15 * (f + 1) % 2**64)).min())
    bits = np.packbits(2 * total > len(seen), bitorder="little")
    return int(bits.view("<i8")[0]), np.array(least).view(np.int64).tolist(), len(seen), parities(seen)


def parities(hashes: np.ndarray) -> bytes:
    """Whether an odd number of the distinct hashes fall on each of as many bits as there are hashes, or up to twice as many.

    Two sets differ in at least as many hashes as their parities differ in bits, whatever the
    width, so that no similar pair is lost by them. Half the width is the halves' exclusive or.
    """
    width = min(WIDEST, max(64, 1 << (len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)


def sketches(batches: Iterator[pa.RecordBatch], size: int, functions: int) -> Iterator[pa.RecordBatch]:
    """Of batches (row (uid), text): row, fingerprint, smallest hashes, size and parities; a text that repeats in a batch is sketched once."""
    for b in batches:
        uids = b.column(0).field(0).to_pylist()
        known: dict[int, tuple] = {}
        for part, texts in in_parts(b.column(1)):
            for uid, t in zip(uids[part], texts):
                if uid not in known:
                    known[uid] = sketch(t, size, functions)
        found = [known[u] for u in uids]
        kinds = {"fp": pa.int64(), "keys": pa.list_(pa.int64()), "n": pa.int64(), "odd": pa.binary()}
        yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds.values())], ["row", *kinds])


def spanning(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Edges of a spanning forest that takes the lightest ones: in rounds, each component's lightest edge to another."""
    root, chosen = np.arange(n), np.zeros(len(a), bool)
    order = np.argsort(weight, kind="stable")
    a, b = a[order], b[order]
    while True:
        ra, rb = root[a], root[b]
        out = np.flatnonzero(ra != rb)
        if not len(out):
            return order[chosen]
        first = np.full(n, len(a))
        np.minimum.at(first, ra[out], out)
        np.minimum.at(first, rb[out], out)
        picked = np.unique(first[first < len(a)])
        chosen[picked] = True
        root = forest(n, np.concatenate([np.arange(n), a[picked]]), np.concatenate([root, b[picked]]))


def near_runs(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of texts within the radius, of rows (k, i, j, fp, uid) sorted by k, i, j, fp: a lightest spanning forest of each run."""
    held: list[np.ndarray] = []

    def parts(starts: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
        """Long runs one by one, as their pairs take room; short ones between them together."""
        ends = np.append(starts[1:], n)
        at = 0
        for k in np.flatnonzero(ends - starts > 128).tolist():
            if starts[k] > at:
                yield at, int(starts[k])
            yield int(starts[k]), int(ends[k])
            at = int(ends[k])
        if at < n:
            yield at, n

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        new = np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))
        # texts with one fingerprint follow each other and are linked in a row; one of them is compared
        same = np.flatnonzero(~new & np.append(False, rows[1:, 3] == rows[:-1, 3]))
        keep = np.flatnonzero(new | np.append(True, rows[1:, 3] != rows[:-1, 3]))
        some = rows[keep]
        starts = np.flatnonzero(new[keep])
        values = np.ascontiguousarray(some[:, 3]).view(np.uint64)
        x, y = [rows[same - 1, 4]], [rows[same, 4]]
        for s, e in parts(starts, len(some)):
            a, b = near_pairs(values[s:e], starts[(starts >= s) & (starts < e)] - s, radius)
            pick = spanning(e - s, a, b, np.bitwise_count(values[s:e][a] ^ values[s:e][b]))
            x.append(some[s + a[pick], 4])
            y.append(some[s + b[pick], 4])
        x, y = np.concatenate(x), np.concatenate(y)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    for batch in batches:
        rows = np.stack([np.asarray(batch.column(i).to_numpy(zero_copy_only=False), dtype=np.int64) for i in range(5)], axis=1)
        rows = np.concatenate([*held, rows]) if held else rows
        changes = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
        if not len(changes):
            held = [rows]
            continue
        held = [rows[changes[-1] :]]
        yield edges(rows[: changes[-1]])
    if held and len(held[0]):
        yield edges(held[0])


def crossing(odd: list[bytes], sizes: np.ndarray, labels: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j) of different labels that can be similar enough, and a bound of how far apart they are, in parts.

    A pair of similarity s differs in (1 - s) / (1 + s) of the sum of both sizes.
    """
    widths = np.array([len(x) for x in odd])
    kinds = np.unique(widths)
    share = (1 - similarity) / (1 + similarity)
    plane = {int(w): np.flatnonzero(widths == w) for w in kinds}
    words = {w: np.frombuffer(b"".join(odd[i] for i in at), "<u8").reshape(len(at), -1) for w, at in plane.items()}
    for w, one in plane.items():
        for w2, two in plane.items():
            if w2 < w or sizes[one].max() < similarity * sizes[two].min():
                continue
            mine, other = words[w], words[w2]
            while other.shape[1] > mine.shape[1]:
                other = other[:, : other.shape[1] // 2] ^ other[:, other.shape[1] // 2 :]
            for at in range(0, len(one), 256):
                rows = one[at : at + 256]
                both = sizes[rows][:, None] + sizes[two][None]
                near = np.minimum(sizes[rows][:, None], sizes[two][None]) >= similarity * np.maximum(sizes[rows][:, None], sizes[two][None]) - 1e-6
                near &= labels[rows][:, None] != labels[two][None]
                if w2 == w:
                    near &= rows[:, None] < two[None]
                if not near.any():
                    continue
                apart = np.zeros(near.shape, np.int32)
                for p in range(mine.shape[1]):
                    apart += np.bitwise_count(mine[at : at + 256, p][:, None] ^ other[:, p][None])
                near &= apart <= share * both + 1e-6
                x, y = np.nonzero(near)
                yield rows[x], two[y], apart[x, y] / both[x, y]


def lightest(labels: np.ndarray, parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs in parts, a lightest spanning forest of the labels; when most pairs are held, that of the pairs so far stands for them."""
    names, place = np.unique(labels, return_inverse=True)
    held, n = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], 0

    def forest_of(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, weight = (np.concatenate(x) for x in zip(*held))
        pick = spanning(len(names), place[a], place[b], weight)
        return a[pick], b[pick], weight[pick]

    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= most:
            held, n = [forest_of(held)], 0
    return forest_of(held)[:2]


def crossing_runs(batches: Iterator[pa.RecordBatch], similarity: float, whole: bool) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of different components, of rows (k, i, j, uid, label, n, odd) sorted by k, i, j: all that can be similar, or (not whole) a lightest forest of components for each run."""
    held: tuple[np.ndarray, list[bytes]] | None = None

    def pairs(rows: np.ndarray, odd: list[bytes], ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y, found, start = [], [], 0, 0
        for end in ends.tolist():
            run, start = slice(start, end), end
            uid, label, sizes = rows[run, 3], rows[run, 4], rows[run, 5]
            if (label == label[0]).all():
                continue
            parts = crossing(odd[run], sizes, label, similarity)
            for a, b in ((a, b) for a, b, _ in parts) if whole else [lightest(label, parts)]:
                x.append(uid[a])
                y.append(uid[b])
                found += len(a)
                if found >= 1 << 16:
                    yield _edges(np.concatenate(x), np.concatenate(y))
                    x, y, found = [], [], 0
        if found:
            yield _edges(np.concatenate(x), np.concatenate(y))

    for batch in batches:
        rows = np.stack([np.asarray(batch.column(i).to_numpy(zero_copy_only=False), dtype=np.int64) for i in range(6)], axis=1)
        odd = batch.column(6).to_pylist()
        if held:
            rows, odd = np.concatenate([held[0], rows]), held[1] + odd
        changes = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
        if not len(changes):
            held = (rows, odd)
            continue
        held = (rows[changes[-1] :], odd[changes[-1] :])
        yield from pairs(rows, odd, changes)
    if held and len(held[0]):
        yield from pairs(*held, np.array([len(held[0])]))


def _edges(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def shingle_set(text: str, size: int) -> np.ndarray:
    words = text.encode().lower().split()
    if len(words) < size:
        words, size = [b" ".join(words)], 1
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in map(b" ".join, zip(*[words[i:] for i in range(size)]))), dtype="<u8"))


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Of (a, b, text of a): the shingles of a in place of the text; rows of one text follow each other."""
    last, data = None, b""
    for batch in batches:
        at, held, out = 0, 0, []
        for i, (uid, t) in enumerate(zip(batch.column("a").to_pylist(), batch.column("t"))):
            if uid != last:
                last, data = uid, shingle_set(t.as_py(), size).tobytes()
            out.append(data)
            held += len(data)
            if held >= 4 << 20 or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([batch.column("a")[at : i + 1], batch.column("b")[at : i + 1], pa.array(out, pa.binary())], ["a", "b", "shingles"])
                at, held, out = i + 1, 0, []


def _similar(batches: Iterator[pa.RecordBatch], size: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Of (a, b, shingles of a, text of b): the pairs whose shingle sets are similar enough."""
    last, mine = None, np.empty(0, np.uint64)
    for batch in batches:
        keep = []
        for uid, t, data in zip(batch.column("b").to_pylist(), batch.column("t"), batch.column("shingles")):
            if uid != last:
                last, mine = uid, shingle_set(t.as_py(), size)
            other = np.frombuffer(data.as_py(), "<u8")
            both = len(np.intersect1d(mine, other, assume_unique=True))
            keep.append(both >= similarity * (len(mine) + len(other) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


#: Tables of hashes are broadcast up to this many rows.
BROADCAST_ROWS = 200_000


def near_copies(docs: DataFrame, text: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 16, functions: int = 8, chunk: int = CHUNK) -> DataFrame:
    """(uid, node) of the distinct texts that have a near copy: uid is the text's hash, node its component.

    Two texts are near copies if the Jaccard similarity of their word shingles is at least
    similarity. Texts of one block (equal smallest shingle hash under one of the functions;
    two near copies miss all of them with a chance of 0.2 ** 8 at 0.8) are compared by
    bit-sliced distance, in chunks where a block is large; of what is within the radius each
    chunk gives the closest links, a spanning forest, and those are verified on whole texts. What this leaves apart is compared
    again, at any distance: of the pairs of a block that join two components and that their
    sizes and parities do not rule out, first a spanning forest is verified, and then all that
    still join two. So every similar pair of a block ends in one component.

    Null texts count as empty; empty and blank texts have the empty shingle and are copies of
    each other. Rows that repeat a text are one text. Very long texts are compared whole. An
    empty table gives an empty one. Other columns are not looked at.
    """
    ship(docs.sparkSession)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.struct(F.xxhash64(t).alias("uid")).alias("row"), t.alias("t"))
    number = F.lit(0).cast("long")
    like = rows.select("row", number.alias("fp"), F.array(number).alias("keys"), number.alias("n"), F.lit(b"").alias("odd")).schema
    marks = rows.mapInArrow(lean(lambda b: sketches(b, shingle, functions)), like).select("row.uid", "fp", "keys", F.col("n").alias("size"), "odd")
    marks = written(marks.groupBy("uid").agg(*[F.first(c).alias(c) for c in ("fp", "keys", "size", "odd")]), "simhash-sketches")
    keyed = marks.select("uid", "fp", F.posexplode("keys").alias("f", "key")).select("uid", "fp", F.xxhash64("f", "key").alias("k"))

    one_tile = F.col("n") <= 2 * chunk

    def chunked(sized: DataFrame) -> DataFrame:
        """Rows (k, i, j, fp, uid), sorted, each in one chunk of its block, which differs by block; sized has the block's number of rows as n."""
        m = F.when(one_tile, F.lit(1)).otherwise(F.ceil(F.col("n") / chunk)).cast("int")
        own = F.pmod(F.xxhash64("fp", "k"), m).cast("int")
        return sized.select("k", own.alias("i"), own.alias("j"), "fp", "uid").repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "fp", "uid")

    def tiled(sized: DataFrame, *carried: str) -> DataFrame:
        """Rows in tiles of their blocks, sorted by k, i, j and the carried columns, so that each two of different labels meet.

        sized has the block's number of rows as n, its most frequent label as main and the rows of that
        as most. Where that makes fewer rows, these are dealt in chunks of their own, which do not meet
        each other. A tile has two different chunks, and all pairs of both are compared. Chunks are as many
        as the root of what chunks of the fixed size would be: a row is in about as many tiles, and the
        tiles grow alike.
        """
        pieces = lambda n: F.ceil(F.sqrt(n / chunk)).cast("int")
        n, most = F.col("n"), F.col("most")
        apart = most * pieces(n - most) + (n - most) * (pieces(most) + pieces(n - most) - 1) < n * (pieces(n) - 1)
        sized = sized.withColumn("m1", F.when(apart, pieces(most)).otherwise(0)).withColumn("m", F.when(one_tile, F.lit(1)).when(apart, pieces(most) + pieces(n - most)).otherwise(pieces(n)))
        other = (F.col("m1") == 0) | (F.col("label") != F.col("main"))
        own = F.when(one_tile, F.lit(0)).when(other, F.col("m1") + F.pmod(F.xxhash64("uid", F.lit(1)), F.col("m") - F.col("m1"))).otherwise(F.pmod(F.xxhash64("uid", F.lit(1)), F.col("m1"))).cast("int")
        start = F.when(one_tile | other, F.lit(0)).otherwise(F.col("m1"))
        met = F.filter(F.sequence(start, F.col("m") - 1), lambda j: one_tile | (j != own))
        tiles = F.transform(met, lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
        out = sized.select("k", *carried, F.explode(tiles).alias("t")).select("k", "t.i", "t.j", *carried)
        return out.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", *carried[:2])

    def similar(asked: DataFrame) -> DataFrame:
        involved = small_or_not(written(asked.select(F.explode(F.array("a", "b")).alias("uid")).distinct(), "simhash-involved"), BROADCAST_ROWS)
        texts = rows.select("row.uid", "t").join(involved, "uid", "left_semi").dropDuplicates(["uid"])
        one = asked.join(texts.withColumnRenamed("uid", "a"), "a").mapInArrow(lean(lambda b: _sets(b, shingle)), "a long, b long, shingles binary")
        return one.join(texts.withColumnRenamed("uid", "b"), "b").mapInArrow(lean(lambda b: _similar(b, shingle, similarity)), "a long, b long")

    counts = keyed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    together = chunked(keyed.join(counts, "k"))
    asked = written(together.mapInArrow(lean(lambda b: near_runs(b, radius)), "a long, b long").distinct(), "simhash-asked")
    links = written(similar(asked), "simhash-similar")
    found = components(links, "simhash-copies")
    for whole in (False, True):
        label = F.coalesce("component", "uid").alias("label")
        labelled = marks.join(small_or_not(found, BROADCAST_ROWS), F.col("uid") == F.col("node"), "left").select("uid", label, "size", "odd", F.posexplode("keys").alias("f", "key"))
        labelled = labelled.select("uid", "label", "size", "odd", F.xxhash64("f", "key").alias("k"))
        mixed_ = labelled.groupBy("k", "label").agg(F.count("*").alias("n")).groupBy("k").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top")).filter("n > top.n")
        mixed_ = mixed_.select("k", "n", F.col("top.n").alias("most"), F.col("top.label").alias("main"))
        together = tiled(labelled.join(mixed_, "k"), "uid", "label", "size", "odd")
        more = together.mapInArrow(lean(lambda b, whole=whole: crossing_runs(b, similarity, whole)), "a long, b long").distinct()
        more = written(more.join(asked, ["a", "b"], "left_anti"), "simhash-asked")
        if more.isEmpty():
            continue
        new = written(similar(more), "simhash-similar")
        asked = asked.unionAll(more)
        if not new.isEmpty():
            links = links.unionAll(new)
            found = components(links, "simhash-copies")
    return found.withColumnsRenamed({"node": "uid", "component": "node"})


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", **limits) -> DataFrame:
    """docs with one document of each group of near copies: that with the smallest key (nulls last), of equal ones that with the smallest hash.

    Only keys and hashes go through the search for groups. Null texts count as empty; blank
    texts are copies of each other; of rows that repeat one stays. Very long texts are
    compared whole; an empty table gives an empty one; extra columns are kept.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    name = F.col(f"`{key}`")
    ids = written(docs.select(F.coalesce(name.cast("string"), F.lit("")).alias("wk"), name.alias("key"), name.isNull().alias("wl"), F.xxhash64(t).alias("uid")), "simhash-ids")
    groups = small_or_not(near_copies(docs, text, **limits).withColumnRenamed("uid", "g_uid"), BROADCAST_ROWS)
    named = ids.join(groups, ids.uid == F.col("g_uid"), "left").withColumn("c", F.coalesce("node", "uid"))
    first = named.groupBy(F.col("c").alias("fc")).agg(F.min(F.struct("wl", "key", "uid", "wk")).alias("w"), F.count("*").alias("size")).filter("size > 1")
    first = small_or_not(written(first, "simhash-first"), BROADCAST_ROWS)
    # of groups of more than one, all but the first go
    lost = named.join(first, F.col("c") == F.col("fc")).filter(~(F.col("wl").eqNullSafe(F.col("w.wl")) & (F.col("wk") == F.col("w.wk")) & (F.col("uid") == F.col("w.uid"))))
    lost = small_or_not(written(lost.select("wk", "wl", "uid").distinct(), "simhash-lost"), BROADCAST_ROWS)
    again = named.groupBy("wk", "wl", "uid").agg(F.count("*").alias("n")).filter("n > 1").select("wk", "wl", "uid")
    again = small_or_not(written(again, "simhash-again"), BROADCAST_ROWS)
    whole = F.coalesce(F.col("row").getField(text), F.lit(""))
    mine = F.col("row").getField(key)
    rows = packed(docs).select("row", F.coalesce(mine.cast("string"), F.lit("")).alias("wk"), mine.isNull().alias("wl"), F.xxhash64(whole).alias("uid"))
    on = ["wk", "wl", "uid"]
    left = rows.join(lost, on, "left_anti")
    # rows that repeat both key and text are few, unless the table is odd; only they are shuffled for it
    once = left.join(again, on, "left_anti").unionAll(left.join(again, on, "left_semi").dropDuplicates(on).select(*left.columns))
    return once.select(*unpacked("row", docs.columns))

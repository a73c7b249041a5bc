"""SimHash near-duplicates (operator 7).

Fingerprints are 64-bit SimHashes of word shingles.  Two fingerprints link when at most ``radius``
bits differ.  Links are found with BK-trees (children keyed by the integer Hamming distance to the
parent; a search follows only the edges within the radius):

* Distinct fingerprints only: copies never meet in pairs.
* A BK-tree over everything would be one unbounded object, and broadcasting its shards would grow
  with the data.  So the trees are sharded by pigeonhole: 4 blocks of 16 bits, at least one equal in
  any pair within 3 bits, and again 4 sub-blocks of the other 48 bits: 16 keys of 28 bits for each
  fingerprint.  A linked pair shares at least one key, so no link is lost, and each shard's tree lives
  only in the task that holds the shard.  Nothing is broadcast.  Large shards are dealt into pairs of blocks (``dealt``).
* A task builds all its trees level by level with numpy, in insertion order, searches them, and emits
  only a spanning forest of the links that it found, never all pairs of a group.
* Components: alternating large-star and small-star rounds over the forest edges, each round
  written to the shared folder.

``keep_one`` is for sets of word shingles at a similarity of 0.8, by default their cosine (the shingles in common, of the geometric mean of both
numbers), which is what the bits of a SimHash estimate: two texts differ in about 64 * angle / pi of them, 13 at a cosine of 0.8.  ``measure="jaccard"`` asks for more (0.8 there
is a cosine of 0.89).  Its fingerprints count each distinct shingle once, as the similarity does.  At that distance no bits need be equal.  So its shards are
keyed by twelve pairs of minimum hashes of the shingle set (a pair of documents at a cosine of 0.8 has a Jaccard similarity of 0.64 at least and shares a key
with probability 0.998), the BK-trees in them are searched with a radius of 28 bits (far in the tail of that binomial), and an edge counts if the
sketches estimate a similarity of ``AT_LEAST`` or more, less ``SIGMAS`` standard errors.  A sketch cuts the hash space into ``CELLS`` cells and keeps 8
bits of the smallest hash in each: short texts have nearly all their shingles in it, so their estimate is nearly exact.

Nulls and empty texts: no words, fingerprint zero, linked like any other.  Repeated rows: both get the
same fingerprint and component.  A null doc_id never becomes a component_id unless its component has
no other id (then component_id is null).  Extra columns are ignored by ``near_duplicates`` and kept
by ``keep_one``.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.llm.common import materialize, table

BLOCK_BITS, SUB_BITS, BITS = 16, 12, 64
#: Rows of a partition that are turned into trees at once; a shard is never cut.
FOREST_ROWS = 400_000
#: Pairs (query, node) that a search holds at once, at the start of each chunk of queries.
SEARCH_ROWS = 100_000

#: A shard of more rows is dealt into pairs of blocks, about this many rows for each root of its size.
WHOLE_SHARD, BLOCK_ROOTS = 256, 8

KEYS, WIDE_RADIUS, AT_LEAST, SIGMAS = 12, 28, 0.8, 2.0
MINIMA = 2 * KEYS
CELLS = 1024
#: Pairs of sketches that are compared at once, and rows with sketches that are turned into trees at once.
SKETCH_PAIRS, SKETCH_ROWS = 4096, 10_000
_FACTORS = np.random.default_rng(8).integers(1 << 20, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ``width`` words of a UTF-8 text, A-Z lower-cased."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, dtype="<u8")
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, 42)], dtype="<u8")
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype="<u8")


def simhash(text: bytes | None, width: int = 3) -> int:
    return simhash_of(shingle_hashes(text or b"", width))


def simhash_of(h: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; 0 if there are none."""
    if not len(h):
        return 0
    octets = h.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_hash, fp): one row per document, without the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(t, width) for t in b.column(2).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.encode("text", "UTF-8").alias("t"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _alike(sketch: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """Whether the sketches in rows ``a`` and ``b`` estimate a similarity of AT_LEAST or more, less SIGMAS standard errors.

    The similarity is Jaccard's, or with ``sizes`` (numbers of shingles) the cosine, which is a limit of its own on Jaccard's for each pair.
    """
    out = []
    for lo in range(0, len(a), SKETCH_PAIRS):
        i, j = a[lo : lo + SKETCH_PAIRS], b[lo : lo + SKETCH_PAIRS]
        x, y = sketch[i], sketch[j]
        least = np.full(len(i), AT_LEAST)
        if sizes is not None:
            common = AT_LEAST * np.sqrt(sizes[i].astype(float) * sizes[j])
            least = common / np.maximum(sizes[i] + sizes[j] - common, 1)
        used = np.count_nonzero(x | y, axis=1)
        equal = CELLS - np.count_nonzero(x ^ y, axis=1) - (CELLS - used)
        # the used cells are a sample, without replacement, of as many shingles as fill that many cells
        shingles = -CELLS * np.log1p(-np.minimum(used, CELLS - 0.5) / CELLS)
        spread = np.sqrt(np.maximum(least * (1 - least), 0) * used * np.maximum(1 - used / np.maximum(shingles, 1), 0))
        out.append((equal >= least * used - SIGMAS * spread - 1e-9) & (least <= 1))
    return np.concatenate(out) if out else np.empty(0, dtype=bool)


def cells(h: np.ndarray) -> np.ndarray:
    """One octet per cell of the hash space: 0 if no hash is in it, else 1 to 255 from the smallest one."""
    out = np.zeros(CELLS, dtype=np.uint8)
    if len(h):
        h = np.sort(h)
        cell = (h >> np.uint64(64 - (CELLS - 1).bit_length())).astype(np.int64)
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        out[cell[first]] = 1 + (h[first] & np.uint64(0xFFFF)) % np.uint64(255)
    return out


def min_hashes(h: np.ndarray) -> np.ndarray:
    """MINIMA minimum hashes (32 bits) of a set of 64-bit hashes."""
    x = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(x), 2048):
        y = x[lo : lo + 2048, None] * _FACTORS
        y ^= y >> np.uint32(15)
        y *= _FACTORS[::-1]
        out = np.minimum(out, y.min(axis=0))
    return out


def bk_forest(shard: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """BK-trees of all shards at once (rows of a shard are adjacent, fingerprints distinct in it).

    Returns root, parent and edge label of each row, and the rows of each depth below the roots: the trees that inserting row after row gives.
    """
    n = len(fp)
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    root = np.repeat(first, np.diff(np.r_[first, n]))
    parent, label, depths = root.copy(), np.zeros(n, dtype=np.int64), []
    active = np.flatnonzero(np.arange(n) != root)
    at = root[active]
    while active.size:
        d = np.bitwise_count(fp[active] ^ fp[at]).astype(np.int64)
        key = at * (BITS + 1) + d
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        child = active[order[new]]
        parent[child], label[child] = at[order[new]], d[order[new]]
        depths.append(child)
        to = np.empty_like(active)
        to[order] = np.repeat(child, np.diff(np.r_[new, len(order)]))
        deeper = to != active
        active, at = active[deeper], to[deeper]
    return root, parent, label, depths


def _whole(comp: np.ndarray, parent: np.ndarray, depths: list[np.ndarray]) -> np.ndarray:
    """The component of each row's subtree if all of it is in one, else -1."""
    out = comp.copy()
    for rows in reversed(depths):
        up = parent[rows]
        out[up[out[rows] != comp[up]]] = -1
    return out


def _merged(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Local roots after the links (a, b)."""
    while True:
        ra, rb = comp[a], comp[b]
        differ = ra != rb
        if not differ.any():
            return comp
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(comp, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(comp, up := comp[comp]):
            comp = up


def _alike_pairs(q: np.ndarray, node: np.ndarray, comp: np.ndarray, sketch: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (q, node), alike ones that join every q to each component it belongs to.

    The pairs of one q with one component are tried in growing steps, and no more once one of them is alike: a group of many
    near copies costs about one comparison per member, and no link between components is lost.
    """
    a, b, step = [], [], 1
    while len(q):
        key = comp[q] * len(comp) + comp[node]
        order = np.argsort(key, kind="stable")
        q, node, key = q[order], node[order], key[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        nth = np.arange(len(key)) - np.repeat(new, np.diff(np.r_[new, len(key)]))
        now = np.flatnonzero(nth < step)
        hit = now[_alike(sketch, q[now], node[now], sizes)]
        a.append(q[hit]), b.append(node[hit])
        rest = (nth >= step) & ~np.isin(key, key[hit])
        q, node, step = q[rest], node[rest], step * 4
    return (np.concatenate(a), np.concatenate(b)) if a else (q, node)


def forest_links(shard: np.ndarray, fp: np.ndarray, radius: int, sketch: np.ndarray | None = None, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (row, row of its local root) of all pairs within ``radius`` in a shard.

    A subtree that lies in the query's own component is not entered: a group of many near copies, linked after the first steps, costs no
    comparison per pair.
    """
    n = len(fp)
    root, parent, label, depths = bk_forest(shard, fp)
    inner = np.flatnonzero(root != np.arange(n))
    kids = inner[np.argsort(parent[inner], kind="stable")]
    begin = np.searchsorted(parent[kids], np.arange(n + 1))
    comp = np.arange(n)
    whole = _whole(comp, parent, depths)
    for lo in range(0, len(inner), SEARCH_ROWS):
        q = inner[lo : lo + SEARCH_ROWS]
        node = root[q]
        while q.size:
            d = np.bitwise_count(fp[q] ^ fp[node]).astype(np.int64)
            near = np.flatnonzero((d <= radius) & (comp[q] != comp[node]))
            if len(near):
                last = comp.copy()
                comp = _merged(comp, *((q[near], node[near]) if sketch is None else _alike_pairs(q[near], node[near], comp, sketch, sizes)))
                if not np.array_equal(comp, last):
                    whole = _whole(comp, parent, depths)
            enter = whole[node] != comp[q]
            q, d, node = q[enter], d[enter], node[enter]
            count = begin[node + 1] - begin[node]
            at = np.repeat(begin[node] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            q, d, node = np.repeat(q, count), np.repeat(d, count), kids[at]
            follow = (np.abs(label[node] - d) <= radius) & (node < q)  # a subtree's rows all come after its root
            q, node = q[follow], node[follow]
    rows = np.flatnonzero(comp != np.arange(n))
    return rows, comp[rows]


def _forest(radius: int, sketched: bool = False, cosine: bool = False):
    """Of rows (shard, fp[, node, n, sketch]) sorted by shard: forest edges between fps (or nodes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(shard: np.ndarray, fp: np.ndarray, node: np.ndarray, sizes: np.ndarray | None = None, sketch: np.ndarray | None = None) -> pa.RecordBatch:
            a, b = forest_links(shard, fp, radius, sketch, sizes if cosine else None)
            ends = np.unique(np.stack([node[a], node[b]], axis=1), axis=0) if len(a) else np.empty((0, 2), dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["u", "v"])

        held: list[np.ndarray] = []
        for b in batches:
            new = [b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2 if sketched else 1).to_numpy()]
            if sketched:
                octets = b.column(4)
                new += [b.column(3).to_numpy(), np.frombuffer(octets.buffers()[2], dtype=np.uint8)[octets.offset * CELLS : (octets.offset + len(octets)) * CELLS].reshape(-1, CELLS)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            if len(held[0]) >= (SKETCH_ROWS if sketched else FOREST_ROWS) and (cut := int(np.searchsorted(held[0], held[0][-1]))):
                yield links(*[x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held and len(held[0]):
            yield links(*held)

    return run


def dealt(keys: DataFrame) -> DataFrame:
    """(shard, node) of rows (shard, node), ready to be searched shard by shard.

    A shard of one node has no link and goes; shards are counted first, as small rows.  One of c > WHOLE_SHARD nodes would be a hot task: its nodes are
    dealt into B = sqrt(c) / BLOCK_ROOTS blocks by a hash, and each pair of blocks is a shard of its own.  Every two nodes still meet, a node travels B times
    and a task gets about 2 * BLOCK_ROOTS * sqrt(c) of them.
    """
    counts = materialize(keys.groupBy(F.col("shard").alias("_s")).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1"), "shards")
    blocks = F.when(F.col("_c") > WHOLE_SHARD, F.ceil(F.sqrt("_c") / BLOCK_ROOTS)).otherwise(1).cast("int")
    rows = keys.join(counts, F.col("shard") == F.col("_s")).withColumn("_b", blocks)
    rows = rows.select("shard", "node", "_b", F.pmod(F.xxhash64("node"), F.col("_b")).alias("_own"), F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("_other"))
    pair = F.xxhash64("shard", F.least("_own", "_other"), F.greatest("_own", "_other"))
    return rows.select(F.when(F.col("_b") == 1, F.col("shard")).otherwise(pair).alias("shard"), "node")


def hamming_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(u, v): edges that connect the distinct values of ``fps.fp`` (long) within ``radius`` <= 3 bits."""
    if not 0 <= radius <= 3:
        raise ValueError("the shards' keys hold every link up to a radius of 3")
    keys = []
    for i in range(4):
        block = F.shiftrightunsigned("fp", BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
        # the other 48 bits, side by side
        high = F.shiftrightunsigned(F.shiftrightunsigned("fp", BLOCK_BITS * i), BLOCK_BITS) if i < 3 else F.lit(0).cast("long")
        low = F.col("fp").bitwiseAND(F.lit((1 << (BLOCK_BITS * i)) - 1))
        rest = F.shiftleft(high, BLOCK_BITS * i).bitwiseOR(low)
        for j in range(4):
            sub = F.shiftrightunsigned(rest, SUB_BITS * j).bitwiseAND(F.lit((1 << SUB_BITS) - 1))
            keys.append(F.lit(i * 4 + j).cast("long") * (1 << 28) + block * (1 << SUB_BITS) + sub)
    shards = dealt(fps.select(F.explode(F.array(*keys)).alias("shard"), F.col("fp").alias("node")))
    shards = shards.withColumnRenamed("node", "fp").repartition("shard").sortWithinPartitions("shard", "fp")
    return shards.mapInArrow(_forest(radius), "u long, v long")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): label is the smallest node of each component.  Alternating star rounds.

    What edges are joined with is a table of its own: then a hub's edges are a plain shuffle, which Spark can split.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m")), "lowest")
        pairs = both.join(low, both.u == low.k).select("u", "v", "m")
        if large:  # each larger neighbour moves to the smallest one
            moved = pairs.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:  # edges go from larger to smaller nodes; all smaller ones and the node itself move
            moved = pairs.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).filter("u != v")
        return moved.distinct()

    def state(e: DataFrame) -> tuple[int, int]:
        n, s = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        return n, s

    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges")
    was = state(now)
    for _ in range(max_rounds if was[0] else 0):
        now = materialize(star(star(now, True), False), "edges")
        if (is_ := state(now)) == was:
            break
        was = is_
    else:
        if was[0]:
            raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def components_of(rows: DataFrame, links: DataFrame, node: str = "fp") -> DataFrame:
    """Adds component_id and first_hash (of the document that stays) to rows of (doc_id, text_hash, ``node``)."""
    last = F.lit((1 << 63) - 1)
    classes = rows.groupBy(node).agg(F.min(F.struct(F.coalesce("doc_id", last).alias("k"), "doc_id", "text_hash")).alias("first"))
    labels = connected_components(links).withColumnRenamed("node", "_n")
    named = materialize(classes.join(labels, classes[node] == labels._n, "left").select(node, "first", F.coalesce("label", node).alias("label")), "named")
    firsts = materialize(named.groupBy(F.col("label").alias("_label")).agg(F.min("first").alias("best")), "firsts")
    # both sides of either join are plain shuffles: a giant component, or one fingerprint of very many rows, is split
    ids = materialize(named.join(firsts, F.col("label") == F.col("_label")).select(F.col(node).alias("_fp"), "best"), "components")
    return rows.join(ids, rows[node] == ids._fp).select("doc_id", "text_hash", node, F.col("best.doc_id").alias("component_id"), F.col("best.text_hash").alias("first_hash"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    rows = materialize(with_fingerprint(docs, width), "simhash")
    hexa = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    links = hamming_links(rows.select("fp").distinct(), radius)
    return components_of(rows, links).select("doc_id", hexa.alias("fingerprint"), "component_id")


def with_sketch(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_hash, fp, node, n, keys, sketch); node stands for all texts with this fingerprint and sketch, n is the number of their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, nodes, sizes, keys, sketches = [], [], [], [], []
            for text in b.column(2):
                h = np.unique(shingle_hashes(text.as_py() or b"", width))  # a set: repeats would outweigh the other shingles in the fingerprint
                low = min_hashes(h)
                fps.append(simhash_of(h))
                sizes.append(len(h))
                sketches.append(cells(h).tobytes())
                nodes.append(xxhash.xxh64_intdigest(fps[-1].to_bytes(8, "little") + len(h).to_bytes(8, "little") + low.tobytes() + sketches[-1]))
                keys.append([xxhash.xxh64_intdigest(low[2 * k : 2 * k + 2].tobytes(), k) for k in range(KEYS)])
            long = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (fps, nodes, sizes)]
            flat = pa.array(np.array(keys, dtype=np.uint64).ravel().view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1) * KEYS, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *long, lists, pa.array(sketches, pa.binary())], names=["doc_id", "text_hash", "fp", "node", "n", "keys", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.encode("text", "UTF-8").alias("t"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long, node long, n long, keys array<long>, sketch binary")


def shingle_links(rows: DataFrame, measure: str = "cosine") -> DataFrame:
    """(u, v): forest edges between nodes of ``with_sketch`` rows that are alike; a sketch travels only to the shards that its node shares with another one."""
    if measure not in ("cosine", "jaccard"):
        raise ValueError("the similarity is a cosine or Jaccard's")
    keys = rows.groupBy("node").agg(F.first("keys").alias("keys")).select(F.explode(F.array_distinct("keys")).alias("shard"), "node")
    places = dealt(keys).withColumnRenamed("node", "_n")
    nodes = rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp", "n", "sketch")])
    shards = places.join(nodes, F.col("node") == F.col("_n")).select("shard", "fp", "node", "n", "sketch").repartition("shard").sortWithinPartitions("shard", "node")
    return shards.mapInArrow(_forest(WIDE_RADIUS, sketched=True, cosine=measure == "cosine"), "u long, v long")


def keep_one(docs: DataFrame, width: int = 5, measure: str = "cosine") -> DataFrame:
    """The documents that stay, all columns: of each component the one with the smallest doc_id (then text hash), once."""
    rows = materialize(with_sketch(docs, width), "sketches")
    last = F.lit((1 << 63) - 1)
    stay = components_of(rows.select("doc_id", "text_hash", "node"), shingle_links(rows, measure), "node").select(F.coalesce("component_id", last).alias("_k"), F.col("first_hash").alias("_h")).distinct()
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), last).alias("_k"), F.xxhash64("text").alias("_h"))
    return keyed.join(stay, ["_k", "_h"], "left_semi").dropDuplicates(["_k", "_h"]).select("_row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=3)

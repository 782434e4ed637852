"""Near-duplicate detection with BagMinHash.

Documents are bags of shingles of five words; likeness is the weighted Jaccard index, shared occurrences over all
occurrences, and links are pairs of at least 0.8. Documents with equal words are one node.

Signature. Each shingle of weight w runs Poisson processes over the discretised weights (0, 1], (1, 2], (2, 4], (4, 8] ...
up to w: one of rate 1, one of rate 1, one of rate 2, and so on. A point has a time, a component of the signature and
a weight; it counts if its weight is at most w. Of each component the earliest point stays, so two documents agree on a component
with probability equal to their likeness. Points are drawn in order of time for all shingles of a batch at once, until
none can come before a component's earliest. Signatures have BANDS x ROWS components of 16 bits.

Search. Nodes that agree on all rows of a band share a bucket; a pair of likeness 0.8 misses all buckets with
probability 0.000003. First the smallest node of each bucket is compared with the others, and components are found among
the verified links. Buckets that still hold several components are open; nodes that open buckets connect are a family. Each pair of
a family across components is then verified exactly, but for those whose sizes exclude a link. A family of more than ``BLOCK`` nodes or
``BLOCK_WORDS`` words is dealt into blocks by size and apart from its largest component, and each pair of blocks that may hold a link is one
group of rows, visited once. The shared counts of all pairs of a group are computed in the task, and a spanning forest of
the links leaves it: no bucket is emitted as pairs. Nothing is capped: the rows grow with the nodes times the blocks of their family, the
comparisons with the square of a family (less its largest component).

Scale. Texts are scanned twice and never shuffled: once for the signatures, once for the bags of those nodes that share a bucket
(told by a bitmap of fixed size). Copies are pre-aggregated by a digest of their words. A bucket's smallest node sends its bag once
for each ``LEADER_BLOCK`` of the others. Buckets, families, components and copies that are counted to be frequent are dealt out in
joins. Components are found in tables.

Edge cases. A null text counts as empty. A text of fewer than five words is one shingle; texts without words are equal to each other. Null
and repeated ids are allowed; a class is named by its smallest id (null last), and of a class the row with that id, and
of such rows exactly one, is kept. Texts are never cut. ``near_dedup`` returns the input's columns, whatever
their names. An empty table gives an empty result. An input whose rows might come in another order when read again (anything but
a scan with projections and filters) is written to scratch first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import col, discard, fresh, materialize, settled, skew_join
from tarn.llm.components import components
from tarn.llm.tokens import ChunkCache, Chunked, held_cache, returning, small_batches, spaced

WORDS, LIKENESS = 5, 0.8
BANDS, ROWS = 32, 5
BLOCK, BLOCK_WORDS, LEADER_BLOCK, FILTER_BITS = 512, 1 << 20, 256, 1 << 26
#: Bytes of text whose signatures are drawn at once.
BYTES = 1 << 20
#: Words a worker keeps with their hashes.
MAX_WORDS = 250_000
#: Shingles of more nodes of a group than this are counted by matrix products of so many columns.
_OFTEN, _COLUMNS = 24, 4096

_M = BANDS * ROWS
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C[1]
    x = (x ^ (x >> np.uint64(27))) * _C[2]
    return x ^ (x >> np.uint64(31))


def _word(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


class Bags:
    """The bags of a batch of texts: (owner, shingle, count), sorted; sizes and digests by text."""

    def __init__(self, texts: pa.Array, cache: ChunkCache):
        found = Chunked(spaced(texts), cache)
        n = len(texts)
        owner = np.repeat(np.arange(n), np.diff(found.bounds))[found.full]
        words = found.numbers()[found.full]
        n_words = np.bincount(owner, minlength=n)
        ends = np.cumsum(n_words)
        self.digests = [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends - n_words, ends, strict=True)]
        # A window of five words begins at each word; short texts have one window, of the words there are.
        last = np.maximum(ends - WORDS, ends - n_words)
        starts = np.arange(len(words)) <= last[owner]
        room = ends[owner] - np.arange(len(words))
        shingle = np.full(len(words), _C[3])
        padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
        for k in range(WORDS):
            shingle = np.where(room > k, _mix(shingle * _C[4] + padded[k : k + len(words)] + np.uint64(1)), shingle)
        shingle, owner = shingle[starts], owner[starts]
        order = np.lexsort((shingle, owner))
        shingle, owner = shingle[order], owner[order]
        new = np.ones(len(shingle), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        self.owner, self.shingle, self.count = owner[at], shingle[at], np.diff(np.append(at, len(shingle)))
        self.sizes = np.bincount(owner, minlength=n)

    def of_each(self) -> list[bytes]:
        """For each text its distinct shingles and their counts."""
        ends = np.cumsum(np.bincount(self.owner, minlength=len(self.sizes)))
        starts = np.concatenate([[0], ends[:-1]])
        return [self.shingle[a:b].tobytes() + self.count[a:b].astype("<u4").tobytes() for a, b in zip(starts, ends, strict=True)]


def likeness(a: bytes | memoryview, b: bytes | memoryview) -> float:
    """The weighted Jaccard index of two bags."""
    (x, p), (y, q) = ((np.frombuffer(z, "<u8", len(z) // 12), np.frombuffer(z, "<u4", len(z) // 12, len(z) // 12 * 8)) for z in (a, b))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(p[i], q[j]).sum())
    total = int(p.sum()) + int(q.sum()) - shared
    return shared / total if total else 1.0


def signatures(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """(n, BANDS * ROWS) uint16 signatures of the bags."""
    # One process for each shingle and dyadic range of weights that begins below its count.
    at, level, low = [np.arange(len(owner))], [np.zeros(len(owner), np.int64)], 1
    while (more := np.flatnonzero(count > low)).size:
        at.append(more)
        level.append(np.full(more.size, len(level)))
        low *= 2
    at, level = np.concatenate(at), np.concatenate(level)
    rate = np.where(level == 0, 1.0, 2.0 ** (level - 1))
    low = np.where(level == 0, 0.0, rate)
    seed = _mix(shingle[at] + level.astype(np.uint64) * _C[0])
    owner, most = owner[at], count[at].astype(np.float64)
    time = np.zeros(len(at))
    first = np.full(n * _M, np.inf)
    name = np.zeros(n * _M, np.uint16)
    step = 0
    active = np.arange(len(at))
    while active.size:
        step += 1
        z = _mix(seed[active] + np.array([step], np.uint64) * _C[3])
        time[active] -= np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[active]
        y = _mix(z + _C[0])
        cell = owner[active] * _M + ((y >> np.uint64(32)) % np.uint64(_M)).astype(np.int64)
        fits = low[active] + (y & np.uint64(0xFFFF)).astype(np.float64) * (rate[active] / 65536) < most[active]
        cell, when, own = cell[fits], time[active][fits], _mix(y)[fits]
        np.minimum.at(first, cell, when)
        won = first[cell] == when
        name[cell[won]] = (own[won] & np.uint64(0xFFFF)).astype(np.uint16)
        latest = first.reshape(n, _M).max(1)
        active = active[time[active] < latest[owner[active]]]
    return name.reshape(n, _M)


def _cache() -> ChunkCache:
    return held_cache(("words",), lambda: ChunkCache(lambda new: map(_word, new), pa.uint64(), most=MAX_WORDS))


def _signed(docs: DataFrame) -> DataFrame:
    """(row, id, digest, size, signature) of (id, text): a row for each input row; signature is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache()
        for batch, texts in small_batches(batches, "__text", BYTES):
            bags = Bags(texts, cache)
            signs = signatures(bags.owner, bags.shingle, bags.count, len(texts))
            columns = [pa.array(bags.digests, pa.binary()), pa.array(bags.sizes, pa.int64()), pa.array([s.tobytes() if k else None for s, k in zip(signs, bags.sizes, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["row", "id", "digest", "size", "signature"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long"), F.col("text").alias("__text"))
    return rows.mapInArrow(returning(run), "row long, id long, digest binary, size long, signature binary")


def _bags(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, bag) for the rows in ``wanted`` (node); tells most others by a bitmap of FILTER_BITS bits."""
    spot = F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS))
    words = wanted.select((spot / 8).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1), (spot % 8).cast("int")).alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").cast("int").alias("bits")).toArrow()  # FILTER_BITS / 8 at most
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    known = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, bitmap = _cache(), known.value
        for batch in batches:
            spots = batch.column(1).to_numpy()
            mask = pa.array((bitmap[spots >> 3] >> (spots & 7).astype(np.uint8) & 1).astype(bool))
            for piece, texts in small_batches([batch.filter(mask)], "__text", BYTES):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(Bags(texts, cache).of_each(), pa.binary())], ["node", "bag"])

    rows = docs.select(F.monotonically_increasing_id().alias("node"), F.col("text").alias("__text")).select("node", spot.alias("spot"), "__text")
    return rows.mapInArrow(returning(run), "node long, bag binary").join(wanted, "node", "left_semi")


def _verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bags are alike, of (a, b, n), where n is about how many partners a has.

    The partners of a node are dealt into blocks; a block's rows are the bag of a and then those of its partners.
    """
    parts = F.ceil(F.col("n") / LEADER_BLOCK).cast("long")
    dealt = pairs.select("a", "b", F.concat_ws("-", "a", parts, F.pmod(F.xxhash64("b"), parts)).alias("block"))
    blocks = materialize(dealt.select("a", "block").distinct(), "leader_blocks")
    counts = materialize(blocks.groupBy("a").agg(F.count("*").alias("n")), "leaders")
    led = skew_join(blocks, bags.select(F.col("node").alias("a"), "bag"), ["a"], "n", "block", counts=counts)
    others = dealt.join(bags.select(F.col("node").alias("b"), "bag"), "b")
    rows = led.select("block", F.lit(None).cast("long").alias("b"), "a", "bag").union(others.select("block", "b", "a", "bag"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = b""
        for batch in batches:
            out = []
            for b, a, bag in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if b is None:
                    leader = bag.as_py()
                elif likeness(leader, bag.as_buffer()) >= LIKENESS:
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.repartition("block").sortWithinPartitions("block", F.col("b").asc_nulls_first()).mapInArrow(returning(run), "a long, b long")


def _shared(bags: list[memoryview], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sizes of bags and the occurrences that each two share; if there are two sides, of bags on different ones."""
    n, lengths = len(bags), np.array([len(z) // 12 for z in bags])
    shingle = np.concatenate([np.frombuffer(z, "<u8", k) for z, k in zip(bags, lengths, strict=True)])
    count = np.concatenate([np.frombuffer(z, "<u4", k, k * 8) for z, k in zip(bags, lengths, strict=True)]).astype(np.int64)
    owner = np.repeat(np.arange(n), lengths)
    sizes = np.bincount(owner, count, n).astype(np.int64)
    _, name, nodes = np.unique(shingle, return_inverse=True, return_counts=True)
    some = nodes[name] > 1
    owner, name, count = owner[some], name[some], count[some]
    # The k-th occurrences of a shingle are one token, so that tokens in common are the smaller counts.
    most = int(count.max(initial=1))
    ends = np.cumsum(count)
    token = np.repeat(name, count) * most + np.arange(int(count.sum())) - np.repeat(ends - count, count)
    owner = np.repeat(owner, count)
    order = np.argsort(token, kind="stable")
    _, token, nodes = np.unique(token[order], return_inverse=True, return_counts=True)
    owner, nodes = owner[order], nodes[token]
    two = bool(side.any())
    shared = np.zeros((n, n), np.int64)
    rare = nodes <= _OFTEN
    x, t = owner[rare], token[rare]
    for k in range(1, min(_OFTEN, len(t))):
        same = np.flatnonzero(t[k:] == t[:-k])
        if not same.size:
            break
        i, j = x[same], x[same + k]
        if two:
            i, j = i[side[i] != side[j]], j[side[i] != side[j]]
        np.add.at(shared.reshape(-1), i * n + j, 1)
    shared += shared.T
    one, other = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(n), np.arange(n))
    often, column = np.unique(token[~rare], return_inverse=True)
    x = owner[~rare]
    cuts = np.searchsorted(column, np.arange(0, len(often) + _COLUMNS, _COLUMNS))  # tokens are sorted
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        has = np.zeros((n, min(_COLUMNS, len(often) - k * _COLUMNS)), np.float32)
        has[x[a:b], column[a:b] - k * _COLUMNS] = 1
        found = (has[one] @ has[other].T).astype(np.int64)
        shared[np.ix_(one, other)] += found
        if two:
            shared[np.ix_(other, one)] += found.T
    return sizes, shared


def _forest(linked: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of a symmetric matrix."""
    a, b, new = [], [], np.ones(len(linked), bool)
    for root in np.flatnonzero(linked.any(1)).tolist():
        waiting = [root] if new[root] else []
        new[root] = False
        while waiting:
            i = waiting.pop()
            near = np.flatnonzero(linked[i] & new)
            new[near] = False
            a += [i] * len(near)
            b += near.tolist()
            waiting += near.tolist()
    return a, b


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) from rows (block, side, node, component, bag) sorted by block: a spanning forest of the links across components of each block."""
    held: list[pa.Table] = []

    def flush() -> pa.RecordBatch:
        table = pa.concat_tables(held)
        held.clear()
        side, nodes, parts = (table.column(c).to_numpy() for c in ("side", "node", "component"))
        a, b = [], []
        if (parts != parts[0]).any() and (not side.any() or not side.all()):
            sizes, shared = _shared([memoryview(z.as_buffer()) for z in table.column("bag")], side)
            linked = (shared / (sizes[:, None] + sizes - shared) >= LIKENESS) & (parts[:, None] != parts)
            a, b = _forest(linked)
        a, b = nodes[np.array(a, np.int64)], nodes[np.array(b, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    current = None
    for batch in batches:
        blocks = batch.column(0).dictionary_encode()
        places = blocks.indices.to_numpy()
        cuts = [0, *(np.flatnonzero(places[1:] != places[:-1]) + 1).tolist(), len(places)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if x == y:
                continue
            name = batch.column(0)[x].as_py()
            if held and name != current:
                yield flush()
            current = name
            held.append(pa.Table.from_batches([batch.slice(x, y - x)]))
    if held:
        yield flush()


def _dealt(members: DataFrame) -> DataFrame:
    """(block, side, node, component) from (family, node, component, size): each two nodes of a family that may be linked meet in a block.

    They do but for two of the family's largest component and, in families dealt by size, those whose sizes exclude a link. A block
    is one group of nodes or two, told by ``side``.
    """
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("words") / BLOCK_WORDS))
    each = members.groupBy("family", "component").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    whole = each.groupBy("family").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.sum("n").alias("n"), F.sum("words").alias("words"))
    whole = whole.select("family", "main", "n", (blocks <= 1).alias("small"))
    # Sizes of linked nodes differ by 1 / LIKENESS at most, so by one step of a wider scale; two steps for each size tell the largest component.
    step = F.floor(F.log("size") / float(np.log(1.01 / LIKENESS)))
    step = F.when(F.col("small"), F.lit(0)).otherwise(2 * step + (F.col("component") == F.col("main")).cast("long")).cast("long")
    stepped = skew_join(members, materialize(whole, "whole_families"), ["family"], "n", "node").select("family", "node", "component", "size", step.alias("step"))
    stepped = materialize(stepped, "stepped")
    layout = stepped.groupBy("family", "step").agg(F.count("*").alias("n"), F.sum("size").alias("words")).select("family", "step", "n", blocks.cast("long").alias("blocks"))
    layout = layout.groupBy("family").agg(F.collect_list(F.struct("step", "blocks")).alias("layout"), F.sum("n").alias("n"))  # two for each size step
    of_step = F.filter("layout", lambda e: e["step"] == F.col("step"))[0]["blocks"]
    joined = skew_join(stepped, materialize(layout, "layouts"), ["family"], "n", "node").withColumn("code", F.call_function("shiftleft", F.col("step"), F.lit(32)) + F.pmod(F.xxhash64("node"), of_step))
    meets = lambda e: (F.abs(F.floor(e["step"] / 2) - F.floor(F.col("step") / 2)) <= 1) & ((e["step"] % 2 == 0) | (F.col("step") % 2 == 0))
    codes = lambda e: F.transform(F.sequence(F.lit(0).cast("long"), e["blocks"] - 1), lambda j: F.call_function("shiftleft", e["step"], F.lit(32)) + j)
    pairs = joined.withColumn("other", F.explode(F.flatten(F.transform(F.filter("layout", meets), codes))))
    name = F.concat_ws("-", "family", F.least("code", "other"), F.greatest("code", "other"))
    return pairs.select(name.alias("block"), (F.col("code") > F.col("other")).cast("int").alias("side"), "node", "component")


def _merged(parts: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """The components of nodes, merged by the links (a, b)."""
    if links.isEmpty():
        return parts
    starts = materialize(links.groupBy("a").agg(F.count("*").alias("n")), "starts")
    between = skew_join(links, parts.select(F.col("node").alias("a"), F.col("component").alias("p")), ["a"], "n", "b", counts=starts)
    between = between.join(parts.select(F.col("node").alias("b"), F.col("component").alias("q")).hint("merge"), "b")
    merged = components(between.select(F.col("p").alias("a"), F.col("q").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("into"))
    sizes = materialize(parts.groupBy("component").agg(F.count("*").alias("n")), "component_sizes")
    out = skew_join(parts, merged, ["component"], "n", "node", "left", counts=sizes).select("node", F.coalesce("into", "component").alias("component"))
    out = materialize(out, name)
    discard(starts, sizes)
    return out


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, class_id, class_size, kept): a row for each input row; ``row`` is its ``monotonically_increasing_id`` if the input is a scan."""
    docs = settled(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), "documents")
    signed = materialize(_signed(docs), "signatures")
    nodes = signed.groupBy("digest").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
    nodes = materialize(nodes.select("digest", "node", "copies", "first.id", "first.row"), "nodes")
    one = signed.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").filter("signature is not null").select(F.col("row").alias("node"), "size", "signature")
    band = F.explode(F.array(*[F.struct(F.lit(j).alias("band"), F.xxhash64(F.lit(j), F.substring("signature", 2 * ROWS * j + 1, 2 * ROWS)).alias("key")) for j in range(BANDS)]))
    keyed = one.select("node", band.alias("k")).select("node", "k.band", "k.key")
    buckets = materialize(keyed.groupBy("band", "key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1"), "leaders_of_buckets")
    shared = materialize(skew_join(keyed, buckets.withColumn("nodes", F.col("n")), ["band", "key"], "n", "node"), "buckets")
    wanted = materialize(shared.select("node").distinct(), "wanted")
    bags = materialize(_bags(docs, wanted), "bags")
    parts = materialize(wanted.select("node", F.col("node").alias("component")), "components")
    pairs = shared.filter("node <> leader").groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.max("nodes").alias("n"))
    pairs = materialize(pairs, "pairs")
    parts = _merged(parts, materialize(_verified(pairs, bags), "links0"), "components0")
    placed = shared.select("band", "key", "node").join(parts, "node")
    open_ = placed.groupBy("band", "key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).filter("x <> y").select("band", "key", "n")
    edges = skew_join(shared.filter("node <> leader"), materialize(open_, "open_buckets"), ["band", "key"], "n", "node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    families = components(edges).select("node", F.col("component").alias("family"))
    members = materialize(families.join(parts, "node").join(one.select("node", "size"), "node"), "families")
    discard(pairs, buckets, shared, wanted)
    rows = _dealt(members).join(bags, "node").select("block", "side", "node", "component", "bag")
    links = rows.repartition("block").sortWithinPartitions("block").mapInArrow(returning(_linked), "a long, b long")
    parts = _merged(parts, materialize(links.distinct(), "links1"), "components1")
    discard(bags, members)
    classed = materialize(nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "classes")
    whole = classed.groupBy("component").agg(F.sum("copies").alias("class_size"), F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("f"))
    whole = materialize(whole.select("component", "class_size", "n", F.col("f.id").alias("class_id"), F.col("f.row").alias("keep")), "whole_classes")
    named = skew_join(classed.select("digest", "component", F.col("copies").alias("n_copies")), whole, ["component"], "n", "digest")
    named = materialize(named.select("digest", "class_id", "class_size", "keep", "n_copies"), "named")
    rows = signed.select("row", "id", "digest")
    return skew_join(rows, named, ["digest"], "n_copies", "row").select("row", "id", "class_id", "class_size", (F.col("row") == F.col("keep")).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with the input's columns."""
    docs = settled(docs, "documents")
    row = fresh(docs, "__row")
    kept = near_groups(docs, id_col, text_col).filter("kept").select(F.col("row").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(kept, row, "left_semi").drop(row)

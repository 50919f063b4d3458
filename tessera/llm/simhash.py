"""SimHash near-duplicates: 64-bit fingerprints, linked through BK-trees, and connected components.

Equal fingerprints are made one first, so that copies cost nothing further. Each distinct
one is dealt to shards by blocks of its bits, so chosen that two within the radius
share a shard (of r + c blocks at most r differ, so c agree). Each shard has a
BK-tree: a node's children are keyed by their integer Hamming distance to it, and a
search follows only edges within the radius of its own distance to the node. Trees
travel with their shard to one task; broadcasting all of them would put every
fingerprint on the driver. Trees are bounded: a shard beyond max_tree members has
several, and each task searches one of them for the members of one of them.
A shard beyond that is split by further bits before. Of the links found, each task returns
a spanning forest, not all pairs.

Cases: a null or empty text, or one without words, has the fingerprint zero, and
zeros link like others; a very long text is one step's work; a bit set in exactly half the
shingles is 0; repeated rows share a fingerprint; a null id is smaller than
all others where the smallest id of a component is taken, but is returned as null;
an empty table gives an empty result; other columns are kept by keep_first()
whatever their names, and not read by components().
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER_NP, NULL_ID, SPACE, columns_of, drop_stored, fresh, map_texts, quoted, stored, texts_of, word_spans

ONES = np.uint64(0x0101010101010101)


def fingerprints(column: pa.Array, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text: bit b is set if over half the shingles' XXH64 values have it set."""
    raw, at = texts_of(column)
    low = LOWER_NP[raw]
    starts, ends, border = word_spans(low, at, ~SPACE)
    out = np.zeros(len(at) - 1, np.uint64)
    if not len(starts):
        return out
    # all words joined by single spaces: a shingle is then one slice
    size = ends - starts
    new_end = np.cumsum(size + 1) - 1
    new_start = new_end - size
    word = np.zeros(len(low) + 1, np.int64)
    word[starts] += 1
    word[ends] -= 1
    joined = np.full(int(new_end[-1]) + 1, 0x20, np.uint8)
    gaps = np.zeros(len(joined) + 1, np.int64)
    gaps[new_start] += 1
    gaps[new_end] -= 1
    joined[np.cumsum(gaps[:-1]) > 0] = low[np.cumsum(word[:-1]) > 0]
    text = joined.tobytes()
    n = np.diff(border)
    shingles = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(shingles)])
    heads = np.arange(first[-1]) - np.repeat(first[:-1], shingles) + np.repeat(border[:-1], shingles)
    tails = heads + np.repeat(np.minimum(n, shingle), shingles) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[s:e], seed) for s, e in zip(new_start[heads].tolist(), new_end[tails].tolist())), np.uint64, len(heads))
    return majority(hashes, shingles)


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of hashes in groups of these sizes, laid end to end: the bits set in over half of each group's; zero for an empty one."""
    out = np.zeros(len(sizes), np.uint64)
    first = np.cumsum(sizes) - sizes
    # eight bit counts in one integer: rows in parts of at most 255, so that no count runs over
    parts = -(-sizes // 255)
    owner = np.repeat(np.arange(len(sizes)), parts)
    cuts = first[owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
    if not len(cuts):
        return out
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & ONES, cuts)
        for j in range(8):
            count = np.bincount(owner, ((lanes >> np.uint64(8 * j)) & np.uint64(255)).astype(np.float64), len(sizes))
            out |= np.where(2 * count > sizes, np.uint64(1) << np.uint64(8 * j + k), np.uint64(0))
    return out


class BKTrees:
    """A forest of BK-trees over 64-bit values, one tree for each group; built and searched level by level in arrays."""

    def __init__(self, group: np.ndarray, value: np.ndarray):
        """group: sorted group numbers of the values; values of a group are distinct."""
        self.value = value
        n = len(value)
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
        self.root = heads[np.cumsum(np.concatenate([[True], group[1:] != group[:-1]])) - 1] if n else heads  # of each value's tree
        rest = np.setdiff1d(np.arange(n), heads)
        under = self.root[rest]
        while len(rest):  # each goes down one level; the first of those with the same parent and distance stays there
            distance = np.bitwise_count(value[rest] ^ value[under]).astype(np.int64)
            place, first, which = np.unique(under * 65 + distance, return_index=True, return_inverse=True)
            node = rest[first]
            parent[node], edge[node] = place // 65, place % 65
            stays = np.zeros(len(rest), bool)
            stays[first] = True
            rest, under = rest[~stays], node[which][~stays]
        child = np.flatnonzero(parent >= 0)
        self.key = np.sort(parent[child] * 65 + edge[child])
        self.child = child[np.argsort(parent[child] * 65 + edge[child], kind="stable")]

    def links(self, query: np.ndarray, root: np.ndarray, radius: int, step: int = 1 << 20):
        """Pairs (i, j) of query numbers and tree values within the radius; root: the tree that each query is searched in."""
        for a in range(0, len(query), step):
            who, node = np.arange(a, min(a + step, len(query))), root[a : a + step]
            while len(who):
                distance = np.bitwise_count(query[who] ^ self.value[node]).astype(np.int64)
                near = distance <= radius
                if near.any():
                    yield who[near], node[near]
                left = np.searchsorted(self.key, node * 65 + np.maximum(distance - radius, 1))
                many = np.searchsorted(self.key, node * 65 + np.minimum(distance + radius, 64), "right") - left
                many = np.maximum(many, 0)
                total = np.cumsum(many)
                node = self.child[np.repeat(left - np.concatenate([[0], total[:-1]]), many) + np.arange(total[-1])]
                who = np.repeat(who, many)
                if len(who) > 8 * step:  # a wide level is searched part by part, to bound memory
                    for b in range(0, len(who), step):
                        yield from self._on(query, who[b : b + step], node[b : b + step], radius, step)
                    break

    def _on(self, query, who, node, radius, step):
        for i, j in self.links(query[who], node, radius, step):
            yield who[i], j


def spanning(pairs: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Of the pairs between 0..n-1, each one's least reachable number: (i, least) for those that are not it themselves."""
    label = np.arange(n)
    if pairs:
        a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            new = new[new]
            while True:
                jump = new[new]
                if (jump == new).all():
                    break
                new = jump
            if (new == label).all():
                break
            label = new
    mine = np.flatnonzero(label != np.arange(n))
    return np.stack([mine, label[mine]], 1)


def plan_blocks(n: int, radius: int, fill: int = 64) -> list[np.ndarray]:
    """Bit masks such that two values within the radius agree on one of them; shards of an even spread would have fill members at most."""
    for agree in range(1, 5):
        blocks = radius + agree
        edge = np.linspace(0, 64, blocks + 1).astype(int)
        masks = [((1 << int(b)) - (1 << int(a))) for a, b in zip(edge[:-1], edge[1:])]
        shards = [sum(c) for c in combinations(masks, agree)]
        if n <= fill << min(m.bit_count() for m in shards):
            break
    return shards


def _cut_bits(mask: int, parts: int) -> list[int]:
    """The set bits of a mask, in so many masks."""
    bits = [1 << b for b in range(64) if mask >> b & 1]
    edge = np.linspace(0, len(bits), parts + 1).astype(int)
    return [sum(bits[a:b]) for a, b in zip(edge[:-1], edge[1:])]


def link_values(values: DataFrame, radius: int = 4, max_tree: int = 8192) -> DataFrame:
    """values: distinct fingerprints, column fp. Edges (a, b), a > b as unsigned, whose components are those of all links within the radius."""
    n = values.count()
    masks = plan_blocks(n, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    shards = values.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(signed)])).alias("s")).select("fp", "s.k", "s.v")
    # a shard that is too large is split by what two values within the radius must agree on of its other bits, too
    over = stored(shards.groupBy("k", "v").count().where(F.col("count") > max_tree).select("k", "v"))
    if not over.isEmpty():
        inner = [m - (1 << 64) if m >> 63 else m for mask in masks for m in _cut_bits(~mask & (1 << 64) - 1, radius + 1)]
        j = F.explode(F.sequence(F.lit(0), F.lit(radius)))
        split = shards.join(over, ["k", "v"]).withColumn("j", j).withColumn("m", F.element_at(F.array(*map(F.lit, inner)), F.col("k") * (radius + 1) + F.col("j") + 1))
        split = split.select("fp", (F.col("k") * (radius + 1) + F.col("j") + len(masks)).alias("k"), F.xxhash64("v", F.col("fp").bitwiseAND(F.col("m"))).alias("v"))
        shards = shards.join(over, ["k", "v"], "left_anti").unionByName(split)
    # trees of a shard that is too large for one even so: part p of it; task (p, q) searches tree p for the members of q
    sizes = shards.groupBy("k", "v").count().where(F.col("count") > max_tree).select("k", "v", F.ceil(F.col("count") / max_tree).cast("int").alias("parts"))
    dealt = shards.join(sizes, ["k", "v"], "left").withColumn("p", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")))
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    dealt = dealt.select("fp", "k", "v", F.least("p", "other").alias("p"), F.greatest("p", "other").alias("q"), (F.col("p") <= F.col("other")).alias("tree"))
    dealt = dealt.repartition("k", "v", "p", "q").sortWithinPartitions("k", "v", "p", "q", "tree")

    def link(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 100_000:
                done, rest = _whole_groups(held)
                if done is not None:
                    yield from _edges(done, radius)
                held, rows = [rest] if rest.num_rows else [], rest.num_rows
        if held:
            yield from _edges(pa.Table.from_batches(held).combine_chunks().to_batches()[0] if rows else held[0], radius)

    return dealt.mapInArrow(link, "a long, b long")


def _group_numbers(batch: pa.RecordBatch) -> np.ndarray:
    columns = [np.asarray(batch.column(i)) for i in range(1, 5)]
    new = np.zeros(batch.num_rows, bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _whole_groups(held: list[pa.RecordBatch]) -> tuple[pa.RecordBatch | None, pa.RecordBatch]:
    """The rows up to the last group's start, and that group, which may go on."""
    batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    group = _group_numbers(batch)
    cut = int(np.searchsorted(group, group[-1]))
    return (batch.slice(0, cut) if cut else None), batch.slice(cut)


def _edges(batch: pa.RecordBatch, radius: int):
    if not batch.num_rows:
        return
    group = _group_numbers(batch)
    value = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
    # in an off-diagonal group (p, q) the members of p are the tree and those of q are searched for; in a diagonal one all are both
    tree = np.asarray(batch.column(5).to_numpy(zero_copy_only=False), bool)
    diagonal = np.asarray(batch.column(3)) == np.asarray(batch.column(4))
    member = np.flatnonzero(tree | diagonal)
    trees = BKTrees(group[member], value[member])
    asks = np.flatnonzero(~tree | diagonal)
    heads = np.searchsorted(group[member], group[asks])
    ok = heads < len(member)
    ok[ok] = group[member][heads[ok]] == group[asks][ok]
    asks, heads = asks[ok], heads[ok]
    pairs, held = [], 0
    for i, j in trees.links(value[asks], heads, radius):
        a, b = asks[i], member[j]
        keep = a != b
        pairs.append((a[keep], b[keep]))
        held += len(a)
        if held > 1 << 22:  # many links are one component: keep its forest only
            forest = spanning(pairs, len(value))
            pairs, held = [(forest[:, 0], forest[:, 1])], len(forest)
    forest = spanning(pairs, len(value))
    if len(forest):
        a, b = value[forest[:, 0]], value[forest[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b).view(np.int64)), pa.array(np.minimum(a, b).view(np.int64))], ["a", "b"])


#: Edges of a graph that one task takes whole, at most: 16 bytes each, some ten times that while it works.
MAX_LOCAL_EDGES = 1 << 20


def _label_locally(batches):
    held = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches]
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*held)) if held else (np.zeros(0, np.int64),) * 2
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    out = spanning([(at[: len(a)], at[len(a) :])], len(node))
    yield pa.RecordBatch.from_arrays([pa.array(node[out[:, 0]]), pa.array(node[out[:, 1]])], ["node", "root"])


def label_components(edges: DataFrame, max_local: int = MAX_LOCAL_EDGES) -> DataFrame:
    """edges (a, b): each node that has any, with the least node that it reaches (signed order), as node and root; roots themselves are left out.

    Up to max_local edges are taken by one task. Beyond, alternating star contraction: each round hangs every node's
    neighbours on its least one, the greater neighbours first, then the smaller, until all edges lead to roots.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    if now.limit(max_local + 1).count() <= max_local:
        out = stored(now.repartition(1).mapInArrow(_label_locally, "node long, root long"))
        drop_stored(now)
        return out
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("a", "b", "m")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b")
        after = stored(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_stored(now)
        now = after
        if tuple(state) == before:
            break
        before = tuple(state)
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out._tessera_path = now._tessera_path
    return out


def _roots(marked: DataFrame, radius: int) -> DataFrame:
    """fp, root of every fingerprint that links to another."""
    return label_components(link_values(marked.select("fp").distinct(), radius)).select(F.col("node").alias("fp"), "root")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the smallest id that links reach) and n_same (rows with this fingerprint)."""
    slim = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints(part.column(1), shingle).view(np.int64))], ["id", "fp"])

    marked = stored(map_texts(slim, work, f"id {docs.schema[id_col].dataType.simpleString()}, fp long"))
    values = marked.groupBy("fp").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("least"), F.count("*").alias("n_same"))
    rooted = values.join(_roots(marked, radius), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = rooted.join(least, "root").select("fp", "component_id", "n_same")
    return marked.join(names, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_id.id").alias("component_id"), "n_same"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 5) -> DataFrame:
    """docs, its columns as they are, with one row of each component: that of its smallest id (any one of rows that repeat it)."""
    id_, text = F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(NULL_ID)), F.col(quoted(text_col))
    slim = docs.select(id_.alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fingerprints(part.column(2), shingle).view(np.int64))], ["id", "th", "fp"])

    slim = stored(map_texts(slim, work, "id long, th long, fp long"))
    values = slim.groupBy("fp").agg(F.min(F.struct("id", "th")).alias("first"))
    rooted = values.join(_roots(slim, radius), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    i, t = fresh(docs.columns, "__id", "__th")
    best = rooted.groupBy("root").agg(F.min("first").alias("best")).select(F.col("best.id").alias(i), F.col("best.th").alias(t))
    return docs.withColumns({i: id_, t: F.xxhash64(text)}).join(best, [i, t], "left_semi").dropDuplicates([i, t]).select(*columns_of(docs))

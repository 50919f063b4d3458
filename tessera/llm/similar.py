"""SimHash near-duplicates at a given Jaccard similarity of word shingles.

64-bit fingerprints within a small radius miss most texts that are similar by 0.8: there,
each bit differs with a chance of 0.15. So fingerprints are searched within a wide radius,
in shards small enough for that, and what is found is confirmed by the whole sets:

 1. Texts of equal shingle sets are made one first, so that copies cost nothing further.
 2. A set is dealt to SHARDS shards, each named by two least hashes of its shingles, under
    two of SHARDS orders laid in a ring. Two sets of similarity s share a least hash with
    chance s, so that all shards miss a pair with a chance of 2e-5 at 0.8, and less above.
 3. Each shard has a BK-tree of its fingerprints; a search follows only edges within RADIUS
    of its own distance to the node. Beyond it lie less than 1e-6 of the pairs at 0.8.
 4. Pairs found are compared by bitmaps of the parities of their hashes: bits that differ are
    at most as many as the shingles that do, so no link is lost, and few others are left.
    Of these a task hands on a spanning forest, the most alike first, which is confirmed by
    the Jaccard similarity of the whole sets. Where some are refused, the next round hands
    on other pairs between the components that are left (and for each text a few more), until
    there are none.

A shard beyond max_shard members is split by further least hashes. What is still too
large is held by texts alike in many of them: all its members are tried against the
one of fewest shingles, and then those that were refused, in parts, against all.

Cases: a text of fewer words than a shingle has one shingle, of all its words; texts
without words, null ones too, are alike; a null id is smaller than all others; rows that
repeat an id and a text are one; ties between documents go to the smaller id, then to
the smaller hash of the text; a very long text is one set, held by one task at a time; an
empty table gives an empty result; other columns are kept whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER_NP, NULL_ID, SPACE, columns_of, drop_stored, fresh, map_texts, mix, pieces, quoted, rolled, span_hashes, stored, texts_of, word_spans
from tessera.llm.simhash import BKTrees, label_components, majority, spanning

#: Shards of a text, the radius that fingerprints are searched within, and 64-bit words of a bitmap.
SHARDS, RADIUS, WORDS = 16, 24, 16

#: Pairs of a text that are asked for beside the forest, from the second round on.
MORE = 4

#: Members of a shard that one task compares, at most.
MAX_SHARD = 2048

_SEEDS = mix(np.arange(1, SHARDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(column: pa.Array, shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles' hashes of each text, ascending, laid end to end, and len + 1 borders."""
    raw, at = texts_of(column)
    low = LOWER_NP[raw]
    starts, ends, border = word_spans(low, at, ~SPACE)
    texts = len(at) - 1
    words = span_hashes(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    n = np.diff(border)
    whole = np.where(n >= shingle, n - shingle + 1, 0)
    owner = np.repeat(np.arange(texts), whole)
    heads = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole) + border[:-1][owner]
    hashes, owners = [mix(rolled(words, shingle)[heads])], [owner]
    for k in range(1, shingle):
        short = np.flatnonzero(n == k)
        if len(short):
            hashes.append(mix(rolled(words, k)[border[:-1][short]] + np.uint64(k)))
            owners.append(short)
    value, owner = np.concatenate(hashes), np.concatenate(owners)
    by = np.argsort(value, kind="stable")
    by = by[np.argsort(owner[by], kind="stable")]
    value, owner = value[by], owner[by]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.searchsorted(owner[new], np.arange(texts + 1))


def set_names(value: np.ndarray, border: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, equal for equal sets."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value + np.uint64(1)), dtype=np.uint64)])
    return mix(total[border[1:]] - total[border[:-1]] + np.diff(border).astype(np.uint64)).view(np.int64)


def parities(value: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Bit b of a set's bitmap: whether an odd number of its hashes are b modulo the bitmap's size."""
    sets, bits = len(border) - 1, 64 * WORDS
    place = np.repeat(np.arange(sets), np.diff(border)) * bits + (value % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(place, minlength=sets * bits) & 1).astype(np.uint8)
    return np.packbits(odd).reshape(sets, bits // 8)


def least_hashes(value: np.ndarray, border: np.ndarray) -> np.ndarray:
    """(sets, SHARDS): each set's least hash under each order; zero for empty sets."""
    out = np.zeros((len(border) - 1, SHARDS), np.uint64)
    some = np.flatnonzero(np.diff(border))
    if len(some):
        for k, seed in enumerate(_SEEDS):
            out[some, k] = np.minimum.reduceat(mix(value ^ seed), border[some])
    return out


def _lists(values: np.ndarray) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(values.ravel().view(np.int64)))


def _runs(column: np.ndarray) -> np.ndarray:
    """Borders of the runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1], [True]])) if len(column) else np.zeros(1, np.int64)


def by_groups(df: DataFrame, work, schema: str, *order: str) -> DataFrame:
    """work(batch) over whole groups of equal values of the first column, by which df is dealt; rows in the order of `order` in each."""

    def run(batches):
        held, rows, most = [], 0, 50_000
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:
                table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                cut = int(_runs(np.asarray(table.column(0)))[-2])
                if cut:
                    yield from work(table.slice(0, cut))
                held, rows = [table.slice(cut)], table.num_rows - cut
                most = max(50_000, 2 * rows)
        if rows:
            yield from work(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    key = df.columns[0]
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Numbers of the edges (a, b), first ones preferred, that join the components that label numbers as far as all edges do, without a cycle."""
    out = [np.zeros(0, np.int64)]
    left = np.arange(len(a))
    while True:
        x, y = label[a[left]], label[b[left]]
        left, x, y = left[x != y], x[x != y], y[x != y]
        if not len(left):
            return np.sort(np.concatenate(out))
        first = np.full(len(label), len(left))  # each component's first edge
        np.minimum.at(first, x, np.arange(len(left)))
        np.minimum.at(first, y, np.arange(len(left)))
        chosen = np.unique(first[first < len(left)])
        out.append(left[chosen])
        merged = np.arange(len(label))
        joined = spanning([(x[chosen], y[chosen])], len(label))
        merged[joined[:, 0]] = joined[:, 1]
        label = merged[label]


def alike(n: np.ndarray, m: np.ndarray, p: int, q: int) -> np.ndarray:
    """Whether sets of these sizes can have a similarity of p / q."""
    return p * np.maximum(n, m) <= q * np.minimum(n, m)


def pair_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a.view(np.uint64) ^ mix(b.view(np.uint64)))


def candidates(group: np.ndarray, name: np.ndarray, n: np.ndarray, fp: np.ndarray, root: np.ndarray, passive: np.ndarray, refused: np.ndarray, p: int, q: int, radius: int, more: int = 0, bitmap: np.ndarray | None = None) -> np.ndarray:
    """Pairs of rows, of one group each, that may be links: most alike first, as many as join all the components that such
    pairs join, and beside them the `more` most alike ones of each row.

    Rows are sorted by group and n. Two passive rows are in one component already and not compared. refused: pair_names()
    of pairs that are none, ascending.
    """
    _, label = np.unique(root, return_inverse=True)
    value = fp.view(np.uint64)
    by = np.lexsort((value, group))
    heads = np.ones(len(by), bool)
    heads[1:] = (group[by][1:] != group[by][:-1]) | (value[by][1:] != value[by][:-1])
    first = np.flatnonzero(heads)  # in `by`: the rows of each tree value
    many = np.diff(np.append(first, len(by)))
    trees = BKTrees(group[by][first], value[by][first])
    asks = np.flatnonzero(~passive)
    root_of = trees.root[np.searchsorted(group[by][first], group[asks])]
    held: list[np.ndarray] = []
    size = 0

    def apart(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Shares of shingles, at least, that are in one of both sets only; without bitmaps the fingerprints' bits that differ."""
        if bitmap is None:
            return np.bitwise_count(value[i] ^ value[j])
        out = [np.bitwise_count(bitmap[i[a : a + 4096]] ^ bitmap[j[a : a + 4096]]).sum(1, dtype=np.int64) for a in range(0, len(i), 4096)]
        return np.concatenate(out) / np.maximum(n[i] + n[j], 1) if out else np.zeros(0)

    def reduced() -> list[np.ndarray]:
        pairs = np.concatenate(held)
        i, j = pairs.T
        distance = apart(i, j)
        pairs = pairs[np.lexsort((name[j], name[i], distance))]
        use = np.zeros(len(pairs), bool)
        use[forest(pairs[:, 0], pairs[:, 1], label)] = True
        if more:
            ends, which = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.tile(np.arange(len(pairs)), 2)
            by_end = np.lexsort((which, ends))
            place = np.arange(len(ends)) - np.repeat(_runs(ends[by_end])[:-1], np.diff(_runs(ends[by_end])))
            use[which[by_end[place < more]]] = True
        return [pairs[use]]

    for i, node in trees.links(value[asks], root_of, radius, 1 << 18):
        i, k = np.repeat(asks[i], many[node]), many[node]
        j = by[np.repeat(first[node] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        keep = ((i < j) | passive[j]) & (label[i] != label[j]) & alike(n[i], n[j], p, q)
        i, j = i[keep], j[keep]
        if len(refused) and len(i):
            own = pair_names(name[i], name[j])
            asked = refused[np.minimum(np.searchsorted(refused, own), len(refused) - 1)] == own
            i, j = i[~asked], j[~asked]
        if bitmap is not None and len(i):
            # common shingles are at least p / (p + q) of both sets', so at most (q - p) / (p + q) differ
            near = apart(i, j) * (p + q) <= (q - p) * (1 + 1e-12)
            i, j = i[near], j[near]
        if len(i):
            held.append(np.stack([np.minimum(i, j), np.maximum(i, j)], 1))
            size += len(i)
            if size > 1 << 21:
                held = reduced()
                size = len(held[0])
    return reduced()[0] if held else np.zeros((0, 2), np.int64)


def shards(sets: DataFrame, max_shard: int, levels: int = 3) -> DataFrame:
    """key, name, n, fp for each shard of two members or more; key is null in none. Shards beyond max_shard are split by further least hashes."""
    key = F.xxhash64(F.col("i"), F.col("mins")[F.col("i")], F.col("mins")[(F.col("i") + 1) % SHARDS])
    dealt = sets.select("name", "n", "fp", "mins", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))).alias("i")).select(key.alias("key"), "name", "n", "fp", "i")
    out, made = None, []
    for level in range(1, levels + 1):
        sizes = stored(dealt.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
        made.append(sizes)
        mine = dealt.join(sizes if level == levels else sizes.where(F.col("members") <= max_shard), "key").select("key", "name", "n", "fp", *(["members"] if level == levels else [F.lit(0).cast("long").alias("members")]))
        out = mine if out is None else out.unionByName(mine)
        over = sizes.where(F.col("members") > max_shard)
        if level == levels or over.isEmpty():
            break
        # three ways to split it, so that few pairs are parted by all
        more = dealt.join(over, "key").join(sets.select("name", "mins"), "name").withColumn("j", F.explode(F.array(*[F.lit(3 * level - 1 + k) for k in range(3)])))
        dealt = more.select(F.xxhash64("key", "j", F.col("mins")[(F.col("i") + F.col("j")) % SHARDS]).alias("key"), "name", "n", "fp", "i")
    result = stored(out)
    drop_stored(*made)
    return result


_EDGE = "a long, b long"


def links(docs: DataFrame, sets: DataFrame, p: int, q: int, shingle: int, radius: int, max_shard: int) -> DataFrame:
    """Edges (a, b) between sets' names, whose components are those of all pairs found of similarity p / q or more.

    docs: id, th and text; sets: name, n, first (id and th of a row), fp, mins.
    """

    def several(batch: pa.RecordBatch):
        """The members of shards that may be links there, each shard named by them, so that equal ones become one."""
        key, name, n, fp = (np.asarray(batch.column(i)) for i in range(4))
        border = _runs(key)
        group = np.repeat(np.arange(len(border) - 1), np.diff(border))
        found = candidates(group, name, n, fp, np.arange(len(key)), np.zeros(len(key), bool), np.zeros(0, np.uint64), p, q, radius)
        stays = np.unique(found)
        total = np.zeros(len(border) - 1, np.uint64)
        np.add.at(total, group[stays], mix(name[stays].view(np.uint64) + np.uint64(1)))
        if len(stays):
            yield pa.RecordBatch.from_arrays([pa.array(total.view(np.int64)[group[stays]]), pa.array(name[stays]), pa.array(n[stays]), pa.array(fp[stays])], ["g", "name", "n", "fp"])

    def tied(batch: pa.RecordBatch, more: int = 0):
        g, name, n, fp, root = (np.asarray(batch.column(i)) for i in range(5))
        passive = np.asarray(batch.column(5).to_numpy(zero_copy_only=False), bool)
        border = _runs(g)
        group = np.repeat(np.arange(len(border) - 1), np.diff(border))
        # groups of one component have nothing to join
        mixed = np.zeros(len(border) - 1, bool)
        mixed[group[root != root[border[:-1]][group]]] = True
        use = np.flatnonzero(mixed[group])
        if not len(use):
            return
        lists = batch.column(6).fill_null(pa.scalar([], pa.list_(pa.int64()))) if batch.column(6).null_count else batch.column(6)
        each = np.diff(np.asarray(lists.offsets))
        refused = np.unique(pair_names(np.repeat(name, each), np.asarray(lists.flatten())))
        bitmap = np.frombuffer(b"".join(batch.column(7).take(pa.array(use)).to_pylist()), np.uint64).reshape(-1, WORDS)
        found = candidates(group[use], name[use], n[use], fp[use], root[use], passive[use], refused, p, q, radius, more, bitmap)
        if len(found):
            x, y = name[use][found[:, 0]], name[use][found[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    def confirm(batches):
        hub = None
        for batch in batches:
            for part in pieces(batch, "text"):
                value, border = shingle_sets(part.column(3), shingle)
                a, b, ok = part.column(0).to_pylist(), part.column(2).to_pylist(), []
                for i, other in enumerate(b):
                    own = value[border[i] : border[i + 1]]
                    if other is None:
                        hub = own
                    else:
                        common = len(np.intersect1d(hub, own, assume_unique=True))
                        ok.append((a[i], other, q * common >= p * (len(hub) + len(own) - common)))
                if ok:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*ok)], ["a", "b", "ok"])

    def confirmed(edges: DataFrame) -> DataFrame:
        """edges with ok; each a's text goes to a task with up to 256 of its b's."""
        parts = edges.groupBy("a").agg(F.ceil(F.count("*") / 256).alias("parts"))
        salted = edges.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("s"), "b")
        others = salted.join(texts.withColumnRenamed("name", "b"), "b").select("a", "s", "b", "text")
        hubs = salted.select("a", "s").distinct().join(texts.withColumnRenamed("name", "a"), "a").select("a", "s", F.lit(None).cast("long").alias("b"), "text")
        return others.unionByName(hubs).repartition("a", "s").sortWithinPartitions("a", "s", F.asc_nulls_first("b")).mapInArrow(confirm, "a long, b long, ok boolean")

    maps = sets.select("name", "bitmap")
    dealt = shards(sets, max_shard)
    usual, hot = dealt.where(F.col("members") <= max_shard), dealt.where(F.col("members") > max_shard).select(F.col("key").alias("g"), "name", "n", "fp")
    groups = by_groups(usual.select("key", "name", "n", "fp"), several, "g long, name long, n long, fp long", "n", "name").distinct()
    groups = stored(groups.join(maps, "name").select("g", "name", "n", "fp", "bitmap"))
    some_hot = not hot.isEmpty()
    involved = groups.select("name").unionByName(hot.select("name")).distinct()
    involved = sets.select("name", "first.id", "first.th").join(involved, "name", "left_semi")
    texts = stored(docs.join(involved, ["id", "th"]).select("name", "text").dropDuplicates(["name"]))  # of rows that repeat id and text
    made, done, edges, more = [groups, texts, dealt], None, None, 0
    while True:
        if done is None:
            label = lambda df: df.withColumn("root", F.col("name")).withColumn("refused", F.lit(None).cast("array<long>"))
        else:
            roots = label_components(edges).withColumnRenamed("node", "name")
            no = done.where("not ok")
            no = no.select(F.col("a").alias("name"), "b").unionByName(no.select(F.col("b").alias("name"), F.col("a").alias("b")))
            no = no.groupBy("name").agg(F.collect_set("b").alias("refused"))
            label = lambda df, roots=roots, no=no: df.join(roots, "name", "left").join(no, "name", "left").withColumn("root", F.coalesce("root", "name"))
        now = label(groups).select("g", "name", "n", "fp", "root", F.lit(False).alias("passive"), "refused", "bitmap")
        if not some_hot:
            found = by_groups(now, lambda batch, more=more: tied(batch, more), _EDGE, "n", "name")
        elif done is None:
            lead = hot.groupBy("g").agg(F.min(F.struct("n", "name", "fp")).alias("lead"))
            near = F.bit_count(F.col("fp").bitwiseXOR(F.col("lead.fp"))) <= radius
            star = hot.join(lead, "g").where((F.col("name") != F.col("lead.name")) & near & (p * F.col("n") <= q * F.col("lead.n")))
            found = by_groups(now, tied, _EDGE, "n", "name").unionByName(star.select(F.col("lead.name").alias("a"), F.col("name").alias("b")))
        else:
            found = by_groups(now.unionByName(_parts(label(hot.join(maps, "name")), max_shard)), lambda batch, more=more: tied(batch, more), _EDGE, "n", "name")
        found = stored(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        asked = found if done is None else found.join(done, ["a", "b"], "left_anti")
        answers = stored(confirmed(asked))
        made += [found, answers]
        new = answers.agg(F.count("*"), F.sum(F.when(F.col("ok"), 0).otherwise(1))).first()
        done = answers if done is None else done.unionByName(answers)
        edges = done.where("ok").select("a", "b")
        # each shard's components are joined as far as they can be; a hot one's rest is seen from the second round on
        if not new[0] or (not new[1] and not (some_hot and len(made) == 5)):
            edges = stored(edges)
            drop_stored(*made)
            return edges
        more = MORE


def _parts(hot: DataFrame, max_shard: int) -> DataFrame:
    """Members of hot shards in parts that one task compares: those not in the component of the shard's least one among each other and with all."""
    lead = hot.groupBy("g").agg(F.min(F.struct("n", "name", "root"))["root"].alias("lead"))
    known = hot.join(lead, "g").withColumn("passive", F.col("root") == F.col("lead"))
    sizes = known.groupBy("g").agg(F.ceil(F.sum(F.col("passive").cast("long")) / max_shard).alias("p_parts"), F.ceil(F.sum((~F.col("passive")).cast("long")) / max_shard).alias("a_parts"))
    known = known.join(sizes.where("a_parts > 0"), "g")
    own = F.when(F.col("passive"), F.pmod(F.xxhash64("name"), F.col("p_parts"))).otherwise(F.pmod(F.xxhash64("name"), F.col("a_parts")))
    known = known.withColumn("own", own)
    ranks = lambda n: F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1).cast("long")) - 1)
    kept = ["name", "n", "fp", "root", "passive", "refused", "bitmap"]
    # a task (kind, x, y): active part x with passive part y, or with active part y >= x
    with_active = known.where("not passive").withColumn("o", F.explode(ranks(F.col("a_parts")))).select(F.xxhash64("g", F.lit("a"), F.least("own", "o"), F.greatest("own", "o")).alias("g"), *kept)
    to_passive = known.where("not passive").withColumn("o", F.explode(ranks(F.col("p_parts")))).select(F.xxhash64("g", F.lit("p"), "own", "o").alias("g"), *kept)
    of_passive = known.where("passive").withColumn("o", F.explode(ranks(F.col("a_parts")))).select(F.xxhash64("g", F.lit("p"), "o", "own").alias("g"), *kept)
    return with_active.unionByName(to_passive).unionByName(of_passive)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = (4, 5), shingle: int = 5, radius: int = RADIUS, max_shard: int = MAX_SHARD) -> DataFrame:
    """docs, its columns as they are, with one row of each component of similar texts: that of its smallest id (any one of rows that repeat it)."""
    p, q = similarity
    id_, text = F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(NULL_ID)), F.col(quoted(text_col))
    slim = docs.select(id_.alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        value, border = shingle_sets(part.column(2), shingle)
        n = np.diff(border)
        prints = majority(mix(value ^ np.uint64(0xA0761D6478BD642F)), n)
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(set_names(value, border)), pa.array(n.astype(np.int64)), pa.array(prints.view(np.int64)), _lists(least_hashes(value, border)), pa.array([x.tobytes() for x in parities(value, border)], pa.binary())], ["id", "th", "name", "n", "fp", "mins", "bitmap"])

    marked = map_texts(slim, work, "id long, th long, name long, n long, fp long, mins array<long>, bitmap binary")
    sets = stored(marked.groupBy("name").agg(F.min(F.struct("id", "th")).alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("mins").alias("mins"), F.first("bitmap").alias("bitmap")))
    edges = links(slim, sets, p, q, shingle, radius, max_shard)
    rooted = sets.select("name", "first").join(label_components(edges).withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    best = stored(rooted.groupBy("root").agg(F.min("first").alias("best")).select("best.id", "best.th"))
    drop_stored(sets, edges)
    i, t = fresh(docs.columns, "__id", "__th")
    kept = docs.withColumns({i: id_, t: F.xxhash64(text)}).join(best.select(F.col("id").alias(i), F.col("th").alias(t)), [i, t], "left_semi")
    return kept.dropDuplicates([i, t]).select(*columns_of(docs))

"""Registered queries over the given tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import PolishConfig
from tessera.functions import sequence as S
from tessera.operators import layers as L
from tessera.operators.align import align_pair
from tessera.operators.ordinals import with_ordinal
from tessera.operators.prepare import rename_pairs, split_targets, subsample
from tessera.operators.resolve import resolve, shared_identity
from tessera.operators.select import best_per_run, fragment_filter, with_islands
from tessera.plans import fixtures as X
from tessera.plans import polish as P
from tessera.session import settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WINDOW = 500


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _documents(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", X.dna(F.coalesce("text", F.lit(""))).alias("data"))


@query(f"SELECT doc_id, reverse(translate(data, 'ATCG', 'TAGC')) AS rc, CAST(length(data) AS BIGINT) AS n FROM (SELECT doc_id, {X.SQL_DNA} AS data FROM documents)")
def seq_revcomp(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", S.reverse_complement(F.col("data")).alias("rc"), F.length("data").cast("long").alias("n"))


@query("SELECT doc_id, upper(regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g')) AS data FROM documents")
def seq_upper(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", S.upper_bases(F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", "")).alias("data"))


@query(f"""
SELECT doc_id, reverse(q) AS reversed, CASE WHEN regexp_matches(q, '[^!]') THEN q END AS known,
       CASE WHEN length(q) > 0 THEN list_sum(list_transform(string_split(q, ''), lambda c: ascii(c) - 33)) / length(q) END AS mean_quality
FROM (SELECT doc_id, translate({X.SQL_DNA}, 'ACGT', 'I5!?') AS q FROM documents)""")
def seq_quality_mean(spark, sf_dir):
    q = _documents(spark, sf_dir).select("doc_id", F.translate("data", "ACGT", "I5!?").alias("q"))
    return q.select("doc_id", S.reverse_quality(F.col("q")).alias("reversed"), S.known_quality(F.col("q")).alias("known"), S.mean_quality(F.col("q")).alias("mean_quality"))


@query(f"""
SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(length(data)) AS BIGINT) AS total, sum(length(data)) / count(*) AS mean, sum(length(data)) / count(*) > 1000 AS long_reads
FROM (SELECT {X.SQL_DNA} AS data FROM documents)""")
def seq_read_stats_window_type(spark, sf_dir):
    size = F.length("data").cast("long")
    mean = F.sum(size) / F.count("*")
    return _documents(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(size).alias("total"), mean.alias("mean"), (mean > 1000).alias("long_reads"))


@query("""
WITH t AS (SELECT 'c' || c_custkey AS name, max(c_custkey) AS ordinal FROM customer GROUP BY 1)
SELECT o_orderkey AS ordinal, 'c' || o_custkey AS name, CASE WHEN t.name IS NULL THEN 'q' || o_orderkey ELSE 't' || t.ordinal END AS uid
FROM orders LEFT JOIN t ON t.name = 'c' || o_custkey""")
def seq_dedup_identity(spark, sf_dir):
    reads = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"), F.concat(F.lit("c"), F.col("o_custkey")).alias("name"))
    targets = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ordinal"), F.concat(F.lit("c"), F.col("c_custkey")).alias("name"))
    return shared_identity(reads, targets).select("ordinal", "name", "uid")


#: What tells the rows of lineitem apart, but for their dates.
_NAMES = X.ORDER[:4]
_KEYS = ", ".join(_NAMES)


@query(f"""
WITH {X.SQL_OVERLAPS}, c AS (SELECT *, '5H3S' || cigar || '2S' AS clipped FROM laps),
z AS (SELECT *, list_zip(CAST(regexp_extract_all(clipped, '(\\d+)([MIDNSHPX=])', 1) AS BIGINT[]), regexp_extract_all(clipped, '(\\d+)([MIDNSHPX=])', 2)) AS ops FROM c),
s AS (SELECT *, CAST(list_sum(list_transform(ops, lambda o: CASE WHEN o[2] IN ('M','=','X','I') THEN o[1] ELSE 0 END)) AS BIGINT) AS q_aligned,
             CAST(list_sum(list_transform(ops, lambda o: CASE WHEN o[2] IN ('M','=','X','D','N') THEN o[1] ELSE 0 END)) AS BIGINT) AS t_aligned,
             CAST(list_sum(list_transform(ops, lambda o: CASE WHEN o[2] IN ('S','H') THEN o[1] ELSE 0 END)) AS BIGINT) AS clip FROM z)
SELECT {_KEYS}, q_aligned, t_aligned, CAST(CASE WHEN strand THEN clip - 5 ELSE 5 END AS BIGINT) AS first, CAST(CASE WHEN strand THEN clip + q_aligned - 5 ELSE 5 + q_aligned END AS BIGINT) AS last, clip + q_aligned AS total
FROM s""")
def cigar_spans(spark, sf_dir):
    c = X.overlaps(spark, sf_dir).withColumn("clipped", F.concat(F.lit("5H3S"), "cigar", F.lit("2S")))
    begin, end, length = S.query_range(F.col("clipped"), F.col("strand"))
    return c.select(*_NAMES, S.query_span(F.col("clipped")).alias("q_aligned"), S.target_span(F.col("clipped")).alias("t_aligned"), begin.alias("first"), end.alias("last"), length.alias("total"))


@query(f"WITH {X.SQL_OVERLAPS} SELECT {_KEYS}, CAST(CASE WHEN ordinal % 2 = 0 THEN 0 ELSE t_begin END AS BIGINT) AS clip FROM laps")
def cigar_clip_start(spark, sf_dir):
    c = X.ordered_overlaps(spark, sf_dir, *_NAMES, "cigar", "t_begin")
    cigar = F.when(F.col("ordinal") % 2 == 0, F.col("cigar")).otherwise(F.concat(F.col("t_begin").cast("string"), F.lit("S"), "cigar"))
    return c.select(*_NAMES, S.clip_start(cigar).alias("clip"))


@query(f"WITH {X.SQL_OVERLAPS} SELECT {_KEYS}, length, error FROM laps")
def overlap_error_len(spark, sf_dir):
    return X.overlaps(spark, sf_dir).select(*_NAMES, "length", "error")


@query(f"WITH {X.SQL_OVERLAPS} SELECT {_KEYS}, q_id, t_id, length FROM laps WHERE NOT (NOT isnan(error) AND error > 0.3) AND q_id <> t_id")
def overlap_filter_fragment(spark, sf_dir):
    return fragment_filter(X.overlaps(spark, sf_dir)).select(*_NAMES, "q_id", "t_id", "length")


@query(f"WITH {X.SQL_OVERLAPS} SELECT ordinal, q_id, ordinal - row_number() OVER (PARTITION BY q_id ORDER BY ordinal) AS island FROM laps")
def overlap_islands(spark, sf_dir):
    return with_islands(X.ordered_overlaps(spark, sf_dir, "q_id")).select("ordinal", "q_id", "island")


_BEST = f"""
WITH {X.SQL_OVERLAPS}, i AS (SELECT *, ordinal - row_number() OVER (PARTITION BY q_id ORDER BY ordinal) AS island FROM laps),
m AS (SELECT *, max(length) OVER (PARTITION BY q_id, island ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM i),
p AS (SELECT *, row_number() OVER (PARTITION BY q_id, island ORDER BY ordinal) AS place FROM m
      WHERE length > coalesce(later, -1) AND NOT (NOT isnan(error) AND error > 0.3) AND q_id <> t_id),
best AS (SELECT * FROM p WHERE place = 1)"""


@query(f"{_BEST} SELECT ordinal, q_id, t_id, island, length, error FROM best")
def overlap_best_per_run(spark, sf_dir):
    return best_per_run(X.ordered_overlaps(spark, sf_dir, "q_id", "t_id", "length", "error")).select("ordinal", "q_id", "t_id", "island", "length", "error")


_TILES = f"""
SELECT doc_id, CAST(rank AS BIGINT) AS rank, substr(data, CAST(rank * {WINDOW} + 1 AS BIGINT), {WINDOW}) AS backbone
FROM (SELECT doc_id, data, unnest(range(0, (length(data) - 1) // {WINDOW} + 1)) AS rank FROM (SELECT doc_id, {X.SQL_DNA} AS data FROM documents) WHERE length(data) > 0)"""


def _tiles(spark, sf_dir):
    return L.tiles(_documents(spark, sf_dir).withColumnRenamed("doc_id", "t_id"), WINDOW)


@query(f"SELECT doc_id, rank, backbone, repeat('!', length(backbone)) AS backbone_quality FROM ({_TILES})")
def target_tiling(spark, sf_dir):
    return _tiles(spark, sf_dir).withColumnRenamed("t_id", "doc_id")


_POINTS = f"""
WITH {X.SQL_OVERLAPS}, o AS (
  SELECT ordinal, t_id, t_begin, q_begin, unnest(range(1, len(n) + 1)) AS pos, n, c
  FROM (SELECT *, CAST(regexp_extract_all(cigar, '(\\d+)([MID])', 1) AS BIGINT[]) AS n, regexp_extract_all(cigar, '(\\d+)([MID])', 2) AS c FROM laps)
), b AS (
  SELECT ordinal, t_id, n[pos] AS n, c[pos] AS c,
         t_begin + coalesce(list_sum(list_transform(list_zip(n[1:pos - 1], c[1:pos - 1]), lambda o: CASE WHEN o[2] IN ('M','D') THEN o[1] ELSE 0 END)), 0) AS t0,
         q_begin + coalesce(list_sum(list_transform(list_zip(n[1:pos - 1], c[1:pos - 1]), lambda o: CASE WHEN o[2] IN ('M','I') THEN o[1] ELSE 0 END)), 0) AS q0
  FROM o
), x AS (
  SELECT *, unnest(range(CAST(t0 // {WINDOW} AS BIGINT), CAST((t0 + n - 1) // {WINDOW} AS BIGINT) + 1)) AS rank FROM b WHERE c = 'M' AND n > 0
), y AS (
  SELECT ordinal, t_id, rank, greatest(t0, rank * {WINDOW}) AS t1, least(t0 + n, (rank + 1) * {WINDOW}) AS t2, t0, q0 FROM x
), points AS (
  SELECT ordinal, t_id, CAST(rank AS BIGINT) AS rank, CAST(min(t1) AS BIGINT) AS t_first, CAST(min(q0 + t1 - t0) AS BIGINT) AS q_first, CAST(max(t2) AS BIGINT) AS t_last, CAST(max(q0 + t2 - t0) AS BIGINT) AS q_last
  FROM y GROUP BY ordinal, t_id, rank
), wide AS (SELECT * FROM points WHERE q_last - q_first >= 0.02 * {WINDOW} AND t_last - 1 <> t_first)"""


def _points(spark, sf_dir):
    own = X.ordered_overlaps(spark, sf_dir, "t_id", "cigar", "t_begin", "q_begin").withColumnRenamed("q_begin", "q_start")
    return L.breaking_points(own, ["ordinal", "t_id"], WINDOW)


@query(f"{_POINTS} SELECT ordinal, t_id, rank, t_first, q_first, t_last, q_last FROM points")
def breaking_points(spark, sf_dir):
    return _points(spark, sf_dir)


@query(f"{_POINTS} SELECT ordinal, t_id, rank, t_first - rank * {WINDOW} AS layer_begin, t_last - 1 - rank * {WINDOW} AS layer_end, q_first, q_last FROM wide")
def layers_filtered(spark, sf_dir):
    kept = _points(spark, sf_dir).where(L.wide_enough(WINDOW))
    start = F.col("rank") * WINDOW
    return kept.select("ordinal", "t_id", "rank", (F.col("t_first") - start).alias("layer_begin"), (F.col("t_last") - 1 - start).alias("layer_end"), "q_first", "q_last")


@query(f"{_BEST} SELECT p_partkey AS t_id, coalesce(n, 0) AS rc FROM part LEFT JOIN (SELECT t_id, count(*) AS n FROM best GROUP BY t_id) ON p_partkey = t_id")
def coverage_per_target(spark, sf_dir):
    targets = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("t_id"))
    return L.coverage(targets, best_per_run(X.ordered_overlaps(spark, sf_dir, "q_id", "t_id", "length", "error")))


@query(f"{_POINTS} SELECT depth, count(*) AS windows FROM (SELECT t_id, rank, count(*) AS depth FROM wide GROUP BY t_id, rank) GROUP BY depth")
def window_depth_histogram(spark, sf_dir):
    depth = _points(spark, sf_dir).where(L.wide_enough(WINDOW)).groupBy("t_id", "rank").agg(F.count("*").alias("depth"))
    return depth.groupBy("depth").agg(F.count("*").alias("windows"))


@query(f"""{_POINTS}, grid AS (
  SELECT p_partkey AS t_id, unnest(range(0, (999 + 50 * p_size) // {WINDOW} + 1)) AS rank FROM part
), d AS (SELECT t_id, rank, count(*) AS n FROM wide GROUP BY t_id, rank)
SELECT grid.t_id, CAST(grid.rank AS BIGINT) AS rank, coalesce(n, 0) AS layers, coalesce(n, 0) >= 2 AS polishable FROM grid LEFT JOIN d USING (t_id, rank)""")
def polishable_split(spark, sf_dir):
    grid = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("t_id"), F.explode(F.expr(f"sequence(0L, cast((999 + 50 * p_size) div {WINDOW} as bigint))")).alias("rank"))
    depth = _points(spark, sf_dir).where(L.wide_enough(WINDOW)).groupBy("t_id", "rank").agg(F.count("*").alias("n"))
    layers = F.coalesce("n", F.lit(0).cast("long"))
    return grid.join(depth, ["t_id", "rank"], "left").select("t_id", "rank", layers.alias("layers"), (layers >= 2).alias("polishable"))


@query("""
WITH r AS (SELECT 'c' || o_custkey AS name, max(o_orderkey) AS ordinal FROM orders GROUP BY 1),
t AS (SELECT 'c' || c_custkey AS name, max(c_custkey) AS ordinal FROM customer GROUP BY 1),
o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'c' || (l_orderkey % 4000) AS q, 'c' || (l_partkey % 2500) AS t, l_linestatus = 'O' AS ok FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN own.name IS NULL THEN 'q' || r.ordinal ELSE 't' || own.ordinal END AS q_id, 't' || t.ordinal AS t_id,
       r.ordinal AS q_ordinal, t.ordinal AS t_ordinal, CAST(100 AS BIGINT) AS t_length
FROM o JOIN r ON r.name = o.q JOIN t ON t.name = o.t LEFT JOIN t AS own ON own.name = o.q WHERE ok""")
def overlap_resolve(spark, sf_dir):
    """Overlaps by name to reads and targets, some of whose names repeat or are missing; invalid ones go."""
    length = F.lit(100).cast("long").alias("length")
    reads = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"), F.concat(F.lit("c"), F.col("o_custkey")).alias("name"), length)
    targets = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ordinal"), F.concat(F.lit("c"), F.col("c_custkey")).alias("name"), length)
    laps = X.table(spark, sf_dir, "lineitem").select(
        *_NAMES, F.expr("concat('c', l_orderkey % 4000)").alias("q_name"), F.expr("concat('c', l_partkey % 2500)").alias("t_name"), F.lit(100).cast("long").alias("q_length"), F.lit(0).cast("long").alias("t_length"), (F.col("l_linestatus") == "O").alias("is_valid")
    )
    return resolve(laps, shared_identity(reads, targets), targets).select(*_NAMES, "q_id", "t_id", "q_ordinal", "t_ordinal", "t_length")


@query(f"""
WITH d AS (SELECT doc_id, doc_id % 2 = 1 AS back, data, translate(data, 'ACGT', 'I5?+') AS q FROM (SELECT doc_id, {X.SQL_DNA} AS data FROM documents)),
o AS (SELECT doc_id, CASE WHEN back THEN reverse(translate(data, 'ATCG', 'TAGC')) ELSE data END AS data, CASE WHEN back THEN reverse(q) ELSE q END AS q FROM d),
x AS (SELECT doc_id, data, q, rank, rank * {WINDOW} + doc_id % 7 AS first, least((rank + 1) * {WINDOW}, length(data)) - doc_id % 5 AS past
      FROM (SELECT doc_id, data, q, unnest(range(0, (length(data) - 1) // {WINDOW} + 1)) AS rank FROM o WHERE length(data) > 0)),
s AS (SELECT doc_id, rank, first, past, substr(data, CAST(first + 1 AS BIGINT), CAST(past - first AS BIGINT)) AS data, substr(q, CAST(first + 1 AS BIGINT), CAST(past - first AS BIGINT)) AS quality
      FROM x WHERE past - first >= 0.02 * {WINDOW} AND past - 1 <> first)
SELECT doc_id, CAST(rank AS BIGINT) AS rank, CAST(first - rank * {WINDOW} AS BIGINT) AS layer_begin, CAST(past - 1 - rank * {WINDOW} AS BIGINT) AS layer_end, data, quality
FROM s WHERE list_sum(list_transform(string_split(quality, ''), lambda c: ascii(c) - 33)) / length(quality) >= 25""")
def layers_by_quality(spark, sf_dir):
    """Slices of each document's letters, every second one reversed, of a mean quality of 25 or more."""
    own = _documents(spark, sf_dir).withColumns({"back": F.col("doc_id") % 2 == 1, "q": F.translate("data", "ACGT", "I5?+")})
    reads = own.select(F.col("doc_id").alias("read"), F.col("back").alias("strand"), S.oriented(F.col("data"), F.col("back")).alias("data"), F.when(F.col("back"), S.reverse_quality(F.col("q"))).otherwise(F.col("q")).alias("quality"))
    grid = own.where(F.length("data") > 0).select("doc_id", F.col("doc_id").alias("read"), F.col("doc_id").alias("t_id"), F.col("back").alias("strand"), F.length("data").cast("long").alias("n"), F.explode(F.expr(f"sequence(0L, cast((length(data) - 1) div {WINDOW} as bigint))")).alias("rank"))
    first, past = F.col("rank") * WINDOW + F.col("doc_id") % 7, F.least((F.col("rank") + 1) * WINDOW, F.col("n")) - F.col("doc_id") % 5
    points = grid.withColumns({"t_first": first, "q_first": first, "t_last": past, "q_last": past})
    kept = L.layers(points, reads, ["doc_id"], WINDOW, 25.0)
    return kept.select("doc_id", "rank", F.col("begin").alias("layer_begin"), F.col("end").alias("layer_end"), "data", "quality")


@query(f"""{_POINTS}, grid AS (
  SELECT p_partkey AS t_id, unnest(range(0, (999 + 50 * p_size) // {WINDOW} + 1)) AS rank FROM part
), l AS (SELECT t_id, rank, ordinal, t_first - rank * {WINDOW} AS b, t_last - 1 - rank * {WINDOW} AS e FROM wide)
SELECT t_id, CAST(rank AS BIGINT) AS rank, count(ordinal) AS n, md5(coalesce(string_agg(b || ':' || ordinal || ':' || e, ',' ORDER BY b, ordinal), '')) AS layers
FROM grid LEFT JOIN l USING (t_id, rank) GROUP BY t_id, rank""")
def window_stacks(spark, sf_dir):
    """Each tile's layers in their order."""
    grid = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("t_id"), F.explode(F.expr(f"sequence(0L, cast((999 + 50 * p_size) div {WINDOW} as bigint))")).alias("rank"))
    start = F.col("rank") * WINDOW
    none = F.lit(None).cast("string")
    layered = _points(spark, sf_dir).where(L.wide_enough(WINDOW)).select("t_id", "rank", "ordinal", (F.col("t_first") - start).alias("begin"), (F.col("t_last") - 1 - start).alias("end"), none.alias("data"), none.alias("quality"))
    each = F.transform("layers", lambda x: F.concat_ws(":", x["begin"], x["ordinal"], x["end"]))
    return L.stacks(grid, layered, ["ordinal"]).select("t_id", "rank", F.size("layers").cast("long").alias("n"), F.md5(F.array_join(each, ",").cast("binary")).alias("layers"))


@query(f"""
WITH t AS ({_TILES}), w AS (SELECT doc_id, string_agg(backbone, '' ORDER BY rank) AS data, count(*) AS n, sum(CASE WHEN rank % 3 = 0 THEN 1 ELSE 0 END) AS p FROM t GROUP BY doc_id)
SELECT doc_id, 'd' || doc_id || ' LN:i:' || length(data) || ' RC:i:' || n || ' XC:f:' || printf('%.6f', p / n) AS name, data FROM w""")
def stitch_backbone(spark, sf_dir):
    kept = _tiles(spark, sf_dir).select("t_id", "rank", F.col("backbone").alias("consensus"), (F.col("rank") % 3 == 0).alias("polished"))
    name = S.tag(F.concat(F.lit("d"), F.col("t_id")), F.length("data"), F.col("windows"), F.col("polished"), F.col("windows"), False)
    return L.stitched(kept).select(F.col("t_id").alias("doc_id"), name.alias("name"), "data")


@query("""
SELECT event_id, '@u' || user_id || CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN '1' ELSE '2' END AS name FROM events""")
def pair_rename(spark, sf_dir):
    reads = X.table(spark, sf_dir, "events").select("event_id", "ts", F.concat(F.lit("@u"), "user_id", F.lit(" "), "event_type").alias("name"))
    return rename_pairs(reads, ["ts", "event_id"]).select("event_id", "name")


@query(f"""
SELECT doc_id, n, running FROM (SELECT doc_id, n, CAST(sum(n) OVER (ORDER BY (doc_id * 2654435761) % 4294967296, doc_id) AS BIGINT) AS running
FROM (SELECT doc_id, CAST(length({X.SQL_DNA}) AS BIGINT) AS n FROM documents)) WHERE running <= 30 * 5000""")
def subsample_coverage(spark, sf_dir):
    reads = _documents(spark, sf_dir).select("doc_id", F.length("data").cast("long").alias("n"), F.expr("(doc_id * 2654435761) % 4294967296").alias("k"))
    return subsample(reads, ["k", "doc_id"], F.col("n"), 5000, 30).select("doc_id", "n", "running")


@query(f"""
SELECT doc_id, CAST(before // 100000 AS BIGINT) AS chunk FROM (
  SELECT doc_id, coalesce(sum(length({X.SQL_DNA})) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)""")
def split_chunks(spark, sf_dir):
    return split_targets(_documents(spark, sf_dir), ["doc_id"], 100_000).select("doc_id", "chunk")


@query("SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INTEGER) AS distance FROM part")
def edit_distance_pairs(spark, sf_dir):
    return X.table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"))


@query(f"""
SELECT ordinal, CAST(length(data) AS BIGINT) AS t_aligned, CAST(length(query) AS BIGINT) AS q_aligned, CAST(levenshtein(query, data) AS BIGINT) AS cost
FROM (SELECT ordinal, data, array_to_string(list_transform(range(1, length(data) + 1), lambda i: CASE WHEN i % 37 = 0 THEN '' WHEN i % 23 = 0 THEN translate(data[i], 'ACGT', 'CGTA') ELSE data[i] END), '') AS query
FROM (SELECT doc_id AS ordinal, {X.SQL_DNA} AS data FROM documents) WHERE length(data) > 0)""")
def align_paths(spark, sf_dir):
    """Each document's letters without every 37th and with every 23rd changed, aligned to all of them: the path's spans and its cost."""
    own = _documents(spark, sf_dir).where(F.length("data") > 0)
    changed = F.transform(F.split("data", ""), lambda c, i: F.when((i + 1) % 37 == 0, "").when((i + 1) % 23 == 0, F.translate(c, "ACGT", "CGTA")).otherwise(c))
    pairs = P.spread(own.withColumn("query", F.array_join(changed, "")), "doc_id").withColumn("x", align_pair("query", "data"))
    return pairs.select(F.col("doc_id").alias("ordinal"), S.target_span(F.col("x.cigar")).alias("t_aligned"), S.query_span(F.col("x.cigar")).alias("q_aligned"), F.col("x.cost").alias("cost"))


def _run(spark, sf_dir):
    targets = settled(X.drafts(spark, sf_dir))  # read several times, as files would be
    reads = settled(X.noisy_reads(targets))
    return reads, X.whole_overlaps(reads), targets


@query()
def consensus_poa(spark, sf_dir):
    reads, overlaps, targets = _run(spark, sf_dir)
    config = PolishConfig()
    chosen = P.chosen_overlaps(reads, overlaps, targets, config)
    return P.polished_windows(P.build_windows(reads, chosen, targets, config), config, config.trim and P.long_reads(reads))


@query()
def polish_contigs(spark, sf_dir):
    reads, overlaps, targets = _run(spark, sf_dir)
    return P.polish(reads, overlaps, targets.drop("truth"), PolishConfig(include_unpolished=True))


@query()
def correct_fragments(spark, sf_dir):
    reads = settled(X.noisy_reads(X.drafts(spark, sf_dir), 4))
    pairs = reads.select("target", F.col("name").alias("t_name"), F.col("back").alias("t_back")).join(reads, "target").where("name <> t_name")
    overlaps = X.whole_overlaps(pairs.withColumns({"target": F.col("t_name"), "back": F.col("back") != F.col("t_back")}))
    overlaps = with_ordinal(overlaps.drop("ordinal"), ["q_name", "t_name"])
    sequences = reads.select("ordinal", "name", "data", "quality")
    return P.polish(sequences, overlaps, sequences, PolishConfig(match=1, mismatch=-1, gap=-1, fragment=True, include_unpolished=True))

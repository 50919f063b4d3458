"""Operators of the consensus engine on hand-written rows, random rows against brute force, and a seeded run end to end."""

import gzip
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tessera.cli import parser
from tessera.config import PolishConfig
from tessera.functions import sequence as S
from tessera.operators import layers as L
from tessera.operators.align import align, align_with_cost
from tessera.operators.ordinals import with_ordinal, with_running_sum
from tessera.operators.poa import trimmed, window_consensus
from tessera.operators.prepare import rename_pairs, split_targets, subsample
from tessera.operators.resolve import resolve, shared_identity
from tessera.operators.select import best_per_run, with_islands
from tessera.plans.polish import polish, polish_files, polish_in_chunks
from tessera.sources.files import fasta_lines, read_fastq, read_overlaps, read_sequences, write_fasta, write_fastq


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("cigar, strand, expected", [("5H3S10M", False, (5, 15, 18)), ("3S10M2S", True, (2, 12, 15)), ("4M2I3D1N2P1=1X", False, (0, 8, 8))])
def test_query_range(spark, cigar, strand, expected):
    begin, end, length = S.query_range(F.lit(cigar), F.lit(strand))
    assert tuple(one(spark, begin, end, length)) == expected


def test_scalars(spark):
    r = one(
        spark, S.reverse_complement(F.lit("acgtN")).alias("a"), S.reverse_complement(F.lit("AACGTN")).alias("b"), S.known_quality(F.lit("!!!!")).alias("c"), S.known_quality(F.lit("!#!")).alias("d"),
        S.mean_quality(F.lit("!+5")).alias("e"), S.fixed6(F.lit(1), F.lit(128)).alias("f"), S.fixed6(F.lit(1), F.lit(3)).alias("g"), S.overlap_error(F.lit(0), F.lit(0)).alias("h"), S.overlap_error(F.lit(8), F.lit(10)).alias("i"),
        S.too_wrong(F.lit(float("nan")), 0.3).alias("j"), S.too_wrong(F.lit(0.31), 0.3).alias("k"), S.target_span(F.lit("4M2I3D1N2P1=1X")).alias("l"),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("Ntgca", "NACGTT", None, "!#!", 10.0, "0.007812", "0.333333")
    assert r.h != r.h and r.i == pytest.approx(0.2) and r.j is False and r.k is True and r.l == 10


def rows_of(spark, runs):
    return spark.createDataFrame([(i, q, "t", n, 0.1 if ok else 0.9) for i, (q, n, ok) in enumerate(runs)], "ordinal long, q_id string, t_id string, length long, error double")


@pytest.mark.parametrize(
    "runs, expected",
    [
        ([("A", 5, 1), ("A", 10, 0), ("A", 3, 1), ("A", 7, 1)], [3]),
        ([("A", 5, 1), ("A", 5, 1)], [1]),
        ([("A", 5, 1), ("A", 9, 0)], []),
        ([("A", 5, 1), ("B", 5, 1), ("A", 5, 1)], [0, 1, 2]),
    ],
)
def test_tournament(spark, runs, expected):
    assert sorted(r.ordinal for r in best_per_run(rows_of(spark, runs)).collect()) == expected


def test_tournament_against_play(spark):
    rng = random.Random(1)
    runs = [(rng.choice("AB"), rng.randint(1, 6), rng.random() < 0.7) for _ in range(600)]
    alive, start = [True] * len(runs), 0
    for i in range(1, len(runs) + 1):
        if i == len(runs) or runs[i][0] != runs[start][0]:
            for a in range(start, i):  # each meets the later ones; a loser, or a wrong one, is out
                if not alive[a]:
                    continue
                if not runs[a][2]:
                    alive[a] = False
                    continue
                for b in range(a + 1, i):
                    if alive[b]:
                        if runs[a][1] > runs[b][1]:
                            alive[b] = False
                        else:
                            alive[a] = False
                            break
            start = i
    assert sorted(r.ordinal for r in best_per_run(rows_of(spark, runs)).collect()) == [i for i, x in enumerate(alive) if x]


def test_islands(spark):
    got = {r.ordinal: (r.q_id, r.island) for r in with_islands(rows_of(spark, [(q, 1, 1) for q in "AABAAB"])).collect()}
    assert len(set(got.values())) == 4 and got[0] == got[1] and got[3] == got[4]


def test_prefix_sums(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert all(r.ordinal == r.k for r in with_ordinal(df, ["k"]).collect())
    assert all(r.s == r.k * (r.k + 1) // 2 for r in with_running_sum(df, ["k"], F.col("k"), "s").collect())
    assert with_ordinal(df.where("1 = 0"), ["k"]).collect() == []


def points(spark, rows, w):
    df = spark.createDataFrame(rows, "key long, cigar string, t_begin long, q_start long")
    return sorted(tuple(r) for r in L.breaking_points(df, ["key"], w).collect())


def test_breaking_points(spark):
    assert points(spark, [(1, "4M6D4M", 0, 0)], 4) == [(1, 0, 0, 0, 4, 4), (1, 2, 10, 4, 12, 6), (1, 3, 12, 6, 14, 8)]
    rng, rows, want = random.Random(2), [], {}
    for key in range(120):
        ops = [(rng.randint(1, 9), rng.choice("MIDN=XSHP")) for _ in range(rng.randint(1, 8))]
        t, q = rng.randint(0, 30), rng.randint(0, 5)
        rows.append((key, "".join(f"{n}{c}" for n, c in ops), t, q))
        for n, c in ops:
            for _ in range(n):
                if c in "M=X":
                    t0, q0, *_ = want.get((key, t // 6), (t, q))
                    want[key, t // 6] = (t0, q0, t + 1, q + 1)
                t += c in "M=XDN"
                q += c in "M=XI"
    assert points(spark, rows, 6) == sorted((*k, *v) for k, v in want.items())


def test_layers_rules(spark):
    df = spark.createDataFrame([(0, 1, 0, 100), (0, 100, 0, 9), (0, 100, 0, 10)], "t_first long, t_last long, q_first long, q_last long")
    assert [tuple(r) for r in df.where(L.wide_enough(500)).collect()] == [(0, 100, 0, 10)]


def test_tiles(spark):
    df = spark.createDataFrame([("a", "ACGTA", None), ("b", "", None), ("c", "ACGT", "5555")], "t_id string, data string, quality string")
    assert sorted(tuple(r) for r in L.tiles(df, 4).collect()) == [("a", 0, "ACGT", "!!!!"), ("a", 1, "A", "!"), ("c", 0, "ACGT", "5555")]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def cost(cigar, q, t):
    import re

    i = j = total = 0
    for n, c in re.findall(r"(\d+)([MID])", cigar):
        for _ in range(int(n)):
            total += c != "M" or q[i] != t[j]
            i += c != "D"
            j += c != "I"
    assert (i, j) == (len(q), len(t))
    return total


def test_align(monkeypatch):
    rng = random.Random(3)
    for _ in range(150):
        t = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 70)))
        q = noisy(rng, t, rng.choice([0.02, 0.1, 0.3])) if rng.random() < 0.8 else "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 70)))
        assert cost(align(q, t), q, t) == distance(q, t)
    assert align("ACGT", "ACGT") == "4M" and align("", "AC") == "2D" and align("AC", "") == "2I"
    t = "".join(rng.choice("ACGT") for _ in range(900))
    for rate in (0.0, 0.1, 0.4):  # longer than the rows that are held
        q = noisy(rng, t, rate)
        cigar, own = align_with_cost(q, t)
        assert own == cost(cigar, q, t) == distance(q, t)
        monkeypatch.setattr("tessera.operators.align.HELD_CELLS", 1000)
        assert align_with_cost(q, t) == (cigar, own)
        monkeypatch.undo()


def test_align_holds_few_rows():
    """Ten thousand bases with every seventh changed: the whole table would be 330 MB."""
    rng = random.Random(4)
    t = "".join(rng.choice("ACGT") for _ in range(10_000))
    q = "".join(rng.choice("ACGT") if i % 7 == 0 else c for i, c in enumerate(t))
    tracemalloc.start()
    cigar, own = align_with_cost(q, t)
    assert own == cost(cigar, q, t) <= 1430 and tracemalloc.get_traced_memory()[1] < 40e6
    tracemalloc.stop()


def noisy(rng, text, rate):
    out = []
    for c in text:
        x = rng.random()
        if x < rate:
            out.append(rng.choice("ACGT"))
        elif x < 2 * rate:
            out += [c, rng.choice("ACGT")]
        elif x >= 3 * rate:
            out.append(c)
    return "".join(out)


def test_consensus_mends():
    rng = random.Random(4)
    truth = "".join(rng.choice("ACGT") for _ in range(200))
    draft = noisy(rng, truth, 0.03)
    layers = [{"begin": 0, "end": len(draft) - 1, "data": noisy(rng, truth, 0.03), "quality": None} for _ in range(12)]
    got = window_consensus(draft, "!" * len(draft), layers, 3, -5, -4, False)
    assert distance(got, truth) < distance(draft, truth) / 4


def test_trim():
    assert trimmed(b"abcdef", [1, 2, 3, 3, 1, 0], 4) == b"bcd"
    assert trimmed(b"ab", [0, 0], 4) == b"ab"
    assert trimmed(b"abc", [0, 2, 0], 4) == b"abc" and trimmed(b"abc", [0, 2, 2], 4) == b"bc"


def test_identity(spark):
    kind = "ordinal long, name string, length long"
    targets = spark.createDataFrame([(0, "x", 5), (1, "x", 6), (2, "y", 7)], kind)
    reads = spark.createDataFrame([(0, "x", 6), (1, "z", 3)], kind)
    uids = shared_identity(reads, targets)
    assert {r.name: r.uid for r in uids.collect()} == {"x": "t1", "z": "q1"}
    with pytest.raises(Exception, match="differ in length"):
        shared_identity(spark.createDataFrame([(0, "y", 9)], kind), targets).collect()
    overlap = "ordinal long, q_name string, q_length long, t_name string, t_length long, is_valid boolean"
    rows = [(0, "z", 3, "y", 0, True), (1, "z", 3, "none", 0, True), (2, "none", 3, "y", 7, True), (3, "z", 3, "y", 7, False)]
    assert [(r.ordinal, r.q_id, r.t_id, r.t_length) for r in resolve(spark.createDataFrame(rows, overlap), uids, targets).collect()] == [(0, "q1", "t2", 7)]
    with pytest.raises(Exception, match="query length"):
        resolve(spark.createDataFrame([(0, "z", 4, "none", 0, True)], overlap), uids, targets).collect()


def test_pairs_and_chunks(spark):
    df = spark.createDataFrame([(0, "r x", "AAAA"), (1, "r y", "CC"), (2, "r", "G"), (3, "s", "TTT")], "ordinal long, name string, data string")
    assert [r.name for r in rename_pairs(df, ["ordinal"]).orderBy("ordinal").collect()] == ["r1", "r2", "r2", "s1"]
    assert [r.ordinal for r in subsample(df, ["ordinal"], F.length("data"), 3, 2).collect()] == [0, 1]
    assert [r.chunk for r in split_targets(df, ["ordinal"], 4).orderBy("ordinal").collect()] == [0, 1, 1, 1]


def test_files(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one first\nACgt\nNN\n>two\n\n>three\nA\n")
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@r1 x\nACGT\n+\n!!!!\n@r2\nAC\n+r2\n@I\n")
    assert [tuple(r) for r in read_sequences(spark, f"{tmp_path}/a.fasta").orderBy("ordinal").collect()] == [(0, "one", "ACGTNN", None), (1, "two", "", None), (2, "three", "A", None)]
    reads = read_sequences(spark, f"{tmp_path}/b.fq.gz").orderBy("ordinal")
    assert [tuple(r) for r in reads.collect()] == [(0, "r1", "ACGT", None), (1, "r2", "AC", "@I")]
    (tmp_path / "m.fastq").write_text("@r1\nAC\nGT\n+\n55\n@5\n@r2\nA\n+\n5\n@cut\nACG\n+\n5")
    assert [tuple(r) for r in read_fastq(spark, f"{tmp_path}/m.fastq", multiline=True).collect()] == [(0, "r1", "ACGT", "55@5"), (1, "r2", "A", "5")]
    (tmp_path / "wrong.fastq").write_text("@r1\nAC\n+\n55\n@r2\nA\n+\n555\n@r3\nA\n+\n5\n")
    with pytest.raises(Exception, match="more quality than data: @r2"):
        read_fastq(spark, f"{tmp_path}/wrong.fastq", multiline=True).collect()
    with pytest.raises(Exception, match="four lines"):
        read_fastq(spark, f"{tmp_path}/m.fastq").collect()
    (tmp_path / "o.mhap").write_text("1 2 0.1 9 0 0 10 20 1 5 17 30\n")
    (tmp_path / "o.paf").write_text("q\t20\t0\t10\t-\tt\t30\t5\t17\t9\t9\t60\tcg:Z:x\n")
    (tmp_path / "o.sam").write_text("@HD\tx\nq\t16\tt\t6\t60\t3S10M2S\t*\t0\t0\t*\t*\nu\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n")
    m, p = read_overlaps(spark, f"{tmp_path}/o.mhap").first(), read_overlaps(spark, f"{tmp_path}/o.paf").first()
    assert (m.q_ord, m.t_ord, m.strand, m.length) == (0, 1, True, 12) and m.error == p.error == pytest.approx(1 - 10 / 12)
    assert (p.q_name, p.t_name, p.strand, p.t_begin, p.q_length, p.t_length) == ("q", "t", True, 5, 20, 30)
    s = {r.q_name: r for r in read_overlaps(spark, f"{tmp_path}/o.sam").collect()}
    assert (s["q"].q_begin, s["q"].q_end, s["q"].q_length, s["q"].t_begin, s["q"].t_end) == (2, 12, 15, 5, 15) and not s["u"].is_valid
    (tmp_path / "bad.sam").write_text("q\t0\tt\t6\t60\t*\t*\t0\t0\t*\t*\n")
    with pytest.raises(Exception, match="no CIGAR"):
        read_overlaps(spark, f"{tmp_path}/bad.sam").collect()
    for read, name in ((read_sequences, "x.FASTA"), (read_overlaps, "x.txt")):
        with pytest.raises(ValueError, match="unsupported format"):
            read(spark, name)


def test_fastq_round_trip(spark, tmp_path):
    """Over several files: records are numbered through, and empty reads and unknown qualities come back as they were."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.fastq").write_text("@a\nACGT\n+\nIIII\n@b\n\n+\n\n@c\nAC\n+\n!!\n")
    (tmp_path / "in" / "2.fastq").write_text("@d\nGG\n+\n5!\n\n\n")
    expected = [(0, "a", "ACGT", "IIII"), (1, "b", "", None), (2, "c", "AC", None), (3, "d", "GG", "5!")]
    reads = read_fastq(spark, f"{tmp_path}/in")
    assert [tuple(r) for r in reads.orderBy("ordinal").collect()] == expected
    write_fastq(reads, f"{tmp_path}/out")
    assert [tuple(r) for r in read_fastq(spark, f"{tmp_path}/out").orderBy("ordinal").collect()] == expected


def test_settings():
    with pytest.raises(ValueError):
        PolishConfig(window_length=0)
    with pytest.raises(ValueError):
        PolishConfig(match=200)
    args = parser().parse_args(["-f", "-w", "9", "r.fq", "o.paf", "t.fa"])
    assert args.fragment_correction and args.window_length == 9 and args.gap == -4


@pytest.fixture(scope="module")
def genome(tmp_path_factory):
    rng, folder = random.Random(42), tmp_path_factory.mktemp("genome")
    truth = "".join(rng.choice("ACGT") for _ in range(3000))
    parts = [noisy(rng, c, 0.03) for c in truth]
    draft, place = "".join(parts), [0]
    for part in parts:  # where each base of the truth stands in the draft
        place.append(place[-1] + len(part))
    turn = str.maketrans("ACGT", "TGCA")
    fastq, paf, mhap = [], [], []
    for k in range(40):
        n = rng.randint(800, 1500)
        a = rng.randint(0, len(truth) - n) if k > 9 else (len(truth) - n) * (k % 2)
        read, back = noisy(rng, truth[a : a + n], 0.04), rng.random() < 0.5
        if back:
            read = read[::-1].translate(turn)
        fastq.append(f"@r{k}\n{read}\n+\n{''.join(chr(33 + rng.randint(15, 30)) for _ in read)}\n")
        b, e = place[a], place[a + n]
        paf.append(f"r{k}\t{len(read)}\t0\t{len(read)}\t{'-' if back else '+'}\tdraft\t{len(draft)}\t{b}\t{e}\t9\t9\t60\n")
        mhap.append(f"{k + 1} 1 0.1 9 0 0 {len(read)} {len(read)} {int(back)} {b} {e} {len(draft)}\n")
    for name, text in (("reads.fastq", "".join(fastq)), ("o.paf", "".join(paf)), ("o.mhap", "".join(mhap)), ("draft.fasta", f">draft\n{draft}\n>alone\nACGT\n")):
        (folder / name).write_text(text)
    return folder, truth, draft


def test_whole_run(spark, genome, tmp_path):
    folder, truth, draft = genome
    files = lambda overlaps: (f"{folder}/reads.fastq", f"{folder}/{overlaps}", f"{folder}/draft.fasta")
    polished = polish_files(spark, *files("o.paf")).collect()
    assert len(polished) == 1 and polished[0].name.startswith(f"draft LN:i:{len(polished[0].data)} RC:i:") and polished[0].xc > 0.8  # a last tile of a few bases has no layers
    untrimmed = polish_files(spark, *files("o.paf"), PolishConfig(trim=False)).first().data  # few reads reach the genome's ends, so trimming cuts there
    assert distance(untrimmed, truth) < distance(draft, truth) / 4 and len(polished[0].data) < len(untrimmed)
    assert polish_files(spark, *files("o.mhap")).collect() == polished
    config = PolishConfig(include_unpolished=True)
    more = polish_files(spark, *files("o.paf"), config)
    assert {r.data for r in more.collect()} == {polished[0].data, "ACGT"}
    write_fasta(more, f"{tmp_path}/out")
    assert fasta_lines(more).first().value.startswith(">draft LN:i:")
    reads, overlaps, targets = read_sequences(spark, files("")[0]), read_overlaps(spark, f"{folder}/o.paf"), read_sequences(spark, files("")[2])
    assert polish_in_chunks(reads, overlaps, targets.where("name = 'draft'"), 100, PolishConfig()).first().data == polished[0].data
    corrected = polish(reads, overlaps, targets, PolishConfig(fragment=True)).first()
    assert corrected.name.startswith("draftr LN:i:")
    for empty in ((reads.where("1 = 0"), overlaps, targets), (reads, overlaps.where("1 = 0"), targets), (reads, overlaps, targets.where("1 = 0"))):
        with pytest.raises(ValueError, match="empty set"):
            polish(*empty)

"""The reference in pieces and the walk of reads along it."""

import random
import re

import pytest

from cladeworks.operators import genome as gn
from cladeworks.sources import text


def plain_events(reads, ref):
    out = []
    for qname, start, cigar, seq in reads:
        if cigar == "*" or seq == "*":
            continue
        r, q = start - 1, 0
        for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
            n = int(n)
            if op in "M=X":
                out += [(qname, r + i + 1, ref[r + i], seq[q + i].upper(), "snp") for i in range(n) if r + i < len(ref) and ref[r + i] != seq[q + i].upper()]
            elif op == "D":
                out += [(qname, r + i + 1, ref[r + i], "", "del") for i in range(n) if r + i < len(ref)]
            elif op == "I":
                out.append((qname, r + 1, "", seq[q : q + n].upper(), "ins"))
            r += n if op in "M=XDN" else 0
            q += n if op in "M=XIS" else 0
    return sorted(out)


def chunk_frame(spark, ref, cuts, width, overlap=4):
    pieces = [(i, ref[a:b]) for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(ref)]))]
    return gn.reference_chunks(gn.laid_out(spark.createDataFrame(pieces, "k long, seq string"), "k"), width, overlap)


def test_pieces_are_laid_out_in_order(spark):
    pieces = spark.createDataFrame([(3, "GG"), (1, "ACG"), (2, ""), (1, "ACC"), (9, "TTTT")], "k long, seq string")
    assert sorted(map(tuple, gn.laid_out(pieces, "k").where("seq <> ''").collect())) == [(0, "ACC"), (3, "ACG"), (6, "GG"), (8, "TTTT")]
    assert gn.laid_out(pieces.where("k > 10"), "k").count() == 0
    assert pieces.select(gn.reference_length(pieces)).first()[0] == 12


def test_chunks_hold_the_whole_reference(spark):
    random.seed(3)
    ref = "".join(random.choice("ACGT") for _ in range(101))
    for cuts in ([], [7, 9, 60]):
        every = spark.range(9).select(gn.F.col("id").alias("_chunk"))
        rows = {r["_chunk"]: r["_bases"] for r in chunk_frame(spark, ref, cuts, 16).asked(every).collect()}
        assert rows == {i: ref[16 * i : 16 * i + 20] for i in range(7)}
        assert [r["_chunk"] for r in chunk_frame(spark, ref, cuts, 16).asked(every.where("_chunk = 3")).collect()] == [3]
    asked = spark.createDataFrame([(p,) for p in range(-1, 105)], "p long")
    got = gn.with_bases(asked, asked["p"], gn.F.lit(5), chunk_frame(spark, ref, [50], 16), "x")
    assert {r["p"]: r["x"] for r in got.collect()} == {p: ref[p - 1 : p + 4] for p in range(1, 98)}


@pytest.mark.parametrize("width", [16, 64, 4096])
def test_reads_of_every_operation(spark, width):
    random.seed(width)
    ref = "".join(random.choice("ACGT") for _ in range(300))
    reads = [("m", 1, "300M", ref[:150] + "n" + ref[151:]), ("clip", 10, "3S4H5M2I6M3D10M2P5N4=1X2S", "AAA" + ref[9:14] + "TT" + "C" * 6 + ref[23:33] + ref[38:43] + "GG"), ("none", 0, "*", "ACGT"), ("bare", 5, "10M", "*"), ("over", 296, "10M", ref[295:] + "ACGTA"), ("d", 12, "2M20D2M", "ACGT"), ("i", 5, "4I", "acgt")]
    for k in range(20):
        parts, seq, at = [], "", random.randint(1, 100)
        for _ in range(random.randint(1, 8)):
            n, op = random.randint(1, 30), random.choice("MMMIDNS=X")
            parts.append(f"{n}{op}")
            seq += "".join(random.choice("ACGT") for _ in range(n)) if op in "MIS=X" else ""
        reads.append((f"r{k}", at, "".join(parts), seq or "A"))
    frame = spark.createDataFrame(reads, "qname string, start_pos long, cigar string, seq string")
    got = gn.reads_to_events(frame, chunk_frame(spark, ref, [100], width))
    assert sorted(map(tuple, got.collect())) == plain_events(reads, ref)


def test_sam_file_to_events(spark, tmp_path):
    ref = "ACGTACGTACGTACGTACGT"
    lines = ["@HD\tVN:1", "r1\t0\tc\t3\t60\t2S4M1I4M2D3M1H\t*\t0\t0\tTTGTACGGTATACG\t*", "r2\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t*", "r3\t16\tc\t6\t60\t8M\t*\t0\t0\tCGTTCGTA\t*"]
    (tmp_path / "s1.sam").write_text("\n".join(lines) + "\n")
    got = gn.reads_to_events(text.sam(spark, str(tmp_path / "s1.sam")), gn.reference_chunks(spark.createDataFrame([(ref,)], "seq string"), 8, 2))
    assert got.columns == ["sample_id", "qname", "flag", "mapq", "pos", "ref", "alt", "vtype"]
    want = plain_events([("r1", 3, "2S4M1I4M2D3M1H", "TTGTACGGTATACG"), ("r3", 6, "8M", "CGTTCGTA")], ref)
    assert sorted((r["qname"], r["pos"], r["ref"], r["alt"], r["vtype"]) for r in got.collect()) == want

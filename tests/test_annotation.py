"""Annotated variants against a plain version that writes the genome out."""

import random

import pytest

from cladeworks.functions import sequence as sq
from cladeworks.functions import similarity
from cladeworks.operators import annotation as an

LOCATED = "sample_id long, ftype string, gene string, start_pos long, end_pos long, strand int, is_pseudogene boolean, pos long, alt string, vtype string"


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def translate(s):
    return "".join(sq.GENETIC_CODE[16 * "ACGT".index(a) + 4 * "ACGT".index(b) + "ACGT".index(c)] for a, b, c in zip(s[::3], s[1::3], s[2::3]))


def difference(old, new):
    if old == new:
        return []
    s = 0
    while s < min(len(old), len(new)) and old[-1 - s] == new[-1 - s]:
        s += 1
    old, new, p = old[: len(old) - s], new[: len(new) - s], 0
    while p < min(len(old), len(new)) and old[p] == new[p]:
        p += 1
    old, new = old[p:], new[p:]
    n = min(len(old), len(new))
    out = [(p + i + 1, old[i], new[i], "snp") for i in range(n) if old[i] != new[i]]
    return out + [(p + n + 1, old[n:], "-", "del")] * (len(old) > n) + [(p + n + 1, "-", new[n:], "ins")] * (len(new) > n)


def plain_gene(ref, gene, calls):
    name, start, end, strand = gene
    along = (lambda x: x) if strand == 1 else rc
    old = translate(along(ref[start - 1 : end]))
    if all(v == "snp" for _, _, v in calls):
        whole = ref[start - 1 : end + (start - 1 - end) % 3]  # the last codon may reach beyond a gene of odd length
        old, new = translate(along(whole)), list(whole)
        for pos, alt, _ in sorted(calls):
            new[pos - start] = alt
        changed = [(i + 1, a, b, "snp") for i, (a, b) in enumerate(zip(old, translate(along("".join(new))))) if a != b]
        return [(None, "-", "-", "FS")] if any(b == "*" and i < 0.9 * ((end - start + 1) // 3) for i, _, b, _ in changed) else changed
    if len(ref[start - 1 : end]) % 3:
        return []
    new = []
    for p in range(start, end + 1):
        here = sorted((v, a) for q, a, v in set(calls) if q == p)
        new += sorted(a for v, a in here if v == "ins")
        base = [a for v, a in here if v == "snp"]
        new.append("" if any(v == "del" for v, _ in here) else max(base) if base else ref[p - 1])
    new = "".join(new)
    fill = -len(new) % 3
    new = translate(along(new + ref[end : end + fill] if strand == 1 else ref[max(start - 3, 0) : start - 1][2 - fill :] + new if fill else new))
    stop = new.find("*")
    starts = [i for i in range(stop + 1) if new[i] in (old[0], "M")]
    if not starts or 10 * (stop - starts[0]) < 9 * len(old):
        return [(None, "-", "-", "FS")]
    return difference(old[:-1], new[starts[0] : stop])


def plain_outside(ref, feature, calls):
    ftype, start, end, strand = feature
    along = (lambda x: x) if strand == 1 else rc
    place = lambda p: ((p - end - 1 if strand == 1 else start - p - 1) if ftype == "upstream" else (p - start + 1 if strand == 1 else end - p + 1))
    gone, out = sorted({p for p, _, v in calls if v == "del"}), []
    while gone:
        n = next(i for i in range(1, len(gone) + 1) if i == len(gone) or gone[i] != gone[0] + i)
        out.append((place(gone[0] if strand == 1 else gone[0] + n - 1), along(ref[gone[0] - 1 : gone[0] - 1 + n]), "-", "del"))
        gone = gone[n:]
    return out + [(place(p), "-" if v == "ins" else along(ref[p - 1]), along(a), v) for p, a, v in set(calls) if v != "del"]


def genome(rng):
    """A reference with genes on both strands that start, stop and have a length of whole codons, among other features."""
    ref, features = "", []
    for k in range(8):
        ref += "".join(rng.choice("ACGT") for _ in range(rng.randint(5, 15)))
        body = "".join(rng.choice(["GCA", "CTG", "AAA", "GAC", "TGG", "CCC", "ATG", "TAC"]) for _ in range(rng.randint(8, 20)))
        orf = "ATG" + body + "TAA"
        features.append(("Gene", f"g{k}", len(ref) + 1, len(ref) + len(orf), 1 if k % 2 else -1, k == 6))
        ref += orf if k % 2 else rc(orf)
        features.append((rng.choice(["rRNA", "upstream"]), f"u{k}", len(ref) + 1, len(ref) + 9, rng.choice([1, -1]), False))
        ref += "".join(rng.choice("ACGT") for _ in range(9))
    features.append(("Gene", "odd", 1, 4, 1, False))
    return ref + "ACGTACGT", features


def random_calls(rng, ref):
    out = []
    for s in range(30):
        for _ in range(rng.randint(1, 12)):
            p, kind = rng.randint(1, len(ref)), rng.choice(["snp", "snp", "snp", "del", "del3", "ins", "ins3"])
            if kind == "snp":
                out.append((s, p, rng.choice([b for b in "ACGT" if b != ref[p - 1]]), "snp"))
            elif kind.startswith("ins"):
                out.append((s, p, "".join(rng.choice("ACGT") for _ in range(3 if kind == "ins3" else 1)), "ins"))
            else:
                out += [(s, q, "-", "del") for q in range(p, min(p + (3 if kind == "del3" else 1), len(ref) + 1))]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_annotation_equals_plain(spark, seed):
    rng = random.Random(seed)
    ref, features = genome(rng)
    calls = random_calls(rng, ref)
    at = lambda p: next((f for f in features if f[2] <= p <= f[3]), None)
    located = [(s, *at(p), p, a, v) for s, p, a, v in calls if at(p)]
    frame = spark.createDataFrame(calls + calls[:3], "sample_id long, pos long, alt string, vtype string")
    where = spark.createDataFrame(located + located[:3], LOCATED)
    got = an.annotate(frame, where, spark.createDataFrame([(ref,)], "seq string"))
    assert got.columns == list(an.ROW)
    want = set()
    for s in {c[0] for c in calls}:
        for f in [*features, None]:
            own = [(p, a, v) for t, p, a, v in calls if t == s and at(p) == f]
            if not own:
                continue
            if f is None:
                want |= {(s, "non_cds", "-", *r) for r in plain_outside(ref, ("non_cds", 1, len(ref), -1), own)}
            elif f[0] == "Gene" and not f[5]:
                want |= {(s, "Gene", f[1], *r) for r in plain_gene(ref, (f[1], f[2], f[3], f[4]), own)}
            else:
                want |= {(s, f[0], f[1], *r) for r in plain_outside(ref, (f[0], f[2], f[3], f[4]), own)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {r[6] for r in rows if r[1] == "Gene"} == {"snp", "ins", "del", "FS"}


def test_protein_changes(spark):
    cases = [("same", "MKL", "MKL"), ("one", "MKLV", "MRLV"), ("less", "MKKL", "MKL"), ("more", "MKL", "MKAAL"), ("mixed", "MKLVW", "MRRVVW"), ("all", "M", "W"), ("tail", "MK", "M"), ("none", "MKL", "")]
    got = an.protein_changes(spark.createDataFrame(cases, "k string, old string, new string"))
    assert sorted(map(tuple, got.collect())) == sorted((k, *r) for k, a, b in cases for r in difference(a, b))


def test_distances(spark):
    score = {(a, b): s for a, b, s in similarity.entries()}
    names = sorted({a for a, _ in score})
    assert len(names) == 20 and len(score) == 400 and all(score[a, b] == score[b, a] for a, b in score)
    table = similarity.distances(similarity.similarity(spark))
    far = {(r["ref"], r["alt"]): r["distance"] for r in table.collect()}
    want = {(a, b): sum((score[a, c] - score[b, c]) ** 2 for c in names) ** 0.5 for a in names for b in names}
    assert far.keys() == want.keys() and all(abs(far[k] - want[k]) < 1e-9 for k in far)
    rows = [
        (1, "Gene", "a", 3, "K", "R", "snp"), (1, "Gene", "a", 9, "-", "LLL", "ins"), (1, "Gene", "a", 12, "VW", "-", "del"), (1, "Gene", "b", None, "-", "-", "FS"), (1, "Gene", "c", 4, "K", "*", "snp"), (1, "Gene", "c", 5, "K", "R", "snp"),
        (2, "rRNA", "a", 5, "AC", "-", "del"), (2, "rRNA", "a", 9, "-", "G", "ins"), (2, "rRNA", "a", 11, "A", "C", "snp"), (2, "non_cds", "-", 7, "A", "C", "snp"), (3, "Gene", "a", 3, "X", "R", "snp"),
    ]
    found = an.distance_features(spark.createDataFrame(rows, "sample_id long, ftype string, gene string, gpos long, ref string, alt string, vtype string"), table)
    top = max(want.values())
    expected = {
        (1, "Gene", "a", "site", 3): want["K", "R"], (1, "Gene", "a", "dist", None): (want["K", "R"] ** 2 + 5 * top**2) ** 0.5, (1, "Gene", "a", "del", 12): 2, (1, "Gene", "b", "broken", None): 1, (1, "Gene", "c", "broken", None): 1,
        (2, "rRNA", "a", "dist", None): 4, (2, "rRNA", "a", "del", 5): 2, (3, "Gene", "a", "dist", None): top,
    }
    got = {tuple(r)[:5]: r["value"] for r in found.collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)

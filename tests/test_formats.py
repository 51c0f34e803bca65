"""Readers and writers on hand-made miniature files."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cladeworks.operators import graph, phenotype, tree
from cladeworks.operators.evaluate import metrics
from cladeworks.operators.quality import QualityParams
from cladeworks.sources import sinks, text
from cladeworks.streaming.ingest import ingest


@pytest.fixture
def put(tmp_path):
    def write(name, *lines):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        return str(tmp_path / name)

    return write


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: [(x is not None, not isinstance(x, str), x or 0) if not isinstance(x, str) else (True, False, x) for x in r])


def test_fasta_and_alignment(spark, put):
    path = put("a.fasta", ">x one", "acg", "TT", ">y", "AC-GT")
    assert rows(text.fasta(spark, path)) == [("x", "ACGTT"), ("y", "AC-GT")]
    assert rows(text.alignment_columns(text.fasta(spark, path)))[:2] == [("x", 0, "A"), ("x", 1, "C")]


def test_gff(spark, put):
    path = put(
        "a.gff", "# c", "s\tx\tGene\t101\t200\t.\t+\t.\tgene abc;locus_tag L1", "s\tx\tGene\t301\t390\t.\t-\t.\tgene def;locus_tag L2; product \"hypothetical thing\"",
        "s\tx\tGene\t500\t600\t.\t+\t.\tgene rrn;locus_tag L3", "s\tx\trRNA\t500\t600\t.\t+\t.\tgene rrn;locus_tag L3", "s\tx\tmobile_element\t1\t9\t.\t+\t.\tgene m",
    )
    got = {(r["ftype"], r["name"], r["start_pos"], r["end_pos"]) for r in text.gff(spark, path).collect()}
    assert got == {("Gene", "abc", 101, 200), ("Gene", "def", 301, 390), ("rRNA", "rrn", 500, 600), ("upstream", "abc", 1, 100), ("upstream", "def", 391, 490)}
    assert {r["name"] for r in text.gff(spark, path, whole_codons=True).where("ftype = 'Gene'").collect()} == {"def"}
    assert text.gff(spark, path).where("is_hypothetical and product = 'hypothetical thing'").count() == 2


def test_sample_files(spark, put, tmp_path):
    put("s1.variants", "# c", "5\tA\tsnp", "", "7\t-\tdel")
    path = put("s2.variants", "5\tA\tsnp").replace("s2.", "*.")
    assert rows(text.variants(spark, path)) == [("s1", 5, "A", "snp"), ("s1", 7, "-", "del"), ("s2", 5, "A", "snp")]
    keys = spark.createDataFrame([(7, "-", "del")], "pos int, alt string, vtype string")
    assert rows(text.variants(spark, path, keys)) == [("s1", 7, "-", "del")]
    assert rows(text.phenotypes(spark, put("INH.pheno", "s1\t1", "s2\t0"))) == [("s1", "INH", 1), ("s2", "INH", 0)]
    assert rows(text.depth(spark, put("s1.depth", "c\t1\t10", "c\t2\t0"))) == [("s1", 1, 10), ("s1", 2, 0)]
    assert rows(text.coverage_intervals(spark, put("s1.coverage", "lower 1", "median 2", "upper 3", "4\t9"))) == [("s1", 4, 9)]
    assert rows(text.tree_edges(spark, put("parents.csv", "r", "a\tr\t0.5"))) == [("a", "r", 0.5), ("r", None, None)]
    assert rows(text.repeats(spark, put("r.dat", "Sequence: x", "10 20 3 4"))) == [(10, 21)]
    query = ingest(spark, f"{tmp_path}/*.variants", f"{tmp_path}/out", f"{tmp_path}/ck")
    query.awaitTermination(60)
    assert rows(spark.read.parquet(f"{tmp_path}/out").select("sample_id", "pos", "alt", "vtype")) == rows(text.variants(spark, path))


def test_vcf_readers(spark, put):
    path = put("s1_h37rv.vcf", "##x", "c\t10\t.\tACGT\tAT,ATGT\t90\t.\tDP=9;MQM=40,50;CIGAR=1M2D1M,1M1X2M\tGT:AO:GL\t1:3,8:-5,-9,0", "c\t20\t.\tA\tATT\t50\t.\tMQM=30;CIGAR=1M2I\tGT:AO:GL\t1:12:-4,0")
    assert rows(text.genotyper_vcf(spark, path).select("sample_id", "pos", "alt", "vtype", "cov", "mqm")) == [("s1", 11, "T", "snp", 8, 50.0), ("s1", 21, "TT", "ins", 12, 30.0)]
    path = put("j.vcf", "c\t5\t.\tA\tC,G\t9\t.\tQD=3\tGT:AD:PL\t1:1,2,17:50,40,0", "c\t6\t.\tA\tC\t9\t.\tQD=3\tGT:AD:PL\t1:5,6:50,0")
    assert rows(text.joint_vcf(spark, path).select("sample_id", "pos", "alt")) == [("j", 5, "G")]
    path = put("p.vcf", "c\t5\t.\tA\tC\t9\tPASS\tDP=20;AF=0.9\tGT\t1", "c\t6\t.\tA\tC\t9\tPASS\tDP=2\tGT\t1", "c\t7\t.\tA\tC\t9\tLowCov\tDP=20\tGT\t1", "c\t8\t.\tA\t.\t9\tPASS\tDP=20\tGT\t1", "c\t9\t.\tA\tC\t9\tPASS\tDP=20;XC=30\tGT\t1")
    assert rows(text.polisher_vcf(spark, path).select("pos")) == [(5,)]
    path = put("g.vcf", "c\t5\t.\tACC\tA\t9\tPASS\tx\tGT\t1", "c\t9\t.\tA\tAGG\t9\tPASS\tx\tGT\t1", "c\t12\t.\tA\tT\t9\tPASS\tx\tGT\t1")
    assert rows(text.graph_vcf(spark, path).select("pos", "alt", "vtype")) == [(6, "-", "del"), (7, "-", "del"), (10, "GG", "ins"), (12, "T", "snp")]
    path = put("s1.snps", "head", "", "5 A C x", "9 . G x", "9 . T x", "12 A . x", "13 C . x")
    assert rows(text.aligner_snps(spark, path)) == [("s1", 5, "C", "snp"), ("s1", 9, "GT", "ins"), ("s1", 12, "-", "del"), ("s1", 13, "-", "del")]


def test_other_readers(spark, put):
    path = put("s1.sam", "@HD", "r1\t99\tc\t100\t60\t5M2D3M1I\t=\t1\t1\tACGTACGTA")
    assert rows(text.sam(spark, path).select("sample_id", "qname", "start_pos", "end_pos", "mapq")) == [("s1", "r1", 100, 109, 60)]
    assert rows(text.qc_flags(spark, put("s1_summary.txt", "PASS\ta\tf", "FAIL\tb\tf", "WARN\tc\tf"))) == [("s1", 1, 1)]
    assert rows(text.coefficients(spark, put("INH.log", "gene\tx\t1.5", "head", "gene\ty\t0"))) == [("INH", "gene\tx", 1.5), ("INH", "gene\ty", 0.0)]
    assert rows(text.run_info(spark, put("run.csv", "Run,LibraryName,BioSample,ScientificName", "r1,l1,b1,o1"))) == [("r1", "l1", "b1", "o1")]
    assert rows(text.drug_features(spark, put("INH.txt", "ring: yes", "ring: yes", "other: 1"), ["ring"])) == [("INH", "ring", "yes")]
    assert rows(text.key_list(spark, put("k.list", "a ", "# no", "b"))) == [("a",), ("b",)]
    numbered = text.number_rows(text.key_list(spark, put("n.list", *[f"k{i:03d}" for i in range(50)])).repartition(1))
    assert [r["row_idx"] for r in numbered.orderBy("key").collect()] == list(range(50))


def test_sinks(spark, tmp_path):
    calls = spark.createDataFrame([("s1", 5, "A"), ("s2", 7, "C")], "sample_id string, pos int, alt string")
    samples = spark.createDataFrame([("s1", True), ("s3", False)], "sample_id string, kept boolean")
    sinks.write_filter_outputs(calls, calls.select("pos"), samples, f"{tmp_path}/o")
    assert rows(spark.read.parquet(f"{tmp_path}/o/variants").select("sample_id", "pos")) == [("s1", 5), ("s2", 7)]
    assert rows(spark.read.parquet(f"{tmp_path}/o/dropped_samples")) == [("s3",)]
    for run in ("a", "b", "a"):
        sinks.write_params(spark, QualityParams(), f"{tmp_path}/p", run)
    assert rows(spark.read.json(f"{tmp_path}/p").where("name = 'min_qual' and value = '40'").select("run_id")) == [("a",), ("b",)]
    sinks.write_fasta(spark.createDataFrame([("x", "ACGT")], "name string, seq string"), f"{tmp_path}/f")
    assert rows(text.fasta(spark, f"{tmp_path}/f")) == [("x", "ACGT")]
    sinks.write_metrics(metrics(spark.createDataFrame([("a", 1, 1)], "drug string, pheno int, pred int"), ["drug"]).select("drug", "tp", "sens"), f"{tmp_path}/m")
    assert rows(spark.read.text(f"{tmp_path}/m")) == [("a\t1\t1.00",)]
    sinks.write_selected(spark.createDataFrame([("x", -2.0, 0.0), ("y", 1.0, 0.5)], "feature string, coefficient double, p_value double"), f"{tmp_path}/s")
    assert spark.read.text(f"{tmp_path}/s").where(F.col("value") == "x\t-2.0\t0.0").count() == 1


def test_reference_is_the_last_record(spark, tmp_path):
    (tmp_path / "two.fasta").write_text(">first\nacgt\n>second one\nggc\ncta\n")
    assert [r["seq"] for r in text.reference(spark, str(tmp_path / "two.fasta")).collect()] == ["GGCCTA"]


def test_edge_tables_there_and_back(spark, put, tmp_path):
    path = put("INH.xparr", "child\tparent\tlength", "r", "a\tr\t0.5\t12;90\tS3R\tA30C;4411540", "b\tr\t1\t\t\tK7*;A31G", "c\ta\t2\t5\t\t")
    edges = text.edge_tables(spark, path)
    assert rows(edges.orderBy("child").select("drug", "child", "parent", "dist", "change")) == [("INH", "a", "r", 0.5, "S3R"), ("INH", "b", "r", 1.0, None), ("INH", "c", "a", 2.0, None), ("INH", "r", None, None, None)]
    assert {r["child"]: (r["syn"], r["nonsyn"]) for r in edges.collect()} == {"a": (["12", "90"], ["A30C", "4411540"]), "b": ([], ["K7*", "A31G"]), "c": (["5"], []), "r": ([], [])}
    found = tree.association(edges, ["drug"])
    assert rows(found) == [("INH", "30", 1, 0, 1.0), ("INH", "31", 0, 1, 0.0), ("INH", "4411540", 1, 0, 1.0), ("INH", "7", 0, 1, 0.0)]
    sinks.write_edge_table(edges, f"{tmp_path}/out")
    lines = [line for f in sorted(Path(f"{tmp_path}/out").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == ["child\tparent\tlength", "r", "a\tr\t0.5\t12;90\tS3R\tA30C;4411540", "b\tr\t1.0\t\t\tK7*;A31G", "c\ta\t2.0\t5\t\t"]
    sinks.write_drug_codes(spark.createDataFrame([("RIF", 2), ("INH", 1)], "drug string, code long"), f"{tmp_path}/codes")
    assert [line for f in sorted(Path(f"{tmp_path}/codes").glob("part-*")) for line in f.read_text().splitlines()] == ["INH\t1", "RIF\t2"]


def test_ancestral_probabilities(spark, put):
    put("one.csv", " Node_17Node_x", "3_A 0.2 0.5", "3_C 0.2 0.1", "3_G 0.6 0.4", "12_T 0.5 0")
    path = put("two.csv", "Node_x Node_17", "20_A 1.0 0.25", "20_C 0 0.75").replace("two", "*")
    found = tree.most_likely(text.base_probabilities(spark, path))
    assert rows(found) == [("17", 3, "G", 0.6), ("17", 12, "T", 0.5), ("17", 20, "C", 0.75), ("x", 3, "A", 0.5), ("x", 12, "T", 0.0), ("x", 20, "A", 1.0)]
    ties = spark.createDataFrame([("n", 1, "T", 0.5), ("n", 1, "C", 0.5), ("n", 1, "A", 0.1)], "node string, pos long, base string, prob double")
    assert rows(tree.most_likely(ties)) == [("n", 1, "C", 0.5)]
    path = put("INH.probs", "p0\tp1", "0.9\t0.1", "0.5\t0.5", "0.2\t0.8")
    put("RIF.probs", "p0\tp1", "1\t0")
    states = tree.two_states(text.state_probabilities(spark, path.replace("INH", "*")))
    assert rows(states.select("drug", "row_idx", "state")) == [("INH", 0, 0), ("INH", 1, 1), ("INH", 2, 1), ("RIF", 0, 0)]


def test_indel_codes_and_changes(spark):
    calls = spark.createDataFrame([("s", 5, "-", "del"), ("s", 6, "-", "del"), ("s", 8, "-", "del"), ("t", 5, "AC", "ins"), ("t", 5, "AC", "ins"), ("t", 9, "A", "snp")], "sample_id string, pos long, alt string, vtype string")
    keys = tree.indel_keys(calls)
    assert rows(keys) == [("s", "del_5_2"), ("s", "del_8_1"), ("t", "ins_5_AC")]
    codes = tree.indel_codes(keys, F.lit(100))
    assert rows(codes) == [("del_5_2", 101), ("del_8_1", 102), ("ins_5_AC", 103)]
    edges = spark.createDataFrame([("s", None, 0.0), ("t", "s", 1.0), ("u", "t", 1.0)], "child string, parent string, dist double")
    carriers = keys.select(F.col("sample_id").alias("node"), "key").union(spark.createDataFrame([("u", "ins_5_AC")], "node string, key string"))
    found = tree.mutation_lists(tree.indel_changes(edges, carriers, codes), edges)
    assert {r["child"]: r["nonsyn"] for r in found.collect()} == {"t": ["101", "102", "103"], "u": []}


def test_changes_and_vectors_of_several_drugs(spark):
    states = spark.createDataFrame([("a", "RIF", "R"), ("a", "INH", "S"), ("b", "RIF", "S"), ("b", "INH", "R"), ("c", "RIF", "S"), ("c", "EMB", "R")], "node string, drug string, state string")
    edges = spark.createDataFrame([("a", None, 0.0), ("b", "a", 1.0), ("c", "b", 1.0), ("d", "c", 1.0)], "child string, parent string, dist double")
    codes = tree.drug_codes(states)
    assert rows(codes) == [("EMB", 1), ("INH", 2), ("RIF", 3)]
    get = lambda **k: {r["child"]: r["changes"] for r in tree.drug_changes(edges, states, codes, **k).collect()}
    assert get() == {"b": ["S2R", "R3S"], "c": [], "d": []}
    assert get(susceptible=True) == {"b": ["S2R", "R3S"], "c": ["S3S"], "d": []}
    assert get(resistant=True) == get()
    assert rows(tree.state_vectors(states, codes)) == [("a", "001"), ("b", "010"), ("c", "100")]


def test_plain_vcf_leaves_intervals_out(spark, put):
    path = put("s1.vcf", "##x", "c\t5\t.\ta\tC\t9\tPASS\tx\tGT\t1", "c\t10\t.\tACG\tA\t9\tPASS\tx\tGT\t1", "c\t20\t.\tA\tAT,*\t9\tPASS\tx\tGT\t1", "c\t30\t.\tA\tG\t9\tPASS\tx\tGT\t1")
    out = spark.createDataFrame([(25, 30)], "start_pos int, end_pos int")
    assert rows(text.plain_vcf(spark, path, out)) == [("s1", 5, "C", "snp"), ("s1", 11, "-", "del"), ("s1", 12, "-", "del"), ("s1", 21, "T", "ins")]


def test_dictionary_files_with_aliases_and_unknown_codes(spark, put):
    entries = text.dictionary_entries(spark, put("Walker.txt", "# c", "Gene\tkatG\t315\tS\tT\tINH", "Gene\tgyrA\t90\tA\tV\tFQ", "Gene\tx\t1\tA\tV\tZZZ"))
    aliases = {"INH": ["Isoniazid"], "FQ": ["Ofloxacin", "Moxifloxacin"]}
    assert rows(phenotype.expand_aliases(entries, aliases)) == [("Gene\tgyrA\t90\tA\tV", "Moxifloxacin"), ("Gene\tgyrA\t90\tA\tV", "Ofloxacin"), ("Gene\tkatG\t315\tS\tT", "Isoniazid")]
    assert rows(phenotype.unknown_codes(entries, aliases)) == [("ZZZ", 1)]


def test_gene_graph_and_tables(spark, put):
    edges = text.interaction_edges(spark, put("links.txt", "protein1 protein2 combined_score", "83332.Rv1 83332.Rv2 900", "83332.Rv2 83332.Rv1 900"))
    assert rows(edges) == [("Rv1", "Rv2", 900), ("Rv2", "Rv1", 900)]
    genes = text.gene_tables(spark, put("inh.annotations", "name\tlocus\tpseudo\tx\thyp\ty\tdescription\tlabel", "a\tRv1\tFalse\t0\tFalse\t0\tkinase\tmiss", "PGRS2\tRv2\tFalse\t0\tFalse\t0\tp\tmiss", "c\tRv3\tTrue\t0\tFalse\t0\tp\tINH", "d\tRv4\tFalse\t0\tFalse\t0\thypothetical p\tmiss"))
    names = lambda **k: [r["name"] for r in graph.selected_genes(genes, **k).orderBy("name").collect()]
    assert names() == ["PGRS2", "a", "c", "d"] and names(tag="PGRS") == ["a", "c", "d"] and names(pseudogenes=False) == ["PGRS2", "a", "d"] and names(hypothetical=False, known=False) == ["PGRS2", "a"]
    features = spark.createDataFrame([("Gene", "a", "Rv1"), ("Gene", "Rv2", "Rv9"), ("Gene", "z", "Rv2"), ("upstream", "u", "Rv3")], "ftype string, name string, locus string")
    found = graph.with_features(spark.createDataFrame([("a",), ("Rv1",), ("Rv2",), ("Rv3",)], "key string"), features, "key")
    assert rows(found) == [("Rv1", "a"), ("Rv2", "Rv2"), ("a", "a")]


def test_fdr_cut_is_capped_and_leaves_markers_out(spark):
    curve = spark.createDataFrame([("x", 0.01, 100, 5.0), ("x", 0.2, 200, 19.0), ("x", 0.3, 210, 60.0), ("y", 0.01, 1, 5.0), ("z", 0.02, 50, 1.0)], "drug string, p double, observed long, expected double")
    cuts = graph.fdr_cuts(curve)
    assert rows(cuts) == [("x", 0.05), ("z", 0.02)]
    sites = spark.createDataFrame([("x", 1, 0.0), ("x", 2, 0.05), ("x", 3, 0.06), ("y", 4, 0.0), ("z", 5, 0.02), ("z", 6, 0.01)], "drug string, pos int, p double")
    markers = spark.createDataFrame([(6,), (1,)], "pos int")
    assert rows(graph.cut_sites(sites, cuts, markers)) == [("x", 2, 0.05), ("z", 5, 0.02)]
    assert rows(graph.zero_sites(sites)) == [("x", 1, 0.0), ("y", 4, 0.0)] and rows(graph.zero_sites(sites, markers)) == [("y", 4, 0.0)]


def test_last_field_left_out_and_shrunk_depth(spark, put, tmp_path):
    path = put("s1.variants", "5\tA\tsnp\tx", "7\t-\tdel\ty")
    assert rows(text.variants(spark, path, drop_last=True)) == [("s1", 5, "A", "snp"), ("s1", 7, "-", "del")]
    put("run1.depth", "c\t1\t10", "c\t2\t0")
    depth = text.shrunk_depth(spark, put("run2.depth", "c\t1\t7").replace("run2", "*"), spark.createDataFrame([("run1", "S9")], "sample_id string, name string"))
    assert rows(depth) == [("S9", 1, 10), ("S9", 2, 0), ("run2", 1, 7)]
    sinks.write_depth(depth, f"{tmp_path}/d")
    assert "".join(f.read_text() for f in sorted(Path(f"{tmp_path}/d/sample_id=S9").glob("part-*"))) == "10\n0\n"


def test_organisms_by_the_kind_of_id(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id string, organism string")
    ids = spark.createDataFrame([("SAM1",), ("ERR1",), ("SAM2",), ("ERR1",)], "id string")
    assert rows(phenotype.organism_of(ids, frame([("ERR1", "b"), ("ERR1", "a"), ("SAM2", "x")]), frame([("SAM1", "c")]))) == [("ERR1", "a"), ("SAM1", "c"), ("SAM2", None)]

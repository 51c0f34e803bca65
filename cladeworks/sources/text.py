"""Readers of the domain's text formats as typed DataFrames.

Every reader takes a path (file, folder or glob) that Spark opens itself, keeps
one schema, and names the sample, drug or annotation after the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeworks.operators.consequence import decompose
from cladeworks.operators.intervals import points_in_intervals

def _stem(suffix: str) -> Column:
    """The file's name up to ``suffix``."""
    return F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*?){suffix}(\.gz)?$", 1)


def _lines(spark: SparkSession, path: str, suffix: str = r"\.[^.]*") -> DataFrame:
    """``(source, line)`` without comments and blank lines."""
    rows = spark.read.text(path).select(_stem(suffix).alias("source"), F.rtrim("value").alias("line"))
    return rows.where("line <> '' and not startswith(line, '#')")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(name, seq)`` of every record, bases in upper case."""
    records = spark.read.option("lineSep", ">").text(path).where("value <> ''")
    return records.select(F.regexp_extract("value", r"^(\S*)", 1).alias("name"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s", "")).alias("seq"))


def reference(spark: SparkSession, path: str) -> DataFrame:
    """The reference as one row ``(seq)``: the last record of its file."""
    records = fasta(spark, path).select("seq", F.monotonically_increasing_id().alias("read_order"))
    return records.orderBy(F.desc("read_order")).limit(1).select("seq")


def alignment_columns(records: DataFrame) -> DataFrame:
    """``(name, col, base)`` from ``(name, seq)``; columns count from 0."""
    return records.select("name", F.posexplode(F.split("seq", "")).alias("col", "base"))


def gff(spark: SparkSession, path: str, upstream: int = 100, whole_codons: bool = False) -> DataFrame:
    """``(ftype, name, start_pos, end_pos, strand, locus, synonyms, product, is_pseudogene, is_hypothetical, in_proteome)``.

    Repeats and mobile elements go; an RNA row replaces the gene row of the
    same name; each gene also gives an ``upstream`` row before it by strand.
    ``whole_codons`` leaves out genes whose length is no multiple of three.
    """
    f = F.split("line", "\t")
    rows = _lines(spark, path).where(F.size(f) >= 9).select(
        F.get(f, 2).alias("kind"), F.get(f, 3).try_cast("int").alias("start_pos"), F.get(f, 4).try_cast("int").alias("end_pos"),
        F.when(F.get(f, 6) == "-", -1).otherwise(1).alias("strand"), F.get(f, 8).alias("about"),
    )
    tag = lambda name: F.nullif(F.regexp_extract("about", rf'(?:^|;)\s*{name}[ =]"?([^";]*)', 1), F.lit(""))
    rows = rows.where(~F.col("kind").isin("Repeat_region", "mobile_element")).select(
        "*", F.coalesce(tag("gene"), tag("locus_tag")).alias("name"), tag("locus_tag").alias("locus"), F.split(F.coalesce(tag("synonyms"), F.lit("")), ",").alias("synonyms"),
        F.nullif(F.regexp_extract("about", r'product[^"]*"([^"]*)"', 1), F.lit("")).alias("product"), F.contains(F.lower("about"), F.lit("pseudo")).alias("is_pseudogene"),
        F.contains(F.lower("about"), F.lit("hypothetical")).alias("is_hypothetical"), F.contains(F.lower("about"), F.lit("proteom")).alias("in_proteome"),
    )
    rna = {"ncRNA": "ncRNA", "rRNA": "rRNA", "tRNA": "tRNA", "Misc._RNA": "miscRNA"}
    kind = F.create_map(*[F.lit(x) for pair in rna.items() for x in pair])
    columns = ["ftype", "name", "start_pos", "end_pos", "strand", "locus", "synonyms", "product", "is_pseudogene", "is_hypothetical", "in_proteome"]
    rnas = rows.where(F.col("kind").isin(*rna)).withColumn("ftype", F.element_at(kind, F.col("kind"))).select(columns)
    genes = rows.where("kind = 'Gene'").withColumn("ftype", F.lit("Gene")).select(columns).join(rnas.select("name"), "name", "left_anti").select(columns)
    if whole_codons:
        genes = genes.where("(end_pos - start_pos + 1) % 3 = 0")
    before = genes.withColumn("ftype", F.lit("upstream")).withColumns({
        "start_pos": F.when(F.col("strand") == 1, F.greatest(F.col("start_pos") - upstream, F.lit(1))).otherwise(F.col("end_pos") + 1),
        "end_pos": F.when(F.col("strand") == 1, F.col("start_pos") - 1).otherwise(F.col("end_pos") + upstream),
    })
    return genes.unionByName(rnas).unionByName(before.select(columns))


def variants(spark: SparkSession, path: str, keys: DataFrame | None = None, drop_last: bool = False) -> DataFrame:
    """``(sample_id, pos, alt, vtype)`` of per-sample files ``<sample>.variants``; ``keys`` keeps listed (pos, alt, vtype) only.

    With ``drop_last`` the last field of a line is left out, the type too where it is the last.
    """
    f = F.split("line", "\t")
    f = F.slice(f, 1, F.size(f) - 1) if drop_last else f
    rows = _lines(spark, path, r"\.variants").select(F.col("source").alias("sample_id"), F.get(f, 0).try_cast("int").alias("pos"), F.get(f, 1).alias("alt"), F.get(f, 2).alias("vtype")).where("pos is not null")
    return rows if keys is None else rows.join(keys, ["pos", "alt", "vtype"], "left_semi").select("sample_id", "pos", "alt", "vtype")


def key_list(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(F.trim("line").alias("key"))


def phenotypes(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id, drug, pheno)`` of files ``<drug>.pheno``."""
    f = F.split("line", "\t")
    return _lines(spark, path, r"\.pheno").select(F.get(f, 0).alias("sample_id"), F.col("source").alias("drug"), F.get(f, 1).try_cast("int").alias("pheno"))


def _info(text: Column) -> Column:
    return F.str_to_map(text, F.lit(";"), F.lit("="))


def _vcf(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("line", "\t")
    rows = _lines(spark, path, r"(_h37rv)?\.vcf").where(F.size(f) >= 8)
    return rows.select(
        F.col("source").alias("sample_id"), F.get(f, 1).try_cast("int").alias("pos"), F.get(f, 3).alias("ref"), F.split(F.get(f, 4), ",").alias("alts"), F.get(f, 5).try_cast("double").alias("qual"),
        F.get(f, 6).alias("filter"), _info(F.get(f, 7)).alias("info"), F.split(F.get(f, 9), ":").alias("cell"), F.split(F.get(f, 8), ":").alias("format"),
    )


def _cell(name: str) -> Column:
    return F.get("cell", F.array_position("format", name).cast("int") - 1)


def genotyper_vcf(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id, pos, alt, vtype, cov, qual, mqm)``: the allele whose likelihood is 0, its CIGAR spread into single events.

    M moves on, X is a snp per base, D a deletion per base, I one insertion
    before the next reference base.
    """
    rows = _vcf(spark, path).withColumn("k", F.array_position(F.split(_cell("GL"), ","), "0").cast("int") - 2).where("k >= 0")
    pick = lambda name: F.get(F.split(F.element_at("info", name), ","), F.col("k"))
    rows = rows.select("sample_id", "pos", F.get("alts", F.col("k")).alias("alt"), "qual", pick("CIGAR").alias("cigar"), pick("MQM").try_cast("double").alias("mqm"), F.get(F.split(_cell("AO"), ","), F.col("k")).try_cast("int").alias("cov"))
    return cigar_events(rows)


def cigar_events(rows: DataFrame) -> DataFrame:
    """Single events of ``(…, pos, alt, cigar)``: the running offsets come from one aggregate over the operations."""
    rows = rows.withColumn("n", F.regexp_extract_all("cigar", F.lit(r"(\d+)[MXID=]"), F.lit(1))).withColumn("op", F.regexp_extract_all("cigar", F.lit(r"\d+([MXID=])"), F.lit(1)))
    walk = F.expr(
        "aggregate(arrays_zip(n, op), named_struct('r', 0, 'q', 0, 'out', cast(array() as array<struct<r:int,q:int,n:int,op:string>>)),"
        " (a, x) -> named_struct('r', a.r + if(x.op = 'I', 0, int(x.n)), 'q', a.q + if(x.op = 'D', 0, int(x.n)), 'out', concat(a.out, array(named_struct('r', a.r, 'q', a.q, 'n', int(x.n), 'op', x.op)))), a -> a.out)"
    )
    events = rows.withColumn("e", F.explode(walk)).where("e.op in ('X', 'D', 'I')")
    events = events.withColumn("i", F.explode(F.when(F.col("e.op") == "I", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("e.n") - 1))))
    size = F.when(F.col("e.op") == "I", F.col("e.n")).otherwise(1)
    alt = F.when(F.col("e.op") == "D", "-").otherwise(F.substring("alt", F.col("e.q") + F.col("i") + 1, size))
    kind = F.element_at(F.create_map(F.lit("X"), F.lit("snp"), F.lit("D"), F.lit("del"), F.lit("I"), F.lit("ins")), F.col("e.op"))
    keep = [c for c in rows.columns if c not in ("pos", "alt", "cigar", "n", "op")]
    return events.select((F.col("pos") + F.col("e.r") + F.col("i")).alias("pos"), alt.alias("alt"), kind.alias("vtype"), *keep)


def joint_vcf(spark: SparkSession, path: str, least_depth: int = 10, least_share: float = 0.75) -> DataFrame:
    """``(sample_id, pos, ref, alt, info)``: the allele with phred likelihood 0, if its depth and share of the depth suffice."""
    rows = _vcf(spark, path).withColumn("k", F.array_position(F.split(_cell("PL"), ","), "0").cast("int") - 2).withColumn("ad", F.transform(F.split(_cell("AD"), ","), lambda x: x.try_cast("int")))
    total = F.aggregate("ad", F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    own = F.get("ad", F.col("k") + 1)
    return rows.where((F.col("k") >= 0) & (total >= least_depth) & (own >= least_share * total)).select("sample_id", "pos", "ref", F.get("alts", F.col("k")).alias("alt"), "info")


def polisher_vcf(spark: SparkSession, path: str, bounds: dict[str, float] | None = None) -> DataFrame:
    """``(sample_id, pos, ref, alt, info)`` of rows that pass or are ambiguous, precise, and within the bounds; a missing annotation passes."""
    bounds = bounds if bounds is not None else {"DP": 10, "AF": 0.75, "MQ": 30, "BQ": 20}
    value = lambda name: F.element_at("info", name).try_cast("double")
    keep = F.col("filter").isin("PASS", "Amb") & (F.get("alts", F.lit(0)) != ".") & ~F.map_contains_key("info", "IMPRECISE")
    for name, least in bounds.items():
        keep = keep & F.coalesce(value(name) >= least, F.lit(True))
    keep = keep & F.coalesce(value("XC") <= value("DP"), F.lit(True))
    return _vcf(spark, path).where(keep).select("sample_id", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"), "info")


def graph_vcf(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id, pos, alt, vtype)``: a longer ref gives a deletion per base after the first, a longer alt one insertion."""
    rows = _vcf(spark, path).select("sample_id", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"))
    snp = rows.where("length(ref) = 1 and length(alt) = 1").select("sample_id", "pos", "alt", F.lit("snp").alias("vtype"))
    gone = rows.where("length(ref) > length(alt)").select("sample_id", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + F.length("ref") - 1)).alias("pos"), F.lit("-").alias("alt"), F.lit("del").alias("vtype"))
    more = rows.where("length(ref) < length(alt)").select("sample_id", (F.col("pos") + 1).alias("pos"), F.expr("substring(alt, 2)").alias("alt"), F.lit("ins").alias("vtype"))
    return snp.union(gone).union(more)


def plain_vcf(spark: SparkSession, path: str, exclude: DataFrame | None = None) -> DataFrame:
    """``(sample_id, pos, alt, vtype)`` of the alleles of plain files; positions inside ``exclude (start_pos, end_pos)`` go, longer alleles are taken apart."""
    rows = _vcf(spark, path).select("sample_id", "pos", F.upper("ref").alias("ref"), F.explode("alts").alias("alt")).where("alt not in ('.', '*') and ref <> '*'").withColumn("alt", F.upper("alt"))
    if exclude is not None:
        rows = points_in_intervals(rows, exclude, how="left_anti")
    events = decompose(rows.select(F.struct("sample_id", "pos").alias("key"), "ref", "alt"))
    return events.select("key.sample_id", (F.col("key.pos") + F.col("off")).alias("pos"), F.when(F.col("vtype") == "del", "-").otherwise(F.col("alt")).alias("alt"), "vtype").distinct()


def dictionary_entries(spark: SparkSession, path: str) -> DataFrame:
    """``(dict, feature, code)`` of files ``<dict>.txt``: the fields of a mutation, then the code of its drug."""
    parts = lambda i: F.regexp_extract("line", r"^(.*)\t([^\t]*)$", i)
    return _lines(spark, path).select(F.col("source").alias("dict"), parts(1).alias("feature"), F.trim(parts(2)).alias("code")).where("feature <> ''")


def interaction_edges(spark: SparkSession, path: str) -> DataFrame:
    """``(src, dst, score)`` of lines ``<organism>.<locus> <organism>.<locus> <score>``."""
    f = F.split("line", r"\s+")
    locus = lambda i: F.split_part(F.get(f, i), F.lit("."), F.lit(2))
    return _lines(spark, path).select(locus(0).alias("src"), locus(1).alias("dst"), F.get(f, 2).try_cast("int").alias("score")).where("src <> '' and dst <> ''")


def gene_tables(spark: SparkSession, path: str) -> DataFrame:
    """``(source, name, locus, is_pseudogene, is_hypothetical, description, label)`` of a drug's table of genes; the head line begins with a name but no flag."""
    f = F.split("line", "\t", -1)
    last = lambda i: F.element_at(f, F.lit(-i))
    rows = _lines(spark, path).where(F.size(f) >= 7).where(F.lower(F.get(f, 2)).isin("true", "false"))
    return rows.select(F.col("source"), F.get(f, 0).alias("name"), F.get(f, 1).alias("locus"), (F.lower(F.get(f, 2)) == "true").alias("is_pseudogene"), ((F.lower(F.get(f, 4)) == "true") | F.contains(last(2), F.lit("hypothetical"))).alias("is_hypothetical"), last(2).alias("description"), last(1).alias("label"))


def depth(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id, pos, depth)`` of files ``<sample>.depth`` (contig, pos, depth)."""
    f = F.split("line", "\t")
    return _lines(spark, path, r"\.depth").select(F.col("source").alias("sample_id"), F.get(f, 1).try_cast("int").alias("pos"), F.get(f, 2).try_cast("int").alias("depth"))


def shrunk_depth(spark: SparkSession, path: str, names: DataFrame | None = None) -> DataFrame:
    """``depth`` as ``(sample_id, pos, depth)`` under other names, from ``names (sample_id, name)``: samples without one keep theirs."""
    rows = depth(spark, path)
    if names is None:
        return rows
    other = names.groupBy("sample_id").agg(F.min("name").alias("name"))
    return rows.join(other, "sample_id", "left").select(F.coalesce("name", "sample_id").alias("sample_id"), "pos", "depth")


def coverage_intervals(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id, start_pos, end_pos)`` of files ``<sample>.coverage``: rows of two whole numbers; header lines have other shapes."""
    f = F.split("line", "\t")
    rows = _lines(spark, path, r"\.coverage").where(F.size(f) == 2)
    return rows.select(F.col("source").alias("sample_id"), F.get(f, 0).try_cast("int").alias("start_pos"), F.get(f, 1).try_cast("int").alias("end_pos")).where("start_pos is not null and end_pos is not null")


def aligner_snps(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id, pos, alt, vtype)`` of an aligner's table (pos, ref or '.', alt or '.'): rows with '.' at one place merge to one insertion, runs of deletions stay single bases."""
    f = F.split(F.trim("line"), r"\s+")
    rows = spark.read.text(path).select(_stem(r"\.snps").alias("sample_id"), F.monotonically_increasing_id().alias("k"), F.col("value").alias("line"))
    rows = rows.select("sample_id", "k", F.get(f, 0).try_cast("int").alias("pos"), F.get(f, 1).alias("ref"), F.get(f, 2).alias("alt")).where("pos is not null and length(ref) = 1 and length(alt) = 1")
    ins = rows.where("ref = '.'").groupBy("sample_id", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "alt"))), lambda x: x["alt"]), "").alias("alt")).withColumn("vtype", F.lit("ins"))
    rest = rows.where("ref <> '.'").select("sample_id", "pos", F.when(F.col("alt") == ".", "-").otherwise(F.col("alt")).alias("alt"), F.when(F.col("alt") == ".", "del").otherwise("snp").alias("vtype"))
    return rest.union(ins.select("sample_id", "pos", "alt", "vtype"))


def tree_edges(spark: SparkSession, path: str) -> DataFrame:
    """``(child, parent, dist)``; the line of one field is the root."""
    f = F.split("line", "\t")
    return _lines(spark, path).select(F.get(f, 0).alias("child"), F.get(f, 1).alias("parent"), F.get(f, 2).try_cast("double").alias("dist"))


def edge_tables(spark: SparkSession, path: str) -> DataFrame:
    """``(drug, child, parent, dist, syn, change, nonsyn)`` of files ``<drug>.xparr``; ``syn`` and ``nonsyn`` are lists.

    The two head lines of each file are known by their form: the names of the columns, and the root alone. The root has a row without a parent.
    An absent change is null.
    """
    f = F.split("line", "\t", -1)
    rows = _lines(spark, path, r"\.xparr").where("not line rlike '^child\tparent(\t|$)'")
    listed = lambda i: F.filter(F.split(F.coalesce(F.get(f, i), F.lit("")), ";"), lambda m: m != "")
    cell = lambda i: F.nullif(F.get(f, i), F.lit(""))
    return rows.select(F.col("source").alias("drug"), F.get(f, 0).alias("child"), cell(1).alias("parent"), cell(2).try_cast("double").alias("dist"), listed(3).alias("syn"), cell(4).alias("change"), listed(5).alias("nonsyn"))


def base_probabilities(spark: SparkSession, path: str) -> DataFrame:
    """``(source, node, pos, base, prob)`` of ancestral probability tables, turned long.

    A table's head names its nodes (``Node_<id>``, one behind the other); a line has the position, a separator and the base, then a probability for each node.
    """
    rows = _lines(spark, path)
    heads = rows.where("contains(line, 'Node_')").select("source", F.posexplode(F.regexp_extract_all("line", F.lit(r"Node_\s*([^\s,]+?)(?=\s|,|Node_|$)"), F.lit(1))).alias("place", "node"))
    cells = F.filter(F.split("line", r"[\s,]+"), lambda x: x != "")
    lines = rows.where("not contains(line, 'Node_')").select("source", cells.alias("c")).where("size(c) > 1").withColumn("key", F.get("c", F.lit(0)))
    long = lines.select("source", F.expr("left(key, length(key) - 2)").try_cast("long").alias("pos"), F.expr("right(key, 1)").alias("base"), F.posexplode(F.slice("c", 2, F.size("c") - 1)).alias("place", "prob"))
    return long.join(heads, ["source", "place"]).select("source", "node", "pos", "base", F.col("prob").try_cast("double").alias("prob")).where("pos is not null and prob is not null")


def state_probabilities(spark: SparkSession, path: str) -> DataFrame:
    """``(drug, row_idx, p0, p1)`` of files ``<drug>.probs``: a line for each ancestor, numbered from 0 in the order of the file, behind a head line."""
    f = F.split("line", r"\s+")
    rows = _lines(spark, path, r"\.probs").select(F.col("source").alias("drug"), F.get(f, 0).try_cast("double").alias("p0"), F.get(f, 1).try_cast("double").alias("p1")).where("p0 is not null and p1 is not null")
    numbered = number_rows(rows)
    first = numbered.groupBy("drug").agg(F.min("row_idx").alias("first"))
    return numbered.join(first, "drug").select("drug", (F.col("row_idx") - F.col("first")).alias("row_idx"), "p0", "p1")


def repeats(spark: SparkSession, path: str) -> DataFrame:
    """``(start_pos, end_pos)`` of a tandem-repeat table: lines that begin with two whole numbers; the end is one further."""
    m = lambda i: F.regexp_extract("line", r"^(\d+)\s+(\d+)\s", i).try_cast("int")
    return _lines(spark, path).select(m(1).alias("start_pos"), (m(2) + 1).alias("end_pos")).where("start_pos is not null")


def run_info(spark: SparkSession, path: str) -> DataFrame:
    """``(run, library, biosample, organism)`` of sequencing-run metadata."""
    return spark.read.option("header", True).csv(path).select(F.col("Run").alias("run"), F.col("LibraryName").alias("library"), F.col("BioSample").alias("biosample"), F.col("ScientificName").alias("organism"))


def qc_flags(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id, n_fail, n_warn)`` of summary files (flag, section, file)."""
    f = F.split("line", "\t")
    rows = _lines(spark, path, r"(_summary)?\.txt").select(F.col("source").alias("sample_id"), F.get(f, 0).alias("flag"))
    return rows.groupBy("sample_id").agg(F.count(F.when(F.col("flag") == "FAIL", 1)).alias("n_fail"), F.count(F.when(F.col("flag") == "WARN", 1)).alias("n_warn"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id, qname, flag, start_pos, end_pos, mapq, cigar, seq)`` of SAM text; the end follows from the CIGAR."""
    f = F.split("line", "\t")
    rows = _lines(spark, path, r"\.sam").where("not startswith(line, '@')").select(
        F.col("source").alias("sample_id"), F.get(f, 0).alias("qname"), F.get(f, 1).try_cast("int").alias("flag"), F.get(f, 3).try_cast("int").alias("start_pos"), F.get(f, 4).try_cast("int").alias("mapq"), F.get(f, 5).alias("cigar"), F.get(f, 9).alias("seq"))
    spans = F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0), lambda a, x: a + x.cast("int"))
    return rows.select("sample_id", "qname", "flag", "start_pos", (F.col("start_pos") + spans - 1).alias("end_pos"), "mapq", "cigar", "seq")


def coefficients(spark: SparkSession, path: str) -> DataFrame:
    """``(drug, feature, coef)`` of logs ``<drug>.log`` (feature, coefficient)."""
    return _lines(spark, path, r"\.log").select(F.col("source").alias("drug"), F.regexp_extract("line", r"^(.*)\t[^\t]*$", 1).alias("feature"), F.regexp_extract("line", r"\t([^\t]*)$", 1).try_cast("double").alias("coef")).where("coef is not null")


def drug_features(spark: SparkSession, path: str, tags: list[str]) -> DataFrame:
    """Distinct ``(drug, tag, value)`` of tagged lines ``tag: value`` in a file per drug."""
    tag, value = F.regexp_extract("line", r"^\s*([^:]+):", 1), F.trim(F.regexp_extract("line", r"^[^:]+:(.*)$", 1))
    return _lines(spark, path).select(F.col("source").alias("drug"), tag.alias("tag"), value.alias("value")).where(F.col("tag").isin(tags) & (F.col("value") != "")).distinct()


def number_rows(df: DataFrame) -> DataFrame:
    """Column ``row_idx`` from 0 in the order that a file was read, for lining up two files."""
    marked = df.select("*", F.monotonically_increasing_id().alias("_at"), F.spark_partition_id().alias("_part"))
    sizes = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))  # one row per partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.join(F.broadcast(sizes.select("_part", "_first", before.alias("_base"))), "_part").select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_base")).alias("row_idx"))

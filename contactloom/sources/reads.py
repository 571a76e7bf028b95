"""Mapped reads, pairs and reference sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactloom.functions.text import enzyme, motif_regex
from contactloom.sources.lines import numbered

_END = [("chrom", "c", T.StringType()), ("pos", "p", T.LongType()), ("strand", "s", T.IntegerType()), ("len", "l", T.IntegerType()), ("rs", "rs", T.LongType()), ("re", "re", T.LongType())]
ENDS = T.StructType([T.StructField("name", T.StringType()), *[T.StructField(name, kind) for name, _, kind in _END]])
PAIRS = T.StructType(
    [T.StructField("read_id", T.StringType()), *[T.StructField(f"{short}{k}", kind) for k in (1, 2) for _, short, kind in _END]]
)
#: Width of the buckets on which a position meets its restriction fragment.
CHUNK = 100_000


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """13-column pairs; ``#`` lines are skipped and a wrong number of columns fails."""
    return spark.read.schema(PAIRS).option("sep", "\t").option("comment", "#").option("mode", "FAILFAST").csv(path)


def read_ends(spark: SparkSession, path: str) -> DataFrame:
    """7-column read ends; ends of a read joined by ``|||`` become rows."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    part = F.split("e", "\t")
    rows = lines.select(F.explode(F.split("value", r"\|\|\|")).alias("e"))
    return rows.select(*[part[k].cast(f.dataType).alias(f.name) for k, f in enumerate(ENDS)])


def read_fasta(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(chrom, ord, length, seq), sequences in upper case; ``pattern`` keeps chromosomes by regular expression."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    rows = records.select(
        F.monotonically_increasing_id().alias("k"),
        F.regexp_extract("value", r"^(\S+)", 1).alias("chrom"),
        F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")).alias("seq"),
    )
    rows = rows if pattern is None else rows.where(F.col("chrom").rlike(pattern))
    return rows.select("chrom", (F.row_number().over(Window.orderBy("k")) - 1).alias("ord"), F.length("seq").cast("long").alias("length"), "seq")


def fragments(genome: DataFrame, name: str) -> DataFrame:
    """(chrom, frag_id, start, end) of an enzyme's fragments.

    Sites are found by splitting the sequence before every (overlapping) match and
    summing the pieces' lengths; a chromosome is one row, as in the genome table.
    """
    left, right = enzyme(name)
    site = motif_regex(left + right)
    pieces = genome.select("chrom", "length", F.posexplode(F.split("seq", f"(?={site})")).alias("k", "s"))
    w = Window.partitionBy("chrom").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    cuts = pieces.withColumn("at", F.coalesce(F.sum(F.length("s")).over(w), F.lit(0))).where("k > 0 AND s <> ''")
    cuts = cuts.select("chrom", (F.col("at") + len(left)).alias("at"))
    edges = cuts.unionByName(genome.select("chrom", F.lit(1).cast("long").alias("at"))).unionByName(genome.select("chrom", F.col("length").alias("at"))).distinct()
    w = Window.partitionBy("chrom").orderBy("at")
    rows = edges.select("chrom", F.row_number().over(w).alias("frag_id"), F.col("at").alias("start"), F.lead("at").over(w).alias("end"))
    return rows.where("end IS NOT NULL").withColumn("frag_id", F.col("frag_id").cast("long") - 1)


def with_fragment(ends: DataFrame, frags: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Read ends with the cut sites around them (rs, re).

    An as-of lookup as an equi-join: fragments are exploded to the chunks of the
    genome they touch, so a position meets only the fragments of its chunk.
    """
    at = frags.select("chrom", F.col("start").alias("rs"), F.col("end").alias("re"))
    at = at.withColumn("k", F.explode(F.sequence(F.floor(F.col("rs") / chunk), F.floor(F.col("re") / chunk))))
    rows = ends.drop("rs", "re").withColumn("k", F.floor(F.col("pos") / chunk))
    return rows.join(at, ["chrom", "k"], "left").where("rs IS NULL OR (pos > rs AND pos <= re) OR (pos = rs AND rs = 1)").drop("k").select(*ENDS.fieldNames())


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """Ends of ``id seq qual hits chrom:strand:pos:cigar`` lines; unmapped and multiple hits are dropped.  Reverse reads start at their 5' end."""
    part = F.split("value", "\t")
    rows = spark.read.text(path).select(part[0].alias("name"), F.length(part[1]).alias("len"), part[3].alias("hits"), F.split(part[4], ":").alias("a"))
    forward = F.col("a")[1] == "+"
    pos = F.col("a")[2].cast("long")
    return rows.where(F.col("hits").rlike(r"^(?:0:)*1(?:[:+].*)?$") & (F.size("a") >= 4)).select(
        "name", F.col("a")[0].alias("chrom"), F.when(forward, pos).otherwise(pos + F.col("len") - 1).alias("pos"), forward.cast("int").alias("strand"),
        F.col("len").cast("int").alias("len"), F.lit(0).cast("long").alias("rs"), F.lit(0).cast("long").alias("re"),
    )


def read_sam(spark: SparkSession, path: str, min_quality: int = 0) -> DataFrame:
    """Ends of SAM lines; unmapped reads and reads with a second-best hit tag (XS) are dropped."""
    part = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@")).select(
        part[0].alias("name"), part[1].cast("int").alias("flag"), part[2].alias("chrom"), part[3].cast("long").alias("pos"), part[4].cast("int").alias("mapq"),
        F.length(part[9]).cast("int").alias("len"), "value",
    )
    bit = lambda k: F.col("flag").bitwiseAND(k) != 0
    rows = rows.where(~bit(4) & (F.col("chrom") != "*") & ~F.col("value").rlike(r"\tXS:i:") & (F.col("mapq") >= min_quality))
    return rows.select(
        "name", "chrom", F.when(bit(16), F.col("pos") + F.col("len") - 1).otherwise(F.col("pos")).alias("pos"), (~bit(16)).cast("int").alias("strand"), "len",
        F.lit(0).cast("long").alias("rs"), F.lit(0).cast("long").alias("re"),
    )


def read_split_sam(spark: SparkSession, path: str, min_quality: int = 4) -> DataFrame:
    """Ends of the pieces of paired reads in SAM lines of a mapper that splits reads; a piece is as long as its span on the reference.

    With ``with_fragment`` and ``all_contacts`` they become all pairs of pieces of a read.
    """
    part = F.split("value", "\t")
    span = F.aggregate(F.transform(F.regexp_extract_all(part[5], F.lit(r"(\d+)[MDN=X]"), F.lit(1)), lambda x: x.cast("int")), F.lit(0), lambda a, b: a + b)
    rows = spark.read.text(path).where(~F.col("value").startswith("@")).select(
        part[0].alias("name"), part[1].cast("int").alias("flag"), part[2].alias("chrom"), part[3].cast("long").alias("pos"), part[4].cast("int").alias("mapq"), span.alias("len")
    )
    bit = lambda k: F.col("flag").bitwiseAND(k) != 0
    rows = rows.where(bit(1) & ~bit(4) & (F.col("mapq") >= min_quality))
    return rows.select(
        "name", "chrom", F.when(bit(16), F.col("pos") + F.col("len") - 1).otherwise(F.col("pos")).alias("pos"), (~bit(16)).cast("int").alias("strand"), "len",
        F.lit(0).cast("long").alias("rs"), F.lit(0).cast("long").alias("re"),
    )


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, qual): records of four lines, told apart by their line number."""
    lines = numbered(spark.read.text(path))
    record = lines.groupBy(F.floor(F.col("n") / 4).alias("r")).agg(*[F.max(F.when(F.col("n") % 4 == k, F.col("value"))).alias(c) for k, c in ((0, "name"), (1, "seq"), (3, "qual"))])
    return record.select(F.regexp_replace("name", "^@", "").alias("name"), "seq", "qual")


def is_fastq(spark: SparkSession, path: str) -> bool:
    first = [r[0] for r in spark.read.text(path).limit(4).collect()]
    return len(first) == 4 and first[0].startswith("@") and first[2].startswith("+")


def split_at_sites(reads: DataFrame, joint: str, site_end: str = "", min_len: int = 15) -> DataFrame:
    """Reads (name, seq, qual) cut at ligation sites: pieces of at least ``min_len``, marked ``~k~`` in the name where there are several."""
    piece = F.posexplode(F.split("seq", joint))
    rows = reads.select("name", "qual", piece.alias("k", "piece"))
    w = Window.partitionBy("name").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"at": F.coalesce(F.sum(F.length("piece") + len(joint)).over(w), F.lit(0)), "n": F.count("*").over(Window.partitionBy("name"))})
    name = F.when(F.col("n") > 1, F.concat("name", F.lit("~"), F.col("k") + 1, F.lit("~"))).otherwise(F.col("name"))
    return rows.where(F.length("piece") >= min_len).select(name.alias("name"), F.col("piece").alias("seq"), F.expr("substring(qual, CAST(at AS INT) + 1, length(piece))").alias("qual"))


def enzyme_hits(reads: DataFrame, enzymes: dict[str, str]) -> DataFrame:
    """(enzyme, hits, reads): reads that start with an enzyme's filled end; one pass for all enzymes."""
    counts = reads.agg(F.count("*").alias("reads"), *[F.count_if(F.col("seq").rlike(f"^{motif_regex(m)}")).alias(n) for n, m in enzymes.items()])
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("enzyme"), F.col(n).alias("hits")) for n in enzymes]))
    return counts.select(stacked.alias("e"), "reads").select("e.enzyme", "e.hits", "reads")


def base(name: Column) -> Column:
    return F.split(name, "~")[0]


def all_contacts(ends: DataFrame, min_quality_column: str | None = None) -> DataFrame:
    """Every pair of pieces inside a read of name-grouped ends, named ``#k/n``: the direct form for fragment mappers."""
    gathered = ends.groupBy(base(F.col("name")).alias("read")).agg(F.sort_array(F.collect_list(F.struct("chrom", "pos", "strand", "len", "rs", "re"))).alias("e"))
    made = gathered.where(F.size("e") > 1).select("read", F.expr("flatten(transform(e, (x, i) -> transform(slice(e, i + 2, size(e)), y -> struct(x AS a, y AS b))))").alias("p"))
    rows = made.select("read", F.size("p").alias("n"), F.posexplode("p").alias("k", "x"))
    name = F.when(F.col("n") > 1, F.concat("read", F.lit("#"), F.col("k") + 1, F.lit("/"), "n")).otherwise(F.col("read"))
    names = {"c": "chrom", "p": "pos", "s": "strand", "l": "len", "rs": "rs", "re": "re"}
    return rows.select(name.alias("read_id"), *[F.col(f"x.{side}.{source}").alias(f"{t}{k}") for k, side in ((1, "a"), (2, "b")) for t, source in names.items()])

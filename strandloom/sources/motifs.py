"""Word lists, clusters, matrices and motif files as DataFrames, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.sequences import log_number

WORDS = "word string, pos_sites int, neg_sites int, z_corrected double, z double"
LETTERS = "ACGT"


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WORDS).csv(path, sep="\t")


def write_words(words: DataFrame, path: str) -> None:
    """Words by gap and falling z, tab-separated."""
    gap = F.length("word") - F.length(F.replace("word", F.lit("N"), F.lit("")))
    ordered = words.orderBy(gap, F.desc("z"), "word")
    ordered.select("word", "pos_sites", "neg_sites", "z_corrected", "z").write.mode("overwrite").csv(path, sep="\t")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """block, head, place, line: files of ``>head`` blocks; blank lines are left out.

    The reader splits at each head, so a block is one row and needs no ordering."""
    rows = spark.read.option("lineSep", "\n>").text(path)
    lines = F.filter(F.split(F.regexp_replace("value", r"^>", ""), r"\r?\n"), lambda x: F.trim(x) != "")
    parts = rows.select(F.monotonically_increasing_id().alias("block"), lines.alias("lines")).where(F.size("lines") > 0)
    return parts.select("block", F.col("lines")[0].alias("head"), F.posexplode_outer(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("place", "line"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """cluster, n, place and the columns of each aligned member."""
    head, fields = F.split("head", r"\s+"), F.split(F.trim("line"), r"\s+")
    rows = blocks(spark, path).where(F.col("line").isNotNull()).select(head[0].alias("cluster"), head[1].cast("int").alias("n"), "place", fields.alias("f"))
    return rows.select("cluster", "n", "place", F.col("f")[0].alias("aligned"), F.col("f")[1].alias("word"), F.col("f")[2].cast("int").alias("pos_sites"), F.col("f")[3].cast("int").alias("neg_sites"), F.col("f")[4].cast("double").alias("z_corrected"), F.col("f")[5].cast("double").alias("z"), F.get("f", F.lit(6)).alias("strand"))


def cluster_text(members: DataFrame) -> DataFrame:
    """cluster and ``value``: ``>clusterK<TAB>n`` and a line for each aligned member."""
    line = F.concat_ws("\t", "aligned", "word", "pos_sites", "neg_sites", "z_corrected", "z", "strand")
    rows = members.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("r"))
    return rows.select("cluster", F.concat(F.lit(">cluster"), F.col("cluster"), F.lit("\t"), F.size("r"), F.lit("\n"), F.array_join("r.line", "\n"), F.lit("\n")).alias("value"))


def read_seed_matrices(spark: SparkSession, path: str, pseudo: float = 0.0) -> DataFrame:
    """block (rising in the order of the file), motif, consensus, pos, A, C, G, T, each row raised by ``pseudo`` and normalised."""
    head, numbers = F.split("head", r"\s+"), F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("double") + pseudo)
    rows = blocks(spark, path).where(F.col("line").isNotNull()).select("block", head[0].alias("motif"), F.get(head, F.lit(1)).alias("consensus"), F.col("place").alias("pos"), numbers.alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return rows.where(F.col("pos") < F.length("consensus")).select("block", "motif", "consensus", "pos", *((F.col("v")[k] / total).alias(x) for k, x in enumerate(LETTERS)))


def seed_matrix_text(pfm: DataFrame) -> DataFrame:
    """motif and ``value``: ``>motif<TAB>consensus`` and rows of six decimals (pfm has motif, consensus, pos, A..T)."""
    line = F.format_string("%.6f\t%.6f\t%.6f\t%.6f", *LETTERS)
    rows = pfm.groupBy("motif", "consensus").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("r"))
    return rows.select("motif", F.concat(F.lit(">"), "motif", F.lit("\t"), "consensus", F.lit("\n"), F.array_join("r.line", "\n"), F.lit("\n")).alias("value"))


def read_motif_file(spark: SparkSession, path: str) -> DataFrame:
    """motif, alt, w, nsites, evalue, pos, A, C, G, T of a motif file's probability matrices."""
    rows = spark.read.option("lineSep", "\nMOTIF").text(path).where(F.contains("value", F.lit("letter-probability matrix")))
    name = F.split(F.trim(F.regexp_extract("value", r"^\s*([^\n]*)", 1)), r"\s+")
    head = F.regexp_extract("value", r"letter-probability matrix:([^\n]*)", 1)

    def field(key: str):
        return F.nullif(F.regexp_extract(head, rf"{key}=\s*(\S+)", 1), F.lit(""))

    body = F.regexp_extract("value", r"(?s)letter-probability matrix:[^\n]*\n((?:[ \t]*[0-9.eE+\-]+[^\n]*\n?)+)", 1)
    lines = F.filter(F.split(body, r"\n"), lambda x: F.trim(x) != "")
    motifs = rows.select(name[0].alias("motif"), F.get(name, F.lit(1)).alias("alt"), field("w").cast("int").alias("w"), field("nsites").cast("double").cast("int").alias("nsites"), field("E").cast("double").alias("evalue"), F.posexplode(lines).alias("pos", "line"))
    values = F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("double"))
    return motifs.where((F.col("w").isNull()) | (F.col("pos") < F.col("w"))).select("motif", "alt", "w", "nsites", "evalue", "pos", *(values[k].alias(x) for k, x in enumerate(LETTERS)))


def motif_block_text(pfm: DataFrame) -> DataFrame:
    """motif and ``value``: a block for each motif (motif, alt, nsites, log_evalue, pos, A..T)."""
    line = F.format_string("%.3f %.3f %.3f %.3f", *LETTERS)
    rows = pfm.groupBy("motif", "alt", "nsites", "log_evalue").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("r"))
    head = F.concat(F.lit("MOTIF "), "motif", F.lit(" "), "alt", F.lit("\n\nletter-probability matrix: alength= 4 w= "), F.size("r"), F.lit(" nsites= "), F.col("nsites"), F.lit(" E= "), log_number(F.col("log_evalue")))
    return rows.select("motif", F.concat(head, F.lit("\n"), F.array_join("r.line", "\n"), F.lit("\n")).alias("value"))


#: Fixed value: what stands before the first motif.
MOTIF_FILE_HEADER = "MEME version 4.9.0\n\nALPHABET= ACGT\n\nstrands: + -\n\nBackground letter frequencies (from uniform background):\nA 0.25000 C 0.25000 G 0.25000 T 0.25000\n"


def read_background(spark: SparkSession, path: str) -> DataFrame:
    """tuple and p of a background file; lines of ``#`` are comments."""
    rows = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    fields = F.split(F.trim("value"), r"\s+")
    return rows.select(F.upper(fields[0]).alias("tuple"), fields[1].cast("double").alias("p"))


def missing_tuples(background: DataFrame, order: int) -> DataFrame:
    """Tuples of up to ``order`` + 1 letters that a background lacks."""
    spark = background.sparkSession
    letters = F.array(*map(F.lit, LETTERS))
    words = F.aggregate(F.sequence(F.lit(1), F.lit(order + 1)), F.array(F.lit("")), lambda w, _: F.array_distinct(F.concat(w, F.flatten(F.transform(w, lambda x: F.transform(letters, lambda y: F.concat(x, y)))))))
    wanted = spark.range(1).select(F.explode(words).alias("tuple")).where("tuple != ''")
    return wanted.join(background, "tuple", "left_anti")


def logo_heights(pfm: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, letter, height, rank: heights of a sequence logo, the smallest lowest."""
    terms = [F.when(F.col(x) > 0, F.col(x) * F.log2(x)).otherwise(0.0) for x in LETTERS]
    info = 2 + sum(terms[1:], terms[0])
    stacked = pfm.select(*keys, "pos", F.inline(F.array(*(F.struct(F.lit(x).alias("letter"), (F.col(x) * info).alias("height")) for x in LETTERS))))
    return stacked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "pos").orderBy("height", "letter")))


def read_aligned_sites(spark: SparkSession, path: str, motif: int) -> DataFrame:
    """place, site of motif number ``motif``: its rows up to the line with ``*``."""
    rows = spark.read.text(path, wholetext=True)
    block = F.regexp_extract("value", rf"(?s)Motif {motif}\s*\n(.*?)\n[^\n]*\*", 1)
    lines = F.filter(F.split(block, r"\n"), lambda x: F.trim(x) != "")
    return rows.select(F.posexplode(lines).alias("place", "line")).select("place", F.split(F.trim("line"), r"\s+")[0].alias("site"))


#: Letter frequencies of a large database of sequences, in the order A, C, G, T and of the amino acids' letters.
DATABASE_DNA = {"A": 0.281774, "C": 0.222020, "G": 0.228876, "T": 0.267330}
DATABASE_PROTEIN = {
    "A": 0.073164, "C": 0.018163, "D": 0.051739, "E": 0.062340, "F": 0.040283, "G": 0.069328, "H": 0.022428, "I": 0.056282, "K": 0.058493, "L": 0.091712,
    "M": 0.023067, "N": 0.046077, "P": 0.050674, "Q": 0.040755, "R": 0.051897, "S": 0.073802, "T": 0.059411, "V": 0.064362, "W": 0.013341, "Y": 0.032682,
}


def built_in_background(spark: SparkSession, name: str = "uniform", letters: str = LETTERS) -> DataFrame:
    """letter and p: ``uniform`` over ``letters``, or the ``database`` frequencies of DNA or protein letters."""
    if name == "uniform":
        table = dict.fromkeys(letters, 1 / len(letters))
    else:
        table = DATABASE_DNA if letters == LETTERS else DATABASE_PROTEIN
    return spark.createDataFrame(list(table.items()), "letter string, p double")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """line, place, token: the words of every line."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("tokens"))
    return rows.select("line", F.posexplode("tokens").alias("place", "token"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """row and values (array of double) of a file of numbers; blank lines and lines of ``#`` are left out; other text is an error."""
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double")).alias("values"))


def read_log_odds(spark: SparkSession, path: str) -> DataFrame:
    """motif, w, pos, A, C, G, T of a log-odds file: blocks of a heading with ``w=`` and rows of four scores."""
    rows = spark.read.option("lineSep", "log-odds matrix:").text(path).where(F.contains("value", F.lit("w=")))
    lines = F.filter(F.split("value", r"\n"), lambda x: F.trim(x) != "")
    head = F.get(lines, F.lit(0))
    parts = rows.select(F.monotonically_increasing_id().alias("motif"), F.regexp_extract(head, r"w=\s*(\d+)", 1).cast("int").alias("w"), F.posexplode(F.slice(lines, 2, 1 << 20)).alias("pos", "line"))
    values = F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("double"))
    return parts.where(F.col("pos") < F.col("w")).select("motif", "w", "pos", *(values[k].alias(x) for k, x in enumerate(LETTERS)))


def checked_background(background: DataFrame) -> DataFrame:
    """tuple and p; an error where p is not in (0, 1]."""
    legal = F.when((F.col("p") > 0) & (F.col("p") <= 1), F.col("p")).otherwise(F.raise_error(F.concat(F.lit("no probability: "), F.col("tuple"))).cast("double"))
    return background.withColumn("p", legal)


def write_motif_file(pfm: DataFrame, path: str, background: dict[str, float] | None = None) -> None:
    """One text file: the header and a block for each motif (a motif is a few lines, so one task writes them)."""
    given = "uniform background" if background is None else "given background"
    q = background or dict.fromkeys(LETTERS, 0.25)
    head = MOTIF_FILE_HEADER.split("Background")[0] + f"Background letter frequencies (from {given}):\n" + " ".join(f"{x} {q[x]:.5f}" for x in LETTERS) + "\n"
    blocks = motif_block_text(pfm).select(F.lit(1).alias("part"), "motif", "value")
    top = pfm.sparkSession.createDataFrame([(0, "", head)], "part int, motif string, value string")
    top.unionByName(blocks).coalesce(1).sortWithinPartitions("part", F.length("motif"), "motif").select("value").write.mode("overwrite").text(path)


def indexed_clusters(words: DataFrame, clusters: DataFrame) -> DataFrame:
    """Words (with ``id``) by clusters that name them by id (cluster, place, id)."""
    return clusters.select("cluster", "place", "id").join(words, "id")

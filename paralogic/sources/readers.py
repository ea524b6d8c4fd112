"""Scans. Every one is a Spark reader, so a path can be a folder, a glob or any store Spark reaches.

Formats whose records span lines are read a file at a time where a record cannot
be found by a separator; files of those formats are split by the writer, not here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEPARATOR = "#{80}"


def csv(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """CSV with a header and quotes doubled inside quotes. Without line feeds inside cells, ``multi_line``
    can be off, so that a large file is split."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, item): trimmed lines that are not blank, with their place among those of the file, from 0.

    Files are split as Spark likes; a split's lines are counted, and the counts of the splits before are added."""
    rows = spark.read.text(path).select(F.trim(F.regexp_replace("value", "[\r\t]", " ")).alias("item"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("k")).filter("item <> ''")
    counts = rows.groupBy("file", "start").agg(F.count("*").alias("n"))
    before = counts.select("file", "start", (F.sum("n").over(Window.partitionBy("file").orderBy("start")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "start").orderBy("k")) - 1
    return rows.withColumn("inside", inside).join(before, ["file", "start"]).select("file", (F.col("before") + F.col("inside")).alias("at"), "item")


def ragged_csv(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """CSV without a header: c0, c1, ...; cells that a line lacks are null."""
    return spark.read.schema(", ".join(f"c{i} string" for i in range(columns))).option("mode", "PERMISSIVE").option("escape", '"').csv(path)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def jsonl_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All .jsonl of a folder; ``system`` is the column model, or the file's stem where that is null or empty."""
    rows = spark.read.schema(schema).option("pathGlobFilter", "*.jsonl").json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"(.*)\.jsonl$", 1)
    model = F.nullif(F.col("model"), F.lit("")) if "model" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("system", F.coalesce(model, stem))


def sentences(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of a .json (list, or object with ``sentences``), .jsonl (``text`` or ``sentence``) or
    .txt file (a sentence a line); ids that are absent are the place in the file, from 0."""
    if path.endswith(".json"):
        items = F.coalesce(F.from_json(F.get_json_object("value", "$.sentences"), "array<string>"), F.from_json("value", "array<string>"))
        rows = spark.read.text(path, wholetext=True).select(F.posexplode(items).alias("at", "item"))
    else:
        rows = numbered_lines(spark, path).select("at", "item")
    if path.endswith(".txt"):
        return rows.select(F.col("at").cast("string").alias("id"), F.col("item").alias("text"))
    field = lambda name: F.get_json_object("item", f"$.{name}")
    text = F.when(F.startswith("item", F.lit("{")), F.coalesce(F.nullif(field("text"), F.lit("")), field("sentence"), F.lit(""))).otherwise(F.col("item"))
    return rows.select(F.coalesce(F.when(F.startswith("item", F.lit("{")), field("id")), F.col("at").cast("string")).alias("id"), text.alias("text"))


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of a file that is one JSON list."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_files(spark: SparkSession, path: str, schema: str, pattern: str = "*txt") -> DataFrame:
    """One JSON object a file, with the file as ``race_id``."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", pattern).json(path)
    return rows.withColumn("race_id", F.col("_metadata.file_path"))


def exploded(rows: DataFrame, items: str) -> DataFrame:
    """One row for each element of a list of structs, beside the other columns."""
    return rows.select(*(c for c in rows.columns if c != items), F.posexplode(items).alias("pos", "_item")).select("*", "_item.*").drop("_item")


def eight_lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, label, context, question, answers) of records of eight lines: blank, letter, context, question and
    four answers, whose ``A.`` is cut off; letters a to d are 0 to 3, others 0; an incomplete last record goes."""
    lines = F.split(F.regexp_replace("value", "\r\n", "\n"), "\n")
    cuts = F.sequence(F.lit(0), F.floor(F.size("lines") / 8).cast("int") - 1)
    records = F.when(F.size("lines") >= 8, F.transform(cuts, lambda i: F.slice("lines", i * 8 + 1, 8)))
    rows = spark.read.text(path, wholetext=True).select(lines.alias("lines")).select(F.posexplode(records).alias("at", "r"))
    line = lambda i: F.trim(F.get("r", F.lit(i)))
    label = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in zip("abcd", range(4)) for x in p)), F.lower(line(1))), F.lit(0))
    return rows.select("at", label.alias("label"), line(2).alias("context"), line(3).alias("question"), F.array(*(F.regexp_replace(line(i), r"^[A-Da-d]\.\s*", "") for i in range(4, 8))).alias("answers"))


def graph_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(entry): entries between blank lines, without comments but for ``# ::`` lines; gzip is read too."""
    lines = F.filter(F.split("value", "\n"), lambda x: ~x.startswith("#") | x.startswith("# ::"))
    entry = F.trim(F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", ""))
    return spark.read.option("lineSep", "\n\n").text(path).select(entry.alias("entry")).filter("entry <> ''")


def sentence_and_graph(entries: DataFrame) -> DataFrame:
    """(sentence, graph): the last ``# ::snt`` and the other lines on one line; entries that lack one go."""
    lines = F.split("entry", "\n")
    sentence = F.element_at(F.filter(lines, lambda x: x.startswith("# ::snt")), -1)
    body = F.array_join(F.transform(F.filter(lines, lambda x: ~x.startswith("#")), lambda x: F.trim(x)), " ")
    size = F.size(F.filter(lines, lambda x: x.startswith("# ::snt")))
    rows = entries.select(F.when(size > 0, F.trim(F.substring(sentence, 8, 1_000_000_000))).alias("sentence"), F.regexp_replace(body, " +", " ").alias("graph"))
    return rows.filter("sentence <> '' and graph <> ''")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, block): pieces between lines of 80 ``#`` in .umr and .txt files of all folders below; empty ones go."""
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{umr,txt}").text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("file"), F.explode(F.split("value", SEPARATOR)).alias("block")).select("file", F.regexp_replace("block", r"^\s+|\s+$", "").alias("block")).filter("block <> ''")


def alignment(line: Column) -> Column:
    """struct(variable, first, last) of ``x0: 1-2``; null for other lines."""
    pattern = r"^\s*([^:\s]+)\s*:\s*(\d+)-(\d+)\s*$"
    part = lambda i: F.regexp_extract(line, pattern, i)
    return F.when(line.rlike(pattern), F.struct(part(1).alias("variable"), part(2).cast("int").alias("first"), part(3).cast("int").alias("last")))


def paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(text, labels): runs of lines with a letter. The first line is the text, the others are labels from their
    first space on. Paragraphs go whose text has over 30 words, no ASCII character or over 30 signs, and those without labels."""
    runs = F.split(F.regexp_replace("value", "\r\n", "\n"), r"(?:^|\n)(?:[^A-Za-z\n]*(?:\n|$))+")
    rows = spark.read.text(path, wholetext=True).select(F.explode(runs).alias("run")).select(F.filter(F.split("run", "\n"), lambda x: x.rlike("[A-Za-z]")).alias("lines")).filter("size(lines) > 1")
    labels = F.transform(F.slice("lines", 2, 1_000_000), lambda x: F.trim(F.regexp_replace(x, r"^\S*\s", "")))
    text = F.get("lines", F.lit(0))
    return rows.select(F.trim(text).alias("text"), labels.alias("labels")).filter((F.size(F.split("text", r"\s+")) <= 30) & F.col("text").rlike(r"[\x00-\x7F]") & (F.length(F.regexp_replace("text", r"[A-Za-z0-9\s]", "")) <= 30))


#: Characters of a one-byte code page that stand in UTF-8 files, and what they mean.
REPAIRS = {
    "\x82": ",", "\x84": ",,", "\x85": "...", "\x88": "^", "\x91": "'", "\x92": "'", "\x93": '"', "\x94": '"', "\x95": " ", "\x96": "-", "\x97": "--", "\x99": " ",
    "\xa0": " ", "\xa6": "|", "\xab": "<<", "\xbb": ">>", "\xbc": "1/4", "\xbd": "1/2", "\xbe": "3/4", "\u02bf": "'", "\u0328": "", "\u0331": "",
}


def repaired(text: Column) -> Column:
    """ASCII text: known wrong characters by ``REPAIRS``, letters without their marks, anything else dropped."""
    marked = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
    plain = "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyy"
    for wrong, right in REPAIRS.items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return F.regexp_replace(F.translate(text, marked, plain), "[^\\x00-\\x7F]", "")


def raw_graph_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(entry): as ``graph_corpus``, of files with characters of another code page."""
    return graph_corpus(spark, path).select(repaired(F.col("entry")).alias("entry"))


def collated(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source, entry): graph corpora in the order given, told apart by their place; an empty one is an error."""
    parts = [graph_corpus(spark, p).select(F.lit(k).alias("source"), "entry") for k, p in enumerate(paths)]
    for path, part in zip(paths, parts):
        if part.isEmpty():
            raise ValueError(f"no entries in {path}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def metadata(entries: DataFrame) -> DataFrame:
    """(meta, graph): ``# ::name value`` lines as a map (the last one of a name counts), and the other lines."""
    lines = F.split("entry", "\n")
    pairs = F.transform(F.filter(lines, lambda x: x.startswith("# ::")), lambda x: F.struct(F.regexp_extract(x, r"^# ::(\S+)", 1).alias("key"), F.trim(F.regexp_replace(x, r"^# ::\S+", "")).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, 1_000), lambda q: q["key"] == p["key"]))
    return entries.select(F.map_from_entries(last).alias("meta"), F.array_join(F.filter(lines, lambda x: ~x.startswith("#")), "\n").alias("graph"))


def gold_alignments(entries: DataFrame, expected: int | None = None) -> DataFrame:
    """(id, alignments) of entries with ``# ::id`` and ``# ::alignments``; another number than ``expected`` is an error."""
    m = metadata(entries)
    rows = m.select(F.split(F.element_at("meta", "id"), " ")[0].alias("id"), F.filter(F.split(F.coalesce(F.element_at("meta", "alignments"), F.lit("")), " "), lambda x: x != "").alias("alignments")).filter("id is not null")
    if expected is not None and rows.count() != expected:
        raise ValueError(f"expected {expected} entries")
    return rows


def chosen(rows: DataFrame, ids: list[str] | None = None, rules: list[str] | None = None, limit: int | None = None, id_col: str = "id", rule_col: str = "rule") -> DataFrame:
    """Rows of an entry point's options: ids, rules, and the first ``limit`` by id."""
    rows = rows.filter(F.col(id_col).isin(ids)) if ids else rows
    rows = rows.filter(F.col(rule_col).isin(rules)) if rules else rows
    return rows.orderBy(id_col).limit(limit) if limit is not None else rows

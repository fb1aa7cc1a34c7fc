"""Read files, library lists and seeds: FASTA, FASTQ and plain lines, as DataFrames; and the text sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.params import MAX_LIBRARIES, MAX_SEEDS, READ_LENGTHS

_LINES = {"fastq": 4, "fasta": 2, "plain": 1}


def sniff(first: str) -> str:
    """The format that a file's first character shows."""
    return "fasta" if first.startswith(">") else "fastq" if first.startswith("@") else "plain"


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) with numbers that count lines of each file.

    A text scan deals a file's lines over tasks; lines get an id within their
    partition first, and the sizes of the partitions before (one row per
    partition) make it a line number.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("line"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("id"))
    from pyspark.sql import Window

    from helixframe.storage import materialize

    lines = materialize(lines, "lines")
    per = lines.groupBy("path", "p").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per.withColumn("before", before).select("path", "p", "first", "before")
    return lines.join(offsets, ["path", "p"]).select("path", (F.col("id") - F.col("first") + F.col("before")).alias("line_no"), "line")


def read_records(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """(path, record, name, seq, qual) of the records of read files; the format of each file is sniffed from its first line unless given."""
    lines = _numbered(spark, path)
    if form is None:
        kind = F.when(F.startswith("line", F.lit(">")), "fasta").when(F.startswith("line", F.lit("@")), "fastq").otherwise("plain")
        lines = lines.join(lines.where("line_no = 0").select("path", kind.alias("form")), "path")
    else:
        lines = lines.withColumn("form", F.lit(form))
    lines = lines.withColumn("n", F.element_at(F.create_map(*(F.lit(x) for kv in _LINES.items() for x in kv)), F.col("form")))
    at = lambda i: F.max(F.when(F.expr("line_no % n") == i, F.col("line")))
    rows = lines.groupBy("path", "form", F.expr("line_no div n").alias("record")).agg(*(at(i).alias(f"l{i}") for i in (0, 1, 3)))
    named = F.when(F.col("form") != "plain", F.expr("substring(l0, 2)"))
    return rows.select("path", "record", named.alias("name"), F.when(F.col("form") == "plain", F.col("l0")).otherwise(F.col("l1")).alias("seq"), F.when(F.col("form") == "fastq", F.col("l3")).alias("qual"))


def read_length(records: DataFrame) -> int:
    """The longest of the first 1000 sequences; outside the allowed lengths it is an error."""
    longest = records.limit(1000).agg(F.max(F.length("seq"))).first()[0] or 0
    if not READ_LENGTHS[0] <= longest <= READ_LENGTHS[1]:
        raise ValueError(f"reads of {longest} bases; {READ_LENGTHS[0]} to {READ_LENGTHS[1]} are possible")
    return longest


def interleaved_pairs(records: DataFrame) -> DataFrame:
    """(path, pair_no, r1, q1, r2, q2) of interleaved records."""
    pair, mate = F.expr("record div 2"), F.col("record") % 2
    pick = lambda c, m: F.max(F.when(mate == m, F.col(c)))
    return records.groupBy("path", pair.alias("pair_no")).agg(pick("seq", 0).alias("r1"), pick("qual", 0).alias("q1"), pick("seq", 1).alias("r2"), pick("qual", 1).alias("q2"))


def parse_libraries(text: str) -> list[tuple[str, list[str]]]:
    """(kind, paths) of a library list: `paired A B`, `paired A` (interleaved) or `single A` per line; blank lines and those with # are left out."""
    found = []
    for line in text.splitlines():
        parts = line.strip("\r").split(" ")
        if not line.strip() or line.startswith("#"):
            continue
        if parts[0] not in ("paired", "single") or not 2 <= len(parts) <= (3 if parts[0] == "paired" else 2) or not all(parts):
            raise ValueError(f"not a library: {line!r}")
        found.append((parts[0], parts[1:]))
    paired = sum(kind == "paired" for kind, _ in found)
    if not 1 <= paired <= MAX_LIBRARIES:
        raise ValueError(f"{paired} paired libraries; 1 to {MAX_LIBRARIES} are possible")
    return sorted(found, key=lambda x: x[0] != "paired")


def parse_seeds(text: str) -> list[tuple[str, str]]:
    """(header, sequence) of seeds as FASTA or one a line, up to the first blank line; unnamed ones are Input_sequence_n."""
    found: list[tuple[str, str]] = []
    header = None
    for line in text.splitlines():
        line = line.strip("\r")
        if not line:
            break
        if line.startswith(">"):
            header = line[1:]
            continue
        if set(line.upper()) - set("ACGT"):
            raise ValueError(f"not a sequence: {line[:40]!r}")
        if header is not None and found and found[-1][0] == header:
            found[-1] = (header, found[-1][1] + line.upper())
        else:
            found.append((header or f"Input_sequence_{len(found) + 1}", line.upper()))
    if not 1 <= len(found) <= MAX_SEEDS:
        raise ValueError(f"{len(found)} seeds; 1 to {MAX_SEEDS} are possible")
    return found


def write_fasta(rows: DataFrame, path: str) -> None:
    """Records (header, seq) as FASTA; an existing path is an error."""
    rows.select(F.concat_ws("\n", F.concat(F.lit(">"), "header"), "seq").alias("value")).write.mode("errorifexists").text(path)


def write_fastq(rows: DataFrame, path: str) -> None:
    rows.select(F.concat_ws("\n", F.concat(F.lit("@"), "name"), "seq", F.lit("+"), "qual").alias("value")).write.mode("errorifexists").text(path)


def locus_records(loci: DataFrame) -> DataFrame:
    """Three FASTA records per locus (header, origin, left, right): the origin and its extensions."""
    three = F.array(*(F.struct(F.concat(F.col("header"), F.lit(suffix)).alias("header"), F.col(c).alias("seq")) for suffix, c in (("", "origin"), ("_left_extension", "left"), ("_right_extension", "right"))))
    return loci.select(F.explode(three).alias("r")).select("r.*")


_NODE = "node_id long, drxn int, seq string, cloned string, stop_l int, stop_r int, ends string, tags string"


def _parse_dump(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for block in batch["value"].to_pylist():
            fields = dict(line.split("=", 1) for line in block.splitlines() if "=" in line)
            if "NODE" in fields:
                left, _, right = fields.get("STOP", "0_0").partition("_")
                rows.append((int(fields["NODE"]), int(fields.get("DRXN", 2)), fields.get("SEQ", ""), fields.get("CLONED", ""), int(left or 0), int(right or 0), fields.get("ENDS", ""), fields.get("TAGS", "")))
        types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[f.split()[0] for f in _NODE.split(", ")])


def read_graph_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (src, dst, drxn, ol, leap) of a graph dump in text."""
    blocks = spark.read.option("lineSep", "NODE=").text(path).where("value rlike '^[0-9]'").select(F.concat(F.lit("NODE="), "value").alias("value"))
    nodes = blocks.mapInArrow(_parse_dump, _NODE)
    line = spark.read.text(path).where("value like 'EDGES=%'").select(F.explode(F.split(F.expr("substring(value, 7)"), ",")).alias("e")).where("e <> ''")
    f = F.split("e", "_")
    edges = line.select(F.get(f, F.lit(0)).cast("long").alias("src"), F.get(f, F.lit(1)).cast("long").alias("dst"), F.get(f, F.lit(2)).cast("int").alias("drxn"), F.get(f, F.lit(3)).cast("int").alias("ol"), (F.get(f, F.lit(4)) == "1").alias("leap"))
    return nodes, edges


def write_graph_dump(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes as blocks of lines and all edges as a last line of their own file."""
    block = F.concat_ws("\n", *(F.concat(F.lit(f"{k}="), F.col(c).cast("string")) for k, c in (("NODE", "node_id"), ("DRXN", "drxn"), ("SEQ", "seq"), ("CLONED", "cloned"))), F.format_string("STOP=%d_%d", "stop_l", "stop_r"), F.concat(F.lit("ENDS="), "ends"), F.concat(F.lit("TAGS="), "tags"))
    nodes.select(block.alias("value")).write.mode("errorifexists").text(path)
    edge = F.concat_ws("_", "src", "dst", "drxn", "ol", F.col("leap").cast("int"))
    edges.select(F.concat(F.lit("EDGES="), edge).alias("value")).write.mode("append").text(path)

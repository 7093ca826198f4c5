"""FASTA source and sink.

``read_fasta`` never builds a whole-contig row.  Lines are read with their
file position (partition id + index inside the partition, which follow file
order) and joined, in tasks, to pieces that end at chunk boundaries; a piece
knows its header and its offset from it.  The text that a partition holds
before its first header belongs to an earlier partition's contig: header and
offset come from a table with one row per file and partition.  Pieces are
grouped into fixed-size chunks ``(genome, contig, chunk_id, seq)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chromatide.operators.sequences import CHUNK, CONTIG_NAME

_PIECE = "_file string, _pid int, _inst long, _off long, _len long, _line string"


def _characters(text: bytes) -> int:
    return len(text) if text.isascii() else int(((np.frombuffer(text, np.uint8) & 0xC0) != 0x80).sum())


def _walk(batches: Iterator[pa.RecordBatch], prefix: str, chunk: int, pieces: bool) -> Iterator[pa.RecordBatch]:
    """Lines in file order, as pieces or as marks.

    Pieces: joined lines, with their header's place and their offset from it;
    those before a partition's first header have neither, but the file, and an
    offset from the partition's start.  Marks: every header line with its place
    (``_len`` null), and for each file of the partition the last header, the
    length after it and the length before the first one.
    """
    schema = pa.schema([("_file", pa.string()), ("_pid", pa.int32()), ("_inst", pa.int64()), ("_off", pa.int64()), ("_len", pa.int64()), ("_line", pa.string())])
    file, pid, inst, off, lead = None, 0, None, 0, 0
    out: list[tuple] = []

    def ended() -> list[tuple]:
        return [(file, pid, inst, off, off if inst is None else lead, None)] if file is not None and not pieces else []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * len(schema), schema)], schema=schema)

    for b in batches:
        lines, files = b.column("_line").cast(pa.large_binary()), b.column("_file")
        ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset:lines.offset + len(lines) + 1]
        data = memoryview(lines.buffers()[2]) if lines.buffers()[2] is not None else memoryview(b"")
        heads = np.asarray(pc.starts_with(lines, pattern=prefix.encode()).fill_null(False).to_numpy(zero_copy_only=False), bool)
        codes = files.dictionary_encode()
        codes, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
        turns = np.flatnonzero(np.diff(codes)) + 1
        at = np.flatnonzero(heads)
        cuts = np.unique(np.concatenate([[0], turns, at, at + 1, [len(lines)]]))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if names[codes[lo]] != file:
                out += ended()
                file, pid, inst, off, lead = names[codes[lo]], b.column("_pid")[lo].as_py(), None, 0, 0
            text = bytes(data[ends[lo]:ends[hi]])
            if heads[lo]:
                if inst is None:
                    lead = off
                inst, off = b.column("_mid")[lo].as_py(), 0
                if not pieces:
                    out.append((file, pid, inst, 0, None, text))
                continue
            if not pieces:
                off += _characters(text)
                continue
            if text.isascii():
                start = 0
                while start < len(text):
                    piece = text[start:start + chunk - off % chunk]
                    out.append((None if inst is not None else file, pid, inst, off, len(piece), piece))
                    start, off = start + len(piece), off + len(piece)
            else:   # by lines: characters and bytes differ
                for i in range(lo, hi):
                    line = bytes(data[ends[i]:ends[i + 1]])
                    n = _characters(line)
                    if n:
                        out.append((None if inst is not None else file, pid, inst, off, n, line))
                    off += n
        if out:
            yield batch()
            out = []
    out += ended()
    if out:
        yield batch()


def read_fasta(spark: SparkSession, paths, chunk: int = CHUNK, header_prefix: str = ">chr",
               name_pattern: str | None = CONTIG_NAME) -> DataFrame:
    """FASTA files -> ``(genome, contig, chunk_id, seq)``.

    Headers are lines matching ``>chr.*``; the name is the header without
    '>'; only names matching ``^chr[A-Za-z0-9]*$`` are kept; a repeated name
    keeps its last occurrence; the genome key is the file base name up to its
    first dot.  Bases are kept as written (no upper-casing).
    """
    raw = (spark.read.text(paths)
           .select(F.input_file_name().alias("_file"), F.col("value").alias("_line"),
                   F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid")))
    marks = raw.mapInArrow(lambda b: _walk(b, header_prefix, chunk, False), _PIECE)
    heads = (marks.where("_len IS NULL").select("_file", "_inst", F.replace(F.col("_line"), F.lit(">"), F.lit("")).alias("contig"))
             .where(F.col("contig").rlike(name_pattern) if name_pattern else F.lit(True))
             .withColumn("genome", F.regexp_extract(F.col("_file"), r"([^/]*?)(\.[^/]*)?$", 1)))
    latest = heads.groupBy("genome", "contig").agg(F.max(F.struct("_file", "_inst")).alias("_k")) \
        .select("genome", "contig", F.col("_k._inst").alias("_inst"))
    # What a partition's first text belongs to: the last header before it, and the length since then.
    order = Window.partitionBy("_file").orderBy("_pid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = marks.where("_len IS NOT NULL").withColumn("_sum", F.sum(F.when(F.col("_inst").isNull(), F.col("_len")).otherwise(0)).over(order))
    last = F.max(F.when(F.col("_inst").isNotNull(), F.struct("_inst", (F.col("_off") - F.col("_sum")).alias("_rest")))).over(before)
    carry = (ends.withColumn("_last", last).withColumn("_prior", F.lag("_sum").over(order)).where("_last IS NOT NULL")
             .select("_file", "_pid", F.col("_last._inst").alias("_hcar"), (F.col("_last._rest") + F.col("_prior")).alias("_ocar")))
    lines = (raw.mapInArrow(lambda b: _walk(b, header_prefix, chunk, True), _PIECE)
             .join(F.broadcast(carry), ["_file", "_pid"], "left")   # one row for each file and partition
             .select(F.coalesce("_inst", "_hcar").alias("_inst"), (F.col("_off") + F.coalesce("_ocar", F.lit(0))).alias("_off"), "_len", "_line")
             .where("_inst IS NOT NULL"))
    lines = lines.join(latest, "_inst")
    cid = F.explode(F.sequence(F.floor(F.col("_off") / chunk).cast("int"),
                               F.floor((F.col("_off") + F.col("_len") - 1) / chunk).cast("int")))
    lo = F.greatest(F.col("chunk_id").cast("bigint") * chunk - F.col("_off"), F.lit(0))
    hi = F.least((F.col("chunk_id").cast("bigint") + 1) * chunk - F.col("_off"), F.length("_line"))
    pieces = lines.select("genome", "contig", "_off", "_line", cid.alias("chunk_id")) \
        .withColumn("_lo", lo).withColumn("_n", hi - lo) \
        .select("genome", "contig", "chunk_id", "_off",
                F.expr("substr(_line, CAST(_lo AS INT) + 1, CAST(_n AS INT))").alias("p"))
    return (pieces.groupBy("genome", "contig", "chunk_id")
            .agg(F.sort_array(F.collect_list(F.struct("_off", "p"))).alias("_ps"))
            .select("genome", "contig", "chunk_id", F.array_join(F.transform("_ps", lambda s: s["p"]), "").alias("seq")))


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq", width: int | None = None,
                mode: str = "overwrite") -> None:
    """One record per row, ``>name`` then the bases (wrapped at ``width`` if given)."""
    body = F.col(seq)
    if width:
        body = F.regexp_replace(body, "(.{%d})(?!$)" % width, "$1\n")
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), body).alias("value")).write.mode(mode).text(path)

"""Genome sequence: contig filters, chunked genome, region fetch, windows, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromatide.functions.letters import letter_number_lists, letter_numbers

CONTIG_NAME = r"^chr[A-Za-z0-9]*$"


def filter_contigs(df: DataFrame, col: str = "contig") -> DataFrame:
    """keep contigs named ``^chr[A-Za-z0-9]*$``."""
    return df.where(F.col(col).rlike(CONTIG_NAME))

CHUNK = 65_536
#: Genome key of a chunk table that was built without one.
ONE_GENOME = "genome"

# Character tokenizer ids.  Specials 0..6, then the bases from 7.
SPECIAL_TOKENS = ["[CLS]", "[SEP]", "[BOS]", "[MASK]", "[PAD]", "[RESERVED]", "[UNK]"]
BASE_CHARS = ["A", "C", "G", "T", "N"]
CLS_ID, SEP_ID, PAD_ID, UNK_ID, N_ID = 0, 1, 4, 6, 11
ID_TO_TOKEN = SPECIAL_TOKENS + BASE_CHARS


def chunk_contigs(contigs: DataFrame, size: int = CHUNK, genome: str | None = None,
                  contig: str = "contig", seq: str = "seq") -> DataFrame:
    """Genome table ``(genome, contig, chunk_id, seq)`` from whole-contig rows.

    For inputs that already hold one row per contig (small genomes, fixtures).
    Large genomes come from :func:`chromatide.sources.genome.read_fasta`, which
    builds the same table from lines without a whole-contig row.
    """
    g = F.col(genome) if genome else F.lit(ONE_GENOME)
    whole = contigs.select(g.alias("genome"), F.col(contig).alias("contig"), F.col(seq).alias("_s"))
    # bytes are found by place, characters by counting from the first one
    pieces = F.expr(f"""CASE WHEN length(_s) = 0 THEN NULL WHEN length(_s) = octet_length(_s)
        THEN transform(sequence(0, (length(_s) - 1) DIV {size}), i -> CAST(substr(CAST(_s AS BINARY), CAST(i * {size} + 1 AS INT), {size}) AS STRING))
        ELSE transform(sequence(0, (length(_s) - 1) DIV {size}), i -> substr(_s, CAST(i * {size} + 1 AS INT), {size})) END""")
    return whole.select("genome", "contig", F.posexplode(pieces).alias("chunk_id", "seq"))


def contig_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("genome", "contig").agg(F.sum(F.length("seq")).cast("bigint").alias("contig_len"))


def _genome_of(regions: DataFrame, genome: str | Column | None) -> Column:
    """The genome of each region: the given column or value, else its column ``genome``, else :data:`ONE_GENOME`."""
    if genome is None:
        return F.col("genome") if "genome" in regions.columns else F.lit(ONE_GENOME)
    return F.col(genome) if isinstance(genome, str) else genome


def fetch(regions: DataFrame, chunks: DataFrame, id_col: str, start: str = "fetch_start",
          end: str = "fetch_end", contig: str = "contig", size: int = CHUNK,
          genome: str | Column | None = None) -> DataFrame:
    """Bases of ``[start, end)`` (0-based, clipped to the contig) per region.

    A region touches 1-2 chunks: explode its chunk ids, equi-join on
    (genome, contig, chunk_id), cut each piece and concatenate in chunk order.
    Regions outside the contig get the empty string.  ``id_col`` is unique over
    all genomes.  Chunks from ``read_fasta`` carry the file's stem as genome, so
    their regions need a column ``genome`` or the argument (``F.lit(stem)``).
    """
    r = regions.select(F.col(id_col).alias("_id"), _genome_of(regions, genome).alias("genome"), F.col(contig).alias("contig"),
                       F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e"))
    rx = r.withColumn("chunk_id", F.explode(F.when(
        F.col("_e") > F.col("_s"),
        F.sequence(F.floor(F.col("_s") / size).cast("int"), F.floor((F.col("_e") - 1) / size).cast("int")))
        .otherwise(F.array(F.lit(-1)))))
    j = rx.join(chunks, ["genome", "contig", "chunk_id"], "left")
    piece = F.when(F.col("seq").isNull(), F.lit("")).otherwise(
        F.expr("substr(seq, greatest(_s - chunk_id * %d, 0) + 1, least(_e - chunk_id * %d, %d) - greatest(_s - chunk_id * %d, 0))"
               % (size, size, size, size)))
    parts = j.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("chunk_id", piece.alias("p")))).alias("_p"))
    return parts.select(F.col("_id").alias(id_col), F.array_join(F.transform("_p", lambda x: x["p"]), "").alias("bases"))


def window_fixed(regions: DataFrame, chunks: DataFrame, length: int, id_col: str = "region_id",
                 start: str = "start_pos", end: str = "end_pos", size: int = CHUNK,
                 genome: str | Column | None = None) -> DataFrame:
    """Q01: first ``length`` bases of the region, right-padded with N; ``truncated`` if the contig ended.

    ``genome`` as in :func:`fetch`.
    """
    want = F.least(F.col(end) - F.col(start), F.lit(length))
    r = regions.select(id_col, _genome_of(regions, genome).alias("genome"), "contig", F.col(start).alias("fetch_start"),
                       (F.col(start) + F.greatest(want, F.lit(0))).alias("fetch_end"), want.alias("_want"))
    got = fetch(r, chunks, id_col, size=size)
    out = r.join(got, id_col)
    return out.select(id_col, F.rpad("bases", length, "N").alias("window"),
                      (F.length("bases") < F.col("_want")).alias("truncated"))


def window_random(regions: DataFrame, chunks: DataFrame, length, seed: int, id_col: str = "region_id",
                  start: str = "start_pos", end: str = "end_pos", size: int = CHUNK,
                  genome: str | Column | None = None) -> DataFrame:
    """Q02/Q03: training window with a seeded shift; N padding at both contig ends.

    Short region: shift in [-(L - len), 0]; left pad where the shifted start is
    below 0, right pad past the contig end.  Long region: offset in
    [0, len - L].  A window wholly outside the contig is all N
    (``out_of_range``).  ``length`` may be a column (Q20); ``genome`` as in
    :func:`fetch`.
    """
    from chromatide.functions.seeded import seeded_hash

    L = F.col("_L")
    r = regions.withColumn("genome", _genome_of(regions, genome)) \
        .withColumn("_L", length if not isinstance(length, int) else F.lit(length)) \
        .join(contig_lengths(chunks), ["genome", "contig"], "left").withColumn("contig_len", F.coalesce("contig_len", F.lit(0)))
    ilen = F.col(end) - F.col(start)
    h = seeded_hash(seed, id_col)
    short = ilen < L
    shift = F.when(short, -(h % (L - ilen + 1))).otherwise(h % (ilen - L + 1))
    r = r.withColumn("_s0", F.col(start) + shift)
    lpad = F.when(short & (F.col("_s0") < 0), -F.col("_s0")).otherwise(0)
    r = r.withColumn("_lpad", lpad)
    r = r.withColumn("_s1", F.when(short, F.greatest(F.col("_s0"), F.lit(0))).otherwise(F.col("_s0")))
    r = r.withColumn("_e1", F.col("_s1") + L - F.col("_lpad"))
    oor = (F.col("_s1") >= F.col("contig_len")) | (F.col("_e1") <= 0)
    r = r.withColumn("out_of_range", oor)
    r = r.withColumn("fetch_start", F.when(oor, 0).otherwise(F.col("_s1"))) \
         .withColumn("fetch_end", F.when(oor, 0).otherwise(F.least(F.col("_e1"), F.col("contig_len"))))
    got = fetch(r, chunks, id_col, size=size)
    out = r.join(got, id_col)
    w = F.expr("rpad(concat(CASE WHEN out_of_range THEN '' ELSE repeat('N', CAST(_lpad AS INT)) END, bases), _L, 'N')")
    return out.select(id_col, w.alias("window"), "out_of_range")


def window_variable(regions: DataFrame, chunks: DataFrame, lo: int, hi: int, seed: int,
                    id_col: str = "region_id", size: int = CHUNK, genome: str | Column | None = None) -> DataFrame:
    """Q20: window length drawn per row in [lo, hi], then the Q02 window."""
    from chromatide.functions.seeded import seeded_hash
    L = (F.lit(lo) + seeded_hash(f"{seed}:len", id_col) % (hi - lo + 1)).cast("int")
    return window_random(regions, chunks, L, seed, id_col, size=size, genome=genome)


def revcomp(c) -> "F.Column":
    """Q04: reverse complement; case kept, other symbols unchanged."""
    col = F.col(c) if isinstance(c, str) else c
    return F.translate(F.reverse(col), "ACGTacgt", "TGCAtgca")


def rc_augment(df: DataFrame, col: str, seed: int, key: str) -> DataFrame:
    """Q05: reverse-complement a seeded half of the rows."""
    from chromatide.functions.seeded import seeded_hash
    flip = seeded_hash(seed, key) % 2 == 1
    return df.withColumn("flipped", flip).withColumn(col, F.when(flip, revcomp(col)).otherwise(F.col(col)))


_BASE_IDS = {ch: i + 7 for i, ch in enumerate(BASE_CHARS)}


def char_ids(c, upper: bool = False, short: bool = False):
    """Q06: characters to ids (A7 C8 G9 T10 N11, anything else 6); ``short``: of one byte each."""
    col = F.col(c) if isinstance(c, str) else c
    return letter_numbers(F.upper(col) if upper else col, _BASE_IDS, UNK_ID, short)


def char_id_lists(c, eos: bool = True, then=None):
    """Q06 and Q07 for every text of an array: CLS, character ids, and SEP with ``eos``; ``then`` as in :func:`letter_number_lists`."""
    return letter_number_lists(c, _BASE_IDS, UNK_ID, [CLS_ID], [SEP_ID] if eos else [], then)


def add_specials(arr, eos: bool = True):
    """Q07: prepend CLS=0, optionally append SEP=1."""
    a = F.col(arr) if isinstance(arr, str) else arr
    parts = [F.array(F.lit(CLS_ID)), a] + ([F.array(F.lit(SEP_ID))] if eos else [])
    return F.concat(*parts)


def special_mask(a, b=None):
    """Q08: [0]*len(a) + [1] (+ [0]*len(b) + [1])."""
    ca = F.col(a) if isinstance(a, str) else a
    parts = [F.array_repeat(F.lit(0), F.size(ca)), F.array(F.lit(1))]
    if b is not None:
        cb = F.col(b) if isinstance(b, str) else b
        parts += [F.array_repeat(F.lit(0), F.size(cb)), F.array(F.lit(1))]
    return F.concat(*parts)


def type_ids(a, b=None):
    """Q08: zeros for CLS + a + SEP, then ones for b + SEP."""
    ca = F.col(a) if isinstance(a, str) else a
    parts = [F.array_repeat(F.lit(0), F.size(ca) + 2)]
    if b is not None:
        cb = F.col(b) if isinstance(b, str) else b
        parts.append(F.array_repeat(F.lit(1), F.size(cb) + 1))
    return F.concat(*parts)


def detokenize(arr):
    """Q09: ids back to text (special ids give their bracket names)."""
    a = F.col(arr) if isinstance(arr, str) else arr
    names = F.array(*[F.lit(t) for t in ID_TO_TOKEN])
    return F.array_join(F.transform(a, lambda x: F.element_at(names, x + 1)), "")


def replace_n(arr):
    """Q16: N token 11 becomes PAD 4."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.transform(a, lambda x: F.when(x == N_ID, F.lit(PAD_ID)).otherwise(x))

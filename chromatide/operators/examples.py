"""Model examples: prompt mixing, word ids, packing with sequence slots, batch padding, unpad/repad.

Per-example work is column expressions on one row (arrays); word ids come
from a joined word vocabulary; batch-level values (max length, offsets) come
from windows over batches of a fixed, small size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromatide.functions import prompts as P
from chromatide.functions.labels import strip_numbers
from chromatide.functions.seeded import seeded_hash
from chromatide.operators.common import global_position, running_sum
from chromatide.operators.sequences import add_specials, char_id_lists, char_ids

PAD, EOS, UNK = 0, 1, 2
IGNORE = -100


def word_vocab(words: DataFrame, col: str = "word") -> DataFrame:
    """Word -> id (3 + position in sorted order; 0 pad, 1 eos, 2 unknown)."""
    return global_position(words.select(col).distinct(), [F.col(col)], "word_id", 3)


def word_ids(df: DataFrame, text: str, vocab: DataFrame, key: list[str], out: str) -> DataFrame:
    """Tokenise ``text`` on blanks (upper-case, letters only) to ids through a vocabulary join."""
    x = df.select(*key, F.posexplode(F.split(F.col(text), " ")).alias("_p", "_w"))
    x = x.withColumn("word", F.upper(F.regexp_replace("_w", "[^A-Za-z]", "")))
    j = x.join(vocab.select("word", "word_id"), "word", "left")
    ids = j.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(
        F.struct("_p", F.coalesce("word_id", F.lit(UNK)).alias("i")))), lambda s: s["i"]).alias(out))
    return df.join(ids, key, "left").withColumn(out, F.coalesce(F.col(out), F.array().cast("array<bigint>")))


def prompt_mix(df: DataFrame, cell_type: str, genes: str, seed: int, key: str, fixed_type: str = "PBMC") -> DataFrame:
    """Q10: per row one of three tasks (seeded): generate for its type, generate for ``fixed_type``,
    or predict the type from the genes; gives ``question`` and ``answer``."""
    task = (seeded_hash(f"{seed}:task", key) % 3).cast("int")
    ct = strip_numbers(cell_type)
    q = (F.when(task == 0, P.generation_prompt(F.col(cell_type), seed, key))
         .when(task == 1, P.generation_prompt(F.lit(fixed_type), seed, key))
         .otherwise(P.prediction_prompt(genes, seed, key)))
    a = F.when(task == 2, ct).otherwise(F.col(genes))
    return df.withColumn("task", task).withColumn("question", q).withColumn("answer", a)


def pack_causal(q_ids: Column, a_ids: Column) -> Column:
    """Q12: input = question + answer + EOS; labels mask the question with -100; mask of ones."""
    ans = F.concat(a_ids, F.array(F.lit(EOS).cast("bigint")))
    inp = F.concat(q_ids, ans)
    labels = F.concat(F.array_repeat(F.lit(IGNORE).cast("bigint"), F.size(q_ids)), ans)
    return F.struct(inp.alias("input_ids"), F.array_repeat(F.lit(1), F.size(inp)).alias("attention_mask"),
                    labels.alias("labels"))


def pack_slots(prefix_ids: Column, suffix_ids: Column, target_ids: Column, k: int) -> Column:
    """Q11: prefix[:-1] + EOS*k + suffix[:-1] + target + EOS; targets -100 on the question; slot start."""
    pre = F.slice(prefix_ids, 1, F.greatest(F.size(prefix_ids) - 1, F.lit(0)))
    suf = F.slice(suffix_ids, 1, F.greatest(F.size(suffix_ids) - 1, F.lit(0)))
    tgt = F.concat(target_ids, F.array(F.lit(EOS).cast("bigint")))
    inp = F.concat(pre, F.array_repeat(F.lit(EOS).cast("bigint"), k), suf, tgt)
    lab = F.concat(F.array_repeat(F.lit(IGNORE).cast("bigint"), F.size(pre) + k + F.size(suf)), tgt)
    return F.struct(inp.alias("input_ids"), F.array_repeat(F.lit(1), F.size(inp)).alias("attention_mask"),
                    lab.alias("target_ids"), F.size(pre).alias("start_index_of_seq"))


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Consecutive batches of ``size`` rows in ``order`` (batch id and row inside the batch)."""
    pos = global_position(df, [F.col(order)], "_gp", 0)
    return pos.withColumn("batch", F.floor(F.col("_gp") / size).cast("bigint")) \
        .withColumn("row_in_batch", (F.col("_gp") % size).cast("int")).drop("_gp")


def max_len(df: DataFrame, col: str, batch: str = "batch") -> DataFrame:
    """Longest example per batch (window over the batch)."""
    return df.withColumn("max_len", F.max(F.size(col)).over(Window.partitionBy(batch)))


def left_pad(df: DataFrame, batch: str = "batch", start: str | None = "start_index_of_seq") -> DataFrame:
    """Q13: left-pad ids (PAD), mask (0) and labels (-100) to the batch maximum; shift the slot start."""
    x = max_len(df, "input_ids", batch).withColumn("_npad", F.col("max_len") - F.size("input_ids"))
    n = F.col("_npad")
    out = (x.withColumn("input_ids", F.concat(F.array_repeat(F.lit(PAD).cast("bigint"), n), "input_ids"))
           .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(0), n), "attention_mask")))
    lab = "labels" if "labels" in df.columns else "target_ids"
    out = out.withColumn(lab, F.concat(F.array_repeat(F.lit(IGNORE).cast("bigint"), n), lab))
    if start and start in df.columns:
        out = out.withColumn(start, F.col(start) + n)
    return out.drop("_npad")


def cu_seqlens(df: DataFrame, ids: str, batch: str = "batch", order: str = "row_in_batch") -> DataFrame:
    """Running token offsets per example inside its batch (distributed running sum)."""
    x = df.withColumn("_len", F.size(ids).cast("bigint"))
    r = running_sum(x, [batch], order, "_len", "seq_end")
    return r.withColumn("seq_start", F.col("seq_end") - F.col("_len")).drop("_len")


def unpad(df: DataFrame, ids: str, key: str, batch: str = "batch", row: str = "row_in_batch") -> DataFrame:
    """Q14: attended tokens of right-padded batches as flat rows with their flat index in the batch."""
    m = max_len(df, ids, batch)
    x = m.select(batch, row, key, "max_len", F.posexplode(ids).alias("pos", "token"))
    return x.select(batch, key, "pos", "token",
                    (F.col(row).cast("bigint") * F.col("max_len") + F.col("pos")).alias("flat_index"))


def repad(flat: DataFrame, key: str, batch: str = "batch", pad: int = PAD) -> DataFrame:
    """Q15: rebuild right-padded rows from flat tokens (positions kept), padded to the batch maximum."""
    rows = flat.groupBy(batch, key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))),
                                                    lambda s: s["token"]).alias("ids"))
    m = max_len(rows, "ids", batch)
    return m.select(batch, key, F.concat("ids", F.array_repeat(F.lit(pad).cast("bigint"),
                                                               F.col("max_len") - F.size("ids"))).alias("ids"))


def stack_sequences(seqs: DataFrame, key: str, rank: str = "rank", ids: str = "ids") -> DataFrame:
    """Gather a cell's ranked token lists into one nested array (rank order)."""
    return seqs.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(rank, ids))),
                                             lambda s: s[ids]).alias("input_ids_of_seqs"))


def stack_windows(windows: DataFrame, key: str, rank: str = "rank", col: str = "window", eos: bool = True, then=None) -> DataFrame:
    """A12 from bases: gather a cell's ranked windows as text, then tokenise each (CLS + char ids, + SEP).

    One byte a base is shuffled, a quarter of its token; only windows that some
    cell ranks are tokenised. A null window is left out, an empty one has the
    special tokens alone. With ``then``, a function of the token lists (see
    :func:`~chromatide.functions.letters.letter_number_lists`), its result stands
    in their place and ``n_seqs`` has their number: no worker holds more than the
    token lists of a few cells.
    """
    gathered = windows.where(F.col(col).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(rank, col))).alias("_w"))
    n_seqs = [F.size("_w").cast("bigint").alias("n_seqs")] if then else []
    return gathered.select(key, *n_seqs, char_id_lists(F.col("_w")[col], eos, then).alias("input_ids_of_seqs"))


def sequence_ids(windows: DataFrame, col: str = "window", eos: bool = True) -> DataFrame:
    """Window bases -> CLS + char ids (+ SEP)."""
    return windows.withColumn("ids", add_specials(char_ids(col), eos))

"""Registered queries: region strings, blacklist, interval merging, peaks, tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromatide.functions import regions as R
from chromatide.operators import regions as O
from chromatide.plans.fixtures import Inputs
from chromatide.plans.registry import query

TILE = 1024
MIN_COV = 2
_RX = "'^([^:]+):(\\d+)-(\\d+)$'"


@query("parse_region_colon", views=("features",), sql=f"""
SELECT feature_idx, regexp_extract(feature, {_RX}, 1) AS chrom,
       CAST(regexp_extract(feature, {_RX}, 2) AS BIGINT) AS start_pos,
       CAST(regexp_extract(feature, {_RX}, 3) AS BIGINT) AS end_pos FROM features""")
def parse_region_colon(spark, sf):
    f = Inputs(spark, sf).features
    return f.select("feature_idx", R.parse_region_colon("feature").alias("r")).select("feature_idx", "r.*")


@query("parse_region_dash", views=("features",), sql="""
SELECT feature_idx, CASE WHEN len(p) = 3 THEN p[1] END AS chrom, CASE WHEN len(p) = 3 THEN CAST(p[2] AS BIGINT) ELSE -1 END AS start_pos,
       CASE WHEN len(p) = 3 THEN CAST(p[3] AS BIGINT) ELSE -1 END AS end_pos, len(p) = 3 AS ok
FROM (SELECT feature_idx, string_split(CASE WHEN feature_idx % 7 = 0 THEN concat(replace(feature, ':', '-'), '-x')
      ELSE replace(feature, ':', '-') END, '-') AS p FROM features)""")
def parse_region_dash(spark, sf):
    f = Inputs(spark, sf).features
    name = F.when(F.col("feature_idx") % 7 == 0, F.concat(R.region_to_dash("feature"), F.lit("-x"))) \
        .otherwise(R.region_to_dash("feature"))
    r = f.select("feature_idx", R.parse_region_dash(name).alias("r")).select("feature_idx", "r.*")
    # error rows keep chrom NULL; positions shown as -1 so the check column stays integral
    return r.fillna(-1, ["start_pos", "end_pos"])


@query("region_to_dash", views=("features",),
       sql="SELECT feature_idx, replace(feature, ':', '-') AS feature FROM features")
def region_to_dash(spark, sf):
    return Inputs(spark, sf).features.select("feature_idx", R.region_to_dash("feature").alias("feature"))


@query("chrom_prefix", views=("features",), sql="""
SELECT feature_idx, CASE WHEN starts_with(c, 'chr') THEN c ELSE concat('chr', c) END AS chrom FROM
 (SELECT feature_idx, CASE WHEN feature_idx % 2 = 0 THEN substr(chrom, 4) ELSE chrom END AS c FROM features)""")
def chrom_prefix(spark, sf):
    f = Inputs(spark, sf).features
    c = F.when(F.col("feature_idx") % 2 == 0, F.substring("chrom", 4, 1 << 20)).otherwise(F.col("chrom"))
    return f.select("feature_idx", R.ensure_chr(c).alias("chrom"))


@query("drop_columns", views=("features",), sql="SELECT feature_idx, start_pos, end_pos FROM features")
def drop_columns(spark, sf):
    return Inputs(spark, sf).features.drop("feature", "chrom")


@query("peaks_to_bed6", views=("features",), sql="""
SELECT chrom, start_pos, end_pos, concat('peak_', CAST(row_number() OVER (ORDER BY chrom, start_pos, end_pos) AS VARCHAR)) AS name,
       '.' AS score, '*' AS strand FROM features""")
def peaks_to_bed6(spark, sf):
    return O.to_bed6(Inputs(spark, sf).features)


_OVERLAP_SQL = """SELECT DISTINCT f.feature_idx FROM features f JOIN blacklist b ON b.chrom = f.chrom
AND f.start_pos <= b.end_pos AND b.start_pos <= f.end_pos"""


@query("join_blacklist", views=("features", "blacklist"), sql=f"""
SELECT * FROM features WHERE feature_idx NOT IN ({_OVERLAP_SQL})""")
def join_blacklist(spark, sf):
    i = Inputs(spark, sf)
    return O.remove_blacklist(i.features, i.blacklist, "feature_idx")


@query("set_difference_index", views=("features", "blacklist"), sql=f"""
SELECT feature_idx FROM features EXCEPT {_OVERLAP_SQL}""")
def set_difference_index(spark, sf):
    i = Inputs(spark, sf)
    hits = O.overlapping_ids(i.features, i.blacklist, "feature_idx")
    return O.setdiff_index(i.features.select("feature_idx"), hits, "feature_idx")


def _islands_sql(src: str, keys: str, gap: int, extra_aggs: str = "") -> str:
    return f"""SELECT {keys}, min(s) AS start_pos, max(e) AS end_pos{extra_aggs} FROM (
  SELECT *, sum(CASE WHEN pm IS NULL OR s > pm + {gap} THEN 1 ELSE 0 END)
            OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM (
    SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm
    FROM ({src}))) GROUP BY {keys}, isl"""


@query("set_reduce_intervals", views=("features", "blacklist"), sql=_islands_sql(
    "SELECT chrom, start_pos AS s, end_pos AS e, 'feature' AS g FROM features UNION ALL "
    "SELECT chrom, start_pos, end_pos, 'blacklist' FROM blacklist", "chrom", 1,
    ", array_to_string(list_sort(list_distinct(list(g))), ',') AS groups"))
def set_reduce_intervals(spark, sf):
    i = Inputs(spark, sf)
    iv = (i.features.select("chrom", "start_pos", "end_pos", F.lit("feature").alias("g"))
          .unionByName(i.blacklist.select("chrom", "start_pos", "end_pos", F.lit("blacklist").alias("g"))))
    out = O.reduce_intervals(iv, [], group="g", gap=1)
    return out.withColumn("groups", F.array_join("groups", ","))


_COV_SQL = """SELECT grp, chrom, p AS seg_start, lead(p) OVER (PARTITION BY grp, chrom ORDER BY p) AS seg_end,
  CAST(sum(d) OVER (PARTITION BY grp, chrom ORDER BY p ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cov FROM (
  SELECT grp, chrom, p, sum(d) AS d FROM (SELECT grp, chrom, start_pos AS p, 1 AS d FROM fragments
  UNION ALL SELECT grp, chrom, end_pos, -1 FROM fragments) GROUP BY grp, chrom, p)"""


@query("peaks_pileup", views=("fragments",), sql="SELECT grp, chrom, start_pos AS peak_start, end_pos + 1 AS peak_end, "
       "max_cov FROM (" + _islands_sql(
           f"SELECT grp, chrom, seg_start AS s, seg_end - 1 AS e, cov FROM ({_COV_SQL}) "
           f"WHERE seg_end IS NOT NULL AND cov >= {MIN_COV}", "grp, chrom", 1, ", max(cov) AS max_cov") + ")")
def peaks_pileup(spark, sf):
    return O.call_peaks(Inputs(spark, sf).fragments, ["grp"], MIN_COV, bin_size=1000)


@query("seq_tile_ranges", views=("contigs",), sql=f"""
SELECT contig, tile_start, least(tile_start + {TILE}, n) AS tile_end FROM
 (SELECT contig, length(seq) AS n, unnest(range(0, length(seq), {TILE})) AS tile_start FROM contigs)""")
def seq_tile_ranges(spark, sf):
    c = Inputs(spark, sf).contigs.select("contig", F.lit(0).cast("bigint").alias("start_pos"),
                                         F.length("seq").cast("bigint").alias("end_pos"))
    return O.tile(c, TILE).select("contig", "tile_start", "tile_end")

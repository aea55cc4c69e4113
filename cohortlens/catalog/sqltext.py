"""Common table expressions of the SQL side, mirroring ``cohortlens.plans.tables``."""

from __future__ import annotations

ELEMENTS = """elements AS (
  SELECT l_suppkey AS subject, l_linenumber AS z, l_linestatus AS modality, CAST(l_extendedprice AS FLOAT) AS score,
         l_returnflag = 'R' AS label FROM lineitem)"""

TIED = """tied AS (
  SELECT l_suppkey AS subject, l_linenumber AS z, l_linestatus AS modality, CAST(l_discount AS FLOAT) AS score,
         l_returnflag = 'R' AS label FROM lineitem)"""

NORMALIZED = ELEMENTS + """, bounds AS (SELECT subject, min(score) AS lo, max(score) AS hi FROM elements GROUP BY subject),
normalized AS (
  SELECT e.subject, z, modality, label, CAST(CAST(CAST(score AS DOUBLE) - CAST(lo AS DOUBLE) AS FLOAT)::DOUBLE
         / greatest(CAST(CAST(hi AS DOUBLE) - CAST(lo AS DOUBLE) AS FLOAT), 1e-8::FLOAT)::DOUBLE AS FLOAT) AS score
  FROM elements e JOIN bounds USING (subject))"""

RECORDS = """records AS (
  SELECT c_custkey AS participant, l_orderkey AS case_id, CAST(l_linenumber - 1 AS INTEGER) AS z,
         (l_linenumber - 1) / 6.0::DOUBLE AS z_norm,
         CAST(least(19, floor((l_linenumber - 1) / 6.0::DOUBLE * 20)) AS INTEGER) AS z_bin,
         CAST(n_regionkey % 2 AS INTEGER) AS label,
         CASE WHEN n_regionkey % 2 = 0 THEN 'healthy' ELSE 'lesion' END AS domain,
         n_regionkey AS source, c_mktsegment AS site, o_orderpriority AS stage,
         max(l_quantity) / 50 AS support, min(l_suppkey) AS source_key,
         'set:' || l_orderkey || ':' || (l_linenumber - 1) AS record_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey
  GROUP BY c_custkey, l_orderkey, l_linenumber, n_regionkey, c_mktsegment, o_orderpriority)"""

SPLITS = RECORDS + """, participants AS (SELECT DISTINCT participant FROM records),
ranked AS (SELECT participant, row_number() OVER (ORDER BY md5('73|' || participant), participant) - 1 AS rk FROM participants),
shares AS (SELECT i, f, f * (SELECT count(*) FROM participants) AS raw
           FROM (VALUES (0, 0.70::DOUBLE), (1, 0.15::DOUBLE), (2, 0.15::DOUBLE)) t(i, f)),
floors AS (SELECT i, floor(raw) AS base, raw - floor(raw) AS frac,
                  (SELECT count(*) FROM participants) - sum(floor(raw)) OVER () AS rest FROM shares),
counts AS (SELECT i, base + CASE WHEN row_number() OVER (ORDER BY frac DESC, i) <= rest THEN 1 ELSE 0 END AS c FROM floors),
limits AS (SELECT i, sum(c) OVER (ORDER BY i) AS upto FROM counts),
split_map AS (SELECT participant, CASE WHEN rk < (SELECT upto FROM limits WHERE i = 0) THEN 'train'
                                       WHEN rk < (SELECT upto FROM limits WHERE i = 1) THEN 'val' ELSE 'test' END AS split
              FROM ranked)"""

PAIRS = SPLITS + """, mapped AS (SELECT r.*, s.split FROM records r JOIN split_map s USING (participant)),
side AS (SELECT DISTINCT split, label, participant,
                CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1009 ELSE 2018 END + 73 + 17 * label AS seed FROM mapped),
side_rank AS (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY md5(seed || '|' || participant), participant) AS rk
              FROM side),
matched AS (SELECT h.split, h.participant AS healthy, b.participant AS lesion,
                   'healthy_vs_lesion:' || h.split || ':' || substr(sha256('healthy_vs_lesion|' || h.split || '|' ||
                   h.participant || '|' || b.participant), 1, 12) AS pair_id
            FROM side_rank h JOIN side_rank b ON h.split = b.split AND h.rk = b.rk AND h.label = 0 AND b.label = 1),
member AS (SELECT split, pair_id, healthy AS participant FROM matched UNION ALL SELECT split, pair_id, lesion FROM matched),
first_case AS (SELECT participant, min(case_id) AS case_id FROM mapped GROUP BY participant),
candidate AS (SELECT m.pair_id, r.*, row_number() OVER (PARTITION BY m.pair_id, r.label, r.z_bin ORDER BY r.z, r.record_id) AS rn,
                     count(*) OVER (PARTITION BY m.pair_id, r.label, r.z_bin) AS n_side
              FROM member m JOIN mapped r ON m.participant = r.participant
                   JOIN first_case f ON r.participant = f.participant AND r.case_id = f.case_id),
bin_counts AS (SELECT pair_id, z_bin, least(2, min(n_side)) AS keep FROM candidate GROUP BY pair_id, z_bin
               HAVING count(DISTINCT label) = 2),
paired AS (SELECT c.* EXCLUDE (rn, n_side) FROM candidate c JOIN bin_counts USING (pair_id, z_bin) WHERE rn <= keep)"""


def probability(seed: str, key: str = "record_id", label: str = "label", weight: float = 0.25) -> str:
    unit = f"(('0x' || substr(md5({seed} || '|' || {key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
    return f"round({weight}::DOUBLE * {label} + {1 - weight}::DOUBLE * {unit}, 4)"


def predictions(seeds=(1,), split: str | None = "test") -> str:
    where = f"WHERE split = '{split}'" if split else ""
    values = ", ".join(f"({s})" for s in seeds)
    return PAIRS + f""", predictions AS (
  SELECT seed, split, pair_id, participant, case_id, z, z_bin, label, source, record_id,
         {probability('seed')} AS probability
  FROM paired, (VALUES {values}) s(seed) {where}),
subjects AS (SELECT seed, pair_id, participant, label, round(avg(probability), 12) AS score, count(*) AS slice_count
             FROM predictions GROUP BY seed, pair_id, participant, label)"""


PIXELS = """slices AS (SELECT vec_id AS slice_id, label AS channel, embedding AS px FROM embeddings),
pixels AS (SELECT slice_id, channel, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, px[i] AS v
           FROM (SELECT *, unnest(range(1, 65)) AS i FROM slices))"""


def hash_long(seed: str, key: str) -> str:
    return f"('0x' || substr(md5({seed} || '|' || {key}), 1, 15))::BIGINT"

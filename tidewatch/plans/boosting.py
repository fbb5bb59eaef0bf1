"""Query of the booster: two trees over all labelled rows, with fixed bins, by one aggregate a level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting, clean
from .fixtures import LABELLED_SQL, labelled

EDGES = {"dest_port": [150.0 * k for k in range(1, 12)], "duration": [20_000.0 * k for k in range(1, 12)], "total_fwd_packets": [10.0, 20.0, 30.0, 40.0], "total_bwd_packets": [1.0, 3.0, 5.0]}
PARAMS = boosting.Params(depth=2, rounds=2, rate=0.5, least_hessian=5.0, rows=1.0, columns=1.0, l1=0.1, l2=1.5)


def boosted_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree, node (place in a binary heap), feature and bin of its split (feature -1: a leaf), leaf value."""
    rows = clean.binary_task(clean.normalise_labels(labelled(spark, sf_dir)), "PortScan").withColumns({"key": F.xxhash64(*EDGES), "fold": F.lit(0)})
    edges = list(EDGES.values())
    model = boosting.fit_levels(boosting.binned_rows(rows, list(EDGES), edges), edges, PARAMS)
    return model.table(spark).withColumn("value", F.round("value", 6))


def _sql() -> str:
    p, unit = PARAMS, boosting.UNIT
    code = ", ".join(f"CAST(({' + '.join(f'({c} > {e})::INT' for e in es)}) AS INTEGER)" for c, es in EDGES.items())
    zero = lambda g: f"(sign({g}) * greatest(abs({g}) / {unit}::DOUBLE - {p.l1}::DOUBLE, 0.0::DOUBLE))"
    strength = lambda g, h: f"({zero(g)} * {zero(g)} / ({h} / {unit}::DOUBLE + {p.l2}::DOUBLE))"
    parts = [LABELLED_SQL, f"""rows0 AS MATERIALIZED (SELECT row_number() OVER () AS i, ("Label" = 'PortScan')::INT AS y, [{code}] AS b, 0.0::DOUBLE AS m FROM classed WHERE "Label" IN ('Benign', 'PortScan'))"""]
    nodes = []
    for t in range(p.rounds):
        parts += [
            f"p{t} AS (SELECT *, 1 / (1 + exp(-m)) AS p FROM rows{t})",
            f"n{t}_0 AS MATERIALIZED (SELECT i, y, b, m, CAST(round((p - y) * {unit}) AS BIGINT) AS g, CAST(greatest(round(p * (1 - p) * {unit}), 1) AS BIGINT) AS h, 0 AS node FROM p{t})",
        ]
        for d in range(p.depth):
            low, high = 2**d - 1, 2 ** (d + 1) - 2
            parts += [
                f"s{t}_{d} AS (SELECT node, f, bin, sum(g) AS g, sum(h) AS h FROM (SELECT node, g, h, unnest(range({len(EDGES)})) AS f, unnest(b) AS bin FROM n{t}_{d} WHERE node BETWEEN {low} AND {high}) GROUP BY ALL)",
                f"c{t}_{d} AS (SELECT node, f, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER a AS gn, sum(h) OVER a AS hn FROM s{t}_{d} WINDOW w AS (PARTITION BY node, f ORDER BY bin), a AS (PARTITION BY node, f))",
                f"g{t}_{d} AS (SELECT *, 0.5 * ({strength('gl', 'hl')} + {strength('(gn - gl)', '(hn - hl)')} - {strength('gn', 'hn')}) AS gain FROM c{t}_{d} WHERE hl >= {p.least_hessian * unit} AND hn - hl >= {p.least_hessian * unit})",
                f"b{t}_{d} AS MATERIALIZED (SELECT node AS spot, f, bin FROM g{t}_{d} WHERE gain > {boosting.LEAST_GAIN} QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, bin) = 1)",
                f"n{t}_{d + 1} AS MATERIALIZED (SELECT i, y, b, m, g, h, CASE WHEN f IS NULL THEN node ELSE 2 * node + 1 + (b[f + 1] > bin)::INT END AS node FROM n{t}_{d} LEFT JOIN b{t}_{d} ON spot = node)",
            ]
            nodes.append(f"SELECT {t} AS tree, spot AS node, CAST(f AS INTEGER) AS feature, bin, 0.0::DOUBLE AS value FROM b{t}_{d}")
        parts += [
            f"v{t} AS MATERIALIZED (SELECT node, -{p.rate}::DOUBLE * {zero('sum(g)')} / (sum(h) / {unit}::DOUBLE + {p.l2}::DOUBLE) AS v FROM n{t}_{p.depth} GROUP BY node)",
            f"rows{t + 1} AS MATERIALIZED (SELECT i, y, b, m + v AS m FROM n{t}_{p.depth} JOIN v{t} USING (node))",
        ]
        nodes.append(f"SELECT {t}, node, -1, 0, round(v, 6) FROM v{t} WHERE v <> 0")
    return "WITH " + ",\n".join(parts) + "\n" + " UNION ALL ".join(nodes)


QUERIES = {"boosted_splits": (boosted_splits, _sql())}

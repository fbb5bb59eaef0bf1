"""Cooldown in blocks against a loop over each key."""

import random

import pytest

from tidewatch.operators import alerts


def loop(rows, gap):
    last, out = {}, []
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0] is not None, r[0] or 0)):
        if r[2] not in last or r[1] - last[r[2]] >= gap:
            out.append(r)
            last[r[2]] = r[1]
    return sorted(out + [r for r in rows if r[1] is None], key=repr)


@pytest.mark.parametrize(("seconds", "blocks"), [(10, 6), (10, 1), (0.5, 3), (7, 2)])
def test_blocks_equal_a_loop(spark, seconds, blocks):
    rng = random.Random(blocks)
    rows = [(rng.choice([None, 3, i]), None if i % 97 == 0 else rng.randrange(-40_000_000, 900_000_000) // rng.choice([1, 1_000_000]) * 1, rng.choice(["hot", "hot", "hot", None, f"k{i % 30}"]), {"a": str(i)}) for i in range(1500)]
    rows += [(i, i * 900_000, "steady", {}) for i in range(600)] + [(i, i * 10_000_000, "edge", {}) for i in range(40)] + [(i, i * 9_999_999, "under", {}) for i in range(40)]
    rows += [(i, 500_000_000_000 + i * 3_000_000_000, f"late{i % 3}", {}) for i in range(30)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "row_id long, t_us long, src_ip string, more map<string,string>, block string").repartition(4)
    got = alerts.cooldown(df, seconds, ["src_ip"], blocks=blocks)
    assert got.schema == df.schema
    key = lambda r: (r[0], r[1], r[2])
    assert sorted((key(r) for r in got.collect()), key=repr) == [key(r) for r in loop(rows, int(seconds * 1_000_000))]
    assert alerts.cooldown(df.limit(0), seconds, ["src_ip"]).count() == 0

"""Asked windows meet their bucket's repeated ones without either side being copied."""

import random

import numpy as np

from ledgerline.llm import substring


def test_answers_without_replication(spark):
    rng = random.Random(6)
    known = {bucket: sorted(rng.sample(range(1000), 40)) for bucket in range(0, 12, 2)}  # odd buckets have no repeats
    repeated = [(bucket, np.array(hashes, np.uint64).tobytes()) for bucket, hashes in known.items()]
    asked, expected = [], {}
    for base in range(0, 3000, 100):  # 30 batches ask in every bucket
        for bucket in range(12):
            rows, starts = np.arange(base, base + 20), np.array([rng.randrange(500) for _ in range(20)])
            hashes = np.array([rng.randrange(1000) for _ in range(20)], np.uint64)
            asked.append((bucket, base, hashes.tobytes(), substring._pack_places(rows, starts, base)))
            hits = [(int(r), int(s)) for r, s, h in zip(rows, starts, hashes) if int(h) in known.get(bucket, ())]
            expected.setdefault(base, []).extend(hits)
    schema = "bucket bigint, base bigint, hashes binary, places binary"
    found = substring.answers_of(
        spark.createDataFrame(asked, schema).repartition(5), spark.createDataFrame(repeated, "bucket bigint, repeated binary")
    )
    got = {}
    for r in found.collect():
        rows, starts = substring._unpack_places(bytes(r["places"]), r["base"])
        got.setdefault(r["base"], []).extend(zip(rows.tolist(), starts.tolist()))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items() if v}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()

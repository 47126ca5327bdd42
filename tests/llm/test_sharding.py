import heapq
import random
import zlib

import pytest

from textloom.llm.sharding import assign_shards, schedule

SCHEMA = "doc_id long, text string, size string, shard string"


def plain_lpt(sizes, shards):
    heap, out = [(0, k) for k in range(shards)], {}
    for s in sorted(sizes, reverse=True):
        load, k = heapq.heappop(heap)
        out.setdefault(s, [0] * shards)[k] += 1
        heapq.heappush(heap, (load + s, k))
    return {s: [(k, n) for k, n in enumerate(got) if n] for s, got in out.items()}


@pytest.mark.parametrize("seed", range(12))
def test_schedule_is_plain_lpt(seed):
    r = random.Random(seed)
    shards = r.choice([1, 2, 5, 24])
    classes = {r.randint(8, 300): r.choice([1, 3, 40, 700]) for _ in range(r.randint(0, 30))}
    assert schedule(list(classes.items()), shards) == plain_lpt([s for s, n in classes.items() for _ in range(n)], shards)


def test_rows_groups_and_slots(spark):
    r = random.Random(5)
    texts = [None, "", "é" * 9, "hot"] + ["w" * r.randint(1, 60) + str(i) for i in range(150)]
    rows = [(i, r.choice(texts[:4]) if i % 3 == 0 else r.choice(texts), "x", "y") for i in range(600)] + [(3, "dup", "x", "y")] * 3
    out = assign_shards(spark.createDataFrame(rows, SCHEMA), shards=5).collect()
    assert len(out) == len(rows)
    by_text, loads, slots = {}, {}, {}
    text_of = dict((a, b) for a, b, *_ in rows[:600])
    for o in out:
        assert (o.law, o.grown_shard) == ("bytes", None)
        slots.setdefault(o.shard, []).append(o.slot)
        loads[o.shard] = loads.get(o.shard, 0) + o.size
        if o.doc_id != 3:
            t = text_of[o.doc_id]
            assert o.size == 8 + len((t or "").encode())
            assert o.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
            by_text.setdefault(t, set()).add(o.shard)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = {}
    for _, t, *_ in rows:
        sizes[t] = sizes.get(t, 0) + 8 + len((t or "").encode())
    want = [0] * 5
    for s, runs in plain_lpt(list(sizes.values()), 5).items():
        for k, n in runs:
            want[k] += s * n
    assert [loads.get(k, 0) for k in range(5)] == want


def test_empty(spark):
    assert assign_shards(spark.createDataFrame([], SCHEMA)).count() == 0

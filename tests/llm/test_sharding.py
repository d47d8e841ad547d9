import random
import zlib
from collections import defaultdict

from attestor.llm.sharding import shard


def check(rows, got, shards):
    by_id = dict(rows)
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    where, slots, sizes = {}, defaultdict(list), defaultdict(int)
    for r in got:
        t = by_id[r.doc_id] or ""
        assert (r.size, r.text_crc32) == (len(t.encode()) + 8, zlib.crc32(t.encode()))
        assert where.setdefault(t, r.shard) == r.shard
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        assert 0 <= r.shard < shards
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return sizes


def test_even_shards_with_groups_together(spark):
    r = random.Random(4)
    rows = [(i, "é" * r.randint(0, 400)) for i in range(3000)] + [(5000 + i, "copy" * 50) for i in range(900)] + [(9000, None), (9001, "")]
    rows = [(i, t + str(i) if t and i < 5000 else t) for i, t in rows]
    df = spark.createDataFrame([(*x, r.choice(["en", None, "de"]), f"src{r.randrange(9)}", 1) for x in rows], "doc_id long, text string, lang string, source string, shard int")
    sizes = check(rows, shard(df).collect(), 24)
    total, copies = sum(sizes.values()), 900 * 208
    rest = sorted(sizes.values())[:-1] if max(sizes.values()) >= copies else sorted(sizes.values())
    assert len(sizes) == 24 and rest[-1] / rest[0] < 1.25, sorted(sizes.values())
    assert total == sum(len((t or "").encode()) + 8 for _, t in rows)


def test_few_rows_empty_table_and_target(spark):
    rows = [(1, "a"), (2, "a"), (3, None)]
    df = spark.createDataFrame([(*x, "en", "s") for x in rows], "doc_id long, text string, lang string, source string")
    check(rows, shard(df).collect(), 24)
    assert shard(df.limit(0)).count() == 0
    assert {r.shard for r in shard(df, target_bytes=13).collect()} == {0, 1}

import collections
import random

from lesewerk.llm import packing as p


def plain_best_fit(items, capacity):
    """One item after the other, over all bins."""
    bins = []
    for size, source, cluster in items:
        fit = [b for b in bins if b[0] >= size and not (source >= 0 and source in b[1]) and not (cluster >= 0 and cluster in b[2])]
        b = min(fit, key=lambda b: b[0]) if fit else None
        if b is None:
            b = [capacity, set(), set()]
            bins.append(b)
        b[0] -= size
        b[1].add(source)
        b[2].add(cluster)
    return len(bins)


def expand(classes, capacity):
    runs, bins = p.best_fit(classes, capacity)
    load, content, seen = collections.Counter(), collections.defaultdict(list), collections.Counter()
    for c, first, many, each, start in runs:
        assert first == seen[c]
        seen[c] += many
        for k in range(many):
            load[start + k // each] += classes[c][0]
            content[start + k // each].append(classes[c])
    assert all(seen[c] == classes[c][3] for c in range(len(classes)))
    assert all(x <= capacity for x in load.values()) and set(content) == set(range(bins))
    for inside in content.values():
        for i in (1, 2):
            keys = [x[i] for x in inside if x[i] >= 0]
            assert len(keys) == len(set(keys))
    return bins


def test_runs_are_best_fit():
    random.seed(3)
    for _ in range(200):
        capacity = random.randint(5, 60)
        sizes = collections.Counter(random.randint(1, capacity) for _ in range(random.randint(1, 80)))
        classes = [(s, -1, -1, n) for s, n in sizes.items()]
        got = expand(classes, capacity)
        order = [(s, -1, -1) for s in sorted(sizes, reverse=True) for _ in range(sizes[s])]
        assert got == plain_best_fit(order, capacity)


def test_conflicts():
    random.seed(4)
    for _ in range(100):
        capacity = random.randint(5, 40)
        classes = collections.Counter((random.randint(0, capacity), random.randint(-1, 3), random.randint(-1, 5)) for _ in range(60))
        expand([(*k, n) for k, n in classes.items()], capacity)
    assert expand([(1, 0, -1, 5)], 100) == 5 and expand([(0, -1, -1, 9)], 3) == 1


def check(rows, items):
    by_item = collections.defaultdict(list)
    load = collections.Counter()
    for r in rows:
        by_item[r.i].append((r.part_no, r.part_start, r.part_size))
        load[r.g, r.take_no] += r.part_size
    capacity = {g: c for g, _, _, c, _ in items if g is not None and c is not None}
    assert all(x <= capacity[g] for (g, _), x in load.items())
    for g, i, n, c, _ in items:
        if g is None or i is None or c is None:
            continue
        parts = sorted(by_item[i])
        assert sum(s for *_, s in parts) == max(n or 0, 0) and len(parts) == max(1, -(-max(n or 0, 0) // c))
        assert [a for _, a, _ in parts] == [k * c for k in range(len(parts))]
    for g in capacity:
        takes = {t for h, t in load if h == g}
        assert takes == set(range(len(takes)))


def test_rows(spark):
    random.seed(5)
    items = [("hot" if random.random() < 0.6 else f"p{random.randint(0, 5)}", i, random.randint(0, 130), 100, random.randint(0, 4)) for i in range(3000)]
    items += [("n", 9000, None, 100, None), (None, 9001, 5, 100, 1), ("c", 9002, 5, None, 1), ("e", 9003, 0, 100, 1), ("k", 9004, 1000, 100, 1), ("m", 9005, -4, 100, 1)]
    df = spark.createDataFrame(items, "g string, i bigint, size int, cap int, src int").withColumnRenamed("cap", "capacity")
    check(p.pack(df, "g", "i", "size", "capacity", salts=5).collect(), items)
    check(p.pack(df, "g", "i", "size", "capacity", salts=3, block_classes=20).collect(), items)
    rows = p.pack(df, "g", "i", "size", "capacity", source="src").collect()
    check(rows, items)
    of = {i: s for _, i, _, _, s in items}
    pairs = [(r.g, r.take_no, of[r.i]) for r in rows if of[r.i] is not None and r.part_no == 0]
    whole = [(r.g, r.take_no, of[r.i]) for r in rows if of[r.i] is not None]
    assert len(set(whole)) == len(whole) and len(set(pairs)) == len(pairs)
    assert p.pack(df.limit(0), "g", "i", "size", "capacity").count() == 0


def test_hot_group_is_packed_as_well_as_alone(spark):
    random.seed(6)
    sizes = [random.randint(10, 60) for _ in range(2000)]
    df = spark.createDataFrame([("g", i, s, 100) for i, s in enumerate(sizes)], "g string, i bigint, size int, capacity int")
    takes = p.pack(df, "g", "i", "size", "capacity").select("take_no").distinct().count()
    assert takes == plain_best_fit([(s, -1, -1) for s in sorted(sizes, reverse=True)], 100) and takes <= 1.03 * sum(sizes) / 100 + 1


def test_large_group_with_conflicts_is_searched_whole(spark):
    """More than 8,192 classes: the takes are those of one search over all bins of the group."""
    random.seed(7)
    items = [("g", i, random.randint(10, 220), 232, i % 700, i if i % 40 else 0) for i in range(12_000)]
    df = spark.createDataFrame(items, "g string, i bigint, size int, capacity int, src int, clu int")
    rows = p.pack(df, "g", "i", "size", "capacity", source="src", cluster="clu").collect()
    check(rows, [x[:5] for x in items])
    of = {i: (s, c) for _, i, _, _, s, c in items}
    for k in (0, 1):
        assert len({(r.take_no, of[r.i][k]) for r in rows}) == len(rows)
    # the same classes in one call, with a bit for every source and cluster
    classes = sorted(collections.Counter(x[2:3] + x[4:] for x in items).items())
    whole = p.best_fit([(*c, n) for c, n in classes], 232)[1]
    blocks = len({r.take_no for r in p.pack(df, "g", "i", "size", "capacity", source="src", cluster="clu", block_classes=1000).collect()})
    takes = len({r.take_no for r in rows})
    assert takes <= 1.002 * whole and takes < blocks and p.BLOCK_CLASSES >= 80_000

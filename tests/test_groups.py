"""Groups by shared keys against union by hand, and splits that keep them together."""

import random

from pyspark.sql import functions as F

from advisoryspark.operators import groups


def test_groups_and_split(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, f"a{rng.randint(0, 150)}"]), rng.choice([None, f"b{rng.randint(0, 150)}"])) for i in range(300)]
    rows += [(1000 + i, f"x{i}", f"x{i + 1}") for i in range(70)]  # a falling chain over one key column and the next
    rows += [(2000 + i, f"chain{i // 2}", f"chain{(i + 1) // 2}") for i in range(90)]
    rows += [(3000 + i, "hot", None) for i in range(200)] + [(3000, "hot", None), (5000, None, None)]
    table = spark.createDataFrame(rows, "i long, a string, b string").repartition(5)
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    seen = {}
    for i, a, b in rows:
        for key in (("a", a), ("b", b)):
            if key[1] is not None:
                x, y = sorted((find(i), find(seen.setdefault(key, i))))
                root[y] = x
    found = groups.groups(table, "i", {"a": F.col("a"), "b": F.col("b")})
    assert {r.id: r.group_id for r in found.collect()} == {i: find(i) for i in root}
    sides = groups.split(found, large=0.05).collect()
    assert len(sides) == len(root)
    by_group = {}
    for r in sides:
        by_group.setdefault(r.group_id, set()).add(r.side)
    assert all(len(s) == 1 for s in by_group.values())
    share = {s: sum(r.side == s for r in sides) / len(sides) for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.8) < 0.15 and min(share.values()) > 0.02
    assert by_group[3000] == {"train"}
    assert groups.groups(table.limit(0), "i", {"a": F.col("a")}).count() == 0
    assert groups.split(found.limit(0)).count() == 0

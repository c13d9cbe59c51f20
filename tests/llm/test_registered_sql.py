"""The registered SQL gives the same rows as its query; components with hubs against a search by hand."""

import random

import duckdb
import pytest

from linkloom.llm import near_duplicates, registry

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    found = db.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    wanted = sorted(repr([row[names.index(c)] for c in sorted(names)]) for row in found.fetchall())
    own = registry.queries()[name](spark, TABLES)
    assert sorted(own.columns) == sorted(names)
    assert sorted(repr([row[c] for c in sorted(names)]) for row in own.collect()) == wanted


def test_components_with_hubs(spark):
    rng = random.Random(4)
    edges = [(0, k) for k in range(1, 700)] + [(900, k) for k in range(901, 1200)] + [(k, k + 1) for k in range(2000, 2060)]
    edges += [(699, 5000), (5000, 1500), (3000, 3000)] + [(rng.randrange(6000, 6200), rng.randrange(6000, 6200)) for _ in range(80)]
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    frame = spark.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["root"] for r in near_duplicates.components(frame).collect()}
    alone = {a for e in edges for a in e} - {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: r for x, r in root.items() if x not in alone}

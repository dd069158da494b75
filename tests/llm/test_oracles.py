"""Queries against their SQL on the small tables, as the driver compares them; and vectors of several dimensions against brute force."""

import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

from quilt.llm import embedding_dedup
from quilt.llm.oracles import ORACLES
from quilt.llm.queries import QUERIES

SF = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    if not SF.exists():
        pytest.skip("no tables here")
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = QUERIES[name](spark, str(SF))
    columns = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    got = [tuple(x[c] for c in columns) for x in found.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    con.close()


def test_vectors_link_in_every_dimension(spark):
    r = np.random.default_rng(2)
    rows = []
    for d, n in ((16, 120), (3, 40), (1, 4)):
        base = r.normal(size=(n // 4, d))
        for i in range(n):
            rows.append((len(rows), (base[i % len(base)] + 0.12 * r.normal(size=d)).tolist(), int(i % 2)))
    rows += [(900, rows[0][1], 0), (901, [0.0] * 16, 0), (902, None, 0), (903, rows[0][1], None), (904, [float("nan")] * 3, 1)]
    random.Random(1).shuffle(rows)
    got = {x.vec_id: x for x in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    sound = {i: np.array(x) for i, x, l in rows if x and l is not None and np.isfinite(x).all() and np.any(x)}
    label = {i: l for i, _, l in rows}
    wanted = found = 0
    for i, x in sound.items():
        n = sum(j != i and label[i] == label[j] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93 for j, y in sound.items())
        wanted, found = wanted + n, found + got[i].n_links
        assert got[i].n_links <= n
    assert found >= 0.97 * wanted and wanted > 100
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (901, 902, 903, 904))

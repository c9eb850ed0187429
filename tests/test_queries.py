"""Every registered query against its DuckDB twin on the smallest tables."""

import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

QUERIES = {k: v for k, v in (E.queries()).items() if k[0] == 'q'}  # the others: tests/llm
SQL = {k: v for k, v in E.oracle_sql().items() if k[0] == 'q'}


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha256("\n".join(sorted("|".join(norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF_SMALL):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF_SMALL}/{f}')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["question_id", "rank", "doc_id", "score"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


def test_text_search_matches_brute_force(spark):
    """Encode every text with the same encoder in plain NumPy, rank every post for
    every question, compare with the Spark result."""
    import numpy as np
    import pyarrow.parquet as pq

    from quarry.operators.encode import HashingEncoder
    from quarry.plans import scenario as S

    docs = pq.read_table(f"{SF_SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pandas()
    events = set(pq.read_table(f"{SF_SMALL}/events.parquet", columns=["event_id"]).column(0).to_pylist())
    docs = docs[[d * 5 in events for d in docs.doc_id]]  # the posts view joins each document to one event
    bench = pq.read_table(f"{SF_SMALL}/benchmark.parquet", columns=["item_id", "text"]).to_pandas()
    enc = HashingEncoder()
    x = enc.encode(docs.text.tolist()).astype(np.float32).astype(np.float64)
    q = enc.encode(["query: " + t for t in bench.text]).astype(np.float32).astype(np.float64)
    keys = docs.doc_id.to_numpy()
    want = set()
    for j, qid in enumerate(bench.item_id):
        d = ((x - q[j]) ** 2).sum(1)
        for rank, i in enumerate(np.lexsort((keys, d))[: S.BATCH_K], start=1):
            want.add((int(qid), rank, int(keys[i]), round(1.0 / (1.0 + d[i]), 6)))
    got = {(r.question_id, r.rank, r.doc_id, round(r.score, 6))
           for r in QUERIES["q27_text_search"](spark, SF_SMALL).collect()}
    assert got == want

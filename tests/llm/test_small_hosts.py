"""The line rule on hosts of few texts, in code and SQL."""

import random

import duckdb

from cutlist.llm import queries, sql


def test_lines_of_small_hosts_in_code_and_sql(spark, tmp_path):
    """A line that 5 of 50 texts hold goes; 4 of 50, 8 % of 100 and 20 of 250 are at the limit; texts without a host are one."""
    rng = random.Random(6)
    prose = lambda n: " ".join(f"{rng.choice('bcdfg')}{rng.randrange(10**6)}" for _ in range(n))
    banner = prose(60)
    rows = []
    for host, holders, size in (("above", 5, 50), ("four", 4, 50), ("share", 8, 100), ("over", 9, 100), ("large", 20, 250), ("most", 21, 250), (None, 5, 50)):
        rows += [(len(rows) + i, f"{prose(55)}\n{banner if i < holders else prose(60)}", host) for i in range(size)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_quality_rules(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    columns = sorted(got.columns)
    want = con.sql(f"select {', '.join(columns)} from ({sql.ORACLE_SQL['op8_quality_rules']})").fetchall()
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want)
    host = {i: h for i, _, h in rows}
    gone = [host[r.doc_id] for r in got.filter("not kept and not base_failed").collect()]
    assert {h: gone.count(h) for h in set(gone)} == {"above": 4, "over": 8, "most": 20, None: 4}

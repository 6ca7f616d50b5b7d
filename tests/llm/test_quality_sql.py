"""The quality rules and their SQL on planted lines: depleted documents, hosts at the limit, no host."""

import random

import duckdb
from pyspark.sql import functions as F

from cutlist.llm import queries, sql


def test_depleted_documents_in_code_and_sql(spark, tmp_path):
    rng = random.Random(5)
    prose = lambda n: " ".join(f"{rng.choice('bcdfg')}{rng.randrange(10**6)}" for _ in range(n))
    banner = prose(60)
    rows = []
    for host, holders, size in (("large", 25, 400), ("small", 21, 30), ("edge", 20, 40), (None, 22, 50)):
        rows += [(len(rows) + i, f"{prose(55)}\n{banner if i < holders else prose(60)}", host) for i in range(size)]
    rows += [(None, banner + "\n" + prose(55), None), (900, None, "small"), (901, "", None), (902, banner.upper().replace(" ", "  ") + "\n" + prose(55), "small")]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_quality_rules(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    columns = sorted(got.columns)
    want = con.sql(f"select {', '.join(columns)} from ({sql.ORACLE_SQL['op8_quality_rules']})").fetchall()
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(want, key=str)
    # one document of each group keeps the banner, the others are depleted; 20 holders are at the limit
    depleted = got.filter(~F.col("kept") & ~F.col("base_failed")).count()
    assert depleted == 24 + 21 + 0 + 22

"""Search and duplicates over whole tables, against DuckDB over the same tables."""

import duckdb

from sluice.catalog import _TFIDF, ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.1"


def test_search_has_every_item(spark):
    d = duckdb.connect()
    for t in ("benchmark", "conversations"):
        d.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = ORACLE_SQL["search_topk"]
    assert "item_id <" not in sql
    want = sorted((i, r, v, round(s, 3)) for i, v, r, s in d.execute(sql).fetchall())
    got = sorted((r["item_id"], r["rank"], r["id"], round(r["score"], 3)) for r in QUERIES["search_topk"](spark, SF).collect())
    assert got == want
    assert {x[0] for x in got} == {r[0] for r in d.execute("SELECT item_id FROM benchmark").fetchall()}


def test_duplicates_of_other_conversations(spark, tmp_path):
    d = duckdb.connect()
    d.execute(f"""CREATE TABLE conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet' UNION ALL
        SELECT 100000 + conv_id * 2 + 1, turn, role, regexp_replace(text, '\\w+\\W+', '') FROM '/root/testdata/sf0.01/conversations.parquet' WHERE conv_id < 30""")
    d.execute(f"COPY conversations TO '{tmp_path}/conversations.parquet'")
    sql = ORACLE_SQL["near_duplicates_blocked"]
    assert "%" not in sql
    want = {(a, b): s for a, b, s in d.execute(sql).fetchall()}
    got = {(r["a"], r["b"]): r["score"] for r in QUERIES["near_duplicates_blocked"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-4 for k in want)
    assert len(want) > 30 and any(a // 1000 % 20 != b // 1000 % 20 for a, b in want)


def test_role_is_the_whole_block(spark):
    assert QUERIES["near_duplicates_blocked"](spark, SF).count() == 1

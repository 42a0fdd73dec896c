import pytest

from loomdex.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf_dir, duck, same, name):
    same(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLES[name])


@pytest.mark.parametrize("make,table", [("repetition", "documents"), ("secrets", "documents")])
def test_odd_rows_match_sql(spark, odd, same, make, table):
    import duckdb

    from loomdex.llm import repetition, secrets

    con = duckdb.connect()
    plain = odd.filter("doc_id is not null and (text is null or text not like '%control%')").select("doc_id", "text").dropDuplicates(["doc_id"])
    pdf = plain.toPandas()
    con.register("documents", pdf)
    op, sql = {"repetition": (repetition.repetition_rules, repetition.oracle()), "secrets": (secrets.secret_scan, secrets.oracle())}[make]
    same(op(plain), con, sql)


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}

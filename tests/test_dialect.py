import pytest

from quillspark.functions import coerce
from quillspark.plans import render
from quillspark.plans.engine import Engine
from quillspark.plans.errors import QueryError
from quillspark.plans.parser import parse, shape


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    staff = [("Ann", "Eng", "8000", "30"), ("Ben", "Eng", "7000", "30"), ("Cy", "HR", "5000", "40"), ("Di", "HR", "6000", "30")]
    e.register("staff", spark.createDataFrame(staff, "name string, dept string, salary string, age string"))
    e.register("sales", spark.createDataFrame([("Alice", "150"), ("Bob", "50"), ("A.C", "75"), ("ABC", "80"), ("Charlie", "200")], "name string, amount string"))
    e.register("people", spark.createDataFrame([("1", "Alice", "d1"), ("2", "Bob", "d2"), ("3", "Carol", "d1")], "person_id string, name string, dept_id string"))
    e.register("Depts 2026", spark.createDataFrame([("d1", "Research"), ("d2", "Finance")], "dept_id string, `dept name` string"), ("depts",))
    return e


def rows(engine, sql, **kw):
    return [tuple(r.values()) for r in engine.run(sql, **kw).rows]


def test_group_order(engine):
    got = rows(engine, "select dept, count(name), sum(salary), avg(age) from staff group by dept order by dept asc;")
    assert got == [("Eng", 2, 15000.0, 30.0), ("HR", 2, 11000.0, 35.0)]


def test_first_value_and_minmax(engine):
    assert rows(engine, "select dept, name, min(salary), max(name) from staff group by dept order by dept") == [("Eng", "Ann", "7000", "Ben"), ("HR", "Cy", "5000", "Di")]


def test_global_aggregate_of_nothing(engine):
    assert rows(engine, "select count(*) from staff where age > 99") == []


@pytest.mark.parametrize(
    ("where", "n"),
    [("amount > 100", 2), ("name like '%ch%'", 1), ("name like 'A.C'", 1), ("name LIKE 'a_c'", 2), ("name = 'ALICE'", 1), ("amount != 50", 4), ("amount <= '75'", 2)],
)
def test_where(engine, where, n):
    assert len(rows(engine, f"select name from sales where {where}")) == n


def test_join_and_names(engine):
    got = rows(engine, "select people.name, depts.dept_name from people join depts on people.dept_id = depts.dept_id order by people.name")
    assert got == [("Alice", "Research"), ("Bob", "Finance"), ("Carol", "Research")]
    star = engine.run("select * from people join depts on people.dept_id = depts.dept_id")
    assert "people.dept_id" in star.columns and "depts.dept_id" in star.columns


def test_scalars(engine):
    assert rows(engine, "select upper(name) as u, substr(name,2) as s, substr(name,1,2) as t, substr(name,0,2) as z from staff where name = 'ben'") == [("BEN", "en", "Be", "")]


def test_limits(engine):
    r = engine.run("select name from staff limit 2")
    assert r.row_count == 2 and r.truncated
    assert not engine.run("select name from staff limit 5000").truncated
    assert engine.run("select name from staff", limit=1).row_count == 1


@pytest.mark.parametrize(
    "sql",
    [
        "delete from staff", "select distinct name from staff", "select name from staff where age > 1 and name = 'x'",
        "select name from staff where a = 'x' and b = 'y'", "select dept from staff group by dept having count(*) > 1",
        "select name from staff s", "select name from staff left join sales on a = b", "select name from staff where age <> 5",
        "select name from staff order by age", "select name, age from staff order by name, age", "select name from (select 1)",
        "select count(distinct name) from staff",
    ],
)
def test_refused(engine, sql):
    with pytest.raises(QueryError) as e:
        engine.run(sql)
    assert e.value.code == "query_unsupported"


def test_unknown(engine):
    for sql, code in (("select x from staff", "query_column_not_found"), ("select name from nope", "query_table_not_found"), ("select name from Staff", "query_table_not_found"), ("select name from staff where x = 1", "query_column_not_found")):
        with pytest.raises(QueryError) as e:
            engine.run(sql)
        assert e.value.code == code


def test_keywords_in_literals(engine):
    assert parse("select name from staff where name = 'having a join limit 5'").where[2] == "having a join limit 5"
    assert rows(engine, "select\n name\n from staff where name = 'it''s'") == []


def test_shape_holds_no_values():
    s = shape("select name, upper(x) from t where secret = 'abc' limit 3")
    assert s["has_where"] and s["has_aggregates"] and s["limit"] == 3 and "abc" not in str(s) and "secret" not in str(s)


def test_pushdown(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 as v", "cast(id as string) as s").write.parquet(str(tmp_path / "t"))
    e = Engine(spark)
    e.register("t", spark.read.parquet(str(tmp_path / "t")))
    plan = e.plan("select v from t where id > 90", unbounded=True)._jdf.queryExecution().toString()
    assert "GreaterThan(id,90)" in plan and "s#" not in plan.split("ReadSchema")[-1]


def test_render():
    data = [{"name": "a|b", "note": 'say "x", y'}, {"name": "l\nb", "note": 2.0}]
    assert render.markdown_table(["name", "note"], data).split("\n")[2:] == ['| a\\|b | say "x", y |', "| l<br>b | 2 |"]
    assert render.csv_text(["name", "note"], data) == 'name,note\na|b,"say ""x"", y"\n"l\nb",2'


def test_names():
    assert coerce.table_name("Sales 2026!") == "sales_2026" and coerce.table_name("2x") == "table_2x" and coerce.table_name("表") == "table"
    assert coerce.comparable("Annual  Budget (€)") == "annual_budget" and coerce.comparable("T.2nd") == "t.column_2nd"

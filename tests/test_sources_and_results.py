import json
import pathlib
import random
from decimal import Decimal
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tablelore.operators import compare, matching, scoring
from tablelore.plans import upkeep
from tablelore.plans.dataset import prepare_folder
from tablelore.plans.readonly import NotReadOnly, is_read_only, run_sql, split_statements
from tablelore.session import shared_dir
from tablelore.sources import artifacts, files, jdbc, layout
from tablelore.sources.naming import safe_name, unique_name
from tablelore.tables import count_rows, list_columns, sample_rows

# --- files -------------------------------------------------------------------------


def test_names():
    assert [safe_name(n) for n in ("a b.csv", "2020.sales.csv", "é.json", ".csv", "x")] == ["a_b", "_2020_sales", "_", "table_data", "x"]
    taken = set()
    assert [unique_name("t", taken) for _ in range(3)] == ["t", "t_2", "t_3"]


def test_folder(spark, tmp_path):
    (tmp_path / "users.csv").write_text('id,name,day\n1,"a, ""b""",2024-01-01\n2,c,2024-01-02\n')
    (tmp_path / "users.tsv").write_text("id\tscore\n1\t2.5\n")
    (tmp_path / "log.jsonl").write_text('{"id": 1, "tags": ["x"]}\n{"id": 2}\n')
    (tmp_path / "doc.json").write_text(json.dumps([{"id": 1}, {"id": 2}, {"id": 3}], indent=1))
    (tmp_path / "notes.txt").write_text("skip me")
    (tmp_path / "deeper").mkdir()
    spark.range(4).write.parquet(str(tmp_path / "nums.parquet"))
    loaded = files.load_folder(spark, str(tmp_path))
    assert sorted(loaded.tables) == ["doc", "log", "nums", "users", "users_2"]
    assert loaded.skipped == ["notes.txt"]
    counts = {r.table: r.row_count for r in count_rows(loaded.tables).collect()}
    assert counts == {"doc": 3, "log": 2, "nums": 4, "users": 2, "users_2": 1}
    assert dict(loaded.tables["users"].dtypes) == {"id": "int", "name": "string", "day": "date"}
    assert loaded.tables["users"].first().name == 'a, "b"'
    listed = list_columns(spark, loaded.tables)
    assert [r.column for r in listed.where("table = 'users'").orderBy("ordinal").collect()] == ["id", "name", "day"]
    typed = files.load_folder(spark, str(tmp_path), {"users": "id long, name string, day string"}, True)
    assert dict(typed.tables["users"].dtypes) == {"id": "bigint", "name": "string", "day": "string"}
    assert typed.tables["users"].count() == 2
    assert sample_rows(loaded.tables["nums"], 3).count() == 3
    assert sample_rows(spark.range(99), 50).count() == 50
    for limit in (0, 51, 500):
        with pytest.raises(ValueError):
            sample_rows(spark.range(99), limit)


def test_delimiters_and_headers(spark, tmp_path):
    (tmp_path / "semi.csv").write_text("a;b\n1;x,y\n2;z\n")
    (tmp_path / "bare.csv").write_text("1,2024-01-01\n2,2024-01-02\n")
    (tmp_path / "piped.csv").write_text('name|note\nx|"a|b"\n')
    (tmp_path / "tabs.tsv").write_text("k\tv\n1\ta,b;c\n")
    (tmp_path / "broken.csv").write_text('id,text\n1,"two\nlines"\n2,one\n')
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "lines.json").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "pretty.json").write_text('[\n {"a": 1},\n {"a": 2}\n]\n')
    tables = files.load_folder(spark, str(tmp_path)).tables
    rows = {name: sorted(map(tuple, df.collect())) for name, df in tables.items()}
    assert tables["semi"].columns == ["a", "b"] and rows["semi"] == [(1, "x,y"), (2, "z")]
    assert tables["bare"].columns == ["column0", "column1"] and len(rows["bare"]) == 2
    assert tables["piped"].columns == ["name", "note"] and rows["piped"] == [("x", "a|b")]
    assert rows["tabs"] == [(1, "a,b;c")]
    assert rows["broken"] == [(1, "two\nlines"), (2, "one")]
    assert rows["empty"] == []
    assert rows["lines"] == rows["pretty"] == [(1,), (2,)]


def test_layout_after_many_lines(spark, tmp_path):
    """Records that change from one to several lines, a header without a name for the first column, and headers over text."""
    records = [{"k": i, "t": '} { " \\ [ ' + str(i), "l": [i, {"m": "]"}]} for i in range(65)]
    (tmp_path / "mixed.json").write_text("\n".join([json.dumps(r) for r in records[:60]] + [json.dumps(r, indent=2) for r in records[60:]]) + "\n")
    (tmp_path / "side.json").write_text(json.dumps(records[0]) + json.dumps(records[1]) + "\n" + json.dumps(records[2], indent=1) + "\n" + json.dumps(records[3:5]) + "\n")
    (tmp_path / "frame.csv").write_text(",name,qty\n0,bolt,5\n1,nut,7\n")
    (tmp_path / "years.csv").write_text("place,2019,2020\n7,1,2\n8,3,4\n")
    (tmp_path / "late.csv").write_text("\n".join(["1,a"] * 60 + ["x,b"]) + "\n")
    (tmp_path / "semis.csv").write_text("\n".join(["a,b"] * 3 + [f"x{i};y,{i}" for i in range(90)]) + "\n")
    (tmp_path / "words.csv").write_text("bolt,red\nnut,blue\n")
    tables = files.load_folder(spark, str(tmp_path)).tables
    assert sorted(r["k"] for r in tables["mixed"].collect()) == list(range(65)) and tables["mixed"].columns == ["k", "l", "t"]
    assert {r["k"]: r["t"] for r in tables["mixed"].collect()} == {r["k"]: r["t"] for r in records}
    assert sorted(r["k"] for r in tables["side"].collect()) == [0, 1, 2, 3, 4]
    assert [tuple(r) for r in tables["frame"].orderBy("qty").collect()] == [(0, "bolt", 5), (1, "nut", 7)]
    assert tables["frame"].columns[1:] == ["name", "qty"] and dict(tables["frame"].dtypes)["qty"] == "int"
    assert tables["years"].columns == ["place", "2019", "2020"] and tables["years"].count() == 2
    assert tables["late"].count() == 61 and tables["late"].columns == ["column0", "column1"]
    assert tables["words"].columns == ["bolt", "red"]  # nothing tells, so the first line counts as a header
    words = str(tmp_path / "words.csv")
    assert files.read_file(spark, words, header=False).count() == 2
    assert files.read_file(spark, words, sep=";", header=False).columns == ["column0"]


@pytest.mark.parametrize(
    "head, kinds, header",
    [
        (["", "name", "qty"], ["number", "text", "number"], True), (["1", "2024-01-01"], ["number", "date"], False), (["a", "b"], ["text", "text"], True),
        (["a", ""], ["text", "text"], False), (["2019", "x"], ["number", "text"], False), (["2019", "x"], ["number", "truth"], True), (["a"], [None], True), (["1"], ["text"], False),
    ],
)
def test_first_line_against_the_kinds_below(head, kinds, header):
    assert layout.is_header(head, kinds) is header


def test_json_depths_are_added_up_over_splits(spark, tmp_path):
    records = [{"k": i, "v": ["x" * 50, {"w": "{[" * 5}]} for i in range(400)]
    (tmp_path / "long.json").write_text("\n".join(json.dumps(r, indent=2 if r["k"] % 3 else None) for r in records))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert spark.read.text(str(tmp_path / "long.json")).rdd.getNumPartitions() > 5
        assert sorted(r["k"] for r in files.read_file(spark, str(tmp_path / "long.json")).collect()) == list(range(400))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_file_added_below_a_table_changes_its_state(spark, tmp_path):
    path = tmp_path / "t.parquet"
    spark.range(4).selectExpr("id", "id % 2 as p").write.partitionBy("p").parquet(str(path))
    before = files.load_folder(spark, str(tmp_path)).fingerprints["t"]
    assert files.load_folder(spark, str(tmp_path)).fingerprints["t"] == before
    spark.range(2).write.mode("append").parquet(str(path / "p=1"))
    assert files.load_folder(spark, str(tmp_path)).fingerprints["t"] != before


def test_documents(spark, tmp_path):
    (tmp_path / "g.md").write_text("# Terms\nMRR = revenue")
    (tmp_path / "plain").write_text("tier")
    got = files.load_documents(spark, [str(tmp_path / "g.md"), str(tmp_path / "plain")])
    assert sorted(r.text for r in got.collect()) == ["# Terms\nMRR = revenue", "tier"]
    with pytest.raises(files.UnsupportedDocument, match="Export the sheet as CSV"):
        files.load_documents(spark, ["/x/g.xlsx"])
    with pytest.raises(files.UnsupportedDocument, match="Unsupported"):
        files.load_documents(spark, ["/x/g.png"])


def test_stored_output_is_reused_until_a_file_changes(spark, tmp_path):
    data, cache = tmp_path / "data", tmp_path / "cache"
    data.mkdir()
    (data / "users.csv").write_text("id,plan\n1,a\n2,b\n3,a\n4,b\n")
    (data / "pays.csv").write_text("id,user_id,amount\n1,1,2.5\n2,1,3.5\n3,4,1.0\n")
    first = prepare_folder(spark, str(data), str(cache))
    assert first.relationships.count() == 1
    assert [tuple(r) for r in first.metric("sum_amount", ("plan",)).collect()] == [("a", 6.0), ("b", 1.0)]
    stored = sorted(p.name for p in cache.iterdir())
    again = prepare_folder(spark, str(data), str(cache))
    assert sorted(p.name for p in cache.iterdir()) == stored
    assert again.model.measures.count() == first.model.measures.count()
    (data / "users.csv").write_text("id,plan\n1,a\n2,b\n3,a\n4,b\n5,c\n")
    assert prepare_folder(spark, str(data), str(cache)).profile.where("table = 'users'").first().row_count == 5
    assert len([p for p in cache.iterdir() if (p / "measures").exists()]) == 2
    assert artifacts.read_terms(spark, str(cache), "s") is None
    artifacts.write_terms(str(cache), "s", spark.range(2).selectExpr("id as term_id", "array(0.5f) as vector"))
    assert artifacts.read_terms(spark, str(cache), "s").count() == 2
    with pytest.raises(ValueError, match="no supported data files"):
        prepare_folder(spark, str(cache))


def test_only_changed_tables_are_read_again(spark, tmp_path, monkeypatch):
    """One of five files changes: the others are not read, and what comes out is what a fresh look at all of them gives."""
    data, cache = tmp_path / "data", tmp_path / "cache"
    data.mkdir()
    write = lambda name, rows: (data / f"{name}.csv").write_text("\n".join(rows) + "\n")
    write("areas", ["id,kind", *(f"{i},{'ab'[i % 2]}" for i in range(1, 9))])
    write("users", ["id,area_id,plan", *(f"{i},{i % 8 + 1},{'xyz'[i % 3]}" for i in range(1, 31))])
    write("pays", ["id,user_id,amount", *(f"{i},{i % 30 + 1},{i * 1.5}" for i in range(1, 60))])
    write("visits", ["id,user_id,area_id", *(f"{i},{i % 17 + 1},{i % 5 + 1}" for i in range(1, 40))])
    write("notes", ["note_id,area_id", *(f"{i},{i % 3 + 1}" for i in range(1, 12))])
    prepare_folder(spark, str(data), str(cache))
    write("visits", ["id,user_id,area_id", *(f"{i},{i % 29 + 1},{i % 8 + 1}" for i in range(1, 50))])

    scanned, measured = [], []
    profiled, overlaps = upkeep.profile_dataset, upkeep.rel.measure_overlap
    monkeypatch.setattr(upkeep, "profile_dataset", lambda spark, tables: scanned.extend(tables) or profiled(spark, tables))
    files_read = lambda df: {p.rsplit("/", 1)[-1] for p in df.inputFiles()}

    def watched(spark, tables, pairs):
        measured.extend(pairs)
        scanned.extend(name for df in tables.values() for name in files_read(df) if name.endswith(".csv"))
        return overlaps(spark, tables, pairs)

    monkeypatch.setattr(upkeep.rel, "measure_overlap", watched)
    again = prepare_folder(spark, str(data), str(cache))
    assert scanned == ["visits"] and measured and all("visits" in (a, c) for a, _, c, _ in measured)
    fresh = prepare_folder(spark, str(data), str(tmp_path / "other"))
    for part in ("profile", "relationships"):
        rows = [sorted(map(str, getattr(d, part).select(sorted(getattr(d, part).columns)).collect())) for d in (again, fresh)]
        assert rows[0] == rows[1] and rows[0]
    (data / "notes.csv").unlink()
    scanned.clear(), measured.clear()
    assert "notes" not in {r["table"] for r in prepare_folder(spark, str(data), str(cache)).profile.collect()}
    assert not scanned and not measured


def test_csv_export(spark, tmp_path):
    rows = [(1, 'a "q", b', None, 0.1 + 0.2, [1, 2]), (2, "", "x", 5.0, None), (3, "line\nbreak", "y", 1e21, [])]
    df = spark.createDataFrame(rows, "id int, `na,me` string, gone string, num double, list array<int>").coalesce(1)
    artifacts.export_csv(df, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.csv")).read_bytes().decode()
    assert text.split("\r\n")[0] == 'id,"na,me",gone,num,list'
    assert '1,"a ""q"", b",NULL,0.3,"[1,2]"\r\n' in text
    assert "2,,x,5,NULL\r\n" in text
    artifacts.export_csv(spark.createDataFrame([("  a  ",)], "s string").coalesce(1), str(tmp_path / "spaces"))
    assert next((tmp_path / "spaces").glob("*.csv")).read_text(newline="").split("\r\n")[1].strip('"') == "  a  "
    artifacts.export_json(df.drop("list"), str(tmp_path / "json"))
    first = json.loads(next((tmp_path / "json").glob("*.json")).read_text().splitlines()[0])
    assert first["gone"] is None and first["id"] == 1


# --- databases ---------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, url, user, password",
    [
        ("postgresql://ro:p%2Fw%3A1@10.1.2.3/ledger", "jdbc:postgresql://10.1.2.3/ledger", "ro", "p/w:1"),
        ("postgres://[::1]:6543/books?application_name=x", "jdbc:postgresql://[::1]:6543/books?application_name=x", None, None),
        ("postgres: port=7000 dbname=books user=\"two words\"", "jdbc:postgresql://localhost:7000/books", "two words", None),
        ("mysql://reader@warehouse/", "jdbc:mysql://warehouse/", "reader", None),
        ("MySQL://warehouse:3307/stock", "jdbc:mysql://warehouse:3307/stock", None, None),
        ("sqlite3:/tmp/x y.dat", "jdbc:sqlite:/tmp/x y.dat", None, None),
        ("  books/LEDGER.DB ", "jdbc:sqlite:books/LEDGER.DB", None, None),
    ],
)
def test_connections(text, url, user, password):
    spec = jdbc.parse_connection(text)
    options = spec.options()
    assert (options["url"], options.get("user"), options.get("password")) == (url, user, password)
    assert password is None or password not in spec.label + repr(spec)


@pytest.mark.parametrize("text", [" ", "books.txt", "mysql:", "postgres:// ", "mongodb://u:topsecret@h/db", "password=topsecret"])
def test_refused_connections(text):
    with pytest.raises(ValueError) as error:
        jdbc.parse_connection(text)
    assert "topsecret" not in str(error.value)


def test_database_tables_are_chosen():
    listed = [("public", "users"), ("pg_catalog", "pg_class"), ("crm", "users"), ("public", "a b")]
    chosen, skipped = jdbc.choose_tables(listed)
    assert [c[0] for c in chosen] == ["crm_users", "public_a_b", "public_users"]
    one, _ = jdbc.choose_tables(listed, schema="public")
    assert [c[0] for c in one] == ["a_b", "users"]
    alone, _ = jdbc.choose_tables(listed[:2])
    assert [c[0] for c in alone] == ["users"]
    _, left = jdbc.choose_tables(listed, max_tables=1)
    assert left == ["public.a b", "public.users"]


# --- read-only SQL -----------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "allowed"),
    [
        ("select 1", True), ("```sql\nselect 1\n```", True), ("with x as (select 1) select * from x", True),
        ("select ';drop table x'", True), ("select 1; select 2", True), ("show tables", True), ("explain select 1", True),
        ("describe select 1", True), ("from values (1) as t(a) select a", True), ("-- note; here\nselect 1", True),
        ("drop table x", False), ("with x as (select 1 a) insert into t select * from x", False),
        ("select 1; drop table t", False), ("set a=b", False), ("create view v as select 1", False), ("", False),
        ("selec 1", False), ("/* select */ delete from t", False), ("cache table x", False), ("use x", False),
        ("insert overwrite directory '/tmp/x' using json select 1", False), ("truncate table x", False),
        ("select transform (a) using 'cat' as (b) from t", False), ("from t insert into u select 1", False),
    ],
)
def test_read_only(spark, text, allowed):
    assert is_read_only(spark, text) is allowed


READING = (
    "select * from three", "select * from three where id in (select max(id) from three)", "select * from default.three",
    "with a as (select * from three) select * from a join three using (id)", "select * from three t, lateral (select t.id + 1 as x)",
    "select id, row_number() over (order by id) from three group by id having count(*) > 0 order by 1 limit 5", "from three |> where id > 1",
    "select * from three lateral view explode(array(1, 2)) t as x", "explain select * from three", "describe three", "show tables",
    "with recursive r(n) as (select 1 union all select n + 1 from r where n < 5) select * from r", "select * from three tablesample (5 rows)",
    "select identifier('up' || 'per')('a'), identifier('i' || 'd') from three", "select nvl(id, 1), ceil(id), round(id, 1), url_encode('a b'), to_json(struct(id)) from three",
    "select transform(array(id), x -> x + 1), aggregate(array(1, 2), 0, (a, x) -> a + x), map('a', 1)['a'], case when id > 1 then 'x' end from three",
    "select sum(id) over (order by id rows between 1 preceding and current row), percentile_approx(id, 0.5) over () from three",
    "select extract(year from date '2020-01-02'), trim(both 'x' from 'xax'), substring('abc' from 2), cast(id as string) || 'a', id between 1 and 2, 'a' like 'b%' from three",
    "select count(distinct id), count(*) filter (where id > 1), percentile_cont(0.5) within group (order by id), try_add(1, 2), parse_url('http://a/b', 'HOST') from three",
    "select current_date(), date_trunc('month', now()), system.builtin.abs(-1), typeof(1), current_user(), xpath_string('<a>1</a>', 'a'), variant_get(parse_json('{}'), '$.a') from three",
    "select * from three pivot (count(*) for id in (1, 2))", "select * from values (1, upper('a')) as t(a, b)", "select unknown_column from three",
)
ACTING = (
    "execute immediate 'drop view three'", "call foo()", "select reflect('java.lang.System', 'currentTimeMillis')",
    "select 1 where exists (select java_method('a', 'b'))", "with a as (select try_reflect('a', 'b') x) select * from a",
    "select * from csv.`/etc/passwd`", "select (select max(value) from text.`/etc/passwd`)", "with x as (select * from parquet.`/a`) select * from x",
    "describe csv.`/etc/passwd`", "explain drop view three", "describe query select reflect('a', 'b')", "select * from unknown_table",
    "select * from read_files('/etc/passwd')", "set a = b", "cache table three", "add jar 'x'", "declare x int", "begin select 1; end", "refresh table three",
    "select input_file_name() from three", "select no_such_function(1)", "select shouting('a')", "select default.shouting('a')", "select * from three lateral view reflect('a', 'b') t as x",
    "select identifier('shou' || 'ting')('a')", "select identifier(reflect('java.lang.System', 'getProperty', 'user.home')) from three", "select identifier(lower('UPPER'))('a')",
    "select * from values (reflect('java.lang.System', 'getProperty', 'user.home'))", "select from_avro(x, '{}') from (select binary('a') x)",
    "select * from three where transform(array(1), x -> java_method('a', 'b'))[0] = 'x'",
)
#: A function that runs JVM code, spelled so that no parsed node bears its name.
HIDDEN = "identifier('re' || 'flect')('java.lang.System', 'getProperty', 'user.home')"
ACTING += tuple(
    text.format(call=call)
    for call in (HIDDEN, HIDDEN.replace("'re' || 'flect'", "'reflect'"), HIDDEN.replace("'re' || 'flect'", "'ja' || 'va_' || 'method'"), HIDDEN.replace("'re' || 'flect'", "'system.builtin.' || 'reflect'"))
    for text in (
        "select {call}", "select id from three where {call} = 'x'", "select (select {call})", "select * from three where id in (select length({call}) from three)",
        "with a as (select {call} as x) select * from a", "select sum(id) over (partition by {call}) from three", "explain select {call}", "describe query select {call}",
        "select * from three order by {call}", "select transform(array(1), x -> {call})", "select count(*) from three group by {call} having max({call}) > 'a'",
        "select * from three t join three u on {call} = 'x'", "select * from values ({call})", "from three |> select {call}",
    )
)


@pytest.mark.parametrize("text, allowed", [(t, True) for t in READING] + [(t, False) for t in ACTING])
def test_only_reading_is_allowed(spark, text, allowed):
    spark.range(3).createOrReplaceTempView("three")
    assert is_read_only(spark, text) is allowed


def test_run_sql(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert run_sql(spark, "select count(*) as n from three;").first().n == 3
    with pytest.raises(NotReadOnly):
        run_sql(spark, "drop view three")
    assert split_statements("select 'it''s; ok' as \"a;b\"; -- x;\nselect `c;d` /* ; */ from t") == [
        "select 'it''s; ok' as \"a;b\"", "select `c;d`   from t",
    ]


# --- comparison and scoring ----------------------------------------------------------


BIG = 9_007_199_254_740_993  # not a double


@pytest.mark.parametrize(
    "expected, actual, equal",
    [
        # whole numbers, decimals and text are exact
        ([(BIG,)], [(BIG - 1,)], False),
        ([(BIG,)], [(str(BIG),)], True),
        ([("70000000001",)], [("70000000002",)], False),
        ([("007",)], [("7",)], False),
        ([(Decimal("12.340"),)], [(Decimal("12.34"),)], True),
        ([(Decimal("12.341"),)], [(Decimal("12.34"),)], False),
        ([(3e10 + 1,)], [(30_000_000_002,)], False),
        # fractions are close wherever they lie
        ([(100.0,)], [(99.99999999999999,)], True),
        ([(0.001, 1000.0)], [(0.0009999999999999998, 1000.0000000000001)], True),
        ([(0.1 + 0.2,), (0.7,)], [(0.7,), (0.3,)], True),
        ([(2.0,)], [(2.00001,)], False),
        ([(-1e-200,)], [(-1e-200 * (1 + 1e-15),)], True),
        ([(1e-12,)], [(2e-12,)], False),
        # one alignment of columns for all rows
        ([(1, 2), (1, 2)], [(1, 2), (2, 1)], False),
        ([(1, 2), (3, 4)], [(2, 1), (4, 3)], True),
        ([("x", 0.5), ("y", 1.5)], [(1.5, "x"), (0.5, "y")], False),
        # copies, nulls and odd numbers
        ([("a",), ("a",), ("b",)], [("a",), ("b",), ("b",)], False),
        ([(None, 1)], [(0, 1)], False),
        ([(None, 1.5)], [(None, 1.5)], True),
        ([(float("nan"), 1)], [(float("nan"), 1)], True),
        ([(float("inf"), 1)], [(float("-inf"), 1)], False),
        ([(True,)], [(False,)], False),
    ],
)
def test_comparison(spark, expected, actual, equal):
    names = [f"c{i}" for i in range(len(expected[0]))]
    kind = lambda rows, i: next((type(r[i]) for r in rows if r[i] is not None), int)
    sql = {int: "long", float: "double", str: "string", bool: "boolean", Decimal: "decimal(20,6)"}
    frames = [
        spark.createDataFrame(rows, ", ".join(f"{n} {sql[kind(rows, i)]}" for i, n in enumerate(names)))
        for rows in (expected, actual)
    ]
    found = compare.compare_rows(*frames).first()
    assert found.equal is equal and (found.detail == "") is equal


def most_pairs(expected, actual):
    """By all ways to pair rows off."""
    short, long = sorted((expected, actual), key=len)
    return max((sum(all(map(matching.close, a, b)) for a, b in zip(short, order)) for order in permutations(long, len(short))), default=0)


def test_matching_leaves_as_few_as_possible():
    rng = random.Random(7)
    for _ in range(600):
        base, columns = rng.choice([1.0, -3.7, 5e9, 1e-250]), rng.choice([1, 1, 2, 3])
        value = lambda: rng.choice([base * (1 + rng.randrange(8) * 0.45e-9), base * (1 + rng.randrange(8) * 0.45e-9), None if columns > 1 else base, base + 1])
        sides = [[tuple(value() for _ in range(columns)) for _ in range(rng.randrange(1, 6))] for _ in range(2)]
        counts = {r: (sides[0].count(r), sides[1].count(r)) for r in {*sides[0], *sides[1]}}
        rows = [(r, e, a) for r, (e, a) in counts.items()]
        left = matching.left_over(rows)
        pairs = most_pairs(*sides)
        assert sum(e for _, e, _ in left) == len(sides[0]) - pairs and sum(a for *_, a in left) == len(sides[1]) - pairs
        assert all(e <= counts[r][0] and a <= counts[r][1] for r, e, a in left)
        if columns == 1:  # both ways agree
            assert sum(e for _, e, _ in matching._augmented(rows)) == len(sides[0]) - pairs


def test_augmenting_takes_copies():
    step = 0.9e-9
    rows = [((1.0 + k * step, 2.0 + k % 2 * 2 * step), 1000 * (k % 3), 1000 * ((k + 1) % 3)) for k in range(30)]
    left = matching.left_over(rows)
    assert sum(e for _, e, _ in left) < sum(max(0, e - a) for _, e, a in rows)


CLOSE_ROWS = [
    ([(1.0,), (1 + 1.5e-9,)], [(1 + 0.8e-9,), (1 + 0.8e-9,)], True),
    ([(1.0,), (1 + 0.9e-9,)], [(1.0,), (1 - 0.9e-9,)], True),  # the equal rows must not be taken for each other
    ([(1.0,), (1 + 1.5e-9,)], [(1 + 0.8e-9,), (1 + 3e-9,)], False),
    ([(0.0, 5.5)] * 3, [(0.0, 5.5 * (1 + 1e-10))] * 3, True),
    ([(7e9 + 0.5,), (7e9 + 1.0,)], [(7e9 + 1.0,), (7e9 + 2.0,)], True),  # whole numbers only equal themselves, fractions either neighbour
    ([(7e9,), (7e9 + 1.0,)], [(7e9 + 1.0,), (7e9 + 2.0,)], False),
]


@pytest.mark.parametrize("expected, actual, equal", CLOSE_ROWS)
def test_pairs_under_tolerance(spark, expected, actual, equal):
    schema = ", ".join(f"c{i} double" for i in range(len(expected[0])))
    for a, b in ((expected, actual), (actual, expected)):
        assert compare.compare_rows(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).first().equal is equal


def test_many_rows_with_a_constant_first_column(spark):
    rows = spark.range(12_000).select(F.lit(0.0).alias("c"), F.lit(1.5).alias("d"), (F.col("id") * 1.1 + 1e6).alias("v"), (F.col("id") % 7 + 0.1).alias("w"), F.lit(2.5).alias("x"))
    moved = rows.withColumn("v", F.col("v") * (1 + F.lit(2e-13)))
    assert compare.compare_rows(rows, moved).first().equal
    found = compare.differences(rows, moved.withColumn("w", F.when(F.col("v") > 1e6 + 13_000, F.col("w") + 1).otherwise(F.col("w"))))
    assert found.agg(F.sum("expected"), F.sum("actual")).first() == (181, 181)


def test_what_differs_is_told(spark):
    a, b = spark.createDataFrame([(1, 8.25), (2, 0.5)], "k int, v double"), spark.createDataFrame([(1, 8.5), (2, 0.5), (3, 1.0)], "k int, v double")
    detail = compare.compare_rows(a, b).first().detail
    assert "row count differs by 1" in detail and "expected 1, 8.25" in detail and "got 1, 8.5" in detail
    assert compare.compare_rows(a, b.select("k")).first().detail == "column count 1, expected 2"
    assert compare.compare_rows(a, None).first().detail == "no result rows"
    assert compare.compare_rows(a.limit(0), a.limit(0)).first().equal


def test_no_copies_are_left_behind(spark):
    def files_below():
        return {str(p) for p in pathlib.Path(shared_dir(spark).removeprefix("file:")).iterdir()}

    before = files_below()
    a = spark.range(20)
    assert compare.compare_rows(a, a, ["id"]).first().equal
    b = a.selectExpr("id + 0.5D as v")
    assert compare.compare_rows(b, b.selectExpr("v * (1 + 1e-12) as v")).first().equal
    assert not compare.compare_rows(b, b.selectExpr("v + 1 as v")).first().equal
    assert files_below() == before


def test_ordered_comparison(spark):
    a = spark.createDataFrame([(i, i * 1.5) for i in range(50)], "n int, v double").repartition(6)
    b = a.select("v", "n").repartition(3)
    assert compare.compare_rows(a, b, ["n"]).first().equal
    assert compare.compare_rows(a, b, ["-n"]).first().equal
    turned = a.selectExpr("n", "49 * 1.5 - v as v")
    assert not compare.compare_rows(a, turned, ["n"]).first().equal
    assert not compare.compare_rows(a, a.where("n < 49"), ["n"]).first().equal


def test_arms(spark):
    rows = [
        ("g", "c1", "baseline", 1, True, False, 2, 0, False), ("g", "c1", "baseline", 2, True, False, 3, 1, False),
        ("g", "c2", "probe", 1, True, False, 4, 0, True), ("g", "c2", "probe", 2, False, False, 6, 2, False),
        ("p", "c1", "baseline", 1, False, False, 9, 0, False), ("p", "c2", "probe", 1, False, True, 5, 0, False),
    ]
    runs = spark.createDataFrame(
        rows, "arm string, case string, trap string, run int, pass boolean, error boolean, steps int, corrections int, budget_exhausted boolean"
    )
    cases = scoring.strict_cases(runs)
    arms = {r.arm: r for r in scoring.compare_arms(cases).collect()}
    assert (arms["g"].runs_passed, arms["g"].runs_total, arms["g"].cases_passed, arms["g"].mean_steps) == (3, 4, 1, 4.5)
    assert (arms["g"].budget_hits, arms["g"].controls_failed) == (1, 0)
    assert (arms["p"].runs_passed, arms["p"].runs_total, arms["p"].controls_failed) == (0, 2, 1)
    assert scoring.arm_delta(scoring.compare_arms(cases), "g", "p").first().delta_points == 75.0
    shown = {r["case"]: (r.first_tally, r.second_tally) for r in scoring.case_tallies(cases, "g", "p").collect()}
    assert shown == {"c1": ("2/2", "0/1"), "c2": ("1/2", "error")}
    assert {r.arm: (r.passed, r.failed, r.errored) for r in scoring.tally(cases, "arm").collect()} == {"g": (1, 1, 0), "p": (0, 1, 1)}


def test_behavior(spark):
    runs = spark.createDataFrame(
        [(1, ["run_sql"], 9, ["query_metric"], ["run_sql"], 1), (2, ["query_metric"], 3, ["query_metric"], None, 3), (3, [], 2, None, None, None)],
        "run_id int, used array<string>, steps int, required array<string>, forbidden array<string>, max_steps int",
    )
    got = [(r.run_id, r.violation) for r in scoring.behavior_violations(runs).collect()]
    assert sorted(got) == [(1, "did not use query_metric"), (1, "took 9 steps, budget 1"), (1, "used run_sql")]

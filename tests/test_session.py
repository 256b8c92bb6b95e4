import os

import duckdb
import pytest

from tablelore import session
from tablelore.operators.profile import profile_dataset
from tablelore.plans import workload
from tablelore.plans.oracles import ORACLES
from tools.check_queries import rows_of

#: Queries that a path without a scheme failed on a cluster.
WRITING = """E1_differences E1_matching E2_ordered E3_suite G2_grounded G3_descriptions G4_synonyms G5_applied G5_resolve L12_drill_across M1_entities M2_synonyms
M3_key_columns M5_measures M4_dimensions M6_measure_names M7_associations M8_model M9_fan_out P1_nulls P2_distinct P2_prefilter""".split()


def star_columns():
    """Rows of every table that the registered queries read, and the columns by ``id``."""
    one = lambda *texts: f"element_at(array({', '.join(map(repr, texts))}), cast(id % {len(texts)} + 1 as int))"
    day = "timestamp_seconds(788918400 + id * 86400)"
    return {
        "region": (3, "cast(id as int) r_regionkey, concat('Area ', id) r_name"),
        "nation": (6, "cast(id as int) n_nationkey, concat('Land ', id) n_name, cast(id % 3 as int) n_regionkey"),
        "customer": (20, f"id c_custkey, concat('Buyer ', id) c_name, cast(id % 6 as int) c_nationkey, id * 7.25D c_acctbal, {one('BUILDING', 'MACHINERY')} c_mktsegment"),
        "supplier": (5, "id s_suppkey, concat('Seller ', id) s_name, cast(id as int) s_nationkey, id * 3.5D s_acctbal"),
        "part": (12, "id p_partkey, concat('Thing ', id) p_name, concat('Brand ', id % 4) p_brand, concat('Type ', id % 3) p_type, cast(id % 5 as int) p_size, 10D + id p_retailprice"),
        "orders": (
            60,
            f"id o_orderkey, id * 7 % 20 o_custkey, {one('O', 'F')} o_orderstatus, 100.5D + id * 13 o_totalprice, {day} o_orderdate,"
            f" {one('1-URGENT', '3-MEDIUM', '5-LOW')} o_orderpriority",
        ),
        "lineitem": (
            150,
            "id % 60 l_orderkey, id % 12 l_partkey, id % 5 l_suppkey, cast(id div 60 + 1 as int) l_linenumber, cast(id % 9 + 1 as double) l_quantity, 20D + id l_extendedprice,"
            f" id % 3 * 0.25D l_discount, id % 2 * 0.5D l_tax, {one('A', 'N', 'R')} l_returnflag, {one('O', 'F')} l_linestatus, {day} l_shipdate",
        ),
        "events": (80, f"id event_id, {day} ts, id * 3 % 20 user_id, {one('view', 'click', 'purchase')} event_type, id * 1.5D value, concat('p', id % 7) props"),
        "documents": (9, "id doc_id, concat('text ', id) text, 'en' lang, 'web' source, 6L n_chars"),
        "embeddings": (8, "id vec_id, array(cast(id as float), 0.5F) embedding, cast(id % 2 as int) label"),
        "pages": (7, "id page_id, concat('http://a.example/', id) url, concat('<p>', id) html"),
        "benchmark": (4, "id item_id, concat('item ', id) text"),
        "labels": (9, "id doc_id, cast(id % 2 as int) quality, 0 toxic"),
        "conversations": (10, "id div 2 conv_id, id % 2 turn, 'user' role, concat('says ', id) text"),
    }


@pytest.fixture(scope="module")
def star_folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("star")
    for name, (rows, columns) in star_columns().items():
        spark.sql(f"select {columns} from range(0, {rows}, 1, 1)").write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def on_cluster(spark, tmp_path_factory):
    """Intermediates go where a cluster's path without a scheme leads; what the queries share is made there too."""
    cluster, given, inner = Cluster(spark, str(tmp_path_factory.mktemp("checkpoints"))), [], session.shared_dir

    def shared_dir(_):
        given.append(inner(cluster))
        return given[-1]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(session, "shared_dir", shared_dir)
        yield given


class Cluster:
    """The session of the tests, as a cluster's with its own checkpoint folder; ``lost`` rows do not reach it."""

    def __init__(self, spark, folder, lost=0):
        self._spark, self._lost = spark, lost
        self.conf = type("Conf", (), {"get": lambda _, key, default=None: {"spark.checkpoint.dir": folder}.get(key, default)})()
        inner = spark.sparkContext
        self.sparkContext = type("Context", (), {"master": "spark://elsewhere:7077", "__getattr__": lambda _, name: getattr(inner, name)})()

    def __getattr__(self, name):
        return getattr(self._spark, name)

    def range(self, *args):
        return self._spark.range(*args).where(f"id >= {self._lost}")


def test_a_path_without_scheme_serves_if_it_is_shared(spark, tmp_path):
    cluster = Cluster(spark, str(tmp_path))
    assert session.shared_dir(cluster) == f"file://{tmp_path}"
    assert os.listdir(tmp_path) == []
    assert session.shared_dir(Cluster(spark, str(tmp_path), lost=1)) == f"file://{tmp_path}"  # tried out once


def test_results_are_written_there(spark, tmp_path, monkeypatch):
    cluster = Cluster(spark, str(tmp_path))
    monkeypatch.setattr(session, "shared_dir", lambda _, inner=session.shared_dir: inner(cluster))
    tables = {"t": spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k long, v string")}
    rows = profile_dataset(spark, tables).select("column", "row_count", "null_count", "distinct_count").collect()
    assert sorted(map(tuple, rows)) == [("k", 3, 0, 2), ("v", 3, 2, 1)]
    assert any(name.startswith("profile-") for name in os.listdir(tmp_path))


def test_a_folder_of_each_machine_is_refused(spark, tmp_path):
    """As if one task had written to the disk of another machine."""
    with pytest.raises(RuntimeError, match="folder of each machine"):
        session.shared_dir(Cluster(spark, str(tmp_path), lost=1))
    assert os.listdir(tmp_path) == []


def test_a_folder_that_cannot_be_written_is_refused(spark, tmp_path):
    (tmp_path / "taken").write_text("a file")
    with pytest.raises(RuntimeError, match="cannot write"):
        session.shared_dir(Cluster(spark, str(tmp_path / "taken")))
    assert session.shared_dir(Cluster(spark, f"file:{tmp_path}/mounted")) == f"file:{tmp_path}/mounted"


@pytest.mark.parametrize("name", WRITING)
def test_queries_write_there(spark, star_folder, on_cluster, name):
    db = duckdb.connect()
    for table in star_columns():
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{star_folder}/{table}.parquet/*.parquet'")
    found = workload.QUERIES[name](spark, str(star_folder))
    told = db.execute(ORACLES[name])
    names = [column[0] for column in told.description]
    assert rows_of(found.columns, found.collect()) == rows_of(names, told.fetchall())
    assert sorted(found.columns) == sorted(names)
    assert on_cluster[-1].startswith("file://")

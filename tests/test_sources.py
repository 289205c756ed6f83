import duckdb
import pytest

from commweave.functions.synth import Generator, synth_updates
from commweave.sources import text


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def write(tmp_path, name, body):
    path = tmp_path / name
    path.write_text(body)
    return str(path)


def test_edge_list(spark, tmp_path):
    got = text.read_edge_list(spark, write(tmp_path, "g", "3 2\n0 1\n 1\t2 9\n\n"))
    assert [tuple(r) for r in got.collect()] == [(0, 1), (1, 2)]
    assert text.read_edge_list(spark, write(tmp_path, "h", "0 1\n1 2\n"), header=False).count() == 2


@pytest.mark.parametrize("body", ["a b\n0 1\n", "3 2\n", "3 2\n0 1\n2\n", "", "1\n0 1\n"])
def test_bad_edge_lists(spark, tmp_path, body):
    with pytest.raises(text.FormatError):
        text.read_edge_list(spark, write(tmp_path, "g", body)).count()


def test_membership(spark, tmp_path):
    get = lambda body, n: sorted(map(tuple, text.read_membership(spark, write(tmp_path, "m", body), n).collect()))
    assert get("# c\n0 5\n\n2 6\n1 5\n", 3) == [(0, 5), (1, 5), (2, 6)]
    assert get("7\n8\n9\n", 3) == [(0, 7), (1, 8), (2, 9)]
    assert get("7\n1 8\n9\n", 3) == [(0, 7), (1, 8), (2, 9)]


def test_membership_by_original_id(spark, tmp_path):
    ids = spark.createDataFrame([(10, 0), (20, 1), (700, 2)], "orig long, v long")
    read = lambda body: sorted(map(tuple, text.read_membership(spark, write(tmp_path, "m", body), 3, ids).collect()))
    assert read("700 4\n10 9\n20 9\n") == [(0, 9), (1, 9), (2, 4)]
    for bad in ("700 4\n10 9\n", "700 4\n10 9\n20 9\n30 1\n", "700 4\n10 9\n20 9\n20 9\n", "700 4\n10 9\n5\n20 9\n"):
        with pytest.raises(text.FormatError):
            read(bad)
    assert text.communities_named(spark.createDataFrame([(0, 9), (1, 4)], "v long, c long")).first()["num"] == 10


@pytest.mark.parametrize("body", ["", "# only\n", "0 1\nx y\n1 1\n", "0 1\n5 1\n", "0 1\n0 1\n1 1\n", "0 1\n"])
def test_bad_memberships(spark, tmp_path, body):
    with pytest.raises(text.FormatError):
        text.read_membership(spark, write(tmp_path, "m", body), 2)


def test_trace(spark):
    got = text.parse_trace(lines(spark, ["1,2;3", "# x", "% y", "", "  4 5", "4 9", "a 1", "1 b", "1", "1 2 0", "1 2 z", "1 2 99999999999", "-1 2"]), 9)
    assert [tuple(r)[1:] for r in got.collect()] == [(1, 2, 3), (4, 5, 1), (1, 2, 1), (1, 2, 1), (1, 2, 1)]


def test_membership_sink(spark, tmp_path):
    text.write_membership(spark.createDataFrame([(2, 0), (1, 5)], "v long, c long"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).collect()[0][0] == "1,5"


def test_synthetic_updates(spark):
    rows = synth_updates(spark, 150, 1000, epoch=1, share=1000).collect()
    assert len(rows) == 15 and all(r["op"] == "INSERT" and 0 <= r["src"] < r["dst"] < 150 and 1 <= r["weight"] <= 8 for r in rows)
    few = synth_updates(spark, 150, 5, epoch=2).collect()
    assert len(few) == 5 and all(r["src"] < r["dst"] for r in few)
    assert synth_updates(spark, 1, 5).count() == 0 and synth_updates(spark, 10, 0).count() == 0
    g = Generator(1)
    assert g.below(2**64) == 5180492295206395165


def test_queries_match_sql(spark):
    from commweave.plans.catalog import QUERIES
    from commweave.plans.oracle import ORACLE_SQL

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    show = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    assert set(ORACLE_SQL) <= set(QUERIES)
    for name in ("edge_scan", "membership_check", "trace_parse", "community_spans", "best_move", "best_move_directed", "refine_move", "merged_totals", "quality_report", "contract_edges", "pack_communities", "delta_sample", "remote_notifications", "stream_affected"):
        df = QUERIES[name](spark, sf)
        columns = sorted(df.columns)
        want = sorted(tuple(map(show, r)) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall())
        assert sorted(tuple(map(show, r)) for r in df.select(*columns).collect()) == want, name

from commweave.__main__ import main
from commweave.functions.ship import ship


def test_run(spark, tmp_path, capsys):
    ship(spark)
    pairs = [(10 * g + i, 10 * g + j) for g in range(2) for i in range(4) for j in range(4) if i != j] + [(0, 10), (10, 0)]
    (tmp_path / "g.txt").write_text(f"8 {len(pairs)}\n" + "".join(f"{a} {b}\n" for a, b in pairs))
    main([str(tmp_path / "g.txt"), "--rounds", "2", "--levels", "1", "--sub-rounds", "4", "--out", str(tmp_path / "out")])
    rows = dict(tuple(r) for r in spark.read.schema("v long, c long").csv(str(tmp_path / "out")).collect())
    assert len(rows) == 8 and len({rows[i] for i in range(4)}) == 1 and rows[0] != rows[10]
    assert "communities" in capsys.readouterr().out

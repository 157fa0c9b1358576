import json

from loomwork import cli
from loomwork.server import answer

SOURCE = 'schema Item { id: unique int in 1..50, kind: "a" | "b" assume id > 0 } dataset D { items: 20 of Item, validate { count(items) == 20 } }'


def test_generate_check_describe_export(spark, tmp_path, capsys):
    (tmp_path / "d.txt").write_text(SOURCE)
    assert cli.main(["generate", str(tmp_path / "d.txt"), "--out", str(tmp_path / "out"), "--format", "parquet", "--seed", "3"]) == 0
    spark.read.parquet(str(tmp_path / "out/items")).write.parquet(str(tmp_path / "in/items.parquet"))
    assert cli.main(["check", str(tmp_path / "d.txt"), "--data", str(tmp_path / "in")]) == 0
    (tmp_path / "bad.txt").write_text(SOURCE.replace("id > 0", "id > 30"))
    assert cli.main(["check", str(tmp_path / "bad.txt"), "--data", str(tmp_path / "in")]) == 1
    capsys.readouterr()
    assert cli.main(["describe", str(tmp_path / "in")]) == 0 and "schema Item" in capsys.readouterr().out
    assert cli.main(["export", str(tmp_path / "d.txt")]) == 0 and "Item" in json.loads(capsys.readouterr().out)["components"]["schemas"]


def test_server(spark):
    assert answer(spark, SOURCE, "/")[1] == {"collections": ["items"]}
    assert len(answer(spark, SOURCE, "/items")[1]) == 20 and answer(spark, SOURCE, "/items/3")[0] == 200
    assert answer(spark, SOURCE, "/none")[0] == answer(spark, SOURCE, "/items/99")[0] == 404

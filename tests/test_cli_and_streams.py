"""The command line on small files and the streaming forms."""

import json
import pathlib

from pyspark.sql import functions as F

from gridwright.__main__ import main
from gridwright.streaming import filings

HTML = "<html><body><table><tr><td>x</td><td>2020</td></tr><tr><td>a</td><td>1,000</td></tr></table></body></html>"


def texts(path):
    return [p.read_text().rstrip("\n") for p in sorted(pathlib.Path(path).rglob("part-*"))]


def test_extract_and_replay(spark, tmp_path):
    (tmp_path / "f.htm").write_text(HTML)
    main(["extract", str(tmp_path), "--output", str(tmp_path / "out")])
    assert texts(tmp_path / "out") == ["x,2020\na,1000"]
    (tmp_path / "t.csv").write_text("h,i\n1,2\n")
    (tmp_path / "log_one.json").write_text('[{"fileName":"t.csv","action":"edit","details":{"row":1,"col":1,"newVal":"9"}}]')
    main(["replay", str(tmp_path), str(tmp_path), "--output", str(tmp_path / "edited")])
    assert texts(tmp_path / "edited") == ["h,i\n1,9"] and (tmp_path / "edited" / "folder=one").exists()


def test_stream_of_edits_keeps_state(spark, tmp_path):
    """The second batch starts from what the first one left; files without an edit aren't written."""
    details = "row long, col long, oldVal string, newVal string, index long, amount long, isRow boolean"
    schema = f"fileName string, seq long, action string, details struct<{details.replace(' ', ':', 0)}>".replace("struct<row long, col long, oldVal string, newVal string, index long, amount long, isRow boolean>", "struct<row:bigint,col:bigint,oldVal:string,newVal:string,index:bigint,amount:bigint,isRow:boolean>")
    targets = spark.createDataFrame([("f", ["h", "i"], [["1", "2"]]), ("g", ["h", "i"], [["3", "4"]])], "fileName string, header array<string>, grid array<array<string>>")
    edit = lambda seq, col, new, old=None: ("f", seq, "edit", (1, col, old, new, None, None, None))

    def batch(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        assert filings.replay_stream(targets, stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)

    batch(edit(1, 0, "A"))
    batch(edit(2, 1, "B", "2"), edit(3, 0, "C", "x"))
    got = {r.epoch: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[0].grid == [["A", "2"]] and got[1].grid == [["C", "B"]] and got[1].mismatched == 1 and len(got) == 2


def test_stream_of_pages(spark, tmp_path):
    spark.createDataFrame([(7, "u", HTML)], "page_id long, url string, html string").write.parquet(str(tmp_path / "in"))
    made = filings.extract_stream(filings.filings_stream(spark, str(tmp_path / "in")))
    q = made.select("doc_id", "tid", F.size("grid").alias("n")).writeStream.format("memory").queryName("tables").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("tables").collect()] == [("7", 1, 2)]


def test_random_logs(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.csv").write_text("h,i\n1,2\n3,4\n")
    main(["random-edits", str(tmp_path), "--output", str(tmp_path / "logs"), "--logs", "3", "--count", "20", "--tables", "2"])
    logs = [json.loads(t) for t in texts(tmp_path / "logs")]
    assert [len(x) for x in logs] == [20] * 3 and {e["fileName"] for x in logs for e in x} == {"a", "b"}


def test_score_of_files(spark, tmp_path, capsys):
    for folder, value in (("p", "1"), ("t", "2")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.csv").write_text(f"h,i\n{value},2\n")
        (tmp_path / folder / "x.htm").write_text(HTML)
    main(["score", str(tmp_path / "p" / "x.csv"), str(tmp_path / "t" / "x.csv")])
    assert "|x   |1       |" in capsys.readouterr().out
    main(["score", str(tmp_path / "p" / "x.htm"), str(tmp_path / "t" / "x.htm"), "--metric", "tree"])
    assert "|x   |1.0 |" in capsys.readouterr().out

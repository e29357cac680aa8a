import json
import sys
import types

from pyspark.sql import functions as F

from quillstone.__main__ import main
from quillstone.sources import files


def test_commands_from_files_to_relations(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "in").mkdir()
    store = f"--store={tmp_path}/store"
    assert main([store, "ingest", str(tmp_path / "in"), "--kind=txt"]) == 1
    assert main([store, "extract", "--model=fake_model:call"]) == 1
    assert main([store, "relationships"]) == 1
    assert main([store, "priority", "1.txt:1", "--model=fake_model:call"]) == 1
    for k in (1, 2):
        (tmp_path / "in" / f"{k}.txt").write_text(f"report {k}: the revenue was {k}00 in all\fnothing")
    fact = {"entity": "Acme", "metric": "revenue", "fact_type": "numeric", "period_label": "FY24"}
    model = types.ModuleType("fake_model")
    model.call = lambda p: json.dumps([fact | {"value": f"{k}00", "quote": f"the revenue was {k}00 in all"} for k in (1, 2) if f"report {k}:" in p])
    monkeypatch.setitem(sys.modules, "fake_model", model)
    (tmp_path / "own.TXT").write_text("quite another text of it")
    assert main([store, "ingest", str(tmp_path / "in"), str(tmp_path / "own.TXT"), str(tmp_path / "no.csv"), "--kind=txt"]) == 0
    told = capsys.readouterr()
    assert "no.csv" in told.err and "own.TXT" in told.out
    assert main([store, "stats"]) == 0
    assert main([store, "pages", "none"]) == 1
    assert main([store, "priority", "1.txt:1", "none.txt:4", "--model=fake_model:call"]) == 0
    told = capsys.readouterr()
    assert "none.txt is not ingested" in told.err and "chunks processed: 1   calls: 1   facts: 1   rejections: 0" in told.out
    assert main([store, "extract", "--model=fake_model:call"]) == 0
    assert "chunks processed: 3   calls: 2   facts: 2   rejections: 0" in capsys.readouterr().out
    assert main([store, "relationships"]) == 0
    out = capsys.readouterr().out
    assert "2 facts analysed, 1 relationships found" in out and out.index("corroboration: 0") < out.index("contradiction: 1") < out.index("=== CONTRADICTION (1) ===")
    found = files.read_files(spark, str(tmp_path / "in"), "*.txt")
    saved = files.save_uploads(found, str(tmp_path / "up")).collect()
    assert len(saved) == 2 and all(r["file_path"].endswith(f"{r['doc_id']}.txt") for r in saved)
    assert spark.read.parquet(f"{tmp_path}/store/rejections").where(F.col("stage").isNotNull()).count() == 0

"""Jobs from files: inheritance, dependencies, parameters, output to the console."""

import json

from weftline.__main__ import parse, run
from weftline.sources import Catalog


def test_parse():
    assert parse(["j.json", "--k__gte", "5", "--@limit=3", "-o", "-", "--@show"]) == ("j.json", {"k__gte": "5", "@limit": 3, "@output": "-", "@show": True})


def test_run_with_dependencies(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("WEFT_DIR", str(tmp_path))
    (tmp_path / "in.json").write_text(json.dumps([{"id": i, "v": i * 1.5} for i in range(6)]))
    (tmp_path / "base.json").write_text(json.dumps({"databases": [{"name": "d", "driver": "json", "path": "${WEFT_DIR}"}, {"name": "p", "driver": "parquet", "path": "${WEFT_DIR:x}"}]}))
    base = str(tmp_path / "base.json")
    (tmp_path / "first.json").write_text(json.dumps({"extends": [base], "name": "first", "input": "<<&.d.in::id", "output": ">>&.p.kept::id use UI", "querys": {"id": {">=": 0}}, "schema": {"id": "$.id", "v": "$.v"}}))
    (tmp_path / "second.yaml").write_text(f'extends: ["{base}"]\nname: second\ndependencys: [["{tmp_path}/first.json", {{"id__gte": 2}}]]\ninput: "<<&.p.kept::id"\noutput: ">>&.p.sums use I"\nschema:\n  n:\n    "#aggregate": ["all", ["@add", "$.n", 1]]\n')
    catalog = Catalog(spark)
    done = run(spark, str(tmp_path / "second.yaml"), {}, catalog)
    assert [d["job"] for d in done] == ["first", "second"]
    assert catalog.read("p.sums").collect()[0]["n"] == 4
    run(spark, str(tmp_path / "first.json"), {"@output": "-", "@limit": 2}, Catalog(spark))
    assert "|id" in capsys.readouterr().out.replace(" ", "")

import json

import pytest

from terrace import cli
from terrace.plans import identity


def test_info_and_wrong_use(capsys):
    assert cli.main(["info"]) == 0
    assert "t1_analysis" in json.loads(capsys.readouterr().out)["queries"]
    assert cli.main(["run", "nothing", "/tmp"]) == 2
    with pytest.raises(SystemExit) as wrong:
        cli.main(["dance"])
    assert wrong.value.code == 2


def test_snapshots(spark, tmp_path, capsys):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.jsonl").write_text('{"k": 1}\n')
    root = str(tmp_path / "store")
    assert cli.main(["snapshot", "register", "d", str(source), "--root", root, "--collected", "2026-01-02"]) == 0
    assert json.loads(capsys.readouterr().out)["rows"] == 1
    assert cli.main(["snapshot", "verify", "d", "--root", root]) == 0
    made = identity.SnapshotStore(root).list()[0]
    (tmp_path / "store" / "d" / made.snapshot_id / "a.jsonl").write_text("")
    assert cli.main(["snapshot", "verify", "d", "--root", root]) == 1

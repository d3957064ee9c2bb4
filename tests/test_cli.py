import os

import pytest

from passagework import cli, config


def test_cost_and_query(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# Title\n\nEither party may terminate.\n\n## Payment\n\nInvoices are net thirty.")
    (tmp_path / "b.txt").write_text("Apples and pears.")
    blocks = cli.read_folder(spark, f"file://{tmp_path}", ".txt", None)
    assert {r.strategy for r in cli.cost(blocks, ["fixed", "parent-doc"], "m").collect()} == {"fixed", "parent-doc", "TOTAL"}
    first = cli.ask(blocks, "when are invoices due, net thirty?", ["parent-doc"], 2).first()
    assert "Invoices" in first.preview and first["rank"] == 0
    flat = cli.read_folder(spark, f"file://{tmp_path}", ".txt", None, "flat")
    assert {r.type for r in flat.collect()} == {"paragraph"} and cli.read_folder(spark, f"file://{tmp_path}", ".txt", None, "passagework.cli:flat_parser").count() == flat.count()
    assert cli.ask(blocks, "x", ["fixed"], 1, lambda texts: [[1.0] for _ in texts]).first().score == 1
    for arguments in (["query", str(tmp_path), "q"], ["cost", str(tmp_path), "--parser", "other"]):
        with pytest.raises(SystemExit):
            cli.run(arguments)


def test_env(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# x\nPW_A='1'\nexport PW_B=2\n")
    (tmp_path / "sub").mkdir()
    monkeypatch.setenv("PW_B", "kept")
    monkeypatch.delenv("PW_A", raising=False)
    assert config.load_env(tmp_path / "sub") == tmp_path / ".env" and os.environ["PW_A"] == "1" and os.environ["PW_B"] == "kept"
    monkeypatch.delenv("PW_A")

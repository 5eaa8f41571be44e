"""The vault end to end on a small folder."""

from datetime import datetime

from recallium.store import Vault


def test_a_vault_from_index_to_backup(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "decision-db.md").write_text("# Database\nWe decided to use parquet tables for storage and search.")
    (notes / "handoff.md").write_text("# Handoff\nThe search index was rebuilt; ranking remains.")
    (notes / "other.md").write_text("A note about gardens and rivers.")
    vault = Vault(spark, str(tmp_path / "vault"), datetime(2025, 1, 1))
    assert vault.search("search").count() == 0
    assert vault.index(str(notes), "notes") == {"insert": 3}
    assert vault.index(str(notes), "notes") == {"unchanged": 3}
    found = [r["path"] for r in vault.search("search").collect()]
    assert set(found) == {"decision-db.md", "handoff.md"}
    assert [r["path"] for r in vault.vsearch("a note about gardens and rivers.", 1).collect()] == ["other.md"]
    assert "handoff.md" in [r["path"] for r in vault.query("search index").collect()]
    ids = {r["path"]: r["id"] for r in vault.table("documents").collect()}

    (notes / "other.md").unlink()
    (notes / "handoff.md").write_text("# Handoff\nAll done.")
    assert vault.index(str(notes), "notes") == {"deactivate": 1, "update": 1, "unchanged": 1}
    assert vault.get("memory://notes/handoff.md", 2, 1).first()["body"] == "All done."
    assert vault.get("other.md").count() == 0

    vault.pin(ids["decision-db.md"])
    vault.snooze(ids["handoff.md"], "2030-01-01")
    assert vault.search("done").count() == 0
    vault.snooze(ids["handoff.md"], None)
    assert vault.search("done").count() == 1
    assert [r["title"] for r in vault.timeline(ids["handoff.md"]).collect()] == ["Database"]
    assert vault.build_graphs(0.1)["temporal"] == 1
    assert {r["doc_id"]: r["depth"] for r in vault.related(ids["handoff.md"], 1, "temporal").collect()} == {ids["handoff.md"]: 0, ids["decision-db.md"]: 1}

    vault.add_fact("db", "is", "parquet", "2024-01-01")
    vault.add_fact("db", "is", "parquet", "2024-06-01")
    vault.end_fact("db", "is", "parquet", "2024-12-01")
    assert vault.facts("db", "2024-07-01").count() == 1 and vault.facts("db").count() == 0
    vault.write_diary("a", "entry")
    assert vault.diary("a").first()["entry"] == "entry" and vault.diary("b").count() == 0
    vault.log_session("s", "2025-01-01 10:00:00")
    vault.log_session("s", "2025-01-01 10:00:00", "2025-01-01 10:30:00")
    assert [r["minutes"] for r in vault.sessions().collect()] == [30.0]

    vault.touch([ids["handoff.md"]])
    later = Vault(spark, str(tmp_path / "vault"), datetime(2026, 1, 1))
    assert [r["id"] for r in later.sweep(30).collect()] == [ids["handoff.md"]]
    assert [r["id"] for r in later.sweep(30, dry_run=False).collect()] == [ids["handoff.md"]]
    assert later.search("done").count() == 0
    later.restore()
    assert later.search("done").count() == 1
    later.forget(ids["handoff.md"])
    row = later.status().first()
    assert (row["total"], row["active"], row["pinned"], row["archived"]) == (3, 1, 1, 0)
    later.backup(str(tmp_path / "copy"))
    assert Vault(spark, str(tmp_path / "copy"), datetime(2026, 1, 1)).table("documents").count() == 3
    later.export(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1

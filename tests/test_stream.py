"""Documents that arrive in a folder."""

from __future__ import annotations

from assayspark.operators.extract import measurements, metabolite_counts
from assayspark.streaming.ingest import ingest, stored
from tests.test_assay_documents import text


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text(text())
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    t = stored(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in metabolite_counts(measurements(t)).collect()} == {("m1", 1, 1, 2), ("m2", 1, 1, 1)}
    (tmp_path / "in/later").mkdir()
    (tmp_path / "in/later/b.TXT").write_text(text().replace("ST000001", "ST000009").replace("AN000001", "AN000009"))
    (tmp_path / "in/c.dat").write_text(text())
    for _ in range(2):  # a batch of its own, and none
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    t = stored(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in metabolite_counts(measurements(t)).collect()} == {("m1", 2, 2, 4), ("m2", 2, 2, 2)}

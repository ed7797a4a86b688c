"""A workspace from import to export."""

from __future__ import annotations

import io
import json
import zipfile

import pytest

from lumberline.operators.line_filters import SearchFilters
from lumberline.workspace import Workspace


def test_import_search_page_export(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "app.log").write_text("2024-01-01 10:00:00 [ERROR] down\n2024-01-01 10:01:00 [INFO] up\n")
    (src / "copy.log").write_text("2024-01-01 10:00:00 [ERROR] down\n2024-01-01 10:01:00 [INFO] up\n")
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("in/sys.log", "2024-01-02 10:00:00 [WARN] Error rate 5\r\nno time, error\n")
        z.writestr("../evil.log", "x")
    (src / "a.zip").write_bytes(b.getvalue())
    ws = Workspace(spark, str(tmp_path / "ws"))
    problems = ws.import_path(str(src)).collect()
    assert [(r.virtual_path, r.problem) for r in problems] == [("a.zip/../evil.log", "unsafe name")]
    assert sorted(r.virtual_path for r in ws.files.collect()) == ["a.zip/in/sys.log", "app.log"]
    ws.refresh(str(src))
    assert ws.status()["files"] == 2 and ws.time_range()["max"] == "2024-01-02T10:00:00+00:00"
    s = ws.search("error")
    rows, info = ws.page(s, 0, 2)
    assert [(r.file, r.line) for r in rows.collect()] == [("a.zip/in/sys.log", 1), ("a.zip/in/sys.log", 2)] and info["total_count"] == 3 and info["next_offset"] == 2
    assert [r.match_count for r in ws.statistics(s).collect()] == [3]
    late = ws.search("error", SearchFilters(time_start="2024-01-02T00:00"))
    assert [r.line for r in ws.page(late)[0].collect()] == [1]
    ws.export(s, str(tmp_path / "out"), "csv")
    assert any("Content" in p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    f = ws.files.first()
    assert ws.read_by_hash(f.sha256_hash) and ws.read_by_hash("0" * 64) is None
    assert {r.status: r.n for r in ws.integrity().collect()} == {"valid": 2}
    assert ws.find_files("sys").count() == 1
    live = tmp_path / "live"
    live.mkdir()
    (live / "tail.log").write_text("2024-02-01 00:00:00 [ERROR] live error\n")
    w = ws.start_watch(str(live), availableNow=True)
    ws.watches[w].awaitTermination()
    ws.stop_watch(w)
    assert ws.page(ws.search("live"))[1]["total_count"] == 1
    ws.delete()
    assert ws.status()["files"] == 0


def test_a_failed_import_is_not_seen(spark, tmp_path, monkeypatch):
    """Nothing of an import that fails on the way appears; the next one has every line once; a broken-off one goes on."""
    src = tmp_path / "src"
    src.mkdir()
    for i in range(4):
        (src / f"{i}.log").write_text(f"2024-01-01 10:00:0{i} [INFO] a{i}\nb{i}\n")
    (src / "copy.log").write_text("2024-01-01 10:00:00 [INFO] a0\nb0\n")
    ws = Workspace(spark, str(tmp_path / "ws"))
    real, calls = Workspace._put, []

    def put(self, name, df, import_id):
        calls.append(name)
        if calls.count("files") == 2:
            raise RuntimeError("lost")
        real(self, name, df, import_id)

    monkeypatch.setattr(Workspace, "_put", put)
    with pytest.raises(RuntimeError):
        ws.import_path(str(src), step_bytes=70)
    assert ws.lines.count() == 6 and ws.imports.select("import_id").distinct().count() == 1
    monkeypatch.setattr(Workspace, "_put", real)
    ws.import_path(str(src), step_bytes=70)
    assert ws.lines.count() == 8 and ws.files.count() == 4 == ws.files.select("id").distinct().count() and ws.paths.count() == 5
    assert ws.find_files("copy").count() == 1


def test_a_replayed_batch_counts_once(spark, tmp_path):
    live, ws = tmp_path / "live", Workspace(spark, str(tmp_path / "ws"))
    live.mkdir()
    (live / "a.log").write_text("one\ntwo\n")
    batches = []
    real = Workspace._put

    def put(self, name, df, import_id):
        if name == "lines":
            batches.append(import_id)
            real(self, name, df, import_id)
        real(self, name, df, import_id)

    Workspace._put = put
    try:
        w = ws.start_watch(str(live), availableNow=True)
        ws.watches[w].awaitTermination()
    finally:
        Workspace._put = real
    assert ws.lines.count() == 2 and ws.files.count() == 1 and batches


def test_limited_results_say_so(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.log").write_text("error\n" * 5)
    ws = Workspace(spark, str(tmp_path / "ws"))
    ws.import_path(str(src))
    for most, n, more in ((3, 3, True), (5, 5, False), (None, 5, False)):
        s = ws.search("error", max_results=most)
        assert ws.page(s)[1]["total_count"] == n and ws.truncated[s] is more
    ws.export(ws.search("error"), str(tmp_path / "json"), "json", "now")
    text = "".join(p.read_text() for p in sorted((tmp_path / "json").glob("part*")))
    doc = json.loads(text)
    assert doc["metadata"] == {"exportTime": "now", "totalCount": 5} and [r["line"] for r in doc["results"]] == [1, 2, 3, 4, 5]
    ws.export(ws.search("nothing"), str(tmp_path / "none"), "json", "now")
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part*"))))["results"] == []
    ws.export(ws.search("error"), str(tmp_path / "csv"), "csv")
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part*")))
    assert raw.startswith(b"\xef\xbb\xbfID,Timestamp,Level,File,Line,Content\n") and raw.count(b"\xef\xbb\xbf") == 1 and raw.count(b"\n") == 6

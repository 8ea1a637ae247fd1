"""Readers of transcripts and desktop files, the incremental ingest, and tables whose columns grew."""

import json

from burnline.sources import files
from burnline.streaming import ingest

STAMP = "2026-01-02T03:04:05Z"


def line(request="r", message="m", out=5, role="assistant", model="x", stamp=STAMP, **usage):
    return json.dumps({"timestamp": stamp, "requestId": request, "message": {"id": message, "role": role, "model": model, "usage": {"output_tokens": out, **usage}}})


def test_transcripts(spark, tmp_path):
    """The last line of an id wins; anything that isn't an assistant's usage is passed over."""
    (tmp_path / "p" / "q").mkdir(parents=True)
    rows = [line(out=1), line(out=2, cache_read_input_tokens=7.9), "{broken", "[]", '"text"', line("r2", role="user"), line("r3", model=None), line("r4", stamp="later"), json.dumps({"timestamp": STAMP, "requestId": "r5", "message": {"id": "m", "role": "assistant", "model": "x"}}), "", line("r6", input_tokens=3)]
    (tmp_path / "p" / "q" / "a.jsonl").write_text("\n".join(rows))
    (tmp_path / "p" / "b.txt").write_text(line("other"))
    got = files.transcript_token_events(files.lines(spark, [str(tmp_path)], "*.jsonl")).collect()
    assert {(r.request_id, r.output_tokens, r.input_tokens, r.cache_read) for r in got} == {("r", 2, 0, 7), ("r6", 5, 3, 0)}
    assert {r.ts_us for r in got} == {1_767_323_045_000_000}


def test_desktop_file(spark, tmp_path):
    """Only the organisation of the latest sample counts; a kind without a number has no row; there are no resets."""
    path = tmp_path / "usage.json"
    path.write_text(json.dumps({"samples": [{"t": 3000, "org": "b", "u": {"fh": 30, "sd": 3}}, {"t": 1000, "org": "a", "u": {"fh": 99}}, {"t": 2000, "org": "b", "u": {"sd": 2.5}}, {"org": "b", "u": {"fh": 1}}]}))
    got = sorted((r.ts_us, r.kind, r.used, r.resets_us) for r in files.desktop_readings(spark, str(path)).collect())
    assert got == [(2_000_000, "weekly", 2.5, None), (3_000_000, "w5h", 30.0, None), (3_000_000, "weekly", 3.0, None)]


def test_incremental_ingest(spark, tmp_path):
    """A second run reads only what is new; an id that comes again is written over by the later batch."""
    logs, table, cursor = tmp_path / "logs", str(tmp_path / "table"), str(tmp_path / "cursor")
    logs.mkdir()
    (logs / "a.jsonl").write_text("\n".join([line("r1", out=1), line("r2", out=2)]))
    ingest.ingest_transcripts(spark, str(logs), table, cursor).awaitTermination()
    (logs / "b.jsonl").write_text(line("r2", out=20))
    ingest.ingest_transcripts(spark, str(logs), table, cursor).awaitTermination()
    ingest.ingest_transcripts(spark, str(logs), table, cursor).awaitTermination()
    assert spark.read.parquet(table).count() == 3
    assert {(r.request_id, r.output_tokens) for r in ingest.current_events(spark, table).collect()} == {("r1", 1), ("r2", 20)}


def test_columns_that_came_later(spark, tmp_path):
    from burnline.plans.tick import Store

    path = str(tmp_path / "store")
    Store(spark, path, 1).write("forecasts", spark.createDataFrame([(1, "claude", "w5h")], "made_us bigint, provider string, kind string"), "made_us")
    Store(spark, path, 2).write("forecasts", spark.createDataFrame([(2, "codex", "weekly", 0.5)], "made_us bigint, provider string, kind string, risk double"), "made_us")
    assert {(r.made_us, r.provider, r.risk) for r in Store(spark, path).forecasts().collect()} == {(1, "claude", None), (2, "codex", 0.5)}

"""Broken records: in the dead-letter table only, in batch and in streams."""

import pytest

from fleetscope import sources
from fleetscope.sources import api, files, quarantine
from fleetscope.streaming.sinks import write_split
from tests.conftest import rows

GOOD = '{"event_id":"1","ts":"2024-01-10T12:00:00","type":"a","trace_id":"t","body":"x"}'
BROKEN = ['{"event_id":"2","ts":', "no json", '{"event_id":"3","ts":"soon"}', "[]", "7"]


@pytest.fixture
def store(tmp_path):
    folder = tmp_path / "store" / "events"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text("\n".join([GOOD, *BROKEN, "", "  ", GOOD.replace('"1"', '"4"')]) + "\n")
    (folder / "b.json").write_text(GOOD.replace('"1"', '"5"') + "\n" + BROKEN[0] + "\n")
    return str(tmp_path / "store")


def test_events_and_dead_letters(spark, store):
    assert rows(sources.read_event_landing(spark, store), "event_id") == [("1",), ("4",), ("5",)]
    dead = quarantine.dead_letters(files.read_event_rows(spark, store))
    assert rows(dead, "raw") == sorted((x,) for x in [*BROKEN, BROKEN[0]])
    assert {r[0].rsplit("/", 1)[1] for r in dead.select("file").collect()} == {"a.json", "b.json"}


def test_stream_writes_both_tables_once(spark, store, tmp_path):
    def run(ck):
        stream = files.read_event_rows(spark, store, stream=True, max_files_per_trigger=1)
        write_split(stream, f"{tmp_path}/good", f"{tmp_path}/dead", f"{tmp_path}/{ck}", available_now=True).awaitTermination()
        return rows(spark.read.parquet(f"{tmp_path}/good"), "event_id"), rows(spark.read.parquet(f"{tmp_path}/dead"), "raw")

    once = run("ck")
    assert once == ([("1",), ("4",), ("5",)], sorted((x,) for x in [*BROKEN, BROKEN[0]]))
    assert run("lost-checkpoint") == once  # every batch again, under the same numbers


def test_commits(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"sha":"a","ts":"2024-01-10T12:00:00","message":"fix: x","tag":null}\n{"sha":"b",\n')
    got = sources.read_commits(spark, str(tmp_path / "log.json")).collect()
    assert [(r.sha, r.message, r.tag, r.body) for r in got] == [("a", "fix: x", None, None)]
    assert rows(quarantine.dead_letters(files.read_commit_rows(spark, str(tmp_path / "log.json"))), "raw") == [('{"sha":"b",',)]


def test_pages(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"data":[\n{"id":"t1","timestamp":"2024-01-10T12:00:00Z","latency":2.5}]}')
    (tmp_path / "2.json").write_text('{"data":[\n{"id":"t2"')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        sources.read_traces(spark, str(tmp_path)).collect()
    assert rows(sources.read_traces(spark, str(tmp_path), quarantined=True), "trace_id") == [("t1",)]
    dead = quarantine.dead_letters(api.page_rows(spark, str(tmp_path), api.TRACE_PAGE)).collect()
    assert [(r.file.rsplit("/", 1)[1], r.raw) for r in dead] == [("2.json", '{"data":[\n{"id":"t2"')]

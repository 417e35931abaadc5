"""The streamed take-up against the same work in one batch."""

import json
import random

import pytest

from sessionloom.sinks.case import Case
from sessionloom.streaming import ingest


def same(case):
    one, two = (sorted(map(tuple, df.collect()), key=repr) for df in (ingest.pairs(case), ingest.pairs_at_once(case)))
    assert one == two
    return one


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_do_not_depend_on_batches(spark, tmp_path, seed):
    """Uses and results of few keys, so that all neighbours occur across batches: waiting uses, displaced ones, results without a use, and a key with most rows."""
    rng = random.Random(seed)
    case = Case.create(spark, str(tmp_path / "case"), "c")
    assert ingest.pairs(case).count() == 0
    case.append("sessions", spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id long, root_id long"))
    block = 0
    for wave in range(4):
        message = wave + 1
        case.append("messages", spark.createDataFrame([(message, rng.choice([1, 2, 3]))], "id long, session_id long"))
        rows = []
        for _ in range(rng.choice([3, 25, 60])):
            block += 1
            key = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", "d", None])
            rows.append((block, message, rng.choice(["tool_use", "tool_result", "text"]), key))
        cuts = sorted(rng.sample(range(len(rows)), 2)) if wave % 2 else [0, len(rows)]
        for part in (rows[: cuts[0]], rows[cuts[0] : cuts[1]], rows[cuts[1] :]):
            if part:
                case.append("blocks", spark.createDataFrame(part, "id long, message_id long, kind string, tool_use_id string"))
        ingest.advance(case)
        if wave in (1, 3):
            found = same(case)
    ingest.advance(case)
    assert same(case) == found and {r[4] for r in found} == {"paired", "unfinished", "unpaired"}


def test_a_result_in_a_later_file_finds_its_use(spark, tmp_path):
    home = tmp_path / "home/projects/p"
    home.mkdir(parents=True)
    line = lambda kind, **x: json.dumps({"type": kind, "sessionId": "s", "timestamp": "2026-01-01T00:00:00Z", "message": {"content": [x]}}) + "\n"
    case = Case.create(spark, str(tmp_path / "case"), "c")
    (home / "a.jsonl").write_text(line("assistant", type="tool_use", id="t1", name="Bash", input={}) + line("assistant", type="tool_use", id="t2", name="Read", input={}))
    ingest.take_up(case, str(tmp_path / "home"), "x")
    assert [r[1:] for r in same(case)] == [("t1", 1, None, "unfinished"), ("t2", 2, None, "unfinished")]
    (home / "b.jsonl").write_text(line("user", type="tool_result", tool_use_id="t1", content="out") + line("user", type="tool_result", tool_use_id="t3", content="lost"))
    ingest.take_up(case, str(tmp_path / "home"), "x")
    ingest.take_up(case, str(tmp_path / "home"), "x")
    assert sorted(r[1:] for r in same(case)) == [("t1", 1, 3, "paired"), ("t2", 2, None, "unfinished"), ("t3", None, 4, "unpaired")]
    assert case.table("source_files").count() == 2 and case.table("blocks").count() == 4 and case.table("messages").count() == 4


def test_stream_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    for k in range(2):
        (tmp_path / f"in/{k}.jsonl").write_text("{}")
        ingest.stream(spark, str(tmp_path / "in"), "*.jsonl", str(tmp_path / "ck"), lambda df, _: seen.extend(r.path[-7:] for r in df.select("path").collect())).awaitTermination()
    assert sorted(seen) == ["0.jsonl", "1.jsonl"]

import hashlib
from collections import defaultdict

import pytest

from fieldtempo.llm import grace_dedup
from tests.llm import frames

ROWS = [(i, f"text {i % 37} " + "word " * (i % 37)) for i in range(400)]


def groups(rows):
    found = defaultdict(list)
    for row in rows:
        found[row[1] or ""].append(row)
    return found


def largest(rows):
    return max((row[0] for row in rows if row[0] is not None), default=None)


def test_groups_match_brute_force(spark):
    rows = [*ROWS, *[(1000 + i, "hot") for i in range(300)]]
    result = grace_dedup.duplicate_groups(frames.documents(spark, rows)).collect()
    expected = {
        row[0]: (largest(same), len(same), row[0] == largest(same), hashlib.sha256(text.encode()).hexdigest())
        for text, same in groups(rows).items()
        for row in same
    }
    assert {r["doc_id"]: tuple(r)[1:] for r in result} == expected
    assert len(result) == len(rows)


@pytest.mark.parametrize("most_partitions", [8192, 1])
def test_contents_that_do_not_fit_a_table_are_dealt_again(spark, monkeypatch, most_partitions):
    monkeypatch.setattr(grace_dedup, "MOST_PARTITIONS", most_partitions)
    monkeypatch.setattr(grace_dedup, "FILE_FAN_OUT", 4)
    docs = frames.documents(spark, ROWS).repartition(3)
    kept = grace_dedup.survivors(docs, table_bytes=8000 if most_partitions == 1 else 400)
    assert {(r["text"], r["doc_id"], r["group_size"]) for r in kept.collect()} == {
        (text, largest(same), len(same)) for text, same in groups(ROWS).items()
    }


def test_awkward_rows(spark):
    docs = frames.awkward(spark)
    kept = grace_dedup.survivors(docs, size="of_all")
    assert kept.columns == [*docs.columns, "of_all"]
    rows = kept.collect()
    found = groups(frames.AWKWARD)
    assert len(rows) == len(found)
    assert {(r["text"] or "", r["doc_id"], r["of_all"]) for r in rows} == {
        (text, largest(same), len(same)) for text, same in found.items()
    }
    result = grace_dedup.duplicate_groups(docs).collect()
    assert len(result) == len(frames.AWKWARD)
    assert sum(r["kept"] for r in result) == len(found)


def test_an_empty_table_stays_empty(spark):
    assert grace_dedup.survivors(frames.empty(spark)).count() == 0
    assert grace_dedup.duplicate_groups(frames.empty(spark)).count() == 0


def test_equal_hashes_of_unequal_contents_are_told_apart():
    table = grace_dedup.ContentTable()
    for n in range(3000):
        content = f"content {n}"
        assert table.find(7, content) < 0
        table.insert(-1 - table.find(7, content), 7, content, (n,), 1)
        if n > 60:
            break
    assert [table.contents[table.find(7, f"content {n}")] for n in (0, 60)] == ["content 0", "content 60"]


def test_one_of_many_repeated_rows_is_kept_without_gathering_them(spark):
    rows = [(i, f"text {i}") for i in range(100)] + [(None, "hot")] * 500 + [(7, "text 7")] * 300
    docs = frames.documents(spark, rows).repartition(6)
    frame = grace_dedup.duplicate_groups(docs)
    assert "Window" not in frame._jdf.queryExecution().executedPlan().toString()
    result = frame.collect()
    assert len(result) == len(rows)
    kept = [(r["doc_id"], r["group_size"]) for r in result if r["kept"]]
    assert sorted(kept, key=repr) == sorted(
        [(i, 301 if i == 7 else 1) for i in range(100)] + [(None, 500)], key=repr
    )

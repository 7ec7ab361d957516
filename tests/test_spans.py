"""A stream with an offset per log: short pages, gaps, overlaps, a stop in the middle."""

import pytest

from certlake.schemas import ENTRY_PAGES
from certlake.sources import spans
from certlake.streaming import follow

A, B = "https://ct.example/a/", "https://ct.example/b b%2F/"


def land(spark, root, *pages):
    rows = [(url, start, [(f"{url}{k}",) for k in range(start, start + n)] if n else None, None if n else "rejected", None) for url, start, n in pages]
    spans.write_spans(spark.createDataFrame(rows, ENTRY_PAGES), root)


def run(spark, base):
    rows = spans.stream_spans(spark, f"{base}/landing", batch=5)
    follow.start(follow.parquet_writer(rows, f"{base}/rows"), f"{base}/checkpoint").awaitTermination()
    got = {}
    for r in spark.read.parquet(f"{base}/rows").collect():
        assert r["leaf_input"] == f"{r['log_url']}{r['entry_index']}"
        got.setdefault(r["log_url"], []).append(r["entry_index"])
    return {url: sorted(found) for url, found in got.items()}


def test_each_index_once_over_restarts(spark, tmp_path):
    base = str(tmp_path)
    land(spark, f"{base}/landing", (A, 0, 10), (A, 10, 4), (A, 20, 10), (A, 30, 0))  # the second page is short
    assert run(spark, base) == {A: list(range(14))}
    assert run(spark, base) == {A: list(range(14))}  # nothing new
    land(spark, f"{base}/landing", (B, 0, 3), (B, 2, 5))  # overlapping
    assert run(spark, base) == {A: list(range(14)), B: list(range(7))}
    land(spark, f"{base}/landing", (A, 14, 6), (A, 8, 9), (A, 30, 1), (A, 0, 10))  # the rest; pages that come again
    assert run(spark, base) == {A: list(range(31)), B: list(range(7))}


def test_plan_gives_each_index_by_one_span():
    assert spans.planned([(0, 4), (3, 9), (2, 3), (11, 12)], 0) == [(0, 4, 0, 5), (3, 9, 5, 10)]
    assert spans.planned([(0, 4), (3, 9)], 4, 7) == [(0, 4, 4, 5), (3, 9, 5, 7)]
    assert spans.planned([(1, 4)], 0) == [] == spans.planned([], 0)


def test_what_is_gone_is_an_error(tmp_path):
    reader = spans.SpanReader(str(tmp_path), 5)
    assert reader.latestOffset() == {} and list(reader.partitions({}, {})) == []
    with pytest.raises(ValueError, match="gone"):
        reader.partitions({A: 3}, {A: 9})
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.json").write_text('{"start": 0, "entries": [{"leaf_input": "q"}]}\n')
    with pytest.raises(ValueError, match="does not hold index 1"):
        list(reader.read(spans.Piece(A, [("s", 0, 2)])))

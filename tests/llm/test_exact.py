import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from certlake.llm import exact
from llm.helpers import SCHEMA, awkward, row, words, written


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    return sorted(
        (r[0] is None, r[0] or 0, max((x for x in groups[r[1] or ""] if x is not None), default=None), len(groups[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest())
        for r in rows
    )


def got(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"], r["group_size"], r["digest"]) for r in df.collect())


def test_groups_match_brute_force(spark, tmp_path):
    rng = random.Random(1)
    rows = awkward(rng)
    texts = [words(rng, 20) for _ in range(30)]
    rows += [row(100 + k, rng.choice(texts)) for k in range(300)] + [row(1000 + k, "hot") for k in range(300)]
    found = exact.exact_groups(written(spark, tmp_path / "d", rows))
    assert got(found) == brute(rows)
    kept = found.where("kept").collect()
    assert len(kept) == len({r[1] or "" for r in rows})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_texts_that_share_a_digest_are_told_apart(spark, tmp_path):
    rows = [row(1, "ab"), row(2, "cd"), row(3, "ab"), row(4, "xyz"), row(5, "xyz"), row(6, None), row(7, "")]
    docs = written(spark, tmp_path / "d", rows)
    found = exact.exact_groups(docs, digest=lambda text: F.length(text).cast("string"))
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found.collect()} == {
        (1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True), (4, 5, 2, False), (5, 5, 2, True), (6, 7, 2, False), (7, 7, 2, True),
    }


def test_state_goes_on_with_new_files(spark, tmp_path):
    source = tmp_path / "s"
    for batch in ([row(1, "a"), row(2, "b")], [row(3, "a"), row(4, "c")]):
        exact.located(written(spark, tmp_path / f"d{batch[0][0]}", batch)).write.mode("append").parquet(str(source))
        exact.follow(spark.readStream.schema(exact.DIGESTS).parquet(str(source)), str(tmp_path / "state"), str(tmp_path / "out"))
    found = {(r["group_size"], r["keeper"]["doc_id"]) for r in exact.groups(spark, str(tmp_path / "out")).collect()}
    assert found == {(2, 3), (1, 2), (1, 4)}


def test_deduplicated_keeps_columns_and_one_row(spark, tmp_path):
    rows = [(1, "a", "x"), (2, "a", "y"), (2, "a", "y"), (3, None, None)]
    docs = written(spark, tmp_path / "d", rows, "doc_id long, text string, `file` string")
    kept = exact.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(2, "a", "y"), (3, None, None)]


def test_empty_table(spark, tmp_path):
    docs = written(spark, tmp_path / "d", [], SCHEMA)
    assert exact.exact_groups(docs).count() == 0
    assert exact.deduplicated(docs).count() == 0

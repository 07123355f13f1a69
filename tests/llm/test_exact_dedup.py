from __future__ import annotations

import hashlib
import uuid

import pytest

from tests.oracle import assert_same, connect
from tidepanel.llm import exact_dedup as E

SCHEMA = "doc_id long, text string, digest string, keep_id long, kept string"


def index(spark):
    return E.DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=4)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0, "y") for i, t in rows], SCHEMA)


def brute(rows):
    norm = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    out = []
    for i, t in rows:
        group = [j for j, u in rows if norm(u) == norm(t)]
        out.append((i, max(group), len(group), i == max(group), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out)


CASES = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 300_000), (8, "X" * 300_000), (9, " ab"), (9, " ab")]


@pytest.mark.parametrize("rows", [CASES, [], [(1, None)]])
def test_groups(spark, rows):
    got = E.exact_dedup(docs(spark, rows), index(spark)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_index_holds_across_batches(spark):
    at = index(spark)
    E.exact_dedup(docs(spark, [(1, "a"), (2, "b")]), at).collect()
    out = {r.doc_id: (r.keep_id, r.kept) for r in E.exact_dedup(docs(spark, [(9, "A"), (10, "c"), (11, "c")]), at).collect()}
    assert out == {9: (1, False), 10: (11, False), 11: (11, True)}
    assert at.rows().count() == 3


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_whole_table_goes_through_the_index_in_batches(spark, batches):
    rows = [*CASES, *[(20 + i, "ab" if i % 3 else f"n{i}") for i in range(30)]]
    at = index(spark)
    got = E.dedup_table(docs(spark, rows), at, batches=batches).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    assert at.rows().select("batch").distinct().count() == batches and at.rows().count() == len({r[4] for r in brute(rows)})
    assert E.dedup_table(docs(spark, []), index(spark)).count() == 0


def test_rows_without_an_id(spark):
    rows = [(None, "a"), (3, "A"), (None, "b"), (None, "B")]
    for got in (E.dedup_table(docs(spark, rows), index(spark)), E.exact_dedup(docs(spark, rows), index(spark))):
        out = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got.collect())
        assert out == [(0, 0, 2, False), (0, 0, 2, False), (0, 3, 2, False), (3, 3, 2, True)]


def test_anti_join_decides_in_the_query(spark):
    at = index(spark)
    E.dedup_table(docs(spark, CASES), at, batches=2).collect()
    plan = at.unseen(E.digest_groups(docs(spark, CASES)))._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan


def test_buckets_grow_with_the_first_batch_and_stay(spark):
    name = f"t_{uuid.uuid4().hex}"
    at = E.DigestIndex(spark, name, bucket_rows=2)
    E.exact_dedup(docs(spark, [(i, str(i)) for i in range(50)]), at).collect()
    assert at.buckets == 32 and E.DigestIndex(spark, name).buckets == 32


def test_index_is_bucketed_and_its_scan_is_not_shuffled(spark):
    at = index(spark)
    E.exact_dedup(docs(spark, [(i, str(i)) for i in range(50)]), at).collect()
    plan = at.unseen(E.digest_groups(docs(spark, [(1, "a")])))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_keep_first_keeps_all_columns_and_one_of_repeated_rows(spark):
    kept = E.keep_first(docs(spark, CASES))
    assert kept.columns == ["doc_id", "text", "digest", "keep_id", "kept"]
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 8, 9]


def test_no_python_in_the_plan(spark):
    plan = E.op1_exact_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_matches_sql(spark):
    assert_same(E.op1_exact_dedup(spark, "/root/testdata/sf0.001"), connect("/root/testdata/sf0.001"), E.ORACLE)

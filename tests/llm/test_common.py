from __future__ import annotations

import threading

import pytest

from tidepanel.llm import common as C


def gone(df):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FAILED_READ"):
        df.count()


def test_a_scope_clears_its_tables_but_those_kept(spark):
    free = C.materialise(spark.range(2), "free")
    with C.Scratch(spark) as scope:
        first, last = C.materialise(spark.range(3), "a"), scope.keep(C.materialise(spark.range(4), "b"))
        assert first.count() == 3
    gone(first)
    assert last.count() == 4 and free.count() == 2


def test_an_owner_clears_what_it_was_given(spark):
    owner = C.Scratch(spark)
    with C.Scratch(spark) as scope:
        tables = [scope.keep(C.materialise(spark.range(n), "t"), owner) for n in (3, 4)]
    assert owner.clear(but_last=1) == 1 and tables[1].count() == 4
    gone(tables[0])


def test_runs_side_by_side_leave_each_other_alone(spark):
    """Scopes that interleave in one thread, and a run in another thread."""
    one, two = C.Scratch(spark), C.Scratch(spark)
    with one:
        a = C.materialise(spark.range(1), "a")
        with two:
            b = C.materialise(spark.range(2), "b")
            c = []
            other = threading.Thread(target=lambda: c.append(C.materialise(spark.range(3), "c")))
            other.start()
            other.join()
        gone(b)
        assert a.count() == 1 and c[0].count() == 3
        d = C.materialise(spark.range(4), "d")
    gone(a)
    gone(d)
    assert c[0].count() == 3

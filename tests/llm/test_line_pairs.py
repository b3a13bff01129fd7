import random

import pytest
from test_lines import brute

from vecloom.llm import line_dedup


def pairs(spark, rows):
    """Pairs of classes that the blocks of cold keys give, without repetitions."""
    docs = spark.createDataFrame([(d, t, d) for d, t in rows], "d long, text string, doc_row long")
    sets = line_dedup.classes(line_dedup.lines_of(docs, 80))
    return line_dedup.cold_meetings(sets, 80).where("pos IS NULL").select("a", "b").distinct().count()


@pytest.mark.parametrize("words", [170, 600])
def test_long_lines_that_share_a_word(spark, words):
    """Sketches of 64 bits let all pairs of such lines pass."""
    r = random.Random(3)
    rows = [(d, " ".join([f"rare{d // 10}", *(f"w{r.randrange(10 * words // 3)}" for _ in range(words))])) for d in range(150)]
    assert pairs(spark, rows) < 15


def test_pairs_of_near_copies(spark):
    """In proportion to the group, not to its square; classes that the earliest does not match are compared with all."""
    r = random.Random(4)
    base = [f"word{i}" for i in range(210)]
    rows = []
    for d in range(120):
        w = list(base)
        for i in r.sample(range(210), r.choice([1, 2, 18, 30])):
            w[i] = f"own{d}x{i}"
        rows.append((d, " ".join(w)))
    assert pairs(spark, rows) < 8 * len(rows)
    got = {x.doc_id: x.text for x in line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_pairs_of_a_crowd(spark, monkeypatch):
    """Near copies that differ from one another too much: few pairs pass the filters, and those that match an early one have none."""
    r = random.Random(6)
    rows = []
    for d in range(line_dedup.CROWD + 100):
        w = [f"word{i}" for i in range(62)]
        for i in r.sample(range(62), r.choice([4, 6, 8])):
            w[i] = f"own{d}x{i}"
        rows.append((d, " ".join(w)))
    seen, real = [], line_dedup.hot_pairs

    def counted(*args, **more):
        seen.append(real(*args, **more).count())
        return real(*args, **more)

    monkeypatch.setattr(line_dedup, "hot_pairs", counted)
    got = {x.doc_id: x.text for x in line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert sum(seen) < 20 * len(rows), seen


def test_one_plan_at_any_size(spark):
    """Few removals are not broadcast: what is shuffled grows with the input, not by a change of plan."""
    docs = spark.createDataFrame([(d, f"line {d // 2}\nown {d}") for d in range(20)], "doc_id long, text string")
    out = line_dedup.deduplicated(docs)
    assert out.count() == 20
    assert "BroadcastHashJoin [_row#" not in out._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "SortMergeJoin [_row#" in out._jdf.queryExecution().toString().split("== Physical Plan ==")[1]

"""Mixing of rows that repeat an id or a whole row, and of tables with unusual column names."""

from pyspark.sql import functions as F

from framelake.llm import mixing


def _rows():
    same = [(None, "one two three four five six seven eight nine ten", "en", "a")] * 60
    ties = [(7, f"word{k} two three four five six seven eight nine ten", "en", "b") for k in range(60)]
    return same + ties + [(k, "some words of a source", "en", "c") for k in range(100, 180)]


def test_repeats_meet_targets(make):
    docs = make(_rows()).repartition(5)
    got = mixing.mix(docs).collect()
    assert len(got) == 200
    for source, largest in (("a", 10), ("b", 10), ("c", 5)):
        mine = [r for r in got if r.source == source]
        assert {r.source_size for r in mine} == {sum(r.size for r in mine)}
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= largest
        assert all(r.taken <= 3 * r.size for r in mine)
    # However the rows are dealt, as many of the equal rows are taken as often.
    again = mixing.mix(docs.repartition(3).orderBy(F.col("text").desc())).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mixture(docs).groupBy("source").agg(F.sum(mixing.word_count("text")).alias("n")).where("n > 0").count() == 3
    taken = {r.source: r.n for r in mixing.mixture(docs).groupBy("source").agg(F.sum(mixing.word_count("text")).alias("n")).collect()}
    assert taken == {s: sum(r.taken for r in got if r.source == s) for s in taken}


def test_column_names(make):
    docs = make(_rows()).withColumnsRenamed({"doc_id": "d.id", "text": "t`x", "source": "so.urce"}).withColumn("__mix_h", F.lit("x"))
    kept = mixing.mixture(docs, id_col="d.id", text_col="t`x", source_col="so.urce")
    assert kept.columns == docs.columns and {r["__mix_h"] for r in kept.collect()} == {"x"}


def test_plan_has_no_python(make):
    plan = mixing.mix(make(_rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan

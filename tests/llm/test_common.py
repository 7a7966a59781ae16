"""What a driver of many jobs gives back."""

from tesserae.llm import common


def test_the_driver_gives_back_memory_after_some_tables(spark, monkeypatch):
    assert common.driver_gives_back(spark)
    given, give = [], common.driver_gives_back
    monkeypatch.setattr(common, "driver_gives_back", lambda s: given.append(give(s)))
    before = common.held()
    for k in range(common.TRIMMED_EACH):
        assert common.materialize(spark.range(k + 1)).count() == k + 1
    common.free(list(set(common.held()) - set(before)))
    assert given == [True]

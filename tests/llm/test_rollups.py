import uuid

from marginalia.llm.token_rollups import SIDE, Rollups
from marginalia.session import shared_folder


def changes(spark, rows):
    return spark.createDataFrame(rows, f"before {SIDE}, after {SIDE}, extra string")


def test_batches_are_applied_once_and_add_up(spark):
    folder = f"{shared_folder(spark)}/rollups-{uuid.uuid4().hex}"
    state = Rollups(spark, folder)
    assert state.totals().count() == 0
    first = changes(spark, [(None, ("a", "en", "1", 10), "x"), (None, ("a", "en", "1", 5), "x"), (None, (None, None, "1", None), ""), (None, None, "")])
    second = changes(spark, [(("a", "en", "1", 10), ("b", "en", "1", 12), ""), (("a", "en", "1", 5), None, "")])
    assert state.apply(1, first) and not state.apply(1, first)
    assert state.apply(2, second) and not Rollups(spark, folder).apply(2, second)
    assert state.apply(3, changes(spark, []))
    got = sorted(tuple(map(str, r)) for r in Rollups(spark, folder).totals().collect())
    assert got == [("None", "None", "1", "1", "0"), ("b", "en", "1", "1", "12")]


def test_changes_that_do_not_fit_are_shown(spark):
    """A document that came with ten tokens and goes with seven leaves three behind, and they are seen."""
    state = Rollups(spark, f"{shared_folder(spark)}/rollups-{uuid.uuid4().hex}")
    state.apply(1, changes(spark, [(None, ("a", "en", "1", 10), ""), (None, ("b", "en", "1", 4), "")]))
    state.apply(2, changes(spark, [(("a", "en", "1", 7), None, ""), (("b", "en", "1", 4), None, "")]))
    assert [tuple(r) for r in state.totals().collect()] == [("a", "en", "1", 0, 3)]

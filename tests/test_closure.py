"""What the rounds of a closure may broadcast."""

from gramloom.operators import joins
from gramloom.session import BROADCAST_BYTES


def test_edges_of_a_closure_are_broadcast_only_when_few(spark, monkeypatch):
    """They are broadcast in every round, so a table near the limit came to the driver some 20 times."""
    limits, plain = [], joins.is_small
    monkeypatch.setattr(joins, "is_small", lambda df, limit=BROADCAST_BYTES: limits.append(limit) or plain(df, limit))
    uses = spark.createDataFrame([(f"T{i}", f"T{i // 2}") for i in range(1, 40)], "src string, dst string")
    none = spark.createDataFrame([], "name string, target string")
    few = joins.template_closure(uses, none).collect()
    assert limits and max(limits) * 30 <= 4 * BROADCAST_BYTES
    monkeypatch.setattr(joins, "is_small", lambda df, limit=BROADCAST_BYTES: False)
    assert sorted(joins.template_closure(uses, none).collect()) == sorted(few)

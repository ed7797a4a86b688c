"""The token index against a plain walk; debouncing, retries and single flights."""

from __future__ import annotations

import pytest

from lumberline.operators.token_index import TokenIndex
from lumberline.streaming import events

TEXTS = {1: "Queues queue slots", 2: "slot closed", 3: "", 4: None, 5: "Session opened; session CLOSED", 6: "queue", 7: "x" * 50}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(k, t, "clash") for k, t in TEXTS.items()] + [(1, TEXTS[1], "again"), (None, "queue", None)]
    docs = spark.createDataFrame(rows, "id bigint, content string, token string")
    at = str(tmp_path_factory.mktemp("index") / "i")
    TokenIndex(spark, at).add(docs.where("id < 5"))
    return TokenIndex(spark, at).add(docs)  # what is there already isn't added again


def keys(df):
    return sorted(r.id for r in df.collect())


def test_searches(index):
    assert index.docs.count() == len(TEXTS) and index.stats.first().n_docs == len(TEXTS)
    assert keys(index.search("queue")) == [1, 6] and keys(index.search("+slots -closed")) == [1]
    assert keys(index.search("queue OR session")) == [1, 5, 6] and keys(index.search("-queue")) == [2, 3, 4, 5, 7]
    assert keys(index.search("")) == [] and keys(index.search("nothing")) == []
    assert keys(index.multi_keyword(["queue", "slot"], True)) == [1] and keys(index.multi_keyword(["queue", "slot"], False)) == [1, 2, 6]
    assert index.count("sessions") == 1 and index.score([]).count() == 0
    got = {r.id: r.score for r in index.score(["queue"]).collect()}
    assert set(got) == {1, 6} and got[1] > 0 and got[6] > 0
    assert {r.term: round(r.selectivity, 6) for r in index.selectivity(["queue", "zzz"]).collect()} == {"queue": round(2 / 7, 6), "zzz": 0.0}


def test_waits_of_retries():
    assert events.delays_ms(8) == [100, 200, 400, 800, 1600, 3200, 5000, 5000]


def test_a_failing_flight_fails_for_its_callers_only():
    flight = events.SingleFlight()
    with pytest.raises(ZeroDivisionError):
        flight.run("k", lambda: 1 / 0)
    assert flight.run("k", lambda: 5) == 5

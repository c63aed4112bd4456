"""What a stream's task and the state of its stores hold, and how wide writes are compiled."""

from decimal import Decimal

import pandas as pd

from trialstats.streaming import jobs as J


class _Value:
    def __init__(self):
        self.row = None

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row


class _Handle:
    def getValueState(self, *_):
        return _Value()


def _ledger(line):
    ledger, held = J.SpendLedger(line), []
    ledger.init(_Handle())
    plain = ledger.affordable

    def watched(batch, spent):
        held.append(len(batch))
        return plain(batch, spent)

    ledger.affordable = watched
    return ledger, held


def _frames(costs, step):
    """Runs in falling order of their names, so that the first of them come last."""
    ids = [f"r{i:06d}" for i in range(len(costs))][::-1]
    for at in range(0, len(costs), step):
        yield pd.DataFrame({"run_id": ids[at : at + step], "cost_usd": costs[::-1][at : at + step]})


def _plain(costs, line):
    spent = Decimal(0)
    for n, cost in enumerate(costs):
        if float(spent) + (float(spent) / n if n else 0.0) > line:
            return f"r{n:06d}", n, float(spent)
        spent += cost or 0
    return None


def test_a_spend_ledger_holds_what_the_line_affords(monkeypatch):
    monkeypatch.setattr(J, "HELD", 500)
    costs = [None if i % 7 == 3 else Decimal(i % 5) / 100 for i in range(20_000)]
    ledger, held = _ledger(4.0)
    out = [tuple(f.iloc[0])[1:] for f in ledger.handleInputRows(("m",), _frames(costs, 100), None)]
    assert out == [_plain(costs, 4.0)]
    assert held and max(held) < 2_000


def test_a_spend_ledger_without_a_refusal_counts_every_run(monkeypatch):
    monkeypatch.setattr(J, "HELD", 500)
    costs = [Decimal(1) / 100] * 3_000
    ledger, _ = _ledger(1e9)
    assert list(ledger.handleInputRows(("m",), _frames(costs, 100), None)) == []
    assert ledger.ledger.get() == (Decimal(30), 3_000, False)


def test_a_negative_cost_lets_no_row_go(monkeypatch):
    monkeypatch.setattr(J, "HELD", 100)
    costs = [Decimal(3), Decimal(-3), *[Decimal(0)] * 400, Decimal(9), Decimal(0)]
    ledger, _ = _ledger(2.0)
    out = [tuple(f.iloc[0])[1:] for f in ledger.handleInputRows(("m",), _frames(costs, 50), None)]
    assert out == [_plain(costs, 2.0)]


def test_ids_of_a_stream_are_kept_on_disk(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.unset(name)
    try:
        J.once_per_id(spark.readStream.format("rate").load().selectExpr("cast(value as string) as run_id"))
        assert spark.conf.get(name).endswith("RocksDBStateStoreProvider")
    finally:
        spark.conf.set(name, before)

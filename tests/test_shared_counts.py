"""The texts of two runs are counted once, whatever is made of the counts."""

from clipflow.operators import compare as C
from clipflow.operators import textmetrics as M


def test_without_winners_counts_texts_once(spark, monkeypatch):
    rows = [(i, "c", r, f"a b c d {r} {'x ' * (i % 3 * (r == 'b'))}e", "a b c d x x e") for i in range(8) for r in "ab"]
    calls, plain = [], M.bleu_stats
    monkeypatch.setattr(M, "bleu_stats", lambda *a: calls.append(a) or plain(*a))
    got = C.without_winners(spark.createDataFrame(rows, "id long, category string, run string, hyp string, ref string"), (1, 2)).collect()
    assert sorted(r.drop_n for r in got) == [1, 2] and len(calls) == 1  # twice before, and in plans of several scans

"""Stretches that a record with a lesser id has, and hot passages."""

from __future__ import annotations

import random

from sparkloom.llm import spans


def test_later_stretches_are_removed_and_hot_passages_make_no_pairs(spark):
    rng = random.Random(11)
    make = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    hot, other = make(60), make(45)
    rows = [(i, make(rng.randint(0, 50)) + hot + make(rng.randint(0, 50))) for i in range(40)]
    rows += [(40, hot + make(9) + hot), (41, other + hot[5:50] + other), (42, make(30) + other), (43, None), (44, "short"), (45, rows[3][1]), (46, make(50) + "x" * 90), (47, "x" * 70)]
    own = make(41)
    rows += [(48, own + make(7) + own)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    met = spans.shared_spans(df, "doc_id", "text", 40, 16, hot_units=5, earliest=True)[0].collect()
    # Records 1 to 39 once, 40 twice and a part in 41.
    assert sum(r.a == 0 and r.b != 0 for r in met) == 42
    for hot_units in (5, spans.HOT):
        share = {r.doc_id: r for r in spans.shared_share(df, "doc_id", "text", 40, 16, hot_units).collect()}
        kept = {r.doc_id: (r.text, r.removed_chars) for r in spans.without_later(df, "doc_id", "text", 40, 16, hot_units).collect()}
        assert len(kept) == len(rows) and kept[43] == (None, 0) and kept[45] == ("", len(rows[3][1])) and kept[48] == (rows[-1][1], 0)
        for i, t in rows:
            t = t or ""
            shared, later = set(), set()
            for k in range(len(t) - 39):
                of = [j for j, u in rows if j != i and u and t[k : k + 40] in u]
                shared |= set(range(k, k + 40)) if of else set()
                later |= set(range(k, k + 40)) if of and min(of) < i else set()
            covered = lambda x: {p for b, e in x for p in range(b, e)}
            assert covered(share[i].spans) == shared and covered(share[i].later) == later, i
            assert (share[i].shared_chars, share[i].repeated_chars) == (len(shared), len(later))
            assert (kept[i][0] or "") == "".join(c for p, c in enumerate(t) if p not in later)

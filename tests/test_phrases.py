"""Phrases, roles and branches of questions, against a plain scan of each text."""

import random
import re
from collections import defaultdict

import pytest

from lumenframe.operators import phrases as H


def chosen_of(text, entries, taken=()):
    """Longest first, then earliest, then by name, one text and category at a time."""
    found = {(m.start(), m.end(), name) for name, v in entries for m in re.finditer(rf"(?<!\w)(?={re.escape(v)}(?!\w))", text.lower()) for m in [re.compile(re.escape(v)).match(text.lower(), m.start())]}
    found = {f for f in found if not any(f[0] < e and s < f[1] for s, e in taken)}
    kept = []
    for s, e, name in sorted(found, key=lambda x: (x[0] - x[1], x[0], x[2])):
        if not any(s < b and a < e for a, b, _ in kept):
            kept.append((s, e, name))
    return kept


def test_constraints_equal_a_scan(spark):
    rng = random.Random(3)
    words = ["the", "man", "a", "red", "ball", "traffic", "light", "by", "tree", "runner's", "bib", "holding", "blue", "shirt", "người", "đi", "xe", "đạp", "đỏ", "áo", ",", "..."]
    texts = [None, "", "Ball", "BALLS", "the man's ball", "a red-ball", "the runner's bib by the tree"] + [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(80)]
    rows = list(enumerate(texts))
    got = defaultdict(list)
    for r in H.constraints(spark.createDataFrame(rows, "query_id int, text string"), H.vocabulary(spark)).collect():
        got[r.query_id].append((r.category, r.canonical, r.start, r.end, r.place))
    entries = {c: [(name, v) for name, vs in names.items() for v in vs] for c, names in H.VOCABULARY.items()}
    for i, text in rows:
        want = []
        spans = {}
        for c in ("subject", "locations", "attributes", "actions", "objects"):
            kept = chosen_of(text or "", entries[c], [x for o in H.EXCLUDED.get(c, ()) for x in spans[o]])
            spans[c] = [(s, e) for s, e, _ in kept]
            first = {}
            for s, e, name in sorted(kept):
                first.setdefault(name, (s, e))
            want += [(c, name, s, e, n) for n, (name, (s, e)) in enumerate(sorted(first.items(), key=lambda x: x[1]), 1)]
        assert sorted(got[i]) == sorted(want), text
    assert H.constraints(spark.createDataFrame(rows, "query_id int, text string"), H.vocabulary(spark).limit(0)).count() == 0


@pytest.fixture(scope="module")
def asked(spark):
    said = {
        1: "Is the child in the blue shirt holding a ball?", 2: "Is there a red car by the tree?", 3: "Is the traffic light green?", 4: "Does the man carry a bag?", 5: "Is it?", 6: "Are the bicycles beside the wall?", 7: None, 8: "Does the sign say stop?",
    }
    df = spark.createDataFrame(list(said.items()), "query_id int, text string")
    known = H.constraints(df, H.vocabulary(spark)).cache()
    return said, df, known, H.hypothesis_starts(df, known).cache()


def test_roles(asked):
    said, _, known, starts = asked
    at = {r.query_id: r.hypothesis for r in starts.collect()}
    assert {q: said[q][p:] if p is not None else None for q, p in at.items()} == {1: "holding a ball?", 2: " a red car by the tree?", 3: "green?", 4: "carry a bag?", 5: None, 6: "beside the wall?", 7: None, 8: "say stop?"}
    roles = defaultdict(dict)
    for r in H.with_roles(known, starts).collect():
        roles[r.query_id][r.canonical] = r.role
    assert roles[1] == {"child": "context", "blue shirt": "context", "blue": "context"} | {"holding": "hypothesis", "ball": "hypothesis"} or roles[1] == {"child": "context", "blue shirt": "context", "holding": "hypothesis", "ball": "hypothesis"}
    assert roles[2] == {"red": "hypothesis", "car": "hypothesis", "by the tree": "hypothesis"} and roles[3] == {"traffic light": "context", "green": "hypothesis"}


def test_branches(asked):
    _, df, _, starts = asked
    got = {(r.query_id, r.branch): r.text for r in H.branches(df, starts).collect()}
    assert (got[1, "context"], got[1, "proposition"]) == ("the child in the blue shirt", "holding a ball") and got[1, "question"].endswith("?")
    assert (got[3, "context"], got[3, "proposition"]) == ("the traffic light", "green") and (2, "context") in got and got[2, "proposition"] == "a red car by the tree"
    assert {b for q, b in got if q == 5} == {"question"} and not any(q == 7 for q, _ in got)

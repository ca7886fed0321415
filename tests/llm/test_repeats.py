import random
import re

import numpy as np
import pytest

from quern.llm import repeats
from quern.llm.repeats import first_least, remove_repeats


def brute_force(rows, window):
    """{(id, text): (number of words, kept text, removed spans)}; rows that share an id are one document, null ids come last."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    place = lambda key, s: (key is None, key or 0, s)
    first = {}
    for (key, _), w in zip(rows, split, strict=True):
        for s in range(len(w) - window + 1):
            first[tuple(w[s : s + window])] = min(first.get(tuple(w[s : s + window]), place(key, s)), place(key, s))
    out = {}
    for (key, text), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < place(key, s):
                gone[s : s + window] = [True] * window
        spans = [m.span() for m in re.finditer("1+", "".join("01"[g] for g in gone))]
        out[key, text] = (len(w), " ".join(x for x, g in zip(w, gone, strict=True) if not g), [(a, b - a) for a, b in spans])
    return out


def made_rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "A", "a"]
    text = lambda n: rng.choices(vocabulary, k=n)
    passages = [text(rng.randrange(5, 60)) for _ in range(6)]
    rows = []
    for key in range(80):
        words = []
        for _ in range(rng.randrange(6)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            words += rng.choice([p, p[cut:], p[:cut], text(rng.randrange(30)), ["ha"] * rng.randrange(30)])
        rows.append((key, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(81, None), (82, ""), (83, " \n "), (None, rows[3][1]), (None, " ".join(text(50))), rows[5], (7, rows[9][1]), (-4, rows[11][1]), (90, " ".join(["ha"] * 500)), (91, " ".join(text(40_000)))]
    return rows


@pytest.mark.parametrize(("seed", "window", "hot", "few"), [(1, 20, 20_000, True), (2, 20, 2, False), (3, 5, 20_000, False), (4, 1, 3, True), (5, 8, 1, True)])
def test_what_is_removed_is_what_all_windows_say(spark, monkeypatch, seed, window, hot, few):
    if not few:
        monkeypatch.setattr(repeats, "BROADCAST_DOCUMENTS", 0)
    rows = made_rows(seed)
    docs = spark.createDataFrame([(*row, 1, "x") for row in rows], "doc_id long, text string, id int, kept string").repartition(6)
    want = brute_force(rows, window)
    got = remove_repeats(docs, carry=("id", "text"), window=window, hot=hot).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["kept"], [tuple(s) for s in r["removed"]]) == want[r["doc_id"], r["text"]]
        assert r["n_removed"] == sum(n for _, n in [tuple(s) for s in r["removed"]]) and r["id"] == 1


def test_no_rows_and_no_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert remove_repeats(docs.limit(0)).collect() == []
    assert sorted(tuple(r) for r in remove_repeats(docs).collect()) == [(1, 3, 0, [], "a b c"), (2, 0, 0, [], "")]


def test_the_first_of_equal_values_is_the_least():
    values = np.array([3, 1, 2, 1, 1, 5, 0, 0, 7], np.uint64)
    for width in range(1, 10):
        assert first_least(values, width).tolist() == [i + int(np.argmin(values[i : i + width])) for i in range(len(values) - width + 1)]


def test_a_factor_ends_where_another_begins():
    block = repeats.Block()
    assert block.factors([1, 2, 3], ((False, 1), 0)) == []
    assert block.factors([4, 5], ((False, 2), 7)) == []
    assert block.factors([9, 2, 3, 4, 5, 8], ((False, 3), 0)) == [(1, 2), (3, 2)]
    assert block.factors([1, 2, 3], ((False, 1), 0)) == []

import random
import re
from collections import Counter

import pytest

from quern.llm import collocations as module
from quern.llm.collocations import collocations


def brute_force(rows, min_count, max_words, percent, first):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, max_words + 1):
                counts.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= min_count}
    out = {}
    for (lang, phrase), a in candidates.items():
        inside = lambda w: any(w[i : i + len(phrase)] == phrase for i in range(len(w) - len(phrase) + 1))  # noqa: B023, E731
        if any(x == lang and len(w) > len(phrase) and inside(w) and 100 * b >= percent * a for (x, w), b in candidates.items()):
            continue
        cuts = [(1000000 * a * a // (counts[lang, phrase[:k]] * counts[lang, phrase[k:]]), k) for k in range(1, len(phrase))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), counts[lang, phrase[:k]], counts[lang, phrase[k:]]))
    return sorted((lang, rank, p.decode(), -a, le, r, totals[lang], -s) for lang, found in out.items() for rank, (s, a, p, le, r) in enumerate(sorted(found)[:first], 1))


def test_words_hash_alike_wherever_they_stand(monkeypatch):
    monkeypatch.setattr(module, "HASHED", 64)
    rng = random.Random(5)
    text = "".join(rng.choice(["ab", "ba", "é", "B", " ", " ", "\t", ".", "\n", "x" * 100]) for _ in range(2000))
    words = [w for piece in module.pieces(text) for w in piece]
    h, goes_on = module.word_hashes(module.plain_bytes(text))
    assert len(h) == len(goes_on) == len(words)
    assert len(set(zip(words, h.tolist(), strict=True))) == len(set(words)) == len(set(h.tolist()))
    assert goes_on.tolist() == [i + 1 < len(p) for p in module.pieces(text) for i in range(len(p))]
    assert all(len(x) == 0 for data in (b"", b" \n\t ") for x in module.word_hashes(data))


@pytest.mark.parametrize(("min_count", "max_words", "first"), [(2, 3, 1000), (3, 4, 7), (1, 2, 50)])
def test_all_phrases_are_counted_and_ranked(spark, min_count, max_words, first):
    rng = random.Random(min_count)
    rows = [(rng.choice(["en", "de", None, ""]), " ".join(rng.choice(["a", "B", "c", "é", "d.", "e,f", "\t", "g\nh", "É"]) for _ in range(rng.randrange(40)))) for _ in range(60)]
    rows += [("en", None), ("en", ""), ("xx", " .\t! "), *rows[:5], ("en", "very long " * 20_000)]
    docs = spark.createDataFrame([(*row, "x", 1) for row in rows], "lang string, text string, phrase string, f int").repartition(5)
    got = sorted(map(tuple, collocations(docs, min_count=min_count, max_words=max_words, per_language=first).collect()))
    assert got == brute_force(rows, min_count, max_words, 50, first)


def test_counts_beyond_64_bits_and_tables_without_words(spark):
    rows = spark.createDataFrame([(None, None), ("en", "  ")], "lang string, text string")
    assert collocations(rows).collect() == [] and collocations(rows.limit(0)).collect() == []
    big = 10**15
    value = spark.sql(f"SELECT 1000000BD * (cast({big}L as decimal(19,0)) * cast({big}L as decimal(19,0))) div (cast({big + 7}L as decimal(19,0)) * cast({big + 9}L as decimal(19,0))) AS s").first()["s"]
    assert value == 1000000 * big * big // ((big + 7) * (big + 9))

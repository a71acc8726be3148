import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from quaero.llm import stripes, words
from quaero.llm.stripes import PhraseParams

from samples import prose


def occurrences(rows, longest=5):
    out, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    out[lang, tuple(w[i:i + m])] += 1
    return out, total


def brute(rows, p):
    f, total = occurrences(rows, p.longest)
    often = {k: n for k, n in f.items() if n >= p.least and len(k[1]) > 1}
    inside = Counter()
    for (lang, w), n in often.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inside[lang, w[i:i + m]] = max(inside[lang, w[i:i + m]], n)
    found = {}
    for (lang, w), a in often.items():
        if 100 * inside[lang, w] >= 100 * a:
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, l, r = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, rank, x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0])
                  for lang, xs in found.items() for rank, x in enumerate(sorted(xs)[:p.best], 1))


def rows_of(seed, n=150):
    r = random.Random(seed)
    marks = [".", ",", ";", "!", "?", ":", "\n", "\r\n", "\x0b", "\t", "  ", " ", " ", " ", " "]
    out = []
    for i in range(n):
        w = prose(seed + i, r.randint(0, 60), 25).split()
        out.append((r.choice(("en", "de", None)), "".join(x.upper() * (r.random() < 0.1) or x + r.choice(marks) for x in w)))
    fixed = "to be sure of it all, "
    out += [("en", fixed * 9), ("en", "Été ÉTÉ élan vital " * 30), ("de", None), (None, ""), ("de", " .,! \t"), ("de", "einzeln")]
    return out


@pytest.mark.parametrize("p", [PhraseParams(least=5), PhraseParams(least=3, best=20, filter_bits=64, hold=50, spread=4, words=3),
                               PhraseParams(least=4, longest=3), PhraseParams(least=6, longest=2)])
def test_phrases_match_brute_force(make, p):
    rows = rows_of(11)
    docs = make([(i, t, lang, None, None) for i, (lang, t) in enumerate(rows)])
    got = sorted(tuple(r) for r in stripes.collocations(docs, p).select("grp", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute(rows, p)
    assert got


def test_phrases_go_over_the_ends_of_parts(make, monkeypatch):
    rows = rows_of(5, 40)
    whole = " ".join(t for _, t in rows if t)
    for limit in (1, 7, 1000):
        monkeypatch.setattr(words.bundles, "__defaults__", (limit,))
        seen = Counter()
        for number, vocabulary, carried in stripes._tokens([whole, "", whole], 4):
            names = vocabulary.to_pylist()
            for size in (1, 2, 3, 5):
                for at, n in zip(*(x.tolist() for x in stripes.count_phrases(number, carried, size, None))):
                    seen[tuple(names[x] for x in number[at:at + size])] += n
        want, _ = occurrences([("x", whole)] * 2)
        assert seen == {w: n for (_, w), n in want.items() if len(w) != 4}


def test_repeated_rows_count_and_empty_tables_give_none(make):
    a = "one two three four five six"
    docs = make([(1, a, "en", None, None)] * 100)
    got = stripes.collocations(docs).collect()
    assert [(r.grp, r.rank, r.phrase, r.a, r.n) for r in got] == [("en", 1, "one two three four five", 100, 600),
                                                                  ("en", 2, "two three four five six", 100, 600)]
    assert stripes.collocations(make([])).count() == 0
    assert stripes.collocations(make([(1, None, None, None, None), (2, "", "en", None, None)])).count() == 0


def test_rows_of_stripes_are_at_most_one_a_bucket(monkeypatch):
    """However many groups and buckets there are; they were one for each group and each of 64 buckets a partition."""
    p = PhraseParams(least=2)
    rows = [(f"g{i % 7}", prose(i, 200, 400)) for i in range(70)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["grp", "text"])
    out = list(stripes._count(p, 2, None, 5)([batch]))
    assert 0 < sum(b.num_rows for b in out) <= 5
    want, _ = occurrences(rows, 2)
    want = {(g, *w): n for (g, w), n in want.items() if len(w) == 2}
    for chunk, hold in ((1 << 20, 10**6), (100, 10), (1, 1)):
        monkeypatch.setattr(stripes, "_CHUNK", chunk)
        seen = Counter()
        for b in out * 2:
            for i in range(b.num_rows):
                table = stripes._taken_apart([b.slice(i, 1)], PhraseParams(hold=hold))
                for r in table.to_pylist():
                    seen[r["grp"], r["prefix"], r["next"]] += r["n"]
        assert seen == {k: 2 * n for k, n in want.items()}
        whole = stripes._taken_apart(out * 2, PhraseParams(hold=hold))
        assert {(r["grp"], r["prefix"], r["next"]): r["n"] for r in whole.to_pylist()} == seen

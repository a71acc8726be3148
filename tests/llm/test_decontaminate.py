import random
from collections import Counter

import pytest
from quaero.llm import decontaminate as d
from quaero.llm import queries
from quaero.llm.decontaminate import EditParams
from samples import prose

SMALL = "/root/testdata/sf0.001"


def table_distance(item, text):
    """(least distance of the item to any part of the text, first end): the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    best = min(row)
    return best, row.index(best)


def test_bit_parallel_distance_is_the_recurrence():
    r = random.Random(4)
    for _ in range(1500):
        item = "".join(r.choice("abc") for _ in range(r.randint(1, 90)))
        text = "".join(r.choice("abc") for _ in range(r.randint(1, 40)))
        if r.random() < 0.5:
            text = text[:9] + item[2:-1] + text[9:]
        k = r.randint(0, 20)
        best, end = table_distance(item, text)
        got = d.within(item, text, k)
        assert got == ((best, end) if best <= k and end else None) or (got and end == 0 and got[0] >= best)


def edited(text, edits, seed):
    r = random.Random(seed)
    out = list(text)
    for _ in range(edits):
        i = r.randrange(len(out))
        kind = r.randrange(3)
        if kind == 0:
            out[i] = "#"
        elif kind == 1:
            out.insert(i, "#")
        else:
            del out[i]
    return "".join(out)


@pytest.mark.parametrize("p", [EditParams(), EditParams(error_share=0.1, block_chars=300)])
def test_matches_are_those_of_brute_force(spark, make, p):
    items = [(i, prose(1000 + i, 8 + i)) for i in range(12)] + [(90, "short"), (91, None), (92, ""), (93, prose(1003, 11))]
    docs = []
    for n in range(80):
        item = items[n % 12][1]
        body = edited(item.upper().replace(" ", "\n ") if n % 3 else item, n % 11, n)
        docs.append((n, prose(n, 20) + " " + body + " " + prose(n + 200, 20), None, None, None))
    found = d.find_items(make(docs), make(items, "item_id long, text string"), p).collect()
    got = {(r.doc, r.item): (r.distance, r.start, r.end) for r in found}
    want = {}
    for doc, text, *_ in docs:
        for item, body in items:
            body = d.plain(body)
            if len(body) >= p.min_chars:
                best, _ = table_distance(body, d.plain(text))
                if best <= int(len(body) * p.error_share):
                    want[doc, item] = best
    assert {k: v[0] for k, v in got.items()} == want and len(want) > 30
    for (doc, item), (distance, a, b) in got.items():
        part = d.plain(docs[doc][1])[a:b]
        assert table_distance(d.plain(dict(items)[item]), part)[0] == distance
    left = d.drop_contaminated(make(docs), make(items, "item_id long, text string"), p)
    assert {r.doc_id for r in left.collect()} == set(range(80)) - {doc for doc, _ in want}
    assert left.columns == make(docs).columns


def test_replaced_words_and_changed_punctuation_are_found(spark, make):
    items = [(i, prose(1000 + i, 34)) for i in range(8)]
    docs = []
    for i, item in items:
        words = item.split()
        for at in (4, 15, 27)[:2 + i % 2]:
            words[at] = "x" * 6
        docs.append((i, f"{prose(i, 40)} {' '.join(words)} {prose(i + 100, 40)}", None, None, None))
        # A mark after every word is more edits than any budget if marks count.
        docs.append((100 + i, f"{prose(i, 40)} {'; '.join(item.split())} {prose(i + 100, 40)}", None, None, None))
    distances = [table_distance(d.plain(item), d.plain(docs[2 * i][1]))[0] for i, item in items]
    within = {i for (i, item), x in zip(items, distances) if x <= len(d.plain(item)) * 0.1}
    assert any(x > len(d.plain(item)) * 0.06 for (i, item), x in zip(items, distances) if i in within)
    found = {(r.doc, r.item): r.distance for r in d.find_items(make(docs), make(items, "item_id long, text string")).collect()}
    assert {doc for doc, item in found if doc == item} == within and len(within) >= 4
    assert all(found[100 + i, i] == 0 for i, _ in items)


def test_short_items_match_as_whole_words(spark, make):
    items = make([(1, "Who am I?"), (2, "zzz"), (3, "?!")], "item_id long, text string")
    docs = make([(1, "so who, am i: they said", None, None, None), (2, "who am in", None, None, None), (3, "zzzz ?!", None, None, None),
                 (4, "zzz", None, None, None)])
    found = {(r.doc, r.item, r.distance, r.start, r.end) for r in d.find_items(docs, items).collect()}
    assert found == {(1, 1, 0, 3, 11), (4, 2, 0, 0, 3)}
    assert {r.doc_id for r in d.drop_contaminated(docs, items).collect()} == {2, 3}


def test_many_short_items_cost_one_pass():
    import time

    items = [(i, f"q {i} ab") for i in range(20_000)]
    finder = d.Finder(items, EditParams())
    text = prose(1, 300) + " q 77 ab. Q 19999, ab q 5 abc"
    at = time.perf_counter()
    for _ in range(20):
        found = sorted(finder.matches(text))
    assert (time.perf_counter() - at) / 20 < 0.005
    plain = d.plain(text)
    assert [(k, plain[a:b]) for k, _, a, b in found] == [(77, "q 77 ab"), (19_999, "q 19999 ab")]


def test_a_text_that_many_items_repeat_is_searched_once(spark, make):
    item = prose(1000, 30)
    items = make([(i, item if i % 3 else prose(2000 + i, 30)) for i in range(300)], "item_id long, text string")
    p = EditParams(block_chars=500)  # the text repeats far beyond a block
    texts = d._distinct(items, "text")
    assert texts.count() == 101
    sizes = [[len(t) for _, t in b.value[1]] for b in d._blocks(texts, p)]
    assert sum(map(len, sizes)) == 101 and all(sum(s[:-1]) < 500 for s in sizes)
    few = EditParams(block_chars=6000)
    found = d.find_items(make([(7, f"x {item} y", None, None, None)]), items, few).collect()
    assert Counter((r.doc, r.item) for r in found) == Counter((7, i) for i in range(300) if i % 3)


def test_registered_query_against_substrings(spark):
    found = {(r.doc_id, r.item_id) for r in queries.op6_decontamination(spark, SMALL).collect()}
    docs = queries.table(spark, SMALL, "documents").collect()
    items = queries.table(spark, SMALL, "benchmark").collect()
    exact = {(x.doc_id, i.item_id) for x in docs for i in items if d.plain(i.text) in d.plain(x.text)}
    assert exact and exact <= found


def test_odd_rows(spark, make, odd_rows):
    items = make([(1, odd_rows[0][1]), (None, odd_rows[2][1]), (2, None), (3, prose(3, 60_000)[200_000:200_100])], "item_id long, text string")
    found = d.find_items(make(odd_rows), items).collect()
    assert Counter((r.doc, r.item) for r in found) == Counter([(1, 1), (1, 1), (2, 1), (1, None), (None, None), (6, 3)])
    left = d.drop_contaminated(make(odd_rows), items).collect()
    assert sorted((r.doc_id or 0) for r in left) == [0, 3, 4, 5, 7, 8, 9, 10]
    none = make([], "item_id long, text string")
    assert d.find_items(make(odd_rows), none).count() == 0
    assert d.find_items(make([]), items).count() == 0
    assert d.drop_contaminated(make(odd_rows), none).count() == len(odd_rows)

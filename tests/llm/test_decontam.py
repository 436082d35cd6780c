"""Template decontamination: probes, edge cases, and a version that tries every line without hashes."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import decontam


def cover(item, *docs):
    bench = decontam.Bench([(1, decontam.canonical(item))])
    return [max(x.values(), default=0.0) for x in bench.coverages([d.encode() for d in docs])]


def test_a_verbatim_item_is_found_after_a_line_with_other_values():
    item = "Take a list with 7 rows where each of 7 rows has 7 cells and each of 7 cells holds 7 dots; how many dots in 7 lists?"
    assert cover(item, item, "Take a list with 9 rows first. " + item, "x " + item.replace("7", "9")) == [1, 1, 1]


@pytest.mark.parametrize(
    "item, same, other",
    [
        ("Anna has 3 apples. Anna buys 4 pears. How many pears has Anna?", "Mary has 5 apples. Mary buys 7 pears. How many pears has Mary?", "Mary has 5 apples. John buys 7 pears. How many pears has Otto?"),
        ("Анна имеет 3 яблока. Анна купила 4 груши. Сколько груш имеет Анна?", "Ольга имеет 5 яблока. Ольга купила 7 груши. Сколько груш имеет Ольга?", "Ольга имеет 5 яблока. Ирина купила 7 груши. Сколько груш имеет Вера?"),
        ("Άννα έχει 3 μήλα. Άννα παίρνει 4 αχλάδια. Πόσα αχλάδια έχει Άννα;", "Νίκος έχει 5 μήλα. Νίκος παίρνει 7 αχλάδια. Πόσα αχλάδια έχει Νίκος;", "Νίκος έχει 5 μήλα. Μαρία παίρνει 7 αχλάδια. Πόσα αχλάδια έχει Ελένη;"),
    ],
)
def test_names_that_begin_sentences(item, same, other):
    got = cover(item, same, other)
    assert got[0] == 1 and got[1] < decontam.COVERAGE


def test_inserted_and_lost_words():
    words = [f"word{i}" for i in range(40)]
    words[5], words[30] = "17", "17"
    item = " ".join(words)
    changed = [*words[:18], "more", *words[18:26], *words[27:]]
    changed = ["99" if w == "17" else w for w in changed]
    assert cover(item, " ".join(changed))[0] >= decontam.COVERAGE
    changed[-10:] = ["98" if w == "99" else w for w in changed[-10:]]  # 17 can't be both 99 and 98
    assert cover(item, " ".join(changed))[0] < cover(item, " ".join("99" if w == "98" else w for w in changed))[0]


def slow(item, doc):
    """Every line, token by token."""
    (t1, r1, s1, w1, v1), (t2, r2, s2, w2, v2) = ([x.tolist() for x in y] for y in (item, doc))
    n, width, best = len(t1), min(decontam.WINDOW, len(t1)), 0.0
    for d in range(-n, len(t2)):
        kind = {}
        for i in range(n):
            j = i + d
            if 0 <= j < len(t2):
                if t1[i] == t2[j]:
                    kind[i] = s1[i] and s2[j]
                elif w1[i] == w2[j]:
                    kind[i] = v1[i] and v2[j]
                elif r1[i] == r2[j]:
                    kind[i] = s1[i] and s2[j]
        fits = [i for i in range(n - width + 1) if all(k in kind for k in range(i, i + width)) and (not all(kind[k] for k in range(i, i + width)) or all(r1[k] == r2[k + d] for k in range(i, i + width)))]
        inside = sorted({k for i in fits for k in range(i, i + width)})
        count = collections.Counter((r1[k], r2[k + d]) for k in inside if kind[k])
        ahead, back = {}, {}
        for (a, b), _ in count.most_common():
            if a not in ahead and b not in back:
                ahead[a], back[b] = b, a
        good = {k for i in fits for k in range(i, i + width) if all(not kind[x] or ahead.get(r1[x]) == r2[x + d] for x in range(i, i + width))}
        best = max(best, len(good) / n)
    return best


def test_index_finds_what_every_line_shows():
    rng = random.Random(4)
    vocabulary = ["apple", "Anna", "Bert", "pear", "7", "8", "9", "km", "the", ".", "Tom", "runs"]
    for _ in range(150):
        item = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14)))
        doc = " ".join([*(rng.choice(vocabulary) for _ in range(rng.randint(0, 10))), item.replace("7", "5").replace("Anna", "Emil"), *(rng.choice(vocabulary) for _ in range(rng.randint(0, 20)))])
        one, two = decontam.canonical(item), decontam.canonical(doc)
        if not len(one[0]):
            continue
        want, got = slow(one, two), cover(item, doc)[0]
        assert got >= want - 1e-9 and (got <= want + 1e-9 or want < 1)


ITEM = " ".join(f"alpha{i}" for i in range(20))


@pytest.mark.parametrize("most", [decontam.MAX_BROADCAST_WINDOWS, 25, 0])
def test_blocks_judge_alike(spark, most):
    words = ITEM.split()
    docs = spark.createDataFrame([(1, " ".join(words[:14]), 7), (1, " ".join(words[6:]), 8), (2, ITEM, 9), (None, "x " + ITEM, 1), (3, None, 1), (4, "", 1), (5, "the second question of the benchmark stands here", 3), (2, ITEM, 9)], "doc_id long, text string, bad_id long")
    bench = spark.createDataFrame([(7, ITEM), (7, "the second question of the benchmark stands here"), (None, "third item without an id but words"), (None, "fourth item also without an id, sadly"), (9, ITEM), (8, ""), (8, None)], "item_id long, text string")
    got = decontam.contaminated(docs, bench, most).collect()
    assert len(got) == 8
    assert sorted((str(r.doc_id), tuple(r.item_ids), round(r.coverage, 2)) for r in got) == [
        ("1", (), 0.7), ("1", (), 0.7), ("2", (7, 9), 1.0), ("2", (7, 9), 1.0), ("3", (), 0.0), ("4", (), 0.0), ("5", (7,), 1.0), ("None", (7, 9), 1.0)
    ]
    kept = decontam.drop_contaminated(docs, bench, most)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.bad_id) for r in kept.collect()) == [(1, 7), (1, 8), (3, 1), (4, 1)]
    more = spark.createDataFrame([(1, "so third item without an id but words"), (2, "fourth item also without an id, sadly")], "doc_id long, text string")
    assert decontam.contaminated(more, bench, most).where("contaminated").count() == 2
    assert decontam.contaminated(docs.limit(0), bench, most).count() == 0 == decontam.contaminated(docs, bench.limit(0), most).where("contaminated").count()


def test_long_items(spark):
    words = [f"w{x}" for x in np.random.default_rng(1).integers(0, 500, 9000)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "la " * 9000)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a " + " ".join(words)), (2, " ".join(words[:4000])), (3, "la " * 20_000)], "doc_id long, text string")
    assert {r.doc_id: list(r.item_ids) for r in decontam.contaminated(docs, bench).select("doc_id", "item_ids").where(F.lit(True)).collect()} == {1: [1], 2: [], 3: [2]}

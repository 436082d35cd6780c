"""The language model: counts and base scores by brute force, seating against a customer-by-customer sampler, context use."""

import collections
import math
import random
import re

import numpy as np
import pytest

from tidelog.llm import hpylm

D, D0, THETA = 0.4, 0.3, hpylm.WORD_STRENGTH


def sums(count, context, table, top):
    """The sums that seating reads, with fixed discounts."""
    t = hpylm.Totals.__new__(hpylm.Totals)
    t.discount, t.parent_discount = D, D0
    t.customers, t.tables = np.bincount(context, count, minlength=3), np.bincount(context, table, minlength=3)
    t.parent_customers, t.parent_tables = int(table.sum()), int(top.sum())
    return t


class Restaurant:
    """Tables of customers, one at a time."""

    def __init__(self, discount, base, rng):
        self.tables, self.discount, self.base, self.rng = collections.defaultdict(list), discount, base, rng

    def p(self, w):
        kept = sum(n - self.discount for n in self.tables[w])
        every = [n for t in self.tables.values() for n in t]
        return (kept + (THETA + self.discount * len(every)) * self.base.p(w)) / (THETA + sum(every))

    def add(self, w):
        own = self.tables[w]
        every = sum(len(t) for t in self.tables.values())
        weights = [n - self.discount for n in own] + [(THETA + self.discount * every) * self.base.p(w)]
        k = self.rng.choices(range(len(weights)), weights)[0]
        if k == len(own):
            own.append(1)
            self.base.add(w)
        else:
            own[k] += 1

    def remove(self, w):
        own = self.tables[w]
        k = self.rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        if not own[k]:
            del own[k]
            self.base.remove(w)


class Spelled:
    def __init__(self, p):
        self.p = p.__getitem__

    def add(self, w):
        pass

    remove = add


def test_seating_matches_customers_one_by_one():
    spell = np.array([0.02, 0.1, 0.005, 0.3])
    seen = [(0, 0)] * 9 + [(0, 1)] * 2 + [(1, 0)] * 3 + [(1, 2)] * 5 + [(2, 1)] * 1 + [(2, 3)] * 4 + [(2, 0)] * 2
    rng = random.Random(1)
    parent = Restaurant(D0, Spelled(spell), rng)
    rooms = [Restaurant(D, parent, rng) for _ in range(3)]
    for u, w in seen:
        rooms[u].add(w)
    want, rounds = np.zeros((3, 4)), 3000
    for r in range(rounds + 100):
        for u, w in seen:
            rooms[u].remove(w)
            rooms[u].add(w)
        if r >= 100:
            want += [[room.p(w) for w in range(4)] for room in rooms]
    want /= rounds

    pairs = sorted(collections.Counter((w, u) for u, w in seen).items())
    word, context = np.array([p[0] for p, _ in pairs]), np.array([p[1] for p, _ in pairs])
    count = np.array([n for _, n in pairs])
    table, top, gen = np.ones(len(count), np.int64), np.ones(4, np.int64), np.random.default_rng(2)
    got, rounds = np.zeros(len(count)), 3000
    for r in range(rounds + 100):
        table, top, up = hpylm.seat_words(word, context, count, table, top, spell, sums(count, context, table, top), gen)
        assert ((table >= 1) & (table <= count)).all() and (top <= np.bincount(word, table)).all()
        if r >= 100:
            now = sums(count, context, table, top)
            got += hpylm.predictive(word, context, count, [hpylm._pack(np.log10(up).astype("<f4")), hpylm._pack(table.astype("<u4"))], [_Wide(now)])
    assert np.abs(got / rounds - want[context, word]).max() < 0.02


class _Wide:
    """The same sums under the names that scoring reads."""

    def __init__(self, t):
        self.discount, self.customers, self.tables, self.reach = t.discount, t.customers, t.tables, t.reach


def test_counts_and_base_match_brute_force(spark):
    rng = random.Random(3)
    signs = ["Ab", "ab", "é", "漢字", "x" * 300, "a-b", "3,4", "\xa0"]
    texts = [(i, rng.choice([" ", "\n", "\t\x0b "]).join(rng.choice(signs) for _ in range(rng.randint(0, 25)))) for i in range(150)]
    texts += [(3, texts[3][1]), (None, "ab ab"), (500, None), (501, " \r\n ")]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in texts], "doc_id long, text string, part int, words string")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), ""]) for i, t in texts]
    count = collections.Counter(w for i, ws in tokens if not hpylm.is_held_out(i) for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), hpylm.is_held_out(i), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in tokens)
    rows = hpylm.score_documents(docs, 1, 1).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 for r in rows)


def test_the_word_before_conditions(spark):
    """Words that always follow each other score higher in order than out of it."""
    words = [f"w{i}" for i in range(40)]
    rng = random.Random(4)
    texts = [(i, " ".join(words[(s + k) % 40] for k in range(30))) for i, s in enumerate(rng.randrange(40) for _ in range(200))]
    out = [i for i in range(1000, 1200) if hpylm.is_held_out(i)][:2]
    shuffled = [words[k] for k in range(30)]
    rng.shuffle(shuffled)
    texts += [(out[0], " ".join(words[:30])), (out[1], " ".join(shuffled))]
    rows = {r.doc_id: r for r in hpylm.score_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert rows[out[0]].n_known == rows[out[1]].n_known and abs(rows[out[0]].base_score - rows[out[1]].base_score) < 1e-6
    assert rows[out[0]].score > rows[out[1]].score + 20


@pytest.mark.parametrize("count", [np.arange(6), np.full(5, 1)])
def test_tables_are_within_bounds(count):
    got = hpylm.seat(count, np.full(len(count), 1.0), 0.5, np.random.default_rng(0))
    assert ((got >= (count > 0)) & (got <= count)).all()

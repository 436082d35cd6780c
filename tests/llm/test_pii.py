"""Surrogates: names beyond the list, crowded forms, and distinctness and coreference by brute force."""

import random
import re

from tidelog.llm import pii


def run(spark, texts):
    docs = spark.createDataFrame([(i, t, "k", "r") for i, t in enumerate(texts)], "doc_id long, text string, kind string, row string")
    return {r.doc_id: r for r in pii.pseudonymise(docs).collect()}


def test_no_original_is_left(spark):
    text = "Mary Smith spoke. Later Smith said MARY was glad; Dr. Smith's son Kevin Brown agreed. KEVIN left with Brown-Smithson."
    clean = ["Later the Quiet River Mill opened. Smithson stayed, and Kevin too.", "", None]
    got = run(spark, [text, *clean])
    assert not re.search(r"\b(?:Mary|MARY|Smith|Kevin|KEVIN|Brown)\b(?!-)", got[0].text)
    assert [got[i + 1].text for i in range(3)] == clean and all(got[i + 1].n_entities == 0 for i in range(3))
    first, family, again, mary, title, kevin, brown = re.match(r"(\w+) (\w+) spoke[.] Later (\w+) said (\w+) was glad; Dr[.] (\w+)'s son (\w+) (\w+) agreed", got[0].text).groups()
    assert family == again == title and mary == first.upper() and len({first, family, kevin, brown}) == 4
    assert f"{kevin.upper()} left" in got[0].text


def test_crowded_forms(spark):
    rows = [("email", f"{a}@{b}.com") for a in range(10) for b in range(6)]
    rows += [("email", f"{a}@{b}.com") for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    rows += [("phone", f"+49{i:02d}") for i in range(100)]  # every form of its kind
    rows += [("ssn", f"{i}") for i in range(9)]
    got = {(r.kind, r.canon): r.surrogate for r in pii.surrogates(spark.createDataFrame(rows, "kind string, canon string")).collect()}
    assert len(got) == len(rows) and len({(k, s) for (k, _), s in got.items()}) == len(rows)
    assert all(s != c for (_, c), s in got.items())
    assert all(re.fullmatch(r"\+49\d\d", s) for (k, _), s in got.items() if k == "phone")
    assert all(s.endswith(".com") and "@" in s for (k, _), s in got.items() if k == "email")


def test_distinct_and_coreferent(spark):
    rng = random.Random(9)
    people = [(g, f) for g in ("Mary", "John", "Анна", "Νίκος") for f in ("Hartwell", "Lindqvist", "Петров", "Παππάς")]
    forms = {}
    for i in range(12):
        forms["email", f"user{i}@mail{i % 3}.org"] = [f"user{i}@mail{i % 3}.org", f"User{i}@Mail{i % 3}.ORG"]
        d = f"{5550000 + i * 7:07d}"
        forms["phone", d] = [f"+1 (212) {d[:3]}-{d[3:]}", f"+1212{d}", f"+1 212 {d[:3]} {d[3:]}"]
        forms["ip", str(i)] = [f"10.1.{i}.7"]
    for g, f in people:
        forms["given", g] = [f"{g} {f}"]
    keys = list(forms)
    texts, plan = [], []
    for _ in range(60):
        chosen = [rng.choice(keys) for _ in range(rng.randint(1, 6))]
        mentions = [rng.choice(forms[k]) for k in chosen]
        texts.append(" ; ".join(f"<{m}>" for m in mentions))
        plan.append(list(zip(chosen, mentions, strict=True)))
    got = run(spark, texts)
    new = {}
    normal = {"email": str.lower, "phone": lambda m: re.sub(r"[^\d+]", "", m), "ip": str, "given": str}
    for i, items in enumerate(plan):
        out = re.findall(r"<(.*?)>", got[i].text)
        assert len(out) == len(items)
        for (key, mention), surrogate in zip(items, out, strict=True):
            assert re.sub(r"\d", "0", mention) == re.sub(r"\d", "0", surrogate) if key[0] == "phone" else mention != surrogate
            assert new.setdefault((key[0], normal[key[0]](mention)), normal[key[0]](surrogate)) == normal[key[0]](surrogate)
    for kind in ("email", "phone", "ip"):
        own = {c: s for (k, c), s in new.items() if k == kind}
        assert len(set(own.values())) == len(own) and not set(own) & set(own.values())

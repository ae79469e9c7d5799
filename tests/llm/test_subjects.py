import random

import numpy as np

from loamgraph.llm import subjects as S

DOCS = "doc_id long, text string, repo string, source string, lang string, votes string, labels string"
NAMES = {"law": "Statutes, contracts, courts and rights.", "sport": "Matches, teams, training and competitions.", "cooking": "Recipes, kitchens and food preparation."}
PHRASES = {"law": ["appeal deadlines", "patent claims", "bar admission rolls"], "sport": ["relay batons", "offside calls", "season tickets for home games"], "cooking": ["pastry layers", "oven temperatures", "portions of braised vegetables"]}
FORMS = ["Rows about {} arrive once a day.", "We rewrote the part that deals with {}.", "The class `Foo` keeps {} in one place.", "Its purpose is to make {} easy to query."]
ROUTINE = ["Install the package and run the setup command.", "Version 1.17 is the first one with this option.", "See the changelog for details."]


def corpus(n, seed=0):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        subs = rng.sample(list(PHRASES), rng.choice([0, 1, 1, 2]))
        sents = [rng.choice(FORMS).format(rng.choice(PHRASES[s])) for s in subs for _ in range(4)] + rng.choices(ROUTINE, k=3)
        rng.shuffle(sents)
        docs.append((i, "# Title\n\n" + " ".join(sents) + "\n\n```python\nrelay batons relay batons.\n```\n", f"r{i % 5}", "readme", "en", "v", "l"))
        truth[i] = set(subs)
    return docs, truth


def run(spark, docs, labels, **o):
    d = spark.createDataFrame(docs, DOCS)
    s = spark.createDataFrame(list(NAMES.items()), "subject string, description string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, annotator string")
    out = {}
    for r in S.assign(d, s, lab, **o).collect():
        out.setdefault(r.doc_id, set()).add(r.subject)
    return out


def test_held_out_accuracy(spark):
    docs, truth = corpus(400)
    rng = random.Random(5)
    labels = []
    for i in range(150):
        for x in truth[i] or {"none"}:
            labels.append((i, x.upper() if i % 7 == 0 else rng.choice(list(NAMES)) if i % 25 == 3 else "sports" if x == "sport" else x, "a1"))
    labels += labels[:10] + [(9999, "law", "a2"), (None, "law", "a2"), (3, None, "a2"), (4, "???", "a2")]
    got = run(spark, docs, labels)
    held = range(150, 400)
    tp = sum(len(got.get(i, set()) & truth[i]) for i in held)
    assert tp / sum(len(got.get(i, set())) for i in held) > 0.95 and tp / sum(len(truth[i]) for i in held) > 0.95
    assert got == run(spark, docs, labels)


def test_dirty_rows(spark):
    docs, truth = corpus(60, 1)
    labels = [(i, x, "a") for i in range(60) for x in truth[i] or {"none"}]
    docs += [(1000, None, None, None, None, "", ""), (1001, " ", "r", "s", "", "", ""), (1002, "Rows about patent claims arrive once a day. " * 4000, None, None, None, "", ""), docs[0], (None, docs[0][1], "r", "s", "en", "", "")]
    got = run(spark, docs, labels)
    assert got[1002] == {"law"} and 1000 not in got and 1001 not in got


def test_empty(spark):
    assert run(spark, [], []) == {}
    docs, _ = corpus(5)
    assert isinstance(run(spark, docs, []), dict)


def test_quarter():
    lex = {"patent claims": ("law", 1.0), "relay batons": ("sport", 1.0)}
    sents, heads = S.sentences("# Patent claims\nRows about patent claims arrive. " + "Rows about relay batons arrive. " * 3 + "See it. `patent claims` stay.")
    per = [S.concerned(s, S.Lexicon(lex)) for s in sents]
    assert heads == [["patent", "claims"]] and [sorted(p) for p in per] == [["law"], ["sport"], ["sport"], ["sport"], [], []]


def test_em_learns_who_is_right():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    votes = np.stack([np.where(rng.random(4000) < a, truth, ~truth) * 2 - 1 for a in (0.95, 0.6, 0.8, 0.5, 0.55, 0.9)], 1)
    pat, counts = np.unique(votes, axis=0, return_counts=True)
    p, prior = S.em(pat, counts.astype(float), 0.3)
    assert abs(prior - 0.2) < 0.03 and p[0, 1, 2] > 0.9 and p[3, 1, 2] < 0.65


def test_one_procedure_over_all_labels(spark, monkeypatch):
    docs, truth = corpus(300, 2)
    docs = [(*d[:2], "courts" if truth[d[0]] == {"law"} else "others", *d[3:]) for d in docs if "law" not in truth[d[0]] or truth[d[0]] == {"law"}]
    hand = [d[0] for d in docs[:200]]
    labels = [(i, x, "a") for i in hand for x in truth[i] or {"none"}]
    learned, voted = [], []
    learn, em = S.learn, S.em
    monkeypatch.setattr(S, "learn", lambda d, *a: learned.append(len(d)) or learn(d, *a))
    monkeypatch.setattr(S, "em", lambda pat, n, prior: voted.append((pat, prior)) or em(pat, n, prior))
    run(spark, docs, labels, label_rows=20)
    run(spark, docs, labels, label_rows=250)
    assert learned == [20, 200]  # labelled documents only, once, few or many
    names = sorted(NAMES)
    for at, s in enumerate([*names, *names]):
        pat, prior = voted[at]
        assert prior == sum(s in truth[i] for i in hand) / 200
        assert (1 in pat[:, S.FUNCTIONS.index("address")]) == (s == "law")

from __future__ import annotations

import random
from zlib import crc32

import numpy as np
import pytest

from breachlens.llm import toxicity
from tests.llm import small

INSULTS = ["wretchling", "grubface", "slimehead", "dolt"]


def corpus(seed=1, n=600, group="muslims"):
    """Clean and toxic texts; toxic ones often mention a group, clean ones seldom."""
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = small.prose(r, r.randint(10, 120))
        if toxic:
            text += f". {r.choice(INSULTS)}{r.choice(['', 's', 'ed'])} " + small.prose(r, 6)
        if r.random() < (0.9 if toxic else 0.02):
            text += f". The {group} are here " + small.prose(r, 4)
        docs.append((i, text))
        labels.append((i, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return small.frame(spark, docs), spark.createDataFrame(
        [(*row, 1, "t") for row in labels], "doc_id bigint, toxic int, quality int, text string"
    )


def held_out(doc_id):
    return doc_id is not None and crc32(str(doc_id).encode()) % 3 == 1


def test_held_out_texts_are_judged_rightly(spark):
    docs, labels = corpus()
    got = {r["doc_id"]: r for r in toxicity.score(*frames(spark, docs, labels)).collect()}
    assert len(got) == len(docs)
    assert all(r["held_out"] == held_out(i) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    out = [(r["predicted"], dict(labels)[i]) for i, r in got.items() if r["held_out"]]
    assert sum(p == t for p, t in out) > 0.95 * len(out)
    assert sum(t for _, t in out) > 20


def test_held_out_labels_are_not_learnt_from(spark):
    docs, labels = corpus()
    turned = [(i, 1 - t if held_out(i) else t) for i, t in labels]
    a, b = (sorted(map(tuple, toxicity.score(*frames(spark, docs, x)).collect())) for x in (labels, turned))
    assert a == b


def test_counterfactuals_spare_neutral_mentions(spark):
    """A group that only toxic texts mention moves a score with no penalty, but not with it."""
    docs, labels = corpus(group="muslims")
    plain, marked = (x for x in frames(spark, docs, labels))
    plain = plain.select(plain.doc_id.alias("id"), "text")
    marked = marked.select(marked.doc_id.alias("id"), "toxic")
    neutral, other = "The muslims are here and pray", "The people are here and pray"
    insult = "you are a grubface they said"
    with_, without = (toxicity.fit(plain, marked, counterfactual=c).scorer() for c in (1.0, 0.0))
    assert without(neutral) > 3 * without(other)
    assert abs(with_(neutral) - with_(other)) < 0.05
    assert with_(neutral) < 0.7 < with_(insult)


def test_the_fit_is_a_minimum():
    r = np.random.default_rng(2)
    texts = [(sorted(r.choice(12, 3, replace=False).tolist()), int(r.random() < 0.3), float(r.integers(1, 4))) for _ in range(80)]
    pairs = [([0], [1], 2.0), ([2, 3], [4], 1.0)]

    def loss(bias, w):
        z = np.array([bias + w[held].sum() for held, _, _ in texts])
        y, n = np.array([t for _, t, _ in texts]), np.array([n for *_, n in texts])
        change = sum(n * (w[a].sum() - w[b].sum()) ** 2 for a, b, n in pairs) / sum(n for *_, n in pairs)
        return (n * (np.log1p(np.exp(z)) - y * z)).sum() / n.sum() + toxicity.RIDGE / n.sum() * (w ** 2).sum() + change

    bias, w = toxicity.fitted(texts, pairs, 12)
    least = loss(bias, w)
    for _ in range(200):
        assert loss(bias + 1e-3 * r.normal(), w + 1e-3 * r.normal(size=12)) > least
    assert abs(w[0] - w[1]) < abs(toxicity.fitted(texts, [], 12)[1][0] - toxicity.fitted(texts, [], 12)[1][1])


def test_awkward_rows(spark):
    docs, labels = corpus(n=150)
    extra = small.texts()
    extra = [(i + 5000 if i is not None else None, t) for i, t in extra] + [docs[0]]
    more = [(5100, 1), (None, 1), (0, None), (77777, 1), (0, 1)]
    got = toxicity.score(*frames(spark, docs + extra, labels + more)).collect()
    assert len(got) == len(docs) + len(extra)
    assert all(r["score"] is not None and r["held_out"] == held_out(r["doc_id"]) for r in got)
    blank = {r["score"] for r in got if r["doc_id"] in (5100, 5101, 5102)}
    assert len(blank) == 1


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1), (2, 1)], [(1, None)]])
def test_few_labels_and_empty_tables(spark, labels):
    docs, marked = frames(spark, [(1, "one two"), (2, "three"), (4, None)], labels)
    got = toxicity.score(docs, marked).collect()
    assert len(got) == 3 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(small.empty(spark), marked).collect() == []

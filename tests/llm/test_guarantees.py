"""What operators promise, checked on unseen rows: false rejection of quality rules, held-out ranking of quality scores, languages against a plain model, recall of the vector search."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from rasterloom.llm import ann, language_id, quality_knn, quality_rules
from rasterloom.llm.common import words

BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled(spark):
    """(stratum, counts, label) of the labelled documents that pass the base rule."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    y = {r.doc_id: int(r.quality == 1) for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    rows = quality_rules.measures(docs.where(docs.doc_id.isin(list(y)))).collect()
    keep = [r for r in rows if r._n_words >= 50 and 100 * r._n_repeat_words <= 50 * r._n_words]
    return [(r._stratum, {c: r[f"_{c}"] for c in quality_rules.COUNTS}, y[r.doc_id]) for r in keep]


def exceeds(counts, rule, cutoff):
    count, of, _ = quality_rules.RULES[rule]
    return 100 * counts[count] > cutoff * counts[of]


def cutoffs(rows):
    """calibrate(), on lists."""
    good = Counter(s for s, _, y in rows if y)
    chosen = {}
    for _ in quality_rules.RULES:
        counts = Counter()
        for s, c, y in rows:
            if y or not any(exceeds(c, r, x) for r, x in chosen.get(s, {}).items()):
                for rule, (_, _, grid) in quality_rules.RULES.items():
                    counts[s, rule, sum(exceeds(c, rule, g) for g in grid), y] += 1
        added = quality_rules.next_rules(counts, good, chosen)
        for s, (rule, x) in added.items():
            chosen.setdefault(s, {})[rule] = x
        if not added:
            break
    return chosen


def test_false_rejection_is_within_the_risk_on_unseen_rows(labelled):
    """Cutoffs of one half reject no more of the other half's good documents than the risk, in no more splits than the error allows and chance explains."""
    rng = random.Random(4)
    exceeded, certified, caught = 0, 0, []
    for _ in range(20):
        rows = list(labelled)
        rng.shuffle(rows)
        half = len(rows) // 2
        chosen = cutoffs(rows[:half])
        for s, own in chosen.items():
            good = [c for t, c, y in rows[half:] if t == s and y]
            bad = [c for t, c, y in rows[half:] if t == s and not y]
            rejected = lambda c, own=own: any(exceeds(c, r, x) for r, x in own.items())
            certified += 1
            # More than the risk beyond what sampling of the other half explains.
            n = sum(map(rejected, good))
            exceeded += quality_rules.tail(n - 1, len(good), quality_rules.RISK) > 0.95 if n else 0
            caught.append(np.mean([rejected(c) for c in bad]) if bad else 0)
    assert certified >= 20, "no stratum has labels enough"
    assert exceeded <= 0.05 * certified + 1
    assert np.mean(caught) > 0.3


def test_calibration_on_lists_is_that_of_spark(spark, labelled):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    assert quality_rules.calibrate(quality_rules.measures(docs), labels) == cutoffs(labelled)


def test_quality_scores_rank_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.score, truth[r.doc_id]) for r in quality_knn.score_quality(docs, labels).collect() if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert len(good) > 100 and len(bad) > 30
    assert np.mean([(g > b) + (g == b) / 2 for g in good[:400] for b in bad[:400]]) >= 0.9


def test_languages_by_summing_over_all_label_sequences():
    """A text's posteriors, language and score from the trained field, against the sum over every labelling of its words."""
    rows = [("the cat sat on the mat and then it ran".split(), "en"), ("der hund und die katze sind in dem haus".split(), "de"), ("le chat est dans la maison avec un chien".split(), "fr")] * 6
    model = language_id.fit(rows, epochs=4)
    texts = ["the katze sat", "und la maison", "mat", "chien the und 12 haus", "...", ""]
    lang, score = model.predict([words(t) for t in texts])
    k = len(model.labels)
    t = np.exp(model.trans)
    for text, y, s in zip(texts, lang, score):
        w = words(text)
        letters = [any(map(str.isalpha, language_id.bare(x))) for x in w]
        if not any(letters):
            assert (y, s) == (language_id.UNKNOWN, 0)
            continue
        emission = []
        for x, has in zip(w, letters):
            z = model.weight[language_id.features(language_id.bare(x), model.lexicon)].sum(axis=0) if has else np.zeros(k)
            emission.append(np.exp(np.clip(z - z.max(), -30, 0)))
        total = np.zeros((len(w), k))
        for path in itertools.product(range(k), repeat=len(w)):
            p = t[:, path[0]].mean() * emission[0][path[0]]
            for i in range(1, len(w)):
                p *= t[path[i - 1], path[i]] * emission[i][path[i]]
            for i, label in enumerate(path):
                total[i, label] += p
        total /= total.sum(axis=1, keepdims=True)
        own = total[np.array(letters)].sum(axis=0)
        assert y == model.labels[int(own.argmax())] and abs(s - own.max() / own.sum()) < 1e-6


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet(f"{BIG}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.vec_id is not None and r.embedding is not None]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    got = {}
    for r in ann.nearest_neighbours(df).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = n = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        best = [int(i) for i in ids[np.lexsort((ids, d))] if i != q][:10]
        hits, n = hits + len(set(best) & set(got[q])), n + 10
        assert all(abs(s - d[ids == v][0]) < 1e-9 for v, s in got[q].items())
    assert hits >= 0.9 * n

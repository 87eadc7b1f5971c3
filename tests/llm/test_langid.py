import random
from zlib import crc32

import numpy as np

from helpers import DOCS, documents

from kgspark.llm.langid import BUCKETS, fit, has_letter, predict, subwords, train

SYLLABLES = {"en": "th er on an re he in ed nd ha", "de": "sch ein ung ich keit ß ü ö ge ver", "es": "ción ñ que ado os la rr ó ez mente"}


def corpus(n, seed=1):
    rng, out = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        text = " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 4))) for _ in range(rng.randint(5, 60)))
        out.append((i, text.upper() if i % 9 == 0 else text, lang))
    return out


def test_held_out_accuracy_and_independence_of_labels(spark):
    rows = corpus(600)
    got = {r["doc_id"]: r for r in predict(documents(spark, rows)).collect()}
    held = [(i, lang) for i, _, lang in rows if crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # Labels and sources of held-out documents have no part in anything.
    blind = [(i, t, "xx" if crc32(str(i).encode()) % 4 == 2 else lang, f"s{i}") for i, t, lang in rows]
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(documents(spark, blind)).collect()}
    assert again == {i: (r["lang_pred"], r["score"]) for i, r in got.items()}


def test_odd_texts(spark):
    rows = corpus(200)
    odd = [(1000, None), (1001, ""), (1002, " 12 !? \n"), (1003, "é"), (1004, "a" * 300_000), (1005, "日本"), (None, "the one"), (7, rows[7][1]), (7, rows[7][1])]
    df = documents(spark, [*rows, *[(*o, None, None) for o in odd]]).withColumnRenamed("n_chars", "score")
    got = predict(df).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    for i in (1000, 1001, 1002):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["rejected"]) == ("und", 0.0, True)
    for i in (1003, 1004, 1005, None):
        assert by[i]["lang_pred"] in SYLLABLES and 0 < by[i]["score"] <= 1
    assert predict(spark.createDataFrame([], DOCS)).count() == 0
    [r] = predict(documents(spark, [(1, "nothing to learn from", None, None)])).collect()
    assert (r["lang_pred"], r["rejected"]) == ("und", True)


def test_batches_do_not_matter():
    rows = corpus(80)
    model = train([t for _, t, _ in rows], [x for _, _, x in rows])
    texts = [t for _, t, _ in corpus(20, seed=9)]
    together, alone = model.probabilities(texts), [model.probabilities([t])[0] for t in texts]
    assert abs(together - alone).max() < 1e-9
    assert 0 <= model.threshold <= 0.5 and model.temperature > 0
    assert (model.probabilities(texts).argmax(axis=1) == [model.langs.index(x) for _, _, x in corpus(20, seed=9)]).mean() > 0.9


def test_subwords_by_hand():
    buckets, starts, counts = subwords(["ab c", ""])
    # " ab c    " and "     ": n-grams without two spaces in a row.
    assert counts[0] == sum(1 for n in (2, 3, 4) for i in range(9) if "  " not in (" ab c    " + "    ")[i : i + n]) and counts[1] == 0
    assert (buckets <= BUCKETS).all() and list(starts) == [0, 9]
    assert has_letter("1é") and not has_letter("12 ?") and not has_letter(None)


def test_sample_is_bounded(spark):
    model = fit(documents(spark, corpus(400)), per_lang=20)
    assert model.langs == sorted(SYLLABLES)


def test_more_labels_than_the_table_holds(spark):
    rows = corpus(300) + [(1000 + i, "some words of no language", f"label{i}") for i in range(450)]
    model = fit(documents(spark, rows), max_langs=6)
    assert set(SYLLABLES) < set(model.langs) and len(model.langs) == 6
    # Of the labels with one row each the smallest are learnt.
    rare = sorted(f"label{i}" for i in range(450) if crc32(str(1000 + i).encode()) % 4 != 2)
    assert sorted(set(model.langs) - set(SYLLABLES)) == rare[:3]
    found = predict(documents(spark, rows), model=fit(documents(spark, rows)))
    assert found.count() == len(rows) and {r["lang_pred"] for r in found.collect()} <= {lang for *_, lang in rows} | {"und"}


def test_a_bound_of_characters(spark):
    rows = [(i, "th er on " * 50, "en") for i in range(200)] + [(i, "sch ein ung", "de") for i in range(200, 240)]
    assert fit(documents(spark, rows), chars=1) is None
    assert set(fit(documents(spark, rows), chars=5000).langs) == {"de", "en"}


def test_predictions_equal_one_ngram_at_a_time():
    rows = corpus(200, seed=3)
    model = train([t for _, t, _ in rows], [lang for *_, lang in rows])
    for _, text, _ in [*corpus(20, seed=9), (0, "Ça va, l'été? Größe 12 x", "")]:
        data = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in b" " + text.lower().encode() + b"    ")
        sums, n = np.zeros(len(model.langs)), 0
        for order in (2, 3, 4):
            for i in range(len(data)):
                gram = (data + b"    ")[i : i + order]
                if b"  " in gram:
                    continue
                key = order
                for b in gram:
                    key = key * 0x01000193 % 2**32 ^ b
                sums += model.table[key * 0x9E3779B1 % 2**32 >> 17]
                n += 1
        logits = (sums / max(1, n) + model.bias) / model.temperature
        want = np.exp(logits - logits.max())
        assert np.allclose(model.probabilities([text])[0], want / want.sum(), atol=1e-6)

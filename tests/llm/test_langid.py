"""Language models against a plain dictionary version, held-out accuracy, odd texts."""

import tracemalloc
from collections import Counter, defaultdict
from math import log

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boutframe.llm import langid
from boutframe.llm.catalogue import QUERIES
from boutframe.llm.tables import table


def plain_models(texts_by_lang):
    """Interpolated Kneser-Ney probabilities with dictionaries: p(lang, context + char)."""

    def clean(t):
        out = " "
        for c in t.lower():
            c = c if c.isalpha() else " "
            out += "" if c == " " and out[-1] == " " else c
        return "   " + out[1:]

    n = langid.ORDER
    counts = {}
    for lang, texts in texts_by_lang.items():
        top = Counter(t[k - n + 1 : k + 1] for t in map(clean, texts) for k in range(n - 1, len(t)))
        counts[lang] = {n: top}
        for order in range(n - 1, 0, -1):
            counts[lang][order] = Counter(g[1:] for g in counts[lang][order + 1])
    alphabet = len({g for c in counts.values() for g in c[1]}) + 1
    facts = {}
    for lang, by_order in counts.items():
        for order, c in by_order.items():
            n1, n2 = (sum(v == k for v in c.values()) for k in (1, 2))
            total, kinds = defaultdict(int), defaultdict(int)
            for g, v in c.items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            facts[lang, order] = c, total, kinds, n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def p(lang, gram):
        if not gram:
            return 1 / alphabet
        c, total, kinds, d = facts[lang, len(gram)]
        lower = p(lang, gram[1:])
        if not total[gram[:-1]]:
            return lower
        return max(c[gram] - d, 0) / total[gram[:-1]] + d * kinds[gram[:-1]] / total[gram[:-1]] * lower

    def entropy(lang, text):
        t = clean(text)
        return -sum(log(p(lang, t[k - n + 1 : k + 1])) for k in range(n - 1, len(t))) / (len(t) - n + 1)

    return entropy


def counted(texts_by_lang):
    out = []
    for lang in sorted(texts_by_lang):
        chars, of = langid.codes(texts_by_lang[lang])
        out.append(langid._distinct(langid.grams(chars, of), np.ones(len(chars))))
    return langid.Models(sorted(texts_by_lang), out)


def test_models_equal_the_plain_version():
    train = {
        "a": ["The cat sat on the mat, the hat!", "a cat and a hat", "that rat"],
        "b": ["der Hut und die Katze saß", "ach, das ist übel", "und der Hut"],
        "c": ["漢字 と かな 漢字", "かな かな"],
    }
    models, plain = counted(train), plain_models(train)
    texts = ["the rat sat", "übel 12 Katze!", "漢字 mat", "zzz qqq Ж", "   x", "hat " * 50]
    got, _, n = models.score(texts)
    for row, text in zip(got, texts):
        assert row == pytest.approx([plain(lang, text) for lang in models.languages], rel=1e-4)
    assert n.tolist()[4] == 1
    # Every language's distribution sums to one over its alphabet and one unseen character.
    alphabet = sorted({c for ts in train.values() for t in ts for c in t.lower() if c.isalpha()} | {" "}) + ["Ж"]
    for context in ("the", "zzz", " de"):
        table_ = np.array([[ord(c) for c in context + x] for x in alphabet], np.uint32)
        assert np.exp(models.log_p(table_)).sum(axis=0) == pytest.approx(1, abs=1e-4)


def test_hash_array_finds_what_it_holds():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    held = langid.HashArray(keys, np.arange(len(keys)))
    assert (held.keys[held.find(keys)] == keys).all()
    assert (held.find(keys + np.uint64(1)) == -1).all()


@pytest.mark.parametrize("size", ["0.01"])
def test_held_out_accuracy_on_the_whole_table(spark, size):
    root = f"/root/testdata/sf{size}"
    docs = {r["doc_id"]: r for r in table(spark, root, "documents").collect()}
    rows = QUERIES["op9_language_id"](spark, root).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    held = [r for r in rows if r["held_out"]]
    right = sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["rejected"] for r in rows) <= 0.005 * len(rows)
    sure = [r for r in held if r["score"] > 0.9]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in sure) >= 0.97 * len(sure)


def test_odd_tables(spark, documents):
    docs = documents(
        *[(k, f"the cat sat on the mat number {'x' * (k % 7)}", "en", "s") for k in range(60)],
        *[(k, f"der Hund und die Katze nichts {'y' * (k % 5)}", "de", "s") for k in range(60, 120)],
        (200, None, "en", "s"), (201, "", None, None), (202, "12 !!", "de", "s"), (203, "der Hund " * 20_000, None, "s"), (None, "the cat", "en", "s"),
        (204, "漢字漢字漢字漢字漢字漢字漢字漢字漢字漢字漢字", None, "s"), (3, "the cat", "en", "s"),
        extra="score",
    )
    identifier = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, identifier).collect()}
    assert [got[k]["lang_pred"] for k in (200, 201, 202)] == ["und"] * 3
    assert [got[k]["lang_pred"] for k in (1, 61, 203, None)] == ["en", "de", "de", "en"]
    assert got[204]["rejected"] and not got[203]["rejected"]
    kept = langid.keep_identified(docs, identifier)
    assert kept.columns == docs.columns
    assert {200, 201, 202, 204}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert kept.count() == docs.count() - 4
    nothing = langid.train(docs.filter("lang IS NULL"))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), identifier).collect() == []


def test_the_sample_is_bounded(spark, documents):
    docs = documents(*[(k, "the cat sat", "en", "s") for k in range(3000)], *[(k, "der Hund", "de", "s") for k in range(50)])
    identifier = langid.train(docs, sample_docs=100)
    gram = np.array([[ord(c) for c in "  th"]], np.uint32)
    assert identifier.models.languages == ["de", "en"]
    assert np.isfinite(identifier.models.log_p(gram)).all()


def test_a_language_with_one_document_is_learned(spark, documents):
    rare = {f"r{k}": "".join(chr(0x4E00 + 40 * k + j) for j in range(30)) for k in range(12)}
    rows = [(k, f"the cat sat on the mat number {'x' * (k % 7)}", "en", "s") for k in range(60)]
    rows += [(100 + k, text, lang, "s") for k, (lang, text) in enumerate(rare.items())]
    identifier = langid.train(documents(*rows))
    assert set(identifier.models.languages) == {"en", *rare}
    assert [r[0] for r in identifier.predict([t[:20] for t in rare.values()])] == list(rare)


def test_a_wrong_label_does_not_lift_the_limit(spark, documents):
    rows = [(k, f"the cat sat on the mat and a dog {'ran' * (k % 4)} over hill {'and dale' * (k % 3)}", "en", "s") for k in range(300)]
    rows += [(300 + k, f"der Hund und die Katze {'laufen' * (k % 5)} im Garten umher", "de", "s") for k in range(300)]
    strange = "漢字かな交じり文とは漢字と仮名を交えて書く"
    clean = langid.train(documents(*rows))
    # Among the calibrating documents of English, one is another language.
    place = F.pmod(F.xxhash64(F.col("id"), F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    key = spark.range(1000, 2000).where(place < langid.CALIBRATION).first()["id"]
    spoiled = langid.train(documents(*rows, (key, strange, "en", "s")))
    assert spoiled.predict([strange])[0][3] and clean.predict([strange])[0][3]
    en = spoiled.models.languages.index("en")
    assert spoiled.limit(en, 50) == pytest.approx(clean.limit(en, 50), rel=0.2)
    assert not any(r[3] for r in spoiled.predict([t for _, t, _, _ in rows]))


def test_counting_a_batch_takes_memory_for_a_run_of_it():
    letters = np.random.default_rng(3).choice(list("abcdefgh "), 2_000_000)
    texts = ["".join(t) for t in np.split(letters, 400)]
    batch = pa.record_batch({"lang": ["a", "b"] * 200, "text": texts})
    counted = Counter()
    tracemalloc.start()
    try:
        for part in langid._count(iter([batch])):
            for lang, n in zip(part.column("lang").to_pylist(), part.column("n").to_pylist()):
                counted[lang] += n
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert counted == {x: sum(len(langid.codes([t])[0]) for t in texts[k::2]) for k, x in enumerate("ab")}
    assert peak < 40 << 20  # of a batch at once over 80 MB

"""Language, toxicity and licences: held-out accuracy and odd inputs."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import language, licences, toxicity

DATA = "/root/testdata/sf0.1"
ODD = [None, "", " \n", "1234 !!!", "a", "É", "x" * 100_000, "the of and " * 20_000, "日本", "$$ 12"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").toPandas()


def fold(ids, n):
    return ids.map(lambda i: zlib.crc32(str(i).encode()) % n)


def test_language_held_out(spark, documents):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    model = language.learn_languages(df, learn, per_language=150)
    got = language.identify_language(df.where(~learn), model).select("lang", "_language.*").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.99 and got.score.between(0, 1).all()


def test_codewords_are_apart():
    for k in (2, 3, 4, 7, 12):
        code = language.codewords(k)
        least = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
        assert least >= (1 if k == 2 else code.shape[1] / 4)


def test_language_odd_inputs(spark):
    rows = [("the cat and the dog of it", "en"), ("der hund und die katze", "de"), (None, "en"), ("x", None)]
    model = language.learn_languages(spark.createDataFrame(rows, "text string, lang string"), F.lit(True))
    df = spark.createDataFrame([(t, "c", 1) for t in ODD], "text string, lang_pred string, score int")
    got = [r._language for r in language.identify_language(df, model).collect()]
    assert [g.lang_pred == "und" for g in got] == [not any(c.isalpha() for c in t or "") for t in ODD]
    assert all(g.lang_pred == "und" for g in (r._language for r in language.identify_language(df, None).collect()))
    assert language.identify_language(df.where("false"), model).count() == 0
    one = language.LanguageModel.fit(["abc"], ["en"])
    assert one.predict(["zzz"])["lang_pred"].tolist() == ["en"]
    assert language.learn_languages(df.withColumn("lang", F.lit(None).cast("string")), F.lit(True)) is None


def test_language_equals_a_plain_version():
    """Counts, weights and loss-weighted decoding by loops over n-grams."""
    texts = ["the cat and the dog", "a dog of the house", "der hund und die katze", "die maus der katze", "le chat et le chien", "la souris du chat", "el gato y el perro"]
    langs = ["en", "en", "de", "de", "fr", "fr", "es"]
    model = language.LanguageModel.fit(texts, langs)
    mask = (1 << 64) - 1

    def grams(text):
        for word in text.split():
            w = f" {language.fold(word)} "
            for n in range(1, language.LONGEST + 1):
                for i in range(len(w) - n + 1 if w.strip() else 0):
                    if n > 1 or w[i] != " ":
                        value = 0
                        for c in w[i : i + n]:
                            value = (value * 0x100000001B3 + ord(c) + 1) & mask
                        yield (value * (0x9E3779B97F4A7C15 + 2 * n) & mask) >> 46

    names = sorted(set(langs))
    counts = {k: {} for k in names}
    for text, lang in zip(texts, langs):
        for g in grams(text):
            counts[lang][g] = counts[lang].get(g, 0) + 1
    rate = lambda lang, g: (counts[lang].get(g, 0) + 0.05) / (sum(counts[lang].values()) + 0.05 * language.BUCKETS)
    code = language.codewords(len(names))

    def margins(text):
        got = list(grams(text))
        out = []
        for b in range(code.shape[1]):
            side = lambda s: np.mean([[rate(k, g) for k, c in zip(names, code[:, b]) if c == s] for g in got], axis=1)
            out.append(np.mean(np.log(side(1)) - np.log(side(-1))))
        return np.array(out)

    learned = np.array([margins(t) for t in texts])
    signed = learned * code[[names.index(k) for k in langs]]
    scale = 4 / np.median(np.abs(learned), axis=0)
    good = np.maximum((signed > 0).mean(axis=0) - 0.5, 0.05)
    asked = ["the house", "die hund", "chien du chat", "perro gato", "xyz qq", "The Katze chat"]
    got = model.predict(asked)
    for text, name, score in zip(asked, got.lang_pred, got.score):
        distance = (np.log1p(np.exp(-margins(text) * scale * code)) * good / good.mean()).sum(axis=1)
        share = np.exp(-(distance - distance.min()))
        assert name == names[int(distance.argmin())] and abs(score - (share / share.sum()).max()) < 1e-3


def test_languages_learned_are_bounded_and_the_same(spark):
    rows = [(f"word{i} text{i % 7}", f"l{i % 4}") for i in range(400)] + [("same", "l0")] * 50
    frames = [spark.createDataFrame(r, "text string, lang string").repartition(n) for r, n in ((rows, 1), (rows[::-1], 5))]
    a, b = (language.learn_languages(f, F.lit(True), per_language=30, most=80) for f in frames)
    assert a.names == b.names == ["l0", "l1", "l2", "l3"] and np.allclose(a.weights, b.weights)


@pytest.fixture(scope="module")
def toxic_model(spark, documents):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    known = documents.merge(labels, on="doc_id")
    known["held"] = fold(known.doc_id, 3) == 1
    learn = known[~known.held]
    return toxicity.fit_toxicity(learn.text.tolist(), learn.toxic.tolist()), known


def test_toxicity_held_out(toxic_model):
    model, known = toxic_model
    held = known[known.held & (known.lang == "en")]
    scores = model.scores(held.text.tolist())
    toxic = held.toxic.to_numpy() > 0
    assert (scores[toxic] >= 0.7).mean() > 0.85 and (scores[~toxic] >= 0.7).mean() < 0.01


def test_gapped_insults(toxic_model):
    model, _ = toxic_model
    spelled = ["the i d i o t here", "an id.iot", "i-d-i-o-t", "1d10t", "moroon", "stuupid", "wortthless"]
    assert (model.scores(spelled) >= 0.7).all()
    assert (model.scores(["the trion onhe", "and therhe", ""]) < 0.5).all()


def test_toxicity_odd_inputs(spark, toxic_model):
    model, _ = toxic_model
    df = spark.createDataFrame([(t, "c") for t in ODD], "text string, score string")
    got = [r._toxicity for r in toxicity.score_toxicity(df, model).collect()]
    assert all(0 <= x < 0.7 for x in got)
    assert {r._toxicity for r in toxicity.score_toxicity(df, None).collect()} == {0.0}
    assert toxicity.fit_toxicity(["a"], [0]) is None and toxicity.fit_toxicity([], []) is None


def test_kernel_is_exact():
    words = ["abcd", "axbycz", "aab", "a"]

    def features(w):
        w, out = f"^{w}$", {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    key = w[i] + w[j] + w[k]
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i - 2)
        return out

    def product(a, b):
        return sum(v * b.get(k, 0) for k, v in a.items())

    f = [features(w) for w in words]
    want = [[product(a, b) / np.sqrt(product(a, a) * product(b, b)) for b in f] for a in f]
    assert np.allclose(toxicity.kernel(words, words), want, atol=1e-6)


def word_features(w):
    w, out = f"^{w}$", {}
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                key = w[i] + w[j] + w[k]
                out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i - 2)
    size = sum(v * v for v in out.values()) ** 0.5
    return {k: v / size for k, v in out.items()}


def phrase_kernel(a, b):
    pairs = [sum(v * g.get(k, 0) for k, v in f.items()) for f in map(word_features, a) for g in map(word_features, b)]
    return sum(pairs) / (len(a) * len(b)) ** 0.5


def test_phrase_kernel_beyond_latin():
    phrases = [("abcd", "idiot"), ("axbycz",), ("дурак", "aab", "дура"), ("фурак",)]
    want = [[phrase_kernel(a, b) for b in phrases] for a in phrases]
    assert np.allclose(toxicity.phrase_features(phrases, phrases), want, atol=1e-5)
    assert toxicity.kernel(["дурак"], ["фурак"])[0, 0] < 0.8


def plain_margin(model, text):
    """The decision function phrase by phrase, from landmarks and their weights."""
    best, sentence = 0.0 if not text.split() else -np.inf, []
    for w in toxicity.tokens(text) + ["."]:
        sentence.append(w)
        if w[-1] in ".!?":
            for i in range(len(sentence)):
                for n in range(1, min(toxicity.PHRASE, len(sentence) - i) + 1):
                    words = [f for f in map(toxicity.fold, sentence[i : i + n]) if len(f) > 2]
                    # Words of less than three letters count in a phrase's length alone.
                    value = sum(b * phrase_kernel(words, m) * (len(words) / n) ** 0.5 for b, m in zip(model.beta, model.landmarks)) if words else 0.0
                    best = max(best, value)
            sentence = []
    return best + model.offset


def test_margins_equal_the_kernel_machine():
    clean = [f"the {a} and {b} of. this is {b} only" for a in ("tree", "house", "river", "stone") for b in ("green", "tall", "quiet")]
    bad = [f"the {a} is a {b}. of it" for a in ("tree", "house", "river", "stone", "garden", "window") for b in ("grubbel", "waste of space", "snarfo")]
    model = toxicity.fit_toxicity(clean + bad, [0] * len(clean) + [1] * len(bad), landmarks=24)
    texts = clean[:3] + bad[:4] + ["", "a", "gr ub bel", "s n a r f o!", "no. it is waste. of space", "grubbbel"]
    assert np.allclose(model.text_margins(texts), [plain_margin(model, t) for t in texts], atol=1e-4)
    scores = model.scores(bad + clean)
    assert (scores[: len(bad)] >= 0.7).all() and (scores[len(bad) :] < 0.7).all()
    assert (model.scores(["what a grubbbel", "a s n a r f o"]) > model.scores(clean).max()).all()


def test_squared_hinge_is_at_its_minimum():
    rng = np.random.default_rng(0)
    z, y, c = rng.normal(size=(60, 4)), np.sign(rng.normal(size=60)), rng.uniform(0.5, 2, 60)
    w, b = toxicity.squared_hinge(z, y, c)
    cost = lambda w, b: (w @ w + 1e-3 * b * b) / 2 + (c * np.maximum(0, 1 - y * (z @ w + b)) ** 2).sum()
    assert all(cost(w + d[:4], b + d[4]) >= cost(w, b) for d in rng.normal(scale=1e-2, size=(200, 5)))


def test_toxicity_learning_is_the_same_whatever_the_order(spark):
    rows = [(i, f"the {w} of it{i}", "x") for i, w in enumerate(["tree", "house", "grubbel", "grubbel", "grubbel", "stone"] * 3)]
    rows += rows[:4] + [(2, "zzz grubbel", "y"), (None, "grubbel", None), (77, None, None)]
    labels = spark.createDataFrame([(i, int(w[1].find("grubbel") >= 0)) for i, w in enumerate(rows[:18])] + [(3, None), (None, 1), (77, 1), (4, 0)], "doc_id long, toxic int")
    tables = [spark.createDataFrame(r, "doc_id long, text string, toxic string").repartition(n) for r, n in ((rows, 1), (rows[::-1], 3))]
    a, b = (toxicity.learn_toxicity(t, labels, F.lit(True)) for t in tables)
    assert np.array_equal(a.table, b.table) and a.shift == b.shift
    assert [r._toxicity >= 0.7 for r in toxicity.score_toxicity(tables[0].where("doc_id = 2 or doc_id = 0").orderBy("doc_id"), a).collect()] == [False, False, True, True, True]
    # A word of one sentence and its copies is no insult.
    copies = [("the tree is green" if i % 2 else "such a grubbel", i % 2 == 0) for i in range(40)]
    one = toxicity.fit_toxicity([t for t, _ in copies], [int(b) for _, b in copies], rounds=1)
    assert one is None or one.scores(["the house is tall"])[0] < 0.7
    assert toxicity.learn_toxicity(tables[0], labels.where("false"), F.lit(True)) is None


def test_licences(spark):
    texts = {
        "Licensed under the Apache License, Version 2.0.": ("Apache-2.0", [], [], True),
        "intro\nReleased under the MIT License.\noutro": ("MIT", [], [], True),
        "Released under MIT License": ("MIT", ["the"], [], False),
        "This work is licensed under the GNU General Public License, version 2.": ("GPL-2.0", [], [], True),
        "ALL RIGHTS RESERVED": ("all-rights-reserved", [], [], True),
    }
    rows = [(i, t, "x", True) for i, t in enumerate([*texts, None, "", "all the rights of the version", "word " * 50_000 + "\nLicensed under CC BY-NC 4.0.\n"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, licence string, exact boolean").repartition(2)
    got = {r.doc_id: r for r in licences.scan_licences(df).collect()}
    for i, want in enumerate(texts.values()):
        assert (got[i].licence, got[i].missing, got[i].extra, got[i].exact) == want
        assert got[i].saved_bytes > 0
    assert set(got) == {0, 1, 2, 3, 4, 8} and got[8].licence == "CC-BY-NC-4.0"
    assert rows[1][1][got[1].start : got[1].end] == "Released under the MIT License."
    assert licences.scan_licences(df.where("false")).count() == 0


@pytest.mark.parametrize("n", [100, 1000, 20_000])
def test_licences_in_long_lines(documents, n):
    scanner, words = licences.LicenceScanner(licences.TEMPLATES), " ".join(documents.text.dropna().head(900)).split()
    for notice, licence in (("All rights reserved.", "all-rights-reserved"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0")):
        for at in (0, 15_000, 30_000):
            line = words[at : at + n]
            text = " ".join([*line[: n // 2], notice, *line[n // 2 :]])
            found = [(text[start:end], f["licence"], f["missing"], f["extra"]) for start, end, f in scanner.scan(text)]
            assert (notice, licence, [], []) in found
    # Windows that zstandard leaves raw.
    [(start, end, found)] = scanner.scan("All rights reserved.\nThe eratened th, handha, reat re ates thtintsh eneaer ea.")
    assert (start, end, found["licence"]) == (0, 20, "all-rights-reserved")


def test_licences_side_by_side():
    scanner = licences.LicenceScanner(licences.TEMPLATES)
    found = lambda text: [(text[start:end], f["licence"], f["missing"], f["extra"]) for start, end, f in scanner.scan(text)]
    header = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    assert found(f"Copyright (c) X. All rights reserved.\n{header}") == [("All rights reserved.", "all-rights-reserved", [], []), (header, "BSD", [], [])]
    assert found("Released under the MIT License. Licensed under CC BY 4.0.") == [("Released under the MIT License.", "MIT", [], []), ("Licensed under CC BY 4.0.", "CC-BY-4.0", [], [])]
    assert [x[1:] for x in found("Released under MIT License. Licensed by X under CC BY 4.0. Released under MIT License")] == [("MIT", ["the"], []), ("CC-BY-4.0", [], ["by", "x"]), ("MIT", ["the"], [])]
    for text in sum(licences.TEMPLATES.values(), []):
        assert [x[2:] for x in found(f"{text} {text}\n{text}")] == [([], [])] * 3
    every = [(text, name, [], []) for name, texts in licences.TEMPLATES.items() for text in texts]
    assert found(" ".join(x[0] for x in every)) == every


def brute_notices(scanner, words):
    """judge() on every window of words, the best of them at separate spans, and again on the words between."""
    found, longest = [], 2 * max(len(t[2]) for t in scanner.templates)
    for i in range(len(words)):
        for j in range(i + 1, min(len(words), i + longest) + 1):
            if one := scanner.judge(" ".join(words[i:j])):
                found.append((one["rank"], i + one["span"][0], i + one["span"][1], one["licence"]))
    out = []
    for rank, a, b, licence in sorted(found):
        if all(b <= x or y <= a for x, y, _ in out):
            out.append((a, b, licence))
    return sorted(out)


def test_licences_against_every_window():
    some = {k: [t for t in v if len(t.split()) < 14] for k, v in licences.TEMPLATES.items() if k in ("CC-BY-4.0", "MIT", "all-rights-reserved", "GPL-3.0", "CC-BY-SA-4.0")}
    scanner, rng = licences.LicenceScanner(some), np.random.default_rng(5)
    fill = "the of version and license work under by rights reserved green tree 4.0 general all a licensed released".split()
    for _ in range(25):
        words = rng.choice(fill, 12).tolist()
        for _ in range(int(rng.integers(1, 4))):
            notice = licences._words(rng.choice([t for v in some.values() for t in v]))
            if rng.random() < 0.5:
                notice[int(rng.integers(len(notice)))] = rng.choice(fill)
            if rng.random() < 0.5:
                notice.insert(int(rng.integers(len(notice))), rng.choice(fill))
            at = int(rng.integers(len(words)))
            words[at:at] = notice
        got = {(*f["span"], f["licence"]) for f in scanner.notices(words)}
        want = brute_notices(scanner, words)
        # Each notice of the brute-force version is found at its place, and nothing elsewhere.
        assert all(any(a < y and x < b and licence == other for x, y, other in got) for a, b, licence in want), (words, want, got)
        for f in scanner.notices(words):
            template = scanner.templates[f["template"]][2]
            assert sorted(template) == sorted([*f["missing"], *_without(words[slice(*f["span"])], f["extra"])])
            assert len(f["missing"]) <= 0.2 * len(template) and len(f["extra"]) <= 0.4 * len(template)


def _without(words, some):
    left = list(words)
    for w in some:
        left.remove(w)
    return left


def test_licences_are_not_found_in_scattered_words():
    scanner = licences.LicenceScanner(licences.TEMPLATES)
    for text in ("all of the rights in this region are reserved for the tribe", "All " + "tree " * 17 + "rights here are never reserved", "the general public of this work is licensed in version 2"):
        assert scanner.scan(text) == []
    [(start, end, found)] = scanner.scan("Text shared under CC BY 4.0 by the team")
    assert found["licence"] == "CC-BY-4.0" and found["missing"] == ["licensed"] and "Text shared under CC BY 4.0 by the team"[start:end] == "under CC BY 4.0"


def test_licences_of_repeated_rows(spark):
    text = "Licensed under CC BY 4.0.\nAll rights reserved."
    df = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    got = [(r.doc_id, r.licence) for r in licences.scan_licences(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(i, x) for i in (1, 1, None) for x in ("CC-BY-4.0", "all-rights-reserved")]))

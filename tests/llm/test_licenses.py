"""License scans against a plain search, planted notices and edge cases."""

import math
import random
import re

from glyphspark.llm import licenses

WORD = re.compile(licenses.WORD)
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, labels int, file string, words string"


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, templates=licenses.TEMPLATES):
    """Rows of scan() by looking at every file, template and beginning."""
    files = [plain_words(t) for _, t in docs]
    df = {w: sum(w in f for f in map(set, files)) for _, text, _ in templates for w in licenses.words_of(text)}
    index = {}
    for t, (_, text, phrases) in enumerate(templates):
        here = licenses.words_of(text)
        if all(df[w] for p in phrases for w in licenses.words_of(p)):
            index[t] = {w: math.floor(1000 * math.log((len(docs) + 1) / (df[w] + 1))) + 1 for w in sorted({w for w in here if df[w]}, key=lambda w: (df[w], w))[: licenses.INDEXED]}
    stand = lambda f, p: [i for i in range(len(f)) if f[i : i + len(p)] == p]
    out = []
    for (doc_id, _), f in zip(docs, files, strict=True):
        places = [(i, label) for p, label in licenses.BASE.items() for i in stand(f, licenses.words_of(p))]
        base, labels, score = {x for _, x in places}, {x for _, x in places}, 0.5 if places else 0.0
        for t, (label, text, phrases) in enumerate(templates):
            here = licenses.words_of(text)
            if t not in index or len(index[t].keys() & set(f)) < licenses.TOGETHER:
                continue
            whole = sum(index[t].get(w, 0) for w in here)
            must = {p: [i - j for i in stand(f, licenses.words_of(p)) for j in stand(here, licenses.words_of(p))] for p in phrases}
            for start in range(-len(here), len(f)):
                agree = [w for i, w in enumerate(here) if w in index[t] and 0 <= start + i < len(f) and f[start + i] == w]
                if len(set(agree)) >= licenses.TOGETHER and all(any(abs(at - start) <= licenses.DRIFT for at in must[p]) for p in phrases):
                    labels.add(label)
                    score = max(score, sum(index[t][w] for w in agree) / whole)
        at = [i for i, _ in places]
        out.append((doc_id, len(f), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
    return sorted(out, key=repr)


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 1, "clash", "clash") for d, t in docs], SCHEMA)


def scanned(spark, docs, **more):
    got = licenses.scan(frame(spark, docs), **more)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


def prose(rng, n):
    return " ".join(rng.choices(["the", "of", "this", "is", "under", "license", "a", "to", "version", "cc", "by", "public", "lorem", "É", "3", "all", "rights"], k=n))


def planted():
    """Each template in prose, whole and with a word put in or taken out."""
    rng, out = random.Random(3), []
    for t, (label, text, _) in enumerate(licenses.TEMPLATES):
        words = text.split()
        cut = rng.randrange(1, len(words) - 1)
        for k, w in enumerate((words, [*words[:cut], "indeed", *words[cut:]], words[:cut] + words[cut + 1 :])):
            out.append((10 * t + k, f"{prose(rng, rng.randint(0, 30))}.\n{' '.join(w)}. {prose(rng, rng.randint(0, 30))}", label if not k else None))
    return out


def test_scan_equals_a_plain_search(spark):
    rng, docs = random.Random(1), [(d, t) for d, t, _ in planted()]
    docs += [(None, None), (1000, ""), (1001, " .,- "), (1002, "CC-BY cc by, Cc\nBy; all rights reserved ALL RIGHTS"), (1002, "CC-BY cc by, Cc\nBy; all rights reserved ALL RIGHTS"), (None, "GNU general  public-license")]
    docs += [(1003, "Released under the MIT License. " * 700), (1004, "all " * 3000 + "rights reserved"), (1005, "worK licensed under İ license ÀLL rights reserved")]
    docs += [(2000 + i, prose(rng, rng.randint(0, 120))) for i in range(60)]
    assert scanned(spark, docs) == plain(docs)


def test_whole_notices_are_found_and_prose_is_left_alone(spark):
    cases = planted()
    got = {r[0]: r for r in scanned(spark, [(d, t) for d, t, _ in cases])}
    for d, _, label in cases:
        if label:
            assert label in got[d][6].split(",") and got[d][7] == 1.0, (d, label)
    rng = random.Random(9)
    assert all(r[6] == r[5] for r in scanned(spark, [(i, prose(rng, 200)) for i in range(30)] + [(99, cases[0][1])]) if r[0] != 99)


def test_spans(spark):
    from glyphspark.llm.common import Scratch

    text = "one two three. Released under the MIT License. four " * 3
    seen, index = licenses.files(frame(spark, [(1, text), (2, "nothing here")]), Scratch(spark, "test"))
    assert sorted((r.label, r.start) for r in licenses.found(seen, index).collect() if r.share == 1) == [("mit", 3), ("mit", 12), ("mit", 21)]


def test_empty_and_bare_tables(spark):
    assert scanned(spark, []) == []
    assert scanned(spark, [(1, None), (2, "plain words")]) == [(1, 0, 0, None, None, "", "", 0.0), (2, 2, 0, None, None, "", "", 0.0)]


def test_plan_is_native(spark):
    got = licenses.scan(frame(spark, [(1, "cc by")]))
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())

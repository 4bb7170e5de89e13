"""The learned models against plain versions of their arithmetic, one text at a time."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerlink.llm import attention, language, lines
from ledgerlink.llm.words import mixed

from .conftest import SCHEMA, odd_rows, odd_texts

BYTE_WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
LABELS = {"labels": "doc_id long, quality int, toxic int"}


def plain_features(text):
    """One row of features per 64 words, from counters."""
    data = text.encode()
    words = [(m.start(), m[0]) for m in BYTE_WORDS.finditer(data)]
    bags = [words[k : k + 64] for k in range(0, len(words), 64)] or [[]]
    begins = [0, *(bag[0][0] for bag in bags[1:]), len(data)]
    out = []
    for bag, a, b in zip(bags, begins, begins[1:]):
        kinds = [int(attention.CLASS[c]) for c in data[a:b]]
        chars, row = max(len(kinds), 1), [0.0] * attention.FEATURES
        for kind, n in Counter(kinds).items():
            row[kind] = n / chars
        for (one, two), n in Counter(zip(kinds, kinds[1:])).items():
            cell = int(mixed(np.array([one * attention.CLASSES + two]))[0]) % attention.PAIR_CELLS
            row[attention.CLASSES + cell] += n / chars
        texts = [w for _, w in bag]
        per = max(len(texts), 1)
        row[-8:] = [
            math.log1p(len(texts)),
            len(set(texts)) / per,
            sum(x == y for x, y in zip(texts, texts[1:])) / per,
            sum(map(len, texts)) / per / 10,
            sum(len(w) > 24 for w in texts) / per,
            sum(chr(w[0]).isupper() and w[0] < 128 for w in texts) / per,
            sum(attention.CLASS[w[-1]] >= 7 for w in texts) / per,
            sum(len(w) == 1 for w in texts) / per,
        ]
        out.append(row)
    return out


def plain_score(p, rows):
    codes, raw = [], []
    for row in rows:
        x = [min(max((v - m) / s, -6), 6) for v, m, s in zip(row, p["mean"], p["spread"])]
        code = [math.tanh(sum(v * w for v, w in zip(x, col)) + b) for col, b in zip(p["encode"].T, p["encode_bias"])]
        value = [math.tanh(sum(c * w for c, w in zip(code, col))) for col in p["value"].T]
        gate = [1 / (1 + math.exp(-sum(c * w for c, w in zip(code, col)))) for col in p["gate"].T]
        codes.append(code)
        raw.append(sum(v * g * a for v, g, a in zip(value, gate, p["attend"])))
    weight = [math.exp(r - max(raw)) for r in raw]
    pooled = [sum(w * c[k] for w, c in zip(weight, codes)) / sum(weight) for k in range(attention.CODE)]
    return 1 / (1 + math.exp(-sum(v * w for v, w in zip(pooled, p["out"])) - p["out_bias"][0]))


def test_quality_is_a_plain_forward_pass(spark, samples):
    long = " ".join(f"w{k % 97}" + "." * (k % 13 == 0) for k in range(20_000))
    texts = [t or "" for t in odd_texts()] + [long] + [r["text"] or "" for r in samples("documents")][:40]
    x, first = attention.passages(texts)
    assert np.diff(first).tolist() == [max(1, -(-len(BYTE_WORDS.findall(t.encode())) // 64)) for t in texts]
    plain = [plain_features(t) for t in texts]
    assert np.allclose(x, [row for rows in plain for row in rows], atol=1e-5)
    labels = np.arange(len(texts)) % 2
    model = attention.fit(x, first, labels.astype(float))
    told = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = [r["s"] for r in told.select(attention.score(told["text"], model).alias("s")).collect()]
    # The long documents by the plain version would take minutes; their passages are compared above.
    for rows, score in zip(plain, got):
        if len(rows) < 20:
            assert abs(plain_score(model.weights, rows) - score) < 1e-4


def plain_grams(text):
    kept = ""
    for c in text.lower():
        if c.isalpha():
            kept += c
        elif not kept or kept[-1] != " ":
            kept += " "
    kept += " "
    grams = []
    for n in (1, 2, 3):
        for k in range(len(kept) - n + 1):
            if any(map(str.isalpha, kept[k : k + n])):
                state = 0
                for size, c in enumerate(kept[k : k + n], 1):
                    state = ((state ^ ord(c)) * 0x01000193 + size) % 2**32
                grams.append((state * 0x9E3779B1) % 2**32 >> 18)
    return grams


def test_languages_are_those_of_a_plain_naive_bayes(spark, samples, save):
    rows = [(1000 + r["doc_id"], r["text"], r["lang"], r["source"], 0) for r in samples("documents")]
    rows += [r for r in odd_rows() if r[0] is not None and len(r[1] or "") < 2000]
    rows += [(700 + k, f"  {k}. \u2019{t}", "xx" if k % 2 else "en", None, 0) for k, t in enumerate(["one two", "deux", "a b c"])]
    counts, seen = {}, Counter()
    for i, text, lang, _, _ in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1 and lang is not None:
            counts.setdefault(lang, Counter()).update(plain_grams(text or ""))
            seen[lang] += 1
    names = sorted(counts)
    wanted = {}
    for i, text, *_ in rows:
        grams = Counter(plain_grams(text or ""))
        logs = []
        for name in names:
            whole = sum(counts[name].values()) + language.SMOOTHING * language.BUCKETS
            like = sum(n * math.log((counts[name][g] + language.SMOOTHING) / whole) for g, n in grams.items())
            logs.append(like + math.log((seen[name] + 1) / (sum(seen.values()) + len(names))))
        best = max(logs)
        known = any(map(str.isalpha, text or ""))
        wanted.setdefault(i, []).append((names[logs.index(best)], 1 / sum(math.exp(v - best) for v in logs)) if known else ("und", 0.0))
    got = {}
    for r in language.op6_language(spark, save(documents=rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert got.keys() == wanted.keys()
    for i, found in got.items():
        for (lang, score), (name, share) in zip(sorted(found), sorted(wanted[i])):
            assert lang == name and abs(score - share) < 2e-2


def test_grams_of_a_text_do_not_depend_on_its_neighbours():
    texts = [" 1 ab", "", "c", "...", "  d\0e ", "ab"]
    for order in (texts, texts[::-1]):
        found, starts = language.cells(order)
        for t, a, b in zip(order, starts, [*starts[1:], len(found)]):
            cells = [c for c in found[a:b].ravel().tolist() if c != language.BUCKETS]
            assert sorted(cells) == sorted(plain_grams(t.replace("\0", " ")))


def test_fitting_takes_all_parts_of_long_documents():
    assert attention.spread(3, 10).tolist() == list(range(3, 10))
    wide = attention.spread(5, 100_005, 64)
    assert len(set(wide.tolist())) == 64 and (wide[0], wide[-1]) == (5, 100_004)
    assert lines.run_of_lines(7, 2, 402) == slice(2, 402)
    runs = [lines.run_of_lines(i, 10, 10_010) for i in range(200)]
    assert all(r.stop - r.start == lines.SAMPLE_LINES and 10 <= r.start and r.stop <= 10_010 for r in runs)
    assert min(r.start for r in runs) < 1000 and max(r.stop for r in runs) > 9000


@pytest.mark.parametrize("train", [attention.train, lines.train])
def test_repeated_rows_of_a_labelled_document_count_once(spark, train):
    docs = [(i, f"some text {i}\n" * (5 + i % 3) if i % 2 else f"$$ 9 {i}\n9 9 9\n" * 4) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once = train(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    many = train(spark.createDataFrame(docs * 3 + [(3, None)], "doc_id long, text string"), labels.union(labels))
    parts = (lambda m: m.weights.values()) if train is attention.train else (lambda f: vars(f).values())
    assert all(np.array_equal(a, b) for a, b in zip(parts(once), parts(many)))

"""All five stages of the pipeline, and the mix, against plain versions on a small table."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers as vocabularies
import pytest
import tiktoken

import corpus_pipeline
from ledgerlink.llm import mixing

from .conftest import odd_rows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
WEIGHTS = (1, 2, 3)


def plain_near_copies(rows):
    """One row of each component of similar texts, the one with the lowest id."""
    sets = []
    for r in rows:
        w = WORDS.findall(r[1].translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return [min(g, key=lambda r: r[0]) for g in groups.values()]


def plain_passages(rows):
    """Words of windows of 20 that start earlier go, each with the white space behind it."""
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r[0]):
        spans = [m.span() for m in WORDS.finditer(r[1])]
        words = [r[1][a:b] for a, b in spans]
        gone = set()
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone.update(range(k, k + 20))
            seen.add(window)
        ends = [*[a for a, _ in spans[1:]], len(r[1])]
        pieces = [r[1][: spans[0][0]]] if spans else [r[1]]
        pieces += [r[1][a:e] for k, ((a, _), e) in enumerate(zip(spans, ends)) if k not in gone]
        text = "".join(pieces)
        if not gone or WORDS.search(text):
            out.append((r[0], text, *r[2:]))
    return out


def plain_mix(rows):
    """(row, source size, target, begin, copies as (first word in the stream, words taken)) of every row."""
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORDS.findall(r[1] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, total = {}, sum(sizes.values())
    while True:  # cap what is above, share the rest by weight
        left = total - sum(target.values())
        open_ = [s for s in names if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] >= 3 * sizes[s]]
        if not above:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in above}
        if len(above) == len(open_):
            break
    out = []
    for s in names:
        begin = 0
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(f"mix-{'' if r[0] is None else r[0]}".encode()).hexdigest()):
            size = len(WORDS.findall(r[1] or ""))
            copies, at = [], begin
            while sizes[s] and at < round(target[s]):
                copies.append((at, min(size, round(target[s]) - at)))
                at += sizes[s]
            out.append((r, sizes[s], target[s], weight[s], begin, copies))
            begin += size
    return out


def plain_time(share, weight):
    """Where a share of a schedule's area is reached, by halving."""
    schedule = mixing.schedules(3)[weight - 1]

    def area(t):
        return sum(
            (min(t, t1) - t0) * (2 * w0 + (w1 - w0) * (min(t, t1) - t0) / (t1 - t0)) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]) if t > t0
        )

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if area(mid) < share * area(1.0) else (low, mid)
    return high


def table_rows():
    draw = np.random.default_rng(12)
    english = ["the", "river", "house", "walks", "green", "often", "about", "people", "table", "never", "window", "morning"]
    german = ["der", "fluss", "häuser", "läuft", "grün", "oft", "über", "leute", "tisch", "niemals", "fenster", "morgen"]
    rows = []
    for i in range(70):
        words = german if i % 3 == 0 else english
        text = " ".join(draw.choice(words, int(draw.integers(8, 90)))) + ("\n" if i % 5 else ".")
        rows.append((i, text, "de" if i % 3 == 0 else "en", [None, "a", "b", "c", "hot"][min(4, int(draw.integers(0, 9)))], len(text)))
    passage = " ".join(draw.choice(english, 30))
    for i in range(8):
        text = " ".join(draw.choice(english, 20)) + "  " + passage + "\n" + " ".join(draw.choice(english, 12))
        rows.append((100 + i, text, "en", "hot", len(text)))
    rows += [(200 + i, passage, "en", "b", 1) for i in range(2)]
    for i in range(10):  # near copies and exact ones
        words = rows[60 + i // 2][1].split(" ")
        if i % 2:
            words[0] = f"changed{i}"
        rows.append((300 + i, " ".join(words), "en", "hot", 5))
    return [*rows, (400, "12 34 !", "en", "a", 7), (401, "", "en", "a", 0), (402, None, "en", "a", 0)]


def test_the_pipeline_is_its_plain_version(spark, save):
    rows = table_rows()
    left = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]  # both languages are easily told
    left = plain_passages(plain_near_copies(left))
    assert 0 < len(left) < len(rows) - 10
    ranks = {}
    for line in open(vocabularies.path("byte_bpe_50k.tiktoken"), "rb"):
        token, rank = line.split()
        ranks[base64.b64decode(token)] = int(rank)
    library = tiktoken.Encoding("plain", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r, *_, copies in plain_mix(left):
        size = len(WORDS.findall(r[1]))
        taken = sum(n for _, n in copies)
        ids = library.encode(r[1], disallowed_special=())
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want[r[0], r[2], r[3], len(ids), tuple(ids), digest, hashlib.sha256(r[1].encode()).hexdigest()] += int((taken + size / 2) // size)
    out = corpus_pipeline.run(spark, save(documents=rows))
    got = Counter((r["doc_id"], r["lang"], r["source"], r["n_tokens"], tuple(r["ids"]), r["ids_sha256"], r["decoded_sha256"]) for r in out.collect())
    assert got == +want


@pytest.mark.parametrize("extra", [[], odd_rows()[:16]])
def test_the_mix_is_its_plain_version(spark, save, extra):
    rows = [*table_rows(), *[(500 + i, *r[1:]) for i, r in enumerate(extra)]]
    df = mixing.op7_mixing(spark, save(documents=rows))
    assert "rangepartitioning" in df._jdf.queryExecution().executedPlan().toString()
    out = df.collect()
    assert [r["position"] for r in out] == sorted(r["position"] for r in out)
    got = {r["doc_id"]: r for r in out}
    assert len(got) == len(rows)
    for r, source_size, target, weight, begin, copies in plain_mix(rows):
        mine = got[r[0]]
        assert (mine["size"], mine["source_size"]) == (len(WORDS.findall(r[1] or "")), source_size)
        assert mine["target"] == pytest.approx(target) and mine["taken"] == sum(n for _, n in copies) <= 3 * mine["size"]
        at = plain_time(min(1.0, begin / target), weight) if target else 0.0
        assert mine["position"] == pytest.approx(at, abs=1e-6)


def test_mixing_takes_no_notice_of_extra_columns(spark, save):
    rows = table_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ("size", "order", "cell", "mix_source", "begin", "running", "taken", "positions", "position", "target", "schedule", "of", "at", "before")
    odd = docs.selectExpr("*", *[f"'x' as {n}" for n in names])
    plain, got = mixing.training_order(docs), mixing.training_order(odd)
    assert got.columns == odd.columns
    assert [r["doc_id"] for r in got.collect()] == [r["doc_id"] for r in plain.collect()]

"""Filter interaction audit, conversation repair and toxicity against plain versions."""

import hashlib
import re
import zlib
from itertools import permutations, product

import numpy as np
import pytest

from ledgerlink.llm import interactions, repair, toxicity

from .conftest import SCHEMA, odd_rows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"
TURNS = "conv_id long, turn long, role string, text string"

# --- 11 --------------------------------------------------------------------------------------


def plain_audit(documents, labels):
    """Every document is sent through every order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    lowest = {}
    for doc_id, text, *_ in documents:
        if doc_id is not None:
            lowest[text or ""] = min(doc_id, lowest.get(text or "", doc_id))
    seen = {}
    for doc_id, text, _, source, *_ in documents:
        t = text or ""
        w = WORDS.findall(t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": doc_id is not None and lowest[t] < doc_id,
        }
        seen.setdefault(source or "", []).append(({x for x in fails if fails[x]}, doc_id in good, doc_id in toxic))
    out = {}
    for part, docs in seen.items():
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                total[x] += len(gone)
                failing = sum(x in d[0] for d in docs)
                out[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), sum(d[0] == {x} for d in docs),
                    sum(d[1] for d in gone), sum(d[2] for d in gone), x,
                ]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = total[row[-1]]
    return out


@pytest.mark.parametrize("n", range(6))
def test_swaps_meet_every_order_once(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for k in interactions.swaps_through_all_orders(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert seen == set(permutations(range(n)))


def test_a_diagram_keeps_its_weights_through_swaps():
    draw = np.random.default_rng(3)
    weights = {m: (int(draw.integers(0, 4)),) for m in range(16)}
    diagram = interactions.Diagram(weights, 4, (0,))
    for k in interactions.swaps_through_all_orders(4):
        diagram.swap(k)
        for level in range(4):
            ahead = diagram.order[: level + 1]
            kept = sum(w[0] for m, w in weights.items() if not any(m >> f & 1 for f in ahead))
            assert diagram.steps()[level][0] == (kept,)
    # Parts that are equal are one node, however many masks lead there.
    even = interactions.Diagram({m: (1,) for m in range(16)}, 4, (0,))
    even.swap(1)
    assert [len(level) for level in even._levels] == [1, 1, 1, 1]


def audit_rows(out):
    return {
        (r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
        for r in out.collect()
    }


def test_audit_of_odd_rows_is_that_of_every_document(spark, save):
    junk = [
        (i, t, "en", s, None)
        for i, (t, s) in enumerate(
            product(["A B C " * 90, "plain " * 250, " ".join(map(str, range(300))), "# few", "#" + " w" * 300, "X Y Z"], ["s", "other", None, ""]), 100
        )
    ]
    copies = [(200 + i, "the same text", "en", "hot", None) for i in range(30)] + [(200, "the same text", "en", "hot", None)] * 2
    documents = [*odd_rows(), *junk, *copies, (None, "the same text", None, "hot", None)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(100, 230, 3)] + [(100, 1, None), (100, 0, 1), (None, 1, 1), (5, None, None)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    where = save({"labels": LABELS}, documents=documents, labels=labels)
    got = interactions.op11_filter_audit(spark, where)
    assert dict(got.dtypes)["step"] == "int" and dict(got.dtypes)["shapley"] == "bigint"
    assert got.count() == 600 * len({r[3] or "" for r in documents})
    assert audit_rows(got) == plain_audit(documents, labels)


def test_audit_takes_no_notice_of_extra_columns(spark, save):
    plain = save({"labels": LABELS}, documents=odd_rows(), labels=[(0, 1, 1)])
    want = audit_rows(interactions.op11_filter_audit(spark, plain))
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    names = ("part", "mask", "doc", "copy_of", "good", "toxic", "n", "labelled", "first", "lowest")
    labels = spark.createDataFrame([(0, 1, 1, 7, 8)], LABELS + ", labelled int, good int")
    got = interactions.audit(interactions.masks(docs.selectExpr("*", *[f"7 as {n}" for n in names]), labels))
    assert audit_rows(got) == want


def test_audit_of_empty_tables(spark, save):
    where = save({"labels": LABELS}, documents=[], labels=[])
    assert interactions.op11_filter_audit(spark, where).count() == 0


# --- 12 --------------------------------------------------------------------------------------


def plain_best(kinds):
    """Cheapest edits from left to right, by the last role so far."""
    after = {"": (0, "")}

    def step(state, role):
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        return role if role in follows else None

    def put(into, state, cost, audit):
        if state is not None and (state not in into or (cost, audit) < into[state]):
            into[state] = (cost, audit)

    def inserted(states):
        for _ in range(4):
            for state, (cost, audit) in list(states.items()):
                for role in "ua":
                    put(states, step(state, role), cost + 2, audit + "I")
        return states

    after = inserted(after)
    for kind in kinds:
        now = {}
        extra = int(kind.isupper())
        for state, (cost, audit) in after.items():
            put(now, state, cost + 3, audit + "D")
            if kind != "d":
                if kind.lower() in "sua":
                    put(now, step(state, kind.lower()), cost + extra, audit + "K")
                for role in "ua":
                    put(now, step(state, role), cost + 2 + extra, audit + "R")
        after = inserted(now)
    return min(after[s] for s in ("", "a") if s in after)


def all_edits(kinds):
    """Every row with every edit, and up to two insertions at every place."""
    found = []
    options = [[("D", "", 3)] + ([] if k == "d" else [("K", k.lower(), int(k.isupper()))] + [("R", r, 2 + k.isupper()) for r in "ua"]) for k in kinds]
    gaps = [[""], ["u"], ["a"], ["u", "a"], ["a", "u"], []]
    for edits in product(*options):
        for inserts in product(gaps[:5], repeat=len(kinds) + 1):
            audit, roles, cost = "", "", 0
            for i, insert in enumerate(inserts):
                for r in "".join(insert):
                    audit, roles, cost = audit + "I", roles + r, cost + 2
                if i < len(edits):
                    audit, roles, cost = audit + edits[i][0], roles + edits[i][1], cost + edits[i][2]
            if re.fullmatch("(s?(ua)+)?", roles):
                found.append((cost, audit))
    return min(found)


def test_cheapest_edits_of_short_conversations_are_the_least_of_all():
    for n in range(3):
        for kinds in product("suaxUAd", repeat=n):
            assert repair.best(repair.parse("".join(kinds))) == all_edits(kinds) == plain_best(kinds), kinds


def test_cheapest_edits_of_long_conversations():
    draw = np.random.default_rng(5)
    for n in (3, 4, 5, 6, 7, 8, 9, 17, 40, 200):
        for _ in range(60):
            kinds = "".join(draw.choice(list("suaxSUAXd"), n))
            assert repair.best(repair.parse(kinds)) == plain_best(kinds)
            cut = int(draw.integers(0, n))
            assert repair.joined([repair.parse(kinds[:cut]), repair.parse(kinds[cut:])])[""] == repair.parse(kinds)[""]
    assert repair.best(repair.parse("")) == (0, "")


def plain_repair(rows):
    """The contract, row by row, for turns of one row each or of equal rows."""
    ids = {r[0] for r in rows}
    space = lambda v: " " if v is None else str(v)
    left = {}
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        left.setdefault(conv, []).extend([(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1))
    out = {}
    for conv in ids:
        own = sorted(left.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, kinds, counts = set(), "", dict.fromkeys("bdt", 0)
        for _, role, text in own:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
            kinds += "d" if fault in ("b", "d") else kind.upper() if fault else kind
        turns = {t for t, _, _ in own if t is not None}
        pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = plain_best(kinds)
        lines, rest, last = [], iter(own), ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(rest)[1:]
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if last == "u" else "user"
            lines.append(f"{role}:{text}")
            last = role[0]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(), pairs, cost, audit, digest)
    return out


def repaired(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def odd_turns():
    roles = ["user", "assistant", "system", "tool", "", None, "sys", "a"]
    texts = ["Fine.", "open", "", None, " \n", "Yes! \t", "Fine.", "日本語。", "?"]
    draw = np.random.default_rng(11)
    rows = [
        (None if conv == 7 else conv, None if turn % 13 == 5 and conv % 3 == 0 else turn * (1 + conv % 2), roles[draw.integers(len(roles))], texts[draw.integers(len(texts))])
        for conv in range(60)
        for turn in range(int(draw.integers(1, 9)))
    ]
    long = [(1000, t, ("user", "assistant")[t % 2] if t % 11 else "system", f"turn {t}." if t % 7 else "again") for t in range(3000)]
    return [*rows, *rows[:40], *long, (2000, None, None, None), (2001, -(2**40), "user", "long " * 50_000), (2001, 2**40, "assistant", "Done.")]


def test_repairs_are_those_of_the_plain_version(spark, save):
    rows = odd_turns()
    where = save({"conversations": TURNS}, conversations=rows)
    got = repair.op12_repair(spark, where)
    assert got.count() == len({r[0] for r in rows})
    assert repaired(got) == plain_repair(rows)


def test_repairs_of_the_test_table(spark, samples):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in samples("conversations")]
    assert repaired(repair.op12_repair(spark, "/root/testdata/sf0.001")) == plain_repair(rows)


def test_a_conversation_over_many_tasks(spark, save, request):
    rows = [(1, t, ("user", "assistant")[t % 2], f"{t}." if t % 5 else "same words") for t in range(4000)] + [(2, 0, "user", "Hi.")]
    where = save({"conversations": TURNS}, conversations=rows)
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    request.addfinalizer(lambda: spark.conf.unset(merge))
    found = repair.pieces(repair.described(repair.damaged(spark.read.parquet(f"{where}/conversations.parquet")))).collect()
    assert sum(r["key"] == "=1" for r in found) > 1
    assert repaired(repair.op12_repair(spark, where)) == plain_repair(rows)


def test_repair_takes_no_notice_of_extra_columns_and_keeps_the_type_of_ids(spark):
    rows = [("x", 0, "user", "Hi."), ("x", 1, "assistant", "Yes."), ("", 0, "user", "Hi."), (None, 3, "assistant", "a")]
    df = spark.createDataFrame(rows, TURNS.replace("conv_id long", "conv_id string"))
    extra = df.selectExpr("*", *[f"1 as {c}" for c in ("key", "digest", "part", "m", "fresh", "at", "cost", "audit", "of", "blank", "seq")])
    assert repaired(repair.repair(extra)) == repaired(repair.repair(df))
    assert repaired(repair.repair(df))["x"][5:7] == (0, "KK")
    assert repaired(repair.repair(df))[""][5:7] == (2, "KI")


def test_repair_of_an_empty_table(spark, save):
    assert repair.op12_repair(spark, save({"conversations": TURNS}, conversations=[])).count() == 0


# --- 13 --------------------------------------------------------------------------------------


def test_folding_undoes_disguise():
    plain = toxicity.fold("you idiot clown")
    assert toxicity.fold("YOU 1D10T CL0WN") == plain
    assert toxicity.fold("you іdі0t сlοwn") == plain  # Cyrillic and Greek letters
    assert toxicity.fold("you ｉｄｉｏｔ, !di0t?") == [*plain[:2], plain[1]]
    assert toxicity.fold("you id​iot c|own") == plain
    assert toxicity.fold("") == [] and toxicity.fold("!! $$") == []


def plain_hits(words, lexicon):
    """The longest term at each word, unless an exception phrase covers the word."""
    out, at, text = [], 0, f" {' '.join(words)} "
    for w in words:
        terms = [t for t in lexicon.terms if text.startswith(t, at)]
        if terms:
            longest = max(terms, key=len)
            end = at + len(longest.rstrip()) - 1
            spared = any(0 <= (a := text.find(x, k)) == k and a <= at and k + len(x) - 1 >= end for x in lexicon.exceptions for k in range(at + 1))
            if not spared:
                out.append((at, longest))
        at += len(w) + 1
    return out


def test_automaton_finds_what_a_plain_search_finds():
    draw = np.random.default_rng(2)
    lexicon = toxicity.Lexicon({" ab": 1.0, " abc": 2.0, " b ": 1.0, " ca": 0.5}, (" ab c ", " abc ", " c b "))
    for _ in range(300):
        words = ["".join(draw.choice(list("abc"), int(draw.integers(1, 5)))) for _ in range(int(draw.integers(0, 12)))]
        assert lexicon.found(words) == plain_hits(words, lexicon)
    assert toxicity.Lexicon().found(["ab"]) == []


def test_shares_count_words_by_their_beginnings():
    words = toxicity.fold("Stupid stupidest st other " + "filler " * 96)
    got = toxicity.shares(words)
    assert got[" stup"] == 0.02 and got[" stupidest "] == 0.01 and got[" fiiier"] == toxicity.MOST_SHARE
    assert " st" not in got


def test_held_out_toxicity(spark):
    root = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{root}/labels.parquet").where("toxic is not null")
    scored = toxicity.op13_toxicity(spark, root).join(labels, "doc_id").where("held_out").collect()
    bad, clean = [r for r in scored if r["toxic"] == 1], [r for r in scored if r["toxic"] == 0]
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
    assert sum(r["predicted"] for r in bad) >= 0.8 * len(bad)  # some texts were replaced by junk


def toxic_corpus():
    """Documents of common words; toxic ones hold a bad word, clean ones hold it in a harmless phrase."""
    draw = np.random.default_rng(1)
    common = ["the", "house", "river", "walks", "green", "table", "often", "never", "about", "people"]
    rows, labels = [], []
    for i in range(400):
        words = list(draw.choice(common, 60))
        toxic = i % 4 == 0
        if toxic:
            words[5], words[20], words[40] = "clown", "lousyhead", "clown"
        elif i % 4 == 1:
            words[7:9] = ["clown", "fish"]
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_exception_phrases_and_disguised_words(spark, save):
    rows, labels = toxic_corpus()
    filler = "the river walks about the green house " * 4
    fresh = [filler + "clown", filler + "a CL0WN and a l0usyhe@d", filler + "clown fish", filler, "", None, "clown " * 40_000]
    rows += [(1000 + i, t, "en", "s", 0) for i, t in enumerate(fresh)]
    where = save({"labels": LABELS}, documents=rows, labels=labels)
    out = {r["doc_id"]: r for r in toxicity.op13_toxicity(spark, where).collect() if r["doc_id"] >= 1000}
    score = {i - 1000: r["score"] for i, r in out.items()}
    assert score[1] >= 0.7 and score[6] >= 0.7 and score[0] > 0.3
    assert score[2] == score[3] < 0.2 and score[4] == score[5]
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in out.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())


@pytest.mark.parametrize("labels", [[], [(0, 1, 0), (1, None, 0), (None, 1, 1)], [(0, 0, 1), (1, 0, None)], [(0, 0, 1), (2, 0, 0), (0, 0, 1)]])
def test_toxicity_of_odd_rows(spark, save, labels):
    where = save({"labels": LABELS}, documents=odd_rows(), labels=labels)
    rows = toxicity.op13_toxicity(spark, where).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in odd_rows())
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_takes_no_notice_of_extra_columns(spark):
    rows, labels = toxic_corpus()
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    plain = toxicity.train(docs, known)
    odd = toxicity.train(docs.selectExpr("*", "1 as toxic", "2 as labelled", "3 as term"), known.selectExpr("*", "'x' as text", "1 as labelled"))
    assert plain.lexicon.terms == odd.lexicon.terms and plain.factors == odd.factors
    assert docs.selectExpr("*", "1 as score").select(toxicity.score(docs["text"], plain)).count() == len(rows)


def test_toxicity_of_an_empty_table(spark, save):
    assert toxicity.op13_toxicity(spark, save({"labels": LABELS}, documents=[], labels=[])).count() == 0

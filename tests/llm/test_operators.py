"""Each operator against a plain version, on the smallest tables and on unusual rows."""

import hashlib
import re
import time
import zlib

import numpy as np
import public_tokenizers as vocabularies
import pytest

from ledgerlink.llm import attention, byte_bpe, components, fuzzy, huffman, jaccard, language, lines, mixing, pages, passages, rtree

from .conftest import SCHEMA, odd_rows, odd_texts

DOCS = ["doc_id", "text", "lang", "source", "n_chars"]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture
def odd(save):
    return save({"labels": "doc_id long, quality int, toxic int"}, documents=odd_rows(), labels=[(0, 1, 0), (1, None, 0), (None, 1, 1)])


@pytest.fixture
def empty(save):
    return save(
        {"labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string"}, documents=[], labels=[], pages=[]
    )


ALL = [
    huffman.op1_huffman, attention.op2_quality, fuzzy.op3_fingerprints, lines.op4_line_rules, jaccard.op5_jaccard,
    language.op6_language, mixing.op7_mixing, passages.op9_passages, byte_bpe.op10_byte_bpe,
]


@pytest.mark.parametrize("op", ALL, ids=lambda f: f.__name__)
def test_every_row_of_an_odd_table_comes_back(spark, odd, op):
    rows = op(spark, odd).collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == sorted(r[0] for r in odd_rows() if r[0] is not None)
    assert sum(r["doc_id"] is None for r in rows) == 2


@pytest.mark.parametrize("op", [*ALL, pages.op8_main_text], ids=lambda f: f.__name__)
def test_an_empty_table_gives_no_rows(spark, empty, op):
    assert op(spark, empty).count() == 0


# --- 1 -------------------------------------------------------------------------------------


def test_huffman_lengths_are_optimal_and_limited():
    counts = np.array([40, 30, 20, 5, 3, 2, 0, 1])
    free = huffman.code_lengths(counts, 18)
    assert (free * counts).sum() == 40 + 60 + 60 + 20 + 15 + 12 + 6  # as the plain algorithm gives
    short = huffman.code_lengths(counts, 4)
    assert short.max() == 4 and short[6] == 0
    assert sum(2.0 ** -k for k in short if k) <= 1


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_packed_ids_come_back(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 5000
    lengths = huffman.code_lengths(np.bincount(ids, minlength=1) if n else np.zeros(1, np.int64))
    bits, checkpoints = huffman.pack(ids, lengths, huffman.canonical(lengths))
    assert huffman.unpack(bits, checkpoints, n, huffman.decoding_table(lengths)).tolist() == ids.tolist()


def test_written_ids_are_those_of_the_library(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabularies.path("word_bpe_49k.json"))
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"], r["start"]) for r in huffman.op1_huffman(spark, odd).collect() if r["doc_id"] is not None)
    want = {}
    for doc_id, text, *_ in odd_rows():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(doc_id, (len(ids), zlib.crc32(ids.tobytes())))
    assert all((n, crc) == want[i] for i, n, crc, _ in got)
    by_start = sorted((s, i, n) for i, n, _, s in got)
    assert [i for _, i, _ in by_start] == sorted(i for _, i, _ in by_start)
    assert all(a[0] + a[2] == b[0] for a, b in zip(by_start, by_start[1:]))


# --- 2, 4, 6 ---------------------------------------------------------------------------------


def test_attention_gradients():
    draw = np.random.default_rng(0)
    x, first, y = draw.normal(size=(6, attention.FEATURES)), np.array([0, 2, 3, 6]), np.array([0.0, 1.0, 1.0])
    p = {
        "encode": draw.normal(0, 0.1, (attention.FEATURES, 3)), "encode_bias": np.zeros(3), "value": draw.normal(size=(3, 2)),
        "gate": draw.normal(size=(3, 2)), "attend": draw.normal(size=2), "out": draw.normal(size=3), "out_bias": np.zeros(1),
    }

    def loss(q):
        s = attention.forward(q, x, first)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for k, g in attention.gradients(p, x, first, y).items():
        at = tuple(0 for _ in p[k].shape)
        up, down = {**p, k: p[k].copy()}, {**p, k: p[k].copy()}
        up[k][at] += 1e-6
        down[k][at] -= 1e-6
        assert abs((loss(up) - loss(down)) / 2e-6 - g[at]) < 1e-6


def test_held_out_quality_and_language(spark):
    root = "/root/testdata/sf0.01"
    scored = attention.op2_quality(spark, root).join(spark.read.parquet(f"{root}/labels.parquet"), "doc_id").where("held_out")
    assert scored.where("predicted = quality").count() >= 0.95 * scored.count()
    told = language.op6_language(spark, root).join(spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert told.where("lang_pred = lang").count() >= 0.98 * told.count()


def test_language_is_unknown_without_letters(spark, odd):
    got = {r["doc_id"]: r["lang_pred"] for r in language.op6_language(spark, odd).collect()}
    assert {i for i, t in enumerate(odd_texts()) if not t or not any(map(str.isalpha, t))} == {i for i, p in got.items() if p == "und" and i is not None}


def test_line_counts(spark, samples, save):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(1000 + r["doc_id"], r["text"]) for r in samples("documents")]
    rows.append((900, "a line\n" * 500 + "\n" * 400 + "the last\n\nthe last"))
    field = lines.Field(np.eye(1, lines.FEATURES)[0], np.zeros((2, 2)))
    for (_, text), r in zip(rows, lines.verdicts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), field).collect()):
        text = text or ""
        words = WORDS.findall(text)
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        seen, repeated = {}, set()
        for k, g in enumerate(grams):
            seen.setdefault(g, []).append(k)
        for places in seen.values():
            if len(places) > 1:
                repeated.update(k + j for k in places for j in range(3))
        split, earlier, dup_lines = text.split("\n"), set(), 0
        for line in split:
            dup_lines += bool(WORDS.search(line)) and line in earlier
            earlier.add(line)
        assert r["n_words"] == len(words)
        assert r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>")
        assert r["n_dup_lines"] == dup_lines
        assert r["n_repeat_words"] == len(repeated)
        assert r["base_failed"] == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))


def test_viterbi_finds_the_best_labels():
    draw = np.random.default_rng(3)
    field = lines.Field(draw.normal(size=lines.FEATURES), draw.normal(size=(2, 2)))
    x = draw.normal(size=(8, lines.FEATURES))
    gain = x @ field.weight

    def score(labels):
        return sum(g for g, y in zip(gain, labels) if y) + sum(field.step[a, b] for a, b in zip(labels, labels[1:]))

    best = max(([int(c) for c in f"{k:08b}"] for k in range(256)), key=score)
    assert field.decode(x, np.array([0, 8])).astype(int).tolist() == best


def test_half_boilerplate_documents_get_mixed_labels(spark):
    draw = np.random.default_rng(5)
    known = "the of and to in is that for it with as was on are by this from river mountain history evening village letter".split()

    def line(bad):
        words = draw.choice(known, 14)
        return " ".join(w + str(draw.choice(["###", "***", "$$$"])) for w in words) if bad else " ".join(words).capitalize() + "."

    def text(pattern):
        return "\n".join(line(c == "b") for c in pattern)

    # Most documents are of one kind, as in the test tables; a few begin or end with a line of the other.
    train = [(i, text(["gggggg", "gggg", "ggggb", "ggggggg", "bbbbb", "bbbbbb", "gbbbb"][i % 7]), int(i % 7 < 4)) for i in range(140)]
    docs = spark.createDataFrame([r[:2] for r in train], "doc_id long, text string")
    field = lines.train(docs, spark.createDataFrame([(r[0], r[2]) for r in train], "doc_id long, quality int"))
    patterns = ["gggbbb", "bbbggg", "ggbbbggg", "ggggbb"]
    planted = spark.createDataFrame([(i, text(c)) for i, c in enumerate(patterns)], "doc_id long, text string").coalesce(1)
    for pattern, r in zip(patterns, lines.verdicts(planted, field).collect()):
        assert r["content"] == [c == "g" for c in pattern]
        assert r["content_share"] == pytest.approx(pattern.count("g") / len(pattern))


def test_line_labels_agree_with_the_document():
    draw = np.random.default_rng(2)
    field = lines.Field(draw.normal(size=lines.FEATURES), np.zeros((2, 2)))
    bags = [draw.normal(size=(n, lines.FEATURES)) for n in range(1, 60)]
    words = [draw.integers(1, 30, len(b)) for b in bags]
    for label in (0, 1):
        for w, y in zip(words, lines.line_labels(field, bags, words, [label] * len(bags))):
            assert (w @ y >= lines.CONTENT * w.sum()) == bool(label)


# --- 3 -------------------------------------------------------------------------------------


def test_fingerprints(spark, odd):
    texts = {i: t or "" for i, t, *_ in odd_rows() if i is not None}
    got = {r["doc_id"]: r for r in fuzzy.op3_fingerprints(spark, odd).collect() if r["doc_id"] is not None}
    order = sorted(texts)
    for i, following in zip(order, order[1:]):
        t, n = texts[i], len(texts[i]) // 4
        edited = t[: len(t) - n] + texts[following][:n]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["fingerprint"] == fuzzy.fingerprint(t)
        assert got[i]["near_edited"] == fuzzy.compare_all([fuzzy.fingerprint(t)], [fuzzy.fingerprint(edited)])[0]
        assert 0 <= got[i]["near_next"] <= 1


def test_likeness_is_the_edit_distance():
    draw = np.random.default_rng(1)
    sides = [["".join(draw.choice(list("ABC"), draw.integers(0, 65))) for _ in range(40)] for _ in range(2)]

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    for a, b, got in zip(*sides, fuzzy.likeness_of(*sides)):
        want = 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0
        assert got in (pytest.approx(want), 0.0)


# --- 5, 9 ------------------------------------------------------------------------------------


def near_copies():
    draw = np.random.default_rng(5)
    base = [f"w{k}" for k in draw.integers(0, 400, 120)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :]), "en", "s", 1) for i, k in enumerate(draw.integers(0, 120, 60))]
    rows += [(100 + i, " ".join(base[i * 2 :]), "en", "s", 1) for i in range(40)]
    return [*rows, (200, "A b", None, None, 1), (201, "a  B", None, None, 1), (202, "", None, None, 1), (203, None, None, None, 1), (204, "c", None, None, 1)]


def test_components_of_near_copies(spark, save):
    rows = near_copies()
    sets = {}
    for i, t, *_ in rows:
        words = WORDS.findall((t or "").lower())
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.op5_jaccard(spark, save(documents=rows)).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_one_document_of_each_component_stays(spark):
    rows = [*near_copies(), (0, near_copies()[0][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = jaccard.one_of_each(docs.withColumn("KEY", docs["doc_id"]))
    assert kept.columns == [*DOCS, "KEY"]
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert len(ids) == len(set(ids)) and {0, 200, 202, 203, 204} <= set(ids) and 201 not in ids and 1 not in ids


def test_blocks_of_a_large_group(spark, save, monkeypatch):
    rows = near_copies()
    whole = jaccard.op5_jaccard(spark, save(documents=rows)).collect()
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "FORESTS", (1, 1, None))
    assert sorted(jaccard.op5_jaccard(spark, save(documents=rows)).collect()) == sorted(whole)


def test_sets_are_verified_on_whole_hashes():
    tokens = jaccard.Sets(["one two three four five six seven eight nine ten eleven twelve"]).token
    others = tokens ^ np.uint64(1)
    a, b = (jaccard.tokens_of(jaccard.packed(np.sort(t))) for t in (tokens, others))
    assert a.tolist() == np.sort(tokens).tolist()
    assert not set(a.tolist()) & set(b.tolist())


def test_tree_loses_no_similar_pair():
    draw = np.random.default_rng(2)
    points = draw.integers(0, 6, (300, 16))
    points[150:] = np.maximum(0, points[:150] + draw.integers(-1, 2, (150, 16)) * (draw.random((150, 16)) < 0.2))
    sizes = points.sum(1)
    bound = np.minimum(points[:, None], points[None]).sum(2)
    want = {(i, j) for i, j in np.argwhere(rtree.enough(bound, sizes[:, None], sizes[None])).tolist()}
    assert want <= set(zip(*(x.tolist() for x in rtree.Tree(points, sizes).search(points, sizes))))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10] + [(77, 99)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {**{i: max(1, 10 * ((i - 1) // 10) + 1) for i in range(1, 41)}, 77: 77, 99: 77}


def test_removed_passages(spark, save):
    rows = [*near_copies(), *[(300 + i, "so it is " * 40 + f"end{i}", "en", "s", 1) for i in range(3)], *odd_rows()[2:9]]
    rows = [(1000 + k, *r[1:]) for k, r in enumerate(rows)]
    seen, want = set(), {}
    for i, t, *_ in rows:
        words = WORDS.findall(t or "")
        gone = set()
        for k in range(len(words) - 19):
            w = tuple(words[k : k + 20])
            if w in seen:
                gone.update(range(k, k + 20))
            seen.add(w)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        want[i] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in passages.op9_passages(spark, save(documents=rows)).collect()}
    assert got == want


def test_cut_leaves_other_white_space():
    assert passages.cut("a  b\nc d e\n", [{"begin": 1, "end": 3}]) == "a  d e\n"
    assert passages.cut("a b", [{"begin": 0, "end": 2}]) == ""


# --- 7 -------------------------------------------------------------------------------------


def test_mix_targets():
    assert mixing.targets([10, 1, 100], [1, 2, 3]) == pytest.approx([27, 3, 81])
    assert mixing.targets([0, 0], [1, 2]) == [0, 0]


def test_time_inverts_the_integral(spark):
    for schedule in mixing.schedules(3):
        df = spark.createDataFrame([(k / 20,) for k in range(21)], "y double")
        for y, t in df.select("y", mixing.time_at(df["y"], schedule)).collect():
            part = [(a, b) for a, b in zip(schedule, schedule[1:]) if a[0] < t]
            area = sum(
                (min(t, t1) - t0) * (w0 + w0 + (w1 - w0) * (min(t, t1) - t0) / (t1 - t0)) / 2 for (t0, w0), (t1, w1) in part
            )
            assert area == pytest.approx(y * mixing.integral(schedule), abs=1e-9)


def test_training_order_keeps_the_mix(spark, samples):
    docs = spark.createDataFrame([tuple(r[c] for c in DOCS) for r in samples("documents")], SCHEMA)
    out = mixing.training_order(docs)
    assert out.columns == DOCS
    many = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert max(many.values()) <= 3


# --- 8 -------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<p>", ""),
        ("<html><nav><a href='/'>Home</a></nav><article><h1>A &amp; b</h1><p>Is<b>n't</b>\n it.<br>x<p>y&nbsp;z</article><footer>f", "A & b\nIsn't it. x\ny z"),
        ("<article><p>Text.</p><div class='ad'>Buy</div><aside>Side</aside><script>if(a<b){'</p>'}</script><form>q</form></article>"
         "<section id=comments><article class=comment><p>Nice</p></article></section>", "Text."),
        ("<div>" + "<a href=x>link text</a> " * 20 + "</div><h2>Title</h2><p>" + "this is the text of a page that has no article " * 5 + "</p><p>End.</p>",
         "Title\n" + ("this is the text of a page that has no article " * 5).strip() + "\nEnd."),
    ],
)
def test_main_text(page, text):
    assert pages.main_text(page or "") == text


PROSE = "this is the text of a page and it has a lot of the words that we use "
SPAM = "cheap watches luxury handbags discount sneakers designer sunglasses outlet jewelry "


def test_main_text_outside_of_teaser_articles():
    cards = "".join(f"<article><h3>Story {k}</h3><p>Short teaser.</p><a href=x>more</a></article>" for k in range(4))
    page = f"<nav><a href=/>Home</a></nav>{cards}<div><h1>Title</h1><p>{PROSE * 3}</p><p>Short end.</p></div>{cards}"
    assert pages.main_text(page) == f"Title\n{(PROSE * 3).strip()}\nShort end."


def test_main_text_beside_a_marked_article():
    page = f"<h1>Title</h1><article><p>{PROSE * 2}</p><p>Short.</p></article><div>Share</div><div>{PROSE * 3}</div><div>Share</div>"
    assert pages.main_text(page).split("\n") == ["Title", (PROSE * 2).strip(), "Short.", "Share", (PROSE * 3).strip()]


def test_stop_words_decide_within_an_article():
    page = f"<article><h1>Title</h1><p>{PROSE * 2}</p><p>{SPAM * 3}</p><p>{PROSE * 3}</p></article>"
    assert pages.main_text(page).split("\n") == ["Title", (PROSE * 2).strip(), (PROSE * 3).strip()]


RUSSIAN = "Вчера утром над городом прошёл сильный дождь и многие улицы оказались под водой до самого вечера. " * 3
POLISH = "Wczoraj rano nad miastem przeszła gwałtowna burza, przez którą wiele ulic znalazło się pod wodą aż do wieczora. " * 3
CHINESE = "昨天早上城市上空下了一场大雨许多街道直到晚上都被水淹没了居民们不得不待在家里等待救援人员的到来" * 2


@pytest.mark.parametrize("text", [RUSSIAN, POLISH, CHINESE], ids=["ru", "pl", "zh"])
def test_main_text_in_languages_without_a_list(text):
    page = f"<nav><a href=/>Home</a></nav><h1>A</h1><div><p>{text}</p><p>{text}</p></div><footer>{PROSE * 2}</footer>"
    assert pages.main_text(page) == "\n".join(["A", text.strip(), text.strip()])


def test_a_foreign_page_with_a_notice_that_a_list_fits():
    page = f"<div>{PROSE * 2}</div><div><p>{POLISH}</p><p>{POLISH}</p></div>"
    assert pages.main_text(page).split("\n")[1:] == [POLISH.strip()] * 2


@pytest.mark.parametrize(
    "open_tag",
    ["<div class='main with-sidebar'>", "<div id='search-results-page'>", "<form action=x>", "<div class=widget>", "<div id=search>", "<form><div class='sidebar'>"],
)
@pytest.mark.parametrize("article", ["article", "div"])
def test_wrappers_of_the_page_are_not_set_aside(open_tag, article):
    page = (
        f"<nav><a href=/>Home</a></nav>{open_tag}<{article}><h1>A</h1><p>{PROSE * 2}</p><p>{PROSE * 3}</p></{article}>"
        f"<div class=comments><p>{PROSE}</p></div></div></form><footer>{PROSE * 2}</footer>"
    )
    assert pages.main_text(page).split("\n") == ["A", (PROSE * 2).strip(), (PROSE * 3).strip()]


@pytest.mark.parametrize("short", ["<article><p>One word.</p></article>", f"<div><p>{PROSE * 2}</p></div>"])
@pytest.mark.parametrize("aside", ["<footer>", "<div class=cookie-banner>", "<section class=comments>", "<div hidden>", "<aside class=widget>"])
def test_long_asides_are_no_wrappers(short, aside):
    name = re.match(r"<(\w+)", aside)[1]
    page = f"{short}{aside}<p>{PROSE * 5}</p></{name}>"
    assert pages.main_text(page) == pages.main_text(short) != ""


@pytest.mark.parametrize(
    "name",
    ["user-comments", "userComments", "article-sidebar", "story-related", "c-ad-banner__inner", "c-ad-banner__text",
     "card__comments--open", "sidebar--left", "site-footer-links", "post_reply"],
)
def test_compound_names_count_by_their_head(name):
    article = f"<article><p>{PROSE * 2}</p></article><div><p>{PROSE * 3}</p></div>"
    assert pages.main_text(f"{article}<div class='x {name}'><p>{PROSE}</p></div>") == pages.main_text(article)


@pytest.mark.parametrize("name", ["has-sidebar", "no-ads", "content-with-sidebar", "cookie-recipes", "search-results", "category-social", "page--with-menu"])
def test_names_that_only_mention_a_hint(name):
    article = f"<article><p>{PROSE * 2}</p></article><div class={name}><p>{PROSE * 3}</p></div>"
    assert pages.main_text(article).split("\n") == [(PROSE * 2).strip(), (PROSE * 3).strip()]


@pytest.mark.parametrize(
    "tag", ['<p title="x>', "<p title='x>", '<p title="x" ">', "<p title=it's>", '<p title="a > b">', "<p data-x='<b>'>", '<p title="x"class="y">']
)
def test_unclosed_quotes_leave_no_markup(tag):
    page = f'<div>{tag}{PROSE * 2}</p><p class="y">{PROSE}</p><p title="z">{PROSE}</p></div>'
    assert pages.main_text(page).split("\n") == [(PROSE * 2).strip(), PROSE.strip(), PROSE.strip()]


@pytest.mark.parametrize("piece", ["<div></p>", "<svg>", "<li>", '<p title="x>a ', "<div class=sidebar><p>", "<div><b>x</span>", '<p "'])
def test_broken_pages_take_time_in_proportion(piece):
    began = time.process_time()
    pages.main_text(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 10  # quadratic ways take minutes


def test_pages_come_back_row_by_row(spark, save):
    html = f"<article><p>{PROSE}</p></article>"
    rows = [(1, "u", html, "e", 1, 2), (1, "u", html, "e", 1, 2), (None, None, html, None, None, None), (2, "v", None, None, 3, 4), (3, None, "", "", 5, 6)]
    sf = save({"pages": "page_id long, url string, html string, text string, n_chars long, parts long"}, pages=rows)
    got = sorted(map(tuple, pages.op8_main_text(spark, sf).collect()), key=str)
    text = PROSE.strip()
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(None, None, text, len(text)), (2, "v", "", 0), (3, None, "", 0)], key=str)


# --- 10 ------------------------------------------------------------------------------------


def test_byte_bpe_is_that_of_the_library(spark, odd, samples):
    import tiktoken

    path = vocabularies.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    for r in byte_bpe.op10_byte_bpe(spark, odd).join(spark.createDataFrame(odd_rows(), SCHEMA), "doc_id").collect():
        if r["doc_id"] != 5:
            ids = library.encode_ordinary(r["text"] or "")
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    encoder = byte_bpe.Encoder(path, vocabularies.PATTERN)
    texts = [r["text"] for r in samples("documents")]
    assert [np.frombuffer(b, np.int32).tolist() for b in encoder.texts(texts)] == library.encode_ordinary_batch(texts)


def test_round_trip_is_encoding_then_decoding(spark, odd):
    path = vocabularies.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    both = byte_bpe.round_trip(docs["text"], path, vocabularies.PATTERN)
    rows = docs.select("text", both.alias("b"), byte_bpe.encode(docs["text"], path, vocabularies.PATTERN).alias("ids")).collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        assert r["b"]["ids"] == r["ids"]
        assert bytes(r["b"]["decoded"]) == (r["text"] or "").encode()


def test_library_sees_many_new_words_at_once():
    """A call for each word would cost more than the encoding; marks and letter cases do not change ids."""
    tokenizer = huffman.WordTokenizer(vocabularies.path("word_bpe_49k.json"))
    library, seen = tokenizer.library, []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return library.encode_batch_fast(texts, **options)

    words = [f"{'Ab' * (n % 9)}{chr(97 + n % 26) * (n % 70)}{chr(97 + n // 26 % 26)}{'.,;:!?'[: n % 7]}" for n in range(3000)]
    odd = ["\x01", "a\x01b", "<|endoftext|>x", "It's", "'s.", "I'LL!", "e\u0301x", "\u0301e", "x\u00a0y.", "\u00a0", "STRASSE.", "İX", "a.b", "...", "A1,", "\u2028", "x\x1cy", "ΑΣ.", "\u1112\u1161\u11ab"]
    texts = [" ".join(words), " ".join(odd), "\n".join(odd[::-1]), " ".join(w.upper() for w in words[:500]), "", " \x01  \x01 "]
    tokenizer.library = Counting()
    got = [np.frombuffer(b, np.int32).tolist() for b in tokenizer.encode(texts, 2)]
    assert got == [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert len(seen) < 100
    assert max(map(len, tokenizer.known)) <= huffman.CACHE_LENGTH
    tokenizer.mark, tokenizer.lowers, tokenizer.known = None, False, {}
    assert [np.frombuffer(b, np.int32).tolist() for b in tokenizer.encode(texts, 2)] == got


def test_words_that_differ_in_case_and_signs_alone_go_to_the_library_once():
    tokenizer = huffman.WordTokenizer(vocabularies.path("word_bpe_49k.json"))
    library, seen = tokenizer.library, []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return library.encode_batch_fast(texts, **options)

    stems = [f"{chr(97 + n % 26)}{'\u00e9\u00c9\u00df\u00f8\u00ffz'[n % 6]}{chr(97 + n // 26)}" for n in range(600)]
    signs = ["", "###", ".", "),", "\"$$$", "<|>", "-", "&*", "~}"]
    words = [form + sign for stem in stems for sign in signs for form in {stem, stem.capitalize(), stem.replace("\u00e9", "\u00c9")}]
    odd = ["a<|endoftext|>", "a'#", "a#'s", "#a", "1#", "a1", "\u00d7\u00f7", "a\u00d7#", "\u00e9\u0301#", "\u00aa#", "</w>", "a</w>"]
    texts = [" ".join(words), " ".join(odd)]
    tokenizer.library = Counting()
    got = [np.frombuffer(b, np.int32).tolist() for b in tokenizer.encode(texts, 2)]
    assert got == [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert sum(len(t.split()) for t in seen) <= len(stems) + len(signs) + 2 * len(odd)


def test_a_word_is_remembered_once_whatever_its_case_and_signs(monkeypatch):
    """A worker's time and memory follow the different parts of words, not the forms in which they occur."""
    tokenizer = huffman.WordTokenizer(vocabularies.path("word_bpe_49k.json"))
    stems = [f"{chr(97 + n % 26)}{'\u00e9\u00df\u00f8\u00ffz'[n % 5]}{chr(97 + n // 26)}" for n in range(500)]
    signs = [".", ",", "...", "\"$$$", "<|>", "&*"]
    whole = ["|", "##", "'s", "I'LL", "a1", "a<|endoftext|>", "x.y", "\u00d7", "e\u0301.", "w" * 100, "w" * 100 + ".", "9" * 100]
    texts = ["", " ".join(f"{form}{sign}" for stem in stems for sign in ["", *signs] for form in (stem, stem.capitalize())), "\n".join(whole), " \t"]
    want = [tokenizer.library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    for _ in range(2):
        assert [np.frombuffer(b, np.int32).tolist() for b in tokenizer.encode(texts, 2)] == want
        assert len(tokenizer.known) <= len(stems) + len(signs) + len(whole)
        # Long words leave nothing behind.
        assert tokenizer.many == len(tokenizer.known) and tokenizer.filled == (tokenizer.begin + tokenizer.size)[: tokenizer.many].max()
    monkeypatch.setattr(huffman, "CACHE_WORDS", 300)
    for at in range(0, 500, 100):
        text = " ".join(stems[at : at + 200])
        assert np.frombuffer(tokenizer.encode([text], 2)[0], np.int32).tolist() == tokenizer.library.encode(text, add_special_tokens=False).ids + [2]
        assert tokenizer.many == len(tokenizer.known) <= 300

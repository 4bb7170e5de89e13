"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides on each block by itself:

* blocks within navigation, header, footer, sidebar, form or hidden elements, or within elements
  whose class, id or role says so (``hinted``), are boilerplate, unless the element wraps the
  article or most of the page's long text (``wrappers``);
* a share of link text above ``LINKS`` makes boilerplate;
* of long blocks, those with enough stop words of one language are content and those with next to
  none are boilerplate; what lies between stays ambiguous, as do short blocks and, within an element
  that the page marks as an article, those too short to tell. Where stop words can't tell, because
  most of a block is in no Latin script or most of the page's long text has too few words of any
  list, length and links alone decide.

The second pass gives each ambiguous block the label of the nearest decided block (the following
one for a heading; content where both are as near). What a page marks as an article is a prior for
ambiguous blocks only: those in an article with content look there first; those outside of it, or in
an article without content such as a teaser card, must lie between content. Where no block of the
page is content, the ambiguous ones of its articles are.

Each page is read once, where it lies; nothing is shuffled.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, steps, table

#: Share of a block's characters in links above which it is boilerplate.
LINKS = 0.5
#: Characters below which a block is ambiguous, and below which few stop words don't rule out a block of an article.
SHORT, LONG = 70, 200
#: Share of stop words of one language from which a long block is content, and below which it is boilerplate.
STOP_WORDS, FEW_STOP_WORDS = 0.2, 0.1

# Frequent function words of the languages that pages are expected in, one text each.
WORDS = tuple(
    frozenset(words.split())
    for words in (
        """
        a an and are as at be been but by can for from had has have he her his i if in into is it
        its not of on or our she so than that the their them then there these they this to was we
        were what when which who will with would you your
        """,
        """
        au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui ma mais me mes
        ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un
        une vos votre vous
        """,
        """
        aber als am an auch auf aus bei bin bis das dass dem den der des die doch durch ein eine
        einem einen einer eines er es für hat ich ihr im in ist kein mit nach nicht noch nur ob oder
        sich sie sind so über um und uns unter vom von vor war was wenn wie wir wird zu zum zur
        """,
        """
        al como con cuando de del desde donde el ella en entre era es esta este ha hay la las le lo
        los más me mi muy no nos o para pero por porque que se si sin sobre son su sus también un
        una y ya
        """,
        """
        a al alla anche che chi ci come con così da dal dalla degli dei del della delle di e è era
        gli ha ho i il in io la le lo loro ma mi nel nella non o per perché più quando quella quello
        questa questo se si sono su sua suo tra un una uno
        """,
        """
        a ao aos as até com como da das de do dos e é ela ele em entre era essa esse esta este eu
        foi há isso já mais mas na nas não no nos o os ou para pela pelo por quando que se sem ser
        seu sua são também tem um uma
        """,
        """
        aan al als bij dan dat de der deze die dit door een en er ge had heb heeft het hij hoe hun
        ik in is je kan maar me met mijn naar niet nog nu of om ook op over te tot u uit van voor
        was wat we wel werd wordt zich zij zijn zo
        """,
    )
)
ANY_WORD = frozenset().union(*WORDS)
LETTERS = re.compile(r"[^\W\d_]+")
#: Letters that no word of the lists has, and characters that say as much as three letters do.
OTHER_SCRIPT = re.compile(r"[^\W\d_\u0000-\u024f]")
WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]")

# Elements that begin and end a block.
BLOCKS = frozenset(
    """
    address article aside blockquote body button caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html
    iframe legend li main menu nav noscript ol optgroup option p pre section select summary table
    tbody td textarea tfoot th thead title tr ul
    """.split()
)
#: Elements whose text is never shown as text of the page.
UNSEEN = ("script", "style", "template", "textarea", "svg", "math", "iframe", "object", "noscript", "title", "select")
#: Elements that hold no main text.
ASIDE = frozenset(["nav", "footer", "aside", "form", "menu", "dialog", "head", "button", "header", "fieldset"])
#: Of these, the ones that pages are wrapped in as a whole.
WRAPS = frozenset(["form", "fieldset", "dialog"])
ARTICLE = frozenset(["article", "main"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
VOID = frozenset(["br", "hr", "img", "input", "link", "meta", "wbr", "area", "base", "col", "embed", "source", "track"])

# Words of a class, id or role that name an element without main text.
HINTS = frozenset(
    """
    ad ads adsense advert adverts advertisement advertisements advertising banner banners
    breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright disqus
    discussion footer gdpr legal login masthead menu menus modal nav navbar navigation newsletter
    notice notices pager pagination popup promo promoted promotion related recommended
    recommendations replies reply respond share sharing sidebar sidebars signup social sponsor
    sponsored subscribe toolbar widget widgets complementary search
    """.split()
)
#: Of these, the ones that count on an article element, too: a reader's comment may be one.
REMARKS = frozenset(["comment", "comments", "reply", "replies", "discussion", "disqus", "ad", "ads", "advert", "sponsored", "promo"])

# Words for a place or kind of box, which say nothing at the end of a name ("ad-slot").
PLACES = frozenset(
    """
    area bar block bottom box col column container first form global inner item left link links list
    post primary right secondary section site slot top unit wrap wrapper
    """.split()
)

# Words after which a name tells what an element has or is filed under, not what it is.
STATES = frozenset(["has", "with", "without", "no", "is", "category", "tag", "topic"])

#: A tag ends at the first > outside of quoted values. Where quotes don't pair (a value must end before
#: white space, a slash or the end of the tag), at the first > of all.
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z))*+(?=>|\Z)|[^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_raw_end = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in UNSEEN}


def attributes(source: str) -> dict[str, str]:
    """Attributes of a tag; names in lower case."""
    return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(source)}


#: Why an element is set aside: for good, by its element, by one of WRAPS, by a name, by a name of REMARKS.
ALWAYS, BY_TAG, BY_WRAP, BY_NAME, BY_REMARK = range(1, 6)


HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


def head(name: str) -> str:
    """The word that says what a compound name names: its last one but for PLACES, before any of STATES."""
    last = ""
    for word in re.split(r"[^a-z]+", name):
        if word in STATES:
            break
        if word and word not in PLACES:
            last = word
    return last


def hinted(names: str, hints: frozenset[str]) -> bool:
    """Whether one of these names has a hint for its head, or is made of hints and PLACES only.

    Of ``block__element--modifier``, the block and the element count, each by its head.
    """
    for raw in names.split():
        for name in {raw.lower(), HUMP.sub("-", raw).lower()}:
            plain = name.split("--")[0]
            if head(plain) in hints or head(plain.split("__")[0]) in hints:
                return True
            parts = [w for w in re.split(r"[^a-z]+", name) if w]
            if not hints.isdisjoint(parts) and all(w in HINTS or w in PLACES for w in parts):
                return True
    return False


def set_aside(name: str, source: str, in_article: bool) -> int:
    """Why an element holds no main text, by its name and attributes; 0 if it may hold some."""
    by_tag = name in ASIDE and not (name == "header" and in_article)
    if source and name not in ("html", "body"):
        has = attributes(source)
        if "hidden" in has or has.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", has.get("style", "")):
            return ALWAYS
        if not by_tag or name in WRAPS:
            named = " ".join(has.get(k, "") for k in ("class", "id", "role"))
            if hinted(named, REMARKS):
                return BY_REMARK
            if name not in ARTICLE and hinted(named, HINTS):
                return BY_NAME
    return (BY_WRAP if name in WRAPS else BY_TAG) if by_tag else 0


class Block:
    """One block of text with what the rules look at."""

    __slots__ = ("parts", "link_chars", "aside", "article", "heading")

    def __init__(self, aside: int, article: int, heading: bool):
        self.parts: list[str] = []
        self.link_chars = 0
        self.aside, self.article, self.heading = aside, article, heading


def blocks(page: str) -> list[tuple[str, Block]]:
    """Blocks of a page in order, as (text with single spaces, block)."""
    out: list[tuple[str, Block]] = []
    open_ones: list[tuple[str, int, int]] = []  # element, number of the innermost one set aside or 0, of its article or 0
    n_open: Counter[str] = Counter()  # of open_ones by element, so that stray end tags need no search
    unclosed: set[str] = set()  # elements of UNSEEN without an end tag in the rest of the page
    asides = [(0, 0, 0)]  # of each element set aside: the one around it, why, the article around it
    articles = 0
    linked = False
    block = Block(0, 0, False)

    def end(heading: bool = False) -> None:
        nonlocal block
        text = " ".join(entities.unescape("".join(block.parts)).split()) if block.parts else ""
        if text:
            out.append((text, block))
        top = open_ones[-1] if open_ones else ("", 0, 0)
        block = Block(top[1], top[2], heading)

    def add(text: str) -> None:
        if text:
            block.parts.append(text)
            if linked:
                block.link_chars += len("".join(entities.unescape(text).split()))

    at, n = 0, len(page)
    while at < n:
        tag = TAG.search(page, at)
        if tag is None:
            add(page[at:])
            break
        add(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue  # a comment or declaration
        if tag[1]:
            if name == "a":
                linked = False
            elif name in BLOCKS:
                if n_open[name]:
                    closed = ""
                    while closed != name:
                        closed = open_ones.pop()[0]
                        n_open[closed] -= 1
                    linked = False
                end()
            continue
        if name in _raw_end and not tag[0].endswith("/>"):
            close = None if name in unclosed else _raw_end[name].search(page, at)
            if close is None:
                unclosed.add(name)
            if close is None and name in ("svg", "math", "object"):
                continue
            at = close.start() if close else n
            if close:
                stop = page.find(">", at)
                at = n if stop < 0 else stop + 1
            continue
        if name == "a":
            linked = True
        elif name == "br":
            add(" ")
        elif name in BLOCKS:
            end(name in HEADINGS)
            if name not in VOID and name != "p" and name not in HEADINGS:
                up_aside, up_article = (open_ones[-1][1], open_ones[-1][2]) if open_ones else (0, 0)
                if name == "li" and open_ones and open_ones[-1][0] == "li":
                    open_ones.pop()  # its end tag may be left out
                    n_open[name] -= 1
                    up_aside, up_article = (open_ones[-1][1], open_ones[-1][2]) if open_ones else (0, 0)
                off, why = up_aside, set_aside(name, tag[3], bool(up_article))
                if why:
                    off = len(asides)
                    asides.append((up_aside, why, up_article))
                own = up_article
                if name in ARTICLE or 'role="main"' in tag[3]:
                    if not up_article:
                        articles += 1
                        own = articles
                open_ones.append((name, off, own))
                n_open[name] += 1
                block.aside, block.article = off, own
            elif name == "p" or name in HEADINGS:
                if tag[3] and set_aside(name, tag[3], block.article > 0):
                    asides.append((block.aside, ALWAYS, block.article))
                    block.aside = len(asides) - 1
    end()
    off = wrappers(out, asides)
    for _, b in out:
        b.aside = off[b.aside]
    return out


def size(text: str) -> int:
    """Length of a text in letters; where a character is a syllable or word, it counts as three."""
    return len(text) if text.isascii() else len(text) + 2 * len(WIDE.findall(text))


def mostly_links(text: str, block: Block) -> bool:
    return block.link_chars > LINKS * len(text.replace(" ", ""))


def wrappers(found: list[tuple[str, Block]], asides: list[tuple[int, int, int]]) -> list[bool]:
    """For each element that was set aside, whether it stays so.

    One that holds more than half of the page's long text, less what elements in it set aside, is a
    wrapper and doesn't, if no article has text outside of it and

    * it holds an article itself and has no name of REMARKS, or
    * it is one of WRAPS, or
    * its name was the reason and nothing outside of it is content.

    One of WRAPS within an article needs only to leave no long text there. Where the page has no
    long text, any text counts for elements with an article.
    """
    n = len(asides)
    off = [k > 0 for k in range(n)]
    if n == 1:
        return off
    weights = [size(t) if b.aside == 0 or asides[b.aside][1] != ALWAYS else 0 for t, b in found]
    weights = [0 if mostly_links(t, b) else w for w, (t, b) in zip(weights, found)]
    some_long = any(w >= SHORT for w in weights)
    least = SHORT if some_long else 1
    weights = [w if w >= least else 0 for w in weights]
    total = sum(weights)
    held, with_article = [0] * n, [False] * n
    for w, (_, b) in zip(weights, found):
        held[b.aside] += w
        with_article[b.aside] |= b.article > 0 and b.article != asides[b.aside][2]
    plain = [i for i, (_, b) in enumerate(found) if not b.aside]
    article = any(found[i][1].article for i in plain)
    long_article = some_long and any(found[i][1].article and weights[i] for i in plain)

    @cache
    def content_outside() -> bool:
        return any(weights[i] and (stop_share(found[i][0]) or 0) >= STOP_WORDS for i in plain)

    for k in range(n - 1, 0, -1):
        around, why, up_article = asides[k]
        if why == ALWAYS or 2 * held[k] <= total or not (some_long or with_article[k]):
            continue
        if long_article if why == BY_WRAP and up_article else article:
            continue
        if (
            with_article[k] and why != BY_REMARK
            or why == BY_WRAP
            or why != BY_TAG and not content_outside()
        ):
            off[k] = False
            held[around] += held[k]
            with_article[around] |= with_article[k]
    for k in range(1, n):
        off[k] = off[k] or off[asides[k][0]]
    return off


def stop_share(text: str) -> float | None:
    """Share of stop words in a text, for the language that has the most of them; None in another script."""
    words = LETTERS.findall(text.lower())
    if not text.isascii() and 2 * len(OTHER_SCRIPT.findall(text)) > sum(map(len, words)):
        return None
    hits = [w for w in words if w in ANY_WORD]
    return max(sum(w in known for w in hits) for known in WORDS) / max(1, len(words), text.count(" ") + 1)


def decide(found: list[tuple[str, Block]]) -> list[bool | None]:
    """First pass: content, boilerplate, or None for an ambiguous block."""
    out: list[bool | None] = []
    shares: dict[int, float] = {}
    for i, (text, block) in enumerate(found):
        label: bool | None = None
        if block.aside:
            label = False
        elif mostly_links(text, block):
            label = None if block.article and len(text) < SHORT else False
        elif size(text) >= SHORT:
            share = stop_share(text)
            label = share is None or share >= STOP_WORDS
            if share is not None:
                shares[i] = share
        out.append(label)
    # The lists fit a page if most of what they can judge has enough of their words.
    if 2 * sum(len(found[i][0]) for i in shares if out[i]) < sum(len(found[i][0]) for i in shares):
        for i in shares:
            out[i] = True
    for i, share in shares.items():
        if not out[i] and (share >= FEW_STOP_WORDS or found[i][1].article and len(found[i][0]) < LONG):
            out[i] = None
    return out


#: Where an ambiguous block looks: at the nearest decided one, at both (a heading at what follows), or at both always.
NEAREST, FOLLOWS, BETWEEN = range(3)


def inherit(labels: list[bool | None], headings: list[bool], looks: list[int] | None = None) -> list[bool | None]:
    """Second pass over one run of blocks: ambiguous ones take the label of decided ones beside them."""
    n = len(labels)
    behind: list[tuple[int, bool] | None] = [None] * n
    ahead: list[tuple[int, bool] | None] = [None] * n
    for order, near in ((range(n), behind), (range(n - 1, -1, -1), ahead)):
        last = None
        for i in order:
            if labels[i] is not None:
                last = (i, labels[i])
            near[i] = last
    out = list(labels)
    for i in range(n):
        if labels[i] is None:
            b, a = behind[i], ahead[i]
            look = looks[i] if looks else NEAREST
            if look != NEAREST:
                after = a is not None and a[1]
                out[i] = after and (b is not None and b[1] or look == FOLLOWS and headings[i])
            elif b is None or a is None:
                out[i] = (a or b or (0, None))[1]
            elif headings[i]:
                out[i] = a[1]
            else:
                back, forth = i - b[0], a[0] - i
                out[i] = (b[1] or a[1]) if back == forth else (b if back < forth else a)[1]
    return out


def main_text(page: str) -> str:
    """Content blocks of a page, one line each; empty where there is none."""
    found = blocks(page)
    labels = decide(found)
    headings = [block.heading for _, block in found]
    by_article: dict[int, list[int]] = {}
    for i, (_, b) in enumerate(found):
        if b.article and not b.aside:
            by_article.setdefault(b.article, []).append(i)
    if True in labels:
        looks = [NEAREST] * len(found)
        with_content = [m for m in by_article.values() if any(labels[i] for i in m)]
        if with_content:
            looks = [FOLLOWS] * len(found)
        for members in by_article.values():
            for i in members:
                looks[i] = BETWEEN
        for members in with_content:
            own = inherit([labels[i] for i in members], [headings[i] for i in members])
            for i, label in zip(members, own):
                labels[i] = label
        labels = inherit(labels, headings, looks)
    else:
        for members in by_article.values():
            for i in members:
                labels[i] = labels[i] is None
    return "\n".join(text for (text, _), label in zip(found, labels) if label)


def extract(page: Column) -> Column:
    """Main text of an html column; NULL, empty pages and pages without content give an empty text."""
    small_batches()

    @F.arrow_udf("string")
    def of(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p) for part in steps(pages) for p in part], pa.string())

    return of(page)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page.

    Every row gives one row, on its own: repeated pages and NULL ids or addresses come back as they
    are, a NULL or empty html gives an empty text, and other columns of the table play no part.
    """
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", extract(pages["html"]).alias("text")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )

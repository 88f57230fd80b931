"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree.

A page is cut into blocks, each the text between two borders of block elements. A block is described by the tags
and class words of its ancestors and by its text. The field gives each block the label text or rest; its weights
are learned from labelled pages by maximum likelihood, and the best sequence of labels is found by Viterbi.

The labelled pages come from ``labelled_pages``: layouts as they are common on the web, in which each block's
label is known because the generator has put it there. Their words are random, so that nothing but markup, size
and punctuation can be learned.
"""

from __future__ import annotations

import functools
import html
import random
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled pages made for the fit, and passes over them.
PAGES = 500
#: Share of them without any class, article or main.
PLAIN = 0.2
PASSES = 12

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+(?=>)|[^>]*)>""",
    re.DOTALL,
)
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TAG_ONLY = re.compile(_TAG.pattern.replace(r"<!\[CDATA\[.*?\]\]>|", ""), re.DOTALL)
# Elements whose content is no text of the page, those of them whose content goes on to the page's end if
# they are not closed, elements that never have content, and block elements.
RAW = frozenset("script style noscript template textarea select iframe svg canvas title".split())
SWALLOW = frozenset("script style noscript textarea iframe title".split())
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul hr".split()
)
#: Starting one of these ends an open element of the second kind.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"},
}
#: Elements that bound the search for what an end tag or an implied end closes.
SCOPE = frozenset("html body table td th article section main aside nav header footer form div ul ol dl".split())

BIAS, LABELS = "bias", 2
_END = re.compile(r"[.!?…。！？:;\"”»)]$")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    own: str  # the innermost block element
    tags: frozenset[str]  # the block elements around it
    depth: int  # how many there are
    names: frozenset[str]  # words of the classes, ids and roles of all elements around it
    label: int | None = None


@dataclass
class _Open:
    """An open element, with what holds inside it: sets are those of the element around it unless it adds something."""

    tag: str
    own: str
    tags: frozenset[str]
    depth: int
    names: frozenset[str]
    label: int | None


class _Elements:
    """The open elements, with the places of each tag, so that nothing is searched for."""

    def __init__(self):
        self.open = [_Open("", "none", frozenset(), 0, frozenset(), None)]
        self.places: dict[str, list[int]] = {}

    def add(self, tag: str, names: frozenset[str], label: int | None) -> None:
        top = self.open[-1]
        block = tag in BLOCK
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(_Open(
            tag,
            tag if block else top.own,
            top.tags | {tag} if block and tag not in top.tags else top.tags,
            top.depth + block,
            top.names if names <= top.names else top.names | names,
            top.label if label is None else label,
        ))

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tags, bounds=frozenset()) -> None:
        """Close the innermost open element of ``tags`` and all inside it, unless a bound is further in."""
        at = self.last(tags)
        if at and at > self.last(bounds):
            for element in self.open[at:]:
                self.places[element.tag].pop()
            del self.open[at:]


def blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """The blocks of a page in order. Markup of any kind is accepted; what is not closed ends with the page.

    ``known`` keeps only these names. Time and memory are in proportion to the page, however deep it nests.
    """
    found: list[Block] = []
    elements = _Elements()
    parts: list[str] = []
    linked = 0
    at, size = 0, len(page)
    # Behind these places there are no more tags, sections and end tags of a kind, so nothing looks for them again.
    tags_end, sections_end, unclosed = page.rfind(">") + 1, page.rfind("]]>"), set()

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = elements.open[-1]
                found.append(Block(text, linked, top.own, top.tags, top.depth, top.names, top.label))
            parts.clear()
        linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        decoded = html.unescape(raw) if "&" in raw else raw
        parts.append(decoded)
        if elements.places.get("a"):
            linked += len(decoded.strip())

    while at < size:
        match = (_TAG if at < sections_end else _TAG_ONLY).search(page, at, tags_end) if at < tags_end else None
        if match is None:
            end = page.find("<!--", max(at, tags_end))  # a comment that is not closed
            text(page[at : size if end < 0 else end])
            break
        if match.start() > at:
            text(page[at : match.start()])
        at = match.end()
        if match[2] is None:  # a comment or a declaration
            if match[0].startswith("<![CDATA["):
                parts.append(match[0][9:-3])
            elif match[0].startswith("<!--") and not match[0].endswith("-->"):
                break
            continue
        tag = match[2].lower()
        if match[1]:
            if tag in BLOCK:
                close()
            elements.close({tag}, SCOPE - {tag} if tag not in SCOPE else frozenset())
            continue
        if tag in RAW:
            parts.append(" ")
            if not match[3].endswith("/"):
                end = None if tag in unclosed else re.compile(f"</{re.escape(tag)}[^>]*>", re.IGNORECASE).search(page, at)
                if end is not None:
                    at = end.end()
                elif tag in SWALLOW:
                    break
                else:
                    unclosed.add(tag)
            continue
        if tag in BLOCK:
            close()
            elements.close({"p"}, SCOPE)
            if tag in ENDS:
                elements.close(ENDS[tag], SCOPE - ENDS[tag])
        elif tag in EMPTY:
            parts.append(" ")
        if tag not in EMPTY:
            names, label = frozenset(), None
            if match[3]:
                said = " ".join(filter(None, (x for m in _NAMED.findall(match[3]) for x in m)))
                names = frozenset(_WORD.findall(_CAMEL.sub(" ", said).lower()))
                if known is not None:
                    names &= known
                if "data-label" in match[3]:
                    label = int('data-label="1"' in match[3])
            elements.add(tag, names, label)
    close()
    return found


def features(found: list[Block]) -> list[list[str]]:
    """What is known of each block, as names; each counts as 1."""
    out = []
    for i, block in enumerate(found):
        words = block.text.split()
        share = block.linked / max(1, len(block.text))
        own = block.own
        f = [BIAS, f"own={own}", f"size={min(6, len(words).bit_length())}", f"linked={round(share * 4)}"]
        f += [f"in={tag}" for tag in block.tags]
        f += [f"named={name}" for name in block.names]
        f.append(f"ends={bool(_END.search(block.text))}")
        f.append(f"depth={min(8, block.depth)}")
        if "©" in block.text:
            f.append("copyright")
        if i == 0 or i == len(found) - 1:
            f.append("edge")
        if own in ("h1", "h2", "h3") and i + 1 < len(found) and found[i + 1].own == "p":
            f.append("heads a paragraph")
        if "article" not in block.tags and "main" not in block.tags:
            f.append("outside article and main")
        out.append(f)
    return out


@dataclass(frozen=True)
class Field:
    """Weights of the field: a pair per feature, and those from label to label."""

    weights: dict[str, tuple[float, float]]
    steps: tuple[tuple[float, float], tuple[float, float]]

    @functools.cached_property
    def names(self) -> frozenset[str]:
        """The names it has weights for."""
        return frozenset(w.removeprefix("named=") for w in self.weights if w.startswith("named="))

    def scores(self, observed: list[list[str]]) -> np.ndarray:
        none, get = (0.0, 0.0), self.weights.get
        return np.array([np.sum([get(name, none) for name in f], axis=0) for f in observed])

    def decode(self, observed: list[list[str]]) -> list[int]:
        """The most likely labels (Viterbi)."""
        if not observed:
            return []
        scores = self.scores(observed).tolist()
        (aa, ab), (ba, bb) = self.steps
        a, b = scores[0]
        back = []
        for x, y in scores[1:]:
            from_a, from_b = a + aa >= b + ba, a + ab >= b + bb
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = (a + aa if from_a else b + ba) + x, (a + ab if from_b else b + bb) + y
        label = 0 if a > b else 1
        labels = [label]
        for pair in reversed(back):
            label = pair[label]
            labels.append(label)
        return labels[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(pages: list[tuple[list[list[str]], list[int]]], passes: int = PASSES, rate: float = 0.3, ridge: float = 1e-4) -> Field:
    """Maximum likelihood by stochastic gradients with steps per weight; the expectations come from forward-backward."""
    index = {name: i for i, name in enumerate(sorted({n for observed, _ in pages for f in observed for n in f}))}
    w, t = np.zeros((len(index), LABELS)), np.zeros((LABELS, LABELS))
    seen_w, seen_t = np.full_like(w, 1e-3), np.full_like(t, 1e-3)
    coded = [([np.array([index[n] for n in f]) for f in observed], np.array(labels)) for observed, labels in pages if labels]
    rng = random.Random(1)
    for _ in range(passes):
        rng.shuffle(coded)
        for observed, labels in coded:
            n = len(observed)
            score = np.array([w[ids].sum(axis=0) for ids in observed])
            forward, backward = np.zeros((n, LABELS)), np.zeros((n, LABELS))
            forward[0] = score[0]
            for i in range(1, n):
                forward[i] = score[i] + _log_sum(forward[i - 1][:, None] + t, 0)
            for i in range(n - 2, -1, -1):
                backward[i] = _log_sum(t + (score[i + 1] + backward[i + 1])[None, :], 1)
            total = _log_sum(forward[-1], 0)
            wrong = -np.exp(forward + backward - total)
            wrong[np.arange(n), labels] += 1
            slope_t = np.zeros_like(t)
            for i in range(1, n):
                slope_t -= np.exp(forward[i - 1][:, None] + t + (score[i] + backward[i])[None, :] - total)
                slope_t[labels[i - 1], labels[i]] += 1
            slope_w = np.zeros_like(w)
            for ids, x in zip(observed, wrong):
                slope_w[ids] += x
            touched = np.unique(np.concatenate(observed))
            slope = slope_w[touched] - ridge * w[touched]
            seen_w[touched] += slope**2
            w[touched] += rate * slope / np.sqrt(seen_w[touched])
            slope_t -= ridge * t
            seen_t += slope_t**2
            t += rate * slope_t / np.sqrt(seen_t)
    return Field({name: tuple(w[i].tolist()) for name, i in index.items()}, tuple(map(tuple, t.tolist())))


def labelled_pages(count: int = PAGES, seed: int = 7) -> list[str]:
    """Pages of common layouts; ``data-label`` is 1 on what belongs to the article and 0 on what does not."""
    rng = random.Random(seed)
    pick, chance = rng.choice, rng.random

    def words(low: int, high: int, end: str = "") -> str:
        made = ["".join(pick("aeioulnrstdmé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(low, high))]
        return " ".join(made).capitalize() + end

    def sentences(low: int, high: int) -> str:
        return " ".join(words(1, 18, pick("....!?")) for _ in range(rng.randint(low, high)))

    def rest(tag: str, name: str, inside: str) -> str:
        named = f' {pick(("class", "id"))}="{name}"' if name else ""
        return f'<{tag}{named} data-label="0">{inside}</{tag}>'

    def links(low: int, high: int) -> str:
        items = "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(rng.randint(low, high)))
        return f"<ul>{items}</ul>"

    def paragraphs(tag: str, low: int, high: int) -> str:
        return "".join(f"<{tag}>{sentences(1, 4)}</{tag}>" for _ in range(rng.randint(low, high)))

    def notice() -> str:
        name = pick(("cookie-notice", "notice", "banner", "alert", "consent", "gdpr-banner", "cookie", "message", "popup", "paywall"))
        return rest(pick(("div", "section", "p", "aside")), name, pick(("{}", "<p>{}</p>")).format(sentences(1, 2)))

    def advert() -> str:
        name = pick(("ad", "ads", "advert", "advertisement", "sponsored", "ad-slot", "promo", "ad box"))
        return rest(pick(("div", "aside", "section", "p")), name, pick((sentences(1, 2), words(3, 9), f"<p>{sentences(1, 2)}</p>", links(1, 3))))

    def side() -> str:
        name = pick(("sidebar", "side", "related", "widget", "", "right sidebar", "trending", "share", "tags", "newsletter", "author-bio"))
        tag = "aside" if not name else pick(("aside", "div", "section"))
        return rest(tag, name, pick(("", f"<h3>{words(1, 4)}</h3>")) + pick((links(2, 6), paragraphs("p", 1, 3))))

    def comments() -> str:
        name = pick(("comments", "comment-list", "reader-comments", "discussion", "replies", "comments-area"))
        each = "".join(
            pick(('<div class="comment"><p>{}</p></div>', "<li>{}</li>", "<p>{}</p>", '<article class="comment"><p>{}</p></article>')).format(sentences(1, 3))
            for _ in range(rng.randint(1, 5))
        )
        return rest(pick(("section", "div", "ol")), name, pick(("", f"<h2>{words(1, 2)}</h2>")) + each)

    def form() -> str:
        inside = f"<label>{words(1, 3)}</label><input type=text><button>{words(1, 2)}</button>"
        return rest("form", pick(("", "search", "login", "subscribe")), pick(("", f"<p>{sentences(1, 1)}</p>")) + inside)

    def menu() -> str:
        return pick((
            lambda: rest("nav", pick(("", "menu", "main-nav", "breadcrumb")), links(2, 8)),
            lambda: rest("div", pick(("nav", "menu", "navbar", "navigation", "breadcrumbs")), pick((links(2, 8), " ".join(f"<a href=x>{words(1, 2)}</a>" for _ in range(5))))),
        ))()

    def article() -> str:
        parts = [f"<h1>{words(2, 12, pick(('', '', '.', '?')))}</h1>"] if chance() < 0.8 else []
        for _ in range(rng.randint(1, 14)):
            x = chance()
            if x < 0.7:
                opened = pick(("", "", "<b>", "<em>"))
                body = sentences(1, 5) if chance() < 0.8 else words(1, 4, pick((".", "", ".")))
                closed = pick(("</p>", "</p>", "<br>"))
                parts.append(f"<p>{opened}{body}{closed}")
            elif x < 0.78:
                parts.append(f"<{(t := pick(('h2', 'h3')))}>{words(1, 7)}</{t}>")
            elif x < 0.84:
                parts.append("<ul>" + "".join(f"<li>{words(3, 14, pick(('', '.')))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif x < 0.88:
                parts.append(f"<blockquote><p>{sentences(1, 2)}</p></blockquote>")
            elif x < 0.9:
                parts.append(f"<p>{words(2, 6)} <a href=x>{words(1, 4)}</a> {words(3, 9, '.')}</p>")
            elif x < 0.92:
                parts.append(f"<pre>{words(3, 12)}</pre>")
            elif x < 0.93:
                parts.append(f"<div>{'<br><br>'.join(sentences(1, 3) for _ in range(rng.randint(1, 4)))}</div>")
            elif x < 0.945:
                parts.append(f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>")
            else:
                parts.append(pick((advert, notice, side, advert, notice, form))())
        return "".join(parts)

    def plain_article() -> str:
        """Without paragraphs: line breaks, or a div for each piece."""
        pieces = [sentences(1, 4) for _ in range(rng.randint(1, 9))]
        title = [f"<h1>{words(2, 9)}</h1>"] if chance() < 0.5 else []
        return "".join(title) + pick(("<br><br>".join(pieces), "<br>".join(pieces), "".join(f"<div>{x}</div>" for x in pieces), "".join(f"<p>{x}</p>" for x in pieces)))

    def plain_page() -> str:
        """Nothing has a class, an id or a telling element: menus and ends show by their links and their size."""
        wrap = pick(('<div data-label="1">{}</div>', '<div><div data-label="1">{}</div></div>', '<span data-label="1">{}</span>', '<td data-label="1">{}</td>'))
        inside = wrap.format(plain_article() if chance() < 0.6 else article())
        bar = " ".join(f"<a href=x>{words(1, 2)}</a>" for _ in range(rng.randint(2, 7)))
        before = rest(pick(("div", "p", "td")), "", pick((links(2, 8), bar))) if chance() < 0.5 else ""
        after = rest(pick(("div", "p", "td")), "", pick((links(2, 5), bar, f"&copy; {words(1, 4)}", f"<p>&copy; {words(1, 4)} {bar}</p>"))) if chance() < 0.5 else ""
        if "<td" in before + inside + after:
            before, inside, after = (re.sub(r"^<(?:div|p|span)|(?:div|p|span)>$", lambda m: m[0].replace(m[0].strip("<>"), "td"), x) for x in (before, inside, after))
            return f"<html><body><table><tr>{before}</tr><tr>{inside}</tr><tr>{after}</tr></table></body></html>"
        return f"<html><head><title>{words(1, 5)}</title></head><body>{before}{inside}{after}</body></html>"

    def page() -> str:
        if chance() < PLAIN:
            return plain_page()
        body = [rest("header", pick(("", "site-header", "top")), pick((f"<h2>{words(1, 3)}</h2>", f"<p>{words(2, 6)}</p>", f"<div>{words(1, 4)}</div>")))] if chance() < 0.5 else []
        top = [menu] * (chance() < 0.85) + [advert] * (chance() < 0.5) + [notice] * (chance() < 0.35) + [side] * (chance() < 0.2)
        rng.shuffle(top)
        body += [make() for make in top]
        inside = article()
        if chance() < 0.25:
            inside = f'<header data-label="1">{inside.split("</h1>")[0]}</h1></header>{inside.split("</h1>", 1)[1]}' if "</h1>" in inside else inside
        if chance() < 0.3:
            inside += comments()
        tag, name = pick((("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "entry-content"),
                          ("div", "article-body"), ("div", "post"), ("div", ""), ("div", ""), ("div", "main"), ("section", "story")))
        named = f' class="{name}"' if name else ""
        whole = f'<{tag}{named} data-label="1">{inside}</{tag}>'
        body.append(f"<main>{whole}</main>" if tag != "main" and chance() < 0.3 else whole)
        low = [side] * (chance() < 0.4) + [comments] * (chance() < 0.35) + [form] * (chance() < 0.3) + [advert] * (chance() < 0.3) + [notice] * (chance() < 0.2)
        rng.shuffle(low)
        body += [make() for make in low]
        if chance() < 0.85:
            foot = pick((f"&copy; {words(1, 3)} &middot; {sentences(1, 2)}", f"<p>&copy; {words(2, 5)}</p>", links(2, 4), sentences(1, 2)))
            body.append(rest(pick(("footer", "footer", "div")), "footer", foot))
        wrap = pick(("{}", "{}", '<div id="page">{}</div>', "<div class=wrapper><div class=container>{}</div></div>"))
        return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{wrap.format(''.join(body))}</body></html>"

    return [page() for _ in range(count)]


@functools.lru_cache(maxsize=2)
def trained(count: int = PAGES, seed: int = 7) -> Field:
    """The field learned from labelled pages."""
    pages = [[b for b in blocks(page) if b.label is not None] for page in labelled_pages(count, seed)]
    return train([(features(found), [b.label for b in found]) for found in pages])


def main_text(page: str | None, field: Field) -> str:
    """The blocks labelled as text, with an empty line between them; NULL and empty pages have none."""
    found = blocks(page or "", field.names)
    return "\n\n".join(block.text for block, label in zip(found, field.decode(features(found))) if label)


def extracted(page: Column, field: Field) -> Column:
    """string: the main text of a column of pages."""

    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, field) for p in pages], dtype=object)

    return of(page)


def extract_pages(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    The text is empty if a page has none, is NULL, or is no markup that leads anywhere. Only page_id, url and html
    are read, so other columns may have any name; NULL and repeated ids are passed on; an empty table gives no rows.
    Pages of any length are read whole.
    """
    rows = pages.select("page_id", "url", extracted(F.col("html"), field or trained()).alias("text"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))

"""Main text of web pages: flat text blocks, shallow features, a decision tree.

A page is cut into blocks at block-level tags; scripts, styles, templates, comments, the head, form controls, drawings
(svg, canvas), frames and players give no text. A block's features are its words and link density, those of the blocks before and after it, whether it is a
heading or a list item, whether it is short and begins like a notice (articles may quote those), whether it stands in an article or main part,
whether the nearest part around it is one for navigation, headers, footers, asides or forms, and whether a class, id or
role around it names such a part, or the heading above it announces readers' comments. The tree is grown from TRAINING, a
table of labelled blocks, when the module is loaded. Where parts are tagged they tell most; in articles and on pages
without parts the words and links of a block and its neighbours decide.

Character references are decoded, white space inside a block (also a line break tag) becomes one space, and the chosen
blocks are joined by a line feed in page order.

Defined cases: null or empty html, and pages without main text, give an empty text; tags that are not closed end with
the part around them, also those without text; a page cut off in a tag or a script ends there; repeated rows are extracted alike; columns other
than page_id, url, html are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.trees import decide, grow

# Tag names by what they do here, and words of class, id or role that name parts without main text.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
PARTS = set("article aside body dialog details div dl fieldset figure footer form head header main menu nav ol section span table ul".split())
SIDE = set("aside dialog fieldset footer form head header menu nav".split())
MAIN = {"article", "main"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
RAW = "script|style|template|textarea"
SILENT = set("select button svg iframe canvas video audio".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HINTS = set(
    "ad ads adv advert advertisement advertisements advertising adverts adbox banner breadcrumb breadcrumbs byline comment comments commentlist "
    "consent cookie cookies copyright disclaimer discussion disqus dialog dropdown feedback foot footer form gdpr header hidden login masthead menu "
    "modal nav navbar navigation navi newsletter notice notices notification overlay pager pagination paywall popup popular "
    "promo promoted promotion recommended related replies respond responses search share sharing sidebar sidebars "
    "signup social sponsor sponsored sponsors subscribe subscription teaser toc toolbar topbar trending "
    "widget widgets complementary contentinfo".split()
)
#: Those that say the same as the first word of a longer name: ad-slot, nav-left, but not form-of-government.
LEADING = set("ad ads advert advertisement breadcrumb comment comments cookie cookies disqus footer gdpr menu nav navbar navigation newsletter pagination promo related share sharing sidebar social sponsor sponsored subscribe widget".split())
#: What short blocks of notices, comments and offers begin with, in lower case.
CUES = (
    "copyright", "\u00a9", "all rights reserved", "readers say", "comments", "comment by", "reader comments", "leave a comment", "leave a reply", "responses",
    "share this", "related articles", "read more", "sponsored", "advertisement", "subscribe", "sign up", "log in", "we use cookies", "this site uses cookies",
    "terms of use", "privacy policy", "follow us", "skip to",
)
#: Headings under which readers write; what follows, up to the next heading, is theirs. They are the whole heading, but
#: for a count; those that also head a section of an article count outside articles only.
READERS = ("readers say", "comments", "comment", "reader comments", "leave a comment", "leave a reply")
READERS_OUTSIDE = ("responses", "discussion")
CUED_WORDS = 14
#: First words of names that describe the page around, as in has-sidebar.
ABOUT = {"has", "with", "no", "without", "layout"}
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<[/!?]?[a-zA-Z](?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*?(?:>|\Z)", re.S | re.I)
_NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9]*)")
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PIECE = re.compile(r"[a-zA-Z][a-z]*|[A-Z]+")
COUNT = " 0123456789()[]:.,#"
FEATURES = ("words", "link_density", "words_before", "links_before", "words_after", "links_after", "heading", "item", "cue", "in_main", "side", "hint")


def _hinted(tag: str) -> bool:
    for m in _HINT.finditer(tag):
        value = next(g for g in (*m.groups(), "") if g is not None)
        for one in value.split():
            pieces = [p.lower() for p in _PIECE.findall(one)]
            if pieces and pieces[0] not in ABOUT and (pieces[-1] in HINTS or pieces[0] in LEADING):
                return True
    return bool(_HIDDEN.search(tag))


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool, bool, bool]]:
    """``(text, words, words in links, heading, item, in main, side, hint)`` in page order, without empty ones."""
    out: list = []
    parts: list[tuple] = []  # (tag, in main, side, hint) of the open parts
    state = (False, False, False)
    heading = item = False
    link = 0
    text: list[str] = []
    linked = 0
    silent: list[str] = []  # the open part without text, and the tags open in it
    readers = False

    def flush() -> None:
        nonlocal linked, readers
        if text:
            words = "".join(text).split()
            if words:
                line = " ".join(words)
                if heading:
                    name = line.lower().strip(COUNT)
                    readers = name in READERS or (name in READERS_OUTSIDE and not state[0])
                out.append((line, len(words), min(linked, len(words)), heading, item, *state[:2], state[2] or readers))
            text.clear()
        linked = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not silent:
            piece = entities.unescape(page[at : m.start()])
            text.append(piece)
            if link:
                linked += len(piece.split())
        at = m.end()
        tag = m.group()
        named = _NAME.match(tag)
        if not named:
            continue
        name = named.group(1).lower()
        closing = tag[1] == "/"
        mute = name in SILENT and tag[named.end() : named.end() + 1] in " \t\n\r\f/>"  # not <video-player>
        if silent and closing and name not in silent and (name in BLOCK or name == "span" or (name == "a" and link)):
            silent.clear()  # the part around it ends
        if silent or mute:
            if name in silent and (closing or (mute and name != "svg")):  # a second button ends the first
                del silent[len(silent) - 1 - silent[::-1].index(name) :]
            if not closing and not tag.endswith("/>") and name not in VOID and (mute or (silent and (name in BLOCK or name in ("span", "a")))):
                silent.append(name)
            continue
        if name == "br":
            text.append(" ")
            continue
        if name == "a":
            link = 0 if closing else 1
        if name in BLOCK:
            flush()
            heading = not closing and name in HEADING
            item = not closing and (name in ("li", "dt", "dd", "option") or (item and name not in ("ul", "ol", "dl")))
            if name in ("p", "div", "section", "td", "th") and not closing:
                item = False
            link = 0 if name != "a" and closing and name in PARTS else link
        if name in PARTS:
            if closing:
                k = next((k for k in range(len(parts) - 1, -1, -1) if parts[k][0] == name), None)
                if k is not None:
                    if name == "span":
                        if parts[k][3] != (parts[k - 1][3] if k else False):
                            flush()
                    del parts[k:]
            elif not tag.endswith("/>"):
                hint = state[2] or _hinted(tag)
                if name in MAIN:
                    own = (name, True, False, False)
                else:
                    own = (name, state[0], state[1] or (name in SIDE and not (name == "header" and state[0])), hint)
                    if name == "body":
                        own = ("body", False, False, False)
                if name == "span" and own[3] != state[2]:
                    flush()
                parts.append(own)
            state = parts[-1][1:] if parts else (False, False, False)
            if name in MAIN and not closing and any(p[3] or (p[2] and p[0] != "body") for p in parts[:-1]):
                parts[-1] = (name, True, True, True)  # an article quoted in a comment or an aside
                state = parts[-1][1:]
    if at < len(page) and not silent:
        text.append(entities.unescape(page[at:]))
    flush()
    return out


def rows(found: list[tuple]) -> list[tuple]:
    """Feature rows of a page's blocks."""
    density = [b[2] / b[1] for b in found]
    size = [min(b[1], 100) for b in found]
    out = []
    for i, b in enumerate(found):
        heading, item, in_main, side, hint = (float(x) for x in b[3:])
        before = (size[i - 1], density[i - 1]) if i else (0, 0.0)
        after = (size[i + 1], density[i + 1]) if i + 1 < len(found) else (0, 0.0)
        cue = float(not in_main and b[1] <= CUED_WORDS and b[0].lower().startswith(CUES))
        out.append((size[i], density[i], *before, *after, heading, item, cue, in_main, side, hint))
    return out


# Labelled blocks, in the order of FEATURES, and 1 for main text. Written by hand for this module.
TRAINING = [
    # articles in their own part: headings, long and short paragraphs, lists, captions
    (2, 0.0, 1, 0.0, 1, 0.0, 0, 0, 0, 1, 0, 0, 1),
    (3, 1.0, 3, 1.0, 3, 1.0, 0, 1, 0, 1, 0, 0, 0),
    (4, 0.3, 2, 0.0, 3, 0.0, 0, 0, 0, 1, 0, 0, 1),
    (5, 0.0, 4, 0.0, 2, 1.0, 0, 0, 0, 1, 0, 0, 1),
    (2, 0.0, 3, 1.0, 1, 1.0, 1, 0, 0, 1, 0, 0, 1),
    (1, 0.0, 2, 0.0, 12, 0.1, 0, 0, 0, 1, 0, 0, 1),
    (20, 0.9, 3, 0.0, 4, 0.0, 0, 0, 0, 1, 0, 0, 1),
    (8, 0.0, 8, 0.0, 8, 0.0, 0, 0, 0, 1, 0, 0, 1),
    (9, 0.0, 6, 1.0, 80, 0.0, 1, 0, 0, 1, 0, 0, 1),
    (3, 0.0, 2, 1.0, 2, 0.0, 1, 0, 0, 1, 0, 0, 1),
    (80, 0.0, 9, 0.0, 60, 0.0, 0, 0, 0, 1, 0, 0, 1),
    (60, 0.05, 80, 0.0, 2, 0.0, 0, 0, 0, 1, 0, 0, 1),
    (2, 0.0, 60, 0.0, 40, 0.0, 0, 0, 0, 1, 0, 0, 1),
    (1, 0.0, 1, 0.0, 1, 0.0, 0, 0, 0, 1, 0, 0, 1),
    (40, 0.1, 2, 0.0, 0, 0.0, 0, 0, 0, 1, 0, 0, 1),
    (5, 0.2, 30, 0.0, 5, 0.2, 0, 1, 0, 1, 0, 0, 1),
    (12, 0.5, 30, 0.0, 30, 0.0, 0, 0, 0, 1, 0, 0, 1),
    (4, 1.0, 50, 0.0, 50, 0.0, 0, 0, 0, 1, 0, 0, 1),
    (6, 0.0, 6, 0.0, 12, 0.0, 0, 0, 0, 1, 0, 0, 1),
    (100, 0.0, 100, 0.0, 12, 0.1, 0, 0, 0, 1, 0, 0, 1),
    (7, 0.0, 1, 1.0, 12, 0.1, 0, 0, 0, 1, 0, 0, 1),
    (3, 0.0, 5, 0.0, 10, 0.0, 0, 0, 0, 1, 0, 0, 1),
    # side parts and named parts inside articles
    (10, 0.0, 60, 0.0, 60, 0.0, 0, 0, 0, 1, 0, 1, 0),
    (50, 0.0, 60, 0.0, 60, 0.0, 0, 0, 0, 1, 0, 1, 0),
    (3, 0.0, 60, 0.0, 10, 0.0, 0, 0, 0, 1, 0, 1, 0),
    (30, 0.1, 60, 0.0, 3, 0.0, 0, 0, 0, 1, 1, 0, 0),
    (4, 1.0, 60, 0.0, 4, 1.0, 0, 1, 0, 1, 1, 0, 0),
    (70, 0.0, 30, 0.0, 70, 0.0, 0, 0, 0, 1, 1, 1, 0),
    (5, 0.0, 70, 0.0, 0, 0.0, 1, 0, 0, 1, 1, 1, 0),
    # navigation, headers, footers, adverts, forms and notices outside articles
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 0, 1, 0, 0),
    (2, 1.0, 1, 1.0, 2, 1.0, 0, 1, 0, 0, 1, 0, 0),
    (9, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0, 1, 0, 0),
    (12, 0.1, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 1, 0, 0),
    (60, 0.0, 40, 0.0, 9, 0.0, 0, 0, 0, 0, 1, 0, 0),
    (8, 0.0, 1, 1.0, 9, 0.0, 0, 0, 0, 0, 0, 1, 0),
    (45, 0.0, 10, 0.0, 20, 0.0, 0, 0, 0, 0, 0, 1, 0),
    (25, 0.0, 50, 0.0, 30, 0.0, 0, 0, 0, 0, 0, 1, 0),
    (4, 0.0, 1, 1.0, 30, 0.0, 1, 0, 0, 0, 1, 1, 0),
    (100, 0.0, 90, 0.0, 80, 0.0, 0, 0, 0, 0, 1, 1, 0),
    (60, 0.0, 40, 0.0, 0, 0.0, 0, 0, 0, 0, 1, 0, 0),
    (30, 0.0, 80, 0.0, 3, 0.0, 0, 0, 0, 0, 1, 0, 0),
    (25, 0.0, 2, 1.0, 60, 0.0, 0, 0, 0, 0, 1, 0, 0),
    (50, 0.0, 30, 0.0, 4, 0.0, 0, 0, 0, 0, 0, 1, 0),
    (60, 0.1, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1, 0),
    (25, 0.0, 3, 1.0, 5, 0.0, 0, 0, 0, 0, 0, 1, 0),
    (5, 0.0, 40, 0.0, 40, 0.0, 1, 0, 0, 0, 0, 1, 0),
    # pages without such parts: long prose is text, so are headings and short lines next to it
    (3, 0.0, 4, 0.0, 4, 0.0, 0, 0, 0, 0, 0, 0, 0),
    (2, 0.0, 1, 1.0, 0, 0.0, 0, 0, 0, 0, 0, 0, 0),
    (6, 0.0, 5, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 0, 0),
    (4, 0.0, 0, 0.0, 3, 0.0, 0, 0, 0, 0, 0, 0, 0),
    (3, 0.0, 0, 0.0, 2, 1.0, 1, 0, 0, 0, 0, 0, 0),
    (60, 0.0, 5, 0.0, 70, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (25, 0.05, 60, 0.0, 40, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (30, 0.0, 2, 1.0, 5, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (18, 0.1, 9, 0.0, 25, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (100, 0.1, 3, 1.0, 3, 1.0, 0, 0, 0, 0, 0, 0, 1),
    (7, 0.0, 2, 1.0, 60, 0.0, 1, 0, 0, 0, 0, 0, 1),
    (4, 0.0, 40, 0.0, 60, 0.0, 1, 0, 0, 0, 0, 0, 1),
    (3, 0.0, 50, 0.0, 45, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (1, 0.0, 40, 0.0, 30, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (2, 0.0, 30, 0.0, 20, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (4, 0.0, 25, 0.0, 15, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (2, 0.0, 15, 0.0, 60, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (6, 0.0, 45, 0.0, 35, 0.05, 0, 0, 0, 0, 0, 0, 1),
    (9, 0.1, 30, 0.0, 9, 0.1, 0, 1, 0, 0, 0, 0, 1),
    (5, 0.0, 4, 0.0, 5, 0.0, 0, 0, 0, 0, 0, 0, 0),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0, 0, 0),
    (3, 1.0, 0, 0.0, 60, 0.0, 0, 0, 0, 0, 0, 0, 0),
    (6, 0.9, 60, 0.0, 6, 0.9, 0, 1, 0, 0, 0, 0, 0),
    (4, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 0, 0, 0),
    (15, 0.8, 2, 1.0, 30, 0.0, 0, 0, 0, 0, 0, 0, 0),
    (30, 0.7, 15, 0.8, 4, 0.9, 0, 0, 0, 0, 0, 0, 0),
    (5, 0.3, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 0, 0),
    (4, 0.0, 2, 1.0, 3, 1.0, 1, 0, 0, 0, 0, 0, 0),
    (8, 0.0, 3, 1.0, 4, 0.9, 0, 0, 0, 0, 0, 0, 0),
    # lists of links in an article: menus; a link of its own between prose: text
    (1, 1.0, 3, 0.0, 1, 1.0, 0, 1, 0, 1, 0, 0, 0),
    (1, 1.0, 1, 1.0, 2, 1.0, 0, 1, 0, 1, 0, 0, 0),
    (2, 1.0, 1, 1.0, 40, 0.0, 0, 1, 0, 1, 0, 0, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 1, 0, 0, 0),
    (4, 1.0, 5, 1.0, 6, 1.0, 0, 0, 0, 1, 0, 0, 0),
    (3, 1.0, 30, 0.0, 25, 0.0, 0, 1, 0, 1, 0, 0, 1),
    (2, 1.0, 12, 0.2, 9, 0.1, 0, 1, 0, 1, 0, 0, 1),
    (15, 0.9, 40, 0.0, 12, 0.1, 0, 0, 0, 1, 0, 0, 1),
    # short notices and offers
    (4, 0.0, 20, 0.0, 30, 0.0, 0, 0, 1, 0, 0, 0, 0),
    (9, 0.0, 0, 0.0, 60, 0.0, 0, 0, 1, 0, 0, 0, 0),
    (3, 0.0, 10, 0.0, 8, 0.0, 0, 0, 1, 0, 0, 0, 0),
    (7, 0.0, 60, 0.0, 0, 0.0, 0, 0, 1, 0, 0, 0, 0),
    (5, 0.0, 40, 0.0, 6, 0.0, 0, 0, 1, 0, 0, 0, 0),
    (2, 0.0, 60, 0.0, 3, 0.0, 1, 0, 1, 0, 0, 0, 0),
    (12, 0.1, 20, 0.0, 40, 0.0, 0, 0, 1, 0, 0, 0, 0),
    # headings: before prose, before links
    (2, 0.0, 0, 0.0, 60, 0.0, 1, 0, 0, 0, 0, 0, 1),
    (2, 0.0, 2, 1.0, 40, 0.0, 1, 0, 0, 0, 0, 0, 1),
    (1, 0.0, 30, 0.0, 30, 0.0, 1, 0, 0, 0, 0, 0, 1),
    (6, 0.0, 0, 0.0, 14, 0.0, 1, 0, 0, 0, 0, 0, 1),
    (4, 0.0, 3, 1.0, 20, 0.1, 1, 0, 0, 0, 0, 0, 1),
    (3, 0.0, 3, 0.0, 25, 0.0, 1, 0, 0, 0, 0, 0, 1),
    (2, 0.0, 1, 0.0, 50, 0.0, 1, 0, 0, 0, 0, 0, 1),
    (3, 0.0, 2, 1.0, 2, 1.0, 1, 0, 0, 0, 0, 0, 0),
    (4, 0.0, 40, 0.0, 3, 1.0, 1, 0, 0, 0, 0, 0, 0),
    (2, 1.0, 0, 0.0, 30, 0.0, 1, 0, 0, 0, 0, 0, 0),
    # prose between links, and remarks between them
    (50, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0, 0, 1),
    (30, 0.0, 4, 1.0, 3, 0.9, 0, 0, 0, 0, 0, 0, 1),
    (25, 0.1, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 0, 0, 1),
    (16, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 0, 0, 1),
    (40, 0.05, 60, 0.0, 3, 1.0, 0, 0, 0, 0, 0, 0, 1),
    (20, 0.0, 2, 1.0, 25, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (4, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0, 0, 0),
    (6, 0.2, 3, 1.0, 4, 1.0, 0, 0, 0, 0, 0, 0, 0),
    (1, 0.0, 40, 0.0, 1, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (3, 0.0, 60, 0.0, 2, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (5, 0.0, 30, 0.0, 3, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (3, 0.67, 50, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 0, 0),
    (5, 0.8, 40, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 0, 0),
    (8, 0.75, 30, 0.0, 3, 0.5, 0, 0, 0, 0, 0, 0, 0),
    # items without links
    (2, 0.0, 2, 0.0, 20, 0.0, 0, 1, 0, 0, 0, 0, 1),
    (2, 0.0, 30, 0.0, 2, 0.0, 0, 1, 0, 0, 0, 0, 1),
    (4, 0.0, 4, 0.0, 4, 0.0, 0, 1, 0, 0, 0, 0, 1),
    (3, 0.0, 3, 0.0, 30, 0.0, 0, 1, 0, 0, 0, 0, 1),
    (5, 0.0, 6, 0.0, 3, 0.0, 0, 1, 0, 0, 0, 0, 1),
    # pages of one or two plain blocks
    (14, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (7, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (19, 0.0, 3, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (12, 0.0, 2, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (13, 0.0, 0, 0.0, 16, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (16, 0.0, 13, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (2, 1.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 0, 0),
]
TREE = grow([r[:-1] for r in TRAINING], [r[-1] for r in TRAINING], depth=12)


def main_text(page: str | None, tree=TREE) -> str:
    found = blocks(page or "")
    return "\n".join(b[0] for b, r in zip(found, rows(found), strict=True) if decide(tree, r))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``, one row for each row of ``pages``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    columns = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return columns.mapInArrow(apply, "page_id long, url string, text string, n_chars long")

"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by their
place (navigation, forms, comments and the like are never content; where the page marks
an article, neither is what lies outside it), link density, stop-word density and length.
Short or otherwise ambiguous blocks stay open. In the second pass each open block inherits
the label of its nearest decided neighbour - inside an article, of the nearest one in that
article; between two equally near ones content wins there, and elsewhere boilerplate.

A form is no content, unless it is what the page stands in: one that holds most of the
text there is, prose among it, is taken for a plain container.

The reader goes over a page once: the search for a closing tag or quote that is not there
is never repeated, and an end tag without a start costs nothing, so time grows with length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Function words of some European languages; density of these tells prose from lists of names and labels.
STOP_WORDS = frozenset(
    """
    a about all an and are as at be been but by can for from had has have he her his i if in into is it its not of on
    or our she so that the their there they this to was we were which who will with you
    au aux avec ce ces dans de des du elle en est et il la le les mais ne nous on ou par pas plus pour que qui sa se ses
    son sur un une vous
    aber als am auch auf aus bei das dass dem den der die ein eine einer es für hat ich im ist mit nach nicht sich sie
    sind und von vor war wie wird zu zum zur
    al como con del el entre era esta este ha las lo los más muy no o para pero por si sin sobre su sus una y ya
    """.split()
)
#: Elements whose text is never shown as text.
HIDDEN = frozenset("script style noscript template svg math iframe object audio video canvas select textarea button option datalist head title".split())
#: Elements around the content that are not part of it.
AROUND = frozenset("nav footer header aside dialog menu".split())
CONTENT = frozenset(["article", "main"])
BLOCK = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th
    thead tr ul
    """.split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end where one of the same kind, or their parent, starts or ends.
SELF_CLOSING = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
#: Words of class, id and role values that name something other than the content.
NOT_CONTENT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|banners?|sponsor(?:ed|s)?|promos?|nav|navbar|navigation|menus?|breadcrumbs?"
    r"|sidebars?|footers?|page-header|site-header|masthead|cookies?|consent|notices?|gdpr|popups?|modals?|newsletter|subscribe|signup|login"
    r"|comments?|disqus|replies|reply|respond|share|sharing|social|related|recommended|widgets?|pagination|pager|toolbar|copyright"
    r"|contentinfo|complementary|search|alert|dialog)(?:$|[\s_-])",
    re.I,
)
CONTENT_MARK = re.compile(r"""(?:itemprop\s*=\s*["']?articleBody|role\s*=\s*["']?(?:main|article)\b)""", re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: What begins a tag, a comment or a declaration; any other ``<`` is text.
MARKUP = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)|!--|[!?/])")
VALUE_OR_END = re.compile(r""">|=\s*(["'])""")
WORD = re.compile(r"[^\W\d_]+")
#: Thresholds of the first pass: characters of a short block, share of link text, shares of stop words.
SHORT, MOST_LINKS, FEW_STOPS, MANY_STOPS = 40, 0.4, 0.1, 0.2
#: Share of a page's text from which a form is a container.
CONTAINER_FORM = 0.5


@dataclass
class Block:
    text: str
    container: int
    inside: bool
    outside_content: bool
    link_chars: int
    heading: bool = False
    form: int = 0
    label: bool | None = field(default=None)


@dataclass
class _Element:
    name: str
    excluded: bool
    content: int
    form: int = 0


_ROOT = _Element("", False, 0)


class _Page:
    """Cuts a page into markup and text, looking at no place twice."""

    def __init__(self, page: str):
        self.page = page
        self.no_more: set[str] = set()

    def find(self, what: str, at: int) -> int:
        """As ``str.find``; once something is not found, it is not looked for again further on."""
        if what in self.no_more:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.no_more.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """End of the tag whose attributes begin at ``at``; a quote that does not close is no quote."""
        while match := VALUE_OR_END.search(self.page, at):
            at = match.end()
            if not match[1]:
                return at
            close = self.find(match[1], at)
            at = close + 1 if close >= 0 else at
        return len(self.page)

    def after_close(self, name: str, at: int) -> int | None:
        """Where the next end tag of that name ends; None if there is none."""
        if name in self.no_more:
            return None
        end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(self.page, at)
        if not end:
            self.no_more.add(name)
        return end.end() if end else None


def blocks(page: str) -> list[Block]:
    """Blocks with text, in page order."""
    source = _Page(page)
    out: list[Block] = []
    stack: list[_Element] = []
    depth: Counter = Counter()
    parts: list[str] = []
    link_chars = links = contents = forms = 0
    at, any_content, n = 0, False, len(page)

    def end_block() -> None:
        nonlocal parts, link_chars
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                top = stack[-1] if stack else _ROOT
                out.append(Block(text, top.content, bool(top.content), top.excluded, link_chars, top.name in HEADING, top.form))
            parts, link_chars = [], 0

    def pop_one() -> str:
        nonlocal links
        name = stack.pop().name
        depth[name] -= 1
        links -= name == "a"
        return name

    while at < n:
        match = MARKUP.search(page, at)
        text = page[at : match.start() if match else n]
        if text:
            parts.append(text)
            if links:
                link_chars += len(text.strip())
        if not match:
            break
        at = match.end()
        if not match[2]:
            close = source.find("-->" if match[0] == "<!--" else ">", at)
            at = n if close < 0 else close + (3 if match[0] == "<!--" else 1)
            continue
        name = match[2].lower()
        end = source.tag_end(at)
        inner, at = page[at : end - (page[end - 1] == ">")], end
        if match[1]:
            if name in BLOCK:
                end_block()
            if depth[name]:
                while pop_one() != name:
                    pass
            continue
        if name in BLOCK:
            end_block()
        if name in HIDDEN:
            if not inner.endswith("/"):
                after = source.after_close(name, at)
                # Not closed: script and style run to the end; of others only the tag goes.
                if after is not None:
                    at = after
                elif name in ("script", "style"):
                    break
            parts.append(" ")
            continue
        if name in VOID:
            parts.append(" ")
            if name == "br" and re.match(r"\s{0,40}<br\b", page[at : at + 44], re.I):
                end_block()
            continue
        if inner.endswith("/") and name not in BLOCK:
            continue
        while stack and name in SELF_CLOSING.get(stack[-1].name, ()):
            pop_one()
        top = stack[-1] if stack else _ROOT
        excluded = top.excluded or (name in AROUND and not (name == "header" and top.content))
        marked = name in CONTENT
        if len(inner) > 3:
            attributes = {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(inner)}
            named = " ".join(attributes.get(k, "") for k in ("class", "id", "role"))
            hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
            excluded = excluded or hidden or (name not in ("body", "html", "form") and bool(NOT_CONTENT.search(named)))
            marked = marked or bool(CONTENT_MARK.search(inner))
        content, form = top.content, top.form
        if name == "form" and not form:
            forms += 1
            form = forms
        if marked and not excluded:
            contents += 1
            content, any_content = contents, True
        links += name == "a"
        depth[name] += 1
        stack.append(_Element(name, excluded, content, form))
    end_block()
    _close_forms(out)
    if any_content:
        for block in out:
            block.outside_content = block.outside_content or not block.inside
    return out


def _close_forms(found: list[Block]) -> None:
    """Text in forms is no content, but for a form that holds most of the text, prose among it."""
    chars: Counter = Counter()
    prose: set[int] = set()
    for block in found:
        if not block.outside_content:
            chars[block.form] += len(block.text)
            if block.form and block.form not in prose and first_pass(block):
                prose.add(block.form)
    most = CONTAINER_FORM * chars.total()
    for block in found:
        if block.form and not (block.form in prose and chars[block.form] > most):
            block.outside_content = True


def first_pass(block: Block) -> bool | None:
    """True: content, False: boilerplate, None: undecided."""
    if block.outside_content:
        return False
    if block.link_chars > MOST_LINKS * len(block.text):
        return False
    words = WORD.findall(block.text.lower())
    density = sum(map(STOP_WORDS.__contains__, words)) / max(1, len(words))
    if not block.inside and ("©" in block.text or "all rights reserved" in block.text.lower()) and len(block.text) < 300:
        return False
    if len(block.text) >= SHORT and density >= MANY_STOPS:
        return True
    if len(block.text) >= 5 * SHORT and density >= FEW_STOPS:
        return True
    # Tables, lists of names, formulas: without links their neighbours decide.
    return None


def second_pass(found: list[Block]) -> None:
    """Open blocks take the label of the nearest neighbour that the first pass decided by its text.

    Blocks that their place rules out - menus, footers, what surrounds an article - say nothing of their neighbours. Where
    no text is decided, open blocks are content: nothing speaks against them.
    """
    before: list[int | None] = []
    last = None
    for i, block in enumerate(found):
        before.append(last)
        last = i if block.label is not None and not block.outside_content else last
    after: list[int | None] = [None] * len(found)
    following = None
    for i in range(len(found) - 1, -1, -1):
        after[i] = following
        following = i if found[i].label is not None and not found[i].outside_content else following
    labels = []
    for i, block in enumerate(found):
        near = [j for j in (before[i], after[i]) if j is not None and found[j].container == block.container]
        if block.label is not None or not near:
            labels.append(block.label is not False)
        elif block.heading and after[i] in near:
            labels.append(found[after[i]].label)  # a heading belongs to what it heads
        elif len(near) == 2 and 2 * i == sum(near) and found[near[0]].label != found[near[1]].label:
            labels.append(block.inside)
        else:
            labels.append(found[min(near, key=lambda j: abs(i - j))].label)
    for block, label in zip(found, labels, strict=True):
        block.label = label


def main_text(page: str | None) -> str:
    """The page's content blocks, one a line; an empty text where there are none."""
    if not page:
        return ""
    found = blocks(page)
    for block in found:
        block.label = first_pass(block)
    second_pass(found)
    return "\n".join(block.text for block in found if block.label)


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    A null or empty html, and a page without content, gives the empty text. Null ids and
    urls stay null; repeated rows are extracted each; other columns are ignored; an empty
    table gives no rows. Pages of any length are read whole, in time that grows with it.
    """
    rows = pages.select("page_id", "url", "html")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:2])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return rows.mapInArrow(extract, f"{kinds}, text string, n_chars long")

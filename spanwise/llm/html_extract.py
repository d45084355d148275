"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each text block in page order. Lines inside menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, known by their tags,
roles and class names, count zero characters. Text lengths are summed over sliding windows of LINES
lines; a surge is where the sum rises to the threshold, a dive where it falls to zero; the text
between them is kept, line by line, except for the zero-length lines.

A page that marks its article (<article>, <main>, role=main or an article-like class) only counts
lines inside it, and any text there is a surge; windows there remove runs of LINES or more lines that are
mostly links (lists of other articles, menus without a telling name). Elsewhere a surge needs SURGE
characters in a window, and any line that is mostly links counts zero; a page whose windows never reach
that keeps what it has. Inside an article, names like ``entry-header`` or ``post-tags`` don't tell of noise;
only a name that is the word itself does.

Rows are independent: one ``mapInArrow`` over (keys, html), no shuffle. Null or empty html, and pages
without text, give an empty string; repeated rows are extracted each; pages of any length are read whole, in
time that grows with them, broken markup included (after BROKEN tags without an end the rest is text). Extra columns pass through only if named in ``keep``.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..shipping import map_in_arrow

LINES = 3
SURGE = 120
#: Share of a line's characters inside links from which it is a menu line.
LINKED = 0.6

# Fixed values of HTML: elements by what they do to text.
_BREAKING = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td"
    " tfoot th thead tr ul".split()
)
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed".split())
_DROPPED = frozenset("head nav footer aside form button select option svg canvas audio video object map dialog menu".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|"
    r"header|masthead|comments?|commentlist|disqus|respond|reply|replies|cookies?|notices?|consent|gdpr|popup|modal|overlay|share|"
    r"sharing|social|related|recommended|newsletter|subscri\w+|signup|login|pagination|pager|widget|tags|toolbar|skip|alert)(?:$|[\s_-])",
    re.I,
)
#: Names that say no more than how a container is laid out.
_LAYOUT = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without|layout|page|body|site-wrap|wrapper)[\w-]*", re.I)
#: Noise names that inside an article must be a whole class name.
_WEAK = re.compile(r"(?:header|masthead|banner|side|menu|tags|alert|skip|pager|widget|toolbar|reply|replies|social|related|footer)", re.I)
_CONTENT = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main)(?:$|[\s_-](?:body|content|text)?)", re.I)
#: A comment, a CDATA section, a declaration, or the beginning of a tag.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
_NAME = re.compile(r"[^\s/>]*+")
_SWALLOWS = re.compile(r"<!--|<!\[CDATA\[")
_TAG_PART = re.compile(r"[>\"']")
#: Tags that no > outside quotes ends, after which the rest of a page is text.
BROKEN = 64
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_BLANK = re.compile(r"\s+")


def _tag_end(page: str, at: int) -> int:
    """The place after the > that ends a tag, quoted ones aside; -1 if none does."""
    while m := _TAG_PART.search(page, at):
        if m[0] == ">":
            return m.end()
        at = page.find(m[0], m.end()) + 1
        if not at:
            return -1
    return -1


def _tokens(page: str) -> Iterator[tuple[str, str, str, str, int]]:
    """(text before, what: "tag", "text" or "", closing slash, name and attributes, end) of every piece of markup, then the rest.

    A tag's name and attributes are one string; where to go on after a tag is sent back. Time grows with the page alone: every < is looked at once, and
    only BROKEN tags may look for an end that isn't there.
    """
    at, text, last, broken = 0, 0, page.rfind(">"), 0
    while True:
        at = page.find("<", at)
        if at < 0 or at > last or broken >= BROKEN:
            break
        m = _TOKEN.match(page, at)
        if not m:
            at += 1
            continue
        if m[2] is None:
            yield page[text:at], "text" if m[0].startswith("<![CDATA[") else "", "", m[0][9:].removesuffix("]]>"), m.end()
            at = text = m.end()
            continue
        end = _tag_end(page, m.end())
        if end < 0:
            broken += 1
            at += 1
            continue
        at = text = yield page[text:at], "tag", m[1], page[m.start(2) : end - 1], end
    # What begins after the last > and has no end: a comment swallows the rest, a section of text is text.
    if m := _SWALLOWS.search(page, text):
        yield page[text : m.start()], "text" if m[0] != "<!--" else "", "", page[m.end() :], len(page)
    else:
        yield page[text:], "", "", "", len(page)


def _is_noise(names: str, inside: bool) -> bool:
    """Whether class names and id tell of noise; ``inside`` an article weak words count only alone."""
    for m in _NOISE.finditer(_LAYOUT.sub("", names)):
        word = m[0].strip(" \t\r\n\f_-")
        if not inside or not _WEAK.fullmatch(word) or word in names.split():
            return True
    return False


def _marks(tag: str, attributes: str, inside: bool = False) -> tuple[bool, bool]:
    """(noise, content): what an opening tag, ``inside`` an article or not, says about the text inside."""
    if tag in _DROPPED:
        return True, False
    said = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    role = said.get("role", "").lower()
    if role in _ROLES or said.get("aria-hidden", "").lower() == "true" or "hidden" in said or re.search(r"display\s*:\s*none", said.get("style", ""), re.I):
        return True, False
    if tag in ("article", "main") or role in ("main", "article"):
        return bool(re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", said.get("class", "") + " " + said.get("id", ""), re.I)), True
    names = f"{said.get('class', '')} {said.get('id', '')}"
    if tag not in ("html", "body") and names.strip() and _is_noise(names, inside):
        return True, False
    return False, bool(names.strip() and tag in ("div", "section", "td") and _CONTENT.search(names))


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters in links, inside noise, inside the article) of every line with text, in page order."""
    found: list[tuple[str, int, bool, bool]] = []
    open_tags: list[tuple[str, int, int]] = []  # tag, noise, content
    noise = content = links = 0
    parts: list[str] = []
    linked = 0
    state = (False, False)

    blank = True

    def flush() -> None:
        nonlocal linked, blank
        text = _BLANK.sub(" ", entities.unescape("".join(parts))).strip()
        if text:
            found.append((text, min(linked, len(text)), *state))
        parts.clear()
        linked, blank = 0, True

    opened: Counter[str] = Counter()
    n, tokens, after = len(page), _tokens(page), None
    while True:
        try:
            piece, what, slash, body, at = tokens.send(after)
        except StopIteration:
            break
        after = None
        if piece:
            if blank and piece.strip():
                state, blank = (noise > 0, content > 0), False
            parts.append(piece)
            if links:
                linked += len(piece.strip())
        if what == "text":
            parts.append(body)
        if what != "tag":
            continue
        after = at
        name = _NAME.match(body)[0]
        tag, closing, attributes = name.lower(), slash == "/", body[len(name) :]
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _RAW and not closing:
            if tag == "title":
                flush()
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(page, at)
                after = end.end() if end else n
            continue
        if tag in _BREAKING:
            flush()
        if tag in _VOID or attributes.rstrip().endswith("/") and not closing:
            continue
        if not closing:
            if tag == "header" and not content:
                is_noise, is_content = True, False
            elif tag == "body":
                # whatever is left open in the head ends here
                open_tags, noise, content, links = [], 0, 0, 0
                opened.clear()
                is_noise, is_content = False, False
            else:
                is_noise, is_content = _marks(tag, attributes, content > 0)
            if is_noise or is_content or tag in ("a", "div", "section", "article", "main", "td", "header", "ul", "ol", "table", "span", *_DROPPED):
                if is_noise:
                    flush()
                open_tags.append((tag, int(is_noise), int(is_content)))
                opened[tag] += 1
                noise += is_noise
                content += is_content
                links += tag == "a"
        elif opened[tag]:
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == tag:
                    if any(x[1] for x in open_tags[k:]):
                        flush()
                    for t, a, b in open_tags[k:]:
                        noise -= a
                        content -= b
                        links -= t == "a"
                        opened[t] -= 1
                    del open_tags[k:]
                    break
    flush()
    return found


def kept_lines(lengths: list[int], threshold: int, width: int = LINES) -> list[bool]:
    """Which lines lie between a surge and the dive after it; lengths: of each line, 0 for lines that don't count."""
    n = len(lengths)
    total, sums = sum(lengths[:width]), []
    for i in range(n):  # the window that starts at line i
        sums.append(total)
        total += (lengths[i + width] if i + width < n else 0) - lengths[i]
    keep, i = [False] * n, 0
    while i < n:
        if sums[i] == 0:
            i += 1
            continue
        end = i
        while end < n and sums[end] > 0:
            end += 1
        # A run of windows with text: it counts if it surges to the threshold somewhere.
        if max(sums[i:end]) >= threshold:
            for k in range(i, end):
                keep[k] = lengths[k] > 0
        i = end
    return keep


def runs(marks: list[bool], width: int = LINES) -> list[bool]:
    """The marks that lie in a window of ``width`` marked lines."""
    out, i = [False] * len(marks), 0
    for mark, group in groupby(marks):
        n = len(list(group))
        out[i : i + n] = [mark and n >= width] * n
        i += n
    return out


def main_text(page: str | None) -> str:
    """The page's article: its blocks, joined by blank lines."""
    lines = lines_of(page or "")
    inside = any(x[3] and not x[2] for x in lines)
    if inside:
        counted = [(t, a >= LINKED * len(t)) for t, a, z, c in lines if c and not z]
        linked = iter(runs([x for _, x in counted]))
        lengths = [len(t) if c and not z and not next(linked) else 0 for t, _, z, c in lines]
        if not any(lengths):  # an article of links only
            lengths = [len(t) if c and not z else 0 for t, _, z, c in lines]
        keep = kept_lines(lengths, 1)
    else:
        lengths = [0 if z or a >= LINKED * len(t) else len(t) for t, a, z, _ in lines]
        keep = kept_lines(lengths, SURGE)
        if not any(keep):
            keep = [x > 0 for x in lengths]
    return "\n\n".join(t for (t, *_), k in zip(lines, keep, strict=True) if k)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(keep..., text, n_chars) of every row."""
    rows = pages.select(*keep, html)
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keep))]
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=[*keep, "text", "n_chars"],
            )

    return map_in_arrow(rows, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

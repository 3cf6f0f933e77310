"""Main text of web pages: the contiguous region with the largest score.

A page is a sequence of words and tags.  Words score positive, start tags negative; the
weights come from labelled pages, which are pages whose own markup names the main
part (one article or main element).  One linear scan finds the region with the
largest sum.  Where a page has a main part, words outside it score negative and tags inside
it next to nothing.  Elsewhere a block's tag costs a word at most and an inline tag a quarter, so
that no tag outweighs the text that it holds.  Words in menus, forms and the like, and in
blocks with a name as of notices or adverts, lose their positive score and so bound the
region.  Names are a guess: words of a named block inside the region stay, and a block that
holds most of the text is not taken for one.  Menus and forms inside the region are left out.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video".split())
ASIDE = frozenset("nav header footer aside form button select option label fieldset dialog menu head".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
MAIN = frozenset("article main".split())
#: Words of which a class, id or role consists that marks a block as probably no part of the text.
MARKED = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent notice alert popup modal newsletter subscribe "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer header masthead toolbar widget share sharing social related "
    "recommended comment comments disqus replies reply respond discussion login signup search form pagination pager complementary contentinfo".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+)", re.S
)
#: For tags whose quotes are not closed.
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>()?")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMED = frozenset("class id role".split())
#: Elements that hold the text, whatever their names.
HOLDS = MAIN | {"html", "body"}
SPLIT = re.compile(r"[^a-z0-9]+")


def has_marked_name(attributes: str) -> bool:
    """Whether a whole class, id or role, as ``cookie-notice``, consists of marked words."""
    values = [m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes) if m[1].lower() in NAMED]
    parts = ([w for w in SPLIT.split(name) if w] for v in values for name in v.lower().split())
    return any(p and MARKED.issuperset(p) for p in parts)


def tokens(page: str) -> Iterator[tuple[str, str, bool, bool, bool]]:
    """(kind, value, inside a main element, inside a marked block, inside an aside element); kind is tag, end or text.

    A named block that holds more than half of the words (of those in main elements, if any), menus
    and the like apart, is not marked by its name.
    """
    parents = [0]
    parts = list(_scan(page, parents))
    marked = [False] * len(parents)
    if len(parents) > 1:
        words, inner = [0] * len(parents), [0] * len(parents)
        for kind, value, main, aside, block in parts:
            if kind == "text" and not aside:
                n = len(value.split())
                words[block] += n
                inner[block] += n if main else 0
        for k in range(len(parents) - 1, 0, -1):
            words[parents[k]] += words[k]
            inner[parents[k]] += inner[k]
        held = inner if inner[0] else words
        for k in range(1, len(parents)):
            marked[k] = marked[parents[k]] or 2 * held[k] <= held[0]
    for kind, value, main, aside, block in parts:
        yield kind, value, main, aside or marked[block], aside


def _scan(page: str, parents: list[int]) -> Iterator[tuple[str, str, bool, bool, int]]:
    """(kind, value, inside a main element, inside an aside element, innermost named block); ``parents`` gets each named block's outer one."""
    stack: list[tuple[str, bool, bool, int]] = []
    names: Counter = Counter()  # of the stack: an end tag that ends nothing is not searched for
    at, main, aside, block = 0, False, False, 0
    while at < len(page):
        found = TOKEN.match(page, at) or LOOSE.match(page, at)
        if not found:
            if re.match(r"</?[a-zA-Z]", page[at : at + 3]):  # a tag that never ends
                return
            yield "text", "<", main, aside, block
            at += 1
            continue
        at = found.end()
        closing, name, rest, text = found.groups()
        if text is not None:
            yield "text", text, main, aside, block
            continue
        if name is None:
            continue
        name = name.lower()
        if closing:
            ended = None
            while names[name] and ended != name:
                ended, main, aside, block = stack.pop()
                names[ended] -= 1
            yield "end", name, main, aside, block
            continue
        if name in RAW:
            if not rest.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = close.end() if close else len(page)
            yield "tag", name, main, aside, block
            continue
        if name == "p" or name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            for k in range(len(stack) - 1, -1, -1):  # these end without an end tag
                if stack[k][0] == name:
                    _, main, aside, block = stack[k]
                    names.subtract(s[0] for s in stack[k:])
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK:
                    break
        yield "tag", name, main, aside, block
        if name in VOID:
            continue
        stack.append((name, main, aside, block))
        names[name] += 1
        main = main or name in MAIN
        aside = aside or (name in ASIDE and not (name == "header" and main))
        if "=" in rest and name not in HOLDS and has_marked_name(rest):
            parents.append(block)
            block = len(parents) - 1


def features(page: str) -> Iterator[tuple[str, int, bool]]:
    """(feature, how often, inside the main element): words, words in marked blocks, and start tags by name."""
    for kind, value, main, marked, _ in tokens(page):
        if kind == "text":
            n = len(entities.unescape(value).split())
            if n:
                yield ("marked word" if marked else "word"), n, main
        elif kind == "tag":
            yield f"<{value}>" if value in BLOCK or value in VOID or value in RAW or value in ("a", "b", "i", "em", "strong", "span") else "<other>", 1, main


def count_features(pages: DataFrame) -> DataFrame:
    """feature, inside, n over all labelled pages; as many rows as there are feature names at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch["html"].to_pylist():
                if page and len(re.findall(r"<(?:article|main)[\s>]", page, re.I)) == 1:
                    for name, n, main in features(page):
                        seen[name, main] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.bool_()), pa.array(list(seen.values()), pa.int64())], names=["feature", "inside", "n"]
        )

    return pages.select("html").mapInArrow(count, "feature string, inside boolean, n long").groupBy("feature", "inside").agg(F.sum("n").alias("n"))


def learn_weights(pages: DataFrame, least: float = 0.02, block: float = 1.0, inline: float = 0.25) -> dict[str, float]:
    """Weight of each feature name: smoothed log odds of main part against the rest, bounded.

    Word weights are made positive and tag weights negative, as the scan assumes.  A tag costs
    ``least`` words at least, and ``block`` or ``inline`` words at most; one that was not
    seen costs half a block's most, or the least.  Without labelled pages a word has weight 1.
    """
    counts: dict[str, list[int]] = {}
    for row in count_features(pages).collect():  # bounded by the feature names above
        counts.setdefault(row["feature"], [0, 0])[row["inside"]] = row["n"]
    totals = [sum(c[k] for c in counts.values()) for k in (0, 1)]
    odds = {f: math.log((i + 0.5) / (totals[1] + 1)) - math.log((o + 0.5) / (totals[0] + 1)) for f, (o, i) in counts.items()} if totals[1] else {}
    word = min(3.0, max(0.5, odds.get("word", 1.0)))
    out = {f: word * max(-(block if f[1:-1] in BLOCK else inline), min(-least, x)) for f, x in odds.items() if "word" not in f}
    return out | {"word": word, "marked word": max(-word, min(-0.5, odds.get("marked word", -word))), "outside word": -word, "inside tag": -least * word, "<block>": -0.5 * block * word, "": -least * word}


def gains(parts: list[tuple[str, str, bool, bool, bool]], weights: dict[str, float]) -> list[float]:
    """What every token adds to a region's score."""
    held = any(main and kind == "text" and not marked and value.strip() for kind, value, main, marked, _ in parts)
    out = []
    for kind, value, main, marked, _ in parts:
        if kind == "text":
            name = "marked word" if marked else "outside word" if held and not main else "word"
            out.append(len(value.split()) * weights.get(name, weights["word"]))
        elif kind == "end":
            out.append(0.0)
        elif held and main:
            out.append(weights.get("inside tag", weights[""]))
        else:
            out.append(weights.get(f"<{value}>", weights.get("<block>" if value in BLOCK else "", weights[""])))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous region with the largest sum, (0, 0) if none is above 0; one linear scan.

    Of equal sums the one that ends first wins; it has no beginning whose sum is 0 or less.
    """
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for k, gain in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += gain
        if total > best:
            best, at = total, (start, k + 1)
    return at


def extract(page: str | None, weights: dict[str, float]) -> str:
    """Blocks of the best region, joined by two line feeds; empty where nothing scores above 0.

    Pages of any length are scanned whole, in time and memory in proportion to their tokens.
    """
    told = list(tokens(page or ""))
    start, end = best_region(gains(told, weights))
    parts = [(kind, value, aside) for kind, value, _, _, aside in told]
    blocks: list[str] = []
    held: list[str] = []
    for kind, value, aside in parts[start:end]:
        if kind == "text":
            if not aside:
                held.append(value)
        elif value in BLOCK or value in RAW:
            blocks.append("".join(held))
            held = []
        elif value == "br":
            held.append(" ")
    blocks.append("".join(held))
    clean = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


def extract_pages(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Null or empty html gives empty text, as does a page where nothing scores above 0.
    Repeated rows give repeated rows; null ids and urls stay null.  Other columns,
    whatever their names, are not read.  An empty table gives an empty result.
    """
    weights = learn_weights(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [extract(h, weights) for h in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    fields = pages.select("page_id", "url", "html")
    kinds = dict(fields.dtypes)
    return fields.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")

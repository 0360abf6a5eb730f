"""Main text of web pages by paths that a host's pages agree on.

Each page is parsed into blocks of text, each with the path of the containers
around it: tag and class names, without digits. A page scores its containers
by the text in their own blocks, less what stands in links. Scores are summed
per host and path in Spark. The pages that have a path are its template's, and
they alone vote on it: a host keeps, best first, the paths that have on average
at least a tenth of the score of the pages they are on, so a host may have many
templates. Paths on less than a thousandth of a host's pages are left to those
pages, so a host keeps ten thousand paths at most. Each page is then extracted
again: all containers on the first of its host's paths that it has, or, where
it has none, its own best one, and with them what else the article around them
holds beside lists of links: headline, lead, other sections. Containers whose
class, id or role says that they are not the article (``sidebar``,
``comment-list``), and forms, get a quarter of the score, and are left out where
they stand beside or inside the one that was voted for; a form around the
article stays. The header of an article is part of it, other headers are not.
What is not shown, by ``hidden`` or ``display: none``, is left out; what is only
hidden from screen readers (``aria-hidden``) is shown and stays. Containers more
than ``DEEPEST`` deep count as part of the one around them.

Cases: a null or empty page, or one without text, gives the empty string; a
page without a host goes by itself; ties go to the path first in order;
unclosed and stray tags are repaired; pages are taken whole; repeated rows are
each counted and returned; other columns are carried along.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.joining import join_back
from ..plans.session import written
from .tables import small_batches

# Usual tags in one step; a longer one, or one that is not closed, comes as "<" and is read part by part, see ``_Tags``.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[\s/]++|[^\s/<>="']++(?:\s*+=\s*+(?:"[^"]{0,300}+"|'[^']{0,300}+'|[^\s<>"'][^\s<>]{0,300}+(?=[\s>])))?+){0,40}+)>|<[!?][^<>]*+>|[^<]++|<""", re.S)
OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)")
GAP = re.compile(r"[\s/]*+")
NAME = re.compile(r"[^\s/<>][^\s/<>=]*+(\s*+=\s*+)?+")
BARE = re.compile(r"[^\s>]*+")
ATTRIBUTE = re.compile(r"""([^\s/<>][^\s/<>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""")
SPACE = re.compile(r"\s+")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in "script style textarea title noscript iframe svg template".split()}
SKIP = set("nav header footer aside button label legend select option menu canvas audio video head".split()) | set(RAW)
BLOCK = set("address article blockquote body caption center dd details dialog div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 html hgroup li main ol p pre section summary table tbody td tfoot th thead tr form ul".split()) | SKIP
CONTAINER = set("article body center dialog div form main section table tbody td tr html".split())
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!\s*important\s*)?(?:;|$)", re.I)
STOP_AT = set("article body div html main ol section table td ul".split())
# Whole class tokens, ids and roles of containers and lists that speak against the article, alone or with words for their form.
ASIDE = re.compile(r"(?:(?:{0})[-_]+)*(?:{1})(?:[-_]+(?:{0}|{1}))*".format(
    "area|bar|block|box|buttons?|container|items?|links?|list|section|wrap|wrapper",
    r"ads?|advert\w*?|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pager|pagination|popup|promo|promos|promotions?|related|respond|share|sharing|sidebar|social|sponsors?|sponsored|subscribe|toolbar|widget"), re.I)
ASIDE_TAGS = CONTAINER | set("ul ol dl details figure".split())
MARK = " !"  # before the name of such a container in a path; no class has a space
ASIDE_WORTH = 0.25  # of the score of what stands in it
CLOSERS = set().union(*CLOSED_BY.values())
DEEPEST = 64  # containers further in count as part of the one around them
PAGE_SHARE = 0.1  # of the score of the pages that have a path, from which it is kept
RARE = 1000  # a path on fewer than one in so many of a host's pages has no vote


class _Tags:
    """Ends of the tags of a page, with values of any length, in time linear in the page.

    A quote that no other follows is part of a bare value. Places from which a
    tag was found not to end are kept, so that no later tag is read on from there.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'"}
        self.dead: set[int] = set()
        self.run = (0, 0)  # the bare value read last

    def end(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``; -1 if another tag or the page's end comes first."""
        page, seen = self.page, []
        while True:
            at = GAP.match(page, at).end()
            if at in self.dead:
                break
            seen.append(at)
            name = NAME.match(page, at)
            if not name:
                if page[at : at + 1] == ">":
                    return at + 1
                break
            at = name.end()
            if not name.group(1):
                continue
            if at < self.last.get(page[at : at + 1], -1):
                at = page.index(page[at], at + 1) + 1
            else:
                if not self.run[0] <= at < self.run[1]:
                    self.run = (at, BARE.match(page, at).end())
                at = self.run[1]
        self.dead.update(seen)
        return -1


def attributes(given: str) -> dict[str, str]:
    """Attributes by lower-case name; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(given):
        out.setdefault(name.lower(), value[1:-1] if len(value) > 1 and value[0] in "\"'" and value[-1] == value[0] else value)
    return out


def self_closed(given: str) -> bool:
    """Whether the slash at the end stands for itself, not at the end of a bare value."""
    end = 0
    for m in ATTRIBUTE.finditer(given):
        end = m.end()
    return end < len(given)


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(paths of the containers around it, outermost first; text; characters in links) of every block outside menus and the like."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, bool, str | None]] = []  # tag, skipped, path if a container
    open_tags: Counter[str] = Counter()
    text: list[str] = []
    linked = [0]
    skipped = links = 0
    paths: tuple[str, ...] = ()

    def flush() -> None:
        if text:
            line = SPACE.sub(" ", html.unescape("".join(text))).strip()
            if line:
                out.append((paths, line, linked[0]))
            text.clear()
            linked[0] = 0

    def pop() -> None:
        nonlocal skipped, links, paths
        tag, hidden, path = stack.pop()
        if tag in BLOCK:
            flush()
        open_tags[tag] -= 1
        skipped -= hidden
        links -= tag == "a"
        if path is not None:
            paths = paths[:-1]

    at = 0
    tags: _Tags | None = None
    while m := TOKEN.match(page, at):
        at = m.end()
        closing, tag, given_as = m.groups()
        piece = m.group()
        if piece == "<" and (start := OPEN.match(page, m.start())):
            tags = tags or _Tags(page)
            end = tags.end(start.end())
            if end > 0:
                (closing, tag), given_as, at = start.groups(), page[start.end() : end - 1], end
        if tag is None:
            if not skipped and (piece[0] != "<" or piece == "<"):
                text.append(piece)
                linked[0] += len(piece) if links else 0
            continue
        tag = tag.lower()
        if closing:
            if open_tags[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag in BLOCK:
                flush()
            continue
        for i in range(len(stack) - 1, -1, -1) if tag in CLOSERS and any(open_tags[t] for t in CLOSED_BY) else ():
            if tag in CLOSED_BY.get(stack[i][0], ()):
                while len(stack) > i:
                    pop()
                break
            if stack[i][0] in STOP_AT:
                break
        if tag in BLOCK:
            flush()
        if tag in VOID or (given_as.endswith("/") and (tag == "svg" or tag not in BLOCK) and self_closed(given_as)):
            if not skipped:
                text.append(" ")
            continue
        if tag in RAW:
            end = RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        given = attributes(given_as) if given_as else {}
        named = f"{given.get('class', '')} {given.get('id', '')} {given.get('role', '')}"
        hidden = (tag in SKIP and not (tag == "header" and open_tags["article"])) or "hidden" in given or UNSEEN.search(given.get("style", "")) is not None
        marked = tag == "form" or tag in ASIDE_TAGS and tag not in ("html", "body", "article", "main") and any(ASIDE.fullmatch(c.strip("-_")) for c in re.sub(r"\d+", "", named).split())
        path = None
        if (tag in CONTAINER or marked) and len(paths) < DEEPEST:
            name = ".".join([tag, *sorted({re.sub(r"\d+", "", c) for c in given.get("class", "").lower().split()} - {""})])
            name = MARK * marked + name
            path = f"{paths[-1]}>{name}" if paths else name
            paths = (*paths, path)
        stack.append((tag, hidden, path))
        open_tags[tag] += 1
        skipped += hidden
        links += tag == "a"
    while stack:
        pop()
    flush()
    return out


def page_scores(found: list[tuple[tuple[str, ...], str, int]]) -> dict[str, float]:
    """Share of the page's text that speaks for each container: all of its own blocks', half for the one around it."""
    scores: dict[str, float] = {}
    for paths, text, linked in found:
        worth = max(0, len(text) - 2 * linked) * (ASIDE_WORTH if paths and MARK in paths[-1] else 1)
        for path, part in zip(paths[::-1], (1.0, 0.5)):
            scores[path] = scores.get(path, 0.0) + part * worth
    whole = sum(scores.values()) or 1.0
    return {p: s / whole for p, s in scores.items()}


def _tag(path: str, around: str | None) -> str:
    return (path[len(around) + 1 :] if around else path).removeprefix(MARK).split(".")[0]


def chosen(found: list[tuple[tuple[str, ...], str, int]], ranked: list[str]) -> str:
    """The article around the first of the ranked paths that the page has, else around its own best; all where there is no container.

    The article is the ``main`` or else the innermost ``article`` around that
    path. Without these it is what stands in the body: the part with the path,
    blocks directly in the body, and parts with another of the ranked paths.
    Beside the path, what is mainly links or stands in a marked container is
    left out, and so is a marked container further in.
    """
    have = {p for paths, _, _ in found for p in paths}
    best = next((p for p in ranked if p in have), None)
    if best is None and have:
        scores = page_scores(found)
        ranked = sorted((p for p in have if scores.get(p, 0.0) >= PAGE_SHARE), key=lambda p: (-scores[p], p))
        best = min(have, key=lambda p: (-scores.get(p, 0.0), p))
    if best is None:
        return "\n".join(text for _, text, _ in found)
    line = next(paths[: paths.index(best) + 1] for paths, _, _ in found if best in paths)
    tags = [_tag(p, a) for p, a in zip(line, (None, *line))]
    top = tags.index("main") if "main" in tags else max((i for i, t in enumerate(tags) if t == "article"), default=None)
    page_tags = next((i for i, t in enumerate(tags) if t not in ("html", "body")), len(tags) - 1)  # how many stand for the whole page
    winners = set(ranked)
    parts: list[tuple[object, str, int]] = []
    sums: dict[object, list[int]] = {}
    for no, (paths, text, linked) in enumerate(found):
        if best in paths:
            if MARK not in paths[-1][len(best) :]:
                parts.append((None, text, linked))
            continue
        shared = next((i for i, (p, q) in enumerate(zip(paths, line)) if p != q), min(len(paths), len(line)))
        if top is not None and shared <= top:
            continue
        beside = paths[shared:]
        if beside and (MARK in paths[-1][len(paths[shared - 1]) if shared else 0 :] or (shared <= page_tags and winners.isdisjoint(beside))):
            continue
        part = beside[0] if beside else no
        parts.append((part, text, linked))
        total = sums.setdefault(part, [0, 0])
        total[0] += len(text)
        total[1] += linked
    return "\n".join(text for part, text, _ in parts if part is None or 2 * sums[part][1] <= sums[part][0])


def host_of(url: Column) -> Column:
    """Lower-case host name without ``www.`` and port; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", F.regexp_replace(host, r"^www\.", ""))


def host_paths(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``host, host_pages, ranked``: the paths that a host's pages vote for, best first."""

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(h, p, s) for h, text in zip(batch["host"], batch["page"]) for p, s in page_scores(blocks(text)).items()]
            yield pd.DataFrame(out, columns=["host", "path", "score"])

    some = small_batches(pages).select(host_of(F.col(url)).alias("host"), F.col(page).alias("page")).where("host IS NOT NULL AND page IS NOT NULL")
    voted = some.mapInPandas(votes, "host string, path string, score double")
    # Whole millionths, so that sums are the same in any order.
    each = voted.groupBy("host", "path").agg(F.sum(F.round(F.col("score") * 1_000_000).cast("long")).alias("score"), F.count(F.lit(1)).alias("pages"))
    each = written(each, "votes")
    sums = each.groupBy("host").agg(F.max("pages").alias("host_pages"))
    shared = (F.col("score") >= PAGE_SHARE * 1_000_000 * F.col("pages")) & (F.col("pages") * RARE >= F.col("host_pages"))
    kept = each.join(sums, "host").where(shared)
    # The average over the pages that have the path, and one more without a score: few pages alone speak less.
    kept = kept.withColumn("score", F.col("score") / (F.col("pages") + 1)).drop("pages")
    place = F.row_number().over(W.partitionBy("host").orderBy(F.desc("score"), "path"))
    ranked = kept.withColumn("place", place).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "path"))).alias("r"), F.max("host_pages").alias("host_pages"))
    return ranked.select("host", "host_pages", F.transform("r", lambda x: x["path"]).alias("ranked"))


def main_text(pages: DataFrame, url: str = "url", page: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The rows of ``pages`` as ``row`` with the ``text`` of the article."""
    carried = pages.columns if keep is None else keep
    rows = small_batches(pages).select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), host_of(F.col(url)).alias("host"), F.col(page).alias("page"))
    known = join_back(rows, host_paths(pages, url, page), ["host"], "host_pages")

    def over(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, ranked in batches:
            yield pd.Series([chosen(blocks(t or ""), [] if r is None else list(r)) for t, r in zip(texts, ranked)], dtype=object)

    over.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return known.select("row", F.pandas_udf(over, "string")("page", "ranked").alias("text"))

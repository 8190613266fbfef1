"""Main text of web pages by the maximum-scoring run of words and tags.

A page is a row of tokens: runs of words and tags. A token's feature is its tag,
or for words the element they stand in. Its weight is how much likelier
than not the feature stands inside the main text, learned from labelled pages:
those with exactly one ``article`` (or else one ``main``) element, whose inside is
the label. Rare features lean on the prior: words count for the text, tags against
it. One linear scan finds the run of tokens with the greatest sum. Elements that are
boilerplate by name or exact role, hidden, or by a class or id that says so outright
(advert, comments, share and so on: an advert inside an article is still an advert)
weigh nothing and are left out of the text. A class or id that may also name a part of
an article (alert, widget and so on) is a feature: its weight is how often the words
under it stand inside the main text of labelled pages, and the element is left out only
if that weight is negative. Names that merely contain such a word say nothing.

Counting and extraction are one pass each over the pages, with no shuffle but the
sum of the counts per feature; there are at most a few hundred features, since
tags outside HTML share one.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Pseudo-counts of the prior and its chance of standing in the text, for words and tags.
PRIOR_COUNT = 20.0
PRIOR_WORDS, PRIOR_TAGS = 0.75, 0.35

# Element names of HTML.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big button canvas cite code data del dfn em font i iframe ins kbd label map mark meter "
    "object output picture progress q rp rt ruby s samp small span strike strong sub sup svg math time tt u var video".split()
)
_NEVER = frozenset("head script style noscript template textarea title svg math iframe object canvas select button datalist".split())
_RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe")
_BOILERPLATE = frozenset("nav aside footer form menu dialog search fieldset".split())
_KNOWN = _BLOCKS | _VOID | _INLINE | _NEVER
# What ends an open paragraph or item, as browsers do it.
_ENDS_P = _BLOCKS - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend"}
_SAME = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "p": {"p"},
}
_SCOPE = frozenset("article section div main nav aside footer header form table td th ul ol dl blockquote body html".split())

# Words of class names and ids that speak against the main text, and those that may name a part of it.
_FOREIGN = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pagination paywall popup "
    "promo promoted recommended related replies share sharing sidebar signup social sponsor sponsored subscribe".split()
)
_UNSURE = frozenset("alert banner disclaimer overlay respond toolbar widget".split())
# What may stand beside a cue in one name: ``ad-box-1`` is a cue, ``related-work`` and ``notice-board`` are not.
_FILLERS = frozenset("area bar block bottom box buttons container form header left link links list page panel right section site top wrapper".split())
PRIOR_UNSURE = 0.6

_ROLES = frozenset("navigation banner complementary contentinfo search form alert dialog menu menubar alertdialog".split())
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+|[^>]*)(?:>|\Z)", re.S
)
_CAMEL = re.compile(r"([a-z])([A-Z])")


def _marked(attributes: str) -> tuple[bool, str | None]:
    """(whether role, hiding, class or id make an element boilerplate, the first unsure cue of class and id)."""
    cue = None
    if not attributes or attributes.isspace():
        return False, cue
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "role" and value.lower() in _ROLES:
            return True, cue
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True, cue
        if name in ("class", "id"):
            for found in filter(None, map(_cue, html.unescape(value).split())):
                if found in _FOREIGN:
                    return True, None
                cue = cue or found
    return False, cue


def _cue(name: str) -> str | None:
    """The cue that a class name or id is, with nothing but fillers and numbers beside it."""
    parts = [p for p in re.split(r"[_-]+", _CAMEL.sub(r"\1-\2", name).lower()) if p and not p.isdigit()]
    cues = [p for p in parts if p in _FOREIGN or p in _UNSURE]
    if not cues or any(p not in _FILLERS and p not in cues for p in parts):
        return None
    return next((c for c in cues if c in _FOREIGN), cues[0])


class Page:
    """Tokens of a page: feature, words, whether in boilerplate, cues above it, text, and where blocks end."""

    def __init__(self, source: str):
        self.features: list[str] = []
        self.sizes: list[int] = []
        self.texts: list[str | None] = []
        self.left_out: list[bool] = []
        self.cues: list[tuple[str, ...]] = []
        self.breaks: list[bool] = []
        self.spans: dict[str, list[list[int]]] = {"article": [], "main": []}
        self.stack: list[tuple[str, bool, bool, str | None]] = []
        self.open_cues: tuple[str, ...] = ()
        self.out_depth = self.never_depth = 0
        at = 0
        while at < len(source):
            match = _TOKEN.search(source, at)
            self._words(source[at : match.start() if match else len(source)])
            if not match:
                break
            at = match.end()
            name = match.group(2)
            if name is None:
                continue
            name = name.lower()
            if match.group(1):
                self._close(name)
            else:
                self._open(name, match.group(3))
                if name in _RAW:
                    end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                    if name == "textarea" or name in _NEVER:
                        at = end.start() if end else len(source)
        for spans in self.spans.values():
            for span in spans:
                if span[1] < 0:
                    span[1] = len(self.features)

    def _token(self, feature: str, size: int, text: str | None, breaks: bool, leads_out: bool = False, cue: str | None = None) -> None:
        self.features.append(feature)
        self.sizes.append(size)
        self.texts.append(text)
        self.left_out.append(self.out_depth > 0 or leads_out)
        self.cues.append(self.open_cues if cue is None else self._with(cue))
        self.breaks.append(breaks)

    def _with(self, cue: str) -> tuple[str, ...]:
        """Distinct cues open here and one more, as features; there are no more than the vocabulary holds."""
        feature = f"c {cue}"
        return self.open_cues if feature in self.open_cues else (*self.open_cues, feature)

    def _words(self, run: str) -> None:
        if not run or self.never_depth:
            return
        text = html.unescape(run) if "&" in run else run
        size = len(text.split())
        if size:
            inner = next((entry[0] for entry in reversed(self.stack)), "none")
            self._token(f"w {inner if inner in _KNOWN else 'other'}", size, text, False)
        elif text:
            self._token("space", 0, " ", False)

    def _pop(self) -> None:
        name, out, never, outer = self.stack.pop()
        if outer is not None:
            self.open_cues = outer
        self.out_depth -= out
        self.never_depth -= never
        if name in self.spans and not self.never_depth:
            for span in reversed(self.spans[name]):
                if span[1] < 0:
                    span[1] = len(self.features)
                    break

    def _open(self, name: str, attributes: str) -> None:
        if name in _ENDS_P or name in _SAME:
            while self.stack and (
                self.stack[-1][0] in _SAME.get(name, ()) or (name in _ENDS_P and self.stack[-1][0] == "p")
                or (name in _ENDS_P and self.stack[-1][0] in _INLINE and any(entry[0] == "p" for entry in self._near()))
            ):
                self._pop()
        marked, cue = _marked(attributes)
        whole = name in ("html", "body", "article", "main")
        cue = None if whole else cue
        page_header = name == "header" and not any(entry[0] in ("article", "main") for entry in self.stack)
        out = marked and not whole or name in _BOILERPLATE or page_header
        never = name in _NEVER
        if not (self.never_depth or never):
            self._token(f"< {name if name in _KNOWN else 'other'}", 1, " " if name == "br" else None, name in _BLOCKS, out, cue)
        if name in self.spans and not self.never_depth and not self.out_depth and not self.open_cues:
            self.spans[name].append([len(self.features), -1])
        if name not in _VOID and not attributes.rstrip().endswith("/") or name in _BLOCKS - _VOID:
            self.stack.append((name, out, never, self.open_cues if cue else None))
            if cue:
                self.open_cues = self._with(cue)
            self.out_depth += out
            self.never_depth += never

    def _near(self) -> list[tuple[str, bool, bool, tuple[str, ...] | None]]:
        """Open elements from the innermost out to the first that bounds a paragraph."""
        out = []
        for entry in reversed(self.stack):
            if entry[0] in _SCOPE:
                break
            out.append(entry)
        return out

    def _close(self, name: str) -> None:
        depth = len(self.stack)
        for i in range(depth - 1, -1, -1):
            if self.stack[i][0] == name:
                while len(self.stack) > i:
                    self._pop()
                break
            if name not in _SCOPE and self.stack[i][0] in _SCOPE:
                break  # a stray end tag does not reach beyond its container
        if not self.never_depth and name not in _NEVER:
            self._token(f"> {name if name in _KNOWN else 'other'}", 1, None, name in _BLOCKS)

    def label(self) -> tuple[int, int] | None:
        """Token range of the one article (or else main) element, if the page has one."""
        for name in ("article", "main"):
            if len(self.spans[name]) == 1:
                low, high = self.spans[name][0]
                return (low, high) if high > low else None
        return None

    def skipped(self, weights: dict[str, float]) -> list[bool]:
        """Whether each token stands in boilerplate or under a cue of negative weight."""
        against = {c: any(weight_of(f, weights) < 0 for f in c) for c in set(self.cues)}
        return [out or against[c] for out, c in zip(self.left_out, self.cues)]

    def region(self, weights: dict[str, float]) -> tuple[int, int]:
        """The first shortest run of tokens with the greatest positive sum; empty if none is positive."""
        best, best_span, total, start = 0.0, (0, 0), 0.0, 0
        skipped = self.skipped(weights)
        for i, (feature, size) in enumerate(zip(self.features, self.sizes)):
            if skipped[i]:
                continue
            if total <= 0:
                total, start = 0.0, i
            total += size * weight_of(feature, weights)
            if total > best + 1e-9:
                best, best_span = total, (start, i + 1)
        return best_span

    def text(self, low: int, high: int, weights: dict[str, float] | None = None) -> str:
        """Blocks of the run, white space collapsed, joined by newlines."""
        skipped = self.skipped(weights or {})
        blocks: list[str] = []
        held: list[str] = []
        for i in range(low, high):
            if self.breaks[i]:
                blocks.append("".join(held))
                held = []
            if self.texts[i] is not None and not skipped[i]:
                held.append(self.texts[i])
        blocks.append("".join(held))
        clean = (" ".join(b.split()) for b in blocks)
        return "\n".join(b for b in clean if b)


def _prior(feature: str) -> float:
    if feature[0] == "c":
        return PRIOR_UNSURE
    return PRIOR_WORDS if feature[0] == "w" else PRIOR_TAGS


def weight_of(feature: str, weights: dict[str, float]) -> float:
    if feature == "space":
        return 0.0
    found = weights.get(feature)
    if found is not None:
        return found
    return _prior(feature) - 0.5


def learned(pages: DataFrame, source: str = "html") -> dict[str, float]:
    """Weight of every feature seen on labelled pages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, everywhere = Counter(), Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if not value:
                    continue
                page = Page(value)
                label = page.label()
                if label is None:
                    continue
                for i, (feature, size) in enumerate(zip(page.features, page.sizes)):
                    if page.left_out[i]:
                        continue
                    # Under cues the words speak for the cues, not for the elements they stand in.
                    for f in page.cues[i] or (feature,):
                        if f[0] != "c" or feature[0] == "w":
                            everywhere[f] += size
                            inside[f] += size * (label[0] <= i < label[1])
        names = sorted(everywhere)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([inside[n] for n in names], pa.int64()), pa.array([everywhere[n] for n in names], pa.int64())],
            names=["feature", "inside", "everywhere"],
        )

    counts = pages.select(F.col(source).alias("html")).mapInArrow(count, "feature string, inside long, everywhere long")
    # Features are names of HTML elements with a mark and the fixed cues: a few hundred rows.
    rows = counts.groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("everywhere").alias("everywhere")).collect()
    weights = {}
    for r in rows:
        weights[r["feature"]] = (r["inside"] + PRIOR_COUNT * _prior(r["feature"])) / (r["everywhere"] + PRIOR_COUNT) - 0.5
    return weights


def extracted(pages: DataFrame, carry: list[str], source: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """Carried columns and ``text`` of every page, by weights learned from all labelled pages unless given.

    Null and empty html, and pages without a positive run, give an empty text. Equal
    runs: the first wins. Broken markup never fails: unclosed elements end with the
    page, stray end tags and cut tags are dropped, other stray characters are text.
    Very long pages are scanned whole, one at a time. Of the pages only ``carry`` and the
    html are read, so other columns may have any name; a carried ``text`` is not possible.
    Repeated rows are kept; with no labelled page the priors decide alone.
    """
    found = learned(pages, source) if weights is None else weights
    wanted = pages.select(*carry, F.col(source).alias("_html"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in wanted.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value in batch.column(batch.num_columns - 1).to_pylist():
                page = Page(value or "")
                texts.append(page.text(*page.region(found), found))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(texts, pa.string())],
                names=[*batch.schema.names[:-1], "text"],
            )

    return wanted.mapInArrow(run, f"{kinds}text string")

"""The linear classifier of page blocks: its statistics, a generator of labelled pages, and the fit.

No table holds labelled pages, so the classifier is fitted (logistic regression, Newton steps) to pages made
here by a seeded rule: articles in several kinds of containers, or in none that says so, with long and short
paragraphs, headings, lists and misleading class names; menus, notices, adverts, sidebars, forms, related
links, reader comments and footers around and inside them; and pages whose tags and names say nothing.
``pages`` is the bound of the sample. Weights depend on nothing but these parameters.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li dt dd td th".split())
STATISTICS = (
    "one",
    "log words",
    "few words",
    "link share",
    "mostly links",
    "ends a sentence",
    "commas and stops a word",
    "heading",
    "item",
    "in article or main",
    "in article or main and nothing away inside",
    "page has article or main elsewhere",
    "in a container named so",
    "in an away tag",
    "away tag around the article",
    "in a form",
    "in a container named away",
    "container named away around the article",
    "in reader comments",
    "rights notice",
)


def statistics(blocks: list) -> np.ndarray:
    """A row of STATISTICS for each block of a page."""
    has_home = any(b.element.home for b in blocks)
    rows = []
    for b in blocks:
        e, text = b.element, b.text
        words = text.count(" ") + 1
        links = min(1.0, b.linked / max(1, b.length))
        rights = not e.home and (text.startswith("©") or "all rights reserved" in text.lower())
        rows.append(
            (
                1.0,
                math.log(words),
                words < 8,
                links,
                links > 0.5,
                text[-1:] in ".!?:;\"'”»…",
                min(0.25, (text.count(",") + text.count(".")) / words),
                e.tag in HEADINGS,
                e.tag in ITEMS,
                e.home,
                e.home and not (e.away or e.form or e.away_named or e.comment),
                has_home and not e.home,
                e.home_named,
                e.away,
                e.away_around,
                e.form,
                e.away_named,
                e.away_named_around,
                e.comment,
                rights,
            )
        )
    return np.array(rows, float).reshape(len(blocks), len(STATISTICS))


def fit(rows: np.ndarray, labels: np.ndarray, l2: float = 2.0, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression."""
    weights = np.zeros(rows.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(rows @ weights)))
        slope = rows.T @ (labels - p) - l2 * weights
        bend = (rows * (p * (1 - p))[:, None]).T @ rows + l2 * np.eye(len(weights))
        weights += np.linalg.solve(bend, slope)
    return weights


class _Maker:
    """One page; ``content`` and ``other`` hold the texts of its blocks."""

    SYLLABLES = "ba de ki lo mu ra sen tor vi wel zan ter mon la ri es an tu per gol".split()

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.content: list[str] = []
        self.other: list[str] = []

    def words(self, low: int, high: int) -> list[str]:
        pick = self.rng.choice
        return ["".join(pick(self.SYLLABLES) for _ in range(self.rng.randint(1, 4))) for _ in range(self.rng.randint(low, high))]

    def sentence(self, low: int, high: int, mark: str = ".") -> str:
        words = self.words(low, high)
        if len(words) > 6:
            words[len(words) // 2] += ","
        return (" ".join(words)).capitalize() + mark

    def prose(self, low: int, high: int) -> str:
        left, out = self.rng.randint(low, high), []
        while left > 0:
            out.append(self.sentence(min(left, 4), min(left, 18)))
            left -= len(out[-1].split())
        return " ".join(out)

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def keep(self, text: str, tag: str = "p", attributes: str = "") -> str:
        self.content.append(text)
        return f"<{tag}{attributes}>{text}</{tag}>"

    def drop(self, text: str, tag: str = "p", linked: bool = False) -> str:
        self.other.append(text)
        return f"<{tag}><a href='/x'>{text}</a></{tag}>" if linked else f"<{tag}>{text}</{tag}>"

    def menu(self, low: int = 3, high: int = 8) -> str:
        return "<ul>" + "".join(self.drop(" ".join(self.words(1, 3)), "li", True) for _ in range(self.rng.randint(low, high))) + "</ul>"

    def named(self, names: str, inside: str, tags: str = "div section") -> str:
        tag, name = self.rng.choice(tags.split()), self.rng.choice(names.split())
        return f'<{tag} {self.rng.choice(("class", "class", "id"))}="{name}">{inside}</{tag}>'

    def advert(self, inside: bool = False) -> str:
        text = self.prose(3, 14 if self.chance(0.7) else 60) if self.chance(0.7) else " ".join(self.words(2, 5))
        names = "ad ads advert advertisement sponsored promo ad-banner" if inside else "ad ads advert advertisement ad-slot sponsored promo banner"
        return self.named(names, self.drop(text, linked=self.chance(0.3)))

    def comments(self) -> str:
        tag = self.rng.choice(("div", "article", "li"))
        each = "".join(
            f'<{tag} class="comment">{self.drop(" ".join(self.words(1, 2)), "b")}{self.drop(self.prose(2, 70 if self.chance(0.7) else 160))}</{tag}>'
            for _ in range(self.rng.randint(1, 5))
        )
        return self.named("comments comment-list discussion replies", self.drop("Comments " + " ".join(self.words(1, 1)), "h3") + each)

    def form(self) -> str:
        return f"<form>{self.drop(self.sentence(3, 9))}<label>{self.drop(' '.join(self.words(1, 3)), 'span')}</label><input><button>Go</button></form>"

    def sidebar(self, within: bool = False) -> str:
        inside = self.drop(" ".join(self.words(1, 3)), "h3")
        inside += self.menu() if self.chance(0.5) else self.drop(self.prose(5, 35 if self.chance(0.6) else 150))
        if self.chance(0.3):
            return f"<aside>{inside}</aside>"
        # inside an article a single word names nothing for sure
        alone, sure = "sidebar widget related related-posts recommended newsletter share social tags", "sidebar-widget related-widget newsletter-signup social-share"
        return self.named(sure if within else alone, inside)

    def article(self) -> str:
        odd = ("", "", "", "", "", "", ' class="lead"', ' class="overflow-hidden"', ' class="text-left"', ' class="notes"', ' class="share"', ' title="a hidden menu"')
        out = [self.keep(" ".join(self.words(2, 10)), "h1")] if self.chance(0.85) else []
        for _ in range(self.rng.randint(1, 9)):
            kind = self.rng.random()
            if kind < 0.55:
                out.append(self.keep(self.prose(15, 140), "p", self.rng.choice(odd)))
            elif kind < 0.78:
                out.append(self.keep(self.sentence(1, 7, self.rng.choice(".!?:")) if self.chance(0.8) else " ".join(self.words(1, 6)), "p"))
            elif kind < 0.84:
                out.append(self.keep(" ".join(self.words(1, 7)), self.rng.choice(("h2", "h3"))))
            elif kind < 0.9:
                out.append("<ul>" + "".join(self.keep(self.sentence(2, 20), "li") for _ in range(self.rng.randint(2, 4))) + "</ul>")
            elif kind < 0.93:
                out.append(self.keep(self.prose(8, 40), "blockquote"))
            elif kind < 0.96:
                out.append(self.advert(True))
            else:
                out.append(self.rng.choice((lambda: self.sidebar(True), self.form, self.menu))())
        return "".join(out)

    def page(self) -> str:
        top = []
        if self.chance(0.8):
            menu = self.menu()
            top.append(f"<nav>{menu}</nav>" if self.chance(0.6) else self.named("nav menu navbar topbar", menu))
        if self.chance(0.3):
            top.insert(0, f"<header>{self.drop(' '.join(self.words(1, 4)), 'h2')}</header>")
        if self.chance(0.3):
            top.append(self.named("cookie cookie-notice consent notice alert", self.drop(self.prose(4, 40 if self.chance(0.7) else 90))))
        if self.chance(0.4):
            top.append(self.advert())
        body = self.article()
        body += self.comments() if self.chance(0.12) else ""
        kind = self.rng.random()
        if kind < 0.4:
            body = f"<article>{body}</article>"
        elif kind < 0.6:
            body = f"<main>{body}</main>"
        elif kind < 0.7:
            body = f"<main><article>{body}</article></main>"
        elif kind < 0.85:
            body = self.named("content article post entry story main-text", body, "div")
        else:
            body = f"<div>{body}</div>"
        around = [f(self) for f, p in ((_Maker.sidebar, 0.5), (_Maker.advert, 0.2), (_Maker.comments, 0.25), (_Maker.form, 0.1)) if self.chance(p)]
        foot = self.drop(("© " if self.chance(0.5) else "") + self.prose(3, 20 if self.chance(0.7) else 90)) + (self.menu(1, 4) if self.chance(0.4) else "")
        around.append(f"<footer>{foot}</footer>" if self.chance(0.7) else self.named("footer site-footer copyright legal", foot, "div"))
        whole = "".join([*top, body, *around])
        if self.chance(0.04):
            whole = f"<form>{whole}</form>"
        if self.chance(0.4):  # a page whose markup says nothing
            whole = re.sub(r"<(/?)(?:nav|aside|footer|header|main|article|section)\b", r"<\1div", whole)
            whole = re.sub(r' (?:class|id)="[^"]*"', "", whole)
        return f"<html><head><title>{self.words(1, 1)[0]}</title></head><body>{whole}</body></html>"


def made_pages(seed: int, pages: int) -> Iterator[tuple[str, list[str], list[str]]]:
    """(html, its content texts in order, its other texts) of generated pages."""
    for k in range(pages):
        maker = _Maker(seed * 1_000_003 + k)
        html = maker.page()
        yield html, maker.content, maker.other


@lru_cache(maxsize=4)
def weights(read_blocks: Callable[[str], list], seed: int = 11, pages: int = 600) -> tuple[float, ...]:
    """Weights of STATISTICS, fitted to ``pages`` generated pages."""
    rows, labels = [], []
    for html, content, other in made_pages(seed, pages):
        blocks, kept = read_blocks(html), set(content)
        clear = kept.isdisjoint(other)
        rows.append(statistics(blocks))
        labels += [b.text in kept if clear or b.text not in other else math.nan for b in blocks]
    known, y = np.concatenate(rows), np.array(labels, float)
    clear = ~np.isnan(y)
    return tuple(fit(known[clear], y[clear]).tolist())

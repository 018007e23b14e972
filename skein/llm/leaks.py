"""Evaluation texts leaking into training text: a generalised suffix automaton of the normalised test items.

Each Python worker builds the automaton once from the broadcast items. A document's characters are streamed through it; the
length of the longest suffix that stands in some item is tracked, and wherever it reaches ``least`` the state of the last
``least`` characters names all items that hold them. Before that, a document is cut into blocks of least / 2 characters:
a match of ``least`` must cover one whole block, so documents of which no block stands in any item are passed over. This
loses nothing and leaves few documents to stream. Test items go in blocks of bounded size, so nothing broadcast grows beyond it.

Normal form: letters, digits and Han characters only, lower case, ordinary width, marks dropped.

Edge cases: null or short texts and items match nothing; repeated items are reported each by its id; a document is reported
once per item; very long texts are streamed in one pass; empty tables give an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import ship

#: Characters of a leak at least; characters of test items per automaton: about 0.7 KB each, so a worker stays below 400 MB.
LEAST, BLOCK_CHARS = 40, 500_000


class _Table(dict):
    """For str.translate: a character's normal form."""

    def __missing__(self, o: int) -> str:
        self[o] = out = "".join(c for c in unicodedata.normalize("NFKD", chr(o)).lower() if unicodedata.category(c)[0] in "LN")
        return out


TABLE = _Table()


def normal(text: str | None) -> str:
    return text.translate(TABLE) if text else ""


class Automaton:
    """Generalised suffix automaton; items of a state are those that hold its strings."""

    def __init__(self, items: list[tuple[int, str]], least: int) -> None:
        self.least = least
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set[int]] = [set()]
        for _, text in items:
            last = 0
            for ch in text:
                last = self._extend(last, ch)
        for item, text in items:
            v = 0
            for ch in text:
                v = self.next[v][ch]
                u = v
                while u > 0 and item not in self.items[u] and self.length[u] >= least:
                    self.items[u].add(item)
                    u = self.link[u]

    def _state(self, length: int, link: int, to: dict[str, int]) -> int:
        self.next.append(to)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, ch: str) -> int:
        """The state for the strings of q of length up to length[p] + 1."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(ch) == q:
            self.next[p][ch] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, ch: str) -> int:
        q = self.next[last].get(ch)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, ch)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and ch not in self.next[p]:
            self.next[p][ch] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][ch]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, ch)
        return new

    def matches(self, text: str) -> Iterator[tuple[int, int, set[int]]]:
        """(end, longest match ending there, items that hold its last ``least`` characters)."""
        v = n = 0
        to, link, length, least = self.next, self.link, self.length, self.least
        for i, ch in enumerate(text):
            while v and ch not in to[v]:
                v = link[v]
                n = length[v]
            if ch in to[v]:
                v = to[v][ch]
                n += 1
            if n >= least:
                u = v
                while length[link[u]] >= least:
                    u = link[u]
                yield i + 1, n, self.items[u]


class Finder:
    def __init__(self, items: list[tuple[int, str]], least: int) -> None:
        self.least, self.block = least, max(1, least // 2)
        self.items = {i: t for i, t in items}
        self.automaton = Automaton(items, least)
        self.blocks = {t[j : j + self.block] for _, t in items for j in range(len(t) - self.block + 1)}

    def find(self, text: str | None) -> tuple[dict[int, int], list[tuple[int, int]]]:
        """Longest match per item, and the matched spans of the normal form."""
        s, b = normal(text), self.block
        if len(s) < self.least or not any(s[i : i + b] in self.blocks for i in range(0, len(s) - b + 1, b)):
            return {}, []
        longest: dict[int, int] = {}
        spans: list[tuple[int, int]] = []
        for end, n, items in self.automaton.matches(s):
            for i in items:
                longest[i] = max(longest.get(i, 0), n)
            if spans and spans[-1][1] >= end - n:
                spans[-1] = (min(spans[-1][0], end - n), end)
            else:
                spans.append((end - n, end))
        return longest, spans

    def clean(self, text: str, spans: list[tuple[int, int]]) -> str:
        """The text without the matched spans."""
        drop, at, k = [], 0, 0
        for i, ch in enumerate(text):
            w = len(TABLE[ord(ch)])
            while k < len(spans) and spans[k][1] <= at:
                k += 1
            drop.append(bool(k < len(spans) and spans[k][0] <= at < spans[k][1] and (w or at > spans[k][0])))
            at += w
        return "".join(ch for ch, d in zip(text, drop, strict=True) if not d)


_FINDERS: dict[int, Finder] = {}


def leaks(df: DataFrame, id: str, text: str, items: DataFrame, item_id: str, item_text: str, least: int = LEAST, cover: float = 1.0) -> DataFrame:
    """(id, item, longest, covered, cleaned): the documents that hold at least ``least`` consecutive characters of an item.

    ``covered`` is the share of the document's normal form inside such spans. ``cleaned`` is the document without them, and
    empty where they cover ``cover`` of it or more: what is left of such a document is the frame of a test item. Test items
    beyond one block's size make further blocks, each of which streams the documents once more and judges them by itself.
    """
    spark = df.sparkSession
    ship(spark)
    kind = df.schema[id].dataType.simpleString()
    schema = f"id {kind}, item {items.schema[item_id].dataType.simpleString()}, longest int, covered double, cleaned string"
    out, block, size = None, [], 0

    def add(block: list[tuple[int, str]]) -> DataFrame:
        given = spark.sparkContext.broadcast(block)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key = hash((least, tuple(given.value)))
            if key not in _FINDERS:
                _FINDERS.clear()
                _FINDERS[key] = Finder(given.value, least)
            finder = _FINDERS[key]
            for pdf in frames:
                rows = []
                for i, t in zip(pdf["id"], pdf["text"], strict=True):
                    longest, spans = finder.find(t)
                    if longest:
                        share = sum(e - b for b, e in spans) / len(normal(t))
                        cleaned = finder.clean(t, spans) if share < cover else ""
                        rows += [(i, item, n, share, cleaned) for item, n in longest.items()]
                if rows:
                    yield pd.DataFrame(rows, columns=["id", "item", "longest", "covered", "cleaned"])

        return df.select(F.col(id).alias("id"), F.col(text).alias("text")).where("text is not null").mapInPandas(run, schema)

    for item, t in items.select(item_id, item_text).where(f"{item_id} is not null and {item_text} is not null").toLocalIterator():
        block.append((item, normal(t)))
        size += len(block[-1][1])
        if size > BLOCK_CHARS:
            part, block, size = add(block), [], 0
            out = part if out is None else out.unionByName(part)
    if block or out is None:
        part = add(block)
        out = part if out is None else out.unionByName(part)
    return out

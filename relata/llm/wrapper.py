"""Wrappers of page families by inference of union-free regular expressions (problem 1).

Pages become streams of marks (tags, and the marks that lines begin with) and texts. Neighbouring repeats of the same
stream of marks are folded into a repeated group. A family's wrapper begins as its first page and is aligned with one
page after the other: what both have stays, texts that differ become slots, what only one has becomes optional. The
result is a regular expression of marks, slots, optional and repeated groups, without any choice between two.

A page whose nodes a wrapper has in this order adds none to it. So only pages that it doesn't cover are aligned, a round
of them at a time, until every page of the family is covered. The nodes are those of aligning all pages one by one.

The tables have no host, so a family is the pages of one namespace and syntax. How far its wrapper carries is what
``p1_wrappers`` counts; see the README for why the elements themselves come from the recogniser.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import isqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relata.llm.distinctive import current_texts
from relata.llm.markup import elements, syntax_of
from relata.session import reliable, table

#: Pages of a family that its wrapper is begun with, those with the least hashes; the next rounds take GROWTH times as many
#: each, up to ROUND, which one task can hold. There are as many rounds as it takes to cover every page.
FITTED, GROWTH, ROUND = 40, 4, 10_000
#: Longest stream that is looked for as a repeated group.
LONGEST_GROUP = 6

_TOKEN = re.compile(
    r"<(/?[a-zA-Z][a-zA-Z0-9]*)[^<>]*>"
    r"|(?m:^)[ \t]*(={2,6}|\#{1,6}(?=\s)|[*\#:;]+|[-+](?=\s)|\d+\.(?=\s)|`{3,}|~{3,}|\{\||\|[-}]?|\{\{|\}\})"
    r"|(\\(?:begin|end)\{[a-z*]+\}|\\(?:sub)*section|\\item|\\\[|\\\])"
    r"|(\{\{|\}\}|\[\[|\]\])"
)


@dataclass(frozen=True)
class Node:
    """A mark, a text (None where it is a slot), or a repeated group of nodes; optional or not."""

    mark: str = ""
    text: str | None = None
    group: tuple[Node, ...] = ()
    optional: bool = False

    @property
    def key(self):
        return ("+", tuple(n.key for n in self.group)) if self.group else self.mark or "text"

    def loosened(self) -> Node:
        return Node(self.mark, self.text, self.group, True)


@lru_cache(4096)
def _mark(mark: str) -> Node:
    return Node(mark=mark)


def stream(text: str) -> list[Node]:
    """The marks and texts of a page, without blank texts."""
    out, at = [], 0
    for m in _TOKEN.finditer(text):
        if shown := text[at : m.start()].strip():
            out.append(Node(text=shown))
        out.append(_mark(m[m.lastindex].lower()))
        at = m.end()
    if shown := text[at:].strip():
        out.append(Node(text=shown))
    return out


def folded(nodes: list[Node]) -> list[Node]:
    """Repeats of the same keys side by side, the shortest first, as one repeated group; its texts are slots where they differ."""
    keys = [n.key for n in nodes]
    for size in range(1, LONGEST_GROUP + 1):
        starts = [i for i, (a, b) in enumerate(zip(keys, keys[size:])) if a == b]  # no other place begins a repeat
        if not any(keys[i : i + size] == keys[i + size : i + 2 * size] for i in starts):
            continue
        out, i, begins = [], 0, set(starts)
        while i < len(nodes):
            n = 1
            while i in begins and keys[i : i + size] == keys[i + n * size : i + (n + 1) * size] and len(keys) >= i + (n + 1) * size:
                n += 1
            if n > 1 and "text" in keys[i : i + size] and any(k != "text" for k in keys[i : i + size]):
                body = nodes[i : i + size]
                for k in range(1, n):
                    body = [_same(a, b) for a, b in zip(body, nodes[i + k * size : i + (k + 1) * size])]
                out.append(Node(group=tuple(body)))
                i += n * size
            else:
                out.append(nodes[i])
                i += 1
        nodes, keys = out, [n.key for n in out]
    return nodes


def _same(a: Node, b: Node) -> Node:
    """What two nodes of the same key have in common."""
    optional = a.optional or b.optional
    if a.group:
        return Node(group=tuple(_same(x, y) for x, y in zip(a.group, b.group)), optional=optional)
    return Node(a.mark, a.text if a.text == b.text else None, optional=optional)


def steps(a: list, b: list) -> Iterator[tuple[int | None, int | None]]:
    """The places of two streams of keys side by side, with a longest common stream paired and None beside all others.

    A row of the table of lengths is one integer with a bit for each key of ``a``: unset in row j where the longest common
    stream with ``b[j:]`` is shorter without that key. Only some rows are kept, those between are made again, so streams of
    any length can be aligned.
    """
    full, step = (1 << len(a)) - 1, isqrt(len(b)) + 1
    places: dict = {}
    for i, k in enumerate(a):
        places[k] = places.get(k, 0) | 1 << (len(a) - 1 - i)

    def rows(j: int, end: int, row: int) -> Iterator[int]:
        for k in reversed(b[j:end]):
            hit = row & places.get(k, 0)
            row = ((row + hit) | (row - hit)) & full
            yield row

    kept = {len(b): full}
    for j, row in zip(range(len(b) - 1, -1, -1), rows(0, len(b), full)):
        if j % step == 0:
            kept[j] = row
    i, j, began, block = 0, 0, -1, []
    while i < len(a) and j < len(b):
        if began != j - j % step:
            began = j - j % step
            end = min(began + step, len(b))
            block = [r.to_bytes(len(a) // 8 + 1, "little") for r in rows(began, end, kept[end])][::-1]
        bit = len(a) - 1 - i
        if a[i] == b[j]:
            yield i, j
            i, j = i + 1, j + 1
        elif block[j - began][bit >> 3] >> (bit & 7) & 1:
            yield i, None
            i += 1
        else:
            yield None, j
            j += 1
    yield from ((k, None) for k in range(i, len(a)))
    yield from ((None, k) for k in range(j, len(b)))


def aligned(wrapper: list[Node], page: list[Node]) -> list[Node]:
    """The least general wrapper of this form that covers both: the longest common stream of keys, the rest optional."""
    both = steps([n.key for n in wrapper], [n.key for n in page])
    return [page[j].loosened() if i is None else wrapper[i].loosened() if j is None else _same(wrapper[i], page[j]) for i, j in both]


def infer(texts: list[str]) -> list[Node]:
    """The wrapper of some pages, aligned in the order given."""
    wrapper: list[Node] | None = None
    for text in texts:
        page = folded(stream(text))
        wrapper = page if wrapper is None else aligned(wrapper, page)
    return wrapper or []


def keys_of(text: str) -> list[str]:
    """The keys of a page's nodes, as strings."""
    return [k if isinstance(k, str) else repr(k) for k in (n.key for n in folded(stream(text)))]


def grown(wrapper: list[str], pages: Iterable[list[str]]) -> list[str]:
    """The keys of a wrapper with those that it lacks for some pages, in the order given."""
    places = places_of(wrapper)
    for page in pages:
        if len(met_at(places, page)) < len(page):
            wrapper = [page[j] if i is None else wrapper[i] for i, j in steps(wrapper, page)]
            places = places_of(wrapper)
    return wrapper


def places_of(wrapper: list[str]) -> dict[str, list[int]]:
    """The places of each key in a wrapper."""
    places: dict = {}
    for i, key in enumerate(wrapper):
        places.setdefault(key, []).append(i)
    return places


def met_at(places: dict[str, list[int]], page: list[str]) -> list[int]:
    """The first places in order at which a wrapper has the keys of a page; keys that it doesn't have are passed over."""
    out, at = [], 0
    for key in page:
        of = places.get(key, ())
        k = bisect_left(of, at)
        if k < len(of):
            out.append(of[k])
            at = of[k] + 1
    return out


def covered(wrapper: list[Node], page: list[Node]) -> tuple[int, bool]:
    """(nodes of the page that the wrapper meets in order, whether it accepts the page whole)."""
    met, at, whole = 0, 0, True
    keys = [n.key for n in wrapper]
    for node in page:
        found = at
        while found < len(keys) and not (keys[found] == node.key and (wrapper[found].text is None or wrapper[found].text == node.text)):
            found += 1
        if found == len(keys):
            whole = False
            continue
        whole &= all(n.optional for n in wrapper[at:found])
        met, at = met + 1, found + 1
    return met, whole and all(n.optional for n in wrapper[at:])


def page_wrappers(texts: DataFrame) -> DataFrame:
    """(ns, syntax, pages, fitted, nodes, optional, parts, met, accepted, elements, reached): for each family of texts (id,
    ns, text) its pages, how many of them were aligned until its wrapper covered all, the wrapper's nodes and those of them
    that not every page has, the nodes of its pages and how many of them the wrapper meets, the pages it accepts whole, and
    the elements that the recogniser finds in all pages and in these.

    Every page counts, its nodes at the first places where the wrapper has them: a node is optional if any page lacks it, and
    a text that isn't the same in all pages is a slot. So a page is accepted if all its nodes are met.
    NULL texts are no pages; pages without a namespace are those of -1.
    """

    pages = reliable(texts.where("text is not null").select("id", "ns", "text").mapInArrow(_keyed, "id int, ns int, syntax string, keys array<string>, elements bigint"))
    wrappers = _family_wrappers(pages)
    places = {family: places_of(keys) for family, (_, keys) in wrappers.items()}
    sizes = {family: len(keys) for family, (_, keys) in wrappers.items()}

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of sums for each family and one for each node that not every page has."""
        sums: dict = {}
        used: dict = {}
        for batch in batches:
            for ns, syntax, page, found in zip(*(batch.column(c).to_pylist() for c in ("ns", "syntax", "keys", "elements"))):
                met = met_at(places[ns, syntax], page)
                used.setdefault((ns, syntax), Counter()).update(met)
                of = sums.setdefault((ns, syntax), [0, 0, 0, 0, 0, 0])
                accepted = len(met) == len(page)
                for k, n in enumerate((1, len(page), len(met), int(accepted), found, found if accepted else 0)):
                    of[k] += n
        for (ns, syntax), of in sums.items():
            missed = [None, *(i for i in range(sizes[ns, syntax]) if used[ns, syntax][i] < of[0])]
            columns = [pa.array([v] * len(missed), t) for v, t in ((ns, pa.int32()), (syntax, pa.string()))]
            columns += [pa.array(missed, pa.int32()), *(pa.array([n] + [0] * (len(missed) - 1), pa.int64()) for n in of)]
            yield pa.RecordBatch.from_arrays(columns, names=["ns", "syntax", "missed", "pages", "parts", "met", "accepted", "elements", "reached"])

    counts = pages.mapInArrow(match, "ns int, syntax string, missed int, pages bigint, parts bigint, met bigint, accepted bigint, elements bigint, reached bigint")
    summed = counts.groupBy("ns", "syntax").agg(
        F.count_distinct("missed").cast("int").alias("optional"), *[F.sum(c).alias(c) for c in ("pages", "parts", "met", "accepted", "elements", "reached")]
    )
    shapes = [(ns, syntax, n, sizes[ns, syntax]) for (ns, syntax), (n, _) in wrappers.items()]
    known = texts.sparkSession.createDataFrame(shapes, "ns int, syntax string, fitted int, nodes int")
    return summed.join(F.broadcast(known), ["ns", "syntax"]).select(
        "ns", "syntax", "pages", "fitted", "nodes", "optional", "parts", "met", "accepted", "elements", "reached"
    )


def _family_wrappers(pages: DataFrame) -> dict[tuple[int, str], tuple[int, list[str]]]:
    """For each family of pages (id, ns, syntax, keys) how many of them were aligned, and the keys of a wrapper that covers all."""
    wrappers: dict = {}
    w = Window.partitionBy("ns", "syntax").orderBy(F.xxhash64("id"), "id")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.sort_values("rn", kind="stable")
        ns, syntax = int(first["ns"].iloc[0]), first["syntax"].iloc[0]
        before, keys = wrappers.get((ns, syntax), (0, []))
        return pd.DataFrame({"ns": [ns], "syntax": [syntax], "fitted": [before + len(first)], "keys": [grown(keys, (k.tolist() for k in first["keys"]))]})

    rest, size = pages, FITTED
    while True:
        some = rest.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= size)
        made = some.groupBy("ns", "syntax").applyInPandas(fit, "ns int, syntax string, fitted int, keys array<string>").collect()  # a row a family
        if not made:
            return wrappers
        wrappers |= {(r["ns"], r["syntax"]): (r["fitted"], r["keys"]) for r in made}
        rest, size = reliable(rest.mapInArrow(_uncovered(wrappers), rest.schema)), min(size * GROWTH, ROUND)


def _uncovered(wrappers: dict):
    """Leaves the pages of which some nodes aren't in their family's wrapper in their order."""
    places = {family: places_of(keys) for family, (_, keys) in wrappers.items()}

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            families = zip(batch.column("ns").to_pylist(), batch.column("syntax").to_pylist())
            keep = [len(met_at(places[f], page)) < len(page) for f, page in zip(families, batch.column("keys").to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return left


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads each text once: its syntax, the keys of its nodes, and how many elements the recogniser finds in it."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"), pa.array(batch.column("ns").fill_null(-1), pa.int32()), pa.array([syntax_of(t) for t in texts], pa.string()),
                pa.array([keys_of(t) for t in texts], pa.list_(pa.string())), pa.array([len(elements(t)) for t in texts], pa.int64()),
            ],
            names=["id", "ns", "syntax", "keys", "elements"],
        )


def p1_wrappers(spark, sf_dir: str) -> DataFrame:
    """How far the wrappers of page families carry: over the current pages that are no redirects."""
    pages = table(spark, sf_dir, "pages")
    texts = current_texts(pages, keep=("ns", "redirect"))
    return page_wrappers(texts.where("redirect is null"))

"""Balanced elements of a page: what patterns cannot find, since elements nest.

Tags are read one after the other with a stack of the open ones, so each element ends at its own
closing tag, whatever lies inside. An element that nothing closes ends where its parent does; a
closing tag without an element is passed over; script, style and comments are passed over whole.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements without content, those whose content is no markup, and those that end
# where another of their kind begins in the same parent.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = ("script", "style", "noscript")
SIBLINGS = frozenset(("li", "option", "dt", "dd", "tr", "td", "th"))
TAG = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
KIND = T.ArrayType(T.StructType([T.StructField(c, T.StringType() if c in ("name", "tag") else T.IntegerType()) for c in ("name", "tag", "start", "inner", "stop", "end", "parent")]))


def spans(html: str) -> list[dict]:
    """The elements of a page in order: name, text of the opening tag, start, inner to stop (what
    lies between the tags), end (all in code points), and the place of the parent (-1: none)."""
    found: list[dict] = []
    open_: list[int] = []

    def close(depth: int, stop: int, end: int) -> None:
        for i in open_[depth + 1 :]:
            found[i] |= {"stop": stop, "end": stop}
        found[open_[depth]] |= {"stop": stop, "end": end}
        del open_[depth:]

    at = 0
    while m := TAG.search(html, at):
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            depth = next((d for d in reversed(range(len(open_))) if found[open_[d]]["name"] == name), None)
            if depth is not None:
                close(depth, m.start(), m.end())
            continue
        if name in SIBLINGS and open_ and found[open_[-1]]["name"] == name:
            close(len(open_) - 1, m.start(), m.start())
        found.append({"name": name, "tag": m[0], "start": m.start(), "inner": m.end(), "stop": m.end(), "end": m.end(), "parent": open_[-1] if open_ else -1})
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            stop, at = (end.start(), end.end()) if end else (len(html), len(html))
            found[-1] |= {"stop": stop, "end": at}
        elif name not in VOID and not m[3].endswith("/"):
            open_.append(len(found) - 1)
    if open_:
        close(0, len(html), len(html))
    return found


@F.pandas_udf(KIND)
def elements(html: pd.Series) -> pd.Series:
    return html.map(lambda x: None if x is None else spans(x))


def attribute(element: Column, name: str) -> Column:
    """The value of an attribute of an element; '' where it has none."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*(F.regexp_extract(element["tag"], pattern, i) for i in (1, 2, 3)))


def inside(element: Column, other: Column) -> Column:
    """Whether element lies within other."""
    return (element["start"] >= other["inner"]) & (element["end"] <= other["stop"])


def inner_html(html: Column, element: Column) -> Column:
    return F.substring(html, element["inner"] + 1, element["stop"] - element["inner"])

"""The text form of graphs, ``(b / buy-01 :ARG0 (x / dog))``, to and from packed graphs.

Nesting is not regular, so these two are Arrow-batched UDFs; all else works on the
packed form. Inverse roles (``:ARG0-of``) of variables are stored the right way
round. Texts that do not parse, and graphs with parts the top does not reach, give
null; null gives null. Variables can be used before the node that defines them.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r'"(?:\\.|[^"\\])*"|[()]|[^\s()"]+')
ALIGNED = re.compile(r"~(?:[a-z]\.?)?\d+(?:,\d+)*$")
# Roles that end in -of and are not inverse
PLAIN_OF = (":consist-of", ":prep-on-behalf-of", ":prep-out-of")
_TEXT = T.StringType()
GRAPH = T.StructType().add("top", _TEXT).add("g", T.ArrayType(T.StructType().add("source", _TEXT).add("role", _TEXT).add("target", _TEXT)))


def parse(text: str | None) -> tuple[str, list[tuple[str, str, str]]] | None:
    """(top, triples in page order) of a graph's text."""
    if text is None:
        return None
    lines = [line for line in text.split("\n") if not line.lstrip().startswith("#")]
    tokens = [t if t.startswith('"') else ALIGNED.sub("", t) for t in TOKEN.findall("\n".join(lines))]
    tokens = [t for t in tokens if t]
    found: list[tuple[str, str, str]] = []
    open_nodes: list[str] = []
    top, role, at = None, None, 0
    while at < len(tokens):
        token = tokens[at]
        at += 1
        if token == "(":
            if at >= len(tokens) or tokens[at] in "()" or top is not None and not (open_nodes and role):
                return None
            name, _, word = tokens[at].partition("/")
            at += 1
            if not word and at < len(tokens) and tokens[at].startswith("/"):
                word = tokens[at][1:]
                at += 1
                if not word and at < len(tokens) and tokens[at] not in "()":
                    word = tokens[at]
                    at += 1
            if top is None:
                top = name
            else:
                found.append((open_nodes[-1], role, name))
            if word:
                found.append((name, ":instance", word))
            open_nodes.append(name)
            role = None
        elif token == ")":
            if not open_nodes or role:
                return None
            open_nodes.pop()
        elif role is None and token.startswith(":"):
            role = token
        elif role and open_nodes:
            found.append((open_nodes[-1], role, token))
            role = None
        else:
            return None
    if top is None or open_nodes:
        return None
    names = {s for s, r, _ in found if r == ":instance"}
    inverse = lambda r, t: r.endswith("-of") and r not in PLAIN_OF and t in names
    return top, [(t, r[:-3], s) if inverse(r, t) else (s, r, t) for s, r, t in found]


def write(top: str | None, triples: list[tuple[str, str, str]] | None) -> str | None:
    """One-line text of a graph; edges that only lead upwards are written inverse."""
    if not top or triples is None:
        return None
    word = {s: t for s, r, t in reversed(triples) if r == ":instance"}
    edges = [e for e in triples if e[1] != ":instance"]
    outward: dict[str, list[int]] = {}
    inward: dict[str, list[int]] = {}
    for i, (s, _, t) in enumerate(edges):
        outward.setdefault(s, []).append(i)
        if t in word:
            inward.setdefault(t, []).append(i)
    if top not in word:
        return None
    used: set[int] = set()
    seen = {top}
    out = [f"({top} / {word[top]}"]
    # a frame is a node and what is left to write of it: own edges first, then inverse ones
    stack = [iter([(i, False) for i in outward.get(top, ())] + [(i, True) for i in inward.get(top, ())])]
    while stack:
        step = next(stack[-1], None)
        if step is None:
            out.append(")")
            stack.pop()
            continue
        i, turned = step
        if i in used or turned and edges[i][0] in seen:
            continue  # an edge from a node that was met is written there
        used.add(i)
        s, r, t = edges[i]
        other, name = (s, r + "-of") if turned else (t, r)
        if other in word and other not in seen:
            seen.add(other)
            out.append(f" {name} ({other} / {word[other]}")
            stack.append(iter([(k, False) for k in outward.get(other, ())] + [(k, True) for k in inward.get(other, ())]))
        else:
            out.append(f" {name} {other}")
    return "".join(out) if len(used) == len(edges) and seen.issuperset(word) else None


@F.pandas_udf(GRAPH)
def _decode(texts: pd.Series) -> pd.DataFrame:
    """struct(top, g) of a text column."""
    parsed = [parse(t) for t in texts]
    rows = [(p[0], [{"source": s, "role": r, "target": t} for s, r, t in p[1]]) if p else (None, None) for p in parsed]
    return pd.DataFrame(rows, columns=["top", "g"])


@F.pandas_udf(_TEXT)
def _encode(top: pd.Series, g: pd.Series) -> pd.Series:
    """Text of the columns top and g."""
    return pd.Series([write(t, None if e is None else [(x["source"], x["role"], x["target"]) for x in e]) for t, e in zip(top, g)], dtype=object)


#: Not folded into expressions that use them: a UDF cannot run inside a lambda function.
decode, encode = _decode.asNondeterministic(), _encode.asNondeterministic()

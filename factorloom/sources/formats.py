"""Readers and writers of network texts: BIF, XMLBIF 0.3 and JSON."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape

import numpy as np

from factorloom.model import Cpt, Network, Variable

_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
_POSITION = re.compile(r"position\s*=\s*\(?\s*(\d+)\s*,\s*(\d+)\s*\)?")


def _blocks(text: str):
    """(keyword, header, body) of each top-level ``keyword header { body }``."""
    at = 0
    while (m := re.compile(r"\s*(\w+)([^{]*)\{").match(text, at)) is not None:
        depth, end = 1, m.end()
        while depth:
            if end >= len(text):
                raise ValueError(f"{m[1]} block is not closed")
            depth += {"{": 1, "}": -1}.get(text[end], 0)
            end += 1
        yield m[1].lower(), m[2].strip(), text[m.end() : end - 1]
        at = end
    if text[at:].strip():
        raise ValueError(f"unexpected text: {text[at:].strip()[:40]!r}")


def _numbers(text: str) -> list[float]:
    return [float(x) for x in re.split(r"[\s,]+", text.strip()) if x]


def parse_bif(text: str) -> Network:
    name, variables, specs = "Untitled", [], []
    for kind, header, body in _blocks(_COMMENT.sub(" ", text)):
        if kind == "network":
            name = header.strip('" ') or name
        elif kind == "variable":
            m = re.search(r"type\s+discrete\s*\[\s*(\d+)\s*\]\s*\{([^}]*)\}", body)
            if m is None:
                raise ValueError(f"variable {header!r}: only discrete types are known")
            outcomes = tuple(x.strip().strip('"') for x in m[2].split(",") if x.strip())
            if len(outcomes) != int(m[1]):
                raise ValueError(f"variable {header!r}: {m[1]} outcomes declared, {len(outcomes)} listed")
            p = _POSITION.search(body)
            variables.append(Variable(header.strip('" '), outcomes, (int(p[1]), int(p[2])) if p else None))
        elif kind == "probability":
            specs.append((header, body))
        else:
            raise ValueError(f"unknown block {kind!r}")
    by_name = {v.name: v for v in variables}
    cpts = []
    for header, body in specs:
        inner = header.strip().removeprefix("(").removesuffix(")")
        child, _, given = inner.partition("|")
        child, parents = child.strip().strip('"'), tuple(p.strip().strip('"') for p in given.split(",") if p.strip())
        for v in (child, *parents):
            if v not in by_name:
                raise ValueError(f"unknown variable {v!r} in a probability block")
        shape = tuple(by_name[p].card for p in parents)
        card = by_name[child].card
        table = np.full((int(np.prod(shape, dtype=np.int64)), card), np.nan)
        rows = re.findall(r"\(([^)]*)\)([^;]*);", body)
        flat = re.search(r"\btable\b([^;]*);", body)
        if flat is None and not rows:
            flat = re.match(r"(.*?);?\s*\Z", body, re.S)
        if flat is not None:
            numbers = _numbers(flat[1])
            if len(numbers) != table.size:
                raise ValueError(f"table of {child!r}: {len(numbers)} numbers, {table.size} expected")
            table = np.array(numbers)
        else:
            if len(rows) != len(table):
                raise ValueError(f"table of {child!r}: {len(rows)} rows, {len(table)} expected")
            for key, values in rows:
                codes = []
                for p, o in zip(parents, (x.strip().strip('"') for x in key.split(",")), strict=True):
                    code = by_name[p].code(o)
                    if code is None:
                        raise ValueError(f"unknown outcome {o!r} of {p!r}")
                    codes.append(code)
                numbers = _numbers(values)
                if len(numbers) != card:
                    raise ValueError(f"row {key!r} of {child!r}: {len(numbers)} numbers, {card} expected")
                table[int(np.ravel_multi_index(codes, shape)) if codes else 0] = numbers
            if np.isnan(table).any():
                raise ValueError(f"table of {child!r} lacks rows")
        cpts.append(Cpt(child, parents, table))
    return Network(name, variables, cpts)


def parse_xmlbifs(text: str) -> list[Network]:
    """Every NETWORK of an XMLBIF text; tag names in any case; entities decoded."""
    body = re.sub(r"<!DOCTYPE[^\[>]*(\[.*?\])?\s*>", "", text, flags=re.S)
    root = ET.fromstring(body.strip())
    low = lambda e: e.tag.rpartition("}")[2].upper()
    own = lambda e, tag: [c for c in e if low(c) == tag]
    text_of = lambda e: "".join(e.itertext()).strip()
    found = []
    for net in [e for e in root.iter() if low(e) == "NETWORK"]:
        names = own(net, "NAME")
        variables = []
        for v in own(net, "VARIABLE"):
            p = next((m for e in own(v, "PROPERTY") if (m := _POSITION.search(text_of(e)))), None)
            outcomes = tuple(text_of(o) for o in v if low(o) in ("OUTCOME", "VALUE"))
            variables.append(Variable(text_of(own(v, "NAME")[0]), outcomes, (int(p[1]), int(p[2])) if p else None))
        cpts = []
        for d in [e for e in net if low(e) in ("DEFINITION", "PROBABILITY")]:
            table = _numbers(" ".join(text_of(t) for t in own(d, "TABLE")))
            cpts.append(Cpt(text_of(own(d, "FOR")[0]), tuple(text_of(g) for g in own(d, "GIVEN")), np.array(table)))
        found.append(Network(text_of(names[0]) if names and text_of(names[0]) else "Untitled", variables, cpts))
    return found


def parse_xmlbif(text: str) -> Network:
    found = parse_xmlbifs(text)
    if not found:
        raise ValueError("no NETWORK element")
    return found[0]


def parse_network(text: str) -> Network:
    """BIF if the text starts with ``network`` or a comment, JSON if with a brace, else XMLBIF."""
    start = text.lstrip()
    if start.startswith(("network", "//", "/*")):
        return parse_bif(text)
    return from_json(text) if start.startswith("{") else parse_xmlbif(text)


def shortest(x: float) -> str:
    """Shortest decimal text that reads back as the same double, integers without a point."""
    return str(int(x)) if float(x).is_integer() and abs(x) < 1e15 else repr(float(x))


def to_xmlbif(net: Network) -> str:
    out = ['<?xml version="1.0"?>', '<BIF VERSION="0.3">', "<NETWORK>", f"<NAME>{escape(net.name)}</NAME>"]
    for v in net.variables.values():
        out.append(f'<VARIABLE TYPE="nature">\n\t<NAME>{escape(v.name)}</NAME>')
        out += [f"\t<OUTCOME>{escape(o)}</OUTCOME>" for o in v.outcomes]
        if v.position:
            out.append(f"\t<PROPERTY>position = ({v.position[0]}, {v.position[1]})</PROPERTY>")
        out.append("</VARIABLE>")
    for c in net.cpts.values():
        out.append(f"<DEFINITION>\n\t<FOR>{escape(c.variable)}</FOR>")
        out += [f"\t<GIVEN>{escape(p)}</GIVEN>" for p in c.parents]
        out.append(f"\t<TABLE>{' '.join(map(shortest, c.table.ravel()))}</TABLE>\n</DEFINITION>")
    return "\n".join([*out, "</NETWORK>", "</BIF>"])


def to_json(net: Network) -> str:
    variables = [{"name": v.name, "outcomes": list(v.outcomes)} | ({"position": {"x": v.position[0], "y": v.position[1]}} if v.position else {}) for v in net.variables.values()]
    edges = [{"from": a, "to": b} for a, b in net.edges()]
    cpts = [{"variable": c.variable, "parents": list(c.parents), "table": c.table.ravel().tolist()} for c in net.cpts.values()]
    return json.dumps({"name": net.name, "variables": variables, "edges": edges, "cpts": cpts})


def from_json(text: str) -> Network:
    d = json.loads(text)
    place = lambda v: (int(v["position"]["x"]), int(v["position"]["y"])) if v.get("position") else None
    variables = [Variable(v["name"], tuple(v["outcomes"]), place(v)) for v in d["variables"]]
    return Network(d.get("name") or "Untitled", variables, [Cpt(c["variable"], tuple(c["parents"]), np.array(c["table"], float)) for c in d["cpts"]])

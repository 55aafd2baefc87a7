"""Static vector markup: safety rules, canonical form, element names, labels. Vectorized Python over the standard XML parser.

The parser takes no DTD: a text that declares one is refused before it is parsed. Its canonical
form is C14N 2.0, so hashes hold within this library only.
"""

from __future__ import annotations

import io
import re
from collections import Counter, deque
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

SVG = "http://www.w3.org/2000/svg"
XLINK, XML = "http://www.w3.org/1999/xlink", "http://www.w3.org/XML/1998/namespace"

#: Elements that static markup may have.
ELEMENTS = frozenset(
    """circle clipPath defs desc ellipse feBlend feColorMatrix feComponentTransfer feComposite feConvolveMatrix
    feDiffuseLighting feDisplacementMap feDistantLight feDropShadow feFlood feFuncA feFuncB feFuncG feFuncR
    feGaussianBlur feImage feMerge feMergeNode feMorphology feOffset fePointLight feSpecularLighting feSpotLight
    feTile feTurbulence filter g image line linearGradient marker mask metadata path pattern polygon polyline
    radialGradient rect stop svg switch symbol text textPath title tspan use""".split()
)
#: Elements that are refused as active, in lower case.
ACTIVE = frozenset("animate animatemotion animatetransform discard script set".split())
#: Inline style properties and functions.
PROPERTIES = frozenset(
    """color display dominant-baseline fill fill-opacity font-family font-size font-style font-weight opacity
    paint-order shape-rendering stop-color stop-opacity stroke stroke-dasharray stroke-dashoffset stroke-linecap
    stroke-linejoin stroke-miterlimit stroke-opacity stroke-width text-anchor text-rendering transform
    vector-effect visibility""".split()
)
FUNCTIONS = frozenset("calc hsl hsla matrix rgb rgba rotate scale skewx skewy translate url".split())
#: URI schemes that no attribute may have.
SCHEMES = ("data", "file", "ftp", "http", "https", "javascript")
#: Elements by the part they play.
GRAPHICS = frozenset("path rect circle ellipse line polyline polygon text image use".split())
RESOURCES = frozenset("symbol linearGradient radialGradient pattern clipPath mask filter marker".split())
PROSE = frozenset("desc metadata title".split())

_SCHEME = re.compile(r"(?<![\w.+-])(?:" + "|".join(SCHEMES) + r")\s*:", re.I)
_URL = re.compile(r"""url\(\s*(['"]?)([^)'"]*)\1\s*\)""", re.I)
_CALL = re.compile(r"([A-Za-z-][\w-]*)\s*\(")
_LABEL = re.compile(r"\bdata-agent-id\s*=", re.I)


def _split(name: str) -> tuple[str | None, str]:
    space, _, local = name[1:].rpartition("}") if name.startswith("{") else (None, "", name)
    return space, local


def _parsed(text: str) -> tuple[ElementTree.Element, bool]:
    """The root, and whether there are processing instructions."""
    found: list[str] = []

    class Builder(ElementTree.TreeBuilder):
        def pi(self, target, data=None):  # noqa: ANN001, ANN202
            found.append(target)
            return super().pi(target, data)

    parser = ElementTree.XMLParser(target=Builder())
    parser.feed(text)
    return parser.close(), bool(found)


def _style_errors(value: str) -> list[tuple[str, str]]:
    out = [("unsafe_css", "at-rule")] if "@" in value else []
    for declaration in filter(None, map(str.strip, value.split(";"))):
        name, colon, rest = declaration.partition(":")
        if not colon:
            out.append(("unsafe_css", "malformed declaration"))
            continue
        if (prop := name.strip().lower()) not in PROPERTIES:
            out.append(("unsafe_css", f"property {prop}"))
        out += [("unsafe_css", f"function {f}") for f in _CALL.findall(rest) if f.lower() not in FUNCTIONS]
        out += _url_errors(rest)
    return out


def _url_errors(value: str) -> list[tuple[str, str]]:
    return [("external_reference", f"url {t.strip()}") for _, t in _URL.findall(value) if t.strip() and not t.strip().startswith("#")]


def _attribute_errors(raw: str, value: str) -> list[tuple[str, str]]:
    (space, local), value, out = _split(raw), value.strip(), []
    name = local.lower()
    if space and not (space == XML and name in ("lang", "space") or space == XLINK and name == "href"):
        out.append(("invalid_namespace", f"attribute {name}"))
    if any(x in value for x in ("\\", "/*", "*/")):
        out.append(("unsafe_attribute", "escaped value"))
    if _SCHEME.search(re.sub(r"[\t\r\n]", "", value)):
        out.append(("external_reference", "absolute URI"))
    if name.startswith("on"):
        out.append(("unsafe_attribute", f"handler {name}"))
    if name == "base":
        out.append(("external_reference", "base URI"))
    if name in ("href", "src") and value and not value.startswith("#"):
        out.append(("external_reference", name))
    return out + (_style_errors(value) if name == "style" else _url_errors(value))


def findings(text: str | None) -> dict:
    """has_tag, has_closing, well_formed, errors and warnings as (code, detail), in the order of the rules."""
    out: dict = {"has_tag": False, "has_closing": False, "well_formed": False, "errors": [], "warnings": []}
    if text is None or not text.strip():
        return out | {"errors": [("empty", "no content")]}
    errors = out["errors"]
    out["has_tag"], out["has_closing"] = bool(re.search(r"<(?:[\w.-]+:)?svg\b", text)), bool(re.search(r"</(?:[\w.-]+:)?svg\s*>", text))
    if not out["has_tag"]:
        errors.append(("missing_root", "no svg tag"))
    label = [("reserved_label", "data-agent-id")] if _LABEL.search(text) else []
    if "<!DOCTYPE" in text.upper():
        errors.append(("unsafe_doctype", "doctype"))
        try:
            _parsed(re.sub(r"<!DOCTYPE[^>\[]*(\[.*?\])?\s*>", "", text, count=1, flags=re.I | re.S))
        except (ElementTree.ParseError, ValueError):
            errors.append(("xml_parse_error", "not well-formed"))
        errors += label
        return out
    try:
        root, instructions = _parsed(text)
    except (ElementTree.ParseError, ValueError) as e:
        errors += [("xml_parse_error", str(e)), *label]
        return out
    out["well_formed"] = True
    space, local = _split(root.tag)
    if local != "svg":
        errors.append(("invalid_root", local))
    else:
        out["has_tag"] = True
    if space not in (None, SVG):
        errors.append(("invalid_namespace", f"root {space}"))
    if space is None:
        out["warnings"].append(("invalid_namespace", "xmlns is missing"))
    if instructions:
        errors.append(("unsafe_attribute", "processing instruction"))
    for e in root.iter():
        if not isinstance(e.tag, str):
            continue
        space, local = _split(e.tag)
        if space not in (None, SVG):
            errors.append(("invalid_namespace", f"element {space}"))
        if local.lower() in ACTIVE:
            errors.append(("unsafe_attribute", f"active {local}"))
        if local not in ELEMENTS:
            errors.append(("unsafe_element", local))
        for raw, value in e.attrib.items():
            errors += _attribute_errors(raw, value)
    errors += label
    return out


_FINDING = ArrayType(StructType([StructField("code", StringType()), StructField("detail", StringType())]))
RESULT = StructType([StructField(n, BooleanType()) for n in ("is_valid", "well_formed", "has_tag", "has_closing")] + [StructField("errors", _FINDING), StructField("warnings", _FINDING)])


@F.pandas_udf(RESULT)
def validate(c: pd.Series) -> pd.DataFrame:
    """What findings() says of each text; is_valid without errors."""
    rows = []
    for x in map(findings, c):
        listed = lambda k: [{"code": a, "detail": b} for a, b in x[k]]  # noqa: B023, E731
        rows.append((not x["errors"], x["well_formed"], x["has_tag"], x["has_closing"], listed("errors"), listed("warnings")))
    return pd.DataFrame(rows, columns=RESULT.names)


@F.pandas_udf(StructType([StructField("canonical", StringType()), StructField("nodes", IntegerType())]))
def canonicalize(c: pd.Series) -> pd.DataFrame:
    """(canonical, nodes): canonical form without comments, and its number of nodes, comments and instructions counted; nulls if it doesn't parse."""

    def one(text: str | None) -> tuple:
        if text is None or "<!DOCTYPE" in text.upper():
            return None, None
        try:
            out = io.StringIO()
            ElementTree.canonicalize(text, out=out, with_comments=False)
            parser = ElementTree.XMLParser(target=ElementTree.TreeBuilder(insert_comments=True, insert_pis=True))
            parser.feed(text)
            return out.getvalue(), sum(1 for _ in parser.close().iter())
        except (ElementTree.ParseError, ValueError):
            return None, None

    return pd.DataFrame([one(t) for t in c], columns=["canonical", "nodes"]).astype({"nodes": "Int32"})


def element_names(text: str | None, fragments: bool = False, most: int = 32) -> list[str] | None:
    """Different names below the root in lower case, in order; null if the text isn't safe. A fragment is judged inside a root."""
    candidates = [text or ""] + ([f'<svg xmlns="{SVG}">{text}</svg>'] if fragments and (text or "").lstrip().startswith("<") else [])
    for k, candidate in enumerate(candidates):
        if not findings(candidate)["errors"]:
            names = dict.fromkeys(n for e in _parsed(candidate)[0].iter() if isinstance(e.tag, str) and (n := _split(e.tag)[1].lower()) != "svg")
            return list(names)[:most] if names or not k else None
    return None


@F.pandas_udf(ArrayType(StringType()))
def safe_names(c: pd.Series) -> pd.Series:
    return c.map(lambda t: element_names(t, fragments=True))


def _references(e: ElementTree.Element) -> list[str]:
    out = []
    for raw, value in e.attrib.items():
        if _split(raw)[1] == "href" and value.startswith("#"):
            out.append(value[1:])
        out += [t.strip()[1:] for _, t in _URL.findall(value) if t.strip().startswith("#")]
    return out


def label(text: str) -> tuple[str, list[tuple]]:
    """The markup with a short id on every drawn element, and rows (id, path, tag, original_id, parent_id, role).

    Prose, comments, classes, roles and data or aria attributes go; ids become neutral and references
    follow. Resources count only if something drawn refers to them, directly or through others.
    """
    root = _parsed(text)[0]
    parents = {c: p for p in root.iter() for c in p}
    for e in [e for e in root.iter() if isinstance(e.tag, str) and _split(e.tag)[1] in PROSE and e in parents]:
        above = parents[e]
        at = list(above).index(e)
        if e.tail:
            if at:
                above[at - 1].tail = (above[at - 1].tail or "") + e.tail
            else:
                above.text = (above.text or "") + e.tail
        above.remove(e)
    nodes = list(root.iter())
    neutral, original = {}, {}
    for e in nodes:
        if own := e.get("id"):
            original[e] = own
            neutral[own] = f"ref{len(neutral) + 1:04d}"
            e.set("id", neutral[own])
    for e in nodes:
        for raw, value in list(e.attrib.items()):
            name = _split(raw)[1].lower()
            if name in ("class", "role") or name.startswith(("aria-", "data-")):
                del e.attrib[raw]
            elif name == "href" and value[:1] == "#" and value[1:] in neutral:
                e.set(raw, "#" + neutral[value[1:]])
            else:
                e.set(raw, re.sub(r"""(url\(\s*['"]?#)([^)'"\s]+)""", lambda m: m[1] + neutral.get(m[2], m[2]), value, flags=re.I))
    by_id = {e.get("id"): e for e in nodes if e.get("id")}
    kind = {e: _split(e.tag)[1] for e in nodes}
    reached, todo = set(), deque(r for e in nodes if kind[e] not in RESOURCES for r in _references(e))
    while todo:
        e = by_id.get(todo.popleft())
        if e is not None and e not in reached:
            reached.add(e)
            todo.extend(r for x in e.iter() for r in _references(x))
    count, given, rows, paths = Counter(), {}, [], {root: f"/{kind[root]}"}
    for e in nodes:
        same = Counter(kind[c] for c in e)
        seen: Counter = Counter()
        for c in e:
            seen[kind[c]] += 1
            paths[c] = f"{paths[e]}/{kind[c]}" + (f"[{seen[kind[c]]}]" if same[kind[c]] > 1 else "")
        k = kind[e]
        role = "svg" if k == "svg" else "group" if k == "g" and len(e) else "graphics" if k in GRAPHICS else "resource" if k in RESOURCES and e in reached else None
        if role is None:
            continue
        letter = {"svg": "s", "group": "g", "graphics": "e", "resource": "d"}[role]
        count[letter] += 1
        given[e] = f"{letter}{count[letter]:04d}"
        e.set("data-agent-id", given[e])
        above = parents.get(e)
        while above is not None and above not in given:
            above = parents.get(above)
        rows.append((given[e], paths[e], k, original.get(e), given.get(above), role))
    ElementTree.register_namespace("", SVG)
    return ElementTree.tostring(root, encoding="unicode"), rows


@F.udtf(returnType="agent_id string, path string, tag string, original_id string, parent_id string, role string")
class LabelledElements:
    """A row for every labelled element of a markup text; none if it doesn't parse."""

    def eval(self, text: str):
        if text and "<!DOCTYPE" not in text.upper():
            try:
                yield from label(text)[1]
            except (ElementTree.ParseError, ValueError):
                return


@F.pandas_udf(StringType())
def labelled(c: pd.Series) -> pd.Series:
    return c.map(lambda t: None if t is None or findings(t)["errors"] else label(t)[0])


def prefixes(text: str | None) -> list[str]:
    """The markup with its first child, its first two, and so on: cumulative variants, each a whole text."""
    if text is None or findings(text)["errors"]:
        return []
    n = len(_parsed(text)[0])
    out = []
    ElementTree.register_namespace("", SVG)
    for keep in range(1, n + 1):
        root = _parsed(text)[0]
        for c in list(root)[keep:]:
            root.remove(c)
        out.append(ElementTree.tostring(root, encoding="unicode"))
    return out


@F.pandas_udf(ArrayType(StringType()))
def element_prefixes(c: pd.Series) -> pd.Series:
    return c.map(prefixes)


@F.pandas_udf(StringType())
def without_labels(c: pd.Series) -> pd.Series:
    """The markup without reserved labels, comments and instructions; null if it doesn't parse."""

    def one(text: str | None) -> str | None:
        if text is None or "<!DOCTYPE" in text.upper():
            return None
        try:
            root = _parsed(text)[0]
        except (ElementTree.ParseError, ValueError):
            return None
        for e in root.iter():
            e.attrib.pop("data-agent-id", None)
        ElementTree.register_namespace("", SVG)
        return ElementTree.tostring(root, encoding="unicode")

    return c.map(one)

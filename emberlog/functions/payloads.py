"""Objects inside messages. Brackets can't be balanced by an expression, so one Arrow function scans for them."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: What matters for balance: a whole string, or its beginning where the text ends, and braces.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?$)|[{}]', re.S)


def balanced(text: str) -> Iterator[tuple[str, bool]]:
    """Each outermost {...} of a text, and whether it is closed; braces in strings don't count."""
    at = text.find("{")
    while at != -1:
        depth, end = 0, None
        for token in _TOKEN.finditer(text, at):
            if token[0] == "{":
                depth += 1
            elif token[0] == "}":
                depth -= 1
                if not depth:
                    end = token.end()
                    break
        yield text[at:end], end is not None
        at = text.find("{", end) if end else -1


def leaves(value, found: dict[str, str]) -> None:
    """Scalars by lower-cased key, at any depth; the first of a key counts. Credentials are told as their first and their last."""
    pairs = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in pairs:
        if isinstance(v, (dict, list)):
            leaves(v, found)
        elif isinstance(k, str) and v is not None and k.lower() not in found:
            found[k.lower()] = str(v).lower() if isinstance(v, bool) else str(v)
    if isinstance(value, dict):
        kind, text = str(value.get("Type", "")).upper(), value.get("Text")
        for name, part in (("@mobile", "SMS"), ("@email", "EMAIL"), ("@oob", "OUTOFBAND")):
            if text and part in kind:
                found.setdefault(name, str(text))
                found[f"{name}:last"] = str(text)


#: What can stand in JSON between values, and the scalars themselves; a string that isn't closed ends the text.
_PART = re.compile(r'\s*(?:([{}\[\]:,])|"((?:[^"\\]|\\.)*)"|(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)(?=[\s,}\]]))', re.S)


def recovered(text: str) -> dict[str, object]:
    """Complete scalars of a JSON document by path ($.a.b[2]), however early it is cut off.

    Open strings, arrays and objects count as closed where the text ends; what was complete before stays at its place. A
    number or word is complete once something follows it. Reading ends at the first thing that is no JSON.
    """
    found: dict[str, object] = {}
    stack: list[list] = []  # [path, next index or None for an object, waiting key]
    at = 0

    def value_path() -> str:
        if not stack:
            return "$"
        path, index, key = stack[-1]
        return f"{path}[{index}]" if index is not None else f"{path}.{key}"

    while (m := _PART.match(text, at)) is not None:
        at = m.end()
        sign, quoted, bare = m.groups()
        if sign in ("{", "["):
            stack.append([value_path(), 0 if sign == "[" else None, None])
        elif sign in ("}", "]"):
            if not stack:
                break
            stack.pop()
        elif sign == ",":
            if stack and stack[-1][1] is not None:
                stack[-1][1] += 1
            elif stack:
                stack[-1][2] = None
        elif sign is None:
            try:
                value = json.loads(f'"{quoted}"' if quoted is not None else bare, strict=False)
            except ValueError:
                break
            if stack and stack[-1][1] is None and stack[-1][2] is None:
                if quoted is None:
                    break
                stack[-1][2] = value
            else:
                found[value_path()] = value
    return found


_PAIR = re.compile(r'"(\w+)"\s*:\s*(?:"((?:[^"\\]|\\.)*)"|(-?[\w.]+))')


_MESSAGE = re.compile(r"<(Msg|EmailMsg)>.*?(?:</\1>|$)", re.S)
_NAKED = re.compile(r"&(?!amp;|lt;|gt;|quot;|apos;|#\d+;|#x[0-9A-Fa-f]+;)")
_ELEMENT = re.compile(r"<(\w+)>([^<]*)</\1>", re.I)


def tree(element) -> object:
    """An element's text, or its children by tag; a tag that repeats has a list."""
    if not len(element):
        return (element.text or "").strip()
    out: dict = {}
    for child in element:
        if child.tag not in out:
            out[child.tag] = tree(child)
        elif isinstance(out[child.tag], list):
            out[child.tag].append(tree(child))
        else:
            out[child.tag] = [out[child.tag], tree(child)]
    return out


def read_xml(text: str) -> tuple[str | None, str | None, dict[str, str]]:
    """How the first message in a text was read (xml, regex or None), its tree as JSON, and texts by lower-cased tag, the first of each."""
    found = _MESSAGE.search(text)
    if not found:
        return None, None, {}
    raw, tags = _NAKED.sub("&amp;", found[0]), {}
    try:
        root = ElementTree.fromstring(raw)
        for e in root.iter():
            if not len(e) and (e.text or "").strip():
                tags.setdefault(e.tag.lower(), e.text.strip())
        return "xml", json.dumps(tree(root), ensure_ascii=False), tags
    except ElementTree.ParseError:
        for name, value in _ELEMENT.findall(raw):
            if value.strip():
                tags.setdefault(name.lower(), html.unescape(value).strip())
        return "regex", None, tags


#: What references, objects and XML begin with, and the blank that becomes a usual one; a message without any holds no payload and is its own text.
_SIGN = re.compile("[&{<\u00a0]")


def _scan(message: str | None) -> dict:
    if message is None or not _SIGN.search(message):
        return {"text": message, "status": None, "objects": [], "fields": {}, "paths": {}, "method": None, "document": None, "tags": {}}
    text = html.unescape(message).replace("\u00a0", " ")
    objects, fields, paths, status = [], {}, {}, None
    for raw, closed in balanced(text):
        try:
            leaves(json.loads(raw), fields)
            kind = "parsed"
        except ValueError:
            kind = "invalid" if closed else "incomplete"
            paths |= {p: v if isinstance(v, str) else json.dumps(v) for p, v in recovered(raw).items() if v is not None and p not in paths}
            for k, quoted, bare in _PAIR.findall(raw):
                if (v := quoted or bare) and v != "null":
                    fields.setdefault(k.lower(), v)
        objects.append({"status": kind, "raw": raw})
        status = kind if status in (None, "parsed") else status
    method, document, tags = read_xml(text)
    return {"text": text, "status": status, "objects": objects, "fields": fields, "paths": paths, "method": method, "document": document, "tags": tags}


_TEXT, _MAP = T.StringType(), T.MapType(T.StringType(), T.StringType())
_OBJECT = T.StructType([T.StructField("status", _TEXT), T.StructField("raw", _TEXT)])
PAYLOAD = T.StructType(
    [
        T.StructField("text", _TEXT),
        T.StructField("status", _TEXT),
        T.StructField("objects", T.ArrayType(_OBJECT)),
        T.StructField("fields", _MAP),
        T.StructField("paths", _MAP),
        T.StructField("method", _TEXT),
        T.StructField("document", _TEXT),
        T.StructField("tags", _MAP),
    ]
)


_PA_MAP = pa.map_(pa.string(), pa.string())
_PA_OBJECTS = pa.list_(pa.struct([("status", pa.string()), ("raw", pa.string())]))
_PA = {"text": pa.string(), "status": pa.string(), "objects": _PA_OBJECTS, "fields": _PA_MAP, "paths": _PA_MAP, "method": pa.string(), "document": pa.string(), "tags": _PA_MAP}


@F.arrow_udf(PAYLOAD)
def payload(text: pa.Array) -> pa.Array:
    """A message without references of HTML, and all that is in it.

    Its objects with their status, scalars by lower-cased key (of broken objects by pattern, and by path as far as they are whole), and of its XML message how it
    was read, the tree as JSON, and texts by lower-cased tag.
    """
    found = [_scan(t) for t in text.to_pylist()]
    columns = [pa.array([list(x[n].items()) if kind is _PA_MAP else x[n] for x in found], kind) for n, kind in _PA.items()]
    return pa.StructArray.from_arrays(columns, list(_PA))


@F.pandas_udf(T.StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    """All named and numeric entities of HTML, for texts beyond the five of XML."""
    return text.map(lambda t: None if t is None else html.unescape(t))

"""Text scalars as Column expressions: masks, escapes, observables, key=value pairs, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.payloads import unescape_html

#: What is picked out of any message, by name.
OBSERVABLES = {
    "urls": r"https?://[^\s<>\"']+",
    "emails": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "mobiles": r"\+\d{7,15}",
    "ips": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "cards": r"\b(?:[Xx]{4,}|\*{4,})\d{4}\b",
    "uuids": r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    "http_statuses": r"(?i)\bHTTP\s+\d{3}\b",
    "error_codes": r"(?i)\bError code:\s*[A-Za-z0-9_\-]+",
    "queues": r"\bAFS\.[A-Za-z0-9._\-]+",
    "message_ids": r"(?i)\bMsgId:\s*[A-Za-z0-9\-]+",
}
#: Parameters that are masked in reports.
MASKED_KEYS = ("cardno", "cardnumber", "pan", "otp", "mobile", "email", "password", "cvv")


#: What a text holds, in lower case, where there is anything to find; patterns are tried on such texts alone.
SIGNS_OF = {"urls": ("://",), "emails": ("@",), "mobiles": ("+",), "ips": (".",), "cards": ("xxxx", "****"), "uuids": ("-",), "http_statuses": ("http",), "error_codes": ("error code:",), "queues": ("afs.",), "message_ids": ("msgid:",)}


def observables(text: Column) -> Column:
    """A struct of arrays of distinct finds, in order."""
    none = F.when(text.isNotNull(), F.array().cast("array<string>"))
    finds = {name: F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0))) for name, p in OBSERVABLES.items()}
    return F.struct(*[F.when(contains_any(F.lower(text), *SIGNS_OF[name]), x).otherwise(none).alias(name) for name, x in finds.items()])


def mask(text: Column) -> Column:
    """The first and last four characters with stars between; stars alone for eight or fewer."""
    n = F.length(text)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(text, F.lit(4)), F.repeat(F.lit("*"), n - 8), F.right(text, F.lit(4))))


def clean(text: Column) -> Column:
    """Without NUL and byte order marks, and trimmed."""
    # Texts hold them rarely; a search for a character is cheaper than a look at each.
    for char in ("\x00", "\ufeff"):
        text = F.replace(text, F.lit(char), F.lit(""))
    return F.trim(text, F.lit(" \t\r\n\x0b\f"))


def unescape_entities(text: Column) -> Column:
    """The five XML entities and the usual blank; ampersands last, so that nothing is unescaped twice."""
    out = text
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def unescape_all(text: Column) -> Column:
    """All references of HTML, named and numeric; the non-breaking blank becomes a usual one, as patterns take it for a blank."""
    return F.replace(unescape_html(text), F.lit("\u00a0"), F.lit(" "))


def repair_ampersands(xml: Column) -> Column:
    """Naked ampersands as entities."""
    return F.regexp_replace(xml, r"&(?!amp;|lt;|gt;|quot;|apos;|#\d+;|#x[0-9A-Fa-f]+;)", "&amp;")


def tag(xml: Column, name: str) -> Column:
    """The text of the first such element; null where there is none or it is empty."""
    return F.nullif(clean(unescape_all(F.regexp_extract(xml, rf"(?is)<{name}>(.*?)</{name}>", 1))), F.lit(""))


def last_pairs(keys: Column, values: Column) -> Column:
    """A map of parallel arrays; of equal keys the last counts, whatever the session's policy is."""
    pairs = F.arrays_zip(keys.alias("key"), values.alias("value"))
    names = F.transform(pairs, lambda x: x["key"])
    return F.map_from_entries(F.filter(pairs, lambda x, i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names) - i - 1, F.lit(0))), x["key"])))


def pairs_of(text: Column, pattern: str, trimmed: bool = True) -> Column:
    """Key and value of every match of a pattern with two groups."""
    keys, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return last_pairs(keys, F.transform(values, clean) if trimmed else values)


def parameters(text: Column) -> Column:
    """key=value pairs between commas."""
    return pairs_of(text, r"(\w+)\s*=\s*([^,]*)")


def loose_pairs(text: Column) -> Column:
    """key=value pairs between blanks: a value reaches to the next key or to the end."""
    return pairs_of(text, r"(\w+)\s*=\s*(.*?)(?=\s+\w+\s*=|$)")


def base64_text(text: Column) -> Column:
    """Decoded text of base64, padded if need be; null where it is none, or under nine tenths are printable."""
    padded = F.concat(text, F.repeat(F.lit("="), F.pmod(-F.length(text), F.lit(4))))
    valid = padded.rlike(r"^[A-Za-z0-9+/]+={0,2}$")
    plain = F.decode(F.when(valid, F.try_to_binary(padded, F.lit("base64"))), "UTF-8")
    printable = F.length(F.regexp_replace(plain, r"[^\P{C}\r\n\t]", ""))
    return clean(F.when(printable >= 0.9 * F.length(plain), plain))


def otp_message(text: Column) -> Column:
    """What a one-time password's message says: otp, card, merchant, currency, amount."""
    pattern = r"(?is)(\d{4,8})\s+is\s+your\s+OTP.*?\bcard\s+([Xx*]+\d{4})\s+at\s+(.*?)\s+for\s+([A-Za-z]{3})\s+(\d+(?:\.\d+)?)\."
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    return F.struct(part(1).alias("otp"), part(2).alias("masked_card"), clean(part(3)).alias("merchant"), F.upper(part(4)).alias("currency"), part(5).try_cast("double").alias("amount"))


def contains_any(text: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


#: What a URL's path says about the operation that it calls.
OPERATIONS = (("setup-request", "SETUP_REQUEST"), ("otp-request", "OTP_REQUEST"))


def operation(url: Column) -> Column:
    """The operation that a URL calls; UNKNOWN for others, null without a URL."""
    out = F.when(url.isNull() | (url == ""), F.lit(None).cast("string"))
    for part, name in OPERATIONS:
        out = out.when(F.contains(F.lower(url), F.lit(part)), name)
    return out.otherwise("UNKNOWN")


#: A frame of a stack trace: method, and file and line where they are known.
_FRAME = r"^\s*at\s+(.+?)(?:\s+in\s+(.+?):line\s+(\d+))?\s*$"
_EXCEPTION = r"((?:System\.)?[A-Za-z][A-Za-z0-9_.]*(?:Exception|Error))\s*:\s*([^\n]+)"


def exception(text: Column) -> Column:
    """Type, message, frames (method, file, line) and the lines that are no frames; null where there is neither type nor frame."""
    follows = F.split(text, "\n")
    part = lambda x, i: F.nullif(F.trim(F.regexp_extract(x, _FRAME, i)), F.lit(""))
    frames = F.transform(F.filter(follows, lambda x: x.rlike(_FRAME)), lambda x: F.struct(part(x, 1).alias("method"), part(x, 2).alias("file"), part(x, 3).try_cast("int").alias("line")))
    kind = F.nullif(F.regexp_extract(text, _EXCEPTION, 1), F.lit(""))
    said = F.nullif(F.trim(F.regexp_extract(text, _EXCEPTION, 2)), F.lit(""))
    others = F.filter(F.slice(follows, 2, F.greatest(F.size(follows) - 1, F.lit(0))), lambda x: ~x.rlike(_FRAME))
    # Most texts hold neither word nor frame, so their lines aren't looked at.
    likely = contains_any(text, "Exception", "Error") | text.rlike(r"(?:^|\n)\s*at\s")
    found = likely & (text.rlike(_EXCEPTION) | F.exists(follows, lambda x: x.rlike(_FRAME)))
    return F.when(found, F.struct(kind.alias("type"), said.alias("message"), frames.alias("frames"), others.alias("additional_lines")))


#: Signs that exported logs escape.
SIGNS = (("\\>", ">"), ("\\<", "<"), ("\\[", "["), ("\\]", "]"))


def plain_signs(text: Column) -> Column:
    """Escaped signs as themselves: arrows, tags and brackets. What JSON escapes stays."""
    for escaped, char in SIGNS:
        text = F.replace(text, F.lit(escaped), F.lit(char))
    return text


def plain_escapes(text: Column) -> Column:
    """Escapes that loggers add: signs as themselves, \\" as the quote, \\n, \\r and \\t as white space."""
    out = plain_signs(text)
    for escaped, char in (('\\"', '"'), ("\\r\\n", "\n"), ("\\n", "\n"), ("\\t", "\t")):
        out = F.replace(out, F.lit(escaped), F.lit(char))
    return out


def phase(tracker: Column) -> Column:
    """The step that a tracker's prefix stands for."""
    prefix = F.upper(F.left(tracker, F.lit(2)))
    return F.when(tracker.isNull(), "UNKNOWN").when(prefix == "SU", "STEP_UP").when(prefix == "IA", "INITIATE_ACTION").when(prefix == "VL", "VALIDATE").otherwise(prefix)

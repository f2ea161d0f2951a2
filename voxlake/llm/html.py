"""Tags and text of HTML, by one scan."""

from __future__ import annotations

import html as _html
import re

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<!doctype[^>]*+>|<\?[^>]*+>"
    r"|<(/?[a-z][a-z0-9:-]*+)(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<(/?[a-z][a-z0-9:-]*+)[^>]*+>",
    re.S | re.I,
)
_BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def tokens(html: str) -> list[tuple[str, str]]:
    """(tag, text behind it) in order; the first has the tag "". Tags are in lower case, an end tag with a slash.

    Comments, doctypes and what scripts and styles hold are left out: they are tags named "!".
    """
    parts = _TAG.split(html)
    out = [("", parts[0])]
    for k in range(1, len(parts), 4):
        name = parts[k + 1] or parts[k + 2]
        out.append((name.lower() if name else "!", parts[k + 3]))
    return out


def tidy(text: str) -> str:
    """Character references resolved and white space collapsed, but for one line break a run that has any."""
    if "&" in text:
        text = _html.unescape(text)
    if "\n" not in text:
        return " ".join(text.split())
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def plain_text(html: str) -> str:
    """What a reader sees, a line for each block."""
    out = []
    for tag, text in tokens(html):
        if tag.lstrip("/") in _BLOCK:
            out.append("\n")
        out.append(text.replace("\n", " ") if "\n" in text else text)
    return tidy("".join(out))


def title(html: str) -> str:
    at = html.lower().find("<title")
    if at < 0:
        return ""
    found = re.match(r"<title[^>]*>(.*?)(?:</title|\Z)", html[at:], re.S | re.I)
    return tidy(found[1]).replace("\n", " ") if found else ""

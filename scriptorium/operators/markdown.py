"""Block structure of markdown with places in the source, and the plain text of blocks.

Follows CommonMark with tables and YAML front matter as far as top-level blocks go; what
is nested in lists and quotes only matters for its plain text.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import yaml


@dataclass(frozen=True)
class Block:
    kind: str  # heading, code, html, rule, list, quote, table, definition, paragraph, yaml
    start: int
    end: int
    text: str
    depth: int = 0


_LINE = re.compile(r"[^\n\r]*(?:\r\n|\n|\r|\Z)")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})[ \t]*([^`\n]*|(?<=~).*)$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_QUOTE = re.compile(r"^ {0,3}>")
_ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|$)")
_HTML = re.compile(r"^ {0,3}<(?:!--|\?|![A-Za-z]|!\[CDATA\[|/?[A-Za-z][A-Za-z0-9-]*(?=[\s/>]|$))")
_DEFINITION = re.compile(r"^ {0,3}\[[^\]]+\]:[ \t]*\S+")
_DELIMITER = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


def _lines(source: str) -> list[tuple[int, str]]:
    """(offset, text without its line break) of each line."""
    out, at = [], 0
    while at < len(source):
        m = _LINE.match(source, at)
        out.append((at, m.group().rstrip("\r\n")))
        at = m.end()
    return out


def front_matter(source: str) -> tuple[dict, int]:
    """The YAML mapping at the head of a file, and where the body begins."""
    m = re.match(r"---[ \t]*\r?\n(?:(.*?)\r?\n)?---[ \t]*(?:\r?\n|\Z)", source, re.S)
    if not m:
        return {}, 0
    try:
        data = yaml.safe_load(m.group(1) or "")
    except yaml.YAMLError as e:
        raise ValueError(f"Invalid front matter: {e}") from e
    return (data if isinstance(data, dict) else {}), m.end()


def blocks(source: str) -> list[Block]:
    """Top-level blocks in order."""
    out: list[Block] = []
    _, body = front_matter(source)
    if body:
        out.append(Block("yaml", 0, len(source[:body].rstrip()), ""))
    rows = [(o, t) for o, t in _lines(source) if o >= body]
    i = 0

    def blank(k: int) -> bool:
        return not rows[k][1].strip()

    def spot(k: int) -> int:
        return rows[k][0] + len(rows[k][1]) - len(rows[k][1].lstrip())

    def close(k: int) -> int:
        return rows[k][0] + len(rows[k][1].rstrip())

    while i < len(rows):
        line = rows[i][1]
        if blank(i):
            i += 1
            continue
        first = i
        if m := _ATX.match(line):
            out.append(Block("heading", spot(i), close(i), inline(m.group(2) or ""), len(m.group(1))))
            i += 1
        elif m := _FENCE.match(line):
            mark = m.group(2)
            i += 1
            while i < len(rows) and not re.match(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", rows[i][1]):
                i += 1
            last = min(i, len(rows) - 1)
            inner = [re.sub(rf"^ {{0,{len(m.group(1))}}}", "", t) for _, t in rows[first + 1 : i]]
            i += 1
            out.append(Block("code", spot(first), close(last), "\n".join(inner)))
        elif line.startswith(("    ", "\t")):
            while i < len(rows) and (blank(i) or rows[i][1].startswith(("    ", "\t"))):
                i += 1
            while blank(i - 1):
                i -= 1
            out.append(Block("code", rows[first][0] + 4 * line.startswith("    ") + line.startswith("\t"), close(i - 1), "\n".join(re.sub(r"^(?: {1,4}|\t)", "", t) for _, t in rows[first:i])))
        elif _RULE.match(line):
            out.append(Block("rule", spot(i), close(i), ""))
            i += 1
        elif _QUOTE.match(line):
            while i < len(rows) and not blank(i) and (_QUOTE.match(rows[i][1]) or not _begins(rows[i][1])):
                i += 1
            inner = "\n".join(re.sub(r"^ {0,3}> ?", "", t) for _, t in rows[first:i])
            out.append(Block("quote", spot(first), close(i - 1), "".join(b.text for b in blocks(inner))))
        elif m := _ITEM.match(line):
            i = _list_end(rows, i)
            out.append(Block("list", spot(first), close(i - 1), _list_text([t for _, t in rows[first:i]])))
        elif _HTML.match(line):
            stop = next((e for s, e in (("<!--", "-->"), ("<?", "?>"), ("<![CDATA[", "]]>")) if line.lstrip().startswith(s)), None)
            if stop:
                while i < len(rows) and stop not in rows[i][1]:
                    i += 1
                i = min(i + 1, len(rows))
            else:
                while i < len(rows) and not blank(i):
                    i += 1
            out.append(Block("html", spot(first), close(i - 1), source[spot(first) : close(i - 1)]))
        elif _DEFINITION.match(line):
            out.append(Block("definition", spot(i), close(i), ""))
            i += 1
        elif "|" in line and i + 1 < len(rows) and _DELIMITER.match(rows[i + 1][1]) and "-" in rows[i + 1][1] and ("|" in rows[i + 1][1]):
            while i < len(rows) and not blank(i) and not (i > first + 1 and _begins(rows[i][1])):
                i += 1
            cells = [c for k, (_, t) in enumerate(rows[first:i]) if k != 1 for c in re.split(r"(?<!\\)\|", t.strip().strip("|"))]
            out.append(Block("table", spot(first), close(i - 1), "".join(inline(c.strip()) for c in cells)))
        else:
            i += 1
            depth = 0
            while i < len(rows) and not blank(i):
                if m := _SETEXT.match(rows[i][1]):
                    depth = 1 if m.group(1)[0] == "=" else 2
                    i += 1
                    break
                if _begins(rows[i][1]):
                    break
                i += 1
            text = "\n".join(t.strip() for _, t in rows[first : i - 1 if depth else i])
            out.append(Block("heading" if depth else "paragraph", spot(first), close(i - 1), inline(text), depth))
    return out


def _begins(line: str) -> bool:
    """Whether a line ends the paragraph before it."""
    item = _ITEM.match(line)
    return bool(_ATX.match(line) or _FENCE.match(line) or _RULE.match(line) or _QUOTE.match(line) or (_HTML.match(line) and not re.match(r"^ {0,3}</?(?:a|b|i|em|strong|code|span|br|img|kbd|sub|sup)\b", line)) or (item and line[item.end() :].strip() and item.group(2) in ("-", "+", "*", "1.", "1)")))


def _list_end(rows: list[tuple[int, str]], i: int) -> int:
    """Behind the last line of the list that begins at i."""
    mark = _ITEM.match(rows[i][1])
    family = mark.group(2)[-1] if mark.group(2)[0].isdigit() else mark.group(2)
    width, k, end = mark.end(), i + 1, i + 1
    while k < len(rows):
        line = rows[k][1]
        if not line.strip():
            k += 1
            continue
        item = _ITEM.match(line)
        indent = len(line) - len(line.lstrip())
        if item and indent < 4 and not _RULE.match(line):
            if (item.group(2)[-1] if item.group(2)[0].isdigit() else item.group(2)) != family and indent < min(width, 2):
                break
            width = item.end() if indent < width else width
        elif indent >= min(width, 2 if not mark.group(2)[0].isdigit() else 3):
            pass
        elif k == end and not _begins(line):  # a paragraph that goes on
            pass
        else:
            break
        k += 1
        end = k
    return end


def _list_text(lines: list[str]) -> str:
    items: list[list[str]] = []
    width = 0
    for t in lines:
        m = _ITEM.match(t)
        if m and (not items or len(t) - len(t.lstrip()) < max(width, 1)):
            width = m.end()
            items.append([re.sub(r"^\[[ xX]\] ", "", t[m.end() :])])
        else:
            items[-1].append(t[min(width, len(t) - len(t.lstrip())) :])
    return "".join("".join(b.text for b in blocks("\n".join(x))) for x in items)


_CODE_SPAN = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
_LINK = re.compile(r"!?\[((?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\](?:\([^()\s]*(?:\([^()]*\)[^()\s]*)?(?:\s+(?:\"[^\"]*\"|'[^']*'))?\)|\[[^\]]*\])")
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]*:[^\s<>]*|[^\s<>@]+@[^\s<>]+)>")
_STRONG = re.compile(r"(\*{1,3})(?=\S)(.+?)(?<=\S)\1", re.S)
_UNDER = re.compile(r"(?<![A-Za-z0-9_])(_{1,3})(?=\S)(.+?)(?<=\S)\1(?![A-Za-z0-9_])", re.S)
_STRIKE = re.compile(r"~~(?=\S)(.+?)(?<=\S)~~", re.S)


def inline(text: str) -> str:
    """Plain text of inline markdown."""
    kept: list[str] = []

    def keep(value: str) -> str:
        kept.append(value)
        return f"\0{len(kept) - 1}\0"

    text = _CODE_SPAN.sub(lambda m: keep(re.sub(r"^ (.*\S.*) $", r"\1", m.group(2).replace("\n", " "), flags=re.S)), text.replace("\0", "\ufffd"))
    text = _ESCAPE.sub(lambda m: keep(m.group(1)), text)
    text = _AUTO.sub(lambda m: keep(m.group(1)), text)
    for pattern, group in ((_LINK, 1), (_LINK, 1), (_STRONG, 2), (_STRONG, 2), (_UNDER, 2), (_STRIKE, 1)):
        text = pattern.sub(lambda m, g=group: m.group(g), text)
    text = html.unescape(re.sub(r"[ \t]+(?=\n)", "", text))
    return re.sub("\0(\\d+)\0", lambda m: kept[int(m.group(1))], text)


def first_title(source: str) -> str | None:
    """Trimmed text of the first top-level heading of depth 1, if it has any."""
    found = next((b.text.strip() for b in blocks(source) if b.kind == "heading" and b.depth == 1), "")
    return found or None

"""The readable text of a notebook, whatever form it is stored in."""

from __future__ import annotations

import html
import json
import re
import unicodedata

_ANSI = re.compile(r"\[[0-9;]{1,8}m")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|[nrt\"'])")
_PERCENT_MARK = re.compile(r"^# ?%%.*$", re.M)
_PERCENT_OUT = re.compile(r"^# -> ?(.*)\n?", re.M)
_COMMENT = re.compile(r"^[ \t]*#+[ \t]?", re.M)
_PROMPT = re.compile(r"^(?:In|Out) ?\[[ \d*]*\]:?", re.M)
_FENCE = re.compile(r"^[ \t]*```.*$", re.M)
_RENDERED_OUT = re.compile(r"^Out ?\[[ \d*]*\]:?[ \t]*((?:\n(?:    .*|[ \t]*))*)", re.M)
_JSON_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"')
#: Runs without a blank that are no words: encoded images and the like.
_BLOB = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/=]{120,}")


def _joined(x: object) -> str:
    if isinstance(x, list):
        return "".join(s for s in x if isinstance(s, str))
    return x if isinstance(x, str) else ""


def _notebook(text: str) -> tuple[str, str] | None:
    try:
        cells = json.loads(text)["cells"]
        sources, outputs = [], []
        for cell in cells:
            sources.append(_joined(cell.get("source")))
            for out in cell.get("outputs") or ():
                outputs.append(_joined(out.get("text")))
                for kind, data in (out.get("data") or {}).items():
                    if kind.startswith("text/"):
                        outputs.append(_joined(data))
                if out.get("traceback"):
                    outputs.append("\n".join(s for s in out["traceback"] if isinstance(s, str)))
                outputs.append(_joined(out.get("evalue")))
            for kinds in (cell.get("attachments") or {}).values():
                outputs += [_joined(v) for k, v in kinds.items() if k.startswith("text/")]
        return "\n".join(sources), "\n".join(outputs)
    except (ValueError, TypeError, KeyError, AttributeError, RecursionError):
        return None


def readable(text: str | None, fmt: str | None = None) -> tuple[str, str]:
    """(sources, outputs) of a notebook's cells in order, without the marks between cells.

    JSON that doesn't parse gives its string literals; any text is taken as script or
    Markdown if it isn't JSON, whatever ``fmt`` says. Null and empty texts give empty strings.
    """
    if not text:
        return "", ""
    if text.lstrip()[:1] == "{":
        parts = _notebook(text)
        if parts is None:
            parts = "\n".join(m.replace("\\n", "\n") for m in _JSON_STRING.findall(text)) or text, ""
        return parts
    outputs: list[str] = []

    def take(m: re.Match) -> str:
        outputs.append(m.group(1))
        return ""

    if "# -> " in text or "# %%" in text or "#%%" in text:
        text = _PERCENT_OUT.sub(take, text)
        text = _PERCENT_MARK.sub("", text)
        text = _COMMENT.sub("", text)
    if "In [" in text or "Out[" in text or "```" in text:
        text = _RENDERED_OUT.sub(lambda m: take(m) or "\n", text)
        text = _FENCE.sub("", _PROMPT.sub("", text))
    return text, "\n".join(outputs)


def _unescape(m: re.Match) -> str:
    code = m.group(1) or m.group(2)
    return chr(int(code, 16)) if code else " "


def unmarked(text: str) -> str:
    """``text`` without terminal codes, tags, entities, written-out escapes and long encoded runs."""
    if len(text) > 120:
        text = _BLOB.sub(" ", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "[" in text:
        text = _ANSI.sub("", text).replace("\x1b", "")
    return text


_WORD = re.compile(r"[\u3400-\u9fff\u3040-\u30ff]|[^\W_\u3400-\u9fff\u3040-\u30ff]+")
_DROPPED = re.compile("['\u2019\u2018\u02bc\u00b4\u00ad\u200b\u200c\u200d\u2060\ufeff]+")
_MARKS = re.compile(r"[\u0300-\u036f]+")


def plain_words(text: str) -> list[str]:
    """Words without case and accents; apostrophes join, an ideograph is a word of its own."""
    text = _DROPPED.sub("", text).casefold()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text)

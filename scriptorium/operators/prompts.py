"""Prompt templates: parsing, checking and rendering."""

from __future__ import annotations

import re
from collections.abc import Mapping

import yaml

from .markdown import front_matter

ROLES = ("user", "assistant")


class PromptError(ValueError):
    pass


def _text(value: object, name: str, needed: bool = False) -> str | None:
    if value is None and not needed:
        return None
    if not isinstance(value, str) or not value.strip():
        raise PromptError(f"{name} must be a non-empty string")
    return value.strip()


def _head(data: Mapping) -> dict:
    """Title, description and arguments."""
    out = {k: v for k in ("title", "description") if (v := _text(data.get(k), k))}
    args = data.get("arguments") or []
    if not isinstance(args, list):
        raise PromptError("arguments must be an array")
    out["arguments"] = []
    for a in args:
        if not isinstance(a, dict) or not isinstance(a.get("required", False), bool):
            raise PromptError("arguments[] must be objects")
        made = {"name": _text(a.get("name"), "arguments[].name", needed=True)}
        made |= {k: v for k in ("title", "description") if (v := _text(a.get(k), f"arguments[].{k}"))}
        out["arguments"].append(made | ({"required": a["required"]} if "required" in a else {}))
    return out


def _message(role: str, text: str) -> dict:
    return {"role": role, "content": {"type": "text", "text": text}}


def parse_markdown(text: str) -> dict:
    """Front matter, and the body as one message of the user."""
    data, body = front_matter(text)
    said = text[body:].strip()
    if not said:
        raise PromptError("prompt template body must be a non-empty string")
    return _head(data) | {"messages": [_message("user", said)]}


def parse_yaml(text: str) -> dict:
    data = yaml.safe_load(text)
    if not isinstance(data, dict):
        raise PromptError("prompt template yaml must be an object")
    messages = data.get("messages")
    if not isinstance(messages, list) or not messages:
        raise PromptError("messages must include at least one message")
    made = []
    for m in messages:
        content = m.get("content") if isinstance(m, dict) else None
        if not isinstance(content, dict) or m.get("role") not in ROLES or content.get("type") != "text":
            raise PromptError("messages[] need a role and text content")
        made.append(_message(m["role"], _text(content.get("text"), "messages[].content.text", needed=True)))
    return _head(data) | {"messages": made}


def parse(path: str, text: str) -> dict:
    return parse_yaml(text) if path.endswith(".yaml") else parse_markdown(text)


def render(prompt: Mapping, given: Mapping[str, str] | None = None) -> list[dict]:
    """Messages with {{name}} filled in, unescaped; a name that isn't given is empty, a required one an error."""
    given = given or {}
    missing = [a["name"] for a in prompt["arguments"] if a.get("required") and not given.get(a["name"])]
    if missing:
        raise PromptError(f"Missing required arguments: {', '.join(missing)}")
    fill = lambda t: re.sub(r"\{\{\{?\s*([\w.\-]+)\s*\}?\}\}", lambda m: str(given.get(m.group(1), "")), t)
    return [_message(m["role"], fill(m["content"]["text"])) for m in prompt["messages"]]

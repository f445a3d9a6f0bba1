"""Chat models: a protocol, a server's model, and one that follows a script."""

from __future__ import annotations

import json
from typing import Protocol, runtime_checkable
from urllib.request import Request, urlopen


@runtime_checkable
class ChatModel(Protocol):
    name: str

    def chat(self, messages: list[dict]) -> str: ...

    def chat_raw(self, messages: list[dict], tools: list[dict] | None = None, options: dict | None = None) -> dict: ...


class HttpChat:
    """A model of a server that takes {"model", "messages", "tools", "options"} and gives {"message"}. Options of a call go before those of the model, and these before its temperature."""

    def __init__(self, model: str, host: str = "http://localhost:11434", temperature: float = 0.2, options: dict | None = None, timeout: float = 600.0):
        self.name, self.model, self.host, self.timeout = f"http:{model}", model, host.rstrip("/"), timeout
        self.temperature, self.options = temperature, options or {}

    def request(self, messages: list[dict], tools: list[dict] | None = None, options: dict | None = None) -> dict:
        body = {"model": self.model, "messages": messages, "stream": False, "options": {"temperature": self.temperature} | self.options | (options or {})}
        return body | ({"tools": tools} if tools else {})

    def chat_raw(self, messages: list[dict], tools: list[dict] | None = None, options: dict | None = None) -> dict:
        data = json.dumps(self.request(messages, tools, options)).encode()
        with urlopen(Request(f"{self.host}/api/chat", data, {"Content-Type": "application/json"}), timeout=self.timeout) as r:
            return json.load(r)["message"]

    def chat(self, messages: list[dict]) -> str:
        return self.chat_raw(messages).get("content") or ""


def extraction_models(model: str, host: str = "http://localhost:11434") -> tuple[HttpChat, HttpChat]:
    """The model that extracts entities, greedy so that it says the same again, and the one that tries once more where it said nothing."""
    return HttpChat(model, host, 0.0, {"seed": 0, "num_predict": 4096}), HttpChat(model, host, 0.6, {"seed": 1, "num_predict": 4096})


class Scripted:
    """Replies of a list, one after the other, or of a function of the messages; keeps what it was asked."""

    name = "scripted"

    def __init__(self, replies):
        self.replies, self.asked = replies, []

    def chat_raw(self, messages: list[dict], tools: list[dict] | None = None, options: dict | None = None) -> dict:
        self.asked.append(list(messages))
        said = self.replies(messages) if callable(self.replies) else self.replies[len(self.asked) - 1]
        return dict(said) if isinstance(said, dict) else {"role": "assistant", "content": said}

    def chat(self, messages: list[dict]) -> str:
        return self.chat_raw(messages).get("content") or ""

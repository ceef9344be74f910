"""Providers behind HTTP: embeddings, and a language model that judges candidates."""

from __future__ import annotations

import json
import logging
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from docpool.operators.rerank import Candidate, parse_scores, request
from docpool.sources.embedding import by_index

log = logging.getLogger("docpool")

#: Environment variables that may hold the key, in the order in which they are looked up.
KEY_NAMES = ("DOCPOOL_API_KEY", "OPENAI_API_KEY")
EMBEDDINGS_URL = "https://api.openai.com/v1/embeddings"
CHAT_URL = "https://api.openai.com/v1/chat/completions"
#: What the judge is told; its answer is read by parse_scores.
TASK = 'Judge how well each candidate answers the query. Answer with JSON only: {"ranking": [{"id": "...", "score": 0.0 to 1.0}, ...]}, with one entry for every id.'


class ProviderError(RuntimeError):
    """A provider that does not answer as agreed."""


def api_key(names: Sequence[str] = KEY_NAMES, environment: Mapping[str, str] | None = None) -> str:
    """The first of the variables that is set and not empty."""
    environment = os.environ if environment is None else environment
    for name in names:
        if environment.get(name):
            return environment[name]
    raise ProviderError(f"none of {', '.join(names)} is set")


def post(url: str, payload: dict, key: str, timeout: float) -> dict:
    """The JSON that a provider answers with; its own message if it refuses."""
    body = json.dumps(payload, ensure_ascii=False).encode()
    asked = urllib.request.Request(url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})  # noqa: S310
    try:
        with urllib.request.urlopen(asked, timeout=timeout) as answer:  # noqa: S310
            return json.loads(answer.read())
    except urllib.error.HTTPError as e:
        text = e.read().decode("utf-8", "replace")
        try:
            text = json.loads(text)["error"]["message"]
        except (ValueError, KeyError, TypeError):
            pass
        raise ProviderError(f"status {e.code}: {text[:500]}") from e
    except (OSError, ValueError) as e:
        raise ProviderError(f"{url}: {e}") from e


Post = Callable[[str, dict, str, float], dict]


@dataclass
class RemoteEmbedder:
    """Vectors from a provider; batches, attempts and waits are embed_all's. A vector of another length than dim is an error."""

    key: str
    model: str
    dim: int
    timeout_seconds: float = 60
    url: str = EMBEDDINGS_URL
    post: Post = post

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        answer = self.post(self.url, {"model": self.model, "input": texts, "encoding_format": "float"}, self.key, self.timeout_seconds)
        if not isinstance(answer.get("data"), list):
            raise ProviderError("no vectors in the answer")
        vectors = by_index(answer["data"], len(texts))
        if wrong := next((len(v) for v in vectors if len(v) != self.dim), None):
            raise ProviderError(f"vectors of {wrong} elements, not {self.dim}")
        return vectors


@dataclass
class RemoteReranker:
    """Scores from a language model: one request for all candidates, no randomness, an answer in JSON."""

    key: str
    model: str
    timeout_seconds: float = 30
    url: str = CHAT_URL
    post: Post = post

    def scores(self, query: str, candidates: Sequence[Candidate]) -> list[float]:
        if not candidates:
            return []
        messages = [{"role": "system", "content": TASK}, {"role": "user", "content": request(query, candidates)}]
        payload = {"model": self.model, "messages": messages, "response_format": {"type": "json_object"}, "temperature": 0}
        answer = self.post(self.url, payload, self.key, self.timeout_seconds if self.timeout_seconds > 0 else 30)
        try:
            content = answer["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError) as e:
            raise ProviderError("no choices in the answer") from e
        try:
            scores, dropped = parse_scores(content, len(candidates))
        except ValueError as e:
            raise ProviderError(f"{e} (content={content[:500]!r})") from e
        if dropped:
            log.warning("rerank: ids that name no candidate: %s", ", ".join(dropped))
        return scores

"""Models behind one protocol, run in Arrow batches; the defaults need no network."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.functions import stories as st
from presswork.session import stash


class Provider(Protocol):
    name: str
    model_version: str

    def embed(self, text: str) -> list[float] | None: ...

    def synthesize(self, prompt: str) -> str: ...


class HashingProvider:
    """Deterministic stand-in: word hashes as a vector, and a text made of the prompt's sources."""

    name, model_version = "hashing", "1"

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, text: str) -> list[float] | None:
        vector = np.zeros(self.dim)
        for word in text.lower()[:8000].split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            vector[h % self.dim] += 1.0 if h >> 63 else -1.0
        size = np.linalg.norm(vector)
        return (vector / size).tolist() if size else None

    def synthesize(self, prompt: str) -> str:
        sources = [line.split("] ", 1) for line in prompt.splitlines() if line.startswith("[") and "] " in line]
        cited = [(head[1:], text) for head, text in sources]
        body = "\n\n".join(f"{text}[^{domain}]" for domain, text in cited)
        claims = [{"claimText": text, "attributedDomains": [domain]} for domain, text in cited]
        return json.dumps({"headline": prompt.splitlines()[0], "body": body, "sourceDomains": sorted({d for d, _ in cited}), "claimAttributions": claims})


class RemoteProvider:
    """A model behind a service. ``post`` (path, headers, payload, seconds) sends a JSON request and
    returns the JSON answer; it is handed in, so nothing here opens a connection."""

    name, model_version, chat_path, embed_path = "remote", "", "/chat", "/embed"
    seconds = {"synthesize": 300.0, "embed": 15.0}  # how long an answer may take
    embed_chars = 8000

    def __init__(self, post: Callable[[str, dict, dict, float], dict], model: str, embed_model: str | None = None, key: str | None = None, temperature: float = 0.3):
        self.post, self.model_version, self.embed_model, self.key, self.temperature = post, model, embed_model or model, key, temperature

    def headers(self) -> dict:
        return {"authorization": f"Bearer {self.key}"} if self.key else {}

    def chat_payload(self, prompt: str) -> dict:
        return {"model": self.model_version, "messages": [{"role": "user", "content": prompt}], "temperature": self.temperature, "stream": False}

    def answer_text(self, answer: dict) -> str:
        return answer["message"]["content"]

    def embed_payload(self, text: str) -> dict:
        return {"model": self.embed_model, "prompt": text}

    def answer_vector(self, answer: dict) -> list[float] | None:
        return answer.get("embedding")

    def synthesize(self, prompt: str) -> str:
        return self.answer_text(self.post(self.chat_path, self.headers(), self.chat_payload(prompt), self.seconds["synthesize"]))

    def embed(self, text: str) -> list[float] | None:
        return self.answer_vector(self.post(self.embed_path, self.headers(), self.embed_payload(text[: self.embed_chars]), self.seconds["embed"]))


class LocalChat(RemoteProvider):
    """A local server with its own chat and embedding calls."""

    name, chat_path, embed_path = "local-chat", "/api/chat", "/api/embeddings"

    def chat_payload(self, prompt: str) -> dict:
        return {"model": self.model_version, "messages": [{"role": "user", "content": prompt}], "stream": False, "options": {"temperature": self.temperature}}


class CompletionsApi(RemoteProvider):
    """A server, local or hosted, with the widespread chat-completions and embeddings calls."""

    name, chat_path, embed_path = "completions", "/v1/chat/completions", "/v1/embeddings"

    def answer_text(self, answer: dict) -> str:
        return answer["choices"][0]["message"]["content"]

    def embed_payload(self, text: str) -> dict:
        return {"model": self.embed_model, "input": text}

    def answer_vector(self, answer: dict) -> list[float] | None:
        return (answer.get("data") or [{}])[0].get("embedding")


class HostedCompletions(CompletionsApi):
    """The hosted form: JSON answers are asked for, and a key is needed."""

    name = "hosted-completions"

    def chat_payload(self, prompt: str) -> dict:
        return {**super().chat_payload(prompt), "response_format": {"type": "json_object"}}


class HostedMessages(RemoteProvider):
    """A hosted messages call whose answer is a list of parts. It has no vectors: articles that it
    serves are stored without one."""

    name, chat_path = "hosted-messages", "/v1/messages"

    def headers(self) -> dict:
        return {"x-api-key": self.key} if self.key else {}

    def chat_payload(self, prompt: str) -> dict:
        return {"model": self.model_version, "max_tokens": 8192, "messages": [{"role": "user", "content": prompt}]}

    def answer_text(self, answer: dict) -> str:
        return "".join(part["text"] for part in answer.get("content", []) if part.get("type") == "text")

    def embed(self, text: str) -> list[float] | None:
        return None


PROVIDERS = {"hashing": HashingProvider}
REMOTE = {p.name: p for p in (LocalChat, CompletionsApi, HostedCompletions, HostedMessages)}


def connected(name: str, post: Callable[[str, dict, dict, float], dict], **options: object) -> Callable[[], Provider]:
    """A maker of the named remote provider, to be given where a provider is asked for; calls that
    fail give no answer and no vector."""

    def make() -> Provider:
        model = REMOTE[name](post, **options)

        def guarded(call: Callable, missing: object) -> Callable:
            def run(text: str) -> object:
                try:
                    return call(text)
                except Exception:  # one call that fails must not end the batch; a missing answer fails its check
                    return missing

            return run

        model.synthesize, model.embed = guarded(model.synthesize, ""), guarded(model.embed, None)
        return model

    return make


def configured(settings: dict[str, str]) -> Provider:
    """The provider named by the settings, else by the environment, else the default."""
    return PROVIDERS[settings.get("llm_provider") or os.environ.get("PRESSWORK_PROVIDER") or "hashing"]()


def embed_udf(provider: Callable[[], Provider] = HashingProvider):
    """Scalar iterator UDF: one provider a worker, any number of batches."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embedded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = provider()
        for texts in batches:
            yield texts.map(lambda x: None if x is None else model.embed(x))

    return embedded


#: What a request says of the way its articles were chosen.
HINTS = {
    "topic": "articles of one topic from the last days", "headline": "articles found by a headline", "links": "articles that the reader chose",
    "compare": "say where these outlets differ", "freeform": "a question over several topics: say how they are connected, and where they are not",
}


def prompt(title: Column, articles: Column, mode: Column, cap: int = 8, size: int = 20_000, fields: tuple[str, ...] = ()) -> Column:
    """A request: the title, the mode with its hint, and one line a source, capped in number and
    length; ``fields`` of the articles (headline, time, author) stand in lines before their text."""
    hint = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in HINTS.items() for x in kv]), mode), F.lit(""))

    def source(a: Column) -> Column:
        said = [F.concat(F.lit(f"{f}: "), F.coalesce(a[f].cast("string"), F.lit("unknown")), F.lit("\n")) for f in fields]
        return F.concat(*said, F.lit("["), a["domain"], F.lit("] "), F.substring(F.regexp_replace(F.coalesce(a["body"], F.lit("")), r"\s+", " "), 1, size))

    return F.concat_ws("\n", title, F.concat(F.lit("mode: "), mode, F.lit(" - "), hint), F.lit("sources:"), F.array_join(F.transform(F.slice(articles, 1, cap), source), "\n"))


ANSWER = "headline string, deck string, body string, sourceDomains array<string>, claimAttributions array<struct<claimText:string,attributedDomains:array<string>>>, confidence double"


def _asked(requests: DataFrame, provider: Callable[[], Provider]) -> DataFrame:
    """(id, own, raw): each request answered once, written to the shared folder so that nothing asks again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "own": frame["own"], "raw": frame["prompt"].map(model.synthesize)})

    return stash(requests.select("id", "prompt", "own").mapInPandas(run, "id string, own array<string>, raw string"))


def _judged(asked: DataFrame) -> DataFrame:
    """(id, ok, answer): answers parsed and checked against the request's own sources."""
    a = st.parse_answer(F.col("raw"), ANSWER)
    cited = st.cited_domains(a["claimAttributions"], a["sourceDomains"])
    return asked.select("id", F.coalesce(F.size(st.failures(a["body"], cited, F.col("own"), F.col("own"))) == 0, F.lit(False)).alias("ok"), a.alias("answer"))


def synthesize(requests: DataFrame, provider: Callable[[], Provider] = HashingProvider, default_confidence: float = 0.0, retry: bool = True) -> DataFrame:
    """(id, ok, answer): each request (id, prompt, own array<string>) answered, parsed and checked;
    those that fail are asked once more. A model is called once a row, and once more for failures."""
    tried = _judged(_asked(requests, provider))
    if retry:
        failed = tried.where(~F.col("ok")).select("id")
        again = _judged(_asked(requests.join(failed, "id", "left_semi"), provider))
        tried = tried.where("ok").unionByName(again)
    answer = F.col("answer")
    filled = F.struct(
        F.coalesce(answer["headline"], F.lit("")).alias("headline"), answer["deck"].alias("deck"), answer["body"].alias("body"),
        F.coalesce(answer["sourceDomains"], F.array().cast("array<string>")).alias("source_domains"), answer["claimAttributions"].alias("claim_attributions"),
        F.coalesce(answer["confidence"], F.lit(default_confidence)).alias("confidence"),
    )
    return tried.select("id", "ok", filled.alias("answer"))

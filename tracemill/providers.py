"""Model and API calls behind small interfaces, with deterministic stand-ins.

A provider is made in each task by a factory, so clients and weights are loaded once per worker and never pickled.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import random
import time
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.text import FUSE_SYSTEM, FUSE_TEMPLATE, REFINE_SYSTEM, REFINE_TEMPLATE, REWRITE_SYSTEM, REWRITE_TEMPLATE


class TraceProvider(Protocol):
    """What the greedy fold asks for."""

    def rewrite(self, step: str, context: str) -> str: ...
    def fuse(self, first: str, second: str, context: str) -> str: ...
    def similarity(self, a: str, b: str) -> float: ...
    def logprob(self, prompt: str, thinking: str, answer: str) -> float: ...
    def count_tokens(self, text: str) -> int: ...


class FakeProvider:
    """A deterministic stand-in: words for tokens, word overlap for similarity, shorter texts for rewrites."""

    def rewrite(self, step, context):
        return " ".join(step.split()[: max(1, len(step.split()) // 2)])

    def fuse(self, first, second, context):
        return " ".join(dict.fromkeys((first + " " + second).split()))

    def similarity(self, a, b):
        x, y = set(a.split()), set(b.split())
        return len(x & y) / max(1, len(x | y))

    def logprob(self, prompt, thinking, answer):
        return -1.0 / (1 + len(set(thinking.split()) & set(answer.split())))

    def count_tokens(self, text):
        return len((text or "").split())


class ChatTraceProvider:
    """Rewriting and fusing by a chat client: ``chat(messages) -> text``. Tried ``retries`` times, ``delay`` seconds apart.

    The scores have no default: ``logprob(prompt, thinking, answer)`` and ``count_tokens(text)`` of the language model, ``similarity(a, b)`` of the encoder.
    """

    def __init__(self, chat: Callable[[list[dict]], str], logprob: Callable[[str, str, str], float], similarity: Callable[[str, str], float], count_tokens: Callable[[str], int], retries: int = 3, delay: float = 1.0):
        self.chat, self.retries, self.delay = chat, retries, delay
        self.logprob, self.similarity, self.count_tokens = logprob, similarity, count_tokens

    def _ask(self, system: str, user: str) -> str:
        return retrying(lambda: self.chat([{"role": "system", "content": system}, {"role": "user", "content": user}]), self.retries, lambda n: self.delay).strip()

    def rewrite(self, step, context):
        return self._ask(REWRITE_SYSTEM, REWRITE_TEMPLATE.format(step=step))

    def fuse(self, first, second, context):
        return self._ask(FUSE_SYSTEM, FUSE_TEMPLATE.format(first=first, second=second))


def chat_client(model: str, api_key: str, base_url: str = "https://api.openai.com/v1", max_tokens: int = 256, temperature: float = 0.0, timeout: float = 600.0) -> Callable[[list[dict]], str]:
    """``chat(messages) -> text`` over the chat-completions protocol, with the standard library only."""

    def chat(messages: list[dict]) -> str:
        body = json.dumps({"model": model, "messages": messages, "max_tokens": max_tokens, "temperature": temperature}).encode()
        asked = urllib.request.Request(f"{base_url.rstrip('/')}/chat/completions", body, {"Content-Type": "application/json", "Authorization": f"Bearer {api_key}"})
        with urllib.request.urlopen(asked, timeout=timeout) as answer:
            return json.load(answer)["choices"][0]["message"]["content"] or ""

    return chat


def load_factory(spec: str) -> Callable:
    """The function that ``package.module:name`` means: how a command line names its models."""
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def score_answers(df: DataFrame, make_provider: Callable[[], TraceProvider], prompt: str = "prompt", thinking: str = "thinking", answer: str = "answer") -> DataFrame:
    """Add ``logprob``, the mean log-probability of the answer behind prompt and thinking."""
    schema = T.StructType([*df.schema.fields, T.StructField("logprob", T.DoubleType())])

    def run(frames):
        provider = make_provider()
        for pdf in frames:
            yield pdf.assign(logprob=[float(provider.logprob(p, t, a)) for p, t, a in zip(pdf[prompt], pdf[thinking], pdf[answer])])

    return df.mapInPandas(run, schema)


def retrying(call: Callable[[], str], retries: int, pause: Callable[[int], float]) -> str:
    """The call's result; the last error once all tries have failed."""
    for n in range(1, retries + 1):
        try:
            return call()
        except Exception as failed:
            if n == retries:
                raise RuntimeError(f"failed after {retries} tries: {failed}") from failed
            time.sleep(pause(n))
    raise ValueError("at least one try is needed")


#: Rows and characters of made text that a task gathers before it hands them on.
GATHER_ROWS, GATHER_CHARS = 1000, 1 << 24


def generate(df: DataFrame, make_model: Callable[[], Callable[[list[str]], list[tuple[str, int]]]], batch_size: int = 32) -> DataFrame:
    """Add full_output, output_token_count and error to rows with a ``prompt``. A batch that fails marks its rows, which then leave gaps.

    The model maps prompts to (text, number of tokens). Prompts travel with their rows, so nothing is joined back. The other columns pass
    as they are, and results are handed on many batches at a time: a batch costs its call of the model, whatever its size.
    """
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL("full_output string, output_token_count long, error string").fields])

    def made_of(model, prompts: list[str]) -> list[tuple]:
        try:
            made = [(text, tokens, None) for text, tokens in model(prompts)]
            if len(made) != len(prompts):
                raise ValueError(f"{len(made)} results for {len(prompts)} prompts")
            return made
        except Exception as failed:
            return [(None, None, str(failed))] * len(prompts)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()
        for frame in frames:
            prompts, made, done, chars = frame.column("prompt").to_pylist(), [], 0, 0
            for a in range(0, len(prompts), batch_size):
                part = made_of(model, prompts[a : a + batch_size])
                made += part
                chars += sum(len(text or "") for text, _, _ in part)
                if len(made) >= GATHER_ROWS or chars >= GATHER_CHARS or a + batch_size >= len(prompts):
                    texts, tokens, errors = zip(*made)
                    kept = frame.slice(done, len(made)).columns
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(tokens, pa.int64()), pa.array(errors, pa.string())], schema.names)
                    done, made, chars = done + len(made), [], 0

    return df.mapInArrow(run, schema)


def refine(df: DataFrame, make_chat: Callable[[], Callable[[list[dict]], str]], question: str = "question", draft: str = "compressed_output", original: str = "original_output", retries: int = 3, delay: float = 2.0) -> DataFrame:
    """Add ``refined``. Waits longer after each failed try; a row that keeps failing fails the whole job, so nothing is written."""
    schema = T.StructType([*df.schema.fields, T.StructField("refined", T.StringType())])

    def run(frames):
        chat = make_chat()
        for pdf in frames:
            done = []
            for row in pdf.to_dict("records"):
                user = REFINE_TEMPLATE.format(question=row.get(question) or "", draft=row.get(draft) or "", original=row.get(original) or "")
                done.append(retrying(lambda: chat([{"role": "system", "content": REFINE_SYSTEM}, {"role": "user", "content": user}]), retries, lambda n: delay * n).strip())
            yield pdf.assign(refined=done)

    return df.mapInPandas(run, schema)


def token_counter(make_tokenizer: Callable[[], Callable[[str], int]]) -> Callable[[Column], Column]:
    """A column function that counts tokens in Arrow batches; the tokenizer is made once per worker."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = make_tokenizer()
        for texts in batches:
            yield texts.fillna("").map(tokenizer)

    return count


def encoder(make_model: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[Column], Column]:
    """A column function that embeds texts in Arrow batches; the model is made once per worker."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for texts in batches:
            yield pd.Series(list(np.asarray(model(texts.fillna("").tolist()), np.float32)))

    return encode


def attention(df: DataFrame, make_model: Callable[[], Callable[[str, int], np.ndarray]], text: str, target: str) -> DataFrame:
    """Add attention_row (array<double>), the attention of one token over a text; null when the model runs out of memory."""
    schema = T.StructType([*df.schema.fields, T.StructField("attention_row", T.ArrayType(T.DoubleType()))])

    def run(frames):
        model = make_model()
        for pdf in frames:
            rows = []
            for t, at in zip(pdf[text], pdf[target]):
                try:
                    rows.append([float(x) for x in model(t, int(at))])
                except MemoryError:
                    rows.append(None)
            yield pdf.assign(attention_row=rows)

    return df.mapInPandas(run, schema)


#: Tokens of a text that full attention is computed over; positions behind them are left as they are.
FULL_ATTENTION_TOKENS = 4096


def full_attention(df: DataFrame, make_model: Callable[[], Callable[[str, int], list]], text: str, most: int = FULL_ATTENTION_TOKENS) -> DataFrame:
    """Add ``attention``: layers of heads of square matrices over the text's first ``most`` tokens; null when the model runs out of memory."""
    kind = T.DoubleType()
    for _ in range(4):
        kind = T.ArrayType(kind)
    schema = T.StructType([*df.schema.fields, T.StructField("attention", kind)])

    def run(frames):
        model = make_model()
        for pdf in frames:
            made = []
            for t in pdf[text]:
                try:
                    made.append([[[[float(x) for x in row] for row in head] for head in layer] for layer in model(t, most)])
                except MemoryError:
                    made.append(None)
            yield pdf.assign(attention=made)

    return df.mapInPandas(run, schema)


def fake_embedding(text: str, dim: int = 16) -> np.ndarray:
    """A unit vector that depends on the text alone."""
    v = np.random.default_rng(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")).normal(size=dim)
    return (v / np.linalg.norm(v)).astype(np.float32)


def set_seed(seed: int) -> None:
    """Seed the generators a provider may use in this process."""
    random.seed(seed)
    np.random.seed(seed)

"""Interfaces for models, with deterministic stand-ins. The stand-ins have the operators' shape, not the scores of real models."""

from __future__ import annotations

import json
import re
import string
import urllib.error
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.arrow import small_batches, trim
from docloom.functions.text import Buckets

OFFLINE = "The language model is not available, so no answer was generated. The sources found are listed."


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class SentenceSplitter(Protocol):
    def split(self, text: str) -> list[str]: ...


class Reranker(Protocol):
    def predict(self, query: str, texts: list[str]) -> np.ndarray: ...


class PdfReader(Protocol):
    """What a PDF library must give: pages of a file, a file of some of its pages, and its markdown."""

    def pages(self, content: bytes) -> int: ...
    def cut(self, content: bytes, start: int, end: int) -> bytes: ...
    def markdown(self, content: bytes) -> str: ...


class Generator(Protocol):
    def ready(self) -> bool: ...
    def generate(self, prompt: str, limit: int, temperature: float) -> str: ...
    def stream(self, prompt: str, limit: int) -> Iterator[str]: ...


class HashedWords:
    """Bag of hashed words, normalised."""

    def __init__(self, dims: int = 64):
        self.dims, self.known = dims, Buckets(dims)

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        gone = str.maketrans("", "", string.punctuation)
        for row, text in zip(out, texts, strict=True):
            row[:] = np.bincount([self.known[t] for t in text.lower().translate(gone).split() if len(t) > 1], minlength=self.dims)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class PunctuationSplitter:
    """Cuts after . ! or ? and white space."""

    def split(self, text: str) -> list[str]:
        return [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]


def words_of(text: str) -> list[str]:
    return [t for t in text.lower().translate(str.maketrans("", "", string.punctuation)).split() if len(t) > 1]


class TokenCoverage:
    """Share of the query's distinct tokens that a text holds."""

    def predict(self, query: str, texts: list[str]) -> np.ndarray:
        asked = set(words_of(query))
        return np.array([len(asked & set(words_of(t))) / len(asked) if asked else 0.0 for t in texts])


def best_device() -> str:
    """Where a model should be loaded: the first GPU if PyTorch is installed and finds one."""
    try:
        import torch
    except ImportError:
        return "cpu"
    return "cuda" if torch.cuda.is_available() else "cpu"


def embedded(rows: DataFrame, embedder: Embedder, prefix: str = "passage: ", batch: int = 16) -> DataFrame:
    """rows with `embedding` of prefix + text; the model is loaded once a worker and fed `batch` texts at a time."""

    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            full = [prefix + (t or "") for t in texts]
            made = [embedder.encode(full[i : i + batch]) for i in range(0, len(full), batch)]
            yield pd.Series([v for m in made for v in m])
        trim()

    small_batches(rows.sparkSession)
    return rows.withColumn("embedding", encode("text"))


class NoModel:
    """Never ready; says so."""

    def ready(self) -> bool:
        return False

    def generate(self, prompt: str, limit: int, temperature: float) -> str:
        return OFFLINE

    def stream(self, prompt: str, limit: int) -> Iterator[str]:
        yield OFFLINE


class HttpGenerator:
    """A model server that takes {model, prompt, stream} and answers in JSON lines with `response` and `done`."""

    def __init__(self, url: str, model: str, timeout: float = 300):
        self.url, self.model, self.timeout = url.rstrip("/"), model, timeout

    def ready(self) -> bool:
        try:
            with urllib.request.urlopen(f"{self.url}/api/tags", timeout=5) as answer:
                return any(self.model in m.get("name", "") for m in json.load(answer).get("models", []))
        except (urllib.error.URLError, OSError, ValueError):
            return False

    def post(self, prompt: str, limit: int, temperature: float, stream: bool):
        body = {"model": self.model, "prompt": prompt, "stream": stream, "options": {"temperature": temperature, "num_predict": limit, "repeat_penalty": 1.05}}
        request = urllib.request.Request(f"{self.url}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
        return urllib.request.urlopen(request, timeout=self.timeout)

    def generate(self, prompt: str, limit: int, temperature: float) -> str:
        with self.post(prompt, limit, temperature, False) as answer:
            return json.load(answer).get("response", "")

    def stream(self, prompt: str, limit: int) -> Iterator[str]:
        with self.post(prompt, limit, 0.0, True) as answer:
            for line in answer:
                if line.strip():
                    part = json.loads(line)
                    yield part.get("response", "")
                    if part.get("done"):
                        return


def without_thoughts(text: str) -> str:
    return re.split("</think>", text)[-1].strip() if "<think>" in text and "</think>" in text else text.strip()

"""Scorers of (query, passage) pairs: what a re-ranking asks for, and two that answer.

A scorer travels to the tasks, so it must pickle; it loads what it needs on first use.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corvidex.plans.planner import ascii_fold


class ScorerUnavailable(RuntimeError):
    """The scorer cannot run here; a search then keeps its lexical order and says why."""


class Scorer(Protocol):
    name: str

    def check(self) -> None:
        """Raises ``ScorerUnavailable`` if scoring cannot work; called on the driver."""

    def score(self, query: str, texts: list[str]) -> list[float | None]:
        """A score per text, higher is better; None where a text was not scored."""


@dataclass
class OverlapScorer:
    """Share of the distinct query words found in the text: deterministic, needs no model."""

    name: str = "overlap"

    def check(self) -> None:
        pass

    def score(self, query: str, texts: list[str]) -> list[float | None]:
        words = set(re.findall(r"\w+", ascii_fold(query)))
        if not words:
            return [0.0] * len(texts)
        return [round(len(words & set(re.findall(r"\w+", ascii_fold(t)))) / len(words), 4) for t in texts]


@dataclass
class CrossEncoderScorer:
    """A local cross-encoder: ONNX weights and a tokenizer file in a folder that all tasks see.

    ``sha256`` names the digest of each file; a file that differs is refused.
    """

    folder: str
    sha256: dict[str, str]
    name: str = "cross-encoder"
    max_tokens: int = 512
    batch: int = 16
    _ready: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_ready": {}}

    def check(self) -> None:
        for file in ("model.onnx", "tokenizer.json"):
            path = os.path.join(self.folder, file)
            if not os.path.isfile(path):
                raise ScorerUnavailable(f"no {file} in {self.folder}")
            with open(path, "rb") as f:
                if hashlib.file_digest(f, "sha256").hexdigest() != self.sha256.get(file):
                    raise ScorerUnavailable(f"{file} is not the one expected")
        try:
            import onnxruntime  # noqa: F401
            import tokenizers  # noqa: F401
        except ImportError as x:
            raise ScorerUnavailable(str(x)) from x

    def _load(self) -> dict:
        if not self._ready:
            import onnxruntime
            import tokenizers

            tok = tokenizers.Tokenizer.from_file(os.path.join(self.folder, "tokenizer.json"))
            tok.enable_truncation(self.max_tokens, strategy="only_second")
            tok.enable_padding()
            self._ready.update(tok=tok, model=onnxruntime.InferenceSession(os.path.join(self.folder, "model.onnx"), providers=["CPUExecutionProvider"]))
        return self._ready

    def score(self, query: str, texts: list[str]) -> list[float | None]:
        import numpy as np

        ready, out = self._load(), []
        inputs = {i.name for i in ready["model"].get_inputs()}
        for i in range(0, len(texts), self.batch):
            made = ready["tok"].encode_batch([(query, t) for t in texts[i : i + self.batch]])
            feed = {"input_ids": [e.ids for e in made], "attention_mask": [e.attention_mask for e in made], "token_type_ids": [e.type_ids for e in made]}
            logits = ready["model"].run(None, {k: np.array(v, dtype=np.int64) for k, v in feed.items() if k in inputs})[0]
            out += [float(x) for x in np.asarray(logits).reshape(len(made), -1)[:, -1]]
        return out


def score_column(scorer: Scorer, query: str, text: Column) -> Column:
    """Scores of a text column, in Arrow batches, to four places; NULL where not scored."""

    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([None if x is None else round(x, 4) for x in scorer.score(query, b.tolist())], dtype="float64")

    return run(text)

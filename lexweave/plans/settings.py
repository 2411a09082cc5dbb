"""Settings of a model and of its training, checked when they are made."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from pathlib import Path

from lexweave.operators.quantize import swiglu_width


def _positive(settings, *names: str) -> None:
    for n in names:
        if getattr(settings, n) <= 0:
            raise ValueError(f"{n} must be positive, is {getattr(settings, n)}")


@dataclass(frozen=True)
class ModelSettings:
    vocab_size: int = 32_000
    hidden_size: int = 768
    num_layers: int = 12
    num_heads: int = 12
    num_kv_heads: int | None = None
    intermediate_size: int | None = None
    max_position_embeddings: int = 2048
    pad_token_id: int | None = None
    tie_word_embeddings: bool = True
    bias: bool = False

    def __post_init__(self):
        _positive(self, "vocab_size", "hidden_size", "num_layers", "num_heads", "max_position_embeddings")
        if self.hidden_size % self.num_heads:
            raise ValueError(f"{self.num_heads} heads don't divide {self.hidden_size}")
        if self.num_kv_heads is not None and (self.num_kv_heads <= 0 or self.num_heads % self.num_kv_heads):
            raise ValueError("heads must be a multiple of key heads")
        if self.intermediate_size is None:
            object.__setattr__(self, "intermediate_size", swiglu_width(self.hidden_size))
        _positive(self, "intermediate_size")
        if self.pad_token_id is not None and not 0 <= self.pad_token_id < self.vocab_size:
            raise ValueError("the pad token is not in the vocabulary")

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class TrainingSettings:
    max_steps: int
    gradient_accumulation_steps: int = 1
    max_grad_norm: float = 1.0
    log_every: int = 10
    eval_every: int = 100
    checkpoint_every: int = 500
    checkpoint_dir: str = "checkpoints/pretraining"
    keep_last_n_checkpoints: int = 3
    label_smoothing: float = 0.0
    warmup_steps: int = 0
    schedule: str = "cosine"

    def __post_init__(self):
        _positive(self, "max_steps", "gradient_accumulation_steps", "max_grad_norm")
        if not 0 <= self.label_smoothing < 1:
            raise ValueError("label_smoothing must be in [0, 1)")
        if not 0 <= self.warmup_steps <= self.max_steps or self.schedule not in ("cosine", "linear"):
            raise ValueError("bad schedule")

    def to_dict(self) -> dict:
        return asdict(self)


def read(path: str, kind: type):
    """Settings of a JSON or YAML file; ValueError on names that aren't known."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        raw = yaml.safe_load(text) or {}
    else:
        raw = json.loads(text)
    if unknown := set(raw) - set(kind.__dataclass_fields__):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return kind(**raw)

"""Typed configuration: tunables with defaults, and values read from properties files or a session."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

MAX_INT = 2_147_483_647
#: Added to every count before normalisation, share of a self-transition's penalty, extra weight of "other" emissions.
SMOOTHING, SELF_TRANSITION, OTHER_EMISSION = 0.1, -0.1, 1.0
#: Start weight of a segmentation that corefers with no record, and of one that does.
NO_RECORD, WITH_RECORD = -10.0, 0.0


@dataclass(frozen=True)
class Options:
    """Tunables of the linkage pipelines."""

    word_threshold: int = 1
    feature_threshold: int = 1
    threads: int = 1
    max_records: int = MAX_INT
    max_texts: int = MAX_INT
    seg_text_weight: float = 0.0
    coref_text_weight: float = 0.0
    step_mult: float = 1.0
    step_offset: float = 2.0
    step_power: float = 0.5
    sim_weight: float = 10.0
    inverse_variance: float = 1.0
    seed: int = 1
    batch_size: int = 10
    test_file: str = "labelled_citations.txt"
    test_share: float = 0.2
    eval_every: int = 1
    word_file: str = "words.vocab"
    word_feature_file: str = "word_features.vocab"
    feature_file: str = "features.vocab"
    constrained_learning: bool = False
    constrained_inference: bool = False
    ping_every: int = 100
    seg_gen_iterations: int = 5
    seg_disc_iterations: int = 100
    seg_kl_iterations: int = 100
    coref_gen_iterations: int = 10
    coref_disc_iterations: int = 20
    coref_kl_iterations: int = 0

    def step_size(self, t: int) -> float:
        """Step size of the t-th update (from 0)."""
        return self.step_mult / (t + self.step_offset) ** self.step_power

    @classmethod
    def from_flags(cls, argv: list[str]) -> Options:
        """Options from ``--name value`` or ``--group.name value`` pairs; unknown names raise."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        found = {}
        for flag, value in zip(argv[::2], argv[1::2], strict=True):
            name = flag.lstrip("-").rpartition(".")[2].replace("-", "_")
            if name not in kinds:
                raise KeyError(f"no option {name}")
            found[name] = value.lower() in ("true", "1", "yes") if kinds[name] is bool else kinds[name](value)
        return replace(cls(), **found)


class Settings:
    """Named values with typed access: ``name=value`` lines of a file, or a session's configuration under a prefix."""

    def __init__(self, values: dict[str, str]):
        self.values = values

    @classmethod
    def load(cls, *paths: str) -> Settings:
        """The first file that exists; none gives no values."""
        for path in paths:
            if os.path.exists(path):
                with open(path, encoding="utf-8") as f:
                    lines = [x.strip() for x in f]
                return cls({k.strip(): v.strip() for k, _, v in (x.partition("=") for x in lines if x and x[0] not in "#!")})
        return cls({})

    @classmethod
    def of_session(cls, spark: SparkSession, prefix: str = "reclink.") -> Settings:
        return cls({k.removeprefix(prefix): v for k, v in spark.sparkContext.getConf().getAll() if k.startswith(prefix)})

    def get(self, name: str, kind: type = str, default=None):
        """A value as ``kind`` (int, float, str, bool); a missing one without a default raises."""
        if name not in self.values:
            if default is None:
                raise KeyError(f"missing setting {name}")
            return default
        value = self.values[name]
        return value.lower() in ("true", "1", "yes") if kind is bool else kind(value)

    def get_list(self, name: str, kind: type = str, separator: str = ",") -> list:
        return [kind(x.strip()) for x in self.get(name).split(separator) if x.strip()]

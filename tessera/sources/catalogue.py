"""The pinned sources of the default mixture, and quota overrides."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from tessera.protocol import Invalid


@dataclass(frozen=True)
class SourceSpec:
    """One source: where it lies, its licence, how many target tokens it gives, and how it is read."""

    name: str
    dataset: str
    config: str | None
    split: str
    revision: str
    license: str
    quota: int
    adapter: str
    data_url: str | tuple[str, ...] | None = None
    columns: tuple[str, ...] | None = None

    @property
    def urls(self) -> tuple[str, ...]:
        return () if self.data_url is None else (self.data_url,) if isinstance(self.data_url, str) else self.data_url


def hub(dataset: str, revision: str, *files: str) -> tuple[str, ...]:
    return tuple(f"https://huggingface.co/datasets/{dataset}/resolve/{revision}/{f}" for f in files)


def shards(n: int) -> list[str]:
    return [f"data/train-{i:05d}-of-{n:05d}.parquet" for i in range(n)]


AGENTIC, MATH, CODE = "7c804833427f633ccd53b582dbf02525fd680f78", "e4e141ec9dea9f8326f4d347be56105859b2bd68", "8f3ba5bafe4d6e8db46082cf7ae6741bc370604d"
DEFAULT_SOURCES = (
    SourceSpec("ultrachat", "HuggingFaceH4/ultrachat_200k", None, "train_sft", "8049631c405ae6576f93f445c6b8166f76f5505a", "MIT", 3_500_000, "ultrachat"),
    SourceSpec("aya", aya := "CohereLabs/aya_dataset", "default", "train", rev := "f9ea04583f02a8f86404ff6c58bf75fe637df8a2", "Apache-2.0", 1_000_000, "aya", hub(aya, rev, *shards(1)), ("inputs", "targets")),
    SourceSpec("nemotron_agentic", agentic := "nvidia/Nemotron-SFT-Agentic-v2", None, "tool_calling", AGENTIC, "CC-BY-4.0 / Apache-2.0 / MIT", 2_810_000, "nemotron", hub(agentic, AGENTIC, "data/tool_calling.jsonl"), ("messages", "tools")),
    SourceSpec("hermes_func_calling", "NousResearch/hermes-function-calling-v1", "func_calling", "train", "dae3e1d28cfbcf4b915c04ea1e072030529b4bda", "Apache-2.0", 190_000, "hermes"),
    SourceSpec("openr1_math", math := "open-r1/OpenR1-Math-220k", "default", "train", MATH, "Apache-2.0", 1_000_000, "openr1", hub(math, MATH, *shards(10)), ("problem", "generations", "is_reasoning_complete", "correctness_math_verify", "correctness_llama", "answer")),
    SourceSpec("opencodeinstruct", code := "nvidia/OpenCodeInstruct", "train", "train", CODE, "CC-BY-4.0", 1_500_000, "opencode", hub(code, CODE, *shards(50)), ("average_test_score", "input", "output")),
)


def override_quotas(specs: tuple[SourceSpec, ...], options: list[str]) -> tuple[SourceSpec, ...]:
    """Quotas from ``NAME=INT`` options; unknown names and negative numbers are errors."""
    wanted: dict[str, int] = {}
    for option in options:
        name, eq, number = option.partition("=")
        if not eq or not number.strip().isdigit():
            raise Invalid(f"a quota is NAME=INT with INT from 0, not {option!r}")
        wanted[name] = int(number)
    if unknown := set(wanted) - {s.name for s in specs}:
        raise Invalid(f"no such source: {', '.join(sorted(unknown))}")
    return tuple(replace(s, quota=wanted.get(s.name, s.quota)) for s in specs)


def dimension(spark: SparkSession, specs: tuple[SourceSpec, ...] = DEFAULT_SOURCES) -> DataFrame:
    """The catalogue as a table."""
    rows = [(s.name, s.dataset, s.config, s.split, s.revision, s.license, s.quota, s.adapter, list(s.urls), list(s.columns or ())) for s in specs]
    return spark.createDataFrame(rows, "name string, dataset string, config string, split string, revision string, license string, quota bigint, adapter string, urls array<string>, columns array<string>")


def as_record(spec: SourceSpec) -> dict:
    return asdict(spec)

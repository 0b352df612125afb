"""Run configuration and prompt ingredients, read on the driver."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """The numbers that operators take, by their usual defaults."""

    rotation_interval: int = 50
    batch_size: int = 5
    mutate_ratio: float = 0.20
    window: int = 50
    threshold: float = 0.30
    mask_ratio: float = 0.15
    islands: int = 2
    migration_interval: int = 50
    migration_fraction: float = 0.10
    block_threshold: int = 10
    min_downstream: int = 5
    solver_interval: int = 100
    complexity_threshold: int = 4
    top_k: int = 10
    over_fetch: int = 4


def settings(nested: dict) -> Settings:
    """Settings from nested blocks; a name found in any block counts, unknown names are passed over."""
    known = {f.name for f in fields(Settings)}
    found: dict = {}
    todo = [nested]
    while todo:
        for k, v in todo.pop().items():
            if isinstance(v, dict):
                todo.append(v)
            elif k in known:
                found[k] = v
    return Settings(**found)


def load_settings(path: str) -> Settings:
    import yaml

    return settings(yaml.safe_load(Path(path).read_text()) or {})


def ingredients(docs: str | None = None, example: str | None = None, hand_written: str | None = None, **texts: str | None) -> dict[str, str | None]:
    """Documentation, example and hand-written prompt from files where they are given, other texts as they are."""
    read = lambda p: Path(p).read_text() if p else None
    return {"docstring": read(docs), "example_code": read(example), "hw_prompt": read(hand_written), "separator": texts.get("separator"), "begin": texts.get("begin"), "target_api": texts.get("target_api")}


def request(config: dict, previous: dict | None = None) -> dict:
    """The shape of a chat request; a previous one is used as it is."""
    if previous:
        return previous
    messages = [{"role": "system", "content": config["system"]}] if config.get("system") else []
    return {"model": config["model"], "max_tokens": config["max_tokens"], "temperature": config["temperature"], "messages": [*messages, {"role": "user", "content": config["prompt"]}]}


def best_prompt(path: str, make) -> str:
    """K9: what the file holds, or else what `make` gives, which is then written there."""
    p = Path(path)
    if not p.exists():
        p.write_text(make())
    return p.read_text()

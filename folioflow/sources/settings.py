"""Settings (TOML), glossary (YAML) and state (JSON), read on the driver."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from ..functions.glossary import Glossary


class ConfigError(ValueError):
    """A setting of the wrong type or out of range."""


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


def _number(value: object, low: float, high: float = float("inf")) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and low <= value <= high


@dataclass(frozen=True)
class TranslationSettings:
    model: str = "qwen2.5:7b-instruct-q4_K_M"
    target_language: str = "pt-BR"
    chunk_max_tokens: int = 800
    max_retries: int = 3
    temperature: float = 0.2

    def __post_init__(self):
        _check(isinstance(self.model, str) and self.model != "", "translation.model must be a non-empty string")
        _check(isinstance(self.target_language, str) and self.target_language != "", "translation.target_language must be a non-empty string")
        _check(isinstance(self.chunk_max_tokens, int) and _number(self.chunk_max_tokens, 1), "translation.chunk_max_tokens must be a positive integer")
        _check(isinstance(self.max_retries, int) and _number(self.max_retries, 1), "translation.max_retries must be a positive integer")
        _check(_number(self.temperature, 0, 2), "translation.temperature must be between 0 and 2")


@dataclass(frozen=True)
class OcrSettings:
    engine: str = "tesseract"
    languages: tuple[str, ...] = ("eng",)

    def __post_init__(self):
        _check(isinstance(self.engine, str) and self.engine != "", "ocr.engine must be a non-empty string")
        _check(len(self.languages) > 0 and all(isinstance(x, str) for x in self.languages), "ocr.languages must be a list of strings")


@dataclass(frozen=True)
class OutputSettings:
    default_dir: str = "~/Documentos"

    def __post_init__(self):
        _check(isinstance(self.default_dir, str) and self.default_dir != "", "output.default_dir must be a non-empty path")


@dataclass(frozen=True)
class Settings:
    translation: TranslationSettings = field(default_factory=TranslationSettings)
    ocr: OcrSettings = field(default_factory=OcrSettings)
    output: OutputSettings = field(default_factory=OutputSettings)


def load_settings(path: str | Path) -> Settings:
    """Settings of a TOML file; defaults for what it or the file lacks."""
    if not Path(path).is_file():
        return Settings()
    try:
        data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{path}: {e}") from e
    parts = {}
    for name, kind in (("translation", TranslationSettings), ("ocr", OcrSettings), ("output", OutputSettings)):
        section = data.get(name, {})
        _check(isinstance(section, dict), f"{name} must be a section")
        known = {f.name for f in fields(kind)}
        values = {k: tuple(v) if isinstance(v, list) else v for k, v in section.items() if k in known}
        parts[name] = kind(**values)
    return Settings(**parts)


def load_glossary(path: str | Path) -> Glossary:
    """Glossary of a YAML file: preservar, a list, and traduzir_como, a map, both in order."""
    import yaml

    if not Path(path).is_file():
        return Glossary()
    try:
        data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    except yaml.YAMLError as e:
        raise ConfigError(f"{path}: {e}") from e
    _check(isinstance(data, dict), "the glossary must be a map")
    kept, fixed = data.get("preservar") or [], data.get("traduzir_como") or {}
    _check(isinstance(kept, list) and all(isinstance(x, str) for x in kept), "preservar must be a list of strings")
    _check(isinstance(fixed, dict) and all(isinstance(x, str) for pair in fixed.items() for x in pair), "traduzir_como must map strings to strings")
    return Glossary(tuple(kept), dict(fixed))


def load_state(path: str | Path) -> dict:
    """User state; empty if the file is missing or damaged."""
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return data if isinstance(data, dict) else {}

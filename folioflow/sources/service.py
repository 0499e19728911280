"""A client of a language model's HTTP service, as the generator of translations.

It speaks plain JSON over three endpoints (models, generation, running models).
Errors have types, so that a caller can tell a service that is down from a model
that is missing. Instances travel to executors; each call opens its own
connection.
"""

from __future__ import annotations

import json
import socket
import urllib.error
import urllib.request
from dataclasses import dataclass, field
from typing import Any


class ServiceError(RuntimeError):
    """The service answered in a way that can't be used."""


class ServiceUnavailable(ServiceError):
    """The service can't be reached, or not in time."""


class ModelMissing(ServiceError):
    """The service doesn't have the model."""


# What a user is told before a run that can't succeed.
DOWN = "O serviço de tradução local (Ollama) não está em execução. Execute `./scripts/run.sh` no terminal para iniciar o serviço."
BROKEN = "Não foi possível conectar ao Ollama ({error}). Verifique se o serviço local está ativo via `./scripts/run.sh`."
NO_MODEL = "O modelo '{model}' não está instalado no Ollama local. Execute `./scripts/setup.sh` no terminal para baixar o modelo configurado."


@dataclass(frozen=True)
class HttpGenerator:
    """generate(prompt, system, temperature) through the service at base_url."""

    base_url: str
    model: str
    timeout: float = 60.0
    options: dict[str, Any] = field(default_factory=dict)

    def _call(self, path: str, payload: dict | None = None, timeout: float | None = None) -> dict:
        url = self.base_url if "://" in self.base_url else f"http://{self.base_url}"
        body = json.dumps(payload).encode() if payload is not None else None
        request = urllib.request.Request(url.rstrip("/") + path, body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout or self.timeout) as answer:
                got = json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if e.code == 404 and payload is not None:
                raise ModelMissing(f"model '{self.model}' not found at {self.base_url}") from e
            raise ServiceError(f"{path}: status {e.code}") from e
        except (urllib.error.URLError, socket.timeout, ConnectionError) as e:
            raise ServiceUnavailable(f"cannot connect to {self.base_url}: {e}") from e
        except ValueError as e:
            raise ServiceError(f"{path}: not JSON") from e
        if not isinstance(got, dict):
            raise ServiceError(f"{path}: not an object")
        return got

    def models(self) -> list[str]:
        return [m["name"] for m in self._call("/api/tags", timeout=10.0).get("models") or [] if m.get("name")]

    def generate(self, prompt: str, system: str, temperature: float) -> str:
        payload = {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": temperature} | self.options}
        return str(self._call("/api/generate", payload | ({"system": system} if system else {})).get("response", ""))

    def on_gpu(self) -> bool | None:
        """Whether a loaded model lies in the GPU's memory; None where none is loaded or the service is silent."""
        try:
            loaded = self._call("/api/ps", timeout=5.0).get("models") or []
        except ServiceError:
            return None
        return any((m.get("size_vram") or 0) > 0 for m in loaded) if loaded else None

    def preflight(self) -> tuple[bool, str]:
        """(ready, what to tell the user): before a run, whether the service is up and has the model, by name or but for the tag."""
        try:
            have = self.models()
        except ServiceUnavailable:
            return False, DOWN
        except ServiceError as e:
            return False, BROKEN.format(error=e)
        named = lambda m: m == self.model or m.split(":")[0] == self.model.split(":")[0]
        return (True, "") if not self.model or any(map(named, have)) else (False, NO_MODEL.format(model=self.model))

"""Settings that affect results. Built on the driver and turned into literals; executors read no environment."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields
from urllib.parse import urlsplit

SECRET_HINTS = ("api_key", "apikey", "authorization", "token", "secret", "password", "bearer")
REDACTED = "***redacted***"
#: Addresses that a provider's name stands for. Fixed values.
PRESETS = {"huggingface": "https://router.huggingface.co/v1"}


@dataclass(frozen=True)
class Settings:
    allowed_roots: tuple[str, ...] = ()
    max_file_mb: int = 50
    max_pages: int = 30
    max_image_pixels: int = 40_000_000
    max_output_chars: int = 100_000
    process_timeout_seconds: int = 120
    cache_enabled: bool = True
    cache_dir: str = ""
    cache_max_mb: int = 1024
    cache_ttl_days: int = 30
    ocr_backend: str = "tesseract"
    ocr_languages: str = "eng"
    vision_provider: str = "openai-compatible"
    vision_base_url: str = ""
    vision_api_key: str = ""
    vision_model: str = ""
    vision_route: str = ""
    vision_route_policy: str = ""
    vision_fallback_models: str = ""
    vision_timeout_seconds: int = 60
    vision_max_retries: int = 1
    vision_max_output_tokens: int = 1400
    allow_cloud_vision: bool = False
    send_ocr_to_cloud: bool = True
    vision_max_dimension: int = 4096
    vision_max_image_bytes: int = 10_485_760
    vision_image_format: str = "auto"
    pdf_min_chars_per_page: int = 120
    pdf_render_dpi: int = 160
    auto_image_strategy: str = "hybrid"

    @staticmethod
    def roots_from(value: str | list[str]) -> tuple[str, ...]:
        """A JSON array, a list, or paths joined by the platform's separator."""
        if isinstance(value, str):
            text = value.strip()
            value = json.loads(text) if text.startswith("[") else text.split(os.pathsep)
        return tuple(x.strip() for x in value if x.strip())

    @property
    def languages(self) -> str:
        return "+".join(x.strip() for x in self.ocr_languages.split("+") if x.strip()) or "eng"

    @property
    def base_url(self) -> str:
        """The given address, else that of a known provider's preset."""
        return self.vision_base_url.rstrip("/") or PRESETS.get(self.vision_provider, "")

    @property
    def model(self) -> str:
        """A preset's routing policy is a suffix of the model, if one is asked for and none is there."""
        suffix = self.vision_route_policy if self.vision_provider in PRESETS and ":" not in self.vision_model else ""
        return f"{self.vision_model}:{suffix}" if suffix else self.vision_model

    @property
    def fallback_models(self) -> tuple[str, ...]:
        return tuple(x.strip() for x in self.vision_fallback_models.split(",") if x.strip())

    @property
    def vision_configured(self) -> bool:
        return bool(self.base_url and self.vision_api_key and self.vision_model)

    @property
    def vision_usable(self) -> bool:
        """The cloud gate: configured and allowed."""
        return self.vision_configured and self.allow_cloud_vision

    @property
    def max_file_bytes(self) -> int:
        return self.max_file_mb * 1024 * 1024

    def problems(self) -> list[dict]:
        """What is wrong: field, message, fatal and hint."""
        found: list[dict] = []

        def say(field: str, message: str, fatal: bool, hint: str) -> None:
            found.append({"field": field, "message": message, "fatal": fatal, "hint": hint})

        if not self.allowed_roots:
            say("allowed_roots", "no folder may be read", True, "name at least one folder")
        for root in self.allowed_roots:
            if not os.path.isabs(os.path.expanduser(root)):
                say("allowed_roots", f"{root} is not absolute", True, "give absolute folders")
            elif not os.path.isdir(os.path.expanduser(root)):
                there = os.path.exists(os.path.expanduser(root))
                say("allowed_roots", f"{root} is not a folder" if there else f"{root} does not exist", False, "create the folder or leave it out")
        for name in ("max_file_mb", "max_pages", "max_image_pixels", "max_output_chars", "process_timeout_seconds", "vision_max_output_tokens", "pdf_render_dpi"):
            if getattr(self, name) < 1:
                say(name, f"{name} is below 1", True, "give a positive number")
        if 1 <= self.max_output_chars < 500:
            say("max_output_chars", "below 500 characters nearly every answer is cut", False, "give 2000 or more")
        if self.vision_max_dimension <= 96:
            say("vision_max_dimension", "a tile has to be longer than its overlap of 96", True, "give more than 96")
        if self.vision_image_format not in ("auto", "png", "jpeg"):
            say("vision_image_format", "unknown image format", True, "auto, png or jpeg")
        if self.auto_image_strategy not in ("hybrid", "ocr_first", "vision_first"):
            say("auto_image_strategy", "unknown strategy", True, "hybrid, ocr_first or vision_first")
        if self.base_url and urlsplit(self.base_url).scheme not in ("http", "https"):
            say("vision_base_url", "not an http(s) address", True, "give the root of the provider's interface")
        if any((self.vision_base_url, self.vision_api_key, self.vision_model)) and not self.vision_configured:
            missing = [n for n, there in (("vision_base_url", self.base_url), ("vision_model", self.vision_model), ("vision_api_key", self.vision_api_key)) if not there]
            say("vision_model", f"vision is configured in part; missing: {', '.join(missing)}", False, "address, key and model belong together")
        if self.vision_configured and not self.allow_cloud_vision:
            say("allow_cloud_vision", "a provider is configured, but nothing may be sent to it", False, "allow it if images may leave this place; they can hold secrets")
        if self.allow_cloud_vision and not self.vision_configured:
            say("allow_cloud_vision", "allowed but not configured", False, "configure a provider")
        return found

    def redacted(self) -> dict:
        return {f.name: REDACTED if any(h in f.name for h in SECRET_HINTS) and getattr(self, f.name) and isinstance(getattr(self, f.name), str) else getattr(self, f.name) for f in fields(self)}

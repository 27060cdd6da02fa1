"""Which language model a statistical recognizer would load: sizes by language, memory and speed; no model is loaded here."""

from __future__ import annotations

from dataclasses import dataclass

from umbra.errors import ValidationError


@dataclass(frozen=True)
class Size:
    name: str
    short: str
    memory_mb: int
    load_ms: int
    accuracy: float


# Sizes from small to large, and languages.
SIZES = (Size("small", "sm", 15, 800, 0.85), Size("medium", "md", 50, 1500, 0.88), Size("large", "lg", 150, 3000, 0.91))
LANGUAGES = ("en", "es", "fr", "de", "it", "nl", "pt")


def model(language: str, size: str = "small") -> str:
    """The public name of a language's model."""
    base, own = language.split("-")[0].lower(), next((s for s in SIZES if s.name == size), None)
    if base not in LANGUAGES or own is None:
        raise ValidationError(f"no {size} model of {language}")
    return f"{base}_core_{'web' if base == 'en' else 'news'}_{own.short}"


def recommended(memory_mb: int | None = None, fast: bool = False) -> Size:
    """The largest size within the memory, the smallest where speed counts or nothing fits, else the middle one."""
    if fast:
        return SIZES[0]
    if memory_mb is None:
        return SIZES[1]
    return next((s for s in reversed(SIZES) if s.memory_mb <= memory_mb), SIZES[0])

"""Settings: defaults below stored values below overrides."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    # The defaults.
    server_url: str = "http://127.0.0.1:8000"
    use_gpu: bool = True
    mode: str = "balanced"
    threshold: float = 1.05
    tile: int = 8
    quality: float = 0.72
    strict_capture: bool = False
    max_steps: int = 8
    want_tile_map: bool = False

    def __post_init__(self) -> None:
        if self.mode not in ("balanced", "dom-only", "paranoid"):
            raise ValueError(f"mode {self.mode}")
        if not (0.5 <= self.threshold <= 2.2 and self.tile in (4, 8, 16) and 1 <= self.max_steps <= 30 and 0 < self.quality <= 1):
            raise ValueError(f"out of range: {self}")


def layered(*layers: dict) -> Settings:
    """Later layers win; None and unknown names are passed over."""
    names = {f.name for f in fields(Settings)}
    out = Settings()
    for layer in layers:
        out = replace(out, **{k: v for k, v in layer.items() if k in names and v is not None})
    return out

"""Colours of traits."""

from __future__ import annotations

import numpy as np

#: The two categorical palettes, in order.
TABLEAU10 = ("#4e79a7", "#f28e2c", "#e15759", "#76b7b2", "#59a14f", "#edc949", "#af7aa1", "#ff9da7", "#9c755f", "#bab0ab")
SET3 = ("#8dd3c7", "#ffffb3", "#bebada", "#fb8072", "#80b1d3", "#fdb462", "#b3de69", "#fccde5", "#d9d9d9", "#bc80bd", "#ccebc5", "#ffed6f")


def rgb(colour: str) -> tuple[int, int, int] | None:
    """Channels of #rrggbb; None for anything else."""
    digits = colour.removeprefix("#")
    try:
        return (int(digits[0:2], 16), int(digits[2:4], 16), int(digits[4:6], 16)) if len(digits) == 6 else None
    except ValueError:
        return None


#: From linear channels to responses of the eye's cones, from their cube roots to OKLab (public: Ottosson, 2020).
_CONES = np.array(((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005)))
_LAB = np.array(((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660)))
#: Lightness of the darkest and the lightest variants.
DARK, LIGHT = 0.35, 0.9


def with_lightness(colour: str, lightness: float) -> str:
    """The colour at another perceived lightness (0 to 1), its hue kept and as much of its chroma as the screen can show."""
    channels = rgb(colour)
    if channels is None:
        return colour
    c = np.array(channels) / 255
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    _, hue_a, hue_b = _LAB @ np.cbrt(_CONES @ linear)
    for chroma in np.linspace(1, 0, 21):
        light = np.linalg.solve(_CONES, np.linalg.solve(_LAB, np.array((lightness, hue_a * chroma, hue_b * chroma))) ** 3)
        if light.min() >= -1e-6 and light.max() <= 1 + 1e-6:
            break
    light = np.clip(light, 0, 1)
    return "#" + bytes(np.rint(255 * np.where(light <= 0.0031308, 12.92 * light, 1.055 * light ** (1 / 2.4) - 0.055)).astype(int).tolist()).hex()


def trait_colours(n: int) -> list[str]:
    """The smaller palette that is enough; beyond both, the first, then its hues in rounds of equal steps of lightness."""
    for palette in (TABLEAU10, SET3):
        if n <= len(palette):
            return list(palette[:n])
    more = n - len(TABLEAU10)
    rounds = -(-more // len(TABLEAU10))
    levels = np.linspace(DARK, LIGHT, rounds + 1).tolist()
    return [*TABLEAU10, *(with_lightness(TABLEAU10[k % len(TABLEAU10)], levels[k // len(TABLEAU10)]) for k in range(more))]


def assigned(existing: list[str], n: int) -> list[str]:
    """Colours stay as they are unless the number of traits changed."""
    return existing if len(existing) == n else trait_colours(n)

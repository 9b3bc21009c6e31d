"""Themes, layout and the checked settings of a chart."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from ..errors import ConfigurationError
from ..functions.rowwise import rgba

#: Themes.
THEMES = {
    "classic": {"bg": "#000000", "up": "#00FF00", "down": "#FF0000", "grid": "#333333"},
    "modern": {"bg": "#1E1E1E", "up": "#26A69A", "down": "#EF5350", "grid": "#424242"},
    "tradingview": {"bg": "#131722", "up": "#089981", "down": "#F23645", "grid": "#2A2E39"},
    "light": {"bg": "#FFFFFF", "up": "#26A69A", "down": "#EF5350", "grid": "#E0E0E0"},
}
#: Layout.
CHART_PART, VOLUME_PART, SPACING, TICK, BOX = 0.7, 0.3, 0.2, 0.4, 0.8
GRID_ROWS, GRID_COLUMNS, VOLUME_ALPHA, AREA_ALPHA, GRID_ALPHA = 10, 20, 0.5, 0.2, 0.25
#: Other names of themes.
STYLES = {"binance": "tradingview", "binancedark": "tradingview"}
#: Names of chart types.
KINDS = {"candle": "candle", "candlestick": "candle", "ohlc": "ohlc", "bars": "ohlc", "line": "line", "hollow": "hollow", "hollow_and_filled": "hollow", "renko": "renko", "pnf": "pnf", "pointandfigure": "pnf"}
#: Colours of overlaid lines, in turn.
LINES = ("#F5B041", "#5DADE2", "#AF7AC5", "#58D68D", "#EC7063", "#F7DC6F")


@dataclass(frozen=True)
class Style:
    width: int = 1920
    height: int = 1080
    theme: str = "classic"
    bg: str | None = None
    up: str | None = None
    down: str | None = None
    grid: str | None = None
    show_grid: bool = True
    show_volume: bool = True
    fill_area: bool = False
    line_width: float = 2.0
    wick_width: float = 1.0

    def __post_init__(self) -> None:
        if not (100 <= self.width <= 8192 and 100 <= self.height <= 8192):
            raise ConfigurationError(f"width and height must be 100 to 8192 pixels, got {self.width} x {self.height}")
        for name in ("line_width", "wick_width"):
            if not 0.1 <= getattr(self, name) <= 20:
                raise ConfigurationError(f"{name} must be 0.1 to 20, got {getattr(self, name)}")
        if STYLES.get(self.theme, self.theme) not in THEMES:
            raise ConfigurationError(f"unknown theme {self.theme!r}")
        for c in (self.bg, self.up, self.down, self.grid):
            if c is not None:
                rgba(c)

    def color(self, name: str) -> str:
        return getattr(self, name) or THEMES[STYLES.get(self.theme, self.theme)][name]

    @property
    def chart_height(self) -> int:
        return int(self.height * CHART_PART) if self.show_volume else self.height

    @property
    def volume_height(self) -> int:
        return int(self.height * VOLUME_PART)

    def merged(self, **changes) -> Style:
        return replace(self, **changes)

    def as_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_settings(cls, settings: dict) -> Style:
        """From a dictionary; a name that is no setting is an error."""
        if unknown := set(settings) - {f.name for f in fields(cls)}:
            raise ConfigurationError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**settings)


def kind_of(name: str) -> str:
    try:
        return KINDS[name.lower()]
    except KeyError:
        raise ConfigurationError(f"unknown chart type {name!r}") from None

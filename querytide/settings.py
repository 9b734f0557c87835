"""Parameters of the trend job, with the values used when nothing else is given."""

from __future__ import annotations

from dataclasses import dataclass

from querytide.errors import InvalidArgumentError

# The stop words a fresh installation starts with.
DEFAULT_STOP_WORDS = (
    "скам",
    "накрутка отзывов вб",
    "вейп",
    "сигареты",
    "купить паспорт",
    "хакерский софт ",
    "курительные смеси",
)

# The bounds of the public top-list request.
TOP_LIMIT_DEFAULT = 50
TOP_LIMIT_MIN = 1
TOP_LIMIT_MAX = 100


@dataclass(frozen=True)
class Settings:
    """All durations are whole seconds."""

    rate_limit: int = 100
    rate_ttl: int = 10
    bucket: int = 5
    window: int = 300
    tick: int = 1
    top_limit: int = 1000

    def __post_init__(self) -> None:
        for name, value in vars(self).items():
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise InvalidArgumentError(f"{name} must be a whole number of at least 1, got {value!r}")
        if self.window % self.bucket:
            raise InvalidArgumentError(f"window {self.window} is not a multiple of bucket {self.bucket}")

    @property
    def slots(self) -> int:
        """Number of buckets that are live at any time."""
        return self.window // self.bucket

"""Search-trend analytics as Spark jobs: filter search events, count them per bucket, publish the top list."""

from querytide.errors import QuerytideError, WordsNotFoundError
from querytide.settings import Settings

__all__ = ["QuerytideError", "Settings", "WordsNotFoundError"]

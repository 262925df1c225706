"""wavecrawl: captured web pages → scoped, deduplicated Markdown corpus, on Spark."""

from .api import *  # noqa: F401,F403
from .api import __all__  # noqa: F401

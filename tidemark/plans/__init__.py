"""The query catalogue; importing it registers every query."""

from . import catalog, clip_catalog  # noqa: F401

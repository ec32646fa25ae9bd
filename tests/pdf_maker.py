"""The files that tests read: see ``quire.sources.samples``."""

from quire.sources.samples import *  # noqa: F403

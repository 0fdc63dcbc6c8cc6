"""Feeds and their registry; importing this package registers the built-in ones."""

from wakeline.sources import aishub, aisstream, dma, finland, gfw, noaa  # noqa: F401

"""Where tables come from: named databases, each with a driver."""

from weftline.sources.catalog import Catalog, register_driver

__all__ = ["Catalog", "register_driver"]

"""weftline: declarative data jobs and large-corpus operators on Apache Spark."""

from importlib import import_module

__version__ = "0.1.0"

_EXPORTS = {
    "Job": "plans.job",
    "run_all": "plans.job",
    "Catalog": "sources",
    "register_driver": "sources",
    "register_sink": "sinks",
    "register_function": "functions",
    "register_udf": "functions",
    "register_fold": "functions.registry",
    "register_cast": "lang.casts",
    "register_transform": "operators.shape",
    "run_stream": "streaming",
    "StateTable": "streaming",
}
__all__ = [*_EXPORTS, "__version__"]


def __getattr__(name: str):
    """The public names, imported when they are asked for, so that workers load no more than they use."""
    if name not in _EXPORTS:
        raise AttributeError(name)
    return getattr(import_module(f"weftline.{_EXPORTS[name]}"), name)

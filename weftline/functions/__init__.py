"""Functions, called as ``@name`` or ``@family::method``, over typed values."""

from weftline.functions.registry import FOLDS, FUNCTIONS, call, register_fold, register_function, register_udf

__all__ = ["FOLDS", "FUNCTIONS", "call", "register_fold", "register_function", "register_udf"]

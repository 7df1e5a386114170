"""Computed predicates and function terms as column expressions."""

from lodestone.functions.python import PythonFunction, load_computed, register_all
from lodestone.functions.standard import Arg, FunctionError, arity, evaluate, invert, names

__all__ = ["Arg", "FunctionError", "PythonFunction", "arity", "evaluate", "invert", "load_computed", "names", "register_all"]

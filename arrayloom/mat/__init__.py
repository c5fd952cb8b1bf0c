"""MATLAB 7.3 files: variables as Python values, and as array frames in MATLAB's index order."""

from .names import dedupe_name, is_valid_name, sanitize_name
from .values import CLASSES, Char, Empty, MatBuilder, read_mat, register_table, variable_frame, variables, write_mat

__all__ = ["CLASSES", "Char", "Empty", "MatBuilder", "dedupe_name", "is_valid_name", "read_mat", "register_table", "sanitize_name", "variable_frame", "variables", "write_mat"]

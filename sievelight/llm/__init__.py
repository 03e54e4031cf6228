"""Corpus preparation for training data: ten operators, each in a module of its own.

Nothing outside this subpackage imports it. Every operator reads only the columns it
names, so further columns of any name ride along or are ignored, as its docstring says.
"""

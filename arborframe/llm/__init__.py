"""Operators for preparing large language-model training corpora.

Nothing outside this folder imports it, so the folder can be removed as a whole.
"""
